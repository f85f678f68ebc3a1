"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints of 64 bits come from the XXH64 of three-word shingles, by majority of each bit. The index over the distinct
fingerprints is a hierarchy of shared bits:

* Its upper nodes share whole blocks of bits. Two fingerprints that differ in at most three bits agree in one of four blocks of 16, so each stands
  below four upper nodes, one for each block. A node with more than `most` rows has nodes of its own below it, by four blocks of the bits that are
  left, and so on until 13 bits or fewer are left, of which there are 8192 patterns at most. Nodes are dealt over the cluster, so none grows with the input.
* Below, the rows of a node stand by the Gray rank of the bits left. Runs of 8, 64, 512, ... rows are nodes that factor out the bits which all
  their rows share. Pairs of nodes are followed from the top; each level adds the differences in the bits that became shared there, and a pair whose
  accumulated differences exceed the radius is left with all its rows. So is one whose rows are all in one component already.

A node gives the edges of a spanning forest, never its pairs.

Defined cases: null and empty texts have the fingerprint zero and link like any other; fewer than three words
make one shingle; equal texts have equal fingerprints and so one component; a row with a null doc_id takes part,
its id never becomes the component's unless all are null; repeated rows each get a row; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.components import connected_components
from assayer.llm.shared import checkpointed, spare, typed, without
from assayer.llm.text import LOWER, SPACES, U64, blocks, column, gram_starts, raw, signed, words

RADIUS = 3
SHINGLE = 3
SEED = 42
_FAN = 8
_HEAD = 256
#: Rows of an upper node that one task searches by itself.
_MOST = 8192
#: With so few bits left a node has 8192 rows at most.
_FEW_BITS = 13
#: Pairs of nodes that are looked at in one go.
_PAIRS = 1 << 16


def blocks_below(mask: int) -> list[int]:
    """The shared bits of the four nodes below a node with these shared bits: a quarter of the bits left is added to each."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text as unsigned 64 bits."""
    out = [np.zeros(0, U64)]
    for a, b in blocks(texts):
        buf, offsets = raw(texts[a:b])
        w = words(buf, offsets, SPACES)
        keep = np.zeros(len(buf) + 1, bool)
        keep[:-1] = ~SPACES[buf]
        text_end = np.zeros(len(buf) + 1, bool)
        text_end[offsets] = True
        gaps = w.ends[~text_end[w.ends]]
        keep[gaps] = True
        norm = np.append(LOWER[buf], np.uint8(32))
        norm[gaps] = 32
        to = np.concatenate([[0], np.cumsum(keep)])
        data = norm[keep].tobytes()
        counts = w.counts
        at = gram_starts(w.first, shingle)
        short = np.flatnonzero((counts > 0) & (counts < shingle))
        starts = np.concatenate([at, w.first[short]])
        ends = np.concatenate([at + shingle - 1, w.first[short + 1] - 1])
        order = np.argsort(starts, kind="stable")
        starts, ends = to[w.starts[starts[order]]], to[w.ends[ends[order]]]
        hash64 = xxhash.xxh64_intdigest
        h = np.fromiter((hash64(data[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), U64, len(starts))
        per = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
        out.append(majority(h, per))
    return np.concatenate(out)


def majority(h: np.ndarray, per: np.ndarray) -> np.ndarray:
    """For each run of `per` hashes, the bits set in more than half of them."""
    result = np.zeros(len(per), U64)
    some = np.flatnonzero(per)
    if not len(some):
        return result
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at = np.concatenate([[0], np.cumsum(per[some])[:-1]])
    ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    packed = np.packbits(ones * 2 > per[some][:, None], axis=1, bitorder="little")
    result[some] = np.ascontiguousarray(packed).view("<u8").ravel()
    return result


def with_fingerprint(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "fp") -> DataFrame:
    """The `keep` columns and the fingerprint as a signed long."""
    keep = without(keep, out)
    own = spare(keep, "text")
    chosen = df.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias(own))

    def run(batches):
        for b in batches:
            fp = pa.array(signed(fingerprints(column(b, own))), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fp], names=[*keep, out])

    return chosen.mapInArrow(run, typed(df, keep, f"`{out}` bigint"))


# The index over one group, or over many small groups at once


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking rows a[i] and b[i]; a label is its component's smallest row."""
    while True:
        la, lb = labels[a], labels[b]
        if (la == lb).all():
            return labels
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


class Tree:
    """The nodes over rows that stand by group and Gray rank: level k has runs of 8 ** k rows, none across groups."""

    def __init__(self, fp: np.ndarray, starts: np.ndarray, labels: np.ndarray, radius: int):
        """starts: the first row of each group, and the end."""
        self.labels, self.radius = labels, radius
        sizes = np.diff(starts)
        place = np.arange(len(fp)) - np.repeat(starts[:-1], sizes)
        self.first, self.pattern, self.mask, self.one = [], [], [], []
        size = 1
        while True:
            at = np.flatnonzero(place % size == 0)
            ands, ors = np.bitwise_and.reduceat(fp, at), np.bitwise_or.reduceat(fp, at)
            low, high = np.minimum.reduceat(labels, at), np.maximum.reduceat(labels, at)
            self.first.append(np.append(at, len(fp)))
            self.pattern.append(ands)
            self.mask.append(~(ands ^ ors))
            self.one.append(np.where(low == high, low, -1))
            if size >= sizes.max():
                break
            size *= _FAN
        # a group is entered at the level where it is one node
        self.roots = [starts[:-1][(sizes <= _FAN**k) & ((sizes > _FAN ** (k - 1)) if k else False)] for k in range(len(self.first))]

    def search(self) -> np.ndarray:
        """The labels after all links within groups."""
        for k, rows in enumerate(self.roots):
            if len(rows):
                node = np.searchsorted(self.first[k], rows)
                none = np.zeros(len(rows), np.int64)
                self._follow(k, node, node, none, none.astype(U64))
        return self.labels

    def _follow(self, k: int, a: np.ndarray, b: np.ndarray, apart: np.ndarray, seen: np.ndarray) -> None:
        """Pairs of nodes of level k, with the differences found above and the bits that these were found in."""
        both = self.mask[k][a] & self.mask[k][b]
        apart = apart + np.bitwise_count((self.pattern[k][a] ^ self.pattern[k][b]) & both & ~seen)
        done = self.one[k]
        keep = (apart <= self.radius) & ((done[a] != done[b]) | (done[a] < 0))
        a, b, apart, both = a[keep], b[keep], apart[keep], both[keep]
        if not len(a):
            return
        if not k:
            self.labels = merged(self.labels, a, b)
            return
        # the nodes below: each of a's with each of b's, in bounded portions
        rows = self.first[k - 1]
        fa, ea, fb, eb = (np.searchsorted(rows, self.first[k][x]) for x in (a, a + 1, b, b + 1))
        n = (ea - fa) * (eb - fb)
        portion = np.cumsum(n) // _PAIRS
        for p in np.split(np.arange(len(a)), np.flatnonzero(np.diff(portion)) + 1):
            m = n[p]
            of = np.repeat(p, m)
            nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            width = (eb - fb)[of]
            x, y = fa[of] + nth // width, fb[of] + nth % width
            ok = x < y if k == 1 else x <= y
            below = x[ok], y[ok], apart[of[ok]], both[of[ok]]
            del of, nth, width, x, y, ok
            self._follow(k - 1, *below)


def forest(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links in each group; rows stand by group and Gray rank."""
    n = len(fp)
    if not n:
        return fp, fp
    starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [n]])
    labels = np.arange(n)
    # neighbours in Gray order first: what they join needn't be searched
    for d in range(1, _FAN):
        near = np.flatnonzero((np.bitwise_count(fp[:-d] ^ fp[d:]) <= radius) & (group[:-d] == group[d:])) if n > d else np.zeros(0, np.int64)
        labels = merged(labels, near, near + d)
    labels = Tree(fp, starts, labels, radius).search()
    # members link to the head of their run of 256, heads to the head before: no node has many edges
    order = np.argsort(labels, kind="stable")
    own = labels[order]
    fresh = np.concatenate([[True], own[1:] != own[:-1]])
    rank = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    head = np.where(rank % _HEAD, np.arange(n) - rank % _HEAD, np.arange(n) - _HEAD)
    linked = rank > 0
    return fp[order[linked]], fp[order[head[linked]]]


def _search_batches(batches):
    """Streams rows by group: whole groups are searched, many at once, as soon as the next one begins."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0

    def flush(last: bool):
        nonlocal held, rows
        if not held:
            return None
        k, key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (key[1:] != key[:-1])])
        cut = len(fp) if last else int(np.flatnonzero(fresh)[-1])
        held = [(k[cut:], key[cut:], fp[cut:])] if cut < len(fp) else []
        rows = len(fp) - cut
        if not cut:
            return None
        a, b = forest(fp[:cut], np.cumsum(fresh[:cut]))
        return pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(signed(b))], names=["a", "b"])

    for batch in batches:
        k, key, fp = (np.asarray(column(batch, c)) for c in ("node", "key", "fp"))
        held.append((k, key, fp.view(U64)))
        rows += len(fp)
        if rows >= 20_000 and (out := flush(False)) is not None:
            yield out
    if (out := flush(True)) is not None:
        yield out


def _gray_rank(x):
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x


def _below(rows: DataFrame, masks: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """Rows (node, fp) dealt to the four nodes below theirs, as (node, key, mask, fp), and the shared bits of these nodes by their number."""
    below = [(node, 4 * node + 1 + j, _long(m)) for node, mask in masks.items() for j, m in enumerate(blocks_below(mask))]
    # as many rows as there are block choices down to this depth, whatever the input
    table = rows.sparkSession.createDataFrame(below, "node int, child int, mask bigint")
    dealt = rows.join(F.broadcast(table), "node").select(F.col("child").alias("node"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "mask", "fp")
    return dealt, {c: m & (1 << 64) - 1 for _, c, m in below}


def links(nodes: DataFrame, most: int = _MOST) -> DataFrame:
    """Spanning edges (a, b) between distinct fingerprints of column `fp` that differ in at most three bits."""
    n = nodes.count()
    rows, masks = nodes.select(F.lit(0).alias("node"), "fp"), {0: 0}
    ready = None
    while True:
        rows, masks = _below(rows, masks)
        fixed = min(m.bit_count() for m in masks.values())
        last = 64 - fixed <= _FEW_BITS
        # where the mean node is large already, all are dealt again without a count
        if not last and n / 2.0**fixed > most / 4:
            rows = rows.select("node", "fp")
            continue
        large = None if last else checkpointed(rows.groupBy("node", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("node", "key"))
        if large is None or not large.limit(1).count():
            ready = rows if ready is None else ready.unionByName(rows)
            break
        small = rows.join(large, ["node", "key"], "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        rows = rows.join(large, ["node", "key"], "left_semi").select("node", "fp")
    ranked = ready.select("node", "key", "fp", _gray_rank(F.col("fp").bitwiseAND(F.bitwise_not("mask"))).alias("rank"))
    dealt = ranked.repartition("node", "key").sortWithinPartitions("node", "key", "rank", "fp")
    return dealt.mapInArrow(_search_batches, "a bigint, b bigint")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, root, component_id) of every row; root is the component's smallest fingerprint, component_id the smallest doc_id reachable over links."""
    docs = checkpointed(with_fingerprint(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", ("doc_id",)))
    nodes = checkpointed(docs.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = connected_components(links(nodes.select("fp")))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = placed.join(named, "root").select("fp", "root", "component_id")
    return docs.join(classes, "fp").select("doc_id", "fp", "root", "component_id")


def hex16(fp: str = "fp"):
    """The fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
