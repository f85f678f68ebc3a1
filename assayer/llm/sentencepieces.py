"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a block are cut where no piece can reach across (before each run of spaces), and the distinct segments are
joined into one index text. Its suffix array, ordered by as many characters as the longest piece has, is searched
for every piece of the vocabulary; the ranges found give all edges (place, length, piece), which are dealt to
their places. Relaxing the edges then gives each segment's pieces.

For models of type BPE the published result is that of merging, not that of the path with the largest sum of scores:
edges are therefore relaxed in the order of their merge ranks (the best edge between two neighbours first, the
leftmost of equals), which a path of summed scores would not reproduce. Only BPE models with an identity normaliser are
taken; others are refused when the model is read.

A worker keeps the ids of segments it has met (at most 200,000, then it starts anew), so a block indexes only what is new to the worker; on a corpus
that never repeats a word every segment is indexed.

Defined cases: null counts as empty, an empty text has no ids and decodes to an empty text; characters without
a piece become byte pieces, or the unknown piece where the model has none; ids outside the vocabulary are refused;
equal texts get equal ids; NUL characters are characters like others; an empty table gives an empty result; columns called like a result are
replaced by it. The model is read by the driver from a path given as
a parameter and sent to the tasks (its size is that of the vocabulary).
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import spare, typed, without
from assayer.llm.text import U64, blocks, column, prefix_sums, raw, spans_hash

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_BASES = (0x94D049BB133111EB, 0xBF58476D1CE4E5B9)
_LONG = 64
_BLOCK = 1 << 19
_NONE = np.int64(1 << 62)
#: Stands for the NUL character in index texts, in which 0 stands between segments.
_NUL = 0x110000


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True
    tables: dict = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, scores, kinds, trainer, normalizer = [], [], [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                p = dict(_fields(value))
                pieces.append(p.get(1, b"").decode())
                scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                kinds.append(p.get(3, _NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0):
            raise ValueError("the model must be of type BPE with leading spaces")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or _USER in kinds:
            raise ValueError("the model must keep texts as they are and have no user-defined pieces")
        return cls(pieces, scores, kinds, bool(normalizer.get(3, 1))).prepared()

    def prepared(self) -> Model:
        t = self.tables
        usable = [i for i, k in enumerate(self.kinds) if k in (_NORMAL, _UNUSED)]
        by_text = {self.pieces[i]: i for i in reversed(usable)}
        usable = sorted(by_text.values())
        if any(SPACE in p.lstrip(SPACE) for p in by_text):
            raise ValueError("pieces must not reach across spaces")
        t["longest"] = max((len(self.pieces[i]) for i in usable), default=1)
        wide = t["longest"]
        t["id"] = np.array(usable, np.int64)
        t["length"] = np.array([len(self.pieces[i]) for i in usable], np.int64)
        t["chars"] = np.zeros((len(usable), wide), np.uint32)
        for row, i in enumerate(usable):
            t["chars"][row, : len(self.pieces[i])] = [ord(c) or _NUL for c in self.pieces[i]]
        t["alphabet"], t["char_index"] = np.unique(t["chars"], return_inverse=True)
        t["char_index"] = t["char_index"].reshape(t["chars"].shape)
        t["inside"] = np.arange(wide) < t["length"][:, None]
        order = sorted(set(self.scores), reverse=True)
        place = {s: k for k, s in enumerate(order)}
        t["rank"] = np.array([place[s] for s in self.scores], np.int64)
        t["by_text"] = by_text
        t["unknown"] = self.kinds.index(_UNKNOWN) if _UNKNOWN in self.kinds else 0
        t["byte"] = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _BYTE}
        told = [bytes([int(p[1:-1], 16)]) if k == _BYTE else b"" if k == _CONTROL else " ⁇ ".encode() if k == _UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        t["bytes"] = np.frombuffer(b"".join(told), np.uint8)
        t["bytes_at"] = np.concatenate([[0], np.cumsum([len(x) for x in told])])
        return self

    def fallback(self, char: str) -> list[int]:
        byte = self.tables["byte"]
        return [byte.get(b, self.tables["unknown"]) for b in char.encode()] if byte else [self.tables["unknown"]]


def _sorted_suffixes(keys: list[np.ndarray]) -> np.ndarray:
    """The order of the suffixes: by the first key, and where that ties by the others."""
    order = np.argsort(keys[0])
    first = keys[0][order]
    tied = np.zeros(len(order), bool)
    same = first[1:] == first[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    at = np.flatnonzero(tied)
    if len(at) and len(keys) > 1:
        group = np.cumsum(np.concatenate([[True], ~same]))[at]
        sub = order[at]
        order[at] = sub[np.lexsort((*(k[sub] for k in keys[:0:-1]), group))]
    return order


class Index:
    """The suffix array of an index text, and the edges that the pieces have in it."""

    def __init__(self, model: Model, chars: np.ndarray):
        """chars: code points; 0 stands between segments."""
        t = model.tables
        wide = self.wide = t["longest"]
        alphabet, code = np.unique(chars, return_inverse=True)
        n, shift0 = len(chars), int(alphabet[0] != 0)
        # as many characters as fit go into one key, so that one key orders most suffixes
        bits = max(1, (len(alphabet) + shift0).bit_length())
        per = min(wide, 64 // bits)
        code = np.concatenate([code.astype(U64) + U64(shift0), np.zeros(2 * wide, U64)])
        shifts = (U64(bits) * np.arange(per - 1, -1, -1).astype(U64)).astype(U64)
        word = np.zeros(n + wide, U64)
        for j in range(per):
            word |= code[j : j + n + wide] << shifts[j]
        n_keys = -(-wide // per)
        keys = [word[per * k : per * k + n] for k in range(n_keys)]
        self.suffixes = _sorted_suffixes(keys)
        keys = [k[self.suffixes] for k in keys]
        # pieces in the block's alphabet
        at = np.minimum(np.searchsorted(alphabet, t["alphabet"]), len(alphabet) - 1)
        has = alphabet[at] == t["alphabet"]
        known = (has[t["char_index"]] | ~t["inside"]).all(axis=1)
        own = (at + shift0).astype(U64)[t["char_index"][known]]
        inside, length, ids = t["inside"][known], t["length"][known], t["id"][known]

        def pack(fill: int) -> np.ndarray:
            c = np.zeros((len(ids), n_keys * per), U64)
            c[:, :wide] = np.where(inside, own, U64(fill))
            c[:, wide:] = U64(fill)
            return np.bitwise_or.reduce(c.reshape(len(ids), n_keys, per) << shifts, axis=2)

        low, high = self._search(keys, pack(0), False), self._search(keys, pack((1 << bits) - 1), True)
        # edges by place: one slot for each place and length
        count = high - low
        piece = np.repeat(np.arange(len(ids)), count)
        place = self.suffixes[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[piece]]
        self.edges = np.full(n * wide, -1, np.int32)
        self.edges[place * wide + length[piece] - 1] = ids[piece]

    @staticmethod
    def _search(keys: list[np.ndarray], want: np.ndarray, after: bool) -> np.ndarray:
        """For each wanted key the number of suffixes before it (or up to it)."""
        low, high = np.searchsorted(keys[0], want[:, 0], "left"), np.searchsorted(keys[0], want[:, 0], "right")
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            less, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for k in range(1, len(keys)):
                have, need = keys[k][mid], want[open_, k]
                less |= equal & (have < need)
                equal &= have == need
            less |= equal & after
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        return low


def relax(model: Model, index: Index, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, place, length) of each segment's symbols after merging along the edges, all segments at once."""
    rank, wide = model.tables["rank"], index.wide
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    sizes = ends - starts
    for s in np.flatnonzero(sizes > _LONG):
        done.append(_relax_long(rank, index.edges, wide, int(s), int(starts[s]), int(ends[s])))
    short = np.flatnonzero((sizes > 0) & (sizes <= _LONG))
    n = sizes[short]
    seg = np.repeat(short, n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[short], n)
    size = np.ones(len(at), np.int64)
    while len(at):
        both = np.append(size[:-1] + size[1:], wide + 1)
        paired = np.append(seg[:-1] == seg[1:], False) & (both <= wide)
        key = np.full(len(at), _NONE)
        p = np.flatnonzero(paired)
        e = index.edges[at[p] * wide + both[p] - 1]
        ok = e >= 0
        key[p[ok]] = (rank[e[ok]] << 32) | p[ok]
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        best = np.minimum.reduceat(key, first)
        idle = best == _NONE
        counts = np.diff(np.append(first, len(at)))
        over = np.repeat(idle, counts)
        if over.any():
            done.append((seg[over], at[over], size[over]))
        win = (best[~idle] & 0xFFFFFFFF).astype(np.int64)
        size[win] = both[win]
        keep = ~over
        keep[win + 1] = False
        seg, at, size = seg[keep], at[keep], size[keep]
    if not done:
        return (np.zeros(0, np.int64),) * 3
    seg, at, size = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(at, kind="stable")
    return seg[order], at[order], size[order]


def _relax_long(rank: np.ndarray, edges: np.ndarray, wide: int, seg: int, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for one long segment, by a heap over its edges."""
    n = end - start
    size, right, left = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and (both := size[i] + size[j]) <= wide and (e := edges[(start + i) * wide + both - 1]) >= 0:
            heapq.heappush(heap, (int(rank[e]), i, both))

    for i in range(n):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = right[i]
        if not size[i] or j >= n or size[i] + size[j] != both:
            continue
        size[i], size[j] = both, 0
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        if left[i] >= 0:
            offer(left[i])
        offer(i)
    at = np.array([i for i in range(n) if size[i]], np.int64)
    return np.full(len(at), seg), at + start, np.array(size, np.int64)[at]


class Known:
    """The ids of segments that a task has met, so that a block indexes only what is new to the task; emptied when it holds `most`."""

    def __init__(self, most: int = 200_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.hash, self.check = np.zeros(0, U64), np.zeros(0, U64)
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The place of each segment, -1 for a new one. A hash held with another check counts as new."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where((self.hash[at] == h) & (self.check[at] == check), at, -1)

    def add(self, h: np.ndarray, check: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        if len(self.hash) + len(h) > self.most:
            self.clear()
        if len(h) > self.most:
            return
        start = np.concatenate([self.start, len(self.ids) + np.cumsum(counts) - counts])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        all_h = np.concatenate([self.hash, h])
        order = np.argsort(all_h, kind="stable")
        self.hash, self.start = all_h[order], start[order]
        self.check, self.count = np.concatenate([self.check, check])[order], np.concatenate([self.count, counts])[order]


def encode(model: Model, texts: pa.Array, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the texts of one block; `known` carries segments from block to block."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if model.dummy_prefix:
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    buf, offsets = raw(texts)
    n = len(offsets) - 1
    if not len(buf):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    # "▁" itself may stand in a text; it counts as a space
    data = buf.tobytes()
    space = buf == 32
    mark = SPACE.encode()
    if mark in data:
        hit = np.zeros(len(buf), bool)
        a = data.find(mark)
        while a >= 0:
            hit[a] = True
            a = data.find(mark, a + 3)
        space = space | hit | np.roll(hit, 1) | np.roll(hit, 2)
    fresh = np.zeros(len(buf), bool)
    fresh[1:] = space[1:] & ~space[:-1]
    fresh[offsets[offsets < len(buf)]] = True
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(buf))
    wide = buf.astype(U64) + U64(1)
    h, check = (spans_hash(prefix_sums(wide, b), starts, ends, b) for b in _BASES)
    _, rep, inverse = np.unique(h, return_index=True, return_inverse=True)
    if (check[rep][inverse] != check).any():  # two segments with one hash: take each by itself
        rep, inverse = np.arange(len(starts)), np.arange(len(starts))
    first = np.searchsorted(starts, offsets)
    known = Known() if known is None else known
    place = known.find(h[rep], check[rep])
    new = np.flatnonzero(place < 0)
    parts = [data[a:b] for a, b in zip(starts[rep[new]].tolist(), ends[rep[new]].tolist(), strict=True)]
    ids, counts = _encode_parts(model, parts)
    # all distinct segments in order: the known ones' ids stand before those of the new ones
    start = np.zeros(len(rep), np.int64)
    n = np.zeros(len(rep), np.int64)
    old = np.flatnonzero(place >= 0)
    start[old], n[old] = known.start[place[old]], known.count[place[old]]
    start[new], n[new] = len(known.ids) + np.cumsum(counts) - counts, counts
    pool = np.concatenate([known.ids, ids.astype(np.int32)])
    out = _spread(pool, start, n, inverse, first)
    known.add(h[rep[new]], check[rep[new]], ids, counts)
    return out


def _encode_parts(model: Model, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of distinct segments, end to end, and their numbers."""
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    joined = b"\0".join(parts)
    chars = np.frombuffer(joined.decode().replace(" ", SPACE).encode("utf-32-le"), np.uint32)
    if joined.count(b"\0") >= len(parts):  # some NULs are characters: separators are told from them by where the parts end
        chars = np.where(chars == 0, np.uint32(_NUL), chars)
        raw_bytes = np.frombuffer(joined, np.uint8)
        nth = np.cumsum((raw_bytes & 0xC0) != 0x80)
        chars[nth[np.cumsum([len(p) + 1 for p in parts[:-1]], dtype=np.int64) - 1] - 1] = 0
    breaks = np.flatnonzero(chars == 0)
    begin, end = np.concatenate([[0], breaks + 1]), np.append(breaks, len(chars))
    index = Index(model, chars)
    seg, at, size = relax(model, index, begin, end)
    ids, seg = _with_fallback(model, index.edges[at * index.wide + size - 1], seg, at, chars)
    return ids, np.bincount(seg, minlength=len(parts))


def _with_fallback(model: Model, ids: np.ndarray, seg: np.ndarray, at: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    missing = np.flatnonzero(ids < 0)
    if not len(missing):
        return ids, seg
    spelled = [model.fallback(chr(c) if c != _NUL else "\0") for c in chars[at[missing]].tolist()]
    times = np.ones(len(ids), np.int64)
    times[missing] = [len(x) for x in spelled]
    flat = np.repeat(ids, times)
    flat[np.repeat(ids < 0, times)] = [i for x in spelled for i in x]
    return flat, np.repeat(seg, times)


def _spread(ids: np.ndarray, start: np.ndarray, counts: np.ndarray, inverse: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all segments in order, from those of the distinct ones."""
    n = counts[inverse]
    total = np.cumsum(n)
    flat = ids[np.arange(total[-1] if len(total) else 0) - np.repeat(total - n, n) + np.repeat(start[inverse], n)]
    return flat.astype(np.int32, copy=False), np.concatenate([[0], total])[first]


def decode(model: Model, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The text of each run of ids; the space that encoding put first is taken away, bytes that form no character are replaced."""
    t = model.tables
    if len(ids) and (ids.min() < 0 or ids.max() >= len(model.pieces)):
        raise ValueError("ids outside the vocabulary")
    start = t["bytes_at"][ids]
    n = t["bytes_at"][ids + 1] - start
    total = np.concatenate([[0], np.cumsum(n)])
    data = t["bytes"][np.arange(total[-1]) - np.repeat(total[:-1], n) + np.repeat(start, n)].tobytes()
    cuts = total[offsets].tolist()
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        s = data[a:b].decode("utf-8", "replace")
        out.append(s[1:] if model.dummy_prefix and s[:1] == " " else s)
    return out


def _blocks(batches, text: str):
    for batch in batches:
        for a, b in blocks(column(batch, text), _BLOCK):
            yield batch.slice(a, b - a)


def encoded(df: DataFrame, model: Model, text: str = "text", out: str = "ids") -> DataFrame:
    """The same rows with a column of piece ids (replacing one of that name)."""
    held = df.sparkSession.sparkContext.broadcast(model)
    df = df.select(*(f"`{c}`" for c in without(df.columns, out) + [text] * (out.lower() == text.lower())))

    def run(batches):
        # a worker keeps the model, and so the segments, from task to task
        known = held.value.tables.setdefault("known", Known())
        for part in _blocks(batches, text):
            ids, offsets = encode(held.value, column(part, text), known)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], names=[*part.schema.names, out])

    return df.mapInArrow(run, typed(df, df.columns, f"`{out}` array<int>"))


def decoded(df: DataFrame, model: Model, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The same rows with a column of texts spelled by their ids; null ids count as none."""
    held = df.sparkSession.sparkContext.broadcast(model)
    df = df.drop(out)

    def run(batches):
        for part in batches:
            lists = column(part, ids)
            n = np.asarray(pc.fill_null(lists.value_lengths(), 0))
            texts = decode(held.value, np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(n)]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    return df.mapInArrow(run, typed(df, df.columns, f"`{out}` string"))


def round_trip(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, the ids of the text and the text decoded from them, in one pass."""
    held = df.sparkSession.sparkContext.broadcast(model)
    keep = without(keep, "ids", "decoded")
    own = spare(keep, "text")
    chosen = df.select(*(f"`{c}`" for c in keep), F.col(text).alias(own))

    def run(batches):
        # a worker keeps the model, and so the segments, from task to task
        known = held.value.tables.setdefault("known", Known())
        for part in _blocks(batches, own):
            ids, offsets = encode(held.value, column(part, own), known)
            back = pa.array(decode(held.value, ids, offsets), pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)), back], names=[*keep, "ids", "decoded"])

    return chosen.mapInArrow(run, typed(df, keep, "ids array<int>", "decoded string"))
