"""Document fingerprints by spot signatures.

A signature is a chain: a common word (the anchor) and the two content words that follow it; frequent words in
between are passed over. A text's fingerprint is the set of its chains, so what stands around the running text
(menus, numbers, names) hardly counts. Of the words that stand in no chain a text has some as signatures by themselves: as many as their share
of its words, picked by hash. Those are all words of a text without a chain and hardly any of running text. One rule for all texts, so a text that gains
its first chains by an edit keeps nearly all of the others. A signature that a text repeats counts as often (the n-th time as a signature of its own).

Two fingerprints are compared by pruned Jaccard: sets are partitioned by length such that sets of a likeness of `least` or more (default 0.05) are in
one partition or in neighbouring ones; pairs further apart, and those whose Jaccard turns out lower, have likeness 0. Signatures have 32 bits.

Defined cases: null counts as an empty text; an empty text has the empty fingerprint, and two empty ones have
likeness 1; a text without words takes its whole text as signature; equal texts
have equal fingerprints. Rows are put in order by doc_id (null last), then the hash of the text, then the text, so repeated rows follow each other;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import bounded_batches, spare, typed, without
from assayer.llm.text import NON_WORD, U64, blocks, column, mix, raw, words

CHAIN = 2
#: Common words of English, French, German and Spanish; anchors, and no content.
COMMON_WORDS = (
    "the of and to a in is that it was for on are as with be by at this an or from not but have has had were they which "
    "le la les de des du et un une que qui est en pour par dans sur pas au aux ce se sont il elle avec "
    "der die das und den dem ein eine ist nicht von zu mit auf für sich im es auch als an "
    "el los las y del una por con para su al lo como más o sus si no"
)
LEAST = 0.05
_BLOCK = 1 << 20
_LOWEST = -(1 << 63)
_MIX = 0x9E3779B97F4A7C15


def _common() -> np.ndarray:
    w = words(*raw(pa.array(COMMON_WORDS.split())), NON_WORD)
    return np.unique(w.hashes())


_COMMON = _common()


def _numbered(owner: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The signatures, told apart by how often their text has had them before."""
    order = np.lexsort((s, owner))
    fresh = np.ones(len(s), bool)
    fresh[1:] = (owner[order][1:] != owner[order][:-1]) | (s[order][1:] != s[order][:-1])
    at = np.arange(len(s))
    times = np.empty(len(s), np.int64)
    times[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return np.where(times > 0, mix(s + times.astype(U64) * U64(_MIX)), s)


class Sets:
    """The signature sets of a block of texts: `packed` holds text << 32 | signature, sorted, each once."""

    def __init__(self, packed: np.ndarray, n: int):
        self.packed, self.n = packed, n
        self.at = np.searchsorted(packed, np.arange(n + 1).astype(U64) << U64(32))
        self.sizes = np.diff(self.at)

    @classmethod
    def of(cls, texts: pa.Array, chain: int = CHAIN) -> Sets:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        w = words(*raw(pc.utf8_lower(texts)), NON_WORD)
        n, h, doc = len(texts), w.hashes(), w.doc
        at = np.minimum(np.searchsorted(_COMMON, h), len(_COMMON) - 1)
        common = _COMMON[at] == h
        content = np.flatnonzero(~common)
        anchor = np.flatnonzero(common)
        nth = np.searchsorted(content, anchor)
        ok = nth + chain <= len(content)
        anchor, nth = anchor[ok], nth[ok]
        if len(anchor):
            inside = doc[content[nth + chain - 1]] == doc[anchor]
            anchor, nth = anchor[inside], nth[inside]
        s = mix(h[anchor] + U64(1))
        for k in range(chain):
            s = mix(s * U64(_MIX) + h[content[nth + k]])
        owner = doc[anchor]
        # words outside chains, by their share; without words: the text itself
        outside = np.ones(len(h), bool)
        outside[anchor] = False
        for k in range(chain):
            outside[content[nth + k]] = False
        alone = np.flatnonzero(outside)
        share = np.bincount(doc[alone], minlength=n) / np.maximum(w.counts, 1)
        single = _numbered(doc[alone], mix(h[alone] ^ U64(_MIX)))
        keep = mix(single) / 2.0**64 <= share[doc[alone]]
        owner, s = np.concatenate([owner, doc[alone[keep]]]), np.concatenate([_numbered(owner, s), single[keep]])
        odd = np.flatnonzero((w.counts == 0) & (np.asarray(pc.binary_length(texts)) > 0))
        if len(odd):
            owner = np.concatenate([owner, odd])
            s = np.concatenate([s, np.array([xxhash.xxh64_intdigest(texts[int(i)].as_py()) for i in odd], U64)])
        return cls(np.unique((owner.astype(U64) << U64(32)) | (s >> U64(32))), n)

    def fingerprints(self) -> list[str]:
        flat = (self.packed & U64(0xFFFFFFFF)).astype("<u4")
        return [base64.b64encode(flat[a:b].tobytes()).decode() for a, b in zip(self.at, self.at[1:], strict=False)]


def length_part(sizes: np.ndarray, least: float) -> np.ndarray:
    """The partition of each set by its length; sets of a Jaccard of `least` or more are in one partition or in neighbouring ones. An empty set is alone."""
    return np.where(sizes > 0, np.floor(np.log(np.maximum(sizes, 1)) / -np.log(least) + 1e-9).astype(np.int64), -9)


def likeness(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, least: float = LEAST) -> np.ndarray:
    """Jaccard of pairs of sets, packed by pair (pair << 32 | signature), from `least` up, else 0. Pairs from partitions too far apart aren't intersected."""
    n = len(na)
    may = (np.abs(length_part(na, least) - length_part(nb, least)) <= 1) & (np.minimum(na, nb) >= least * np.maximum(na, nb))
    pair = lambda x: (x >> U64(32)).astype(np.int64)
    both = np.intersect1d(a[may[pair(a)]], b[may[pair(b)]], assume_unique=True)
    common = np.bincount(pair(both), minlength=n)
    union = na + nb - common
    j = np.where(union > 0, common / np.maximum(union, 1), 1.0)
    return np.where(may & (j >= least), j, 0.0)


def jaccard(x: str, y: str, least: float = LEAST) -> float:
    """The likeness of two fingerprints."""
    a, b = (np.frombuffer(base64.b64decode(f), "<u4").astype(U64) for f in (x, y))
    one = lambda v: np.array([len(v)])
    return float(likeness(a, one(a), b, one(b), least)[0])


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, the fingerprint and its number of signatures."""
    keep = without(keep, "fingerprint", "n_signatures")
    own = spare(keep, "text")
    chosen = df.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias(own))

    def run(batches):
        for batch in batches:
            for a, b in blocks(column(batch, own)):
                part = batch.slice(a, b - a)
                s = Sets.of(column(part, own))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s.fingerprints()), pa.array(s.sizes, pa.int64())], names=[*keep, "fingerprint", "n_signatures"])

    return chosen.mapInArrow(run, typed(df, keep, "fingerprint string", "n_signatures bigint"))


# Neighbours in descending order of doc_id


def _in_order(docs: DataFrame) -> DataFrame:
    """(part, ctx, place, check, doc_id, text): rows dealt by ranges of descending keys, each range with the first row of the next one as ctx = 1.

    `place` is the key, reversed; rows of one key follow by the hash of their text, `check`. The limits come from a quantile sketch of the places, at most one
    for each shuffle partition, so what the driver holds doesn't grow with the table; where limits fall on one key, its rows are cut by equal parts of the
    hash, so no key fills a task but by equal rows. Texts are moved once.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    keyed = docs.select(F.bitwise_not(key).alias("place"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("check"), "doc_id", "text")
    sketch = keyed.approxQuantile("place", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    limits = np.array(sorted(min(int(x), (1 << 63) - 1) for x in sketch), np.int64)

    def part_of(place: np.ndarray, check: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(limits, place, "left"), np.searchsorted(limits, place, "right")
        share = (check.astype(np.float64) / 2.0**64 + 0.5).clip(0, 1 - 1e-12)
        return (low + np.floor(share * (high - low)).astype(np.int64)).astype(np.int32)

    @F.pandas_udf("int")
    def part(place: pd.Series, check: pd.Series) -> pd.Series:
        return pd.Series(part_of(place.to_numpy(), check.to_numpy()))

    first = F.min(F.struct("place", "check")).alias("head")
    heads = {r.part: tuple(r.head) for r in keyed.select("place", "check").withColumn("part", part("place", "check")).groupBy("part").agg(first).collect()}
    filled = sorted(heads)
    before = {heads[p]: filled[k - 1] for k, p in enumerate(filled) if k}
    if filled:
        before[heads[filled[0]]] = filled[-1]
    ordered = sorted(before)
    head_place, head_check = (np.array([h[i] for h in ordered], np.int64) for i in (0, 1))
    to = np.array([before[h] for h in ordered], np.int32)

    @F.pandas_udf("int")
    def context(place: pd.Series, check: pd.Series) -> pd.Series:
        out = np.full(len(place), -1, np.int32)
        place, check = place.to_numpy(), check.to_numpy()
        # heads of one place are as many as parts that its rows are cut into
        low, high = np.searchsorted(head_place, place, "left"), np.searchsorted(head_place, place, "right")
        for shift in range(int((high - low).max(initial=0))):
            at = np.minimum(low + shift, max(0, len(ordered) - 1))
            hit = (low + shift < high) & (head_check[at] == check)
            out[hit] = to[at[hit]]
        return pd.Series(out)

    own = F.struct(part("place", "check").alias("part"), F.lit(0).alias("ctx"))
    other = F.struct(context("place", "check").alias("part"), F.lit(1).alias("ctx"))
    rows = keyed.withColumn("own", own).withColumn("other", other)
    rows = rows.select("place", "check", "doc_id", "text", F.explode(F.when(F.col("other.part") >= 0, F.array("own", "other")).otherwise(F.array("own"))).alias("s"))
    rows = rows.select("s.part", "s.ctx", "place", "check", "doc_id", "text")
    return rows.repartitionById(parts, "part").sortWithinPartitions("part", "ctx", "place", "check", F.col("text").asc_nulls_first())


def edited(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each text beside its edited form, in which the next document's beginning takes the place of the last third.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def emit(rows: list) -> pa.RecordBatch | None:
        own = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        if not own:
            return None
        texts = [r[3] for r in rows]
        changed = [texts[i][: len(texts[i]) - len(texts[i]) // 3] + texts[i + 1][: len(texts[i]) // 3] for i in own]
        a, b = Sets.of(pa.array(texts)), Sets.of(pa.array(changed))
        pick = np.array(own)
        # packed again by pair: text i against its edited form, and against text i + 1
        lists = lambda at: (np.concatenate([a.packed[a.at[i] : a.at[i + 1]] & U64(0xFFFFFFFF) | U64(k << 32) for k, i in enumerate(at)]), a.sizes[at])
        first, following = lists(pick), lists(pick + 1)
        prints, new = a.fingerprints(), b.fingerprints()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in own]),
                pa.array([len(texts[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array([prints[i] for i in own]),
                pa.array(new),
                pa.array(likeness(*first, b.packed, b.sizes)),
                pa.array(likeness(*first, *following)),
            ],
            names=names,
        )

    def run(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            columns = [column(batch, c).to_pylist() for c in ("part", "ctx", "doc_id", "text")]
            for part, ctx, i, t in zip(*columns, strict=True):
                held.append((part, ctx, i, t or ""))
                size += len(t or "") + 64
                if size > _BLOCK and len(held) > 1:
                    if (out := emit(held)) is not None:
                        yield out
                    held, size = held[-1:], len(held[-1][3])
        if len(held) > 1 and (out := emit(held)) is not None:
            yield out

    found = _in_order(docs).mapInArrow(run, f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found
