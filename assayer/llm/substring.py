"""Substring deduplication by Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A word goes when a window over it also starts in a document with a smaller id. Moving one row per window
would cost several times the input, so windows that can't repeat, and runs that repeat whole, are settled
by fewer rows, without loss:

* Cuts are words whose five-word hash is divisible by twenty, so equal text has equal cuts. A window can
  only stand in two documents if each cut in it does; one without a cut answers by its smallest five-word
  hash instead. Other windows are never sent.
* Some of the words start a chunk, again by their five-word hash. A chunk's key hashes all words that its windows span. If a smaller
  document holds the same key, all windows of the chunk repeat. The smallest holder of any window lies in
  a chunk that isn't settled so, hence it is enough to count the windows of the other chunks.

Window and chunk keys have 128 bits; counts are minima over document ids, combined before they are shuffled,
and joined back with a join that Spark can split where one key is hot. The flagged windows of a document
merge into maximal removal intervals.

Defined cases: a null text has no words; texts shorter than a window lose nothing; equal doc_ids aren't
smaller than each other, so repeated rows keep their words; rows with a null doc_id neither lose words nor
make others lose any; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.text import SPACES, U64, Grams, Words, blocks, column, gram_starts, mix, raw, signed, words

WINDOW = 50
GRAM = 5
CUT = 20
CHUNK = 48


class _Block:
    """Words, cuts, chunks and windows of a block of texts."""

    def __init__(self, texts: pa.Array, window: int):
        self.w: Words = words(*raw(texts), SPACES)
        h = self.w.hashes()
        self.grams = Grams(h)
        self.second = Grams(h, 1)
        self.window, self.n = window, len(texts)
        self.doc = self.w.doc
        self.windows = gram_starts(self.w.first, window)
        at = gram_starts(self.w.first, GRAM)
        long = self.w.counts[self.doc[at]] >= window
        at = at[long]
        g = self.grams.spans(at, at + GRAM)
        cut = g % U64(CUT) == 0
        self.cuts, self.cut_keys = at[cut], g[cut]
        # windows without a cut, and the smallest five-word hash of each
        n_cuts = np.zeros(len(h) + 1, np.int64)
        n_cuts[self.cuts + 1] = 1
        n_cuts = np.cumsum(n_cuts)
        inner = window - GRAM + 1
        self.bare = np.flatnonzero(n_cuts[self.windows + inner] == n_cuts[self.windows])
        all_grams = np.full(len(h), U64(2**64 - 1))
        all_grams[at] = g
        self.bare_keys = _sliding_min(all_grams, inner, self.windows[self.bare])
        # chunks: runs of window starts of one text, begun by its first window or a chunk cut
        can = np.zeros(len(h) + 1, bool)
        can[self.windows] = True
        begin = np.zeros(len(h) + 1, bool)
        begin[at[g % U64(CHUNK) == 0]] = True
        begin[self.w.first[:-1][self.w.counts >= window]] = True
        self.chunks = np.flatnonzero(begin & can)
        ends = np.concatenate([self.chunks[1:], [len(h)]])
        if len(self.chunks):
            last = self.w.first[self.doc[self.chunks] + 1] - window + 1
            ends = np.minimum(ends, last)
        self.chunk_ends = ends[: len(self.chunks)]
        spans = self.chunks, self.chunk_ends + window - 1
        self.chunk_keys, self.chunk_checks = self.grams.spans(*spans), self.second.spans(*spans) | U64(1)

    def among(self, doc: np.ndarray, keys: np.ndarray, lists: pa.Array) -> np.ndarray:
        """Whether each key is in its text's list."""
        flat, sizes = lists.flatten(), np.asarray(lists.value_lengths().fill_null(0))
        of = np.repeat(np.arange(self.n), sizes)
        return np.isin(_in_doc(doc, keys), _in_doc(of, np.asarray(flat).view(U64)))

    def open_windows(self, grams: pa.Array, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Whether each window start lies in a settled chunk, and whether it has to be counted."""
        settled = np.zeros(len(self.doc) + 2, np.int64)
        hit = self.among(self.doc[self.chunks], self.chunk_keys, chunks)
        np.add.at(settled, self.chunks[hit], 1)
        np.add.at(settled, self.chunk_ends[hit], -1)
        settled = np.cumsum(settled)[self.windows] > 0
        alone = np.zeros(len(self.doc) + 1, np.int64)
        alone[self.cuts[~self.among(self.doc[self.cuts], self.cut_keys, grams)] + 1] = 1
        alone = np.cumsum(alone)
        may = alone[self.windows + self.window - GRAM + 1] == alone[self.windows]
        may[self.bare] = self.among(self.doc[self.windows[self.bare]], self.bare_keys, grams)
        return settled, ~settled & may


def _sliding_min(x: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """The smallest of x[i : i + size] for each i in `at`, by doubling."""
    span, low = 1, x
    while span * 2 <= size:
        low = np.minimum(low[:-span], low[span:]) if len(low) > span else low
        span *= 2
    return np.minimum(low[at], low[at + size - span])


def _in_doc(doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ mix(doc.astype(U64) + U64(1)))


def _rows(ids: np.ndarray, doc: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> pa.RecordBatch:
    """One row for each text and key."""
    _, at = np.unique(_in_doc(doc, k1 ^ mix(k2)), return_index=True)
    return pa.RecordBatch.from_arrays([pa.array(signed(k1[at])), pa.array(signed(k2[at])), pa.array(ids[doc[at]])], names=["k1", "k2", "doc"])


def _each_block(batches, window):
    for batch in batches:
        for a, b in blocks(column(batch, "text")):
            part = batch.slice(a, b - a)
            yield part, _Block(column(part, "text"), window)


def _keys(docs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for part, x in _each_block(batches, window):
            ids = np.asarray(column(part, "doc"))
            at = np.concatenate([x.cuts, x.windows[x.bare], x.chunks])
            zero = np.zeros(len(x.cuts) + len(x.bare), U64)
            yield _rows(ids, x.doc[at], np.concatenate([x.cut_keys, x.bare_keys, x.chunk_keys]), np.concatenate([zero, x.chunk_checks]))

    return docs.mapInArrow(run, "k1 bigint, k2 bigint, doc bigint")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose key stands in several documents, with the smallest of them as `lo`."""
    least = rows.groupBy("k1", "k2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").drop("hi")
    return rows.join(least, ["k1", "k2"])


def intervals(df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, removed, kept_text) of every row; removed is an array of maximal (start, end) word intervals, end exclusive."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    # rows without an id lose nothing and take no part, so they aren't moved
    nameless = docs.where("doc is null")
    docs = docs.where("doc is not null")
    dealt = docs.repartition("doc")
    found = _shared(_keys(docs, window)).where("k2 = 0 or lo < doc")
    lists = found.groupBy("doc").agg(F.collect_list(F.when(F.col("k2") == 0, F.col("k1"))).alias("grams"), F.collect_list(F.when(F.col("k2") != 0, F.col("k1"))).alias("chunks"))
    known = dealt.join(lists, "doc", "left")

    def count(batches):
        for part, x in _each_block(batches, window):
            ids = np.asarray(column(part, "doc"))
            _, wanted = x.open_windows(column(part, "grams"), column(part, "chunks"))
            at = x.windows[wanted]
            yield _rows(ids, x.doc[at], x.grams.spans(at, at + window), x.second.spans(at, at + window))

    counted = known.mapInArrow(count, "k1 bigint, k2 bigint, doc bigint")
    first = counted.groupBy("k1", "k2").agg(F.min("doc").alias("lo"))
    repeated = counted.join(first, ["k1", "k2"]).where("lo < doc").groupBy("doc").agg(F.collect_list("k1").alias("windows"))

    def remove(batches):
        for part, x in _each_block(batches, window):
            settled, open_ = x.open_windows(column(part, "grams"), column(part, "chunks"))
            at = x.windows
            gone = settled.copy()
            gone[open_] = x.among(x.doc[at[open_]], x.grams.spans(at[open_], at[open_] + window), column(part, "windows"))
            yield _kept(column(part, "doc"), x.w, at[gone], window)

    def whole(batches):
        for part, x in _each_block(batches, window):
            yield _kept(column(part, "doc"), x.w, np.zeros(0, np.int64), window)

    schema = "doc_id bigint, n_words bigint, removed array<struct<start:bigint,end:bigint>>, kept_text string"
    return known.join(repeated, "doc", "left").mapInArrow(remove, schema).unionByName(nameless.mapInArrow(whole, schema))


def _kept(ids: pa.Array, w: Words, starts: np.ndarray, window: int) -> pa.RecordBatch:
    n, total = len(w.first) - 1, len(w.starts)
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    gone = np.cumsum(cover)[:total] > 0
    # maximal intervals: no window crosses texts, but neighbours may touch at a text's edge
    edge = np.zeros(total + 1, bool)
    edge[w.first] = True
    before = np.concatenate([[False], gone[:-1]])
    after = np.concatenate([gone[1:], [False]])
    begin = np.flatnonzero(gone & (~before | edge[:total]))
    end = np.flatnonzero(gone & (~after | edge[1 : total + 1])) + 1
    doc = w.doc
    base = w.first[doc[begin]]
    counts = np.bincount(doc[begin], minlength=n)
    pairs = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], names=["start", "end"])
    removed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pairs)
    # the bytes of kept words, and one space after each
    flips = np.zeros(len(w.buf) + 1, np.int64)
    flips[w.starts[~gone]] += 1
    np.add.at(flips, w.ends[~gone], -1)
    keep = np.cumsum(flips) > 0
    text_end = np.zeros(len(w.buf) + 1, bool)
    text_end[w.offsets] = True
    gaps = w.ends[~gone]
    gaps = gaps[~text_end[gaps]]
    norm = np.append(w.buf, np.uint8(32))
    norm[gaps] = 32
    keep[gaps] = True
    keep[-1] = False
    data, at = norm[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])[w.offsets].tolist()
    kept = [data[a:b].rstrip(b" ").decode() for a, b in zip(at, at[1:], strict=False)]
    return pa.RecordBatch.from_arrays([ids, pa.array(w.counts, pa.int64()), removed, pa.array(kept, pa.string())], names=["doc_id", "n_words", "removed", "kept_text"])


def digest(found: DataFrame) -> DataFrame:
    """Counts and the hash of what is kept."""
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
