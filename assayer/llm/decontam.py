"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are read as lower-cased words (letters, digits and non-ASCII characters).
Five-word seeds found by a running Karp-Rabin hash join a document to the items it shares text with; for each
such pair the longest match of unmarked words is marked again and again, in any order of passages, until none of
five words is left. An item whose words are covered to 80 % or more has leaked into the document.

How it is dealt, for any number of documents and items:

* Items with equal words are one class; a leak is reported once for a class, by its smallest item_id and its number of items.
* Of an item only those seeds are looked up without which the wanted coverage can't be reached: the seeds that most items share are left out as
  long as all words under them stay below it. A passage common to many items then joins a document to none of them, unless little else is in them.
* A Bloom filter of these seeds, of bounded size, runs over each whole document once, where it is read. Documents with a hit are written with their seeds
  (a table in the shared folder), and seeds are joined as rows: a seed that many documents hold is split by the join, not gathered.
* Each pair that shares a seed is tiled by itself, over the parts of the document that match the item at all. Equal documents are tiled once.

Nothing is collected but the filter's words; no pair of documents is formed.

Defined cases: null and empty texts and items without words match nothing; an item of fewer than five words needs
its whole word sequence; repeated documents are reported each; a null doc_id stays null in the report, and a class all of whose item_ids are null has a null
item_id; an empty table on either side gives an empty report; columns beside those named play no part, whatever they are called.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import bounded_batches, checkpointed, spare
from assayer.llm.text import NON_WORD, U64, Grams, Words, blocks, column, gram_starts, mix, raw, signed, words

SEED_WORDS = 5
COVERAGE = 0.8
#: The filter has 2 ** bits bits: 256 or more for each seed, between these limits (32 MB at most; beyond 2 ** 20 seeds it lets more pass, which the join sorts out).
_FILTER_BITS = (16, 28)
#: Items that a task tiles over one text, about.
_PAIRS = 1000
#: Texts with a leak (16 bytes each) up to which their keys are broadcast; beyond, documents are joined by key.
_BROADCAST_ROWS = 1_000_000


def read_words(texts: pa.Array) -> tuple[Words, np.ndarray]:
    w = words(*raw(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))), NON_WORD)
    return w, w.hashes()


# Tiling of one pair


def _runs(ok: np.ndarray) -> np.ndarray:
    """For each place the number of places from it on for which `ok` holds without a gap."""
    n = len(ok)
    stop = np.where(ok, n, np.arange(n))
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n) if n else np.zeros(0, np.int64)


def tiles(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two word sequences (hashes): the longest match of unmarked words is marked, the first in the text and then in the item of equals, until none of `least` words is left.

    All tiles of one length are found by one pass of a running hash over both; the next length by halving. A sequence that repeats itself costs no more than another.
    """
    out: list[tuple[int, int, int]] = []
    free_t, free_i = np.ones(len(text), bool), np.ones(len(item), bool)
    gram_t, gram_i = Grams(text), Grams(item)
    most = min(len(text), len(item))
    while most >= least and free_i.any():
        run_t, run_i = _runs(free_t), _runs(free_i)

        def shared(n: int, run_t=run_t, run_i=run_i):
            a, b = np.flatnonzero(run_t >= n), np.flatnonzero(run_i >= n)
            ha, hb = gram_t.spans(a, a + n), gram_i.spans(b, b + n)
            hit = np.isin(ha, hb)
            return a[hit], ha[hit], b, hb

        low, high, best = least, most, None
        while low <= high:
            n = (low + high) // 2
            found = shared(n)
            if len(found[0]):
                best, low = (n, found), n + 1
            else:
                high = n - 1
        if best is None:
            break
        n, (at, ha, place, hb) = best
        order = np.argsort(hb, kind="stable")
        hb, place = hb[order], place[order]
        first, end = np.searchsorted(hb, ha, "left"), np.searchsorted(hb, ha, "right")
        after: dict[int, int] = {}  # of each hash, the first of its places that may still be free
        reach = -1
        for p, k, e in zip(at.tolist(), first.tolist(), end.tolist(), strict=True):
            if p < reach:
                continue
            j = after.get(k, k)
            while j < e and not (free_i[place[j]] and free_i[place[j] + n - 1] and free_i[place[j] : place[j] + n].all()):
                j += 1
            after[k] = j
            if j < e:
                t = int(place[j])
                out.append((n, p, t))
                free_t[p : p + n] = False
                free_i[t : t + n] = False
                reach = p + n
        most = n
    return out


def tiled(h: np.ndarray, seeds: np.ndarray, order: np.ndarray, item: np.ndarray, k: int) -> tuple[float, int, int]:
    """(covered share of the item's words, tiles, longest tile) of an item in a text, whose seeds of k words stand sorted by hash with their places `order`."""
    at = np.arange(len(item) - k + 1)
    own = np.unique(Grams(item).spans(at, at + k))
    low, high = np.searchsorted(seeds, own, "left"), np.searchsorted(seeds, own, "right")
    n = high - low
    if not n.sum():
        return 0.0, 0, 0
    places = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
    # only what matches the item somewhere is read on; a word that nothing has stands between
    keep = np.zeros(len(h) + 1, bool)
    for i in range(k):
        keep[places + i] = True
    words_at = np.flatnonzero(keep)
    gap = np.flatnonzero(np.diff(words_at) > 1) + 1
    part = np.insert(h[words_at], gap, U64(0))
    found = tiles(part, item, k)
    if not found:
        return 0.0, 0, 0
    return sum(x for x, _, _ in found) / len(item), len(found), max(x for x, _, _ in found)


class TextIndex:
    """The words of one text, and its seeds of each length on demand."""

    def __init__(self, text: str):
        _, self.h = read_words(pa.array([text]))
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def cover(self, item: np.ndarray, seed_words: int = SEED_WORDS) -> tuple[float, int, int]:
        k = min(seed_words, len(item))
        if not k or len(self.h) < k:
            return 0.0, 0, 0
        if k not in self.seeds:
            at = np.arange(len(self.h) - k + 1)
            s = Grams(self.h).spans(at, at + k)
            order = np.argsort(s, kind="stable")
            self.seeds[k] = s[order], order
        return tiled(self.h, *self.seeds[k], item, k)


def coverage(texts: pa.Array, items: pa.Array, seed_words: int = SEED_WORDS) -> list[tuple[int, int, float, int, int]]:
    """(text, item, covered share of the item's words, tiles, longest tile) of every pair with a tile, pair by pair."""
    w, h = read_words(items)
    lists = [h[a:b] for a, b in zip(w.first, w.first[1:], strict=False)]
    out = []
    for d, text in enumerate(texts.to_pylist()):
        index = TextIndex(text or "")
        out += [(d, i, *found) for i, x in enumerate(lists) if (found := index.cover(x, seed_words))[1]]
    return out


# Items


def item_classes(items: DataFrame, text: str, item_id: str) -> DataFrame:
    """(c1, c2, item_id, n_items, words): the items by equal word sequences; words are hashes."""

    def run(batches):
        for batch in batches:
            for a, b in blocks(column(batch, "text")):
                part = batch.slice(a, b - a)
                w, h = read_words(column(part, "text"))
                some = np.flatnonzero(w.counts)
                keys = [signed(Grams(h, i).spans(w.first[some], w.first[some + 1])) for i in (0, 1)]
                lists = pa.ListArray.from_arrays(pa.array(w.first, pa.int32()), pa.array(signed(h))).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys), column(part, "item").take(pa.array(some)), lists], names=["c1", "c2", "item", "words"])

    chosen = items.select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    kind = chosen.schema["item"].dataType.simpleString()
    found = chosen.mapInArrow(run, f"c1 bigint, c2 bigint, item {kind}, words array<bigint>")
    return found.groupBy("c1", "c2").agg(F.min("item").alias("item_id"), F.count(F.lit(1)).alias("n_items"), F.any_value("words").alias("words"))


def seeds_of_items(classes: DataFrame, seed_words: int) -> DataFrame:
    """(c1, c2, n, k, place, seed) of every seed of every class."""

    def run(batches):
        for batch in batches:
            lists = column(batch, "words")
            n = np.asarray(lists.value_lengths())
            first = np.concatenate([[0], np.cumsum(n)])
            h = np.asarray(lists.flatten()).view(U64)
            grams = Grams(h)
            for k in sorted({int(x) for x in np.minimum(n, seed_words)}):
                at = gram_starts(first, k)
                doc = np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0))
                mine = np.minimum(n, seed_words)[doc] == k
                at, doc = at[mine], doc[mine]
                for a in range(0, len(at), 100_000):
                    x, d = at[a : a + 100_000], doc[a : a + 100_000]
                    of = pa.array(d)
                    yield pa.RecordBatch.from_arrays(
                        [column(batch, "c1").take(of), column(batch, "c2").take(of), pa.array(n[d], pa.int32()), pa.array(np.full(len(d), k), pa.int32()), pa.array(x - first[d], pa.int32()), pa.array(signed(grams.spans(x, x + k)))],
                        names=["c1", "c2", "n", "k", "place", "seed"],
                    )

    return classes.select("c1", "c2", "words").mapInArrow(run, "c1 bigint, c2 bigint, n int, k int, place int, seed bigint")


def needed(places: np.ndarray, shared: np.ndarray, n: int, k: int, least: float) -> np.ndarray:
    """Which of an item's seeds have to be looked up: the most shared are passed over as long as the words under them are fewer than the coverage wanted."""
    want = max(1, math.ceil(round(least * n, 9)))
    order = np.lexsort((places, -shared))
    under, look = np.zeros(n, bool), np.ones(len(places), bool)
    covered = 0
    for i in order.tolist():
        p = places[i]
        more = k - int(under[p : p + k].sum())
        if covered + more >= want:
            break
        under[p : p + k] = True
        covered += more
        look[i] = False
    return look


def lookups(seeds: DataFrame, least: float) -> DataFrame:
    """(c1, c2, seed, k) of the seeds that documents are searched for."""
    shared = seeds.groupBy("seed").agg(F.count_distinct("c1", "c2").alias("shared"))
    by_class = seeds.join(shared, "seed").groupBy("c1", "c2", "n", "k").agg(F.sort_array(F.collect_list(F.struct("place", "seed", "shared"))).alias("s"))

    def run(batches):
        for batch in batches:
            head = [column(batch, c).to_pylist() for c in ("c1", "c2", "n", "k")]
            lists = column(batch, "s")
            at = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            flat = lists.flatten()
            place, seed, often = (np.asarray(pc.struct_field(flat, i)) for i in range(3))
            for c1, c2, n, k, a, b in zip(*head, at[:-1].tolist(), at[1:].tolist(), strict=True):
                look = np.unique(seed[a:b][needed(place[a:b], often[a:b], n, k, least)])
                m = len(look)
                yield pa.RecordBatch.from_arrays([pa.array([c1] * m, pa.int64()), pa.array([c2] * m, pa.int64()), pa.array(look), pa.array([k] * m, pa.int32())], names=["c1", "c2", "seed", "k"])

    return by_class.mapInArrow(run, "c1 bigint, c2 bigint, seed bigint, k int")


class SeedFilter:
    """A Bloom filter with two bits a seed."""

    def __init__(self, bits: int, lengths: list[int], at: np.ndarray, value: np.ndarray):
        self.bits, self.lengths = bits, lengths
        self.data = np.zeros(1 << (bits - 3), np.uint8)
        self.data.view(np.uint64)[at] = value.view(np.uint64)

    @staticmethod
    def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return h >> U64(64 - bits), mix(h) >> U64(64 - bits)

    def may(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for p in self.places(h, self.bits):
            ok[ok] = (self.data[p[ok] >> U64(3)] >> (p[ok] & U64(7)).astype(np.uint8)) & 1 == 1
        return ok


def seed_filter(looked: DataFrame) -> SeedFilter | None:
    """The filter of all looked-up seeds, gathered as 64-bit words of it."""
    about = looked.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("k")).alias("lengths")).first()
    if not about.n:
        return None
    bits = min(max(math.ceil(math.log2(about.n)) + 8, _FILTER_BITS[0]), _FILTER_BITS[1])

    def run(batches):
        for batch in batches:
            for p in SeedFilter.places(np.asarray(column(batch, "seed")).view(U64), bits):
                yield pa.RecordBatch.from_arrays([pa.array((p >> U64(6)).astype(np.int64)), pa.array(signed(U64(1) << (p & U64(63))))], names=["at", "bit"])

    got = looked.select("seed").mapInArrow(run, "at bigint, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    return SeedFilter(bits, list(about.lengths), np.asarray(got.column("at")), np.asarray(got.column("bit")))


# Documents


def text_keys(text):
    """Two hashes that stand for a whole text."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def hits(docs: DataFrame, held) -> DataFrame:
    """(doc_id, k1, k2, text, seeds) of the documents (doc_id, k1, k2, text) in which the filter sees seeds."""

    def run(batches):
        f: SeedFilter = held.value
        for batch in batches:
            for a, b in blocks(column(batch, "text")):
                part = batch.slice(a, b - a)
                w, h = read_words(column(part, "text"))
                grams, doc, found = Grams(h), w.doc, []
                for k in f.lengths:
                    at = gram_starts(w.first, k)
                    g = grams.spans(at, at + k)
                    ok = f.may(g)
                    found.append((doc[at[ok]], g[ok]))
                owner, seed = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(owner):
                    continue
                order = np.lexsort((seed, owner))
                owner, seed = owner[order], seed[order]
                fresh = np.concatenate([[True], (np.diff(owner) != 0) | (seed[1:] != seed[:-1])])
                owner, seed = owner[fresh], seed[fresh]
                some, start = np.unique(owner, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array([*start.tolist(), len(owner)], pa.int32()), pa.array(signed(seed)))
                rows = part.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=[*rows.schema.names, "seeds"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, k1 bigint, k2 bigint, text string, seeds array<bigint>")


def _tiled(pairs: DataFrame, texts: DataFrame, least: float, seed_words: int) -> DataFrame:
    """(k1, k2, c1, c2, coverage, n_tiles, longest_tile) of pairs (k1, k2, c1, c2, words) covered to `least` or more, over texts (k1, k2, text).

    A text stands before its items and is moved once for about a thousand of them; the items of a text that has more are dealt to several tasks.
    """
    parts = F.ceil(F.col("n") / _PAIRS).cast("int")
    sizes = pairs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).select("k1", "k2", parts.alias("parts"))
    none = F.lit(None)
    heads = texts.join(sizes, ["k1", "k2"]).select("k1", "k2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "text", none.cast("bigint").alias("c1"), none.cast("bigint").alias("c2"), none.cast("array<bigint>").alias("words"))
    rest = pairs.join(sizes, ["k1", "k2"]).select("k1", "k2", F.pmod("c1", F.col("parts").cast("bigint")).cast("int").alias("part"), F.lit(1).alias("kind"), none.cast("string").alias("text"), "c1", "c2", "words")

    def run(batches):
        index = None
        for batch in batches:
            keys = [column(batch, c) for c in ("k1", "k2", "c1", "c2")]
            texts, lists = column(batch, "text"), column(batch, "words")
            found = []
            for i, kind in enumerate(column(batch, "kind").to_pylist()):
                if not kind:
                    index = TextIndex(texts[i].as_py())
                    continue
                cover, n, longest = index.cover(np.asarray(lists[i].values).view(U64), seed_words)
                if n and cover >= least - 1e-12:
                    found.append((i, cover, n, longest))
            if found:
                at, cover, n, longest = zip(*found, strict=True)
                of = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(k.take(of) for k in keys), pa.array(cover), pa.array(n, pa.int32()), pa.array(longest, pa.int32())], names=["k1", "k2", "c1", "c2", "coverage", "n_tiles", "longest_tile"])

    order = ["k1", "k2", "part"]
    dealt = heads.unionByName(rest).repartition(*order).sortWithinPartitions(*order, "kind")
    return dealt.mapInArrow(run, "k1 bigint, k2 bigint, c1 bigint, c2 bigint, coverage double, n_tiles int, longest_tile int")


def _found(docs: DataFrame, items: DataFrame, text: str, doc_id: str | None, item_text: str, item_id: str, least: float, seed_words: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(classes, documents with a hit, leaks between texts and classes); nothing where there is nothing to look up."""
    bounded_batches(docs.sparkSession)
    classes = checkpointed(item_classes(items, item_text, item_id))
    looked = checkpointed(lookups(seeds_of_items(classes, seed_words), least))
    f = seed_filter(looked)
    if f is None:
        return None
    own = F.col(text)
    rows = docs.select((F.col(doc_id) if doc_id else F.lit(0)).alias("doc_id"), *(k.alias(n) for k, n in zip(text_keys(own), ("k1", "k2"), strict=True)), own.alias("text"))
    hit = checkpointed(hits(rows.where("text is not null"), docs.sparkSession.sparkContext.broadcast(f)))
    by_seed = hit.select("k1", "k2", F.explode("seeds").alias("seed")).distinct()
    pairs = checkpointed(by_seed.join(looked.select("c1", "c2", "seed"), "seed").select("k1", "k2", "c1", "c2").distinct())
    pairs = pairs.join(classes.select("c1", "c2", "words"), ["c1", "c2"])
    texts = hit.join(pairs.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.any_value("text").alias("text"))
    return classes, hit, checkpointed(_tiled(pairs, texts, least, seed_words))


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", least: float = COVERAGE, seed_words: int = SEED_WORDS) -> DataFrame:
    """(doc_id, item_id, n_items, coverage, n_tiles, longest_tile): every document and class of equal items covered to `least` or more; item_id is the class's smallest."""
    id_type, item_type = docs.select(F.col(doc_id)).dtypes[0][1], items.select(F.col(item_id)).dtypes[0][1]
    found = _found(docs, items, text, doc_id, item_text, item_id, least, seed_words)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {id_type}, item_id {item_type}, n_items bigint, coverage double, n_tiles int, longest_tile int")
    classes, hit, leaked = found
    named = leaked.join(classes.drop("words"), ["c1", "c2"])
    return hit.select("doc_id", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "item_id", "n_items", "coverage", "n_tiles", "longest_tile")


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", least: float = COVERAGE, seed_words: int = SEED_WORDS) -> DataFrame:
    """The documents in which no item is covered to `least` or more, with all their columns."""
    found = _found(docs, items, text, None, item_text, item_id, least, seed_words)
    if found is None:
        return docs
    a, b = (spare(docs.columns, n) for n in ("__k1", "__k2"))
    k1, k2 = text_keys(F.col(text))
    gone = found[2].select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    gone = F.broadcast(gone) if gone.count() <= _BROADCAST_ROWS else gone
    return docs.withColumn(a, k1).withColumn(b, k2).join(gone, [a, b], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
