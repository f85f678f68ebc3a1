import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.llm import decontam, queries


def tokens(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def naive_coverage(text, item, least=5):
    """Greedy string tiling, as plainly as can be."""
    a, b = tokens(text), tokens(item)
    least = min(least, len(b))
    if not b:
        return 0.0
    ma, mb = [False] * len(a), [False] * len(b)
    while True:
        best = None
        for p in range(len(a)):
            for t in range(len(b)):
                n = 0
                while p + n < len(a) and t + n < len(b) and a[p + n] == b[t + n] and not ma[p + n] and not mb[t + n]:
                    n += 1
                if n >= least and (best is None or (-n, p, t) < best):
                    best = (-n, p, t)
        if best is None:
            return sum(mb) / len(b)
        n, p, t = -best[0], best[1], best[2]
        ma[p : p + n] = [True] * n
        mb[t : t + n] = [True] * n


@pytest.mark.parametrize("letters", ["abcdefghÉj", "ab"])
def test_coverage_matches_naive_tiling(letters):
    rng = random.Random(3)
    word = lambda: rng.choice(letters)
    items = [" ".join(word() for _ in range(rng.randrange(0, 30))) for _ in range(8)] + ["a a a a a a a a a", "a b a b a b a b a b"]
    texts = []
    for _ in range(40):
        t = [word() for _ in range(rng.randrange(0, 40))]
        w = rng.choice(items).split()
        cut = len(w) // 2
        t[3:3] = rng.choice([w, w[cut:] + ["X,"] + w[:cut], w[:cut]])
        texts.append(" ".join(t))
    got = {(d, i): c for d, i, c, _, _ in decontam.coverage(pa.array(texts), pa.array(items))}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            assert got.get((d, i), 0.0) == pytest.approx(naive_coverage(t, x)), (t, x)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_reordered_passages_and_edges(spark, make, monkeypatch):
    w = ITEM.split()
    docs = make([(1, "x " + " ".join(w[10:]) + " mid " + " ".join(w[:10]).upper() + "!"), (2, " ".join(w[:12])), (3, None), (4, ""), (None, ITEM), (5, ITEM.replace(" ", ", ")), (5, ITEM)])
    docs = docs.withColumns({"k1": F.lit(1), "__k1": F.lit(2), "seeds": F.lit("s")})
    items = spark.createDataFrame([(9, ITEM, 1), (8, None, 1), (7, "", 1), (6, "short item", 1), (9, ITEM, 1), (3, ITEM.upper() + "?", 2)], "item_id bigint, text string, doc_id int")
    got = sorted(((r.doc_id or 0), r.item_id, r.n_items) for r in decontam.leaks(docs, items).collect())
    assert got == [(0, 3, 3), (1, 3, 3), (5, 3, 3), (5, 3, 3)]
    kept = decontam.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    monkeypatch.setattr(decontam, "_BROADCAST_ROWS", 0)
    assert sorted(r.doc_id for r in decontam.without_leaks(docs, items).collect()) == [2, 3, 4]
    assert decontam.leaks(docs, items.where(F.lit(False))).count() == 0
    assert decontam.without_leaks(docs, items.where(F.lit(False))).count() == 7
    assert decontam.leaks(docs.where(F.lit(False)), items).count() == 0
    nameless = decontam.leaks(docs, items.withColumn("item_id", F.lit(None).cast("bigint"))).collect()
    assert len(nameless) == 4 and {r.item_id for r in nameless} == {None}


def test_leaks_match_brute_force_over_many_items(spark):
    """Items that share passages with each other, short items, a word repeated; every pair is held against the naive tiling."""
    rng = random.Random(8)
    word = lambda: rng.choice([f"w{i}" for i in range(40)])
    common = [word() for _ in range(14)]
    items = [common[: rng.randrange(0, 15)] + [word() for _ in range(rng.randrange(1, 20))] for _ in range(40)] + [["solo"], ["one", "two", "three"], ["rep"] * 30]
    texts = [[word() for _ in range(20)] + rng.choice(items)[rng.randrange(0, 3) :] + common + [word() for _ in range(5)] for _ in range(30)] + [["rep"] * 12, ["rep"] * 40, ["solo"], common]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id int, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id int, text string")
    for least in (0.8, 0.4):
        want = {(d, i): c for d, t in enumerate(texts) for i, x in enumerate(items) if (c := naive_coverage(" ".join(t), " ".join(x))) >= least}
        got = {(r.doc_id, r.item_id): r.coverage for r in decontam.leaks(docs, bench, least=least).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_a_passage_common_to_many_items_gives_no_pairs(spark):
    """A passage of 20,000 items is passed over as long as the rest of an item has to be found as well; a long text of one word costs little."""
    passage = " ".join(f"p{i}" for i in range(30))
    items = spark.range(20_000).selectExpr("id as item_id", f"concat('{passage} ', array_join(transform(sequence(1, 20), x -> concat('u', id, '_', x)), ' ')) as text")
    classes = decontam.checkpointed(decontam.item_classes(items, "text", "item_id"))
    looked = decontam.lookups(decontam.seeds_of_items(classes, 5), 0.8)
    assert looked.groupBy("seed").count().agg(F.max("count")).first()[0] == 1
    docs = spark.createDataFrame([(1, passage), (2, "x " * 20_000), (3, "x " * 20_000 + passage + " " + " ".join(f"u7_{i}" for i in range(1, 21)))], "doc_id int, text string")
    bench = items.union(spark.createDataFrame([(-1, "x " * 300)], "item_id bigint, text string"))
    got = sorted((r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect())
    assert got == [(2, -1), (3, -1), (3, 7)]


def test_query_matches_brute_force(spark, sf_dir):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    grams = lambda t: {tuple(w[i : i + 5]) for w in [tokens(t)] for i in range(len(w) - 4)}
    sets = {i: grams(x) for i, x in items.items()}
    assert all(sets.values())
    want = {}
    for d, t in docs.items():
        own = grams(t)
        for i, x in items.items():
            # coverage of 80 % takes one seed in five of the item at least
            if len(own & sets[i]) * 5 >= 0.75 * len(tokens(x)) and (c := naive_coverage(t, x)) >= 0.8:
                want[d, i] = c
    same = {}
    for i, x in items.items():
        same.setdefault(tuple(tokens(x)), []).append(i)
    first = {i: min(ids) for ids in same.values() for i in ids}
    got = {(r.doc_id, r.item_id): r.coverage for r in queries.op10_decontamination(spark, sf_dir).collect()}
    assert want and got == {(d, first[i]): pytest.approx(c) for (d, i), c in want.items()}
