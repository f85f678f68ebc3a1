import random

import brute
from pyspark.sql import functions as F

from assayer.llm import queries, substring


def corpus(seed, n=60, vocab=400):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocab)}é"
    passages = [[word() for _ in range(rng.randrange(50, 160))] for _ in range(6)]
    docs = []
    for i in range(n):
        text = [word() for _ in range(rng.randrange(0, 260))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = rng.choice(passages)
        if docs and rng.random() < 0.4:
            text = brute.words(rng.choice(docs)[1])[:]
            for _ in range(rng.randrange(3)):
                if text:
                    text[rng.randrange(len(text))] = word()
        if rng.random() < 0.1:
            text = ["spam"] * rng.randrange(40, 200)
        docs.append((rng.choice([i, i * 7 % n]), rng.choice([" ", "\n", "\t "]).join(text)))
    return docs


def check(spark, make, docs, **args):
    got = sorted(tuple(map(str, r)) for r in substring.digest(substring.intervals(make(docs), **args)).collect())
    want = sorted(tuple(map(str, (d, *x))) for (d, _), x in zip(docs, brute.windows_removed(docs, **({"size": args["window"]} if args else {})), strict=True))
    assert got == want


def test_random_corpora_match_brute_force(spark, make):
    for seed in range(3):
        check(spark, make, corpus(seed))
    check(spark, make, corpus(9, vocab=3), window=8)


def test_edges(spark, make):
    p = " ".join(f"p{i}" for i in range(50))
    check(spark, make, [(1, p), (2, p), (2, p), (3, None), (4, ""), (5, p + " "), (None, p), (6, "x " + p + " y " + p), (0, p.replace("p1 ", "q1 "))])
    check(spark, make, [(None, p), (None, p)])
    assert substring.intervals(make([(1, p)]).where(F.lit(False))).count() == 0


def test_intervals_are_maximal(spark, make):
    p = [f"p{i}" for i in range(80)]
    docs = [(1, " ".join(p)), (2, "a " + " ".join(p) + " b"), (3, " ".join(p[:70]))]
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in substring.intervals(make(docs)).collect()}
    assert got == {1: [], 2: [(1, 81)], 3: [(0, 70)]}


def test_query_matches_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {(d, *x) for (d, _), x in zip(docs, brute.windows_removed(docs), strict=True)}
    assert {tuple(r) for r in queries.op7_substring(spark, sf_dir).collect()} == want


def test_rows_without_an_id_stay_where_they_are(spark, make):
    p = " ".join(f"p{i}" for i in range(60))
    docs = [(None, p)] * 30 + [(1, p), (2, p), (None, None), (None, "")]
    check(spark, make, docs)
    plan = substring.intervals(make(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(doc_id" in plan.lower() and "isnotnull(doc_id" in plan.lower()
