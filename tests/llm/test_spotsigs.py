import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from assayer.llm import queries, spotsigs


def plain(rows):
    """(doc_id, n_chars, sha of the edited text) and the pairs to compare, one row at a time."""
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1]), r[1]))
    out = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        out.append((d, t, e, nxt))
    return out


def prints(texts):
    s = spotsigs.Sets.of(pa.array(texts))
    return s.fingerprints()


def check(got, rows):
    want = plain(rows)
    exp = []
    for d, t, e, nxt in want:
        f, g, h = prints([t])[0], prints([e])[0], prints([nxt])[0]
        exp.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, round(spotsigs.jaccard(f, g), 12), round(spotsigs.jaccard(f, h), 12)))
    assert sorted((str(r[0]), *r[1:5], round(r[5], 12), round(r[6], 12)) for r in got) == sorted(exp)


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_edited_rows_match_brute_force(spark, make, parts):
    rng = random.Random(1)
    vocab = "the of and red green blue cat dog runs le la maison über 北京".split()
    rows = [(rng.randrange(-50, 200), " ".join(rng.choices(vocab, k=rng.randrange(0, 30)))) for _ in range(60)]
    rows += [(7, None), (7, ""), (7, "!!!"), (None, "x y"), (None, None), (3, "same same"), (3, "same same")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        check(spotsigs.edited(make(rows)).collect(), rows)
        check(spotsigs.edited(make([(1, "the red cat")])).collect(), [(1, "the red cat")])
        assert spotsigs.edited(make(rows).where(F.lit(False))).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_query_matches_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op2_spotsigs(spark, sf_dir).collect()
    check(got, rows)
    near = sorted(r.near_edited for r in got)
    assert near[len(near) // 2] > 0.3 and sum(r.near_next < 0.1 for r in got) > 0.8 * len(got)


def test_signatures():
    a, b, c, d = prints(["the red cat and a dog runs", "the, red, (the) CAT. and dog runs!", "red cat", "the green cat and a bird sings"])
    assert spotsigs.jaccard(a, a) == 1 and spotsigs.jaccard(a, d) == 0 and c and c != a
    assert prints(["", None, "?!"])[:2] == ["", ""] and prints(["?!"]) != [""]
    assert spotsigs.jaccard("", "") == 1 and spotsigs.jaccard("", a) == 0
    x, y = prints(["the red cat the dog runs the bird sings", "the red cat the dog runs the bird sings"])
    one = prints(["the red cat"])[0]
    assert x == y and 0 < spotsigs.jaccard(x, one) < 0.5 and spotsigs.jaccard(x, one, least=0.5) == 0


def test_pruning_by_length_loses_no_pair():
    rng = random.Random(6)
    for least in (0.05, 0.3, 0.8):
        for _ in range(300):
            a, b = ({rng.randrange(60) for _ in range(rng.randrange(0, 40))} for _ in (0, 1))
            b |= set(rng.sample(sorted(a), len(a) * rng.randrange(0, 5) // 4)) if a else set()
            j = len(a & b) / len(a | b) if a | b else 1.0
            pack = lambda s: np.array(sorted(s), np.uint64)
            got = spotsigs.likeness(pack(a), np.array([len(a)]), pack(b), np.array([len(b)]), least)[0]
            assert got == pytest.approx(j if j >= least else 0.0)


def test_a_text_without_a_chain_stays_like_its_edited_form():
    names = " ".join(f"name{i}" for i in range(40))
    before, after = prints([names, names + " the quick fox"])
    assert spotsigs.jaccard(before, after) > 0.3
    long = " ".join(f"the cat{i} ran{i}" for i in range(200))
    assert len(spotsigs.Sets.of(pa.array([long])).packed) < 200 * 1.1
    for text in ("Thsh " * 300, " | ".join(f"item{i}" for i in range(60)), "the cat ran " * 100):
        kept = text[: len(text) * 2 // 3] + " ".join(f"the dog{i} of house{i} was" for i in range(12))
        assert spotsigs.jaccard(*prints([text, kept])) > 0.15, text[:20]


def test_rows_of_one_key_are_dealt_to_several_parts(spark):
    """A third of the rows have no id, a third share one: order and edits are those of one sorted list, and no part holds a third."""
    rows = [(None, f"the text {i} of none") for i in range(200)] + [(7, f"a text {i} for seven") for i in range(200)] + [(i, f"one text {i} in the list") for i in range(100, 300)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        sizes = [r["count"] for r in spotsigs._in_order(docs).groupBy("part").count().collect()]
        assert max(sizes) < 60 and sum(sizes) <= 630
        check(spotsigs.edited(docs).collect(), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
