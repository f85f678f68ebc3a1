import random

import brute
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assayer.llm import queries, simhash
from assayer.llm.components import connected_components


def test_fingerprints_match_brute_force():
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "a\tb  c\x0bd É", "x y z x y z x y z", "\x1f \x85 nbsp\xa0x", "w " * 3000, *(" ".join(random.choices("abcdefgh", k=n)) for n in range(40))]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [brute.simhash(t) for t in texts]


def near(base, rng, bits):
    for b in rng.choice(64, bits, replace=False):
        base ^= 1 << int(b)
    return base


def random_prints(n_random, centres, around, seed=1):
    rng = np.random.default_rng(seed)
    out = {int(x) for x in rng.integers(0, 1 << 63, n_random)}
    for c in rng.integers(0, 1 << 63, centres):
        out |= {near(int(c), rng, int(rng.integers(0, 6))) for _ in range(around)}
    return sorted(out)


def roots(fps):
    return dict(zip(fps, brute.components(fps, fps), strict=True))


def test_tree_search_finds_every_link():
    for n, c, k in ((500, 3, 300), (10, 1, 1500), (4000, 0, 0)):
        fps = np.array(random_prints(n, c, k), np.uint64)
        rank = fps.copy()
        for s in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(s)
        fps = fps[np.argsort(rank)]
        x, y = simhash.forest(fps, np.zeros(len(fps)))
        label = {int(f): int(f) for f in fps}

        def root(f, label=label):
            while label[f] != f:
                f = label[f]
            return f

        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            assert root(a) != root(b)  # a forest: no edge closes a circle
            label[root(a)] = root(b)
        if len(fps) < 2000:
            want = roots([int(f) for f in fps])
            assert len({(root(f), c) for f, c in want.items()}) == len(set(want.values())) == len({root(f) for f in want})
        else:
            assert len(x) == 0


def test_many_groups_at_once():
    """Groups of all sizes, one row to hundreds, in one call: no edge leaves its group, and every link is found."""
    rng = np.random.default_rng(9)
    fps, group = [], []
    for g, n in enumerate([1, 2, 7, 8, 9, 64, 65, 300, 1, 520]):
        own = sorted({near(12345 << 20, rng, int(rng.integers(0, 9))) for _ in range(n)})
        fps += own
        group += [g] * len(own)
    a, b = simhash.forest(np.array(fps, np.uint64), np.array(group))
    edges = set(zip(a.tolist(), b.tolist(), strict=True))
    total = sum(len(own) - len(set(roots(own).values())) for g in set(group) for own in [[f for f, k in zip(fps, group, strict=True) if k == g]])
    assert len(a) == total and edges


def test_a_pair_of_nodes_is_left_by_accumulated_differences():
    """Two far clusters: no pair of rows across them is compared."""
    rng = np.random.default_rng(2)
    fps = sorted({near(0, rng, 2) for _ in range(60)} | {near((1 << 64) - 1, rng, 2) for _ in range(60)})
    tree = simhash.Tree(np.array(fps, np.uint64), np.array([0, len(fps)]), np.arange(len(fps)), 3)
    compared = []
    follow = tree._follow
    tree._follow = lambda k, a, b, *r: (compared.append(len(a)) if k == 0 else None, follow(k, a, b, *r))
    tree.search()
    assert 0 < sum(compared) < len(fps) * (len(fps) - 1) / 2 * 0.7


def test_nodes_below_cover_the_radius():
    for mask in (0, *simhash.blocks_below(0), *simhash.blocks_below(simhash.blocks_below(0)[2])):
        below = simhash.blocks_below(mask)
        added = [m & ~mask for m in below]
        assert len(below) == 4 and all(m & mask == mask for m in below) and sum(x.bit_count() for x in added) == 64 - mask.bit_count()


def test_distributed_links_at_every_depth(spark):
    fps = random_prints(300, 4, 120)
    nodes = spark.createDataFrame([(simhash._long(x),) for x in fps], "fp bigint")
    want = roots(fps)
    for most in (simhash._MOST, 100, 3):
        got = {r.node: r.root for r in connected_components(simhash.links(nodes, most)).collect()}
        groups = {}
        for x in fps:
            groups.setdefault(got.get(simhash._long(x), simhash._long(x)), set()).add(want[x])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_components_of_chains_and_loops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 70)] + [(200, 199), (200, 200), (200, 199)], "a bigint, b bigint")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 71)}, 199: 199, 200: 199}
    assert connected_components(edges.where(F.lit(False))).count() == 0


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fps = [brute.simhash(r.text) for r in docs]
    want = {(r.doc_id, f"{f:016x}", c) for r, f, c in zip(docs, fps, brute.components([r.doc_id for r in docs], fps), strict=True)}
    assert {tuple(r) for r in queries.op6_simhash(spark, sf_dir).collect()} == want


def test_nulls_repeats_and_empty(spark, make):
    rows = [(5, None), (3, ""), (9, "a b c d"), (9, "a b c d"), (None, "A B C D"), (7, "q")]
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(make(rows)).collect())
    assert got == sorted([("5", 3), ("3", 3), ("9", 9), ("9", 9), ("None", 9), ("7", 7)])
    assert simhash.near_duplicates(make(rows).where(F.lit(False))).count() == 0
