"""Fold, shapes, operators: worked examples, oracle parity, invariance."""

import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from assayer import cli
from assayer.functions import shapes, versions
from assayer.operators import clones, graph, history, lines
from assayer.plans import catalog, rubric
from assayer.plans import fold as FO

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: SQL that takes long even over a small table is held to the smallest; all others too, by whoever runs the catalog at a larger scale.
SF = "/root/testdata/sf0.001"


def fold(spark, **bundle):
    return cli.result(cli.fold_documents(spark, {"b": {"rubricVersion": rubric.RUBRIC_VERSION, "analyzableProjects": 3, "productionLoc": 5000, **bundle}})[0])


def dims(score, **more):
    return [{"id": "D1", "category": "code-quality", "score": score, "confidence": 1.0, **more}]


def test_thin_path_weights(spark):
    lenses = [{"lens": "codeHealth", "score": 60, "owaWeight": 0}, {"lens": "productionReadiness", "score": 75, "owaWeight": 0}, {"lens": "accessibility", "score": 90, "owaWeight": 0}]
    r = fold(spark, lenses=lenses)
    assert (r["cai"], r["band"]) == (69.35, "Adequate") and {x["lens"]: x["weight"] for x in r["lenses"]} == {"codeHealth": 0.5398, "productionReadiness": 0.2969, "accessibility": 0.1633}
    assert fold(spark, lenses=lenses[:2])["cai"] == 65.32
    given = [{**x, "owaWeight": w} for x, w in zip(lenses, (0.5, 0.3, 0.2), strict=True)]
    assert fold(spark, lenses=given)["cai"] == 70.5
    assert "twice" in fold(spark, lenses=[given[0], {**given[0]}])["error"]


@pytest.mark.parametrize(("score", "band"), [(6.9999, "Adequate"), (7.0, "Strong"), (4.9995, "Weak"), (2.49, "Critical"), (9.0, "Exemplary")])
def test_bands_cut_the_unrounded_number(spark, score, band):
    assert fold(spark, dimensions=dims(score))["band"] == band


EXAMPLES = json.loads((Path(__file__).parent / "fold_examples.json").read_text())


@pytest.fixture(scope="module")
def folded_examples(spark):
    """All published examples folded in two jobs: those of the present rubric, and those of an older one that knows no categories of dimensions."""
    out = {}
    old = rubric.Catalog("rubric-2026.08.15", [], rubric.Scoring())
    for catalog in (None, old):
        docs = {str(k): x["evidence"] for k, x in enumerate(EXAMPLES) if (x["evidence"].get("rubricVersion") == old.version) == (catalog is old)}
        f, _ = cli.fold_documents(spark, docs, catalog=catalog)
        for r in f.errors.collect():
            out[r.bundle_id] = {"error": r.error}
        for r in f.headline.collect():
            out[r.bundle_id] = {"cai": r.cai, "band": r.band, "lenses": {}}
        for r in f.lenses.collect():
            out[r.bundle_id]["lenses"][r.lens] = r
    return out


@pytest.mark.parametrize("k", range(len(EXAMPLES)))
def test_published_examples(folded_examples, k):
    got, want = folded_examples[str(k)], EXAMPLES[k]
    assert ("error" in got) == ("error" in want)
    if "error" in want:
        return
    want = want["expected"]
    assert got["cai"] == pytest.approx(want["cai"], abs=0.051) and want["band"] in (None, got["band"])
    for lens, x in (want.get("lenses") or {}).items():
        r = got["lenses"][lens]
        assert r.score == pytest.approx(x["score"], abs=0.051) and r.gated == x["gated"] and r["items"] == x["items"]
        assert x["band"] in (None, r.band) and (x["weight"] is None or r.weight == pytest.approx(x["weight"], abs=0.0011))


def test_a_catalog_states_its_parameters():
    doc = {"rubricVersion": "rubric-x", "dimensions": [{"id": "D1", "lens": "codeHealth", "category": "code-quality"}], "scoring": {"withinLensQ": 0.5, "architectureSurface": {"minProjects": 4}, "bands": {"fair": 40}, "qualityBar": {"offsets": {"draft": -30}, "poorFloor": 1}}}
    c = rubric.Catalog.read(doc)
    assert (c.version, c.dimensions) == ("rubric-x", [("D1", "code-quality", "codeHealth")])
    assert (c.scoring.within_q, c.scoring.across_q, c.scoring.min_projects, c.scoring.cutlines, c.scoring.bar_offsets, c.scoring.poor_floor) == (0.5, 0.55, 4, (90.0, 70.0, 40.0, 25.0), {"draft": -30}, 1)
    assert rubric.Scoring.read({}) == rubric.Scoring()


def test_eligibility_and_errors(spark):
    assert fold(spark, dimensions=[*dims(8.0, coverage=0.5), {"id": "D17", "category": "explicit-debt", "score": 8.0, "confidence": 1.0}])["lenses"][0]["score"] == 57.14
    assert "no measured" in fold(spark, dimensions=dims(8.0, advisory=True))["error"]
    assert "no measured" in fold(spark, dimensions=dims(80.0, confidence=0.0))["error"]
    assert "outside 0-10" in fold(spark, dimensions=dims(10.5))["error"] and "coverage" in fold(spark, dimensions=dims(5, coverage=1.5))["error"]
    assert "published" in fold(spark, dimensions=[{"id": "D1", "category": "docs", "score": 5, "confidence": 1}])["error"]
    assert "unknown category" in fold(spark, dimensions=[{"id": "Z1", "category": "astrology", "score": 5, "confidence": 1}])["error"]
    assert "rubric" in fold(spark, rubricVersion="rubric-2099.01.1", dimensions=dims(5))["error"]


def test_gate_surface_and_coherence(spark):
    gated = fold(spark, dimensions=[*dims(10.0), {"id": "D3", "category": "code-quality", "score": 3.99, "confidence": 0.01}])
    assert gated["lenses"][0]["gated"] and gated["lenses"][0]["band"] == "Adequate" and gated["lenses"][0]["score"] > 90
    assert not fold(spark, dimensions=dims(4.0))["lenses"][0]["gated"]
    arch = [{"id": "D5", "category": "architecture", "score": 9.0, "confidence": 1.0}]
    assert fold(spark, dimensions=arch, analyzableProjects=1, productionLoc=1499)["cai"] == 69 and fold(spark, dimensions=arch, analyzableProjects=1, productionLoc=1500)["cai"] == 90
    assert "no measured" in fold(spark, dimensions=arch, analyzableProjects=0)["error"]
    held = fold(spark, dimensions=[*dims(9.9), {"id": "D15", "category": "git-mining", "score": 4.9, "confidence": 1.0}])
    assert held["band"] == "Adequate"


def test_ties_keep_the_lens_order(spark):
    metas = [{"id": f"M{k}", "lens": x, "score": 6.5} for k, x in enumerate(reversed(rubric.LENSES))]
    r = fold(spark, metaDimensions=metas)
    assert [x["lens"] for x in sorted(r["lenses"], key=lambda x: -x["weight"])] == rubric.LENSES


def test_many_bundles_fold_at_once(spark):
    docs = {f"b{k}": {"rubricVersion": rubric.RUBRIC_VERSION, "analyzableProjects": 3, "dimensions": dims(k % 11)} for k in range(50)}
    f, _ = cli.fold_documents(spark, docs)
    assert {r.bundle_id: r.cai for r in f.headline.collect()} == {f"b{k}": pytest.approx(10.0 * (k % 11)) for k in range(50)}


def test_shapes(spark):
    row = spark.range(1).select(shapes.share(F.lit(0.2), 0.2).alias("a"), shapes.share(F.lit(0.6), 0.2).alias("b"), shapes.check(F.lit(1), F.lit(4)).alias("c"), shapes.check(F.lit(0), F.lit(0)).alias("d"), shapes.score2(F.lit(0.125)).alias("e"), shapes.even2(F.lit(0.125)).alias("f"), shapes.score2(F.lit(12.0)).alias("g")).first()
    assert tuple(row) == pytest.approx((0.0, 5.0, 2.5, 10.0, 0.13, 0.12, 10.0))
    found = spark.createDataFrame([("d", "a", 1.0), ("d", "a", 1.0), ("d", None, 1.0), ("d", None, 2.0)], "g string, file string, weight double")
    assert shapes.findings_load(found, ["g"]).first().load == pytest.approx(0.75 + 0.875)


def test_versions(spark):
    v = lambda *xs: [r.v for r in spark.createDataFrame([(x,) for x in xs], "v string").withColumn("k", versions.version_key(F.col("v"))).where("k is not null").orderBy("k").collect()]
    assert v("1.0.0", "1.0.0-b", "1.0.0-2", "1.0.0-10", "0.9", "x", "1.0-a.b") == ["0.9", "1.0.0-2", "1.0.0-10", "1.0-a.b", "1.0.0-b", "1.0.0"]
    keys = [list(r.k) for r in spark.createDataFrame([("rubric-2026.8.1",), ("rubric-2026.8",), ("rubric-2026.8.0",), ("rubric-2026.x",)], "v string").select(versions.rubric_key(F.col("v")).alias("k")).collect()]
    assert keys == [[2026, 8, 1], [2026, 8], [2026, 8], [2026, -1]]


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7), (7, 6), (None, 1)], "src int, dst int")
    assert {tuple(r) for r in graph.strong_components(e).collect()} == {(1, 1, 3), (2, 1, 3), (3, 1, 3), (6, 6, 2), (7, 6, 2)}
    assert {tuple(r) for r in graph.two_cycles(e).collect()} == {(6, 7)}
    assert {tuple(r) for r in graph.reachable(e, spark.createDataFrame([(2,)], "node int")).collect()} == {(2, 0), (3, 1), (1, 2), (4, 2)}
    assert {r.node: r.component for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6}
    assert {r.node: r.instability for r in graph.instability(e, spark.createDataFrame([(9,)], "node int")).collect()}[9] == 1.0
    assert graph.closure(e.where("src > 100")).count() == 0


def test_history_and_lines(spark):
    rows = [(k, "a", "2024-01-01", p) for k in range(5) for p in ("x/1", "y/2")] + [(9, "b", "2024-06-01", "x/1")] + [(20, "c", "2024-06-02", f"w/{k}") for k in range(13)]
    h = spark.createDataFrame(rows, "commit int, author string, ts string, path string").withColumn("ts", F.to_timestamp("ts"))
    assert [tuple(r)[:3] for r in history.change_coupling(h).collect()] == [("x/1", "y/2", 5)]
    assert history.change_coupling(h, edges=spark.createDataFrame([("y/2", "x/1")], "src string, dst string")).count() == 0
    assert history.change_coupling(h, folder=lambda c: F.lit("one")).count() == 0
    iv = spark.createDataFrame([("d", 1, 5), ("d", 2, 3), ("d", 9, 9), ("d", 13, 20)], "k string, start int, end int")
    assert sorted((r.start, r.end, r.n) for r in lines.merge_intervals(iv, ["k"], gap=3).collect()) == [(1, 5, 2), (9, 9, 1), (13, 20, 1)] or sorted((r.start, r.end, r.n) for r in lines.merge_intervals(iv, ["k"], gap=4).collect()) == [(1, 20, 4)]


def test_results_do_not_depend_on_partitions(spark):
    words = [f"w{k % 50}" for k in range(120)]
    t = spark.createDataFrame([(1, words), (2, ["a", *words]), (3, words[:30])], "doc_id int, words array<string>")
    out = []
    for n in (1, 7, 40):
        r = clones.repeated_windows(t.repartition(n))
        out.append(sorted(map(tuple, r.collect())))
        assert sorted((x.doc_id, x.start, x.end) for x in clones.regions(r).collect()) == [(1, 1, 120), (2, 2, 121)]
    assert out[0] == out[1] == out[2]


def plain_clones(docs, size):
    """Tokens under any run of `size` or more that two places share without overlap, pair by pair."""
    covered = {d: set() for d in docs}
    for a, x in docs.items():
        for b, y in docs.items():
            for i in range(len(x)):
                for j in range(len(y)):
                    if (a, i) < (b, j):
                        most = j - i if a == b else min(len(x), len(y))
                        n = 0
                        while n < most and i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                            n += 1
                        if n >= size:
                            covered[a].update(range(i, i + n))
                            covered[b].update(range(j, j + n))
    return {d: sorted(k + 1 for k in c) for d, c in covered.items()}


@pytest.mark.parametrize("vocabulary", [3, 300])
def test_clones_match_pairs_of_places(spark, vocabulary):
    import random

    rng = random.Random(vocabulary)
    passage = [f"p{rng.randrange(vocabulary)}" for _ in range(50)]
    docs = {d: [f"p{rng.randrange(vocabulary)}" for _ in range(rng.randrange(0, 30))] + passage[rng.randrange(0, 20) : rng.randrange(20, 51)] for d in range(12)}
    docs |= {20: ["same"] * 45, 21: passage[:20] + ["x"] + passage[:20], 22: [], 23: ["z"] * 12}
    t = spark.createDataFrame(list(docs.items()), "doc_id int, words array<string>")
    for size in (10, 16):
        got = {d: [] for d in docs}
        for r in clones.regions(clones.repeated_windows(t, size), size).collect():
            got[r.doc_id] += range(r.start, r.end + 1)
        assert {d: sorted(c) for d, c in got.items()} == plain_clones(docs, size)


def test_no_clone_is_lost_to_earlier_places(spark):
    """Two texts share 100 tokens; two earlier ones hold the first 65 and the last 55 of them."""
    run = [f"t{k}" for k in range(100)]
    t = spark.createDataFrame([(0, [*run[:65], "a"]), (1, ["b", *run[45:]]), (2, ["c", *run]), (3, [*run, "d"]), (4, ["e"] * 200), (5, ["e"] * 60)], "doc_id int, words array<string>")
    got = {(r.doc_id, r.start, r.end) for r in clones.regions(clones.repeated_windows(t)).collect()}
    assert got == {(2, 2, 101), (3, 1, 100), (4, 1, 200)}
    assert clones.repeated_windows(t.where("doc_id > 100")).count() == 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def canon(rows):
    told = lambda x: f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(map(told, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_against_its_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = canon(df.select(*names).collect())
    if name not in catalog.ORACLES:
        return
    want = duck.execute(catalog.ORACLES[name])
    at = [[d[0] for d in want.description].index(n) for n in names]
    assert rows == canon([[r[k] for k in at] for r in want.fetchall()])


@pytest.mark.parametrize("balances", [[710.5, -950.5, 435.5, 9999.99, -2000.0, 710.49, 710.51, None], []])
def test_scores_of_balances_at_a_half_are_those_of_the_sql(spark, tmp_path, balances):
    """Doubles just below a half whose product with ten is the half; a row without a name; no rows."""
    rows = [(k, f"Supplier#{k}", 1, b) for k, b in enumerate(balances)] + [(99, None, 1, 500.0)] * bool(balances)
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    got = catalog.QUERIES["scores_json"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == con.execute(catalog.ORACLES["scores_json"]).fetchall()
    assert not balances or json.loads(got[0].json)["Supplier#0"] == 15.6


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
