import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.llm import langid, linear, quality, queries, toxicity

MEDIUM = "/root/testdata/sf0.01"


def crc(x, n):
    return zlib.crc32(str(x).encode()) % n


def test_language_query_on_held_out_rows(spark):
    got = queries.op1_language(spark, MEDIUM).toPandas().merge(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(got) == 1000 and set(got.lang_pred) <= set(got.lang) and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda x: crc(x, 5) == 0)).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and held.rejected.mean() < 0.02


@pytest.mark.parametrize(("query", "label", "n", "k"), [("op4_quality", "quality", 5, 0), ("op8_toxicity", "toxic", 4, 2)])
def test_label_queries_on_held_out_rows(spark, query, label, n, k):
    got = queries.QUERIES[query](spark, MEDIUM).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == got.doc_id.map(lambda x: crc(x, n) == k)).all()
    held = got[got.held_out].merge(spark.read.parquet(f"{MEDIUM}/labels.parquet").toPandas(), on="doc_id")
    assert len(held) > 50 and (held.predicted == held[label]).mean() > 0.9


def docs_with_labels(spark, make, rows):
    docs = make([(i, t) for i, (t, _) in enumerate(rows)])
    labels = spark.createDataFrame([(i, y, "clash") for i, (_, y) in enumerate(rows)] + [(None, 1, ""), (10_000, None, "")], "doc_id bigint, toxic int, text string")
    return docs, labels


def test_counterfactual_pull_spares_neutral_mentions():
    rng = np.random.default_rng(5)
    plain = [f"w{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(600):
        words = list(rng.choice(plain, 8))
        bad = i % 4 == 0
        if bad:
            words[1] = "idiot"
        if rng.random() < (0.8 if bad else 0.02):
            words[3] = "muslims"
        texts.append(" ".join(words))
        labels.append(int(bad))
    rows = [SimpleNamespace(x=x, label=y) for x, y in zip(toxicity.features(pa.array(texts)), labels, strict=True)]
    neutral = pa.array(["w1 w2 muslims w5", "w9 muslims w3 w4 w5"])
    free, bound = (toxicity.train(rows, {0: 1.0, 1: 1.0}, pull=p) for p in (0.0, 1.0))
    gap = lambda m: toxicity.score(neutral, m) - toxicity.score(pa.array([t.as_py().replace("muslims", "christians") for t in neutral]), m)
    assert (np.abs(gap(bound)) < np.abs(gap(free))).all()
    assert toxicity.score(pa.array(["w1 idiot w3"]), bound)[0] > 0.5


def test_scores_match_a_plain_dot_product():
    texts = pa.array(["Ab cd!! EF 12", "", None, "x"])
    w = np.random.default_rng(1).normal(size=quality.DIM).astype(np.float32)
    got = quality.score(texts, (w, 0.25))
    for row, f in zip(got, quality.features(texts), strict=True):
        i, c = np.frombuffer(f, np.int32).reshape(2, -1)
        z = 0.25 + (quality.SCALE * float(w[i].astype(float) @ c) / c.sum() if len(c) else 0)
        assert row == pytest.approx(1 / (1 + np.exp(-z)))


def test_ftrl_separates_and_sparsifies():
    rng = np.random.default_rng(0)
    data = []
    for _ in range(400):
        i = rng.choice(200, 6, replace=False)
        data.append(linear.Example(i, np.ones(6), int(7 in i or 9 in i)))
    w, b = linear.train(data, 200, 8, l1=1.0)
    assert w[7] > 1 and w[9] > 1 and w[7] > np.delete(w, [7, 9]).max() and b < 0
    kept = [(linear.train(data, 200, 8, l1=x)[0] != 0).sum() for x in (0.0, 1.0, 5.0)]
    assert kept[0] > kept[1] > kept[2]


def test_edges(spark, make):
    rows = [(None, 1), ("", 0), ("idiot " * 20_000, 1), ("fine words", 0), ("fine words", 0), ("1234 !!", 1)]
    docs, labels = docs_with_labels(spark, make, rows)
    none = labels.where(F.lit(False))
    for mod, label in ((quality, "toxic"), (toxicity, "toxic")):
        model = mod.fit(docs, labels, label)
        s = {r.doc_id: r.score for r in mod.scores(docs, model).collect()}
        assert len(s) == 6 and s[0] == s[1] and s[3] == s[4] and all(0 <= x <= 1 for x in s.values())
        assert {r.score for r in mod.scores(docs, mod.fit(docs, none, label)).collect()} == {0.5}
        assert mod.scores(docs.where(F.lit(False)), model).count() == 0
    model = langid.fit(docs)
    out = {r.doc_id: r for r in langid.predict(docs, model, keep=("doc_id", "lang")).collect()}
    assert [out[i].lang_pred for i in range(6)] == ["und", "und", "en", "en", "en", "und"] and out[0].rejected and out[0].score == 0
    assert langid.accepted(docs, model).count() == 3
    empty = langid.fit(docs.where(F.lit(False)))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"} and langid.predict(docs.where(F.lit(False)), model).count() == 0


def test_foreign_script_is_rejected(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    far = langid.fit(docs).predict(pa.array(["Привет мир как дела сегодня хорошо " * 8, "今天天气很好我们去公园玩吧" * 20]))
    assert far[3].all()


def test_smallest_takes_what_one_ranking_would(spark):
    from assayer.llm.shared import smallest

    rows = [(i % 5000, "ab"[i % 5000 % 7 == 0]) for i in range(6000)]
    hashed = {r.id: r.h for r in spark.range(5000).selectExpr("id", "xxhash64(id) as h").collect()}
    for most in (7, 300, 9000):
        found, totals = smallest(spark.createDataFrame(rows, "id bigint, g string"), "g", most)
        want = []
        for g in "ab":
            want += [(g, i) for i in sorted({i for i, k in rows if k == g}, key=lambda i: (hashed[i], i))[:most]]
        assert sorted((r.g, r.id) for r in found.collect()) == sorted(want) and sum(totals.values()) == 6000
    assert smallest(spark.createDataFrame([], "id bigint, g string"), "g", 3)[0].count() == 0


def test_a_repeated_id_stays_within_the_sample(spark):
    """A third of all rows share one id, under one label and language; none of them escapes the bound, and the ranking reads a few times the sample."""
    from assayer.llm.shared import smallest

    docs = spark.range(100_000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "concat('text number ', id % 50) as text", "if(id % 2 = 0, 'en', 'fr') as lang", "cast(id % 2 as int) as quality")
    rows, share = linear.sampled(docs, docs, "quality", 50)
    got = rows.collect()
    assert len(got) == 100 and len({(r.id, r.label) for r in got}) == 100 and all(0 < x < 0.01 for x in share.values())
    model = langid.fit(docs, per_language=40)
    assert model.languages == ["en", "fr"]
    few, _ = smallest(docs.select("doc_id", "lang"), "lang", 40, key="doc_id")
    assert few.count() == 80
    same = spark.range(20_000).selectExpr("cast(1 as bigint) as doc_id", "concat('w', id) as text", "'en' as lang", "1 as quality")
    assert linear.sampled(same, same, "quality", 50)[0].count() == 1 and langid.fit(same).languages == ["en"]


def test_learnt_rows_are_bounded_and_scores_read_all(spark, make):
    long = " ".join(f"x{i} good{i}" for i in range(60_000))
    docs = make([(1, long), (2, "bad words here"), (3, long + " tail")])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    for mod in (quality, toxicity):
        model = mod.fit(docs, labels, "quality")
        assert all(len(f) < 4 * (2 * linear.MOST_FEATURES + 2) * 2 for f in mod.features(pa.array([long, "x muslims " + long])))
        assert len({r.doc_id for r in mod.scores(docs, model).collect()}) == 3
        any_model = (np.random.default_rng(1).normal(size=mod.DIM).astype(np.float32) / 100, 0.0)
        whole = [float(x) for x in mod.score(pa.array([long, long + " tail"]), any_model)]
        assert whole[0] != whole[1]


def test_kept_columns_that_clash_are_replaced(spark):
    docs = spark.createDataFrame([(1, "some words", "old", 5, "y")], "doc_id bigint, text string, score string, text_ int, LANG_PRED string")
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    got = quality.scores(docs, quality.fit(docs, labels), keep=tuple(docs.columns))
    assert got.columns == ["doc_id", "text", "text_", "LANG_PRED", "score", "predicted"] and got.first().text_ == 5
    got = langid.predict(docs, langid.fit(docs, lang="LANG_PRED"), keep=tuple(docs.columns))
    assert got.columns == ["doc_id", "text", "text_", "lang_pred", "score", "distance", "rejected"] and got.count() == 1


def test_swaps_replace_words_pairs_and_stems():
    texts = pa.array(["the christians came", "an african-american woman"])
    swapped = pa.array(["the jews came", "an asian-mexican man"])
    for f, want in zip(toxicity.features(texts), toxicity.features(swapped), strict=True):
        x, y = np.frombuffer(f, np.int32), np.frombuffer(want, np.int32)
        assert sorted(x[x[0] + 1 :]) == sorted(y[1 : y[0] + 1])


def test_one_step_leaves_shared_coordinates_to_the_label():
    learner = linear.Ftrl(4)
    learner.z[:3] = -1.0, 0.5, -2.0
    shared, own, other = 0, 1, 2
    e = linear.Example(np.array([shared, own]), np.ones(2), 1, 1.0, (np.array([shared, other]), np.ones(2)))
    plain = linear.Ftrl(4)
    plain.z[:] = learner.z
    learner.learn(e, pull=3.0)
    plain.learn(linear.Example(e.index, e.value, 1), pull=0.0)
    assert learner.n[shared] == pytest.approx(plain.n[shared]) and learner.n[4] == pytest.approx(plain.n[4])
    assert learner.n[own] != pytest.approx(plain.n[own]) and learner.n[other] > 0


@pytest.mark.parametrize(("module", "query", "label", "n", "k"), [(quality, "op4_quality", "quality", 5, 0), (toxicity, "op8_toxicity", "toxic", 4, 2)])
def test_label_queries_match_a_plain_scorer(spark, sf_dir, monkeypatch, module, query, label, n, k):
    """Every row of the query against sums over a dictionary of the learnt weights, one text at a time."""
    held = []
    monkeypatch.setattr(module, "fit", lambda *a, fit=module.fit: held.append(fit(*a)) or held[0])
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in queries.QUERIES[query](spark, sf_dir).collect()}
    weight, bias = dict(enumerate(held[0][0].tolist())), held[0][1]
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        x = np.frombuffer(module.features(pa.array([r.text]))[0], np.int32).tolist()
        if module is quality:
            half = len(x) // 2
            total = sum(c for c in x[half:])
            z = bias + (quality.SCALE * sum(weight[i] * c for i, c in zip(x[:half], x[half:], strict=True)) / total if total else 0)
        else:
            z = bias + sum(weight[i] for i in x[1 : x[0] + 1])
        s = 1 / (1 + np.exp(-z))
        assert got[r.doc_id] == (crc(r.doc_id, n) == k, pytest.approx(s, abs=1e-6), int(got[r.doc_id][1] >= 0.3))


def test_language_query_matches_a_plain_nearest_centroid(spark, sf_dir, monkeypatch):
    held = []
    monkeypatch.setattr(langid, "fit", lambda *a, fit=langid.fit: held.append(fit(*a)) or held[0])
    got = {r.doc_id: r for r in queries.op1_language(spark, sf_dir).collect()}
    m = held[0]
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        c = langid.counts(pa.array([r.text]))[0]
        v = [np.log1p(float(x)) * float(i) for x, i in zip(c, m.idf, strict=True)]
        norm = sum(x * x for x in v) ** 0.5
        best = {}
        for centre, owner in zip(m.centroids, m.owner, strict=True):
            s = sum(a * float(b) for a, b in zip(v, centre, strict=True)) / norm if norm else 0.0
            best[owner] = max(best.get(owner, -2.0), s)
        row = got[r.doc_id]
        if not any(ch.isalpha() for ch in r.text or ""):
            assert row.lang_pred == "und" and row.score == 0
            continue
        top = max(best.values())
        assert best[m.languages.index(row.lang_pred)] == pytest.approx(top, abs=1e-5) and row.distance == pytest.approx(1 - top, abs=1e-5)
        assert row.score == pytest.approx(1 / sum(np.exp(langid._SHARPNESS * (x - top)) for x in best.values()), abs=1e-4)


def toxic_rows(n):
    """Texts of which one in ten is toxic by a word that also stands in some clean ones, sampled to as many of each class."""
    rng = np.random.default_rng(11)
    texts = [" ".join([*rng.choice([f"w{i}" for i in range(60)], 8), *["idiot"] * (k % 2 or rng.random() < 0.2)]) for k in range(2 * n)]
    return [SimpleNamespace(x=x, label=k % 2) for k, x in enumerate(toxicity.features(pa.array(texts)))]


def test_toxicity_model_is_the_same_with_100_times_the_labels():
    rows = toxic_rows(300)
    few, many = (toxicity.train(rows, {0: 300 / (2700 * k), 1: 300 / (300 * k)}) for k in (1, 100))
    assert np.array_equal(few[0], many[0]) and few[1] == pytest.approx(many[1])
    w = np.array([e.weight for e in toxicity.examples(rows, {0: 1 / 900, 1: 1 / 100})])
    y = np.array([r.label for r in rows])
    assert w.mean() == pytest.approx(1) and w[y == 1].sum() / w.sum() == pytest.approx(0.1)
    assert toxicity.examples([], {}) == []


def test_quality_model_is_the_same_with_100_times_the_labels(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 13} {'good' if i % 2 else 'bad'} w{i % 7}") for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    sampled = linear.sampled
    models, priors = [], []
    for times in (1, 100):
        shares = {0: 1 / (2 * times), 1: 1 / (12 * times)}
        monkeypatch.setattr(linear, "sampled", lambda *a, shares=shares: (sampled(*a)[0], shares))
        monkeypatch.setattr(linear, "train", lambda e, *a, train=linear.train, **b: (priors.append(sum(x.weight for x in e if x.label) / sum(x.weight for x in e)), train(e, *a, **b))[1])
        models.append(quality.fit(docs, labels))
        monkeypatch.undo()
    assert priors == pytest.approx([12 / 14, 12 / 14])
    assert np.allclose(models[0][0], models[1][0]) and models[0][1] == pytest.approx(models[1][1])


def test_foreign_text_is_rejected_at_every_length(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").dropna(subset=["text", "lang"]).orderBy("doc_id").toPandas()
    known, other = docs[docs.doc_id % 2 == 0], docs[docs.doc_id % 2 == 1]
    model = langid.train(known.lang.tolist(), langid.counts(pa.array(known.text.tolist())))
    foreign = ["Привет мир", "今天天气很", "Привет мир как дела сегодня хорошо " * 1700, "今天天气很好我们去公园玩吧" * 2600, "zxqvjk wqxzzq kqj " * 6000]
    assert [len(t.encode()) > 100_000 for t in foreign] == [False, False, True, True, True] and len(foreign[0].encode()) == 19
    assert model.predict(pa.array(foreign))[3].all()
    # texts of the learnt languages stay, cut short or joined to a long one
    other = other[other.n_chars.between(500, 3000)]
    short, long = [t[:n] for t in other.text for n in (20, 40)], [("\n".join(x) * 9)[:120_000] for _, x in other.groupby("lang").text]
    assert model.predict(pa.array(short))[3].mean() < 0.1 and not model.predict(pa.array(long))[3].any()
