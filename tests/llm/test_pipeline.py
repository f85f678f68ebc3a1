import brute
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F
from test_decontam import tokens as words_of

import corpus_pipeline as P
from assayer.llm import langid, secrets, sentencepieces


def test_run_matches_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.fit(docs)
    ids = sorted(rows)
    gone = model.predict(pa.array([rows[i].text for i in ids]))[3]
    ids = [i for i, g in zip(ids, gone, strict=True) if not g]
    comp = brute.components(ids, [brute.simhash(rows[i].text) for i in ids])
    ids = [i for i, c in zip(ids, comp, strict=True) if i == c]
    norm = lambda t: " " + " ".join(words_of(t)) + " "
    items = [norm(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    whole = [i for i in ids if any(x in norm(rows[i].text) for x in items)]
    got = {r.doc_id: r for r in P.run(spark, sf_dir).collect()}
    assert not set(whole) & set(got) and set(got) <= set(ids) and len(set(ids) - set(whole) - set(got)) <= 1 + len(whole) // 10
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL_PATH)
    changed = 0
    for i, r in got.items():
        found = secrets.spans_of(pa.array([rows[i].text]))[0]
        text = rows[i].text
        for s, _, e in found[::-1]:
            assert text[s:e] not in r.text or e - s < 9
        changed += bool(found)
        assert r.text == secrets.redact_text(text, found, "[REDACTED]") and r.n_chars == len(r.text)
        assert r.ids == library.encode(r.text) and r.n_tokens == len(r.ids) and r.round_trip
        assert (r.lang, r.source) == (rows[i].lang, rows[i].source)
    assert changed


def test_stages_keep_columns_and_handle_odd_rows(spark, make, sf_dir):
    text = "the quick brown fox jumps over the lazy dog and runs away from it "
    docs = make([(5, text * 3), (3, text * 3), (3, text * 3), (3, "another story about a cat that sleeps all day long in the sun"), (None, text * 3), (None, "one more text that nobody else has written so far here"), (None, "and a second one that stands quite alone in this small table"), (9, None), (8, ""), (7, "1234")])
    kept = P.language(spark, docs, sf_dir)
    assert kept.columns == docs.columns and kept.count() == 7
    kept = P.near_duplicates(spark, kept, sf_dir)
    out = sorted((str(r.doc_id), r.text[:7]) for r in kept.collect())
    assert kept.columns == docs.columns and out == [("3", "another"), ("3", "the qui"), ("None", "and a s"), ("None", "one mor")]
    for stage in (P.decontaminated, P.redacted):
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns and kept.count() == 4
    last = P.tokens(spark, kept, sf_dir)
    assert last.columns == [*docs.columns, "ids", "n_tokens", "round_trip"] and last.count() == 4
    nothing = docs.where(F.lit(False))
    for _, stage in P.STAGES:
        nothing = stage(spark, nothing, sf_dir)
    assert nothing.count() == 0


def test_clashing_columns_pass_through(spark, sf_dir):
    """Columns called like those that the stages use inside keep their values; the last stage's own replace theirs."""
    text = "the quick brown fox jumps over the lazy dog and runs away from it "
    rows = [(5, text * 3, "en"), (3, text * 3, "en"), (3, text * 3, "en"), (4, "a story about a cat that sleeps all day long in the sun of the garden", "en")]
    extra = ["__id", "__fp", "__own", "__n", "__k1", "__text", "text_", "decoded", "Ids", "n_tokens", "secrets", "fp", "root", "component_id", "score", "k1", "seeds", "kind"]
    docs = spark.createDataFrame([(d, t, lang, None, len(t), *[f"{d}{c}" for c in extra]) for d, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in extra))
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
    got = {r.doc_id: r.asDict() for r in docs.collect()}
    kept = [c for c in extra if c not in ("Ids", "n_tokens")]
    assert sorted(got) == [3, 4] and all(r[c] == f"{d}{c}" for d, r in got.items() for c in kept)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got.values()) and "Ids" not in docs.columns


def test_a_session_without_a_shared_folder_is_refused(monkeypatch):
    from types import SimpleNamespace

    import pytest

    from assayer.llm import shared

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://x:7077", getConf=lambda: SimpleNamespace(get=lambda *a: None)))
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared.shared_dir(far)
