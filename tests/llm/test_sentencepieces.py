import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from assayer.llm import queries
from assayer.llm import sentencepieces as S


@pytest.fixture(scope="module")
def model():
    return S.Model.read(S.MODEL_PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.MODEL_PATH)


def run(model, texts):
    ids, at = S.encode(model, pa.array(texts))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


def samples():
    rng = random.Random(2)
    base = ["", None, "a", " ", "   ", "The quick  brown fox", " lead", "trail ", "tab\tnew\nline\r\n", "naïve café 北京 😀 ẞ", "▁under▁ ▁▁x", "<s> </s> <0x41> <unk>", "x" * 300, "ab" * 5000, "日本語" * 200, "=" * 100 + " " * 50 + "-" * 64, "with\0nul \0", "​﻿ combining é"]
    alphabet = "abcdefgh  teinorsé▁\n.0<>京😀"
    return base + ["".join(rng.choices(alphabet, k=rng.randrange(1, 120))) for _ in range(200)]


def test_ids_and_texts_match_the_library(model, library):
    texts = samples()
    got = run(model, texts)
    for t, ids in zip(texts, got, strict=True):
        assert ids == library.encode(t or ""), t
        back = S.decode(model, np.array(ids, np.int32), np.array([0, len(ids)]))[0]
        assert back == library.decode(ids)
        assert back == (t or "").replace("▁", " ")


def test_decoding_any_ids(model, library):
    rng = np.random.default_rng(4)
    for _ in range(50):
        ids = rng.integers(3, 3 + 256 if rng.random() < 0.3 else 32000, 20)
        ids = ids[ids >= 259] if rng.random() < 0.5 else ids
        got = S.decode(model, ids.astype(np.int32), np.array([0, len(ids)]))[0]
        assert got.replace("�", "") == library.decode(ids.tolist()).replace("�", "")
    with pytest.raises(ValueError, match="vocabulary"):
        S.decode(model, np.array([32000]), np.array([0, 1]))


def test_query_matches_the_library_on_the_whole_table(spark, sf_dir, library):
    want = {r.doc_id: library.encode(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op3_sentencepiece(spark, sf_dir).collect()
    assert {r.doc_id: r.ids for r in got} == want and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_columns_and_edges(spark, make, model):
    docs = make([(1, "a b"), (1, "a b"), (None, None), (2, "")]).withColumn("ids", F.lit("clash"))
    rows = S.decoded(S.encoded(docs, model), model).collect()
    assert sorted((r.doc_id or 0, len(r.ids), r.decoded, r.secrets) for r in rows) == [(0, 0, "", "x"), (1, 2, "a b", "x"), (1, 2, "a b", "x"), (2, 0, "", "x")]
    assert S.encoded(docs.where(F.lit(False)), model).count() == 0


def test_nul_characters_stand_in_the_same_index(model, library, monkeypatch):
    texts = [" ".join(f"w{i}\0x" for i in range(500)), "a\0", "\0", "x\0\0 \0y", "plain"]
    made = []
    monkeypatch.setattr(S, "Index", lambda *a, index=S.Index: (made.append(1), index(*a))[1])
    assert run(model, texts) == [library.encode(t) for t in texts] and len(made) == 1


def test_pieces_of_any_length():
    words = ["ab" * 12, "ab", "abab", "ab" * 4, "ab" * 8]
    pieces = ["<unk>", "a", "b", "▁", *words]
    model = S.Model(pieces, [0.0, -10.0, -11.0, -12.0, -5.0, -1.0, -2.0, -3.0, -4.0], [S._UNKNOWN, *[S._NORMAL] * 8], dummy_prefix=False).prepared()
    assert run(model, ["ab" * 12, "ab" * 13]) == [[4], [4, 5]] and run(model, ["ba"]) == [[2, 1]]


def test_clashing_columns_are_replaced(spark, model):
    docs = spark.createDataFrame([(1, "a b", 7, "x", 3)], "doc_id bigint, text string, ids int, decoded string, text_ int")
    got = S.round_trip(docs, model, keep=tuple(docs.columns))
    assert got.columns == ["doc_id", "text", "text_", "ids", "decoded"] and got.first().decoded == "a b" and got.first().text_ == 3
