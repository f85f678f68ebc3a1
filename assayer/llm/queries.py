"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import decontam, langid, quality, secrets, sentencepieces, simhash, spotsigs, substring, toxicity, warc
from assayer.llm.shared import fold, fresh_path, table


def _held_out(n: int, k: int):
    return F.coalesce(fold("doc_id", n) == k, F.lit(False)).alias("held_out")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 5) != 0))
    return langid.predict(docs, model).select("doc_id", _held_out(5, 0), "lang_pred", "score", "distance", "rejected")


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = sentencepieces.MODEL_PATH) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.sha2("text", 256).alias("text_sha256"))
    found = sentencepieces.round_trip(docs, sentencepieces.Model.read(model_path), keep=("doc_id", "text_sha256"))
    decoded = F.sha2("decoded", 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", decoded.alias("decoded_sha256"), (decoded == F.coalesce("text_sha256", F.sha2(F.lit(""), 256))).alias("round_trip"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(fold("doc_id", 5) != 0))
    return quality.scores(docs, model).select("doc_id", _held_out(5, 0), "score", "predicted")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    # the payload is asked for, so sizes and digests of responses are those of what the archive holds
    found = warc.read(spark, path, "record_type string, page_id bigint, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 4) != 2))
    return toxicity.scores(docs, model).select("doc_id", _held_out(4, 2), "score", "predicted")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.intervals(table(spark, sf_dir, "documents")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_language": op1_language,
    "op2_spotsigs": op2_spotsigs,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_substring": op7_substring,
    "op8_toxicity": op8_toxicity,
    "op9_secrets": op9_secrets,
    "op10_decontamination": op10_decontamination,
}
#: The other operators' results rest on models, on hashes or on readings that SQL has no words for; tests hold those against brute force.
ORACLES: dict[str, str] = {
    "op5_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
        ), d AS (
            SELECT page_id, payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS largest FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN largest END AS refers_to
        FROM d
    """,
    "op7_substring": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), starts AS (
            SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50
        ), windows AS (
            SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM starts
        ), judged AS (
            SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) < doc_id AS repeated FROM windows
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM judged WHERE repeated
        ), numbered AS (
            SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d
        ), kept AS (
            SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY k) AS text FROM numbered ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
}
