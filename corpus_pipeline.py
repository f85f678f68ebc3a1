"""The corpus pipeline: stages over `documents`, each written as Parquet in the shared folder and reread as the next one's input.

1. language: documents whose language can't be told go (no letter, or unlike every labelled language).
2. near-duplicates: of the documents that SimHash links, directly or over others, the one with the smallest doc_id stays.
3. decontamination: documents that hold a benchmark item, in whatever order of passages, go.
4. secrets: spans that look like secrets are blacked out in the text; n_chars follows.
5. tokens: SentencePiece ids are added, and texts that don't survive encoding and decoding are marked.

Defined cases: null and empty texts leave in stage 1; documents without a doc_id pass stage 2 only where no document with one is
linked to them, and of repeated rows (one doc_id and text) one stays; columns beside those of `documents` pass through, whatever their names, but that
the last stage's own columns (ids, n_tokens, round_trip) replace those of their name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm import decontam, langid, secrets, sentencepieces, simhash
from assayer.llm.shared import bounded_batches, checkpointed, fresh_path, spare, table, without


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps each component's document with the smallest doc_id.

    The ids that stay are found from fingerprints alone. The text side is joined once, by doc_id; repeated doc_ids are told
    apart by their fingerprint, and repeated rows by a number.
    """
    bounded_batches(spark)
    found = checkpointed(simhash.near_duplicates(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("s")
    key, fp, own, nth = (spare(docs.columns, c) for c in ("__id", "__fp", "__own", "__n"))
    ids = found.groupBy("root").agg(first).select(F.coalesce("s.doc_id", F.lit(-(1 << 63))).alias(key), F.col("s.fp").alias(fp))
    kept = docs.withColumn(key, F.coalesce("doc_id", F.lit(-(1 << 63)))).join(ids, key)
    repeated = found.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if repeated:
        prints = simhash.with_fingerprint(kept, "text", tuple(kept.columns), out=own).where(F.col(own) == F.col(fp))
        ordered = [F.col(f"`{c}`") for c, kind in docs.dtypes if c != "doc_id" and not any(x in kind for x in ("map<", "variant"))]
        order = Window.partitionBy(key, fp).orderBy(F.xxhash64("text"), *ordered)
        kept = prints.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return secrets.redact(docs, length="n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str = sentencepieces.MODEL_PATH) -> DataFrame:
    bounded_batches(spark)
    kept = without(docs.columns, "ids", "n_tokens", "round_trip")
    # a column `decoded` of the documents stands aside while the texts are decoded
    aside = {c: spare([*kept, "decoded"], "__decoded") for c in kept if c.lower() == "decoded"}
    docs = docs.select(*(F.col(f"`{c}`").alias(aside.get(c, c)) for c in kept))
    found = sentencepieces.round_trip(docs, sentencepieces.Model.read(model_path), keep=tuple(docs.columns))
    same = (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    return found.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in kept), "ids", F.size("ids").cast("long").alias("n_tokens"), same)


STAGES: list[tuple[str, Callable]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", redacted),
    ("tokens", tokens),
]

#: SQL can't express these stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
