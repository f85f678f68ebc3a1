"""What the operators share with Spark: tables, the shared folder, checkpoints."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch at most: documents can be long, and a worker holds a batch at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limits on Arrow batches where they are higher."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        have = spark.conf.get(key).rstrip("b")
        if not have.isdigit() or int(have) > most or int(have) <= 0:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only where that is unset in a session on one machine (tests)."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not have:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="assayer-")
        spark.conf.set("spark.checkpoint.dir", have)
    return have.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def fold(key: str, modulus: int):
    """crc32 of a key as text, modulo: the fixed folds of the labelled tables. A null key is in no fold."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus))


def smallest(rows: DataFrame, group: str, most: int, key: str = "id") -> tuple[DataFrame, dict]:
    """(group, key) of the `most` distinct keys of each group with the smallest hash, and the number of rows of each group.

    Rows and (about) keys are counted by group first; only rows whose hash lies below a limit derived from the number of keys (about twice the sample)
    are told apart and ranked, so a task that ranks a group reads about twice the sample, whatever the table's size and however often a key is repeated.
    The driver holds two numbers for each group, as the model does that is fitted on it.
    """
    spark = rows.sparkSession
    rows = rows.select(group, key)
    counted = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(key).alias("keys")).collect()
    ample = 2 * (most + 8 * math.sqrt(most) + 64)
    limits = [(r[0], min((1 << 63) - 1, int(ample / max(1, r["keys"]) * (1 << 64)) - (1 << 63))) for r in counted]
    limit = spark.createDataFrame(limits, f"`{group}` {dict(rows.dtypes)[group]}, __limit bigint")
    few = rows.join(F.broadcast(limit), group).where(F.xxhash64(key) <= F.col("__limit")).select(group, key).distinct()
    order = Window.partitionBy(group).orderBy(F.xxhash64(key), F.col(key))
    return few.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n"), {r[0]: r.n for r in counted}


def one_text(docs: DataFrame, chosen: DataFrame, *by: str) -> DataFrame:
    """The chosen rows (`by`, text), joined by the columns that both tables have; of rows that share `by` one, by the smallest hash of its text. `chosen` is a bounded sample."""
    shared = [c for c in by if c in docs.columns]
    return docs.join(F.broadcast(chosen), shared).groupBy(*by).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def spare(taken, name: str) -> str:
    """A column name that clashes with none of those taken."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def without(columns, *outs: str) -> list[str]:
    """The columns but those that an operator's own results replace."""
    low = {o.lower() for o in outs}
    return [c for c in columns if c.lower() not in low]


def typed(df: DataFrame, columns, *extra: str) -> str:
    """The columns with their types, and more, as a schema in words."""
    kinds = dict(df.select(*(F.col(f"`{c}`") for c in columns)).dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), *extra])
