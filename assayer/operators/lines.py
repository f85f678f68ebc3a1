"""Lines and runs: islands, interval merging, context windows, previous values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line), from 1; a line break is a line feed."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def islands(rows: DataFrame, key: str, position: str, flag: Column) -> DataFrame:
    """(key, first, last, n) of the maximal runs of consecutive positions where the flag holds."""
    w = Window.partitionBy(key).orderBy(position)
    runs = rows.where(flag).withColumn("__g", F.col(position) - F.row_number().over(w))
    return runs.groupBy(key, "__g").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("n")).drop("__g")


def merge_intervals(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 0, *more: Column) -> DataFrame:
    """(keys, start, end, n, more aggregates) of intervals joined where at most `gap` lies between them."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.withColumn("__new", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0))
    grouped = flagged.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "__g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"), *more).drop("__g")


def context(rows: DataFrame, key: str, position: str, flag: Column, before: int, after: int) -> Column:
    """Whether the flag holds for any row from `before` rows back to `after` rows ahead."""
    return F.max(F.when(flag, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(position).rowsBetween(before, after)) == 1


def previous(value: Column, key: str, position: str) -> Column:
    return F.lag(value).over(Window.partitionBy(key).orderBy(position))
