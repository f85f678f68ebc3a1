"""Change history: hot spots, ownership, staleness, co-change. Inputs are rows (commit, author, ts, path)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def head(history: DataFrame) -> DataFrame:
    """One row with the date of the newest change; windows are relative to it, never to the clock."""
    return history.agg(F.max("ts").alias("head"))


def days_between(late, early):
    """Fractional days."""
    return (F.unix_micros(late.cast("timestamp")) - F.unix_micros(early.cast("timestamp"))) / F.lit(86_400_000_000.0)


def hotspots(history: DataFrame, complexity: DataFrame, window_days: int = 180, churn: int = 4, complex_: float = 10, share: float = 0.08, hot_churn: int = 6, hot_complex: float = 15) -> DataFrame:
    """Paths (path, churn, complexity) changed often lately and complex: churn and complexity and a share of all touches, or both high."""
    recent = history.crossJoin(F.broadcast(head(history))).where(F.col("ts") >= F.col("head") - F.expr(f"interval {window_days} days"))
    per = recent.groupBy("path").agg(F.count(F.lit(1)).alias("churn"))
    total = recent.agg(F.count(F.lit(1)).alias("total"))
    found = per.join(complexity, "path").crossJoin(F.broadcast(total))
    often = (F.col("churn") >= churn) & (F.col("complexity") >= complex_) & (F.col("churn") >= share * F.col("total"))
    return found.where(often | ((F.col("churn") >= hot_churn) & (F.col("complexity") >= hot_complex))).select("path", "churn", "complexity")


def ownership(history: DataFrame) -> DataFrame:
    """(path, touches, authors, first, last, owner): the author with the most touches, the first by name among equals."""
    per = history.groupBy("path", "author").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return per.groupBy("path").agg(
        F.sum("n").alias("touches"), F.count(F.lit(1)).alias("authors"), F.min("a").alias("first"), F.max("b").alias("last"), F.min_by("author", F.struct(-F.col("n"), F.col("author"))).alias("owner")
    )


def last_active(history: DataFrame) -> DataFrame:
    return history.groupBy("author").agg(F.max("ts").alias("active"))


def concentration(history: DataFrame, touches: int = 4, span_days: float = 60, active_days: float = 90) -> DataFrame:
    """Paths that one author alone touched, often enough over long enough, and that author is still active."""
    solo = ownership(history).where((F.col("authors") == 1) & (F.col("touches") >= touches) & (days_between(F.col("last"), F.col("first")) >= span_days))
    active = last_active(history).select(F.col("author").alias("owner"), "active")
    out = solo.join(active, "owner").crossJoin(F.broadcast(head(history)))
    return out.where(days_between(F.col("head"), F.col("active")) <= active_days).select("path", "owner", "touches")


def stale(history: DataFrame, stale_days: float = 180, active_days: float = 90, history_share: float = 0.5) -> DataFrame:
    """Paths whose last change is older than the larger of `stale_days` and half the history (or another share), and none of whose authors is active."""
    h = head(history).crossJoin(history.agg(F.min("ts").alias("start")))
    active = last_active(history)
    silent = history.select("path", "author").distinct().join(active, "author").groupBy("path").agg(F.max("active").alias("active"))
    per = history.groupBy("path").agg(F.max("ts").alias("last")).join(silent, "path").crossJoin(F.broadcast(h))
    limit = F.greatest(F.lit(float(stale_days)), days_between(F.col("head"), F.col("start")) * history_share)
    return per.where((days_between(F.col("head"), F.col("last")) > limit) & (days_between(F.col("head"), F.col("active")) > active_days)).select("path", "last")


def change_coupling(changes: DataFrame, edges: DataFrame | None = None, support: int = 5, confidence: float = 0.7, max_files: int = 12, folder=None) -> DataFrame:
    """Pairs a < b of paths that change together: (a, b, support, confidence), from rows (commit, path).

    Commits of more than `max_files` paths count for nothing, so a commit gives at most max_files * (max_files - 1) / 2 pairs.
    Pairs joined by an edge either way, or of one folder, are left out.
    """
    each = changes.select("commit", "path").distinct()
    size = F.count(F.lit(1)).over(Window.partitionBy("commit"))
    small = each.withColumn("size", size).where((F.col("size") <= max_files) & (F.col("size") > 0)).select("commit", "path")
    counts = small.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.commit") == F.col("y.commit")) & (F.col("x.path") < F.col("y.path")))
    found = pairs.groupBy(F.col("x.path").alias("a"), F.col("y.path").alias("b")).agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= support)
    found = found.join(counts.toDF("a", "na"), "a").join(counts.toDF("b", "nb"), "b")
    found = found.withColumn("confidence", F.col("support") / F.least("na", "nb")).where(F.col("confidence") >= confidence)
    if folder is not None:
        found = found.where(folder(F.col("a")) != folder(F.col("b")))
    if edges is not None:
        undirected = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
        found = found.join(undirected, ["a", "b"], "left_anti")
    return found.select("a", "b", "support", "confidence")
