"""Score shapes and rounding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp10(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), x))


def score2(x: Column) -> Column:
    """A score: clamped to 0..10 and rounded half up to two places."""
    return F.round(clamp10(x), 2)


def even2(x: Column) -> Column:
    """A confidence or coverage: rounded half to even."""
    return F.bround(x, 2)


def away(x: Column, places: int) -> Column:
    """Rounded half away from zero where the scaled double is a half, as C#'s Math.Round and SQL's round do; F.round goes by the shortest decimal text, in which 15.549999999999999 is below the half."""
    scale = F.lit(10.0**places)
    return F.round(x * scale) / scale


def density_of(load: Column, size: Column, k: float) -> Column:
    """10 * exp(-k * load / max(1, size)) for a load of findings already summed."""
    return 10 * F.exp(-F.lit(float(k)) * load / F.greatest(F.lit(1.0), size.cast("double")))


def findings_load(findings: DataFrame, by: list[str], file: str = "file", weight: str = "weight") -> DataFrame:
    """Per group, the load: each file counts 1 - 0.5 ** (its weights), all findings without a file as one more file.

    Two aggregations; both combine before they shuffle.
    """
    files = findings.groupBy(*by, F.coalesce(F.col(file), F.lit("")).alias("__file")).agg(F.sum(weight).alias("__w"))
    return files.groupBy(*by).agg(F.sum(1 - F.pow(F.lit(0.5), F.col("__w"))).alias("load"))


def share(x: Column, floor: float = 0.0) -> Column:
    """0 up to the floor, then linear to 10."""
    return F.when(x <= floor, F.lit(0.0)).otherwise(clamp10(10 * (x - floor) / (1 - floor)))


def check(passed: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(10.0)).otherwise(10.0 * passed / total)


def ladder(*steps: tuple[Column, float], otherwise: float = 0.0) -> Column:
    """The score of the first rung that holds."""
    out = None
    for test, score in steps:
        out = F.when(test, F.lit(score)) if out is None else out.when(test, F.lit(score))
    return out.otherwise(F.lit(otherwise))


def owa_weight(rank: Column, q: float) -> Column:
    """The weight, not yet scaled, of the rank-th value (from 1)."""
    return F.pow(F.lit(q), rank - 1)
