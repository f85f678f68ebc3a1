"""Package and rubric versions as sortable columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_key(text: Column) -> Column:
    """A struct that sorts as package versions do; null where the text is no version.

    Up to four numeric parts; a release sorts after its pre-releases; labels of a pre-release compare one by one, numbers before
    words and by value, words without case, the shorter list first. Build metadata and a leading v don't count.
    """
    plain = F.regexp_replace(F.split_part(F.trim(text), F.lit("+"), F.lit(1)), "^[vV]", "")
    numbers, dash, labels = F.regexp_extract(plain, r"^([^-]*)", 1), F.contains(plain, F.lit("-")), F.regexp_extract(plain, r"^[^-]*-(.*)$", 1)
    parts = F.split(numbers, r"\.")
    part = lambda k: F.coalesce(F.try_element_at(parts, F.lit(k)).cast("bigint"), F.lit(0))
    number = lambda x: F.when(x.rlike(r"^[0-9]{1,18}$"), x.cast("bigint"))
    label = F.transform(F.split(labels, r"\."), lambda x: F.struct(number(x).isNull().alias("word"), F.coalesce(number(x), F.lit(0)).alias("n"), F.when(number(x).isNull(), F.lower(x)).otherwise("").alias("s")))
    key = F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), part(4).alias("revision"), (~dash).alias("release"), F.when(dash, label).alias("labels"))
    return F.when(numbers.rlike(r"^[0-9]{1,18}(\.[0-9]{1,18}){0,3}$") & (~dash | (labels != "")), key)


def rubric_key(text: Column) -> Column:
    """Parts of a rubric version as numbers; a part that is no number is -1. Compare with trailing zeros stripped."""
    parts = F.transform(F.split(F.regexp_replace(text, "^[^0-9]*", ""), r"\."), lambda x: F.when(x.rlike(r"^\d{1,18}$"), x.cast("bigint")).otherwise(F.lit(-1)))
    keep = F.aggregate(F.transform(parts, lambda x, i: F.when(x != 0, i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return F.slice(parts, F.lit(1), keep)


def in_interval(version: Column, introduced: Column, fixed: Column, last: Column) -> Column:
    """introduced <= v, and v < fixed or v <= last; open where a bound is null."""
    return (introduced.isNull() | (version >= introduced)) & (fixed.isNull() | (version < fixed)) & (last.isNull() | (version <= last))
