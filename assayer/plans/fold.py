"""The score fold, for any number of bundles at once.

measurements --weighted mean--> categories --worst-first OWA--> lenses --worst-first OWA--> headline, with gates, caps, cutlines
and bands. Every step groups or ranks within one bundle, so bundles spread over the cluster and a bundle's few rows
stay together after the first aggregation; nothing is collected.

Input tables (columns beyond these are ignored):
  bundles  bundle_id, quality_bar, analyzable_projects, production_loc [, claim]
  dims     bundle_id, id, category, score, confidence, coverage, advisory
  metas    bundle_id, id, lens, score, advisory
  lenses   bundle_id, ord, lens, score, owa_weight             (used where a bundle has no other input)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.shapes import owa_weight
from assayer.plans import rubric
from assayer.plans.rubric import BANDS, Scoring

DEFAULT = Scoring()


@dataclass
class Folded:
    categories: DataFrame  # bundle_id, lens, category, score, items, band_rank
    lenses: DataFrame  # bundle_id, lens, score, weight, contribution, band, band_rank, gated, gates, items, capped
    headline: DataFrame  # bundle_id, cai, band, uncapped_band, held, weakest_category
    errors: DataFrame  # bundle_id, error


def lookup(key: Column, values: dict, default: Column | None = None) -> Column:
    items = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    found = F.try_element_at(F.create_map(*items), key)
    return F.coalesce(found, default) if default is not None else found


def lens_order(lens: Column) -> Column:
    return lookup(lens, {x: i for i, x in enumerate(rubric.LENSES)}, F.lit(len(rubric.LENSES)))


def band_rank(score: Column, cutlines: tuple[Column, ...]) -> Column:
    """0 Critical to 4 Exemplary; a score on a cutline belongs to the band above it."""
    out = None
    for rank, cut in zip((4, 3, 2, 1), cutlines, strict=True):
        out = F.when(score >= cut, rank) if out is None else out.when(score >= cut, rank)
    return out.otherwise(0)


def band_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BANDS)), rank + 1)


def cutlines(p: Scoring, lens: Column, bar: Column) -> tuple[Column, ...]:
    """A lens's cutlines under a declared quality bar."""
    factor = lookup(lookup(lens, rubric.LENS_GROUP, F.lit("default")), p.group_factors, F.lit(p.group_factors["default"]))
    shift = F.when(bar.isNull(), F.lit(0.0)).otherwise(lookup(bar, p.bar_offsets, F.lit(0.0))) * factor
    top, strong, adequate, weak = p.cutlines
    return F.least(shift + top, F.lit(p.exemplary_ceiling)), shift + strong, shift + adequate, F.greatest(shift + weak, F.lit(p.poor_floor))


def baseline(p: Scoring) -> tuple[Column, ...]:
    return tuple(F.lit(x) for x in p.cutlines)


def eligible(dims: DataFrame, dimensions: DataFrame | None = None) -> DataFrame:
    """Dimensions that count, with their lens, effective score and what is wrong with them."""
    d = dims.where(~F.coalesce(F.col("advisory"), F.lit(False)) & (F.coalesce(F.col("confidence"), F.lit(0.0)) > 0))
    if dimensions is None:
        own = lookup(F.col("id"), rubric.DIMENSION_CATEGORY)
        home = lookup(F.col("id"), {i: lens for _, i, lens, *_ in rubric.dimensions()})
    else:  # another catalog: a small table of (id, category, lens)
        d = d.join(dimensions.select("id", F.col("category").alias("__own"), F.col("lens").alias("__home")), "id", "left")
        own, home = F.col("__own"), F.col("__home")
    cover = F.coalesce(F.col("coverage"), F.lit(1.0))
    lens = F.coalesce(lookup(F.col("category"), rubric.CATEGORY_LENS), home)
    wrong = (
        F.when(~F.col("score").between(0, 10), F.format_string("dimension %s: score outside 0-10", "id"))
        .when(~cover.between(0, 1), F.format_string("dimension %s: coverage outside 0-1", "id"))
        .when(own.isNotNull() & ~own.eqNullSafe(F.col("category")), F.format_string("dimension %s: category %s is not the published one", "id", F.coalesce("category", F.lit("none"))))
        .when(lens.isNull(), F.format_string("unknown category %s", F.coalesce("category", F.lit("none"))))
    )
    return d.select("bundle_id", "id", "category", lens.alias("lens"), "confidence", (F.col("score") * cover).alias("effective"), wrong.alias("error"))


def category_scores(d: DataFrame) -> DataFrame:
    mean = F.sum(F.col("effective") * F.col("confidence")) / F.sum("confidence")
    return d.groupBy("bundle_id", "lens", "category").agg((10 * mean).alias("score"), F.count(F.lit(1)).cast("int").alias("items"))


def owa(rows: DataFrame, by: list[str], q: float, score: str = "score") -> DataFrame:
    """Worst-first ordered weighted average of `score` in each group, and its number of inputs."""
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(score)))
    w = owa_weight(F.col("__r"), q)
    return ranked.groupBy(*by).agg((F.sum(F.col(score) * w) / F.sum(w)).alias("score"), F.count(F.lit(1)).cast("int").alias("items"))


def fold(bundles: DataFrame, dims: DataFrame, metas: DataFrame, lenses: DataFrame | None = None, p: Scoring = DEFAULT, dimensions: DataFrame | None = None, rubric_version: str | None = None) -> Folded:
    """Folds every bundle; one that breaks a rule gets a row in `errors` and none elsewhere. With `rubric_version`, bundles must name it in column `rubric`."""
    d = eligible(dims, dimensions)
    m = metas.where(~F.coalesce(F.col("advisory"), F.lit(False)) & F.col("score").isNotNull()).select(
        "bundle_id", "id", "lens", "score", F.when(~F.col("score").between(0, 10), F.format_string("meta-dimension %s: score outside 0-10", "id")).alias("error")
    )
    wrong = d.select("bundle_id", "error").unionByName(m.select("bundle_id", "error")).where("error is not null").groupBy("bundle_id").agg(F.min("error").alias("error"))

    if rubric_version is not None:
        other = bundles.where(~F.col("rubric").eqNullSafe(F.lit(rubric_version)))
        wrong = wrong.unionByName(other.select("bundle_id", F.format_string("evidence names rubric %s", F.coalesce("rubric", F.lit("none"))).alias("error")))

    categories = category_scores(d).withColumn("band_rank", band_rank(F.col("score"), baseline(p)))
    gates = (
        d.where(F.col("effective") < p.gate).select("bundle_id", "lens", "id").unionByName(m.where(F.col("score") < p.gate).select("bundle_id", "lens", "id"))
        .groupBy("bundle_id", "lens").agg(F.sort_array(F.collect_list("id")).alias("gates"))
    )
    inputs = categories.select("bundle_id", "lens", "score").unionByName(m.select("bundle_id", "lens", (F.col("score") * 10).alias("score")))
    about = bundles.select("bundle_id", "quality_bar", F.coalesce("analyzable_projects", F.lit(0)).alias("projects"), F.coalesce("production_loc", F.lit(0)).alias("loc"))

    scored = owa(inputs, ["bundle_id", "lens"], p.within_q).join(about, "bundle_id")
    arch = F.col("lens") == "architecture"
    capped = arch & (F.col("projects") < p.min_projects) & (F.col("loc") < p.min_loc)
    full = scored.where(~(arch & (F.col("projects") == 0))).select(
        "bundle_id", "lens", F.when(capped, F.least("score", F.lit(p.low_surface_cap))).otherwise(F.col("score")).alias("score"), "items", capped.alias("capped"), F.lit(None).cast("double").alias("given"), F.lit(0).alias("ord")
    )
    if lenses is not None:
        thin = lenses.join(inputs.select("bundle_id").distinct(), "bundle_id", "left_anti")
        near_one = F.abs(F.sum(F.coalesce("owa_weight", F.lit(0.0))).over(Window.partitionBy("bundle_id")) - 1) <= 0.01
        twice = F.count(F.lit(1)).over(Window.partitionBy("bundle_id", "lens")) > 1
        thin = thin.select("bundle_id", "lens", "score", F.lit(0).alias("items"), F.lit(False).alias("capped"), F.when(near_one, F.coalesce("owa_weight", F.lit(0.0))).alias("given"), "ord", (near_one & twice).alias("__twice"))
        wrong = wrong.unionByName(thin.where("__twice").select("bundle_id", F.lit("a lens stands twice among given weights").alias("error")).distinct())
        full = full.unionByName(thin.drop("__twice"))
    have = full.select("bundle_id").distinct()
    missing = bundles.select("bundle_id").join(have, "bundle_id", "left_anti").select("bundle_id", F.lit("no measured lens to score").alias("error"))
    errors = wrong.unionByName(missing).groupBy("bundle_id").agg(F.min("error").alias("error"))
    good = full.join(errors.select("bundle_id"), "bundle_id", "left_anti")
    categories = categories.join(errors.select("bundle_id"), "bundle_id", "left_anti")

    order = Window.partitionBy("bundle_id").orderBy("score", lens_order(F.col("lens")), "ord", "lens")
    ranked = good.withColumn("__r", F.row_number().over(order)).withColumn("__w", owa_weight(F.col("__r"), p.across_q))
    total = F.sum("__w").over(Window.partitionBy("bundle_id"))
    weighed = ranked.withColumn("weight", F.coalesce("given", F.col("__w") / total)).withColumn("contribution", F.col("score") * F.col("weight"))
    weighed = weighed.join(about.select("bundle_id", "quality_bar"), "bundle_id").join(gates, ["bundle_id", "lens"], "left")
    gated = F.col("gates").isNotNull()
    own = band_rank(F.col("score"), cutlines(p, F.col("lens"), F.col("quality_bar")))
    rank = F.when(gated, F.least(own, F.lit(2))).otherwise(own)
    result = weighed.select("bundle_id", "lens", "score", "weight", "contribution", band_name(rank).alias("band"), rank.alias("band_rank"), gated.alias("gated"), F.coalesce("gates", F.array().cast("array<string>")).alias("gates"), "items", "capped")

    weakest = categories.groupBy("bundle_id").agg(F.min("band_rank").alias("weakest"), F.min_by("category", F.struct("score", "lens", "category")).alias("weakest_category"))
    sums = result.groupBy("bundle_id").agg(F.sum("contribution").alias("cai")).join(weakest, "bundle_id", "left")
    free = band_rank(F.col("cai"), baseline(p))
    held = F.least(free, F.least(F.coalesce(F.col("weakest") + 1, F.lit(4)), F.lit(4)))
    headline = sums.select("bundle_id", "cai", band_name(held).alias("band"), band_name(free).alias("uncapped_band"), (held < free).alias("held"), F.when(held < free, F.col("weakest_category")).alias("weakest_category"))
    return Folded(categories, result, headline, errors)


def verify(folded: Folded, bundles: DataFrame, p: Scoring = DEFAULT, tolerance: float | None = None) -> DataFrame:
    """Whether each claim is reproduced within the tolerance."""
    delta = F.abs(F.col("cai") - F.col("claim"))
    return folded.headline.join(bundles.select("bundle_id", "claim"), "bundle_id").select("bundle_id", "cai", "claim", delta.alias("delta"), (delta <= (p.tolerance if tolerance is None else tolerance)).alias("ok"))
