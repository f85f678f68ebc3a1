"""What leaves the engine: pruned findings, completed measurements, and JSON, SARIF and mapping documents.

Documents are built from DataFrames in a total order, so equal inputs give equal bytes; a document holds one bundle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import shapes
from assayer.plans import rubric

#: Why taxonomy concepts have no rule here.
UNMAPPED_REASONS = {
    "outdated-dependency": "needs registry data, and nothing is fetched",
    "deprecated-dependency": "needs registry data, and nothing is fetched",
    "mass-assignment": "not implemented",
    "nosql-injection": "not implemented",
    "missing-subresource-integrity": "not implemented",
    "floating-promise": "concept of another language",
    "prototype-pollution": "concept of another language",
    "iac-misconfiguration": "umbrella of more precise rules",
}
NO_RULE = "no detector in this engine"


def prune_postures(findings: DataFrame, measurements: DataFrame, posture: Column | None = None, floor: float = rubric.POSTURE_FLOOR) -> DataFrame:
    """Drops posture findings without a file whose dimension scores `floor` or more; a dimension without a score keeps them."""
    if posture is None:
        posture = F.col("rule_id").isin(*rubric.POSTURE_RULES.split())
    scored = findings.join(F.broadcast(measurements.select(F.col("id").alias("__id"), F.col("score").alias("__score"))), F.col("dimension") == F.col("__id"), "left")
    return scored.where(~(posture & F.col("file").isNull() & (F.coalesce("__score", F.lit(0.0)) >= floor))).drop("__id", "__score")


def not_measured(dimensions: DataFrame, measured: DataFrame, skipped: DataFrame | None = None, fallback: str = "no detector ran for this dimension") -> DataFrame:
    """(id, reason) of dimensions without a measurement: the detector's reason, else the static one, else the fallback."""
    rest = dimensions.join(measured.select("id").distinct(), "id", "left_anti")
    if skipped is not None:
        rest = rest.join(skipped.groupBy("id").agg(F.min("reason").alias("__skip")), "id", "left")
    else:
        rest = rest.withColumn("__skip", F.lit(None).cast("string"))
    return rest.withColumn("reason", F.coalesce("__skip", "static_reason", F.lit(fallback))).drop("__skip")


def sarif_positions(findings: DataFrame) -> DataFrame:
    """Adds the place of each result (file, line, rule, message, commit) and the index of its rule.

    A whole order has one last step; it numbers the rows of one document, not of a corpus.
    """
    order = Window.orderBy(F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), "rule_id", "message", F.coalesce("commit_sha", F.lit("")))
    index = findings.select("rule_id").distinct().withColumn("rule_index", F.row_number().over(Window.orderBy("rule_id")) - 1)
    return findings.withColumn("pos", F.row_number().over(order)).join(F.broadcast(index), "rule_id")


def sarif(findings: DataFrame, rules: DataFrame, tool: str = "assayer", version: str = "1") -> DataFrame:
    """One row with a SARIF 2.1.0 document."""
    placed = sarif_positions(findings).join(F.broadcast(rules.select(F.col("concept").alias("rule_id"), "also", "cwe", "title")), "rule_id", "left")
    end = F.when(F.coalesce("end_line", F.lit(0)) >= F.col("line"), F.col("end_line")).otherwise(F.col("line"))
    region = F.when(F.coalesce("line", F.lit(0)) > 0, F.struct(F.col("line").alias("startLine"), end.alias("endLine")))
    location = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), F.lit("warning").alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.when(F.col("file").isNotNull(), F.array(location)).alias("locations"),
        F.struct(F.col("dimension"), F.col("also"), F.col("weight"), F.col("commit_sha").alias("commit")).alias("properties"),
    )
    results = placed.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", result.alias("r")))), lambda x: x["r"]).alias("results"))
    own = placed.select("rule_id", "rule_index", "title", "cwe").distinct()
    described = F.struct("rule_index", F.struct(F.col("rule_id").alias("id"), F.struct(F.col("title").alias("text")).alias("shortDescription"), F.struct(F.array(F.col("cwe")).alias("tags")).alias("properties")).alias("r"))
    driver = own.agg(F.transform(F.sort_array(F.collect_list(described)), lambda x: x["r"]).alias("rules"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    return results.crossJoin(driver).select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("json"))


def scores_json(scores: DataFrame) -> DataFrame:
    """One row: ids and scores on a scale of 100, one place, in id order; rows without an id are left out, those of one id are in the order of their scores."""
    scores = scores.where("id is not null")
    items = F.sort_array(F.collect_list(F.struct("id", shapes.away(F.col("score") * 10, 1).alias("s"))))
    pairs = F.transform(items, lambda x: F.concat(F.to_json(F.struct(x["id"].alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(x["id"].alias("k")))) - 6), F.lit(":"), x["s"].cast("string")))
    return scores.agg(pairs.alias("p")).select(F.concat(F.lit("{"), F.array_join("p", ","), F.lit("}")).alias("json"))


def evidence(bundle: DataFrame, measurements: DataFrame, skipped: DataFrame, dimensions: DataFrame) -> DataFrame:
    """One row with the evidence document: dimensions with a category, meta-dimensions, what isn't measured and why."""
    placed = measurements.join(dimensions.select("id", "ord", "lens", "category"), "id", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown dimension "), F.col("id")))
    placed = placed.withColumn("ord", F.when(F.col("ord").isNull(), unknown.cast("int")).otherwise(F.col("ord")))
    cover = F.when(F.coalesce("coverage", F.lit(1.0)) != 1.0, F.bround("coverage", 2)).alias("coverage")
    score = F.round("score", 2).alias("score")
    dim = F.struct("id", "category", score, F.bround("confidence", 2).alias("confidence"), cover, F.when(F.col("advisory"), True).alias("advisory"))
    meta = F.struct("id", "lens", score, F.when(F.col("advisory"), True).alias("advisory"))
    rows = lambda s: F.transform(F.sort_array(F.collect_list(s)), lambda x: x["r"])
    dims = placed.where("category is not null").agg(rows(F.struct("ord", dim.alias("r"))).alias("dimensions"))
    metas = placed.where("category is null").agg(rows(F.struct("ord", meta.alias("r"))).alias("metaDimensions"))
    rest = not_measured(dimensions, measurements, skipped).agg(rows(F.struct("ord", F.struct("id", "reason").alias("r"))).alias("notMeasured"))
    joined = bundle.crossJoin(dims).crossJoin(metas).crossJoin(rest)
    head = ("rubricVersion", "commit", "qualityBar", "analyzableProjects", "productionLoc", "headlineScore")
    names = [c for c in head if c in bundle.columns]
    return joined.select(F.to_json(F.struct(*names, "dimensions", "metaDimensions", "notMeasured"), {"ignoreNullFields": "true"}).alias("json"))


def unmapped(taxonomy: DataFrame, rules: DataFrame) -> DataFrame:
    """(concept, reason) of taxonomy concepts without a rule."""
    reason = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in UNMAPPED_REASONS.items() for x in kv)), F.col("concept")), F.lit(NO_RULE))
    return taxonomy.join(F.broadcast(rules.select("concept")), "concept", "left_anti").select("concept", reason.alias("reason"))


def mapping(taxonomy: DataFrame, rules: DataFrame, tool: str = "assayer") -> DataFrame:
    """One row with the mapping document: every rule as a pattern with its dimension, and the concepts without one."""
    own = rules.agg(F.sort_array(F.collect_list(F.struct("concept", F.concat(F.lit("^"), F.col("concept"), F.lit("$")).alias("pattern"), "dimension"))).alias("rules"))
    rest = unmapped(taxonomy, rules).agg(F.sort_array(F.collect_list(F.struct("concept", "reason"))).alias("unmapped"))
    return own.crossJoin(rest).select(F.to_json(F.struct(F.lit(tool).alias("tool"), "rules", "unmapped")).alias("json"))


def findings_tsv(findings: DataFrame) -> DataFrame:
    """One row with the findings as tab-separated lines under a head, in the order of the SARIF document."""
    names = ("rule_id", "dimension", "file", "line", "weight", "message")
    line = F.concat_ws("\t", *(F.regexp_replace(F.coalesce(F.col(n).cast("string"), F.lit("")), r"[\t\r\n]+", " ") for n in names))
    rows = sarif_positions(findings).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]).alias("a"))
    return rows.select(F.array_join(F.concat(F.array(F.lit("\t".join(names))), "a"), "\n").alias("text"))


def markdown(rows: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """One row with a Markdown table of the rows in a total order."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", "\\\\|") for c in columns)), F.lit(" |"))
    lines = rows.select(F.struct(F.row_number().over(Window.orderBy(*order)).alias("n"), cells.alias("l")).alias("s")).agg(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["l"]).alias("a"))
    head = [f"| {' | '.join(columns)} |", f"|{'-|' * len(columns)}"]
    return lines.select(F.array_join(F.concat(F.array(*map(F.lit, head)), "a"), "\n").alias("text"))


def summary(findings: DataFrame, measurements: DataFrame) -> DataFrame:
    """One row with a Markdown table of the measured dimensions: score, findings and their weight."""
    per = findings.groupBy(F.col("dimension").alias("id")).agg(F.count(F.lit(1)).alias("findings"), F.round(F.sum("weight"), 2).alias("weight"))
    rows = measurements.join(per, "id", "left").fillna(0, ["findings"]).fillna(0.0, ["weight"])
    return markdown(rows, ["id", "score", "findings", "weight"], [F.col("score"), F.col("id")])
