"""Command line: scan a repository, score or verify an evidence document, write the mapping."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.plans import fold as FO
from assayer.plans import rubric, sinks
from assayer.plans import scan as S
from assayer.sources import tables


def bundle_tables(spark: SparkSession, documents: dict[str, dict]) -> tuple[DataFrame, ...]:
    """(bundles, dims, metas, lenses) of evidence documents by name."""
    number = lambda x: None if x is None else float(x)
    b, d, m, n = [], [], [], []
    for name, e in documents.items():
        b.append((name, e.get("rubricVersion"), e.get("qualityBar"), e.get("analyzableProjects"), e.get("productionLoc"), number(e.get("headlineScore"))))
        d += [(name, x["id"], x.get("category"), number(x.get("score")), number(x.get("confidence")), number(x.get("coverage")), x.get("advisory")) for x in e.get("dimensions") or []]
        m += [(name, x["id"], x.get("lens"), number(x.get("score")), x.get("advisory")) for x in e.get("metaDimensions") or []]
        n += [(name, k, x["lens"], number(x["score"]), number(x.get("owaWeight"))) for k, x in enumerate(e.get("lenses") or [])]
    return (
        spark.createDataFrame(b, "bundle_id string, rubric string, quality_bar string, analyzable_projects int, production_loc int, claim double"),
        spark.createDataFrame(d, "bundle_id string, id string, category string, score double, confidence double, coverage double, advisory boolean"),
        spark.createDataFrame(m, "bundle_id string, id string, lens string, score double, advisory boolean"),
        spark.createDataFrame(n, "bundle_id string, ord int, lens string, score double, owa_weight double"),
    )


def fold_documents(spark: SparkSession, documents: dict[str, dict], version: str | None = rubric.RUBRIC_VERSION, catalog: rubric.Catalog | None = None) -> tuple[FO.Folded, DataFrame]:
    """Folds documents under the built-in rubric, or under that of a catalog."""
    bundles, dims, metas, lenses = bundle_tables(spark, documents)
    if catalog is not None:
        return FO.fold(bundles, dims, metas, lenses, p=catalog.scoring, dimensions=catalog.table(spark), rubric_version=catalog.version), bundles
    return FO.fold(bundles, dims, metas, lenses, rubric_version=version), bundles


def result(folded: FO.Folded) -> dict:
    """The result of a single bundle as a plain document, lenses by contribution."""
    error = folded.errors.first()
    if error:
        return {"error": error.error}
    h = folded.headline.first()
    lenses = folded.lenses.orderBy(F.desc("contribution"), FO.lens_order(F.col("lens"))).collect()
    return {
        "cai": round(h.cai + 1e-9, 2), "band": h.band, "heldBy": h.weakest_category,
        "lenses": [{"lens": r.lens, "score": round(r.score, 2), "band": r.band, "weight": round(r.weight, 4), "gated": r.gated, "gates": list(r.gates), "items": r["items"]} for r in lenses],
    }


def table_text(r: dict) -> str:
    rows = [f"{x['lens']:<22}{x['score']:>8.2f}  {x['band']:<10}{x['weight']:>8.4f}{'  gated' if x['gated'] else ''}" for x in r["lenses"]]
    return "\n".join([*rows, f"{'headline':<22}{r['cai']:>8.2f}  {r['band']}"])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="assayer")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("scan")
    p.add_argument("root")
    p.add_argument("--out", default="scan-out")
    p.add_argument("--quality-bar")
    p.add_argument("--advisories", help="advisories as JSON")
    p.add_argument("--cycles", help="ends of life as JSON")
    p.add_argument("--as-of", help="the date that ends of life are held against")
    p.add_argument("--licences", help="JSON with a list copyleft")
    p.add_argument("--packages", help="a folder of restored packages")
    for name in ("score", "verify"):
        p = sub.add_parser(name)
        p.add_argument("evidence")
        p.add_argument("--any-rubric", action="store_true")
        p.add_argument("--catalog", help="the rubric as JSON")
    p.add_argument("--expect", type=float)
    p = sub.add_parser("mapping")
    p.add_argument("--taxonomy")
    p.add_argument("--out")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("assayer").getOrCreate()
    if args.command == "scan":
        given = {"advisories": tables.advisory_ranges(spark, args.advisories) if args.advisories else None, "cycles": tables.end_of_life_cycles(spark, args.cycles) if args.cycles else None, "as_of": args.as_of}
        if args.licences and args.packages:
            given["licences"] = (tables.package_licences(spark, args.packages), json.loads(Path(args.licences).read_text())["copyleft"])
        s = S.scan(spark, args.root, args.quality_bar, **given)
        out = Path(args.out)
        out.mkdir(parents=True, exist_ok=True)
        dims = rubric.dimensions_table(spark)
        head = s.bundle.crossJoin(s.folded.headline.select(F.round("cai", 2).alias("headlineScore"))).select(
            F.lit(rubric.RUBRIC_VERSION).alias("rubricVersion"), F.col("quality_bar").alias("qualityBar"), F.col("analyzable_projects").alias("analyzableProjects"), F.col("production_loc").alias("productionLoc"), "headlineScore"
        )
        for name, df in (("evidence.json", sinks.evidence(head, s.measurements, s.skipped, dims)), ("findings.sarif", sinks.sarif(s.findings, rubric.rules_table(spark))), ("scores.json", sinks.scores_json(s.measurements))):
            (out / name).write_text(df.first().json + "\n")
        for name, df in (("findings.tsv", sinks.findings_tsv(s.findings)), ("summary.md", sinks.summary(s.findings, s.measurements))):
            (out / name).write_text(df.first().text + "\n")
        print(table_text(result(s.folded)))
        return 0
    if args.command == "mapping":
        concepts = [(x,) for x in json.loads(Path(args.taxonomy).read_text())] if args.taxonomy else []
        text = sinks.mapping(spark.createDataFrame(concepts, "concept string"), rubric.rules_table(spark)).first().json
        Path(args.out).write_text(text + "\n") if args.out else print(text)
        return 0
    catalog = rubric.Catalog.read(json.loads(Path(args.catalog).read_text())) if args.catalog else None
    folded, bundles = fold_documents(spark, {"bundle": json.loads(Path(args.evidence).read_text())}, None if args.any_rubric else rubric.RUBRIC_VERSION, catalog)
    r = result(folded)
    if "error" in r:
        print(r["error"], file=sys.stderr)
        return 2
    if args.command == "score":
        print(json.dumps(r, indent=1))
        return 0
    claim = args.expect if args.expect is not None else bundles.first().claim
    if claim is None:
        print("nothing to verify against", file=sys.stderr)
        return 2
    ok = abs(folded.headline.first().cai - claim) <= FO.DEFAULT.tolerance
    print(f"folded {r['cai']:.2f}, claimed {claim:.2f}: {'reproduced' if ok else 'not reproduced'}")
    return 0 if ok else 1
