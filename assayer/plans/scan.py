"""A repository scan: facts, findings, measurements, and the fold."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions import text as T
from assayer.operators.common import checkpointed
from assayer.plans import evidence as E
from assayer.plans import fold as FO
from assayer.plans import measures as M
from assayer.plans import relations as R
from assayer.plans import rubric, rules, rules_flow, sinks
from assayer.sources import tables


def code_findings(parsed: DataFrame, methods: DataFrame | None = None, types: DataFrame | None = None, validates: bool = False) -> DataFrame:
    """Findings in production methods, types and comments, and in test methods."""
    methods = tables.exploded(parsed, "methods") if methods is None else methods
    types = tables.exploded(parsed, "types") if types is None else types
    # a method is beside a logger if its project, or without one its file, uses one
    unit = F.coalesce("project", "path") if "project" in parsed.columns else F.col("path")
    loggers = parsed.where("map_contains_key(words, 'ILogger')").select(unit.alias("__unit")).distinct().withColumn("logged", F.lit(True))
    methods = methods.withColumn("__unit", F.coalesce("project", "path") if "project" in methods.columns else F.col("path")).join(loggers, "__unit", "left").fillna(False, ["logged"])
    comments = tables.exploded(parsed, "comments").where(~F.col("is_test"))
    marked = comments.select("path", "line", "text", F.lit(None).cast("int").alias("end_line")).where(F.col("text").rlike(T.MARKERS))
    debt = rules.judged(marked, [("technical-debt-marker", "true", "0.5", "substring(text, 1, 80)")])
    size = parsed.where(~F.col("is_test")).select("path", F.lit(1).alias("line"), "loc")
    large = rules.judged(size, [("oversized-source-file", "loc > 800", "if(loc > 1500, 2, 1)", "concat(loc, ' lines of code')")])
    tests = methods.where(F.col("is_test") & F.col("attributes").rlike(r"\b(Fact|Theory|Test|TestMethod|TestCase)\b"))
    parts = [rules.judged(methods.where(~F.col("is_test")), rules.METHOD_RULES + rules_flow.FLOW_RULES), rules.judged(types.where(~F.col("is_test")), rules.TYPE_RULES + rules_flow.DESIGN_RULES), rules.judged(tests, rules.TEST_RULES), debt, large]
    if "is_packable" in parsed.columns:
        packed = parsed.where("is_packable and coalesce(output_type, '') <> 'Exe'").select("path")
        parts.append(rules.judged(methods.where(~F.col("is_test")).join(packed, "path", "left_semi"), rules.LIBRARY_RULES))
    if validates:
        parts.append(rules.judged(types.where(~F.col("is_test")), rules.REQUEST_RULES))
    return reduce(DataFrame.unionByName, parts)


def unused_members(parsed: DataFrame) -> DataFrame:
    """Private methods whose name stands once in all the code: where they are declared."""
    methods = tables.exploded(parsed, "methods").where(F.array_contains("modifiers", "private") & ~F.array_contains("modifiers", "override") & ~F.col("is_test"))
    uses = parsed.select(F.explode("words").alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n"))
    alone = methods.join(uses.where("n <= 1").select("name"), "name", "left_semi")
    return rules.judged(alone, [("unused-code", "attributes = ''", "1", "concat(name, ' is never used')")])


def file_findings(sources: DataFrame) -> DataFrame:
    """Findings on whole production files: each kind of file is judged in one projection, where it is read."""
    texts = sources.where(~F.col("is_test") & ~F.col("is_binary")).withColumn("line", F.lit(1))
    texts = texts.withColumn("bare", F.regexp_replace("text", r'"(?:[^"\\\n]|\\.)*"|//[^\n]*', ""))
    found = [rules.judged(texts.where(F.col("path").rlike(kind)), judged) for kind, judged in rules_flow.FILE_RULES.items()]
    # a stylesheet that moves needs a guard in some stylesheet
    sheets = texts.where(F.col("path").rlike(r"\.s?css$"))
    guarded = sheets.where(F.col("text").contains("prefers-reduced-motion")).select(F.lit(1).alias("one")).limit(1)
    moving = sheets.where(F.col("text").rlike(r"@keyframes|\b(animation|transition)\s*:\s*(?!none)")).join(guarded, F.lit(True), "left_anti")
    found.append(rules.judged(moving, [("motion-without-reduced-motion", "true", "1", "'moves whoever looks'")]))
    return reduce(DataFrame.unionByName, found)


def symbol_findings(parsed: DataFrame) -> DataFrame:
    """Findings that join declarations with uses: obsolete members in use, commands with several handlers, events nobody handles, open controllers.

    Uses are counted by name before they are joined; only declarations of interest meet them.
    """
    code = parsed.where(~F.col("is_test"))
    methods, types = tables.exploded(parsed, "methods").where(~F.col("is_test")), tables.exploded(parsed, "types").where(~F.col("is_test"))
    uses = code.select(F.explode("words").alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n"))
    declared = methods.groupBy("name").agg(F.count(F.lit(1)).alias("declared"))
    old = methods.where(F.col("attributes").rlike(r"\bObsolete\b")).join(declared, "name").join(uses, "name").where("n > declared")
    found = [rules.judged(old, [("obsolete-symbol-still-used", "true", "least(2, 0.5 + 0.5 * (n - declared))", "concat(name, ' is obsolete and in use')")])]

    handled = types.select("path", "line", "end_line", "name", F.explode("bases").alias("base")).withColumn("message", F.regexp_extract("base", r"(?:Handler|Consumer|Handle\w*)<(\w+)", 1)).where("message <> ''")
    commands = handled.where(F.col("message").rlike("Command$"))
    several = commands.groupBy("message").agg(F.count_distinct("name").alias("n")).where("n > 1")
    found.append(rules.judged(commands.join(several, "message"), [("command-with-multiple-handlers", "true", "1", "concat(message, ' has ', n, ' handlers')")]))

    folded = methods.where(F.col("name").rlike("^(Apply|When|On|Handle|Consume)")).select(F.explode("params").alias("p")).select(F.regexp_extract("p", r"(\w+Event)\b", 1).alias("name"))
    known = handled.select(F.col("message").alias("name")).union(folded).distinct()
    raised = methods.select(F.explode(F.regexp_extract_all("body", F.lit(r"\bnew (\w+Event)\b"), 1)).alias("name")).distinct()
    lost = types.where(F.col("name").rlike("Event$")).join(raised, "name", "left_semi").join(known, "name", "left_anti")
    found.append(rules.judged(lost, [("domain-event-never-handled", "true", "1", "concat(name, ' is raised and never handled')")]))

    fallback = code.where("map_contains_key(words, 'FallbackPolicy') or map_contains_key(words, 'RequireAuthorization')").select(F.lit(1).alias("one")).limit(1)
    opened = types.where(F.col("name").rlike("Controller$") & ~F.concat("attributes", "body").rlike("Authorize|AllowAnonymous") & F.col("body").rlike(r"\[\s*Http(Get|Post|Put|Patch|Delete)"))
    found.append(rules.judged(opened.join(fallback, F.lit(True), "left_anti"), [("missing-authorization", "true", "2", "concat(name, ' lets anyone in')")]))
    return reduce(DataFrame.unionByName, found)


def file_edges(parsed: DataFrame) -> DataFrame:
    """(src, dst): a file names a type that another file declares."""
    declared = tables.exploded(parsed, "types").select("name", F.col("path").alias("dst")).distinct()
    used = parsed.select(F.col("path").alias("src"), F.explode(F.map_keys("words")).alias("name"))
    return used.join(declared, "name").where("src <> dst").select("src", "dst").distinct()


def line_findings(sources: DataFrame) -> DataFrame:
    """Findings in the lines of container files, workflows, Terraform, Razor and code."""
    lines = tables.text_lines(sources.where(~F.col("is_binary")))
    by_file = Window.partitionBy("path").orderBy("line")
    # the innermost key at or above a line tells whether it stands in a run step
    key = F.last(F.when(F.col("text").rlike(r"^\s*(- )?[\w-]+:"), F.regexp_extract("text", r"([\w-]+):", 1)), ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, 0))
    near = F.max(F.when(F.col("text").rlike("dotnet test|npm test|pytest"), 1).otherwise(0)).over(by_file.rowsBetween(-12, 12)) == 1
    flows = lines.where(F.col("path").rlike(r"(^|/)\.github/workflows/[^/]*\.ya?ml$")).withColumn("in_run", key == "run").withColumn("near_test", near)
    scopes = {
        "docker": lines.where(F.col("path").rlike(r"(?i)(^|/)[^/]*dockerfile[^/]*$")), "workflow": flows, "terraform": lines.where(F.col("path").rlike(r"\.tf$")), "razor": lines.where(F.col("path").rlike(r"\.(razor|cshtml)$")),
        "code": lines.join(sources.where(~F.col("is_test")).select("path"), "path", "left_semi").where(F.col("path").rlike(r"\.(cs|json|config|pem|key)$")),
    }
    found = [rules.judged(rows, rules.LINE_RULES[k]) for k, rows in scopes.items()]
    docker = scopes["docker"]
    # the last stage of a container file runs; it needs a user of its own and a health check
    stage = docker.withColumn("stage", F.max(F.when(F.col("text").rlike(r"(?i)^\s*FROM\s"), F.col("line"))).over(Window.partitionBy("path")))
    last = stage.where(F.col("line") >= F.col("stage")).groupBy("path").agg(F.min("line").alias("line"), F.bool_or(F.col("text").rlike(r"(?i)^\s*USER\s+\S")).alias("user"), F.bool_or(F.col("text").rlike(r"(?i)^\s*HEALTHCHECK\s")).alias("health"))
    found.append(rules.judged(last, [("container-runs-as-root", "not user", "2", "'the last stage sets no user'"), ("missing-image-healthcheck", "not health", "1", "'the last stage has no health check'")]))
    return reduce(DataFrame.unionByName, found)


def element_findings(nodes: DataFrame) -> DataFrame:
    """Findings over rows of elements, one page at a time: labels, images inside and the heading before come from joins and windows by page."""
    level = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))
    heads = nodes.withColumn("heading", level)
    before = F.last("heading", ignorenulls=True).over(Window.partitionBy("path").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.withColumn("before", before)
    named = nodes.where("tag = 'label' and attrs['for'] is not null").select("path", F.expr("attrs['for']").alias("target")).distinct()
    labels = nodes.where("tag = 'label'").select("path", F.col("node_id").alias("anc"))
    wrapped = nodes.select("path", "node_id", F.explode("ancestors").alias("anc")).join(labels, ["path", "anc"]).select("path", "node_id").distinct().withColumn("wrapped", F.lit(True))
    images = nodes.where("tag in ('img', 'svg') and coalesce(attrs['alt'], attrs['aria-label'], '') <> ''").select("path", F.explode("ancestors").alias("node_id")).distinct().withColumn("has_image", F.lit(True))
    rows = heads.withColumn("target", F.expr("attrs['id']")).join(named.withColumn("__for", F.lit(True)), ["path", "target"], "left").join(wrapped, ["path", "node_id"], "left").join(images, ["path", "node_id"], "left")
    rows = rows.withColumn("labelled", F.coalesce("__for", F.lit(False)) | F.coalesce("wrapped", F.lit(False))).withColumn("has_image", F.coalesce("has_image", F.lit(False)))
    return rules.judged(rows, rules.ELEMENT_RULES)


def project_findings(projects: DataFrame) -> DataFrame:
    """Findings of the project graph: tests below production, layers upside down, nullable off, floating versions."""
    base = projects.withColumn("line", F.lit(None).cast("int"))
    found = rules.judged(base.where("role <> 'Test'"), [("nullable-analysis-disabled", "not nullable", "2", "concat(name, ': nullable analysis is off')")])
    edges = projects.select(F.col("path").alias("src"), "name", F.col("role").alias("a"), F.explode("references").alias("dst")).join(projects.select(F.col("path").alias("dst"), F.col("role").alias("b")), "dst")
    rank = lambda c: FO.lookup(F.col(c), {"Domain": 0, "Application": 1, "Infrastructure": 2, "Web": 3, "Exe": 3})
    e = edges.withColumn("line", F.lit(None).cast("int")).withColumn("ra", rank("a")).withColumn("rb", rank("b"))
    layers = rules.judged(e, [
        ("layer-dependency-violation", "ra < rb", "if(a = 'Domain', 2, 1)", "concat(name, ' depends on ', dst)"),
        ("production-depends-on-test-code", "a <> 'Test' and b = 'Test'", "2", "concat(name, ' depends on ', dst)"),
    ], file="src")
    return found.unionByName(layers)


#: Jobs that the driver has under way at once.
_AT_ONCE = 6


@dataclass
class Scan:
    findings: DataFrame
    measurements: DataFrame
    not_measured: DataFrame
    folded: FO.Folded
    bundle: DataFrame
    skipped: DataFrame


def scan_sources(spark: SparkSession, sources: DataFrame, quality_bar: str | None = None, changes: DataFrame | None = None, advisories: DataFrame | None = None, cycles: DataFrame | None = None, as_of: str | None = None, licences: tuple[DataFrame, list[str]] | None = None, tags: int = 0) -> Scan:
    """Everything a scan of rows (path, text, is_binary, is_test, is_generated) gives.

    With `changes` (commit, author, ts, path) history is read, with `advisories`, `cycles` (cycle, eol) as of a date, and `licences` (metadata, copyleft ids) packages are;
    what isn't given isn't measured, with the reason. Facts, findings and measurements are read several times, so each is written once as a reliable checkpoint.
    """
    # texts are small and what is done with them isn't: rows are dealt to all cores, where Spark would put small tables into one task
    wide = 2 * spark.sparkContext.defaultParallelism
    sources = checkpointed(sources.repartition(wide))
    projects = checkpointed(tables.projects(sources))
    own = checkpointed(R.owned(sources, projects))
    test_projects = projects.where("role = 'Test'").select(F.col("path").alias("project"), F.lit(True).alias("__t"))
    parsed = tables.code(sources).join(own, "path", "left").join(F.broadcast(test_projects), "project", "left")
    parsed = checkpointed(parsed.withColumn("is_test", F.col("is_test") | F.coalesce("__t", F.lit(False))).drop("__t"))
    code = parsed.where(~F.col("is_test"))
    places = parsed.select("path", "project", "project_name", "role")  # a row for each file of one repository
    methods, types = checkpointed(tables.exploded(parsed, "methods").join(F.broadcast(places), "path").repartition(wide)), tables.exploded(parsed, "types").join(F.broadcast(places), "path")
    surface = methods.where("array_contains(modifiers, 'public')").groupBy("path", F.col("type").alias("name")).agg(F.flatten(F.collect_list(F.concat(F.array("returns"), "params"))).alias("surface"))
    types = checkpointed(types.where(~F.col("is_test")).join(surface, ["path", "name"], "left").withColumn("surface", F.coalesce("surface", F.array().cast("array<string>"))).repartition(wide))
    edges = checkpointed(file_edges(parsed))
    production = edges.join(code.select(F.col("path").alias("src")), "src", "left_semi")
    nodes = checkpointed(tables.html_nodes(sources.where(F.col("path").rlike(r"\.(html?|razor|cshtml)$") & ~F.col("is_test"))))
    boxes = checkpointed(tables.containers(sources))

    complexity = methods.groupBy("path").agg(F.max("cyclomatic").alias("cx"))
    files = code.select("path", "loc").join(complexity, "path", "left").fillna(1, ["cx"])
    fan_in = production.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("fan_in"))
    born = changes.groupBy("path").agg(F.min("ts").alias("born")) if changes is not None else None
    work = boxes.where("kind in ('Deployment', 'StatefulSet', 'DaemonSet')").groupBy("path", "line").agg(F.max("seccomp").alias("s"), F.max("confined").alias("c"))
    own_methods = methods.where(~F.col("is_test"))

    def packages_and_classes():
        (found, n), packages = R.dependency_relations(spark, sources, projects, advisories, cycles, F.lit(as_of).cast("date") if as_of else F.current_date(), licences)
        more, m = R.class_relations(types, own_methods, packages)
        return found + more, n | m

    # many small jobs that don't depend on each other: the driver submits them side by side
    counts = [
        lambda: E.counted(sources.where(~F.col("is_binary")), E.FILE_COUNTS, E.FLAGS), lambda: E.counted(own_methods, E.METHOD_COUNTS), lambda: E.counted(types, E.TYPE_COUNTS), lambda: E.counted(code, {"loc": "loc"}),
        lambda: E.counted(work, {"workloads": "1", "seccomp_workloads": "if(s, 1, 0)", "mac_workloads": "if(c, 1, 0)"}),
    ]
    relations = [
        packages_and_classes, lambda: R.project_graph(projects, code, types, production, own), lambda: R.test_relations(parsed, methods, edges, projects), lambda: R.clone_relations(code, methods, born),
        lambda: R.script_relations(sources), lambda: R.history_relations(changes, files, production, fan_in),
    ]
    with ThreadPoolExecutor(_AT_ONCE) as pool:
        related, counted = [pool.submit(f) for f in relations], [pool.submit(f) for f in counts]
        values = {"tags": tags}
        for f in counted:
            values |= f.result()
        parts = [code_findings(parsed, methods, types, values["validates"]), unused_members(parsed), symbol_findings(parsed), file_findings(sources), line_findings(sources), element_findings(nodes), rules.judged(boxes, rules.CONTAINER_RULES), project_findings(projects), *R.style_relations(sources, nodes)]
        written = [pool.submit(checkpointed, x) for x in (reduce(DataFrame.unionByName, parts[:3]), reduce(DataFrame.unionByName, parts[3:]))]
        for f in related:
            found, n = f.result()
            values |= n
            written += [pool.submit(checkpointed, reduce(DataFrame.unionByName, found))] if found else []
        parts = [f.result() for f in written]
    located = checkpointed(reduce(DataFrame.unionByName, parts))

    by_rule = {r.rule_id: r.n for r in located.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = lambda names: sum(by_rule.get(x, 0) for x in names.split())
    values |= {"no_assert": total("test-without-assertion"), "swallowed": total("test-failure-swallowed"), "mocky": total("excessive-mocking"), "skipped": total("skipped-test-without-reason"), "weak_crypto": total("weak-cryptographic-algorithm weak-hash-algorithm insufficient-password-hashing improper-certificate-validation token-signature-or-expiry-not-validated")}
    values["injections"] = total("sql-injection command-injection path-traversal ldap-injection xpath-injection server-side-request-forgery regex-denial-of-service cross-site-scripting open-redirect code-injection")
    row = E.facts(spark, values)
    findings = checkpointed(located.unionByName(E.list_findings(row)).unionByName(R.rule_documents(sources, values, total("layer-dependency-violation"))))
    told = {f"{prefix}_{r.key}": r.v for prefix, df in (("load", M.loads(findings).select("key", F.col("load").alias("v"))), ("n", M.counts(findings).select("key", F.col("n").alias("v")))) for r in df.collect()}
    for r in E.list_items(row).groupBy("id").agg(F.count_if("ok").alias("ok"), F.count(F.lit(1)).alias("of")).collect():
        told |= {f"ok_{r.id}": r.ok, f"of_{r.id}": r["of"]}
    missing = {x: 0.0 for x in M.names() if x.startswith(("load_", "n_", "ok_", "of_"))}
    measured, skipped = (checkpointed(x) for x in M.measured(E.facts(spark, missing | told | values)))
    dims = rubric.dimensions_table(spark)
    kept = sinks.prune_postures(findings, measured)
    placed = measured.join(F.broadcast(dims.select("id", "lens", "category")), "id").withColumn("bundle_id", F.lit("scan"))
    bundle = row.select(F.lit("scan").alias("bundle_id"), F.lit(quality_bar).cast("string").alias("quality_bar"), F.col("projects").cast("int").alias("analyzable_projects"), F.col("loc").cast("int").alias("production_loc"))
    folded = FO.fold(bundle, placed.where("category is not null"), placed.where("category is null"))
    return Scan(kept, measured, sinks.not_measured(dims, measured, skipped), folded, bundle, skipped)


def scan(spark: SparkSession, root: str, quality_bar: str | None = None, **given) -> Scan:
    """A folder; its history is read where it is a checkout."""
    sources = tables.files(spark, root, tracked=tables.tracked_files(root))
    changes, tags = tables.git_history(spark, root), tables.git_tags(root)
    return scan_sources(spark, sources, quality_bar, changes if changes.limit(1).count() else None, tags=len(tags), **given)
