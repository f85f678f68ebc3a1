"""Findings that join facts: projects, types, tests, history, packages, clones, contracts with scripts. Each function gives findings and the counts that formulas read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import colour
from assayer.operators import clones, detectors, graph, history
from assayer.operators.common import checkpointed
from assayer.plans import evidence
from assayer.plans.rules import judged
from assayer.sources import tables

Found = tuple[list[DataFrame], dict[str, object]]

# Words that tell roles apart.
_LAYER_WORDS = r"(?i)^(Domain|Application|Infrastructure|Persistence|Api|Web|Worker|Host|Contracts|Shared|SharedKernel|Common|Tests?|Core|Messaging|Abstractions|Client|Cli|Tools?|Gateway|Ui|Server)$"
_PUBLISHED = r"(?i)\.(Contracts|Abstractions|Public|Messages|Events|Shared|SharedKernel|Common|Api|Client)$"
_SLICE = r"(?i)/(?:Features|Slices|Modules|UseCases)/([^/]+)/"
_SOURCE_DIR = r"(?i)(^|/)(src|source|libs?|apps?|services|packages|modules|tools?|samples?|examples?)(/|$)"
_KNOWN_DIR = r"(?i)^(src|source|tests?|tools?|samples?|examples?|benchmarks?|build|eng|libs?|apps?|services|packages|modules)(/|$)"
_ENTITY = r"exists(bases, b -> b rlike r'^(\w*Entity\w*|\w*AggregateRoot)\b')"
_ROOT = r"exists(bases, b -> b rlike r'AggregateRoot\b')"
_PRIMITIVE = "'Guid', 'int', 'long', 'string', 'Int32', 'Int64', 'String'"
_JSON_LIBRARY = r"(?i)Newtonsoft\.Json|System\.Text\.Json|System\.Xml"
_BROWSER = (
    "console localStorage sessionStorage navigator document window alert confirm prompt eval import Blazor history location scrollTo scroll open print fetch setTimeout clearTimeout setInterval clearInterval "
    "requestAnimationFrame getComputedStyle matchMedia crypto performance URL JSON Intl screen focus blur addEventListener removeEventListener dispatchEvent indexedDB caches Notification structuredClone"
)
_DEFINES = [
    r"(?:window|globalThis|self)\.(?:[A-Za-z_$][\w$]*\.)*([A-Za-z_$][\w$]*)\s*=", r"\bfunction\s+([A-Za-z_$][\w$]*)", r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=", r"([A-Za-z_$][\w$]*)\s*:\s*(?:async\s*)?(?:function\b|\()",
    r"(?m)^\s*(?:export\s+)?(?:async\s+)?([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*\{",
]


def owned(sources: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, project, project_name, role, is_packable) of every C# file: the project whose folder is the longest prefix of its path."""
    dirs = projects.select(F.col("path").alias("project"), F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))).alias("dir"))
    own = detectors.longest_prefix(sources.where(F.col("path").rlike(r"\.(cs|razor|cshtml|fs)$")).select("path"), dirs, "path", ["path"])
    return own.join(F.broadcast(projects.select(F.col("path").alias("project"), F.col("name").alias("project_name"), "role", "is_packable", "output_type")), "project")


def _one(df: DataFrame, **sums) -> dict[str, object]:
    return df.agg(*(F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in sums.items())).first().asDict()


def project_graph(projects: DataFrame, code: DataFrame, types: DataFrame, edges: DataFrame, own: DataFrame) -> Found:
    """Cycles, instability, main sequence, size, contexts and slices. `code`, `types` are of production files, with their project; `edges` are between files."""
    prod = projects.where("role <> 'Test'")
    refs = prod.select(F.col("path").alias("src"), F.explode("references").alias("dst")).join(projects.select(F.col("path").alias("dst"), F.col("role").alias("to")), "dst")
    inner = checkpointed(refs.where("to <> 'Test'").select("src", "dst"))
    base = projects.withColumn("line", F.lit(None).cast("int"))
    scc = checkpointed(graph.strong_components(inner)) if inner.limit(1).count() else None
    found = []
    if scc is not None:
        found.append(judged(base.join(scc.select(F.col("node").alias("path")), "path"), [("module-dependency-cycle", "true", "2", "concat(name, ' is part of a cycle of projects')")]))

    # namespaces of one adapter project that use each other; stores are plumbing and files without behaviour are contracts
    behind = types.groupBy("path").agg(F.max("methods").alias("m"))
    space = code.where("role = 'Infrastructure'").select("path", "project", F.expr("regexp_extract(replace(namespace, project_name, ''), r'^\\.?(\\w+)', 1)").alias("ns")).where("ns <> ''")
    hubs = types.where("role = 'Infrastructure'").join(space.select("path", "ns"), "path").groupBy("project", "ns").agg(F.avg(F.col("name").rlike(r"(Repository|DbContext|Store|Configuration|Migration|UnitOfWork|Queries|Mapper|Mapping)$").cast("double")).alias("h"))
    a, b = space.toDF("src", "project", "na"), space.toDF("dst", "project", "nb")
    links = edges.join(a, "src").join(b, ["dst", "project"]).where("na <> nb").join(behind.toDF("dst", "m"), "dst").where("m > 0")
    plain = hubs.where("h < 0.5").select("project", "ns")
    links = links.join(plain.toDF("project", "na"), ["project", "na"]).join(plain.toDF("project", "nb"), ["project", "nb"]).groupBy("project", "na", "nb").agg(F.min("src").alias("path"))
    both = links.alias("x").join(links.alias("y"), F.expr("x.project = y.project and x.na = y.nb and x.nb = y.na and x.na < x.nb")).select("x.path", "x.na", "x.nb", F.lit(None).cast("int").alias("line"))
    found.append(judged(both, [("module-dependency-cycle", "true", "1", "concat(na, ' and ', nb, ' use each other')")]))

    # instability, abstractness
    nodes = prod.select(F.col("path").alias("node"))
    per = types.groupBy(F.col("project").alias("node")).agg(
        F.count(F.lit(1)).alias("types"), F.avg(F.expr("cast(kind = 'interface' or array_contains(modifiers, 'abstract') as double)")).alias("abstractness"),
        F.avg(F.expr("cast(kind in ('record', 'enum', 'interface') or methods = 0 as double)")).alias("data"),
    )
    metrics = graph.instability(inner, nodes).join(per, "node", "left").fillna({"abstractness": 0.0, "types": 0, "data": 0.0})
    metrics = checkpointed(metrics.join(prod.select(F.col("path").alias("node"), "name", "role"), "node"))
    unstable = graph.unstable_dependencies(inner, metrics).join(metrics.select(F.col("node").alias("src"), "name"), "src").select(F.col("src").alias("path"), "name", "dst", F.lit(None).cast("int").alias("line"))
    found.append(judged(unstable, [("unstable-dependency", "true", "1", "concat(name, ' depends on the less stable ', dst)")]))
    off = graph.main_sequence(metrics).where(f"types >= 8 and distance > 0.7 and data < 0.8 and role in ('Infrastructure', 'Web', 'Library', 'Application') and not name rlike r'{_PUBLISHED}'")
    if metrics.count() >= 5:
        found.append(judged(off.select(F.col("node").alias("path"), "name", "distance", F.lit(None).cast("int").alias("line")), [("module-off-main-sequence", "true", "1", "concat(name, ' is ', round(distance, 2), ' off the main sequence')")]))
    size = code.groupBy("project").agg(F.sum("loc").alias("loc"), F.count_distinct("namespace").alias("spaces"), F.count(F.lit(1)).alias("files")).join(per.withColumnRenamed("node", "project"), "project", "left").fillna(0)
    large = size.select(F.col("project").alias("path"), "loc", "spaces", "types", F.lit(None).cast("int").alias("line"))
    found.append(judged(large, [("oversized-module", "types >= 120 or loc >= 15000 or types >= 60 and spaces >= 12", "if(types >= 250 or loc >= 30000, 2, 1)", "concat(types, ' types, ', loc, ' lines')")]))

    # bounded contexts: the first two of three or more parts of a name
    parts = F.split("project_name", r"\.")
    context = F.when((F.size(parts) >= 3) & ~F.get(parts, F.lit(1)).rlike(_LAYER_WORDS) & ~F.col("project_name").rlike(_PUBLISHED), F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    placed = types.withColumn("context", context).where("context is not null")
    owners = placed.where("role in ('Domain', 'Application', 'Library')").groupBy("name").agg(F.min("context").alias("owner"))
    surface = placed.where("array_contains(modifiers, 'public')").select("path", "line", F.col("name").alias("type"), "context", F.explode(F.expr("array_distinct(regexp_extract_all(concat_ws(' ', concat(bases, transform(filter(props, p -> p.modifiers like '%public%'), p -> p.type), surface)), r'[A-Za-z_]\\w*', 0))")).alias("name"))
    leaks = surface.join(owners, "name").where("owner <> context").groupBy("path", "name", "owner").agg(F.min("line").alias("line"), F.min("type").alias("type"))
    found.append(judged(leaks, [("boundary-type-leakage", "true", "1", "concat(type, ' shows ', name, ' of ', owner)")]))

    # slices: only through a reference between the projects, and not into what a slice publishes
    slices = own.select(F.col("path"), "project", "project_name", F.regexp_extract("path", _SLICE, 1).alias("slice")).where("slice <> '' and not lower(slice) in ('shared', 'common', 'core', 'infrastructure')")
    pairs = edges.join(slices.select(F.col("path").alias("src"), F.col("project").alias("p"), F.col("slice").alias("mine")), "src").join(slices.select(F.col("path").alias("dst"), F.col("project").alias("q"), F.col("slice").alias("theirs"), "project_name"), "dst")
    pairs = checkpointed(pairs.where(f"mine <> theirs and not project_name rlike r'{_PUBLISHED}'"))
    if pairs.limit(1).count():
        reach = graph.closure(inner).toDF("p", "q")
        pairs = pairs.where("p = q").unionByName(pairs.where("p <> q").join(reach, ["p", "q"], "left_semi").select(*pairs.columns))
        crossing = pairs.groupBy("src", "mine", "theirs").agg(F.min("dst").alias("dst")).withColumn("line", F.lit(None).cast("int"))
        found.append(judged(crossing, [("cross-slice-coupling", "true", "1", "concat(mine, ' reaches into ', theirs, ': ', dst)")], file="src"))
    shells = base.join(own.select(F.col("project").alias("path")).distinct(), "path", "left_anti")
    found.append(judged(shells, [("solution-structure", "true", "1", "concat(name, ' is an empty shell')")]))

    n = _one(prod, projects=F.count(F.lit(1)), **{f"{r.lower()}_projects": F.count_if(F.col("role") == r) for r in ("Domain", "Application", "Infrastructure", "Web", "Library")}, roles=F.count_distinct("role"), packable=F.count_if("is_packable"), nullable_projects=F.count_if("nullable"))
    n |= _one(projects, test_projects=F.count_if(F.col("role") == "Test"), one_prefix=F.count_distinct(F.get(F.split("name", r"\."), F.lit(0))), stray=F.count_if(~F.col("dir").rlike(_KNOWN_DIR)), apart=F.count_if((F.col("role") != "Test") & ~F.col("dir").rlike(_SOURCE_DIR)), mixed=F.count_if((F.col("role") == "Test") & ~F.col("path").rlike(r"(?i)test")))
    all_projects = n["projects"] + n["test_projects"]
    n |= {"src_apart": n.pop("apart") == 0 or all_projects == 1, "tests_apart": n.pop("mixed") == 0, "one_prefix": n["one_prefix"] <= 1 or all_projects >= 6 and n["one_prefix"] <= 2, "stray": 0 if all_projects == 1 else n["stray"]}
    n |= {"scc_nodes": scc.count() if scc is not None else 0, "shells": shells.count(), "apps": n["web_projects"] + prod.where(F.col("sdk").rlike("(?i)worker")).count()}
    n |= _one(placed, contexts=F.count_distinct("context")) | _one(slices, n_slices=F.count_distinct("slice")) | _one(size, most_files=F.max("files"))
    business = r"(?i)/(Domain|Models?|Entities|Services|Application|UseCases|Features|Policies|Rules|Core)/"
    n |= _one(code, by_role=F.sum(F.when(F.col("role").isin("Domain", "Application"), F.col("loc"))), by_folder=F.sum(F.when(F.col("path").rlike(business), F.col("loc"))))
    n["business_loc"] = n.pop("by_role") or n["by_folder"]
    return found, n


def class_relations(types: DataFrame, methods: DataFrame, packages: DataFrame) -> Found:
    """Cohesion, forwarders, the domain's references and identifiers, formats read by hand, options nobody reads."""
    found = []
    # cohesion: a method belongs with what it names, a field or another method
    words = F.expr("array_distinct(regexp_extract_all(body, r'[A-Za-z_]\\w*', 0))")
    plain = methods.where("not array_contains(modifiers, 'static') and body <> '' and not name in ('ToString', 'Equals', 'GetHashCode', 'Dispose') and name <> type").select("path", F.col("type").alias("name"), F.col("name").alias("method"), words.alias("words")).distinct()
    states = types.where("kind in ('class', 'record') and methods >= 6 and size(fields) + size(props) >= 2").select("path", "name", "line", "end_line", F.expr("concat(transform(fields, f -> f.name), transform(filter(props, p -> not p.accessors like '%body%'), p -> p.name))").alias("state"))
    named = plain.groupBy("path", "name").agg(F.collect_set("method").alias("peers")).where("size(peers) >= 6")
    uses = plain.join(states, ["path", "name"]).join(named, ["path", "name"]).select(F.struct("path", "name", "line", "end_line").alias("cls"), "method", F.explode(F.expr("array_union(array(method), array_intersect(words, concat(state, peers)))")).alias("field"))
    uses = checkpointed(uses)
    if uses.limit(1).count():
        loose = detectors.cohesion(uses).select("cls.path", "cls.name", "cls.line", "cls.end_line", "components")
        found.append(judged(loose, [("low-class-cohesion", "components >= 3", "if(components >= 4, 2, 1)", "concat(name, ' falls into ', components, ' parts')")]))

    # forwarders: one call that hands its parameters on
    only = r"^(?:\{\s*(?:return\s+)?|=>\s*)(?:await\s+)?[\w.]+?\.?(\w+)(?:<[^>]*>)?\(([\w\s,]+)\)(?:\.ConfigureAwait\(false\))?\s*;\s*\}?$"
    names = F.expr("transform(params, p -> regexp_extract(p, r'(\\w+)\\s*(=.*)?$', 1))")
    forward = methods.select("path", "line", "end_line", "type", "name", "modifiers", names.alias("given"), F.regexp_extract("body", only, 1).alias("target"), F.split(F.regexp_replace(F.regexp_extract("body", only, 2), r"\s", ""), ",").alias("args"))
    forward = checkpointed(forward.withColumn("wraps", F.expr("target <> '' and target <> name and size(array_except(args, given)) = 0 and size(array_intersect(args, given)) >= greatest(1, size(given) - 1)")))
    wrappers = forward.where("wraps")
    chains = wrappers.join(wrappers.select(F.col("name").alias("target")).distinct(), "target", "left_semi")
    found.append(judged(chains, [("call-indirection", "true", "1", "concat(type, '.', name, ' only forwards to ', target)")]))
    layers = forward.where("array_contains(modifiers, 'public')").groupBy("path", "type").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n"), F.count_if("wraps").alias("w"))
    found.append(judged(layers, [("call-indirection", "n >= 3 and 4 * w >= 3 * n", "1", "concat(type, ' passes ', w, ' of ', n, ' methods through')")]))

    # the domain: roots held by reference, raw identifiers beside typed ones, events that carry the producer's types, rules judged elsewhere
    entities = types.where(_ENTITY)
    roots = types.where(_ROOT).select(F.col("name").alias("held")).distinct()
    members = entities.select("path", "line", "name", F.explode(F.expr("concat(transform(props, p -> named_struct('type', p.type, 'name', p.name)), transform(fields, f -> named_struct('type', f.type, 'name', f.name)))")).alias("m")).select("path", "line", "name", F.col("m.name").alias("member"), F.regexp_replace("m.type", r"\?$", "").alias("held"))
    found.append(judged(members.where("held <> name").join(roots, "held", "left_semi"), [("cross-aggregate-object-reference", "true", "2", "concat(name, '.', member, ' holds ', held)")]))
    typed = types.where(r"name rlike r'\w+Id$' and kind in ('struct', 'record')").select(F.col("name").alias("id_type")).distinct()
    own_ids = members.where(rf"member rlike r'Id$' and held in ({_PRIMITIVE})").withColumn("stem", F.expr("if(member = 'Id', name, regexp_replace(member, 'Id$', ''))"))
    known = entities.select(F.col("name").alias("stem")).union(typed.select(F.regexp_replace("id_type", "Id$", ""))).distinct()
    raw = own_ids.join(known, "stem", "left_semi").join(typed.limit(1).select(F.lit(1).alias("one")), F.lit(True), "left_semi")
    found.append(judged(raw, [("primitive-entity-identifier", "true", "1", "concat(name, '.', member, ' is a raw ', held)")]))
    carried = types.where("name rlike r'IntegrationEvent$'").select("path", "line", F.col("name").alias("event"), "project", F.explode("props").alias("p")).select("path", "line", "event", "project", F.regexp_replace("p.type", r"\?$", "").alias("name"))
    domain = types.where("role = 'Domain'").select("name", F.col("project").alias("owner")).distinct()
    found.append(judged(carried.join(domain, "name").where("owner <> project"), [("integration-event-leaks-domain-type", "true", "1", "concat(event, ' carries ', name)")]))
    conditions = methods.select("path", "type", F.explode(F.expr(r"regexp_extract_all(body, r'(?:\bif|\bwhile|\breturn|=>)\s*\(?([^;{}]{8,200})', 1)")).alias("c")).where(r"c rlike r'&&|\|\||[<>]'")
    judged_on = conditions.select("path", "type", "c", F.explode(F.expr(r"array_distinct(regexp_extract_all(c, r'\b([a-z_]\w*)\.[A-Z]\w*\b(?!\s*\()', 1))")).alias("v"))
    judged_on = judged_on.select("path", "type", F.expr(r"sort_array(array_distinct(regexp_extract_all(c, concat(r'\b', v, r'\.([A-Z]\w*)\b(?!\s*\()'), 1)))").alias("props")).where("size(props) >= 2").distinct()
    shapes = entities.select(F.col("name").alias("entity"), F.expr("transform(props, p -> p.name)").alias("has"), F.explode("props.name").alias("one"))
    hits = judged_on.withColumn("one", F.col("props")[0]).join(shapes, "one").where("size(array_except(props, has)) = 0 and type <> entity")
    scattered = hits.groupBy("entity", "props").agg(F.count_distinct("type").alias("n")).where("n >= 2").select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"), "entity", F.array_join("props", ", ").alias("on"), "n")
    found.append(judged(scattered, [("scattered-domain-rule", "true", "1", "concat('a rule over ', entity, ' (', on, ') is decided in ', n, ' places')")]))

    # formats read by hand where a library for them is referenced
    libraries = packages.where(F.col("id").rlike(_JSON_LIBRARY)).select("project").distinct()
    by_hand = methods.join(libraries, "project", "left_semi")
    found.append(judged(by_hand, [("hand-rolled-structured-format-parsing", r"body rlike r'Regex(\.\w+)?\([^;]*(\"\\{1,2}s\*:|\{\\{1,2}s\*|</?\(|<\w+\[\^>)'", "1", "concat(name, ' reads a structured format by pattern')")]))
    # options: kept with a default that is spelled again elsewhere, and never read
    kept = methods.where("name = type").select("path", "line", "type", F.explode(F.expr(r"regexp_extract_all(body, r'(_\w+)\s*=\s*\w+\s*\?\?\s*[^;]+;', 1)")).alias("option"), F.col("body").alias("made"))
    kept = kept.withColumn("spelled", F.expr(r"trim(regexp_extract(made, concat(option, r'\s*=\s*\w+\s*\?\?\s*([^;]+);'), 1))"))
    whole = types.select("path", F.col("name").alias("type"), F.col("body").alias("whole"))
    inert = kept.join(whole, ["path", "type"]).where(r"size(regexp_extract_all(whole, concat(r'\b', option, r'\b'), 0)) <= 2 and length(spelled) >= 2 and size(split(whole, concat(r'\Q', spelled, r'\E'))) > 2")
    found.append(judged(inert, [("inert-configuration-option", "true", "1", "concat(type, '.', option, ' is stored and never read')")]))
    n = _one(wrappers, wrappers=F.count(F.lit(1)))
    return found, n


def test_relations(code: DataFrame, methods: DataFrame, edges: DataFrame, projects: DataFrame) -> Found:
    """Reach of the tests over files, their levels and what weakens them. `code` and `methods` are of all files, with their project; `edges` are between files."""
    tests = methods.where(r"is_test and attributes rlike r'\b(Fact|Theory|Test|TestMethod|TestCase)\b'")
    named = projects.select(F.col("path").alias("project"), F.expr(r"exists(packages, p -> p.id rlike r'(?i)playwright|selenium|puppeteer') or name rlike r'(?i)e2e|endtoend|ui\.?tests|acceptance'").alias("e2e"), F.expr(r"exists(packages, p -> p.id rlike r'(?i)Mvc\.Testing|Testcontainers|TestHost|Respawn') or name rlike r'(?i)integration|contract'").alias("integration"))
    levels = tests.join(named, "project", "left")
    skipped = F.expr(r"attributes rlike r'Skip\s*=|Ignore' and not attributes rlike r'(?i)(#\d+|https?://|issue|until|[A-Z]{2,}-\d+).{0,60}'")
    n = _one(levels, tests=F.count(F.lit(1)), e2e=F.count_if("e2e"), integration=F.count_if(F.expr("integration and not e2e")), skipped=F.count_if(skipped))
    n["unit"] = n["tests"] - n["e2e"] - n["integration"]
    bases = code.where("is_test").select(F.col("path").alias("node")).distinct()
    between = checkpointed(edges.join(code.select(F.col("path").alias("dst"), "is_test"), "dst").where("not is_test").select("src", "dst"))
    direct = between.join(bases.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("path")).distinct()
    direct = checkpointed(direct)
    reached = graph.reachable(between, direct.withColumnRenamed("path", "node")).select(F.col("node").alias("path"), F.lit(True).alias("reached")) if direct.limit(1).count() else direct.withColumn("reached", F.lit(True))
    complexity = methods.where("body <> ''").groupBy("path").agg(F.max("cyclomatic").alias("cx"), F.count(F.lit(1)).alias("m"))
    files = code.where("not is_test").select("path", "loc", "role").join(complexity, "path", "left").join(direct.withColumn("direct", F.lit(True)), "path", "left").join(reached, "path", "left").fillna({"cx": 0, "m": 0}).fillna(False, ["direct", "reached"])
    files = checkpointed(files.withColumn("logic", F.expr(r"(cx >= 3 or m >= 3 and cx >= 2) and not path rlike r'(?i)/(Contracts|Dtos?|Requests?|Responses?|Options|Settings|Migrations|Hosting|Program\.cs|Startup\.cs|Middleware)'")).withColumn("domain", F.expr(r"role in ('Domain', 'Application') or path rlike r'(?i)/(Domain|Application|Services|Rules|Policies|Features)/' and coalesce(role, '') <> 'Web'")))
    n |= _one(files, logic_files=F.count_if("logic"), reached_files=F.count_if(F.expr("logic and reached")), domain_files=F.count_if("domain"), domain_reached=F.count_if(F.expr("domain and reached")), domain_direct=F.count_if(F.expr("domain and direct")), code_files=F.count(F.lit(1)))
    found = []
    if n["tests"]:
        found.append(judged(files.where("coalesce(role, '') <> 'Web'").withColumn("line", F.lit(None).cast("int")), [("test-coverage", "logic and not direct", "if(reached, 0.5, 1)", "if(reached, 'tested only through a caller', 'no test reaches this logic')")]))
    return found, n


def history_relations(changes: DataFrame | None, files: DataFrame, edges: DataFrame, fan_in: DataFrame) -> Found:
    """Hot spots, silos, orphans and co-change of production files (path, loc, cx). Changes are (commit, author, ts, path)."""
    none = {"has_history": False, "authors": 0, "top_author": 0, "history_days": 0, "significant_loc": 0, "solo_loc": 0, "touched_loc": 0, "stale_loc": 0}
    if changes is None:
        return [], none
    changes = checkpointed(changes)
    per = changes.select("commit", "author").distinct().groupBy("author").agg(F.count(F.lit(1)).alias("n"))
    n = _one(per, authors=F.count(F.lit(1)), commits=F.sum("n"), most=F.max("n"))
    if n["commits"] < 5:
        return [], none
    n |= {"has_history": True, "top_author": n.pop("most") / n["commits"]} | _one(changes, history_days=history.days_between(F.max("ts"), F.min("ts")))
    own = checkpointed(changes.join(files.select("path"), "path", "left_semi"))
    measured = files.join(fan_in, "path", "left").fillna(0, ["fan_in"])
    located = lambda df: df.join(measured, "path").withColumn("line", F.lit(None).cast("int"))
    found = [judged(located(history.hotspots(own, files.select("path", F.col("cx").alias("complexity")))).withColumnRenamed("complexity", "c"), [("churn-complexity-hotspot", "true", "if(c >= 20, 2, 1)", "concat('changed ', churn, ' times lately, complexity ', c)")])]
    significant = measured.where("loc >= 40 and (fan_in >= 2 or cx >= 8)")
    solo = history.concentration(own).join(significant.select("path"), "path", "left_semi")
    stale = history.stale(own)
    n |= _one(significant.join(own.select("path").distinct(), "path", "left_semi"), significant_loc=F.sum("loc")) | _one(located(solo), solo_loc=F.sum("loc")) | _one(measured.join(own.select("path").distinct(), "path", "left_semi"), touched_loc=F.sum("loc")) | _one(located(stale), stale_loc=F.sum("loc"))
    if n["authors"] > 1 and n["top_author"] < 0.9:
        found.append(judged(located(solo), [("knowledge-concentration", "true", "if(loc >= 200, 2, 1)", "concat('written and changed by one contributor only, ', loc, ' lines')")]))
    if n["history_days"] >= 180:
        found.append(judged(located(stale), [("knowledge-freshness", "loc >= 40", "if(loc >= 200, 2, 1)", "'last changed long ago, by people who are silent'")]))
    folder = lambda c: F.regexp_replace(c, r"[^/]*$", "")
    pairs = history.change_coupling(own.select("commit", "path"), edges, folder=folder)
    sides = pairs.select(F.col("a").alias("path"), F.col("b").alias("other"), "support", F.lit(1.0).alias("w")).unionByName(pairs.select(F.col("b").alias("path"), F.col("a").alias("other"), "support", F.lit(0.5).alias("w")))
    found.append(judged(sides.withColumn("line", F.lit(None).cast("int")), [("change-coupling", "true", "w", "concat('changed together with ', other, ' ', support, ' times')")]))
    return found, n


def clone_relations(code: DataFrame, methods: DataFrame, born: DataFrame | None = None, size: int = 70, least_lines: int = 7) -> Found:
    """Duplicated code in production files, and predicates written out in several files. Where `born` (path, born) tells which file is older, the original isn't reported."""
    streams = code.where("size(stream) > 0").select("path", "stream", "stream_lines")
    repeated = clones.repeated_windows(streams, size, key="path", words="stream")
    found = clones.regions(repeated, size, key="path").join(streams.select("path", "stream_lines"), "path")
    found = checkpointed(found.select("path", "tokens", "start", "end", F.element_at("stream_lines", F.col("start")).alias("line"), F.element_at("stream_lines", F.col("end")).alias("end_line")).where(F.col("end_line") - F.col("line") + 1 >= least_lines))
    n = _one(streams, stream_tokens=F.sum(F.size("stream"))) | _one(found, clone_tokens=F.sum("tokens"))
    later = found
    if born is not None:
        # the oldest file that holds a window is the original, unless others were born with it
        first = repeated.join(born, "path").groupBy("path", "pos").agg(F.min("born").alias("b"))
        hashes = clones.windows(streams.select("path", "stream"), size, key="path", words="stream").join(repeated.select("path", "pos"), ["path", "pos"])
        holders = hashes.join(first, ["path", "pos"]).groupBy("h1", "h2").agg(F.min("b").alias("oldest"), F.max("b").alias("newest"))
        original = hashes.join(first, ["path", "pos"]).join(holders, ["h1", "h2"]).where("b = oldest and oldest < newest").select("path", "pos")
        starts = original.join(found, "path").where("pos between start and end").select("path", "start").distinct()
        later = found.join(starts, ["path", "start"], "left_anti")
    parts = [judged(later, [("duplicated-code", "true", "least(2, tokens / 100.0 + 0.5)", "concat(tokens, ' tokens that stand elsewhere too')")])]
    conditions = methods.where("not is_test").select("path", "line", F.explode(F.expr(r"regexp_extract_all(body, r'\b(?:if|while)\s*\(((?:[^()]|\([^()]*\))+)\)', 1)")).alias("c"))
    conditions = conditions.select("path", "line", F.trim(F.regexp_replace("c", r"\s+", " ")).alias("c")).where(r"length(c) >= 30 and c rlike r'&&|\|\|'")
    shared = clones.repeated_values(conditions, "c", "path")
    parts.append(judged(conditions.join(shared, "c"), [("duplicated-code", "true", "0.5", "concat('a predicate written out in ', places, ' files')")]).withColumn("dimension", F.lit("X10")))
    return parts, n


def dependency_relations(spark, sources: DataFrame, projects: DataFrame, advisories: DataFrame | None, cycles: DataFrame | None, as_of, licences: tuple[DataFrame, list[str]] | None) -> tuple[Found, DataFrame]:
    """Advisories, locks, ends of life and licences of packages. Returns the packages (project, id, version, direct, path) too."""
    stated = projects.select(F.col("path").alias("project"), "dir", "role", "locks", "locked_mode", F.explode("packages").alias("p")).select("project", "dir", "role", "locks", "p.id", "p.version")
    locks = sources.where(F.col("path").rlike(r"(^|/)packages\.lock\.json$")).select(F.col("path").alias("lock"), F.regexp_replace("path", r"/?packages\.lock\.json$", "").alias("dir"), F.from_json("text", "dependencies map<string, map<string, struct<type:string,resolved:string>>>").alias("j"))
    resolved = locks.select("lock", "dir", F.explode("j.dependencies")).select("lock", "dir", F.explode("value").alias("id", "d")).where("d.type <> 'Project' and d.resolved is not null").select("lock", "dir", "id", F.col("d.resolved").alias("version"), (F.col("d.type") == "Direct").alias("direct"))
    own = projects.select(F.col("path").alias("project"), "dir", "role").join(resolved, "dir").select("project", "role", F.col("lock").alias("path"), "id", "version", "direct")
    rest = stated.join(locks.select("dir").distinct(), "dir", "left_anti").where("version is not null").select("project", "role", F.col("project").alias("path"), "id", "version", F.lit(True).alias("direct"))
    packages = checkpointed(own.unionByName(rest))
    none = F.lit(None).cast("int").alias("line")
    found = []
    has = packages.select(F.lower("id").alias("id"), "version").distinct()
    n = _one(has, packages=F.count(F.lit(1))) | {"has_advisories": advisories is not None, "has_cycles": cycles is not None, "packages_seen": 0}
    if advisories is not None:
        sites = packages.groupBy(F.lower("id").alias("package"), "version").agg(F.min("path").alias("path"), F.bool_or("direct").alias("direct"))
        hit = detectors.vulnerable(sites, advisories)
        found.append(judged(hit.select("*", none), [("malicious-dependency", "rule_id = 'malicious-dependency'", "weight", "concat(package, ' ', version, ': ', advisory)"), ("vulnerable-dependency", "rule_id = 'vulnerable-dependency'", "weight", "concat(package, ' ', version, ': ', advisory)")]))
    held = stated.where("role <> 'Test'").select("project", "dir", "locks").distinct().join(locks.select("dir").distinct().withColumn("file", F.lit(True)), "dir", "left").withColumn("locked", F.coalesce("file", F.lit(False)) | F.col("locks"))
    held = checkpointed(held.select(F.col("project").alias("path"), "locked"))
    n |= _one(held, lock_projects=F.count(F.lit(1)), locked_projects=F.count_if("locked")) | {"locked_mode": projects.where("locked_mode").count() > 0}
    if n["locked_projects"]:
        found.append(judged(held.select("*", none), [("dependencies-not-locked", "not locked", "1", "'restores without a lock file while others lock theirs'")]))

    frameworks = projects.select("path", F.explode("tfms").alias("what")).select("path", none, "what", F.regexp_extract("what", r"^net(?:coreapp)?(\d+\.\d+)", 1).alias("v"))
    sdk = sources.where("path = 'global.json'").select("path", none, F.get_json_object("text", "$.sdk.version").alias("what")).select("path", "line", "what", F.concat(F.regexp_extract("what", r"^(\d+)\.", 1), F.lit(".0")).alias("v"))
    images = tables.text_lines(sources.where(F.col("path").rlike(r"(?i)(^|/)dockerfile[^/]*$"))).select("path", "line", F.regexp_extract("text", r"(?i)^\s*FROM\s+(\S*dotnet/(?:aspnet|sdk|runtime|runtime-deps):\S+)", 1).alias("what")).select("path", "line", "what", F.regexp_extract("what", r":(\d+\.\d+)", 1).alias("v"))
    platforms = checkpointed(frameworks.unionByName(sdk).unionByName(images).where(r"v rlike r'^\d+\.\d+$'"))
    n["platforms"] = platforms.count()
    if cycles is not None:
        told = cycles.select(F.when(F.col("cycle").contains("."), F.col("cycle")).otherwise(F.concat("cycle", F.lit(".0"))).alias("cycle"), "eol")
        ended = detectors.end_of_life(platforms, told, F.col("v"), as_of)
        found.append(judged(ended, [("end-of-life-platform", "true", "2", "concat(what, ' reached its end of life')")]))
    if licences is not None:
        meta, copyleft = licences
        seen = checkpointed(has.join(meta.select(F.lower("id").alias("id"), "version", "expression", "url"), ["id", "version"]))
        n["packages_seen"] = seen.count()
        ids = F.expr(r"filter(split(coalesce(expression, ''), r'\s+(?:OR|AND|WITH)\s+|[()]'), x -> x <> '')")
        bad = seen.withColumn("hit", F.arrays_overlap(ids, F.array(*map(F.lit, copyleft))) | F.col("url").rlike(r"(?i)gpl-?[23]|agpl|/gpl") & ~F.col("url").rlike("(?i)lgpl"))
        found.append(judged(bad.select(F.lit(None).cast("string").alias("path"), none, "id", "version", "expression", "hit"), [("license-policy-violation", "hit", "2", "concat(id, ' ', version, ': ', coalesce(expression, 'copyleft'))")]))
    return (found, n), packages


def script_relations(sources: DataFrame) -> Found:
    """Names that code calls in scripts and no script of the repository defines."""
    calls = tables.text_lines(sources.where(F.col("path").rlike(r"\.(cs|razor|cshtml)$") & ~F.col("is_test"))).select("path", "line", F.explode(F.expr(r"""regexp_extract_all(text, r'(?i)(?:js\w*|runtime|module|interop|reference)\.Invoke(?:Void)?(?:Async)?(?:<[^>]+>)?\(\s*\"([^\"]+)\"', 1)""")).alias("called"))
    calls = checkpointed(calls.select("path", "line", "called", F.regexp_extract("called", r"([^.]+)$", 1).alias("name"), F.regexp_extract("called", r"^([^.]+)", 1).alias("head")))
    n = {"js_calls": calls.count()}
    if not n["js_calls"]:
        return [], n
    scripts = sources.where(F.col("path").rlike(r"\.(js|mjs|ts|razor|cshtml|html)$") & ~F.col("path").rlike(r"(?i)(^|/)(libs?|vendor|node_modules|dist)/|\.min\.js$"))
    defined = scripts.select(F.explode(F.flatten(F.array(*(F.regexp_extract_all("text", F.lit(p), 1) for p in _DEFINES)))).alias("name")).distinct()
    missing = detectors.undefined(calls.where(~F.col("head").isin(*_BROWSER.split()) & ~F.col("called").rlike("^import|DotNet")), defined)
    return [judged(missing, [("js-interop-contract-mismatch", "true", "1", "concat('no script defines ', called)")])], n


def style_relations(sources: DataFrame, nodes: DataFrame) -> list[DataFrame]:
    """Colours too close to read, in rules and in style attributes; errors that no field names."""
    # inactive controls are exempt
    rules = tables.css_rules(sources.where(F.col("path").rlike(r"\.(css|razor|cshtml|html?)$") & ~F.col("is_test"))).where(~F.col("selector").rlike(r":disabled|\[disabled\]|placeholder")).select("path", "line", "body")
    styled = nodes.where("attrs['style'] is not null").select("path", "line", F.concat(F.expr("attrs['style']"), F.lit(";")).alias("body"))
    pairs = rules.unionByName(styled).select("path", "line", "body", F.regexp_extract("body", r"(?<![\w-])color\s*:\s*([^;]+)", 1).alias("fg"), F.regexp_extract("body", r"background(?:-color)?\s*:\s*([^;]+)", 1).alias("bg"))
    size, unit = F.regexp_extract("body", r"font-size\s*:\s*([\d.]+)(px|rem|em)", 1), F.regexp_extract("body", r"font-size\s*:\s*([\d.]+)(px|rem|em)", 2)
    px = F.expr("try_cast(size as double)") * F.when(F.col("unit") == "px", 1).otherwise(16)
    pairs = pairs.withColumn("size", size).withColumn("unit", unit).withColumn("large", F.coalesce((px >= 24) | (px >= 18.66) & F.col("body").rlike(r"font-weight\s*:\s*(bold|[6-9]00)"), F.lit(False)))
    ratio = colour.contrast(colour.hex_of(F.col("fg")), colour.hex_of(F.col("bg")))
    close = pairs.where("fg <> '' and bg <> ''").withColumn("ratio", ratio)
    found = [judged(close, [("visual-and-motion-safety", "ratio < if(large, 3.0, 4.5)", "1", "concat(trim(fg), ' on ', trim(bg), ' is ', round(ratio, 1), ':1')")])]
    # the element before an error in the same parent
    from pyspark.sql import Window

    order = Window.partitionBy("path", "parent_id").orderBy("node_id")
    beside = nodes.select("path", "line", "tag", "attrs", "text", F.lag("tag").over(order).alias("before"), F.lag("attrs").over(order).alias("its"))
    named = nodes.select("path", F.explode(F.split(F.concat_ws(" ", F.expr("attrs['aria-describedby']"), F.expr("attrs['aria-errormessage']")), " ")).alias("id")).where("id <> ''").distinct()
    errors = beside.where(r"tag in ('p', 'span', 'div', 'small') and attrs['class'] rlike r'(?i)\b(error|invalid|validation|field-message|help-error)' and text <> '' and coalesce(attrs['role'], '') <> 'alert'")
    errors = errors.where("before in ('input', 'select', 'textarea') and its['aria-describedby'] is null and its['aria-errormessage'] is null").withColumn("id", F.expr("attrs['id']"))
    found.append(judged(errors.join(named, ["path", "id"], "left_anti"), [("form-error-not-associated", "true", "1", "'an error that its field does not name'")]))
    return found


def rule_documents(sources: DataFrame, row: dict[str, object], violations: int) -> DataFrame:
    """Recorded architecture rules that nothing checks."""
    docs = sources.where(evidence.FLAGS["rule_docs"]).select("path", "text", F.regexp_extract("text", r"(?is)\A---\s*\n.*?^enforcement:\s*(\S+)", 1).alias("e0")).withColumn("e", F.lower(F.regexp_extract("text", r"(?im)^enforcement:\s*(\S+)", 1))).withColumn("link", F.regexp_extract("text", r"(?im)^enforcement_link:\s*(\S+)", 1))
    have = sources.select(F.col("path").alias("link"), F.lit(True).alias("there"))
    docs = docs.withColumn("link", F.regexp_replace("link", r"^[./]+", "")).join(have, "link", "left").withColumn("line", F.lit(None).cast("int"))
    free = "e = '' and " + ("false" if row["arch_tests"] else "true")
    return judged(docs, [
        ("architecture-rules-unenforced", "e in ('prose', 'review', 'manual', 'none')", "1", "concat('declares enforcement: ', e)"), ("architecture-rules-unenforced", "e in ('test', 'analyzer', 'ci') and link <> '' and there is null", "1", "'its enforcement does not exist'"),
        ("architecture-rules-unenforced", f"{free} and {violations} > 0", "1", "'a rule that the code breaks and no test holds'"),
        ("architecture-rules-unenforced", rf"{free} and {violations} = 0 and text rlike r'(?i)(never|must not|may not)\s+(take|inject|use|call|depend on)\s+(the\s+)?`?(\w*DbContext|repositor|infrastructure)'", "3", "'a rule on types that no test holds'"),
    ])
