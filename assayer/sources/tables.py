"""Repositories as DataFrames: files, code, projects, markup, YAML, history. The kernels run in Arrow batches, one file at a time."""

from __future__ import annotations

import re
import subprocess

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.sources import csharp, manifests, markup

_TEST_PATH = r"(?i)(^|/)(tests?|specs?)/|(^|/)[^/]*\.?(unit|integration)?tests?(/|\.cs$|/[^/]*$)"
_GENERATED_PATH = r"(?i)\.(g|designer|generated)\.cs$|(^|/)(migrations|generated)/"


def files(spark: SparkSession, root: str, tracked: list[str] | None = None) -> DataFrame:
    """(path, text, is_binary, is_test, is_generated) of every file under the folder, without build and package folders; of the `tracked` ones, where these are told.

    A file with a zero byte in its first 8000 is binary and has an empty text.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.escape(re.sub(r"^[a-z]+:/+", "/", root).rstrip("/"))
    path = F.regexp_replace("path", f"^.*?{base}/", "")
    skipped = "(^|/)(" + "|".join(map(re.escape, manifests.EXCLUDED_DIRS)) + ")/"
    binary = F.instr(F.decode(F.substring("content", 1, 8000), "ISO-8859-1"), "\0") > 0
    hidden = _hidden(spark, root)
    found, path = found.select(path.alias("path"), "content").unionByName(hidden), F.col("path")
    rows = found.select(path.alias("path"), F.when(binary, "").otherwise(F.decode("content", "UTF-8")).alias("text"), binary.alias("is_binary"))
    if tracked is not None:
        rows = rows.join(spark.createDataFrame([(x,) for x in tracked], "path string"), "path", "left_semi")
    return classified(rows.where(~F.col("path").rlike(skipped)))


def _hidden(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of files that Spark's readers pass over because their name, or a folder's, begins with a dot or a low line: pipelines, settings."""
    fs, top = pafs.FileSystem.from_uri(root) if re.match(r"[a-z0-9]+:", root) else (pafs.LocalFileSystem(), root)
    base = fs.normalize_path(top).rstrip("/")
    listed, folders = [], [base]
    while folders:
        for x in fs.get_file_info(pafs.FileSelector(folders.pop())):
            if x.type == pafs.FileType.Directory and x.base_name not in manifests.EXCLUDED_DIRS:
                folders.append(x.path)
            elif x.type == pafs.FileType.File and re.search(r"(^|/)[._]", x.path[len(base) + 1 :]):
                listed.append((x.path[len(base) + 1 :],))

    def read(batches):
        own = pafs.FileSystem.from_uri(root)[0] if re.match(r"[a-z0-9]+:", root) else pafs.LocalFileSystem()
        for batch in batches:
            paths = batch.column(0).to_pylist()
            for name in paths:
                with own.open_input_file(f"{base}/{name}") as f:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f.read()], pa.binary())], names=["path", "content"])

    return spark.createDataFrame(listed, "path string").mapInArrow(read, "path string, content binary")


def classified(rows: DataFrame) -> DataFrame:
    """Adds is_test and is_generated to rows (path, text, ...)."""
    generated = F.col("path").rlike(_GENERATED_PATH) | F.contains(F.left("text", F.lit(600)), F.lit("<auto-generated"))
    return rows.withColumn("is_test", F.col("path").rlike(_TEST_PATH)).withColumn("is_generated", generated)


def _kernel(rows: DataFrame, fn, schema: str, arrow: pa.Schema) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += fn(path, text or "")
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.select("path", "text").mapInArrow(run, schema)


_TYPE = "struct<kind:string,name:string,bases:array<string>,modifiers:array<string>,line:int,end_line:int,body:string,attributes:string,methods:int,fields:array<struct<modifiers:string,type:string,name:string>>,props:array<struct<modifiers:string,type:string,name:string,accessors:string>>>"
_METHOD = "struct<type:string,name:string,modifiers:array<string>,returns:string,params:array<string>,line:int,end_line:int,body:string,attributes:string,cyclomatic:int,cognitive:int,statements:int,il:int>"
_strings = pa.list_(pa.string())
_ARROW_TYPE = pa.struct(
    [("kind", pa.string()), ("name", pa.string()), ("bases", _strings), ("modifiers", _strings), ("line", pa.int32()), ("end_line", pa.int32()), ("body", pa.string()), ("attributes", pa.string()), ("methods", pa.int32()),
     ("fields", pa.list_(pa.struct([("modifiers", pa.string()), ("type", pa.string()), ("name", pa.string())]))), ("props", pa.list_(pa.struct([("modifiers", pa.string()), ("type", pa.string()), ("name", pa.string()), ("accessors", pa.string())])))]
)
_ARROW_METHOD = pa.struct(
    [("type", pa.string()), ("name", pa.string()), ("modifiers", _strings), ("returns", pa.string()), ("params", _strings), ("line", pa.int32()), ("end_line", pa.int32()), ("body", pa.string()), ("attributes", pa.string()),
     ("cyclomatic", pa.int32()), ("cognitive", pa.int32()), ("statements", pa.int32()), ("il", pa.int32())]
)
_CODE = pa.schema([("path", pa.string()), ("loc", pa.int32()), ("types", pa.list_(_ARROW_TYPE)), ("methods", pa.list_(_ARROW_METHOD)), ("comments", pa.list_(pa.struct([("line", pa.int32()), ("text", pa.string())]))), ("words", pa.map_(pa.string(), pa.int32())), ("namespace", pa.string()), ("usings", _strings), ("stream", _strings), ("stream_lines", pa.list_(pa.int32()))])


def _code(path: str, text: str) -> list[dict]:
    found = csharp.tokens(text)
    types, methods = csharp.read(found, text)
    stream, lines = csharp.clone_stream(found, methods)
    fields = lambda t: [{"modifiers": m, "type": k, "name": n} for m, k, n in t.fields]
    props = lambda t: [{"modifiers": m, "type": k, "name": n, "accessors": a} for m, k, n, a in t.props]
    return [{
        "path": path, "loc": csharp.code_lines(found), "types": [{**vars(t), "fields": fields(t), "props": props(t)} for t in types], "methods": [{**vars(m), "il": csharp.il_weight(m.body)} for m in methods],
        "comments": [{"line": t.line, "text": t.text} for t in found if t.kind == "comment"], "words": list(csharp.uses_of(found).items()),
        "namespace": csharp.namespace_of(found), "usings": csharp.usings_of(found), "stream": stream, "stream_lines": lines,
    }]


def code(sources: DataFrame) -> DataFrame:
    """One row for each C# file: path, loc, types, methods, comments, words. Explode what a rule needs."""
    cs = sources.where(F.col("path").rlike(r"\.cs$") & ~F.col("is_generated"))
    parsed = _kernel(cs, _code, f"path string, loc int, types array<{_TYPE}>, methods array<{_METHOD}>, comments array<struct<line:int,text:string>>, words map<string,int>, namespace string, usings array<string>, stream array<string>, stream_lines array<int>", _CODE)
    return parsed.join(cs.select("path", "is_test"), "path")


def exploded(parsed: DataFrame, column: str) -> DataFrame:
    return parsed.select("path", "is_test", F.explode(column).alias("x")).select("path", "is_test", "x.*")


def projects(sources: DataFrame) -> DataFrame:
    """One row for each project file. Properties and package versions that the repository states centrally, at its root, are read before each."""
    central = sources.where(F.lower("path").isin("directory.build.props", "directory.packages.props")).select(F.lower("path").alias("path"), "text").collect()
    stated = {r.path: r.text for r in central}
    versions, props = manifests.central_versions(stated.get("directory.packages.props", "")), stated.get("directory.build.props")
    schema = "path string, name string, dir string, sdk string, tfms array<string>, output_type string, nullable boolean, is_packable boolean, version string, locks boolean, locked_mode boolean, role string, packages array<struct<id:string,version:string>>, references array<string>"
    arrow = pa.schema([("path", pa.string()), ("name", pa.string()), ("dir", pa.string()), ("sdk", pa.string()), ("tfms", _strings), ("output_type", pa.string()), ("nullable", pa.bool_()), ("is_packable", pa.bool_()), ("version", pa.string()), ("locks", pa.bool_()), ("locked_mode", pa.bool_()), ("role", pa.string()), ("packages", pa.list_(pa.struct([("id", pa.string()), ("version", pa.string())]))), ("references", _strings)])

    def read(path: str, text: str) -> list[dict]:
        p = manifests.project(path, text, versions, props)
        return [{**p, "packages": [{"id": i, "version": v} for i, v in p["packages"]]}] if p else []

    return _kernel(sources.where(F.col("path").rlike(r"\.[a-z]+proj$")), read, schema, arrow)


_ELEMENTS = pa.schema([("path", pa.string()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("line", pa.int32()), ("depth", pa.int32()), ("ancestors", pa.list_(pa.int32()))])


def html_nodes(sources: DataFrame) -> DataFrame:
    """(path, node_id, parent_id, tag, attrs, text, line, depth, ancestors) of every element; Razor is taken out first."""

    def read(path: str, text: str) -> list[dict]:
        text = markup.strip_razor(text) if path.endswith((".razor", ".cshtml")) else text
        return [{"path": path, "node_id": e.node_id, "parent_id": e.parent_id, "tag": e.tag, "attrs": list(e.attrs.items()), "text": e.text, "line": e.line, "depth": e.depth, "ancestors": e.path} for e in markup.elements(text)]

    return _kernel(sources, read, "path string, node_id int, parent_id int, tag string, attrs map<string,string>, text string, line int, depth int, ancestors array<int>", _ELEMENTS)


def css_rules(sources: DataFrame) -> DataFrame:
    """(path, selector, body, line) of style sheets and style elements."""

    def read(path: str, text: str) -> list[dict]:
        sheets = [(text, 1)] if path.endswith(".css") else markup.style_blocks(text)
        return [{"path": path, "selector": s, "body": b, "line": n} for css, first in sheets for s, b, n in markup.css_rules(css, first)]

    return _kernel(sources, read, "path string, selector string, body string, line int", pa.schema([("path", pa.string()), ("selector", pa.string()), ("body", pa.string()), ("line", pa.int32())]))


def _truth(value, default: bool | None = None) -> bool | None:
    return default if value is None else str(value).lower() == "true"


def _containers(path: str, text: str) -> list[dict]:
    out = []
    for doc, line in manifests.yaml_documents(text):
        kind = str(doc.get("kind") or "")
        spec = doc.get("spec") if isinstance(doc.get("spec"), dict) else {}
        pod = spec
        for step in ("jobTemplate", "template", "spec"):
            inner = pod.get(step) if isinstance(pod, dict) else None
            if step == "jobTemplate" and isinstance(inner, dict):
                inner = inner.get("spec")
            pod = inner if isinstance(inner, dict) else pod
        if not kind or not isinstance(pod.get("containers"), list):
            continue
        outer = pod.get("securityContext") or {}
        for c in pod["containers"]:
            if not isinstance(c, dict):
                continue
            own = c.get("securityContext") or {}
            caps = own.get("capabilities") or {}
            resources = c.get("resources") or {}
            out.append({
                "path": path, "line": line, "kind": kind, "name": str(c.get("name") or ""), "image": str(c.get("image") or ""), "has_context": bool(own or outer), "privileged": _truth(own.get("privileged"), False),
                "non_root": _truth(own.get("runAsNonRoot", outer.get("runAsNonRoot")), False), "escalation": _truth(own.get("allowPrivilegeEscalation")), "read_only": _truth(own.get("readOnlyRootFilesystem"), False),
                "seccomp": bool(own.get("seccompProfile") or outer.get("seccompProfile") or own.get("appArmorProfile")), "added": [str(x) for x in caps.get("add") or []], "dropped": [str(x) for x in caps.get("drop") or []],
                "limits": bool(resources.get("limits")), "requests": bool(resources.get("requests")), "probes": bool(c.get("livenessProbe") or c.get("readinessProbe")), "host": any(_truth(pod.get(x), False) for x in ("hostNetwork", "hostPID", "hostIPC")),
                "confined": bool(own.get("appArmorProfile") or own.get("seLinuxOptions") or outer.get("appArmorProfile") or outer.get("seLinuxOptions")), "host_path": any(isinstance(v, dict) and "hostPath" in v for v in pod.get("volumes") or []), "automount": _truth(pod.get("automountServiceAccountToken"), True), "account": str(pod.get("serviceAccountName") or ""),
            })
    return out


def containers(sources: DataFrame) -> DataFrame:
    """One row for each container of a Kubernetes workload, with what its security rules ask."""
    names = ["path", "line", "kind", "name", "image", "has_context", "privileged", "non_root", "escalation", "read_only", "seccomp", "added", "dropped", "limits", "requests", "probes", "host", "confined", "host_path", "automount", "account"]
    kinds = {"line": ("int", pa.int32()), "added": ("array<string>", _strings), "dropped": ("array<string>", _strings), **{n: ("string", pa.string()) for n in ("path", "kind", "name", "image", "account")}}
    pick = {n: kinds.get(n, ("boolean", pa.bool_())) for n in names}
    return _kernel(sources.where(F.col("path").rlike(r"\.ya?ml$")), _containers, ", ".join(f"{n} {t[0]}" for n, t in pick.items()), pa.schema([(n, t[1]) for n, t in pick.items()]))


def text_lines(sources: DataFrame) -> DataFrame:
    """(path, line, text) of every line, from 1."""
    return sources.select("path", F.posexplode(F.split("text", "\r?\n")).alias("p", "text")).select("path", (F.col("p") + 1).alias("line"), "text")


def _git(root: str, *args: str, timeout: float | None = 600) -> str | None:
    told = subprocess.run(["git", "-C", re.sub(r"^file:/+", "/", root), *args], capture_output=True, text=True, timeout=timeout, check=False)
    return told.stdout if told.returncode == 0 else None


def tracked_files(root: str) -> list[str] | None:
    """The files of a checkout that are tracked, or new and not ignored; nothing if the folder is no checkout's root."""
    top = _git(root, "rev-parse", "--show-prefix")
    if top is None or top.strip():
        return None
    listed = _git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard")
    return None if listed is None else sorted({x for x in listed.split("\0") if x})


def git_tags(root: str) -> list[str]:
    """Tags that read as versions."""
    return [t for t in (_git(root, "tag") or "").split() if re.match(r"v?\d+\.\d+", t)]


def git_history(spark: SparkSession, root: str, timeout: float | None = 600) -> DataFrame:
    """(commit, author, ts, path, added, deleted) of the checked-out history without merges; the driver runs git, once, and reads one commit at a time."""
    rows = []
    command = ["git", "-C", re.sub(r"^file:/+", "/", root), "log", "--no-merges", "--numstat", "--format=%x01%H%x02%aE%x02%aI"]
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, errors="replace") as run:
        for commit in manifests.commits(run.stdout):
            rows += [(r["sha"], r["author"], r["date"], r["path"], r["added"], r["deleted"]) for r in manifests.change_log(commit)]
        run.wait(timeout)
    rows = rows if not run.returncode else []
    return spark.createDataFrame(rows, "commit string, author string, date string, path string, added int, deleted int").select("commit", "author", F.to_timestamp("date").alias("ts"), "path", "added", "deleted")


def advisory_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(advisory, package, introduced, fixed, last_affected, severity, withdrawn) from a JSON array of advisories with nested ranges."""
    schema = "id string, severity string, withdrawn string, affected array<struct<package:string,ranges:array<struct<events:array<struct<introduced:string,fixed:string,last_affected:string>>>>,versions:array<string>>>"
    a = spark.read.schema(schema).option("multiLine", "true").json(path)
    rows = a.select("id", "severity", F.col("withdrawn").isNotNull().alias("withdrawn"), F.explode("affected").alias("f")).select("*", F.explode_outer("f.ranges").alias("r"))
    bound = lambda n: F.try_element_at(F.filter(F.transform("r.events", lambda e: e[n]), lambda x: x.isNotNull()), F.lit(1))
    ranged = rows.where("r is not null").select(F.col("id").alias("advisory"), F.col("f.package").alias("package"), F.nullif(bound("introduced"), F.lit("0")).alias("introduced"), bound("fixed").alias("fixed"), bound("last_affected").alias("last_affected"), "severity", "withdrawn")
    exact = rows.where("r is null").select("id", "f.package", F.explode("f.versions").alias("v"), "severity", "withdrawn").select(F.col("id").alias("advisory"), "package", F.col("v").alias("introduced"), F.lit(None).cast("string").alias("fixed"), F.col("v").alias("last_affected"), "severity", "withdrawn")
    return ranged.unionByName(exact)


def end_of_life_cycles(spark: SparkSession, path: str) -> DataFrame:
    """(cycle, eol) from a JSON document with a list of cycles; one without an end never ends."""
    told = spark.read.option("multiLine", "true").schema("cycles array<struct<cycle:string,eol:string>>").json(path)
    return told.select(F.explode("cycles").alias("c")).select("c.cycle", F.to_date("c.eol").alias("eol"))


def package_licences(spark: SparkSession, folder: str) -> DataFrame:
    """(id, version, expression, url) of the package descriptions in a cache of packages (id/version/id.nuspec)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.nuspec").load(folder).select("path", F.decode("content", "UTF-8").alias("text"))
    part = lambda k: F.element_at(F.split("path", "/"), k)
    pick = lambda p: F.nullif(F.trim(F.regexp_extract("text", p, 1)), F.lit(""))
    return found.select(part(-3).alias("id"), part(-2).alias("version"), pick(r'<license[^>]*type="expression"[^>]*>([^<]+)</license>').alias("expression"), pick(r"<licenseUrl>([^<]+)</licenseUrl>").alias("url"))
