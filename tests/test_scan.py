import json

import pytest
from pyspark.sql import functions as F

from assayer import cli
from assayer.plans import queries_markup as Q
from assayer.plans import rubric, sinks
from assayer.plans import scan as S
from assayer.sources import csharp, manifests, markup


@pytest.fixture(scope="module")
def scanned(spark):
    s = S.scan_sources(spark, Q.sample_sources(spark))
    return s, [r.asDict() for r in s.findings.collect()]


FIRES = {
    "async-void-method": "Orders.cs", "sql-injection": "Orders.cs", "rethrow-resets-stack-trace": "Orders.cs", "blocking-on-async-code": "Orders.cs", "insecure-randomness": "Orders.cs", "not-implemented-placeholder": "Orders.cs",
    "empty-catch-block": "Orders.cs", "unused-code": "Orders.cs", "technical-debt-marker": "Orders.cs", "hardcoded-credential": "Orders.cs", "publicly-mutable-entity-state": "Order.cs", "anemic-domain-model": "Order.cs",
    "event-not-named-in-past-tense": None, "flaky-test": "OrderTests.cs", "test-without-assertion": "OrderTests.cs", "mutable-image-reference": "Dockerfile", "download-without-integrity-check": "Dockerfile", "missing-image-healthcheck": "Dockerfile",
    "privileged-container": "app.yaml", "host-namespace-sharing": "app.yaml", "missing-health-probes": "app.yaml", "unpinned-ci-action": "ci.yml", "ci-workflow-injection": "ci.yml", "ci-test-gate-integrity": "ci.yml", "cleartext-transmission": "main.tf",
    "missing-text-alternative": "Index.cshtml", "form-control-without-label": "Index.cshtml", "page-structure-violation": "Index.cshtml", "non-keyboard-accessible-interaction": "Index.cshtml", "cross-site-scripting": "Index.cshtml",
    "nullable-analysis-disabled": "Shop.Web.csproj", "layer-dependency-violation": "Shop.Domain.csproj", "readme-quality": None,
}


@pytest.mark.parametrize("rule", [r for r in FIRES if r != "event-not-named-in-past-tense"])
def test_rules_fire_on_the_sample(scanned, rule):
    files = [f["file"] for f in scanned[1] if f["rule_id"] == rule]
    assert files and (FIRES[rule] is None or any(f and f.endswith(FIRES[rule]) for f in files))


def test_postures_that_score_well_are_pruned(scanned):
    scores = {r.id: r.score for r in scanned[0].measurements.collect()}
    assert scores["P1"] == 7.5 and not [f for f in scanned[1] if f["rule_id"] == "ci-build-and-test-pipeline"]
    assert scores["M1"] == 4.0 and len([f for f in scanned[1] if f["rule_id"] == "readme-quality"]) == 3


def test_formulas_of_mixed_inputs(scanned):
    """Dimensions whose formula isn't the density of their own findings, worked by hand on the sample."""
    scores = {r.id: r.score for r in scanned[0].measurements.collect()}
    # three tests: one asserts nothing, one sleeps
    assert scores["D10"] == round(10 * (1 - 2 / 3), 2) and scores["D11"] == 0.0
    # a README without a policy, a pipeline whose two items of five apply and fail
    assert scores["D37"] == 0.0 and scores["D36"] == 0.0 and scores["P2"] == 0.0
    # placeholders count for incompleteness; both projects are in one cycle
    assert scores["IC1"] == scores["GD1"] == 6.07 and scores["AX3"] == 2.0 and scores["X5"] == 5.0
    skipped = {r.id: r.reason for r in scanned[0].not_measured.collect()}
    assert skipped["D30"].startswith("no packages") and skipped["P8"] == "no database" and skipped["D15"] == "too little history" and skipped["C1"].startswith("no personal")
    assert not {"AC1", "D31"} & set(skipped) and "D34" in skipped


def test_an_empty_surface_is_not_measured(spark):
    rows = spark.createDataFrame([("notes.txt", "nothing here", False)], "path string, text string, is_binary boolean")
    s = S.scan_sources(spark, S.tables.classified(rows))
    assert {r.id for r in s.measurements.collect()} == {"M1", "M2", "D37", "P1", "P3"}


def test_rules_stay_silent_on_clean_code(spark):
    clean = {
        "src/A.cs": "namespace A;\npublic class Clock\n{\n    private readonly int _x = 1;\n    public async Task<int> ReadAsync(CancellationToken ct) { return await _s.LoadAsync(ct); }\n    public int X() { return _x; }\n}\n",
        "Dockerfile": "FROM node:20.1@sha256:abc\nUSER app\nHEALTHCHECK CMD true\n",
        "a.html": '<html lang="en"><body><h1>A</h1><h2>B</h2><img src="a" alt="A"><label for="q">Q</label><input id="q"><a href="/x">go</a></body></html>',
    }
    rows = S.tables.classified(spark.createDataFrame([(p, t, False) for p, t in clean.items()], "path string, text string, is_binary boolean"))
    found = S.scan_sources(spark, rows).findings.where("file is not null").collect()
    assert found == []


def test_every_rule_is_in_the_rubric_and_scores_hold(scanned):
    s, found = scanned
    known = {r[0]: r[1] for r in rubric.rules()}
    assert all(known[f["rule_id"]] == f["dimension"] for f in found)
    scores = s.measurements.collect()
    assert all(0 <= r.score <= 10 for r in scores) and {r.id for r in scores} | {r.id for r in s.not_measured.collect()} == {d[1] for d in rubric.dimensions()}
    assert s.folded.errors.count() == 0 and 0 < s.folded.headline.first().cai < 100


def test_documents(spark, scanned):
    s, found = scanned
    doc = json.loads(sinks.sarif(s.findings, rubric.rules_table(spark)).first().json)
    results = doc["runs"][0]["results"]
    keys = [(r.get("locations", [{}])[0].get("physicalLocation", {}).get("artifactLocation", {}).get("uri", ""), r["ruleId"]) for r in results]
    assert len(results) == len(found) and [k[0] for k in keys] == sorted(k[0] for k in keys)
    rules = doc["runs"][0]["tool"]["driver"]["rules"]
    assert all(rules[r["ruleIndex"]]["id"] == r["ruleId"] for r in results)
    again = sinks.sarif(s.findings.repartition(7), rubric.rules_table(spark)).first().json
    assert json.loads(again) == doc
    scores = json.loads(sinks.scores_json(s.measurements).first().json)
    assert scores["D1"] == 100.0 and list(scores) == sorted(scores)


def test_scan_command(spark, tmp_path, capsys):
    for p, t in Q.SAMPLE.items():
        f = tmp_path / "repo" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    (tmp_path / "repo/logo.bin").write_bytes(b"\0\1\2")
    (tmp_path / "repo/obj").mkdir()
    (tmp_path / "repo/obj/x.cs").write_text("class Skipped { }")
    assert cli.main(["scan", str(tmp_path / "repo"), "--out", str(tmp_path / "out")]) == 0
    evidence = json.loads((tmp_path / "out/evidence.json").read_text())
    assert "unpinned-ci-action" in (tmp_path / "out/findings.sarif").read_text() and (tmp_path / "out/summary.md").read_text().startswith("| id |") and "rule_id" in (tmp_path / "out/findings.tsv").read_text()
    assert {d["id"] for d in evidence["dimensions"]} >= {"D1", "D17"} and evidence["headlineScore"] > 0 and "Skipped" not in (tmp_path / "out/findings.sarif").read_text()
    assert cli.main(["verify", str(tmp_path / "out/evidence.json")]) == 0
    assert cli.main(["verify", str(tmp_path / "out/evidence.json"), "--expect", "1"]) == 1
    (tmp_path / "empty.json").write_text(json.dumps({"rubricVersion": rubric.RUBRIC_VERSION}))
    assert cli.main(["score", str(tmp_path / "empty.json")]) == 2
    assert cli.main(["mapping"]) == 0 and "god-class" in capsys.readouterr().out


def test_csharp_reader():
    types, methods = csharp.parse('class A : B, IC<int> { int _x = 1; string S => $"a{_x}b"; public int F(int a, List<int> b) { if (a > 0 || a < -5) { for (;;) { } } return a; } class In { void G() { } } }')
    assert [(t.name, t.bases) for t in types] == [("In", []), ("A", ["B", "IC<int>"])] and types[1].fields[0] == ("", "int", "_x")
    f = next(m for m in methods if m.name == "F")
    assert f.params == ["int a", "List < int > b"] and f.cyclomatic == 4 and f.cognitive == 4 and [m.type for m in methods if m.name == "G"] == ["In"]
    assert csharp.code_lines(csharp.tokens("// c\nint a;\n\n/* x\n y */ int b;\n")) == 2


def test_manifest_kernels():
    p = {"Configuration": "Release", "X": ""}
    cases = {"'$(Configuration)' == 'release'": True, "'$(Configuration)'!='Release' or '$(X)' == ''": True, "!('a'=='a') and 'b'=='b'": False, "exists('x')": False, "": True, "('a' == 'a'": False}
    assert {c: manifests.condition(c, p) for c in cases} == cases
    assert manifests.glob_pattern("src/**/*.cs") == "^src/(.*/)?[^/]*\\.cs$" and manifests.normalized("a/../b/./c") == "b/c"
    log = "\x01s1\x02A@x\x022024-01-02T03:04:05+00:00\n\n3\t1\tsrc/{old => new}/a.cs\n-\t-\tlogo.png\n"
    assert [(r["author"], r["path"], r["added"]) for r in manifests.change_log(log)] == [("a@x", "src/new/a.cs", 3), ("a@x", "logo.png", 0)]


def test_markup_kernels():
    text = "@page\n@{ var x = 1; }\n<p>@Model.Name</p>\n@* note *@\n<b>y</b>"
    bare = markup.strip_razor(text)
    assert bare.count("\n") == text.count("\n") and "@" not in bare and [e.line for e in markup.elements(bare)] == [3, 5]
    assert markup.css_rules("a { color: #fff }\n/* x */ b{ }", 4) == [("a", "color: #fff", 4), ("b", "", 5)]


def test_history_of_a_checkout(spark):
    from pathlib import Path

    rows = S.tables.git_history(spark, str(Path(__file__).resolve().parents[1]))
    assert rows.where(F.col("path") == "README.md").count() >= 0


def test_csharp_declarations():
    text = """namespace N.M;
using System.Text;
using static System.Math;
public record Bare(int P, string? Q = null);
public class A<T> : B
{
    public (int a, string b) Pair(int x) { return (x, "y"); }
    public static A<T> operator +(A<T> l, A<T> r) { return l; }
    public static implicit operator int(A<T> a) => 1;
    public T this[int i] { get { return _t[i]; } }
    public int Count { get; private set; }
    public int Sum => Count + 1;
    string S => $"{Count}";
    record Inner(int K);
    public IEnumerable<(int, int)> Pairs(List<int> xs) { yield break; }
}
"""
    types, methods = csharp.parse(text)
    assert [t.name for t in types] == ["Bare", "Inner", "A"] and [p[2] for p in types[0].props] == ["P", "Q"] and types[1].props[0][1:3] == ("int", "K")
    assert [m.name for m in methods] == ["Pair", "operator +", "operator int", "Pairs"] and methods[0].returns == "(inta,stringb)"
    assert [(p[2], p[3]) for p in types[2].props] == [("this[]", "get body"), ("Count", "get private set"), ("Sum", "get body"), ("S", "get body")]
    found = csharp.tokens(text)
    assert csharp.namespace_of(found) == "N.M" and csharp.usings_of(found) == ["System.Text", "System.Math"]


def test_conditions_that_call_or_cant_be_read():
    p = {"MSBuildProjectName": "Shop.Tests", "N": "5"}
    cases = {
        "$(MSBuildProjectName.Contains('Tests')) == 'True'": True, "'$(MSBuildProjectName.EndsWith('Tests'))' == 'true' and '$(N)' != ''": True, "$(MSBuildProjectName.Contains('Web'))": False, "true > 5": False,
        "'$(N)' == 5": True, "$(N.Foo('x')) == 'x'": False, "'a' == 'a' junk": False, "true": True,
    }
    assert {c: manifests.condition(c, p) for c in cases} == cases
    props = '<Project><PropertyGroup Condition="$(MSBuildProjectName.EndsWith(\'.Tests\'))"><IsTestProject>true</IsTestProject></PropertyGroup></Project>'
    one = manifests.project("t/Shop.Checks.Tests.csproj", "<Project><ItemGroup><PackageReference Include='P' /></ItemGroup></Project>", {"p": "1.2.3"}, props)
    assert one["role"] == "Test" and one["packages"] == [("P", "1.2.3")]


def test_razor_signs_and_control_flow():
    bare = markup.strip_razor("@if (x)\n{\n<p>a@@b.c</p>\n}\nelse\n{\n<b>y</b>\n}\n")
    assert "a@b.c" in bare and "}" not in bare and [e.tag for e in markup.elements(bare)] == ["p", "b"]
