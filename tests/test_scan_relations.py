"""Rules that join facts over a repository that breaks them, and over one that comes close without breaking them."""

import json

import pytest
from pyspark.sql import functions as F

from assayer.plans import rubric, sinks
from assayer.plans import scan as S
from assayer.sources import tables


def project(*refs, sdk="Microsoft.NET.Sdk", packages="", props=""):
    links = "".join(f'<ProjectReference Include="../{r}/{r}.csproj" />' for r in refs)
    return f'<Project Sdk="{sdk}"><PropertyGroup><TargetFramework>net8.0</TargetFramework><Nullable>enable</Nullable>{props}</PropertyGroup><ItemGroup>{links}{packages}</ItemGroup></Project>'


def cls(name, body, base="", mods="public"):
    return f"{mods} class {name}{base}\n{{\n{body}\n}}\n"


def branches(n):
    return "\n".join(f"        if (x > {k}) {{ y += {k}; }}" for k in range(n))


COPY = "\n".join(f"        total{k} = Round(price{k} * rate{k}, {k}) + shipping{k}.Cost;" for k in range(9))
FIVE = "\n".join(f"    private int _{c}; public int Get{c}() {{ return _{c}; }} public void Put{c}() {{ _{c} = 1; }}" for c in "abc")
SMALL = {f"src/Acme.N{k}/Acme.N{k}.csproj": project() for k in (1, 2, 3)} | {f"src/Acme.N{k}/N{k}.cs": f"namespace Acme.N{k};\n{cls(f'Node{k}', '    public void Go() { }')}" for k in (1, 2, 3)}
BAD = SMALL | {
    "src/Acme.Sales.Domain/Acme.Sales.Domain.csproj": project(),
    "src/Acme.Sales.Domain/Order.cs": "namespace Acme.Sales;\npublic readonly record struct OrderId(Guid Value);\n"
    + cls("Order", "    public Guid Id { get; private set; }\n    public Customer Buyer { get; private set; }\n    public int Total { get; private set; }\n    public bool Paid { get; private set; }\n    public void Pay() { Paid = true; }", " : AggregateRoot")
    + cls("Customer", "    public string Name { get; private set; }\n    public void Rename(string n) { Name = n; }", " : AggregateRoot"),
    "src/Acme.Stock.Domain/Acme.Stock.Domain.csproj": project("Acme.Sales.Domain"),
    "src/Acme.Stock.Domain/Shelf.cs": "namespace Acme.Stock;\n" + cls("Shelf", "    public Order Last { get; private set; }\n    public bool Free(Order o) { return o.Total > 3 && o.Paid; }"),
    "src/Acme.Sales.Contracts/Acme.Sales.Contracts.csproj": project("Acme.Sales.Domain"),
    "src/Acme.Sales.Contracts/Events.cs": "namespace Acme.Sales.Contracts;\npublic record OrderPlacedIntegrationEvent(Order Order);\n",
    # volatile below stable: Mid is depended on by two and depends on Top, which depends on three
    "src/Acme.Mid/Acme.Mid.csproj": project("Acme.Top"), "src/Acme.Mid/Mid.cs": "namespace Acme.Mid;\n" + cls("Mid", "    public bool Due(Order o) { return o.Total > 3 && o.Paid; }"),
    "src/Acme.Top/Acme.Top.csproj": project("Acme.N1", "Acme.N2", "Acme.N3"), "src/Acme.Top/Top.cs": "namespace Acme.Top;\n" + cls("Top", "    public void Go() { }"),
    "src/Acme.U1/Acme.U1.csproj": project("Acme.Mid", "Acme.Heap"), "src/Acme.U1/U1.cs": cls("U1", "    public void Go() { }"), "src/Acme.U2/Acme.U2.csproj": project("Acme.Mid", "Acme.Heap"), "src/Acme.U2/U2.cs": cls("U2", "    public void Go() { }"),
    "src/Acme.Heap/Acme.Heap.csproj": project(), "src/Acme.Heap/Heap.cs": "".join(cls(f"Heap{k}", f"    public void Go{k}() {{ }}") for k in range(9)), "src/Acme.Empty/Acme.Empty.csproj": project(),
    # an adapter whose namespaces use each other
    "src/Acme.Infrastructure/Acme.Infrastructure.csproj": project(), "src/Acme.Infrastructure/Mail/Post.cs": "namespace Acme.Infrastructure.Mail;\n" + cls("Post", "    public void Send(Disk d) { d.Keep(this); }"),
    "src/Acme.Infrastructure/Files/Disk.cs": "namespace Acme.Infrastructure.Files;\n" + cls("Disk", "    public void Keep(Post p) { p.Send(this); }"),
    # a packed library
    "src/Acme.Kit/Acme.Kit.csproj": project(props="<PackageId>Acme.Kit</PackageId>"),
    "src/Acme.Kit/Kit.cs": "namespace Acme.Kit;\n" + cls("Kit", "    public async Task GoAsync() { await _a.RunAsync(); await _b.RunAsync(); }\n    public int Pick(int x) { if (x > 1) return 2; if (x > 5) return 3; return 1; }") + cls("Split", FIVE)
    + cls("Outer", "    private Inner _i;\n    public void Run(int a) { _i.Pass(a); }") + cls("Inner", "    private Core _c;\n    public void Pass(int a) { _c.Do(a); }"),
    "src/Acme.Kit/Big.cs": cls("Big", "    public int Big1(int x)\n    {\n        var y = 0;\n" + branches(9) + "\n" + "\n".join(f'        y += Call{k}(x + {k}, y, {k}).Value * Other{k}(x, "{k}");' for k in range(60)) + "\n        return y;\n    }"),
    "src/Acme.Web/Acme.Web.csproj": project("Acme.Sales.Domain", sdk="Microsoft.NET.Sdk.Web", packages='<PackageReference Include="Newtonsoft.Json" Version="9.0.1" /><PackageReference Include="Evil" Version="1.0.0" /><PackageReference Include="Copy" Version="2.0.0" />').replace("net8.0", "netcoreapp3.1"),
    "src/Acme.Web/Features/Cart/Cart.cs": "namespace Acme.Web.Cart;\n" + cls("CartPage", "    public void Show(BillPage b) { b.Print(); }"), "src/Acme.Web/Features/Bill/Bill.cs": "namespace Acme.Web.Bill;\n" + cls("BillPage", "    public void Print() { }"),
    "src/Acme.Web/A.cs": cls("CopyA", f"    public void Price()\n    {{\n        first();\n{COPY}\n    }}\n    public int Hot(int x)\n    {{\n        var y = 0;\n{branches(17)}\n        return y;\n    }}"),
    "src/Acme.Web/B.cs": cls("CopyB", f"    public void Cost()\n    {{\n        other();\n{COPY}\n    }}\n    public bool Both(int alpha, int beta) {{ if (alpha > beta && beta > 1000 || alpha == 77) {{ return true; }} return false; }}"),
    "src/Acme.Web/C.cs": cls("Judge", "    public bool Same(int alpha, int beta) { if (alpha > beta &&  beta > 1000 || alpha == 77) { return true; } return false; }")
    + cls("Parser", '    public string Read(string s) { return Regex.Match(s, "\\"name\\"\\\\s*:\\\\s*\\"x\\"").Value; }')
    + cls("Opts", '    private string _mode;\n    public Opts(string mode) { _mode = mode ?? "fast"; }\n    public string Mode() { return "fast"; }'),
    "src/Acme.Web/Pages/Index.razor": '<div class="x">a</div>\n<input id="q">\n<span class="error">bad</span>\n@code { async Task Go() { await JS.InvokeVoidAsync("shop.missing"); await JS.InvokeVoidAsync("shop.there"); } }\n<p style="color: #777; background: rgb(136, 136, 136)">grey</p>',
    "src/Acme.Web/wwwroot/site.js": "window.shop.there = function () { };", "src/Acme.Web/wwwroot/site.css": "a { color: hsl(0, 0%, 60%); background: white; }\nb { color: #000; background-color: white; }",
    "tests/Acme.Tests/Acme.Tests.csproj": project("Acme.Web", packages='<PackageReference Include="xunit" Version="2.0.0" />'),
    "tests/Acme.Tests/WebTests.cs": cls("WebTests", "    [Fact] public void Prices() { var a = new CopyA(); Assert.NotNull(a.Price()); }"),
    "docs/adr/0001-layers.md": "---\nenforcement: manual\n---\nWeb must not reference Infrastructure.\n", "README.md": "# Acme\n",
    "Dockerfile": "FROM mcr.microsoft.com/dotnet/aspnet:3.1\nUSER app\nHEALTHCHECK CMD true\n",
    "src/Acme.Web/Keys.cs": cls("Keys", '    string DbPassword = "hunter2hunter2";\n    string AesKey = "c2VjcmV0LWtleS0xMjM0NQ==";'),
}
EXPECTED = {
    "cross-aggregate-object-reference": "Order.cs", "primitive-entity-identifier": "Order.cs", "integration-event-leaks-domain-type": "Events.cs", "scattered-domain-rule": None, "boundary-type-leakage": "Shelf.cs",
    "unstable-dependency": "Acme.Mid.csproj", "module-off-main-sequence": "Acme.Heap.csproj", "module-dependency-cycle": "Disk.cs", "solution-structure": "Acme.Empty.csproj", "missing-configure-await": "Kit.cs", "low-class-cohesion": "Kit.cs",
    "call-indirection": "Kit.cs", "compiled-code-size": "Big.cs", "cross-slice-coupling": "Cart.cs", "duplicated-code": "B.cs", "hand-rolled-structured-format-parsing": "C.cs", "inert-configuration-option": "C.cs",
    "js-interop-contract-mismatch": "Index.razor", "form-error-not-associated": "Index.razor", "visual-and-motion-safety": "site.css", "test-coverage": "Kit.cs", "architecture-rules-unenforced": "0001-layers.md", "vulnerable-dependency": "Acme.Web.csproj",
    "malicious-dependency": "Acme.Web.csproj", "end-of-life-platform": "Dockerfile", "license-policy-violation": None, "dependencies-not-locked": None, "churn-complexity-hotspot": "A.cs", "knowledge-concentration": "Big.cs", "knowledge-freshness": "Big2.cs",
    "change-coupling": "Mid.cs", "hardcoded-password": "Keys.cs", "hardcoded-cryptographic-key": "Keys.cs", "accessibility-checks-in-ci": None, "domain-vs-controller-coverage": None, "library-api-versioning": None,
}


def changes(spark):
    day = lambda n: f"2026-{1 + n // 28 % 12:02d}-{1 + n % 28:02d}"
    rows = [(f"h{k}", "ann", day(300 + k), "src/Acme.Web/A.cs") for k in range(8)]
    rows += [(f"s{k}", "bob", day(200 + 30 * k), "src/Acme.Kit/Big.cs") for k in range(4)]
    rows += [("o1", "gone", "2024-01-01", "src/Acme.Kit/Big2.cs"), ("o2", "gone", "2024-01-09", "src/Acme.Kit/Big2.cs")]
    rows += [(f"c{k}", "cat", day(290 + k), p) for k in range(6) for p in ("src/Acme.Mid/Mid.cs", "src/Acme.Heap/Heap.cs")]
    return spark.createDataFrame(rows, "commit string, author string, ts string, path string").withColumn("ts", F.to_timestamp("ts"))


def scan(spark, files, **given):
    rows = spark.createDataFrame([(p, t, False) for p, t in files.items()], "path string, text string, is_binary boolean")
    return S.scan_sources(spark, tables.classified(rows), **given)


@pytest.fixture(scope="module")
def broken(spark):
    files = BAD | {"src/Acme.Kit/Big2.cs": BAD["src/Acme.Kit/Big.cs"].replace("Big", "Large").replace("Call", "Ask")}
    advisories = spark.createDataFrame([("A-1", "newtonsoft.json", None, "13.0.1", None, "HIGH", False), ("MAL-7", "Evil", None, None, None, None, False), ("A-2", "xunit", "3.0.0", None, None, "LOW", False)], "advisory string, package string, introduced string, fixed string, last_affected string, severity string, withdrawn boolean")
    cycles = spark.createDataFrame([("3.1", "2022-12-13"), ("8", "2026-11-10")], "cycle string, eol string").withColumn("eol", F.to_date("eol"))
    licences = (spark.createDataFrame([("Copy", "2.0.0", "MIT OR GPL-3.0-only", None), ("Newtonsoft.Json", "9.0.1", "MIT", None)], "id string, version string, expression string, url string"), ["GPL-3.0-only"])
    s = scan(spark, files, changes=changes(spark), advisories=advisories, cycles=cycles, as_of="2026-01-01", licences=licences, tags=3)
    return s, [r.asDict() for r in s.findings.collect()], {r.id: r.score for r in s.measurements.collect()}


@pytest.mark.parametrize("rule", EXPECTED)
def test_rule_fires(broken, rule):
    files = [f["file"] or "" for f in broken[1] if f["rule_id"] == rule]
    assert files and (EXPECTED[rule] is None or any(f.endswith(EXPECTED[rule]) for f in files)), files


def test_scores_of_the_broken_repository(broken):
    s, found, scores = broken
    known = {r[0]: r[1] for r in rubric.rules()}
    assert all(f["dimension"] in (known[f["rule_id"]], "X10", "C2") for f in found)
    assert scores["D43"] == 0 and scores["D44"] == 2.0 and scores["AX8"] == 10 and scores["D16"] == 0.0 and scores["SC1"] == 0.0
    assert {"D15", "D16", "D34", "D35", "D4", "X10", "D23", "AX7", "D6", "D14", "P10", "X8", "R4", "D9", "P9"} <= set(scores)
    assert s.folded.errors.count() == 0
    # a predicate is reported where it stands; a clone once for each file
    assert sorted(f["file"][-4:] for f in found if f["dimension"] == "X10") == ["B.cs", "C.cs"]
    assert {f["line"] for f in found if f["rule_id"] == "cross-aggregate-object-reference"} == {3}


GOOD = {
    "src/Acme.Sales.Domain/Acme.Sales.Domain.csproj": project(),
    "src/Acme.Sales.Domain/Order.cs": "namespace Acme.Sales;\npublic readonly record struct OrderId(Guid Value);\npublic readonly record struct CustomerId(Guid Value);\n"
    + cls("Order", "    public OrderId Id { get; private set; }\n    public CustomerId Buyer { get; private set; }\n    public int Total { get; private set; }\n    public bool Paid { get; private set; }\n    public bool Due() { return Total > 3 && Paid; }", " : AggregateRoot"),
    "src/Acme.Stock.Domain/Acme.Stock.Domain.csproj": project(), "src/Acme.Stock.Domain/Shelf.cs": "namespace Acme.Stock;\n" + cls("Shelf", "    public int Last { get; private set; }\n    private bool Free(Order o) { return o.Due(); }"),
    "src/Acme.Sales.Contracts/Acme.Sales.Contracts.csproj": project(), "src/Acme.Sales.Contracts/Events.cs": "namespace Acme.Sales.Contracts;\npublic record OrderPlacedIntegrationEvent(Guid Order);\n",
    "src/Acme.Infrastructure/Acme.Infrastructure.csproj": project(), "src/Acme.Infrastructure/Mail/Post.cs": "namespace Acme.Infrastructure.Mail;\n" + cls("Post", "    public void Send(Disk d) { d.Keep(); }"), "src/Acme.Infrastructure/Files/Disk.cs": "namespace Acme.Infrastructure.Files;\n" + cls("Disk", "    public void Keep() { }"),
    "src/Acme.Kit/Acme.Kit.csproj": project(props="<PackageId>Acme.Kit</PackageId><RestorePackagesWithLockFile>true</RestorePackagesWithLockFile>", packages='<PackageReference Include="Newtonsoft.Json" Version="13.0.1" />'),
    "src/Acme.Kit/packages.lock.json": json.dumps({"version": 1, "dependencies": {"net8.0": {"Newtonsoft.Json": {"type": "Direct", "resolved": "13.0.1"}, "Acme.Sales.Domain": {"type": "Project"}}}}),
    "src/Acme.Kit/Kit.cs": "namespace Acme.Kit;\n" + cls("Kit", "    public async Task GoAsync() { await _a.RunAsync().ConfigureAwait(false); }")
    + cls("Whole", "    private int _a; private int _b;\n" + "\n".join(f"    public int M{k}() {{ return M{k - 1}() + _a; }}" if k else "    public int M0() { return _a + _b; }" for k in range(7)))
    + cls("Outer", "    private Inner _i;\n    public void Run(int a) { Check(a); _i.Pass(a); }") + cls("Inner", "    private Core _c;\n    public void Pass(int a) { _c.Do(a); }"),
    "src/Acme.Kit/A.cs": cls("CopyA", f"    public void Price()\n    {{\n{COPY[: len(COPY) // 2]}\n    }}"), "src/Acme.Kit/B.cs": cls("CopyB", f"    public void Cost()\n    {{\n{COPY[: len(COPY) // 2]}\n    }}"),
    "src/Acme.Kit/Opts.cs": cls("Opts", '    private string _mode;\n    public Opts(string mode) { _mode = mode ?? "fast"; }\n    public string Mode() { return _mode; }'),
    "web/Index.html": '<html lang="en"><title>A</title><main><h1>A</h1><label for="q">Q</label><input id="q" aria-describedby="e"><span class="error" id="e">bad</span></main></html>', "web/site.css": "a { color: #595959; background: white; }\nh1 { color: #777; background: white; font-size: 24px; }\nb:disabled { color: #ccc; background: white; }",
    "tests/Acme.Tests/Acme.Tests.csproj": project("Acme.Kit", packages='<PackageReference Include="xunit" Version="2.0.0" />').replace("<Nullable>", "<RestorePackagesWithLockFile>true</RestorePackagesWithLockFile><Nullable>"),
    "tests/Acme.Tests/KitTests.cs": cls("KitTests", "    [Fact] public void Works() { Assert.Equal(1, new Whole().M6()); Assert.NotNull(new Order().Due()); Assert.NotNull(new Shelf()); }"),
    "docs/adr/0001-layers.md": "---\nenforcement: test\nenforcement_link: tests/Acme.Tests/KitTests.cs\n---\nWeb must not reference Infrastructure.\n", "Dockerfile": "FROM mcr.microsoft.com/dotnet/aspnet:8.0\nUSER app\nHEALTHCHECK CMD true\n",
}


def test_rules_stay_silent_on_close_calls(spark, broken):
    advisories = spark.createDataFrame([("A-1", "newtonsoft.json", None, "13.0.1", None, "HIGH", False)], "advisory string, package string, introduced string, fixed string, last_affected string, severity string, withdrawn boolean")
    cycles = spark.createDataFrame([("3.1", "2022-12-13"), ("8", "2026-11-10")], "cycle string, eol string").withColumn("eol", F.to_date("eol"))
    s = scan(spark, GOOD, advisories=advisories, cycles=cycles, as_of="2026-11-09")
    fired = {(f.rule_id, f.file) for f in s.findings.collect()}
    postures = {"library-api-versioning", "accessibility-checks-in-ci", "solution-structure"}
    assert not {x for x in fired if x[0] in set(EXPECTED) - postures}, sorted(x for x in fired if x[0] in EXPECTED)
    scores = {r.id: r.score for r in s.measurements.collect()}
    assert scores["D30"] == scores["D43"] == scores["D44"] == scores["D4"] == 10 and scores["SC1"] == 8.0 and scores["DM2"] == 10.0 and scores["R4"] == 10.0


def test_summaries(spark, broken):
    s, found, scores = broken
    lines = sinks.findings_tsv(s.findings).first().text.split("\n")
    assert len(lines) == len(found) + 1 and lines[0].startswith("rule_id\tdimension") and all(x.count("\t") == 5 for x in lines)
    table = sinks.summary(s.findings, s.measurements).first().text.split("\n")
    assert table[0] == "| id | score | findings | weight |" and len(table) == len(scores) + 2
    assert sinks.findings_tsv(s.findings.repartition(5)).first().text == "\n".join(lines)


def test_tracked_files_and_tags(tmp_path, spark):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=A@x", *a], check=True, capture_output=True)
    git("init", "-q")
    for name, text in {"a.cs": "class A { }", ".gitignore": "out.cs\n", "out.cs": "class Out { }", "new.cs": "class New { }"}.items():
        (tmp_path / name).write_text(text)
    git("add", "a.cs", ".gitignore")
    git("commit", "-qm", "one")
    git("tag", "v1.2")
    assert tables.tracked_files(str(tmp_path)) == [".gitignore", "a.cs", "new.cs"] and tables.git_tags(str(tmp_path)) == ["v1.2"] and tables.tracked_files(str(tmp_path / "..")) is None
    assert {r.path for r in tables.files(spark, str(tmp_path), tables.tracked_files(str(tmp_path))).collect()} == {".gitignore", "a.cs", "new.cs"}
    assert {(r.author, r.path) for r in tables.git_history(spark, str(tmp_path)).collect()} == {("a@x", "a.cs"), ("a@x", ".gitignore")}


def test_snapshot_readers(spark, tmp_path):
    (tmp_path / "eol.json").write_text(json.dumps({"cycles": [{"cycle": "7", "eol": "2024-05-14"}, {"cycle": "10", "eol": None}]}))
    assert {(r.cycle, str(r.eol)) for r in tables.end_of_life_cycles(spark, str(tmp_path / "eol.json")).collect()} == {("7", "2024-05-14"), ("10", "None")}
    spec = tmp_path / "copy" / "2.0.0" / "copy.nuspec"
    spec.parent.mkdir(parents=True)
    spec.write_text('<package><metadata><license type="expression">MIT</license></metadata></package>')
    assert [tuple(r) for r in tables.package_licences(spark, str(tmp_path)).collect()] == [("copy", "2.0.0", "MIT", None)]
