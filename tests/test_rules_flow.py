"""Each rule of rules_flow over a file that breaks it and one that comes close without breaking it."""

import pytest

from assayer.plans import rubric, rules_flow
from assayer.plans import scan as S


def method(body, head="public void Run(string name)", cls="public class Worker", fields=""):
    return f"namespace N;\n{cls}\n{{\n{fields}    {head}\n    {{\n{body}\n    }}\n}}\n"


# rule: (file, breaks it, comes close)
M = {
    "code-injection": (method("_ = CSharpScript.EvaluateAsync(name);"), method("_ = CSharpScript.EvaluateAsync(Fixed);", "public void Run(int n)")),
    "ldap-injection": (method('s.Filter = $"(cn={name})";'), method('s.Filter = "(cn=admin)";')),
    "xpath-injection": (method('doc.SelectNodes("//u[@n=\'" + name + "\']");'), method('doc.SelectNodes("//u");')),
    "server-side-request-forgery": (method("await http.GetAsync(name);"), method("if (!Allowed(name)) return; await http.GetAsync(name);")),
    "regex-denial-of-service": (method("var r = new Regex(name);"), method("var r = new Regex(name, o, TimeSpan.FromSeconds(1));")),
    "sensitive-data-in-logs": (method('log.LogInformation("{E}", user.Email);'), method('log.LogInformation("{E}", Mask(user.Email));')),
    "sensitive-data-in-url": (method('var u = $"/find?e={Email}";'), method('var u = $"/find?e={Page}";')),
    "unbounded-allocation-from-untrusted-length": (method("int n = r.ReadInt32(); var b = new byte[n];"), method("int n = r.ReadInt32(); if (n > 100) return; var b = new byte[n];")),
    "insecure-cookie-flags": (method("var c = new CookieOptions { Secure = true };"), method("var c = new CookieOptions { Secure = true, HttpOnly = true, SameSite = Lax };")),
    "https-enforcement": (method("services.AddHsts(o => {});"), method("services.AddHsts(o => {}); app.UseHsts();")),
    "outbound-http-resilience": (method("services.AddHttpClient<Api>();"), method("services.AddHttpClient<Api>().AddStandardResilienceHandler();")),
    "unreachable-code": (method("if (a == b) { X(); } else if (a == b) { Y(); }"), method("if (a == b) { X(); } else if (a == c) { Y(); }")),
    "null-dereference": (method("var n = name?.Length; return name.Trim();"), method("if (name == null) return; var n = name?.Length; name.Trim();")),
    "redundant-condition-operand": (method("if (a.B && a.B) X();"), method("if (x == b && b || a && a.B) X();")),
    "index-access-outside-bounds-guard": (method("if (x.Length > 0 && x[0] == 1 || x[0] == 2) X();"), method("if (x.Length > 0 && (x[0] == 1 || x[0] == 2)) X();")),
    "contradictory-support-guard": (method("if (!(CanSeek || size > 3)) X();"), method("if (!(CanSeek || CanRead)) X();")),
    "loop-decision-on-fixed-element": (method("for (int i = 0; i < n; i++) { if (c[0].Ok) Use(c[i]); }"), method("for (int i = 0; i < n; i++) { if (c[i].Ok) Use(c[i]); }")),
    "unrestored-process-global-state": (method("Console.SetOut(a); X(); Console.SetOut(b);"), method("Console.SetOut(a); try { X(); } finally { Console.SetOut(b); }")),
    "lock-release-state-mismatch": (method("bool held = Take(); try { return true; } finally { if (held) { gate.Release(); } }"), method("bool held = Take(); try { held = false; return true; } finally { if (held) { gate.Release(); } }")),
    "unsynchronized-callback-handoff": (method("var l = new List<string>(); p.Data += (s, e) => l.Add(e.Text); return l;"), method("var l = new ConcurrentQueue<string>(); p.Data += (s, e) => l.Enqueue(e.Text);")),
    "query-with-side-effects": (method("db.SaveChanges();", "public void Handle(Q q)", "public class ListQueryHandler"), method("return db.Items;", "public void Handle(Q q)", "public class ListQueryHandler")),
    "business-logic-in-controller": (
        method("if (a) x(); if (b) y(); if (c) z(); if (d) w(); e(); f(); g(); h();", "public void Post(int n)", "public class AController"), method("return Ok(_s.Get(n));", "public void Post(int n)", "public class AController")),
    "multi-aggregate-transaction": (method("_orderRepository.Add(o); _stockRepository.Update(s);"), method("_orderRepository.Add(o); _orderRepository.Add(p);")),
    "synchronous-remote-call-in-event-handler": (method("await _http.PostAsync(u);", "public async Task Handle(PaidEvent e)"), method("await _repo.SaveAsync(u);", "public async Task Handle(PaidEvent e)")),
    "constructible-invalid-entity": (method("N = name;", "public Worker(string name)", "public class Worker : Entity"), method("Guard(name); N = name;", "public Worker(string name)", "public class Worker : Entity")),
    "repository-for-non-aggregate": ("public interface IOrderRepository\n{\n    IQueryable<Order> All();\n}\n", "public interface IOrderRepository\n{\n    Order Find(int id);\n}\n"),
    "null-forgiving-suppression": (method("a!.X(); b!.Y(); c!.Z();"), method('a!.X(); L("Hi!."); L("Go!."); L("No!."); b = !c;')),
    "suppressed-diagnostic": ("#pragma warning disable CS1\nclass A { }\n", "#pragma warning disable CS1\nclass A { }\n#pragma warning restore CS1\n"),
    "commented-out-code": ("class A\n{\n    // int x = 1;\n    // int y = 2;\n}\n", "class A\n{\n    // A note; and then\n    // more of it.\n}\n"),
    "obsolete-symbol-still-used": ("class A\n{\n    [Obsolete] public void OldWay() { X(); }\n    public void Use() { OldWay(); }\n}\n", "class B\n{\n    [Obsolete] public void OlderWay() { X(); }\n}\n"),
    "command-with-multiple-handlers": ("class A1 : ICommandHandler<PayCommand> { }\nclass A2 : ICommandHandler<PayCommand> { }\n", "class B1 : ICommandHandler<ShipCommand> { }\n"),
    "domain-event-never-handled": (method("Raise(new LostEvent());", fields="") + "public class LostEvent { }\n", method("Raise(new FoundEvent());") + "public class FoundEvent { }\nclass H : IHandler<FoundEvent> { }\n"),
    "missing-authorization": ("public class AController\n{\n    [HttpGet] public int Get() { return N(); }\n}\n", "[Authorize]\npublic class BController\n{\n    [HttpGet] public int Get() { return N(); }\n}\n"),
}
FILES = {
    "ambient-nondeterminism-in-domain": ("Shop.Domain/{}.cs", method("At = DateTime.UtcNow;"), method("At = at;")),
    "domain-depends-on-infrastructure": ("Shop.Domain/{}.cs", method("X();", "public void Run(ShopDbContext db)"), method("X();", "public void Run(IClock clock)")),
    "value-object-mutability": ("Shop.Domain/{}.cs", "public class Money\n{\n    public int A { get; set; }\n    public int B { get; set; }\n}\n", "public class Cash\n{\n    public int A { get; }\n    public int B { get; }\n}\n"),
    "focus-outline-removed": ("web/{}.css", "a:focus { outline: none; }", "a:focus { outline: none; }\na:focus-visible { box-shadow: 0 0 2px; }"),
    "ci-secret-exposure": (".github/workflows/{}.yml", "on: pull_request_target\nsteps:\n- ref: ${{ github.event.pull_request.head.sha }}\n", "on: pull_request\nsteps:\n- ref: ${{ github.event.pull_request.head.sha }}\n"),
    "overly-permissive-rbac": ("k8s/{}.yaml", "kind: ClusterRole\nrules:\n- verbs: ['*']\n", "kind: ClusterRole\nrules:\n- verbs: ['get']\n"),
    "prerelease-dependency": ("src/{0}/{0}.csproj", '<Project><ItemGroup><PackageReference Include="P" Version="1.0.0-beta.1" /></ItemGroup></Project>', '<Project><ItemGroup><PackageReference Include="P" Version="1.0.0" /></ItemGroup></Project>'),
}
CASES = {r: ("src/{}.cs", *v) for r, v in M.items()} | FILES


def found(spark, files):
    rows = S.tables.classified(spark.createDataFrame([(p, t, False) for p, t in files.items()], "path string, text string, is_binary boolean"))
    parsed = S.checkpointed(S.tables.code(rows))
    parts = S.code_findings(parsed).unionByName(S.symbol_findings(parsed)).unionByName(S.file_findings(rows))
    return {(f.rule_id, f.file) for f in parts.collect()}


@pytest.fixture(scope="module")
def findings(spark):
    name = lambda r, k: "".join(w.title() for w in r.split("-")) + k
    paths = {r: (p.format(name(r, "X")), p.format(name(r, "Y"))) for r, (p, _, _) in CASES.items()}
    files = {path: text for r, (_, bad, good) in CASES.items() for path, text in zip(paths[r], (bad, good), strict=True)}
    return paths, found(spark, files)


@pytest.mark.parametrize("rule", CASES)
def test_rule_tells_the_breach_from_the_close_call(findings, rule):
    paths, hits = findings
    bad, good = paths[rule]
    assert (rule, bad) in hits and (rule, good) not in hits


def test_guards_that_hold_for_the_whole_repository(spark):
    moving, guard = {"a.css": "b { animation: spin 2s; }"}, {"z.css": "@media (prefers-reduced-motion: reduce) { * { animation: none; } }"}
    assert ("motion-without-reduced-motion", "a.css") in found(spark, moving) and not found(spark, moving | guard)
    opened = {"A.cs": M["missing-authorization"][0]}
    policy = {"P.cs": "class P\n{\n    void Go() { o.FallbackPolicy = p; }\n}\n"}
    assert ("missing-authorization", "A.cs") in found(spark, opened) and "missing-authorization" not in {r for r, _ in found(spark, opened | policy)}


def test_rules_are_in_the_rubric():
    known = {r[0] for r in rubric.rules()}
    listed = [r[0] for rs in (rules_flow.FLOW_RULES, rules_flow.DESIGN_RULES, *rules_flow.FILE_RULES.values()) for r in rs]
    assert set(listed) <= known
