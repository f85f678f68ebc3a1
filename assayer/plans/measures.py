"""The measured dimensions as formulas over one row of facts for each bundle.

A row holds counts and flags (see `evidence`), the loads of findings by key (columns `load_<key>`) and the passed and asked items of checklists (`ok_<id>`,
`of_<id>`). Formulas are SQL expressions over it, so any number of bundles is scored in one projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import shapes
from assayer.plans import evidence

#: Findings that a load sums up, where these aren't simply all of the dimension.
KEYS = {
    "IC1": "dimension in ('IC1', 'GD1') or rule_id = 'unreachable-code'",
    "PF3": "dimension = 'PF3' or rule_id = 'blocking-on-async-code'",
    "X5": "rule_id = 'null-forgiving-suppression'",
    "D5": "dimension in ('D5', 'AX3')",
    "D7": "dimension in ('D7', 'AX3', 'AX4')",
    "AX3": "dimension = 'AX3' and rule_id = 'module-dependency-cycle' and message like '% use each other%'",
    "S1": "dimension = 'S1' and file is not null",
    "P2": "dimension = 'P2' and file is not null",
    "AX10": "rule_id = 'business-logic-in-controller'",
    "D36": "dimension = 'D36' and rule_id <> 'build-provenance-and-signing'",
    "D29": "dimension = 'D29' and rule_id <> 'cross-site-scripting' or rule_id = 'cross-site-scripting' and not file rlike r'\\.(razor|cshtml)$'",
}


def density(key: str, size: str = "loc / 1000", k: float = 1.0) -> str:
    return f"10 * exp(-{k} * load_{key} / greatest(1, {size}))"


def share(x: str) -> str:
    return f"10 * ({x})"


def check(key: str) -> str:
    return f"if(of_{key} = 0, 10, 10 * ok_{key} / of_{key})"


_CODE = "code_files > 0"
_NO_CODE = "no production source"
_ddd = lambda formula: ("ddd > 0", "no entities, aggregates or repositories", formula)
#: dimension: (what has to be there, why it isn't measured otherwise, the score from 0 to 10[, confidence[, coverage[, advisory]]]).
FORMULAS: dict[str, tuple] = {
    **{d: (_CODE, _NO_CODE, density(d)) for d in "D1 D2 D3 R3 GD1 IC1 X1 X3 X6 X7 X9 X13 X14 X15 X16 X17 X18 X19 X20 X21 X22 X24 X25 X26 X27 X28 X29 X30 X32".split()},
    "D39": (_CODE, _NO_CODE, density("D39"), 0.7),
    "D4": ("stream_tokens > 0", "no method bodies", "10 * greatest(0, 1 - 5 * clone_tokens / stream_tokens)"),
    "X10": (_CODE, _NO_CODE, density("X10", k=0.5)),
    "D17": (_CODE, _NO_CODE, density("D17", k=0.7)),
    "X2": ("awaiting > 0", "no awaiting methods", share("with_token / awaiting")),
    "PF3": ("awaits > 0 or load_PF3 > 0", "no asynchronous code", density("PF3")),
    "X4": ("log_calls > 0", "no logger calls", share("greatest(0, 1 - n_X4 / log_calls)")),
    "X23": ("log_calls > 0", "no logger calls", density("X23")),
    "X5": ("projects > 0", "no production projects", f"nullable_projects / projects * ({density('X5', k=0.5)})"),
    "D15": ("has_history", "too little history", density("D15", "code_files / 25")),
    "D16": ("has_history and authors > 1 and top_author < 0.9", "too little history of more than one author", share("greatest(0, 1 - 2 * if(significant_loc = 0, 0, solo_loc / significant_loc))")),
    "D34": ("has_history and history_days >= 180", "too short a history", share("greatest(0, 1 - 2 * if(touched_loc = 0, 0, stale_loc / touched_loc))")),
    "D35": ("has_history", "too little history", density("D35", "code_files / 25")),
    "M1": ("true", None, f"if(readme, {check('M1')}, 0)"),
    "M2": ("true", None, check("M2")),
    **{d: (needs, why, check(d)) for d, _, _, needs, why, _ in evidence.LISTS if d in ("M3", "P4", "P10", "P11", "PF1", "AX5", "C1", "C3", "C4", "C5")},
    "D18": ("projects + test_projects > 0", "no projects", f"{check('D18')} * exp(-0.25 * shells)"),
    "AX3": ("projects > 0", "no projects", f"if(scc_nodes = 0, 10, greatest(0, 10 - 4 * scc_nodes)) * ({density('AX3', 'projects / 2')}) / 10"),
    "AX4": ("projects > 0", "no projects", density("AX4", "projects / 4")),
    "AX8": ("projects > 0", "no projects", "greatest(0, 10 - 5 * n_AX8)"),
    "D5": ("projects > 0", "no projects", density("D5", "projects / 3")),
    "D7": ("projects > 0", "no projects", density("D7", "projects / 3")),
    "D6": ("large_classes > 0", "no class large enough", density("D6")),
    "D23": ("contexts >= 2", "one bounded context", density("D23", "projects / 3")),
    "D26": ("projects > 0", "no projects", density("D26", "projects / 3")),
    "D27": ("n_methods > 0", "no methods", f"greatest(0, 10 * (1 - 3 * wrappers / n_methods)) * ({density('D27')}) / 10"),
    "AX1": ("registrations > 0", "no registrations", density("AX1", "registrations / 10")),
    "AX2": ("registrations > 0", "no registrations", density("AX2", "singletons / 5")),
    "AX6": ("interfaces > 0", "no interfaces", density("AX6", "interfaces / 10")),
    "AX7": ("n_slices >= 2", "no slices", density("AX7", "n_slices / 4")),
    "AX9": ("handlers > 0", "no query handlers", density("AX9", "handlers / 10")),
    "AX10": ("projects > 0 and loc > 0", "no production source", f"least(10, 10 * business_loc / loc / 0.45) * ({density('AX10')}) / 10"),
    "DM1": _ddd(density("DM1")),
    "DM2": ("ddd > 0 and id_props > 0", "no identifiers on entities", share("typed_ids / id_props")),
    "DM3": ("integration_events > 0", "no integration events", density("DM3", "integration_events / 5")),
    "DM4": _ddd("if(entities = 0, 10, 10 * (1 - n_DM4 / entities))"),
    "DM5": _ddd(density("DM5", "entities / 5", 0.7)),
    "DM6": ("domain_projects > 0 or load_DM6 > 0", "no domain project", density("DM6")),
    "DM7": _ddd(density("DM7", "greatest(1, repositories) / 4")),
    "DM9": _ddd(density("DM9", "entities / 5")),
    "DM10": _ddd(density("DM10")),
    "DM11": _ddd(density("DM11", "entities / 5")),
    "DM12": ("domain_projects > 0 or ddd > 0", "no domain code", density("DM12")),
    "ED1": ("event_handlers > 0", "no event handlers", share("greatest(0, 1 - n_ED1 / event_handlers)")),
    "ED2": ("commands + events > 0", "no commands or events", density("ED2", "(commands + events) / 10")),
    "ED3": ("events > 0", "no events", share("greatest(0, 1 - n_ED3 / events)")),
    "ED4": ("publishers > 0 or outbox", "nothing publishes messages", density("ED4", "publishers / 4")),
    "ES1": ("folds > 0", "no folds", share("greatest(0, 1 - n_ES1 / folds)")),
    "ES2": ("folds > 0", "no persisted events", density("ES2", "folds / 5")),
    "D29": (_CODE, _NO_CODE, density("D29", k=1.5)),
    "D30": ("packages > 0 and has_advisories", "no packages, or no advisories given", density("D30", "packages / 25")),
    "D43": ("packages > 0 and has_advisories", "no packages, or no advisories given", "if(n_D43 = 0, 10, 0)"),
    "D44": ("platforms > 0 and has_cycles", "no platform, or no cycles given", "greatest(0, 10 - 4 * n_D44)"),
    "D37": ("true", None, f"if(not policy, 0, if(policy_contact, {check('D37')}, 3))"),
    "S1": ("web or web_projects > 0", "no web application", f"{check('S1')} * ({density('S1', k=0.5)}) / 10"),
    "D32": (_CODE, _NO_CODE, density("D32", k=1.5)),
    "C2": ("auth and (controllers + endpoints_code) > 0", "no endpoints, or no authentication", "10 * if(fallback, 1, 1 - (open_controllers + open_endpoints) / (controllers + endpoints_code)) * if(fallback, 1, 0.9)"),
    "D31": ("surface > 0", "no containers or infrastructure", density("D31", "surface / 4", 0.8)),
    "D36": ("flow", "no pipeline", f"{check('D36')} * ({density('D36', 'flows / 2', 0.6)}) / 10"),
    "D40": ("workloads > 0 and egress", "reward only: no egress policy", "if(net_policies >= workloads, 10, 7)"),
    "D41": ("workloads > 0 and (seccomp_workloads > 0 or mac_workloads > 0)", "reward only: no confinement", "round(10 * (0.6 * seccomp_workloads + 0.4 * mac_workloads) / workloads, 1)"),
    "D42": ("workloads > 0 and (runtime_agent or admission or psa)", "reward only: no admission or detection", "round(10 * (if(runtime_agent, 0.5, 0) + if(admission, 0.3, 0) + if(psa_restricted, 0.2, if(psa, 0.1, 0))), 1)"),
    "R4": ("projects > 0 or code_files > 0", "no production source", "if(tests = 0, 0, 10 * if(logic_files = 0, 1, reached_files / logic_files))"),
    "D9": ("projects > 0 or code_files > 0", "no production source", f"if(tests = 0, 0, {check('D9')})"),
    "D10": ("tests > 0", "no tests", share("1 - least(1, 2 * (no_assert + skipped + swallowed + 2 * mocky) / tests)")),
    "D11": ("tests > 0", "no tests", share("1 - least(1, 3 * n_D11 / tests)")),
    "P9": ("tests > 0 and domain_files > 0", "no tests, or no domain layer", share("least(1, 0.5 * domain_reached / domain_files + 0.5 * least(1, domain_direct / domain_files / 0.6))")),
    "SC1": ("packages > 0", "no packages", "10 * if(lock_projects = 0, 1, locked_projects / lock_projects) * if(locked_flow or locked_mode, 1, 0.8)", 1.0, "1", True),
    "D12": ("packages > 0", "no packages", "10 * exp(-0.35 * n_D30 - 2 * n_D43) * exp(-0.3 * n_D12) * (0.7 + 0.3 * if(lock_projects = 0, 1, locked_projects / lock_projects))", 1.0, "0.6"),
    "D14": ("packages_seen > 0", "no package metadata given", density("D14", "1"), 1.0, "packages_seen / greatest(1, packages)"),
    "P1": ("true", None, f"if(flow, {check('P1')}, 0)"),
    "P3": ("true", None, f"if(flow, {check('P3')}, 0)"),
    "P12": ("flow", "no pipeline", density("P12", "1", 0.7)),
    "P2": ("apps > 0", "no web or worker application", f"10 * (if(log, 0.4, 0) + if(health, 0.3, 0) + if(trace, 0.15, 0) + if(correlation, 0.15, 0)) * ({density('P2', k=0.5)}) / 10"),
    "P5": ("state", "no persistent state", "10 * (if(backup, 0.4, 0) + if(restore, 0.3, 0) + if(persist, 0.15, 0) + if(retain, 0.15, 0))"),
    "P6": ("projects > 0", "no projects", "10 * (if(changelog, 1, 0) + if(version_stamp, 1, 0) + if(tags > 0 or not has_history, 1, 0) + if(changelog_shape, 1, 0) + if(changelog_covers, 2, 0)) / if(changelog, 6, 3)"),
    "P7": ("http_sites > 0", "no outbound clients", share("if(http_defaults, 1, greatest(0, 1 - n_P7 / http_sites))")),
    "P8": ("db", "no database", "if(migrations and not ensure_created and not auto_create, 10, if(migrations, 5, if(ensure_created, 2, 4)))"),
    "PF2": ("alloc > 0", "reward only: no allocation-aware code", "least(10, 6 + 4 * least(1, alloc / greatest(0.001, loc / 1000) / 6))"),
    "X8": ("js_calls > 0", "no named interop calls", "10 * greatest(0, 1 - n_X8 / js_calls) * if(js_guard, 1, 0.9)"),
    **{d: ("pages > 0", "no pages", density(d, "pages / 10")) for d in "AC1 AC2 AC3 AC4 AC5".split()},
    "AC6": ("pages + styles > 0", "no pages or styles", density("AC6", "pages / 10")),
    "AC7": ("pages > 0", "no pages", "if(axe and flow_axe, 10, if(axe, 7, if(a11y_docs, 4, 0)))"),
}


def loads(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, key, load, n) of every key: of the dimensions themselves, or of the findings that KEYS names."""
    by = by or []
    own = F.when(~F.col("dimension").isin(*KEYS), F.col("dimension"))
    keys = F.array(own, *(F.when(F.expr(f"coalesce({test}, false)"), F.lit(k)) for k, test in KEYS.items()))
    rows = findings.select(*by, "file", "weight", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"))
    return shapes.findings_load(rows, [*by, "key"])


def counts(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, key, n): findings of each dimension."""
    return findings.groupBy(*(by or []), F.col("dimension").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def names() -> set[str]:
    """The names that formulas read, beyond those of flags and counts."""
    import re

    return {w for f in FORMULAS.values() for text in (f[0], f[2], *f[4:5]) for w in re.findall(r"[A-Za-z_]\w*", text)}


def measured(row: DataFrame, keys: list[str] | None = None, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """((keys, id, score, confidence, coverage, advisory), (keys, id, reason)): what is measured, and why the rest isn't."""
    keys = keys or []
    items = []
    for d, spec in FORMULAS.items():
        if only and d not in only:
            continue
        needs, why, score, confidence, coverage, advisory = (*spec, *(1.0, "1", False)[len(spec) - 3 :])
        items.append(F.struct(
            F.lit(d).alias("id"), F.expr(f"cast(if({needs}, {score}, null) as double)").alias("score"), F.lit(float(confidence)).alias("confidence"),
            F.expr(f"cast({coverage} as double)").alias("coverage"), F.lit(advisory).alias("advisory"), F.lit(why).cast("string").alias("reason"),
        ))
    rows = row.select(*keys, F.explode(F.array(*items)).alias("x")).select(*keys, "x.*")
    scored = rows.where("score is not null").withColumn("score", shapes.score2(F.col("score"))).withColumn("coverage", shapes.even2(F.col("coverage")))
    return scored.drop("reason"), rows.where("score is null").select(*keys, "id", "reason")
