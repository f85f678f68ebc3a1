"""What a repository shows as a whole: flags over its files, counts over its code, and the checklists read from them.

All flags come from one pass over the files, all counts of a scope from one pass over its rows; both are a row each. A checklist is judged on that row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What counts as evidence. Paths first, then what is looked for in the text.

_README = r"(path rlike r'(?i)^readme(\.md|\.rst|\.txt)?$')"
_PROD = r"(path like '%.cs' and not is_test)"
_TEST = r"(path like '%.cs' and is_test)"
_FLOW = r"(path rlike r'^\.github/workflows/[^/]+\.ya?ml$|^\.gitlab-ci\.ya?ml$|^azure-pipelines[^/]*\.ya?ml$|^\.circleci/config\.ya?ml$|^Jenkinsfile$')"
_YAML = r"(path rlike r'\.ya?ml$')"
_K8S = rf"({_YAML} and not path like '.github/%' and text rlike r'(?m)^kind:\s*(Deployment|StatefulSet|DaemonSet|Rollout|CronJob|Job|Service|Ingress)')"
_INFRA = r"(path rlike r'\.(ya?ml|tf|bicep|sh|ps1)$')"
_DOCS = r"(path rlike r'(?i)\.(md|rst|adoc|txt)$' and path rlike r'(?i)^(readme|runbook|operations|disaster|accessibility|a11y)[^/]*$|^(docs?|runbooks?|ops|wiki|adrs?|decisions|architecture)/')"
_POLICY = r"(path rlike r'(?i)^(\.github/)?security\.md$|(^|/)security\.txt$')"
_LOG = r"(path rlike r'(?i)^(changelog|changes|history|releases)(\.md|\.txt|\.rst)?$')"
_PROJ = r"(path rlike r'\.(csproj|props)$')"
_PERSON = r"(email|phone|ssn|passport|dateOfBirth|birthDate|firstName|lastName|fullName|surname|street|postalCode|zipCode|iban|creditCard|cardNumber|salary|diagnosis|religion|ethnicity|gender)"


def _has(where: str, pattern: str) -> str:
    return f"{where} and text rlike r'{pattern}'"


FLAGS = {
    "readme": _README, "readme_long": f"{_README} and length(text) >= 400", "readme_install": _has(_README, r"(?i)install|getting started|build"), "readme_usage": _has(_README, r"(?i)usage|example|run"), "readme_code": f"{_README} and text like '%```%'",
    "licensed": _has(_README, "(?i)licen[cs]e") + " or path rlike r'(?i)^licen[cs]e'", "architecture_doc": r"path rlike r'(?i)architecture[^/]*\.md$|(^|/)docs?/.*\.md$' and text rlike '(?i)architecture'", "decisions": r"path rlike r'(?i)(^|/)adrs?/|decisions/'",
    "diagram": r"path rlike r'(?i)\.(puml|mmd)$' or path like '%.md' and text rlike '(?i)mermaid|plantuml|c4'", "contributing": r"path rlike r'(?i)(^|/)contributing\.md$'",
    "solution_file": r"path rlike r'\.slnx?$'", "build_props": "path = 'Directory.Build.props'", "editorconfig": "path = '.editorconfig'",
    # pipelines
    "flow": _FLOW, "flow_builds": _has(_FLOW, r"dotnet\s+(build|publish|pack|test)|msbuild|nuke|cake"), "flow_tests": _has(_FLOW, r"dotnet\s+test|vstest"),
    "flow_pr": _has(_FLOW, r"pull_request|merge_request|pr:"), "flow_push": _has(_FLOW, r"(?m)^\s*push\s*:|on:\s*\[?\s*push|trigger:|branches:"),
    "sast": _has(_FLOW, r"codeql|semgrep|sonar|snyk|checkmarx|veracode|trivy|grype"), "update_bot": r"path rlike r'^\.github/dependabot\.ya?ml$|(^|/)(renovate\.json5?|\.renovaterc(\.json)?)$'",
    "audit": _has(_FLOW, r"package\s+--vulnerable|NuGetAudit|osv-scanner|dependency-review-action|audit"), "secret_scan": _has(_FLOW, r"gitleaks|trufflehog|detect-secrets|git-secrets"),
    "locked_flow": _has(_FLOW, r"--locked-mode|RestoreLockedMode"),
    "releases": _has(_FLOW, r"(?m)^\s*tags:|^\s*release:\s*$|dotnet\s+nuget\s+push|docker\s+push|docker/build-push-action|push:\s*true|ghcr\.io/|action-gh-release|helm\s+push"),
    "provenance": _has(_FLOW, r"attest-build-provenance|slsa|provenance:\s*true|in-toto"), "sbom": _has(_FLOW, r"(?i)sbom|cyclonedx|spdx|syft"), "signing": _has(_FLOW, r"(?i)cosign|sigstore|notation\s+sign|nuget\s+sign|signtool|attest"),
    "deploys": _has(_FLOW, r"(?i)deploy|kubectl|helm\s|argocd|az\s+webapp|environment:"), "deploy_steps": _has(_FLOW, r"(?i)canary|slot|blue|green|rollout"), "deploy_gate": _has(_FLOW, r"(?im)^\s*environment:\s*\S+|approval|when:\s*manual|reviewers"),
    # observability, state, resilience
    "log": _has(_PROD, r"ILogger<|LoggerMessage|Serilog|NLog|LogInformation\("), "trace": _has(_PROD, r"OpenTelemetry|ActivitySource|new Meter\(|ApplicationInsights|Prometheus"),
    "health": _has(_PROD, r"AddHealthChecks|MapHealthChecks|IHealthCheck|/health|healthz"), "correlation": _has(_PROD, r"TraceIdentifier|CorrelationId|UseHttpLogging|UseSerilogRequestLogging|Activity\.Current|traceparent"),
    "state": _has(_PROD, r"DbContext|IDocumentStore|NpgsqlConnection|SqlConnection|MongoClient|BlobServiceClient|AmazonS3") + " or " + _has(_K8S, r"PersistentVolumeClaim|StatefulSet"),
    "backup": _has(_INFRA, r"(?i)pg_dump|mysqldump|backup|snapshot|velero|pitr") + " or " + _has(_DOCS, r"(?i)(daily|nightly|hourly|automated|scheduled)\s+(backup|snapshot)|point.in.time"),
    "restore": _has(_DOCS, r"(?i)\bRTO\b|\bRPO\b|disaster recovery|restor(e|ing)"), "persist": _has(_INFRA, r"(?i)PersistentVolumeClaim|StatefulSet|aws_db_instance|google_sql|storageClassName|(?m)^volumes:\s*$"),
    "retain": _has(_INFRA, r"(?i)deletion_protection|retention|reclaimPolicy:\s*Retain|prevent_destroy"),
    "k8s": _K8S, "probes": _has(_K8S, r"(?s)readinessProbe.*livenessProbe|livenessProbe.*readinessProbe"), "rolling": _has(_K8S, r"RollingUpdate|maxUnavailable|maxSurge|canary"), "unpinned": _has(_K8S, r"(?m)image:\s*\S+:latest|image:\s*[^:\s@]+\s*$"),
    "compose": r"path rlike r'(^|/)(docker-)?compose[^/]*\.ya?ml$'", "compose_health": r"path rlike r'(^|/)(docker-)?compose[^/]*\.ya?ml$' and text like '%healthcheck:%'", "terraform": r"path rlike r'\.(tf|bicep)$'", "helm": r"path rlike r'(^|/)Chart\.yaml$'",
    "http_defaults": _has(_PROD, r"ConfigureHttpClientDefaults\([^;]*Resilience|AddServiceDefaults\(\)"),
    # schema
    "db": _has(_PROD, r":\s*(Identity)?DbContext\b") + r" or path like '%.csproj' and text rlike r'EntityFrameworkCore|Dapper|Npgsql|DbUp|FluentMigrator|Marten'",
    "migrations": r"path rlike r'(?i)/migrations/.*\.cs$' and text rlike r'\[Migration\(|: Migration\b|MigrationBuilder' or path rlike r'(?i)/(migrations|db/migrate)/.*\.sql$' or path like '%.csproj' and text rlike r'DbUp|FluentMigrator|Evolve' or " + _has(_PROD, r"\.Migrate(Async)?\(\)|MigrationsAssembly"),
    "ensure_created": _has(_PROD, r"EnsureCreated(Async)?\("), "auto_create": _has(_PROD, r"AutoCreate\.(All|CreateOrUpdate)"),
    # releases
    "changelog": _LOG, "changelog_shape": _has(_LOG, r"(?m)^##\s*\[?(Unreleased|\d+\.\d+)"), "changelog_covers": _has(_LOG, r"(?s)##\s*\[?v?\d+\.\d+.*##\s*\[?v?\d+\.\d+"),
    "version_stamp": _has(_PROJ, r"<(Version|VersionPrefix)>|MinVer|GitVersion") + r" or path in ('version.json', 'GitVersion.yml')", "api_baseline": r"path like '%PublicAPI.Shipped.txt' or path like '%.csproj' and text like '%PublicApiAnalyzers%'",
    "api_docs": _has(_PROJ, r"<GenerateDocumentationFile>true"),
    "bdd": r"path like '%.csproj' and text rlike r'SpecFlow|Reqnroll|LightBDD|TickSpec'", "features": "path like '%.feature'", "steps": _has(_TEST, r"\[(Given|When|Then|StepDefinition)\("), "scenarios": r"path like '%.feature' and text rlike r'(?s)Scenario.*Given.*Then'",
    # performance and accessibility practice
    "bench": r"path like '%.csproj' and text like '%BenchmarkDotNet%'", "bench_memory": r"path like '%.cs' and text like '%MemoryDiagnoser%'", "bench_base": r"path like '%.cs' and text rlike r'Baseline\s*=\s*true'", "flow_bench": _has(_FLOW, r"(?i)benchmark"),
    "axe": _has(_TEST, r"AxeCore|RunAxe|axe\.|Accessibility(Checker|Assert|Scan)|Pa11y|Lighthouse") + r" or path like '%.csproj' and text rlike r'AxeCore|Playwright\.Axe'", "flow_axe": _has(_FLOW, r"(?i)axe|pa11y|lighthouse|a11y|accessibility"),
    "a11y_docs": _has(_DOCS, r"(?i)\bWCAG\b|accessibility statement|\ba11y\b") + r" or path rlike r'(^|/)(\.htmlhintrc|\.pa11yci)$' or path like '%package.json' and text like '%a11y%'",
    # disclosure
    "policy": _POLICY, "policy_contact": _has(_POLICY, r"(?i)mailto:|[\w.+-]+@[\w-]+\.[\w.-]+|https?://\S*(security|advisor|report|disclos)|Contact:\s*\S+"), "policy_process": _has(_POLICY, r"(?i)within|response|acknowledg|triage|days|timeline|disclos"),
    "policy_scope": _has(_POLICY, r"(?i)supported versions|scope"),
    # web posture and personal data
    "web": _has(_PROD, r"WebApplication\.CreateBuilder|UseRouting\(\)|ControllerBase|MapGet\("), "hsts": _has(_PROD, r"UseHsts\(\)"), "https": _has(_PROD, r"UseHttpsRedirection\(\)|UseHsts\(\)"),
    "headers": _has(_PROD, r"X-Content-Type-Options|Content-Security-Policy|X-Frame-Options|UseSecurityHeaders"), "validates": _has(_PROD, r"\[ApiController\]|FluentValidation|ModelState\.IsValid|\[Required\]|\[Range\(|\[StringLength|\[MaxLength|AddValidation"),
    "cookies": _has(_PROD, r"new CookieOptions"), "cookies_safe": _has(_PROD, r"Secure\s*=\s*true|HttpOnly\s*=\s*true|SameSite\s*=\s*SameSiteMode"), "auth_order": _has(_PROD, r"(?s)UseAuthorization\(\).{0,400}UseAuthentication\(\)"),
    "auth": _has(_PROD, r"AddAuthentication|AddAuthorization|UseAuthorization"), "fallback": _has(_PROD, r"FallbackPolicy|SetFallbackPolicy|AuthorizeFilter"),
    "c1_tls": _has(_PROD, r"UseHttpsRedirection|UseHsts|RequireHttpsMetadata\s*=\s*true|SslMode=Require|Encrypt=true"), "c1_stored": _has(_PROD, r"IDataProtector|IDataProtectionProvider|Aes\.|AesGcm|ProtectedData|Encrypt|Pseudonym"), "c1_vault": _has(_PROD, r"KeyVault|SecretClient|SecretsManager|Vault|GetEnvironmentVariable|AddUserSecrets"),
    "c3_audit": _has(_PROD, r"SaveChangesInterceptor|AuditTrail|AuditLog|AuditEntry|IAuditable|CreatedBy|ModifiedBy|ChangedBy"), "c3_who": _has(_PROD, r"CreatedBy|ModifiedBy|UpdatedBy|ChangedBy|PerformedBy"),
    "c4_period": _has(_PROD, r"(?i)\bretention\w*|TimeToLive|ExpireAfter|PurgeAfter|KeepFor|RetainFor"), "c4_purge": _has(_PROD, r"(Purge|Cleanup|Sweep|Prune|Retention)\w*(Service|Worker|Job)"),
    "c5_erase": _has(_PROD, r"(?i)Erase|Anonymi[sz]e|Forget|DeletePersonalData"), "c5_export": _has(_PROD, r"(?i)Export(PersonalData|MyData|UserData|Customer|Account)|Portability"), "c5_consent": _has(_PROD, r"(?i)Consent"),
    # clusters
    "egress": rf"{_YAML} and text rlike r'(?s)kind:\s*(Cilium)?NetworkPolicy.*([Ee]gress)'", "runtime_agent": _has(_YAML, r"(?i)tetragon|TracingPolicy|falco|sysdig|kubearmor|neuvector"),
    "admission": _has(_YAML, r"(?i)kyverno|ConstraintTemplate|gatekeeper|ImagePolicyWebhook|ValidatingAdmissionPolicy"), "psa": _has(_YAML, r"pod-security\.kubernetes\.io/enforce:"), "psa_restricted": _has(_YAML, r"pod-security\.kubernetes\.io/enforce:\s*restricted"),
    # architecture
    "slices": r"path rlike r'(?i)/(Features|Slices|UseCases)/[^/]+/'", "hexagonal": r"path rlike r'(?i)/(Ports|Adapters)/'", "outbox": _has(_PROD, r"\bI?Outbox\w*\b|UseOutbox"),
    "rule_docs": r"path rlike r'(?i)(^|/)(docs?|adrs?|decisions|architecture)/.*\.md$' and text rlike r'(?i)\b(must|may|shall|should)\s+(not\s+|only\s+)?(reference|depend|import)|dependency rule|layer(ing)? rule|enforcement:'",
    "arch_tests": _has(_TEST, r"NetArchTest|ArchUnitNET|ArchRuleDefinition|Types\.InAssembly|HaveDependencyOn") + r" or path like '%.csproj' and text rlike r'NetArchTest|ArchUnitNET|BannedApiAnalyzers'",
    "js_guard": _has(_TEST, r"IJSRuntime|JSInterop") + " or path like '%.d.ts'",
}

#: Sums over files.
FILE_COUNTS = {
    "flows": f"if({_FLOW}, 1, 0)", "net_policies": rf"if({_YAML} and text rlike r'kind:\s*(Cilium)?NetworkPolicy', 1, 0)", "pages": r"if(path rlike r'\.(html?|razor|cshtml)$' and not is_test, 1, 0)",
    "surface": r"if(path rlike r'(?i)(^|/)[^/]*dockerfile[^/]*$|\.tf$' or path rlike r'\.ya?ml$' and not path like '.github/%', 1, 0)", "styles": r"if(path rlike r'\.s?css$', 1, 0)",
    "actions": rf"if({_FLOW}, size(regexp_extract_all(text, r'uses:\s*[\w./-]+@', 0)), 0)", "pinned": rf"if({_FLOW}, size(regexp_extract_all(text, r'uses:\s*[\w./-]+@[0-9a-f]{{40}}\b', 0)), 0)",
    "alloc": rf"if({_PROD}, size(regexp_extract_all(text, r'\b(Span<|ReadOnlySpan<|Memory<|ReadOnlyMemory<|ArrayPool<|stackalloc\b|ValueTask\b|IBufferWriter<|ObjectPool<|ref struct|string\.Create\(|CollectionsMarshal|MemoryMarshal)', 0)), 0)",
    "log_calls": rf"if({_PROD}, size(regexp_extract_all(text, r'(?i)log\w*\.Log(Trace|Debug|Information|Warning|Error|Critical)\(', 0)), 0)",
    "awaits": rf"if({_PROD}, size(regexp_extract_all(text, r'\bawait\b', 0)), 0)", "registrations": rf"if({_PROD}, size(regexp_extract_all(text, r'\.Add(Singleton|Scoped|Transient|HostedService)\b', 0)), 0)",
    "singletons": rf"if({_PROD}, size(regexp_extract_all(text, r'\.Add(Singleton|HostedService)\b', 0)), 0)",
    "http_sites": rf"if({_PROD}, size(regexp_extract_all(text, r'\bAdd(Http|Refit|Grpc)Client\b|new HttpClient\(', 0)), 0)",
    "dockerfiles": r"if(path rlike r'(?i)(^|/)dockerfile[^/]*$', 1, 0)",
}

_EVENT = r"exists(params, p -> p rlike r'\b\w+(ed|Event)\b')"
METHOD_COUNTS = {
    "n_methods": "if(body <> '', 1, 0)", "awaiting": "if(array_contains(modifiers, 'async') and body rlike r'\\bawait\\b', 1, 0)", "with_token": "if(array_contains(modifiers, 'async') and body rlike r'\\bawait\\b' and exists(params, p -> p like '%CancellationToken%'), 1, 0)",
    "event_handlers": rf"if(name rlike r'^(Handle|Consume)' and {_EVENT}, 1, 0)", "folds": rf"if(name in ('Apply', 'When', 'On') and {_EVENT}, 1, 0)", "publishers": r"if(body rlike r'\.(Publish|Send)(Async)?\(' and not type rlike r'(?i)Outbox|Dispatcher|Relay', 1, 0)",
    "endpoints_code": r"if(body rlike r'\bMap(Get|Post|Put|Delete|Patch)\(', size(regexp_extract_all(body, r'\bMap(Get|Post|Put|Delete|Patch)\(', 0)), 0)",
    "open_endpoints": r"if(body rlike r'\bMap(Get|Post|Put|Delete|Patch)\(' and not body rlike r'RequireAuthorization|AllowAnonymous', size(regexp_extract_all(body, r'\bMap(Get|Post|Put|Delete|Patch)\(', 0)), 0)",
}
_ENTITY = r"exists(bases, b -> b rlike r'^(\w*Entity\w*|\w*AggregateRoot)\b')"
TYPE_COUNTS = {
    "interfaces": "if(kind = 'interface', 1, 0)", "handlers": r"if(name rlike r'(Query|Get\w+|Find\w+|List\w+|Search\w+)Handler$', 1, 0)", "entities": f"if({_ENTITY}, 1, 0)", "ddd": rf"if({_ENTITY} or kind = 'interface' and name rlike r'Repository$', 1, 0)",
    "repositories": "if(name rlike r'Repository$', 1, 0)", "id_props": f"if({_ENTITY}, size(filter(props, p -> p.name rlike r'Id$')), 0)", "typed_ids": f"if({_ENTITY}, size(filter(props, p -> p.name rlike r'Id$' and not p.type in ('Guid', 'int', 'long', 'string'))), 0)",
    "events": "if(name rlike r'Event$' and kind <> 'interface', 1, 0)", "commands": "if(name rlike r'Command$', 1, 0)", "integration_events": "if(name rlike r'IntegrationEvent$', 1, 0)",
    "personal": rf"size(filter(props, p -> p.name rlike r'(?i)^{_PERSON}$'))", "controllers": "if(name rlike r'Controller$', 1, 0)", "open_controllers": r"if(name rlike r'Controller$' and not concat(attributes, body) rlike r'Authorize|AllowAnonymous' and not name rlike r'(?i)health|status|version', 1, 0)",
    "n_types": "1", "large_classes": "if(kind in ('class', 'record') and methods >= 6 and size(fields) + size(props) >= 2, 1, 0)",
}

#: dimension, rule, weight of a failed item, what has to hold for the list to apply, why it doesn't, items (what, condition[, where it is asked]).
LISTS = [
    ("M1", "readme-quality", 0.5, "readme", None, [("explains itself", "readme_long"), ("installation", "readme_install"), ("usage", "readme_usage"), ("code block", "readme_code"), ("licence", "licensed")]),
    ("M2", "architecture-documentation", 0.5, "true", None, [("architecture document", "architecture_doc"), ("decision records", "decisions"), ("diagram", "diagram"), ("contributing", "contributing")]),
    ("P1", "ci-build-and-test-pipeline", 1.0, "flow", None, [("a pipeline that builds", "flow_builds"), ("a pipeline that runs the tests", "flow_tests"), ("runs on pull requests", "flow_pr"), ("runs on pushes", "flow_push")]),
    ("P3", "security-tooling-in-ci", 0.5, "flow", None, [("code scanning", "sast"), ("dependency updates", "update_bot"), ("an audit of packages", "audit"), ("secret scanning", "secret_scan or sast")]),
    ("P2", "observability", 1.0, "apps > 0", "no web or worker application", [("structured logs", "log"), ("traces or metrics", "trace"), ("health checks", "health"), ("correlation", "correlation")]),
    ("P4", "deployment-rollback-safety", 1.0, "k8s or helm or deploys or terraform or compose", "nothing is deployed from here", [("probes", "probes or not k8s and compose_health"), ("a rolling strategy", "rolling or deploy_steps"), ("an automated deployment", "deploys or helm and flow"), ("an approval gate", "deploy_gate"), ("pinned images", "not k8s or not unpinned")]),
    ("P5", "disaster-recovery-evidence", 1.0, "state", "no persistent state", [("backups", "backup"), ("a restore procedure", "restore"), ("declared persistence", "persist"), ("retention", "retain")]),
    ("P6", "release-hygiene", 1.0, "projects > 0", "no projects", [("a changelog", "changelog"), ("version stamping", "version_stamp"), ("release tags", "tags > 0 or not has_history")]),
    ("P10", "library-api-versioning", 1.0, "packable > 0", "no packable library", [("version stamping", "version_stamp"), ("an API baseline", "api_baseline"), ("XML documentation", "api_docs"), ("a small public surface", "n_types <= 60 or api_baseline"), ("a changelog", "changelog")]),
    ("P11", "executable-specifications", 1.0, "bdd", "no framework for executable specifications", [("feature files", "features"), ("step definitions", "steps"), ("business scenarios", "scenarios"), ("run in the pipeline", "flow_tests")]),
    ("PF1", None, 0.0, "bench", "reward only: no benchmark suite", [("a suite", "bench"), ("memory measured", "bench_memory"), ("run in the pipeline", "flow_bench"), ("baselines", "bench_base")]),
    ("D18", "solution-structure", 0.5, "projects + test_projects > 0", "no projects", [("a solution file", "solution_file"), ("shared build properties", "build_props or projects + test_projects = 1"), (".editorconfig", "editorconfig"), ("sources apart from tests", "src_apart and tests_apart"), ("consistent names", "one_prefix"), ("no stray projects", "stray = 0")]),
    ("M3", "folder-structure", 1.0, "projects + test_projects > 0", "no projects", [("production code in a source folder", "src_apart"), ("tests apart", "tests_apart"), ("one name prefix", "one_prefix")]),
    ("AX5", "architecture-style-fit", 1.0, "projects > 0", "no projects", [("a named style", "domain_projects > 0 and (application_projects > 0 or infrastructure_projects > 0) or slices or hexagonal or projects >= 3 and roles >= 2"), ("modularity that fits the size", "loc < 5000 or projects >= 3 or slices"), ("a core to depend on", "domain_projects > 0 or library_projects > 0 or projects = 1 or slices"), ("no project with everything", "most_files <= 150 or projects = 1")]),
    ("S1", "security-response-headers", 1.0, "web or web_projects > 0", "no web application", [("HTTPS", "https"), ("response headers", "headers"), ("validated inputs", "validates and injections < 3"), ("safe cookies", "not cookies or cookies_safe"), ("authentication before authorization", "not auth_order"), ("sound cryptography", "weak_crypto = 0")]),
    ("C1", "data-encryption-controls", 1.0, "personal >= 2", "no personal data in the model", [("transport security", "c1_tls"), ("protected values at rest", "c1_stored"), ("secrets outside the code", "c1_vault")]),
    ("C3", "audit-trail", 1.0, "personal >= 2", "no personal data in the model", [("an audit of changes", "c3_audit"), ("who changed it", "c3_who")]),
    ("C4", "data-retention-policy", 1.0, "personal >= 2", "no personal data in the model", [("a retention period", "c4_period"), ("a purge", "c4_purge")]),
    ("C5", "data-subject-rights", 1.0, "personal >= 2", "no personal data in the model", [("erasure", "c5_erase"), ("export", "c5_export"), ("consent", "c5_consent")]),
    ("D37", "vulnerability-disclosure-policy", 1.0, "policy", None, [("a policy file", "policy"), ("a contact", "policy_contact"), ("how reports are handled", "policy_process"), ("scope or versions", "policy_scope")]),
    ("D36", "build-provenance-and-signing", 1.0, "flow", "no pipeline", [("actions pinned to commits", "actions > 0 and pinned = actions"), ("locked restores", "locked_flow and locked_projects = lock_projects"), ("build provenance", "provenance", "releases"), ("an SBOM", "sbom", "releases"), ("signed artifacts", "signing", "releases")]),
    ("D9", "test-pyramid-distribution", 1.0, "tests > 0", None, [("a base of unit tests", "unit >= 0.5 * tests"), ("some integration tests", "integration > 0 or tests < 15"), ("more unit than integration tests", "unit >= integration"), ("no inverted pyramid", "e2e <= greatest(integration, 1)")]),
]
#: What counts where the list itself doesn't apply because the thing it looks at is missing altogether: dimension, rule, weight, condition, message.
ABSENT = [
    ("P1", "ci-build-and-test-pipeline", 2.0, "not flow", "no pipeline"), ("M1", "readme-quality", 2.0, "not readme", "no README"), ("D37", "vulnerability-disclosure-policy", 2.0, "not policy", "no policy for reports"),
    ("R4", "test-coverage", 2.0, "projects > 0 and test_projects = 0 and tests = 0", "no test project"), ("AC7", "accessibility-checks-in-ci", 2.0, "pages > 0 and not axe and not a11y_docs", "nothing checks accessibility"),
    ("P8", "versioned-schema-migrations", 1.0, "db and not migrations and not ensure_created", "a database without migrations"), ("P8", "versioned-schema-migrations", 1.0, "auto_create", "the schema is created at run time"),
    ("P6", "release-hygiene", 1.0, "changelog and not changelog_shape", "missing: sections by version"), ("P6", "release-hygiene", 1.0, "changelog and not changelog_covers", "missing: the release history"),
    ("P9", "domain-vs-controller-coverage", 1.0, "domain_files > 0 and tests > 0 and domain_direct < 0.5 * domain_files", "the domain is hardly tested directly"),
    ("P12", "ci-test-gate-integrity", 0.5, "flow and skipped > 0", "the gate skips tests"), ("SC1", "dependencies-not-locked", 1.0, "lock_projects > 0 and locked_projects = 0", "no project locks its packages"),
]
FINDING = "rule_id string, dimension string, message string, file string, line int, end_line int, weight double, commit_sha string"


def counted(rows: DataFrame, sums: dict[str, str], flags: dict[str, str] | None = None) -> dict[str, object]:
    """All sums and flags over the rows, from one pass."""
    told = [F.coalesce(F.sum(F.expr(f"cast({e} as double)")), F.lit(0.0)).alias(n) for n, e in sums.items()]
    told += [F.coalesce(F.bool_or(F.expr(f"coalesce({e}, false)")), F.lit(False)).alias(n) for n, e in (flags or {}).items()]
    return rows.agg(*told).first().asDict()


def facts(spark, values: dict[str, object]) -> DataFrame:
    """The one row on which lists and formulas are judged."""
    kinds = {n: "boolean" if isinstance(v, bool) else "double" for n, v in values.items()}
    return spark.createDataFrame([tuple(bool(v) if kinds[n] == "boolean" else float(v or 0) for n, v in values.items())], ", ".join(f"`{n}` {k}" for n, k in kinds.items()))


def list_items(row: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, id, rule_id, weight, item, ok) of every item of every list that applies."""
    items = [
        F.when(F.expr(" and ".join(f"({x})" for x in (needs, *asked))), F.struct(F.lit(d).alias("id"), F.lit(r).alias("rule_id"), F.lit(w).alias("weight"), F.lit(i).alias("item"), F.expr(f"coalesce({ok}, false)").alias("ok")))
        for d, r, w, needs, _, todo in LISTS for i, ok, *asked in todo
    ]
    return row.select(*(keys or []), F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x")).select(*(keys or []), "x.*")


def list_findings(row: DataFrame) -> DataFrame:
    """A finding for each failed item, and for what is missing altogether; none has a file."""
    none = [F.lit(None).cast(k).alias(n) for n, k in (("file", "string"), ("line", "int"), ("end_line", "int"))]
    tail = F.lit(None).cast("string").alias("commit_sha")
    failed = list_items(row).where("not ok and rule_id is not null").select("rule_id", F.col("id").alias("dimension"), F.concat(F.lit("missing: "), "item").alias("message"), *none, "weight", tail)
    gone = F.array(*(F.when(F.expr(f"coalesce({test}, false)"), F.struct(F.lit(r).alias("rule_id"), F.lit(d).alias("dimension"), F.lit(m).alias("message"), F.lit(w).alias("weight"))) for d, r, w, test, m in ABSENT))
    absent = row.select(F.explode(F.filter(gone, lambda x: x.isNotNull())).alias("x")).select("x.rule_id", "x.dimension", "x.message", *none, "x.weight", tail)
    return failed.unionByName(absent)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
