"""The rubric: lenses, dimensions, rules and the parameters of the fold, as tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# They have to equal the published rubric's for equal results.

RUBRIC_VERSION = "rubric-2026.10.2"

#: In the order that breaks ties between lenses of one score.
LENSES = "codeHealth architecture maturity productionReadiness securityCompliance domainModelling eventDriven eventSourcing accessibility performance".split()

CATEGORY_LENS = {
    "code-quality": "codeHealth", "explicit-debt": "codeHealth", "architecture": "architecture",
    "git-mining": "maturity", "docs": "maturity", "testing": "productionReadiness",
    "dependencies": "productionReadiness", "security": "productionReadiness", "security-compliance": "securityCompliance",
}

#: Categories of the dimensions that have one; the others enter their lens directly. Only the pairs that published examples show.
DIMENSION_CATEGORY = {
    "D1": "code-quality", "D3": "code-quality", "D4": "code-quality", "D17": "explicit-debt", "D5": "architecture", "D7": "architecture",
    "D15": "git-mining", "D9": "testing", "D12": "dependencies", "D28": "security-compliance", "D29": "security-compliance", "D19": "docs",
}

BANDS = ("Critical", "Weak", "Adequate", "Strong", "Exemplary")
LENS_GROUP = {"codeHealth": "foundational", "architecture": "foundational", "securityCompliance": "safety", "maturity": "operational", "productionReadiness": "operational"}


@dataclass(frozen=True)
class Scoring:
    within_q: float = 0.75
    across_q: float = 0.55
    gate: float = 4.0
    min_projects: int = 2
    min_loc: int = 1500
    low_surface_cap: float = 69.0
    #: Exemplary, Strong, Adequate, Weak.
    cutlines: tuple[float, float, float, float] = (90.0, 70.0, 50.0, 25.0)
    bar_offsets: dict[str, float] = field(default_factory=lambda: {"prototype": -18.0, "preview": -8.0, "production": 0.0, "mission-critical": 6.0})
    group_factors: dict[str, float] = field(default_factory=lambda: {"foundational": 0.4, "operational": 1.0, "safety": 0.25, "default": 0.7})
    exemplary_ceiling: float = 98.0
    poor_floor: float = 5.0
    tolerance: float = 0.5

    @classmethod
    def read(cls, block: dict) -> Scoring:
        """The parameters that a catalog's scoring block states, the published defaults for the rest."""
        own = cls()
        surface, bands, bar = block.get("architectureSurface", {}), block.get("bands", {}), block.get("qualityBar", {})
        return cls(
            block.get("withinLensQ", own.within_q), block.get("acrossLensQ", own.across_q), block.get("criticalGate", own.gate),
            surface.get("minProjects", own.min_projects), surface.get("minProductionLoc", own.min_loc), surface.get("lowSurfaceCap", own.low_surface_cap),
            tuple(float(bands.get(n, x)) for n, x in zip(("exemplary", "healthy", "fair", "poor"), own.cutlines, strict=True)),
            bar.get("offsets", own.bar_offsets), bar.get("lensGroupFactors", own.group_factors), bar.get("exemplaryCeiling", own.exemplary_ceiling), bar.get("poorFloor", own.poor_floor),
        )


@dataclass(frozen=True)
class Catalog:
    """A rubric read from a document: its version, the lens and category of each dimension, and the parameters of the fold."""

    version: str
    dimensions: list[tuple[str, str | None, str | None]]  # id, category, lens
    scoring: Scoring

    @classmethod
    def read(cls, document: dict) -> Catalog:
        dims = [(d["id"], d.get("category"), d.get("lens")) for d in document.get("dimensions", [])]
        return cls(document["rubricVersion"], dims, Scoring.read(document.get("scoring", {})))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.dimensions, "id string, category string, lens string")


#: Rules: concept, its dimension and those it also touches, and its weakness number or a dash.
RULES = """
high-cyclomatic-complexity D1 1121
high-cognitive-complexity D2 -
god-class D3 -
long-method D3 -
oversized-source-file R3+D3 1080
duplicated-code D4 1041
technical-debt-marker D17 546
suppressed-diagnostic D17 -
commented-out-code D17 -
unused-code D17 561
unreachable-code D17+X12+IC1 561
obsolete-symbol-still-used D17 477
not-implemented-placeholder GD1+IC1 -
incomplete-implementation IC1 -
empty-catch-block X3+D17 1069
pointless-catch-rethrow X3 -
rethrow-resets-stack-trace X3 -
blocking-on-async-code X1+PF3 -
async-void-method X1 -
missing-cancellation-propagation X2 -
non-structured-log-message X4 -
nullable-analysis-disabled X5 -
null-forgiving-suppression X5 -
null-dereference X5 476
hand-rolled-structured-format-parsing X6 -
silent-error-fallback X7 390
js-interop-contract-mismatch X8 -
redundant-condition-operand X9 -
undrained-child-process-stream X13 833
unbounded-truncation-loop X16 835
improper-resource-disposal X18 404
unrestored-process-global-state X19 -
argument-guard-tests-wrong-condition X20 -
side-effect-in-conditional-guard X21 -
lock-release-state-mismatch X22 667
unguarded-expensive-debug-logging X23 -
inert-configuration-option X25 -
unsynchronized-callback-handoff X26 362
collection-modified-during-enumeration X27 -
index-access-outside-bounds-guard X28 129
loop-decision-on-fixed-element X29 -
contradictory-support-guard X30 -
type-lookup-by-simple-name X32 -
missing-configure-await PF3 -
allocation-awareness PF2 -
benchmark-discipline PF1 -
module-dependency-cycle AX3+D5+D7 1047
unstable-dependency D5 -
module-off-main-sequence D5 -
layer-dependency-violation AX4+D7+D5 -
architecture-rules-unenforced D7 -
boundary-type-leakage D23 -
oversized-module D26 -
call-indirection D27 -
change-coupling D35 -
captive-dependency AX1 -
unsynchronized-shared-state AX2 362
architecture-style-fit AX5 -
fat-interface AX6 -
cross-slice-coupling AX7 -
production-depends-on-test-code AX8 -
query-with-side-effects AX9 -
business-logic-share AX10 -
business-logic-in-controller AX10 -
low-class-cohesion D6 -
solution-structure D18 -
compiled-code-size D39 -
churn-complexity-hotspot D15 -
knowledge-concentration D16 -
knowledge-freshness D34 -
readme-quality M1 -
architecture-documentation M2 -
folder-structure M3 -
test-pyramid-distribution D9 -
test-without-assertion D10 -
skipped-test-without-reason D10+IC1 -
excessive-mocking D10 -
test-failure-swallowed D10 -
flaky-test D11+D10 -
test-coverage R4 -
domain-vs-controller-coverage P9 -
ci-build-and-test-pipeline P1 -
observability P2 -
security-tooling-in-ci P3 -
deployment-rollback-safety P4 -
disaster-recovery-evidence P5 -
release-hygiene P6 -
outbound-http-resilience P7 -
versioned-schema-migrations P8 -
library-api-versioning P10 -
executable-specifications P11 -
ci-test-gate-integrity P12 -
vulnerable-dependency D30+D12 1395
malicious-dependency D43 506
end-of-life-platform D44 1104
prerelease-dependency D12 -
dependencies-not-locked SC1+D12 -
license-policy-violation D14 -
hardcoded-credential D13+D28 798
hardcoded-password D13+D28 259
hardcoded-cryptographic-key D13+D28 321
committed-private-key D13+D28 798
secret-in-version-history D28 540
sql-injection D29 89
command-injection D29 78
code-injection D29 94
path-traversal D29 22
xml-external-entity D29 611
insecure-deserialization D29 502
cross-site-scripting D29 79
regex-denial-of-service D29 1333
ldap-injection D29 90
xpath-injection D29 643
server-side-request-forgery D29+X14 918
open-redirect D29 601
weak-cryptographic-algorithm D29+S1 327
weak-hash-algorithm D29+S1 328
insufficient-password-hashing D29+S1 916
insecure-randomness D29 338
cleartext-transmission D29+S1+D31 319
missing-authorization D29+C2 862
error-information-exposure D29 209
improper-certificate-validation D29+S1 295
token-signature-or-expiry-not-validated D29+S1 347
log-injection D29 117
sensitive-data-in-logs D32+D29 532
sensitive-data-in-url D32+S1 598
unbounded-allocation-from-untrusted-length X15+D29 789
uncontrolled-recursion X17 674
ci-workflow-injection D36+D29 78
ci-secret-exposure D36+D29 -
secret-in-process-arguments D36 214
ci-token-excessive-permissions D36 250
unpinned-ci-action D36 829
download-without-integrity-check D31+D36 494
build-provenance-and-signing D36 -
vulnerability-disclosure-policy D37 -
container-runs-as-root D31 250
privileged-container D31 250
host-namespace-sharing D31 250
host-path-mount D31 250
container-privilege-escalation-allowed D31 250
container-excess-capabilities D31 250
container-writable-root-filesystem D31 -
container-confinement-profile-unset D31 -
container-security-context-missing D31 250
container-missing-resource-limits D31 770
container-missing-resource-requests D31 -
mutable-image-reference D31+D36 -
missing-health-probes D31 -
missing-image-healthcheck D31 -
automounted-service-account-token D31 -
overly-permissive-rbac D31 269
image-not-from-allowed-registry D31 -
network-egress-policy D40 -
workload-syscall-confinement D41 -
runtime-threat-detection-and-admission D42 -
security-response-headers S1 -
https-enforcement S1 -
insecure-cookie-flags S1 614
inbound-input-validation S1 -
data-encryption-controls C1 311
authorization-enforcement C2 -
audit-trail C3 778
data-retention-policy C4 -
data-subject-rights C5 -
cross-aggregate-object-reference DM1 -
primitive-entity-identifier DM2 -
integration-event-leaks-domain-type DM3 -
anemic-domain-model DM4 -
publicly-mutable-entity-state DM5 -
domain-depends-on-infrastructure DM6 -
repository-for-non-aggregate DM7 -
scattered-domain-rule DM9 -
multi-aggregate-transaction DM10 -
constructible-invalid-entity DM11 -
ambient-nondeterminism-in-domain DM12 -
value-object-mutability DM5 -
synchronous-remote-call-in-event-handler ED1 -
command-with-multiple-handlers ED2 -
event-not-named-in-past-tense ED3 -
dual-write-without-outbox ED4 -
domain-event-never-handled ED2 -
nondeterministic-event-fold ES1 -
mutable-persisted-event ES2 -
event-schema-change-without-upcaster ES2 -
missing-text-alternative AC1 -
form-control-without-label AC2 -
page-structure-violation AC3 -
non-keyboard-accessible-interaction AC4 -
invalid-aria-usage AC5 -
focus-outline-removed AC6 -
motion-without-reduced-motion AC6 -
visual-and-motion-safety AC6 -
form-error-not-associated AC2 -
modal-focus-not-managed AC4 -
autoplay-media-without-control AC1 -
accessibility-checks-in-ci AC7 -
"""

#: Findings of these rules describe a posture; without a file they are dropped where their dimension scores well.
POSTURE_RULES = """
readme-quality
architecture-documentation
folder-structure
solution-structure
ci-build-and-test-pipeline
observability
security-tooling-in-ci
deployment-rollback-safety
disaster-recovery-evidence
release-hygiene
library-api-versioning
executable-specifications
architecture-style-fit
test-pyramid-distribution
domain-vs-controller-coverage
build-provenance-and-signing
vulnerability-disclosure-policy
network-egress-policy
workload-syscall-confinement
runtime-threat-detection-and-admission
security-response-headers
https-enforcement
inbound-input-validation
data-encryption-controls
authorization-enforcement
audit-trail
data-retention-policy
data-subject-rights
accessibility-checks-in-ci
benchmark-discipline
allocation-awareness
dependencies-not-locked
business-logic-share
"""

#: Dimensions: id, lens, evaluator and name, in catalog order.
DIMENSIONS = """
D1 codeHealth tool Cyclomatic Complexity
D2 codeHealth tool Cognitive Complexity
D3 codeHealth tool God Classes
D4 codeHealth tool Code Duplication
D17 codeHealth tool Explicit Debt
D18 codeHealth tool Solution Shape
D39 codeHealth tool IL Efficiency
GD1 codeHealth tool Unfinished & placeholder code
IC1 codeHealth tool Incompleteness & stubs
R1 codeHealth tool Type Safety
R2 codeHealth tool Cyclomatic Complexity
R3 codeHealth tool Large Files
R7 codeHealth tool Dead Code
R10 codeHealth tool Code Duplication
X1 codeHealth tool Async correctness
X2 codeHealth tool Cancellation propagation
X3 codeHealth tool Exception handling
X4 codeHealth tool Structured logging
X5 codeHealth tool Nullable reference types
X6 codeHealth tool Hand-rolled structured-format parsing
X7 codeHealth tool Silent fallback defaults
X8 codeHealth tool JS interop contract
X9 codeHealth tool Subsumed condition operand
X10 codeHealth tool Duplicated predicate
X12 codeHealth tool Unreachable branch
X13 codeHealth tool Undrained process stream
X16 codeHealth tool Unfloored truncation loop
X18 codeHealth tool Disposal-pattern correctness
X19 codeHealth tool Unrestored process-global state
X20 codeHealth tool Mistyped argument guard
X21 codeHealth tool Side-effecting pattern guard
X22 codeHealth tool Contradicted release guard
X23 codeHealth tool Unguarded diagnostic materialisation
X25 codeHealth tool Inert configuration knob
X26 codeHealth tool Unsynchronised callback handoff
X27 codeHealth tool Collection changed while being enumerated
X28 codeHealth tool Index access outside its own emptiness guard
X29 codeHealth tool Per-element action decided by a fixed element
X30 codeHealth tool Support guard that admits what it rejects
X31 codeHealth tool Test-only surface in a production module
X32 codeHealth tool Type resolved by simple name across every loaded assembly
D5 architecture tool Coupling
D6 architecture tool Cohesion (LCOM4)
D7 architecture tool Architectural Integrity
D22 architecture llm Internal API Consistency
D23 architecture tool Boundary Type-Coupling
D26 architecture tool Project Cohesion
D27 architecture tool Navigability
D35 architecture tool Change Coupling
AX1 architecture tool Captive dependencies
AX2 architecture tool Stateful singletons
AX3 architecture tool Project dependency cycles
AX4 architecture tool Dependency direction
AX5 architecture tool Architecture & structure
AX6 architecture tool Interface segregation
AX7 architecture tool Slice cohesion
AX8 architecture tool Test isolation
AX9 architecture tool CQS / query purity
AX10 architecture tool Code composition
R9 architecture tool Circular Imports
R11 architecture tool Import Boundaries
D15 maturity tool Churn × Complexity Hotspots
D16 maturity tool Bus Factor
D19 maturity llm Documentation Quality
D20 maturity llm ADR Quality
D21 maturity llm Naming Consistency
D24 maturity llm Comment Value
D25 maturity llm ADR Conformance
D34 maturity tool Knowledge Freshness
AXB1 maturity tool Runtime evidence locked — no reproducible boot
AXB2 maturity tool Runtime readiness
M1 maturity tool Documentation (README)
M2 maturity tool Architecture documentation
M3 maturity tool Folder & project structure
M4 maturity llm Documentation accuracy
D8 productionReadiness tool Code Coverage
D9 productionReadiness tool Test Distribution
D10 productionReadiness tool Test Quality
D11 productionReadiness tool Test Reliability
D12 productionReadiness tool Dependency Hygiene
D13 productionReadiness tool Secret Scanning
D14 productionReadiness tool License Compliance
ED5 productionReadiness llm Idempotency
P1 productionReadiness tool CI/CD gates
P2 productionReadiness tool Observability
P3 productionReadiness tool Security & performance tooling
P4 productionReadiness tool Deployment & Rollback
P5 productionReadiness tool DR & Backup
P6 productionReadiness tool Release Hygiene
P7 productionReadiness tool Outbound HTTP resilience
P8 productionReadiness tool Schema migrations
P9 productionReadiness tool Domain vs controller coverage
P10 productionReadiness tool Library API & versioning
P11 productionReadiness tool BDD / executable specs
P12 productionReadiness tool CI test-gate honesty
R4 productionReadiness tool Test Coverage
R5 productionReadiness tool Dependency Freshness
R6 productionReadiness tool Tooling
R8 productionReadiness tool Dependency Hygiene
D28 securityCompliance tool Secrets (history)
D29 securityCompliance tool Static Analysis (SAST)
D30 securityCompliance tool Dependency Vulnerabilities
D31 securityCompliance tool IaC & Container Security
D32 securityCompliance tool Data Compliance (PII/GDPR)
D36 securityCompliance tool Supply-chain Provenance & Signing
D37 securityCompliance tool Vulnerability-disclosure Policy
D40 securityCompliance tool Network Egress Confinement
D41 securityCompliance tool Kernel & Syscall Confinement
D42 securityCompliance tool Runtime Threat Enforcement
D43 securityCompliance tool Malicious Dependencies
D44 securityCompliance tool Platform End-of-Life
AXA1 securityCompliance tool Runtime unauthenticated reachability
AXH1 securityCompliance tool Runtime security headers
AXI1 securityCompliance tool Runtime container hardening
AXK1 securityCompliance tool Runtime cookie security
AXO1 securityCompliance tool Runtime API surface
AXP1 securityCompliance tool Runtime third-party data flows
AXS1 securityCompliance tool Runtime exposed surface
C1 securityCompliance tool Data Protection
C2 securityCompliance tool Access Controls
C3 securityCompliance tool Audit Trail
C4 securityCompliance tool Data Retention
C5 securityCompliance tool Data-Subject Rights
LA1 securityCompliance llm Personal-Data Handling (GDPR)
LA3 securityCompliance llm Vulnerability-Disclosure Policy
LA4 securityCompliance llm Dev/Test/Prod Separation
S1 securityCompliance tool Web-Security Posture
SC1 securityCompliance tool Supply-chain hygiene
X14 securityCompliance tool Bypassable address classification
X15 securityCompliance tool Unvalidated length from an untrusted reader
X17 securityCompliance tool Uncapped recursion over a caller-supplied document
X24 securityCompliance tool Document value interpolated into markup unescaped
PF1 performance tool Benchmark discipline
PF2 performance tool Allocation hygiene
PF3 performance tool Async & latency hygiene
DM1 domainModelling tool Aggregate boundaries
DM2 domainModelling tool Strongly-typed ids
DM3 domainModelling tool Integration-event coupling
DM4 domainModelling tool Rich vs anemic model
DM5 domainModelling tool Encapsulated state
DM6 domainModelling tool Domain ↔ infrastructure boundary
DM7 domainModelling tool Repository granularity
DM8 domainModelling llm Value-object opportunities
DM9 domainModelling tool Scattered domain decisions
DM10 domainModelling tool One transaction, one aggregate
DM11 domainModelling tool Constructible invalid state
DM12 domainModelling tool Ambient inputs in the domain
ED1 eventDriven tool Handler temporal coupling
ED2 eventDriven tool Event/command shape
ED3 eventDriven tool Event naming
ED4 eventDriven tool Outbox / dual-write
ES1 eventSourcing tool Fold determinism
ES2 eventSourcing tool Immutable events
ES3 eventSourcing llm PII in the event store
AC1 accessibility tool Text alternatives
AC2 accessibility tool Forms & labels
AC3 accessibility tool Page structure
AC4 accessibility tool Keyboard semantics
AC5 accessibility tool ARIA correctness
AC6 accessibility tool Visual & motion safety
AC7 accessibility tool A11y enforcement
AXR1 accessibility tool Runtime accessibility (rendered)
LA2 accessibility llm Alt-Text Quality (WCAG 1.1.1)
LA5 accessibility llm Link & Button Text Quality (WCAG 2.4.4)
LA6 accessibility llm Heading & Label Text Quality (WCAG 2.4.6)
"""

_RUNTIME = "needs runtime: observed on a running application, which is never started"
_SCRIPTS = "JavaScript or TypeScript surface, outside the measured languages"
_JUDGMENT = "needs judgment: a language model evaluates this dimension, and no model is called"

POSTURE_FLOOR = 5.0


def rules() -> list[tuple[str, str, list[str], str | None, str]]:
    """(concept, dimension, also, cwe, title) of each rule."""
    out = []
    for line in RULES.split("\n"):
        if line:
            concept, dims, cwe = line.split()
            own, *also = dims.split("+")
            out.append((concept, own, also, None if cwe == "-" else f"CWE-{cwe}", concept.replace("-", " ").capitalize()))
    return out


def dimensions() -> list[tuple[int, str, str, str, str, str | None]]:
    """(ord, id, lens, evaluator, name, category) of each dimension."""
    rows = [line.split(" ", 3) for line in DIMENSIONS.split("\n") if line]
    return [(k, i, lens, evaluator, name, DIMENSION_CATEGORY.get(i)) for k, (i, lens, evaluator, name) in enumerate(rows)]


def static_reason(dimension: str, evaluator: str) -> str | None:
    """Why a dimension can't be measured at all, if so."""
    if dimension == "D8":
        return "needs runtime: line coverage takes a test run; reachability from tests is reported as R4"
    if evaluator == "llm":
        return _JUDGMENT
    if len(dimension) == 4 and dimension[:2] == "AX" and dimension[2].isalpha():
        return _RUNTIME
    if dimension.startswith("R") and dimension not in ("R3", "R4"):
        return _SCRIPTS
    return "specific to another language" if dimension == "X31" else None


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules(), "concept string, dimension string, also array<string>, cwe string, title string")


def dimensions_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*d, static_reason(d[1], d[3])) for d in dimensions()], "ord int, id string, lens string, evaluator string, name string, category string, static_reason string")
