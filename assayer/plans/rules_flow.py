"""Located rules on what values do: inputs that reach an interpreter, contradictions, escaping state, domain and event design.

Same form as in `rules`: (concept, condition, weight, message). A parameter's name is followed through the body by name, within one method.
"""

from __future__ import annotations

_PARAM = r"regexp_extract(p, r'(\w+)\s*(=.*)?$', 1)"
_TEXT = r"p rlike r'(^|\] )string\b'"
_PERSONAL = r"(?:[Pp]assword|[Ss]sn|[Ee]mail|[Ii]ban|[Pp]assport|[Cc]ardNumber|[Cc]reditCard|[Dd]ateOfBirth|[Pp]honeNumber)"
_DOMAIN = r"path rlike r'(?i)(^|/)[^/]*domain[^/]*/'"
_ENTITY = r"exists(bases, b -> b rlike r'Entity|AggregateRoot')"
_ACCESSORS = r"size(regexp_extract_all(body, r'\{ get;', 0))"
_LENGTH_READ = r"r'(?s)\b(\w+)\s*=\s*\w+\.Read(?:U?Int\d+\w*|7BitEncodedInt\w*)\(\w*\)\s*;.*?\bnew \w+\[\s*\1\s*\]'"
_SHARED = r"(?:Directory\.SetCurrentDirectory\(|Console\.Set(?:Out|Error|In)\(|SetEnvironmentVariable\(|CurrentDirectory\s*=[^=]|Current(?:UI)?Culture\s*=[^=]|Console\.ForegroundColor\s*=[^=])"

FLOW_RULES = [
    # inputs that reach an interpreter, a request, a log
    ("code-injection", rf"exists(params, p -> {_TEXT}) and body rlike r'CSharpScript\.(EvaluateAsync|RunAsync|Create)\w*(<[^>]*>)?\(|CSharpCodeProvider|CompileAssemblyFromSource'", "2", "concat(name, ' compiles its input')"),
    ("ldap-injection", r"body rlike r'(DirectorySearcher\(|\.Filter\s*=|SearchRequest\()[^;]*(\$\"[^\"]*\{|\"\s*\+)'", "2", "concat(name, ' builds an LDAP filter from text')"),
    ("xpath-injection", r"body rlike r'(SelectNodes|SelectSingleNode|XPathSelectElements?|XPathEvaluate|XPathExpression\.Compile)\([^;]*(\$\"[^\"]*\{|\"\s*\+)'", "2", "concat(name, ' builds an XPath expression from text')"),
    ("server-side-request-forgery", rf"exists(params, p -> {_TEXT} and body rlike concat(r'(Get|Post|Put|Send)\w*Async\(\s*(new Uri\(\s*)?(\$\"(https?://)?\{{)?', {_PARAM}, r'\b')) and body rlike r'(?i)http' and not body rlike r'(?i)allow|IsLoopback|trusted'", "2", "concat(name, ' fetches an address from its input')"),
    ("regex-denial-of-service", rf"exists(params, p -> {_TEXT} and body rlike concat(r'(new Regex\(|Regex\.(IsMatch|Match|Matches|Replace|Split)\([^;,]*,)\s*', {_PARAM}, r'\s*[,)]')) and not body rlike r'TimeSpan|NonBacktracking|Regex\.Escape'", "2", "concat(name, ' runs a pattern from its input')"),
    ("regex-denial-of-service", r"body rlike r'Regex[^;\"]*\(\s*[^;\"]*@?\"[^\"]*\((\?:)?[^()\"]*[+*]\)[+*]' and not body rlike r'TimeSpan|NonBacktracking'", "2", "concat(name, ' runs a pattern that backtracks')"),
    ("sensitive-data-in-logs", rf"body rlike r'\.Log(Trace|Debug|Information|Warning|Error|Critical)\([^;]*[,{{]\s*[\w.]*{_PERSONAL}\s*[,)}}]' and not body rlike r'(?i)mask|redact'", "2", "concat(name, ' logs personal data')"),
    ("sensitive-data-in-url", rf"body rlike r'\$\"[^\"]*[?&/][^\"{{]*\{{[\w.]*{_PERSONAL}(\(|\}})'", "2", "concat(name, ' puts personal data into an address')"),
    ("unbounded-allocation-from-untrusted-length", rf"body rlike {_LENGTH_READ} and not body rlike concat(regexp_extract(body, {_LENGTH_READ}, 1), r'\s*(<|>)')", "1", "concat(name, ' allocates what its input says')"),
    ("insecure-cookie-flags", r"body rlike r'new CookieOptions' and not (body rlike r'Secure\s*=' and body rlike r'HttpOnly\s*=' and body rlike r'SameSite\s*=')", "1", "concat(name, ' leaves cookie flags unset')"),
    ("https-enforcement", r"body rlike r'\.AddHsts\(' and not body rlike r'\.UseHsts\('", "2", "concat(name, ' configures HSTS without using it')"),
    ("outbound-http-resilience", r"body rlike r'AddHttpClient\s*[<(]|new HttpClient\(\s*\)' and not body rlike r'Timeout|Polly|Resilience|AddPolicyHandler|AddTransientHttpErrorPolicy'", "1", "concat(name, ' sets no time limit')"),
    # contradictions
    ("unreachable-code", r"body rlike r'\bif\s*\(\s*(true|false)\s*\)'", "1", "concat(name, ' has a fixed condition')"),
    ("unreachable-code", r"body rlike r'\bif\s*\(([^(){}]+)\)\s*\{[^{}]*\}\s*else\s+if\s*\(\1\)'", "1", "concat(name, ' tests the same condition twice')"),
    ("unreachable-code", r"body rlike r'\.ToUpper(Invariant)?\(\)\s*==\s*\"[^\"]*[a-z]|\.ToLower(Invariant)?\(\)\s*==\s*\"[^\"]*[A-Z]'", "1", "concat(name, ' compares with what casing rules out')"),
    ("null-dereference", rf"exists(params, p -> {_PARAM} <> '' and body rlike concat(r'(?s)\b', {_PARAM}, r'\?\..*[^\w.?]', {_PARAM}, r'\.\w') and not body rlike concat(r'\b', {_PARAM}, r'\s*(==|!=|is)\s*(not\s+)?(null|\{{)|ThrowIfNull\(\s*', {_PARAM}))", "1", "concat(name, ' trusts what it took for null')"),
    ("redundant-condition-operand", r"body rlike r'(?:\(|&&|\|\||return|=>)\s*([\w.]+(?:\s*(?:==|!=|<=|>=|<|>)\s*[\w.\"]+)?)\s*(&&|\|\|)\s*\1\s*(?:&&|\|\||\)|;)'", "1", "concat(name, ' repeats an operand')"),
    ("index-access-outside-bounds-guard", r"body rlike r'\b(\w+)\.(Length|Count)\s*>\s*0\s*&&\s*\1\[0\][^|&;]*\|\|\s*\1\[0\]'", "1", "concat(name, ' indexes beside its guard')"),
    ("contradictory-support-guard", r"body rlike r'!\(\s*[\w.]*(Is|Can|Has|Supports)\w*\s*\|\|[^()]*(==|<|>)[^()]*\)'", "1", "concat(name, ' denies a mixed guard')"),
    ("loop-decision-on-fixed-element", r"body rlike r'\bfor\s*\(\s*(?:int|var)\s+(\w+)[^)]*\)\s*\{[^{}]*\bif\s*\([^;{}]*\b(\w+)\[0\][^;{}]*\)\s*\{?[^;{}]*\b\2\[\1\]'", "1", "concat(name, ' decides every turn by one element')"),
    # state that outlives its owner
    ("unrestored-process-global-state", rf"size(regexp_extract_all(body, r'{_SHARED}', 0)) >= 2 and not body rlike r'\bfinally\b|\busing\b'", "1", "concat(name, ' may leave the process changed')"),
    ("lock-release-state-mismatch", r"body rlike r'(?s)\btry\b.*?return true;.*?\bfinally\s*\{\s*if\s*\(\s*\w+\s*\)[^}]*(Release|Exit)\w*\(' and not body rlike concat(regexp_extract(body, r'\bfinally\s*\{\s*if\s*\(\s*(\w+)\s*\)', 1), r'\s*=\s*false;\s*return true')", "1", "concat(name, ' says it holds what it released')"),
    ("unsynchronized-callback-handoff", r"body rlike r'(?s)\b(\w+)\s*=\s*new (List|Queue|Dictionary|StringBuilder|HashSet)\b.*\+=\s*(\([^)]*\)|\w+)\s*=>[^;]*\b\1\.(Add|Enqueue|Append\w*)\(' and not body rlike r'\block\b|Concurrent|Synchronized'", "1", "concat(name, ' fills a collection from a callback')"),
    # design
    ("query-with-side-effects", r"type rlike r'Query(Handler)?$' and name rlike r'^(Handle|Execute)' and body rlike r'\.(SaveChanges|Publish|Update|Remove|Delete|Insert)\w*\('", "1", "concat(type, ' writes')"),
    ("business-logic-in-controller", "type rlike r'Controller$' and array_contains(modifiers, 'public') and statements >= 8 and cyclomatic >= 5", "1", "concat(name, ' decides in the controller')"),
    ("multi-aggregate-transaction", r"size(array_distinct(regexp_extract_all(body, r'\b(_?\w*[rR]epository|_?\w+Repo)\.(?:Add|Update|Remove|Save|Delete)\w*\(', 1))) >= 2", "1", "concat(name, ' writes several aggregates')"),
    ("synchronous-remote-call-in-event-handler", r"(name rlike r'^(Handle|Consume)' and exists(params, p -> p rlike r'Event\b')) and body rlike r'await [^;]*([hH]ttp|[gG]rpc)\w*\.\w+Async\('", "1", "concat(name, ' waits for a remote answer')"),
    ("ambient-nondeterminism-in-domain", rf"{_DOMAIN} and not name rlike r'^(Apply|When|On)$' and body rlike r'DateTime(Offset)?\.(Now|UtcNow|Today)|new Random\(|Random\.Shared|Environment\.(GetEnvironmentVariable|MachineName)'", "1", "concat(name, ' reads its surroundings')"),
    ("domain-depends-on-infrastructure", rf"{_DOMAIN} and exists(params, p -> p rlike r'\b\w*(DbContext|DbConnection|SqlConnection|HttpClient|IMongo\w+)\b')", "1", "concat(name, ' takes infrastructure')"),
]

DESIGN_RULES = [
    ("value-object-mutability", rf"{_DOMAIN} and kind = 'class' and not name rlike r'(Command|Query|Dto|Request|Response|Options)$' and not {_ENTITY} and not body rlike r'\bId \{{' and {_ACCESSORS} between 2 and 8 and body rlike r'\{{ get; set; \}}'", "1", "concat(name, ' can be changed')"),
    ("constructible-invalid-entity", rf"{_ENTITY} and body rlike concat(r'public ', name, r'\s*\([^)]*\b(string|int|decimal|long|double)\b') and not body rlike r'(?i)throw|guard|validate' and not body rlike concat(r'static \w*', name, r'\w*\s+\w+\(')", "1", "concat(name, ' takes any values')"),
    ("repository-for-non-aggregate", r"kind = 'interface' and name rlike r'Repository$' and body rlike r'\bIQueryable<'", "1", "concat(name, ' gives its query away')"),
]

#: Rules on whole files, by what the file is; `bare` is the text without strings and line comments.
FILE_RULES = {
    r"\.cs$": [
        ("null-forgiving-suppression", r"size(regexp_extract_all(bare, r'[\w)\]]!(?=[.;,)\[])', 0)) >= 3", r"least(2, size(regexp_extract_all(bare, r'[\w)\]]!(?=[.;,)\[])', 0)) / 3.0)", "'null checks are overruled'"),
        ("suppressed-diagnostic", r"size(regexp_extract_all(text, r'#pragma warning disable', 0)) > size(regexp_extract_all(text, r'#pragma warning restore', 0))", r"if(text rlike r'#pragma warning disable\s*(\r?\n|$)', 2, 1)", "'warnings stay off'"),
        ("suppressed-diagnostic", r"text rlike r'\[(assembly:\s*)?SuppressMessage\((?![^\]]*Justification)'", "1", "'suppressed without a reason'"),
        ("commented-out-code", r"text rlike r'(?m)(^[ \t]*//(?!/)[^\n]*[;{}][ \t]*\r?\n){2,}'", "0.5", "'code in comments'"),
        ("unreachable-code", r"text rlike r'(?m)^[ \t]*#if\s+(false|NEVER)\b'", "1", "'compiled by nobody'"),
    ],
    r"\.s?css$": [
        ("focus-outline-removed", r"text rlike r':focus(?!-)[^{}]*\{[^}]*outline\s*:\s*(none|0)\b' and not text rlike r':focus(-visible|-within)?[^{}]*\{[^}]*(box-shadow|border(-\w+)?|background(-color)?|outline\s*:\s*[1-9]\w*)'", "1", "'focus can not be seen'"),
    ],
    r"(^|/)\.github/workflows/[^/]*\.ya?ml$": [
        ("ci-secret-exposure", r"text rlike r'pull_request_target' and text rlike r'ref:\s*\$\{\{\s*github\.(event\.pull_request\.head|head_ref)'", "3", "'runs foreign code with secrets'"),
    ],
    r"\.ya?ml$": [
        ("overly-permissive-rbac", r"text rlike r'(?m)^kind:\s*(Cluster)?Role\s*$' and text rlike r'(?m)(verbs|resources):\s*(\[[^\]]*[\x22\x27]\*|\r?\n\s*-\s*[\x22\x27]\*)'", "2", "'role without bounds'"),
        ("overly-permissive-rbac", r"text rlike r'(?m)^kind:\s*ClusterRoleBinding\s*$' and text rlike r'(?m)^\s*name:\s*cluster-admin\s*$'", "2", "'binds the cluster administrator'"),
    ],
    r"\.csproj$|(^|/)Directory\.Packages\.props$": [
        ("prerelease-dependency", r"text rlike r'<Package(Reference|Version)\b[^>]*Version=\"[0-9.]+-[^\"]*\"'", "1", "'pre-release package'"),
        ("suppressed-diagnostic", r"text rlike r'<(NoWarn|WarningsNotAsErrors)>[^<]*[A-Z]+\d+' and not text rlike r'<!--[^>]*-->\s*<(NoWarn|WarningsNotAsErrors)>'", "1", "'warnings off without a reason'"),
    ],
}
