"""Project files, conditions, globs, change logs, YAML: text to rows. No Spark in here."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

try:
    import yaml
except ImportError:  # a checkout without the parser measures everything but YAML
    yaml = None

EXCLUDED_DIRS = (".git", "bin", "obj", "node_modules", ".vs", "packages", "dist", "vendor")


#: Text functions that a condition may call on a property.
_CALLS = {"contains": lambda a, b: b in a, "startswith": str.startswith, "endswith": str.endswith, "equals": str.__eq__}
_WORD = re.compile(r"""'(?:\$\([^()]*(?:\([^()]*\)[^()]*)*\)|[^'$]|\$(?!\())*'|\$\([^()]*(?:\([^()]*\)[^()]*)*\)|==|!=|\(|\)|!|[\w.]+|\s+|.""")


class _Conditions:
    """or / and / not / == / != / parentheses over texts, properties and text functions on properties; what can't be read is false."""

    def __init__(self, text: str, properties: dict[str, str]):
        self.words = [w for w in _WORD.findall(text) if not w.isspace()]
        if any(not re.match(r"['$\w]|==|!=|!|\(|\)", w) or w in ("$", "'") for w in self.words):
            raise ValueError
        self.properties = {k.lower(): v for k, v in properties.items()}
        self.at = 0

    def peek(self) -> str:
        return self.words[self.at].lower() if self.at < len(self.words) else ""

    def take(self) -> str:
        self.at += 1
        return self.words[self.at - 1]

    def any(self) -> bool:
        value = self.all()
        while self.peek() == "or":
            self.take()
            value = self.all() or value
        return value

    def all(self) -> bool:
        value = self.one()
        while self.peek() == "and":
            self.take()
            value = self.one() and value
        return value

    def one(self) -> bool:
        if self.peek() == "!":
            self.take()
            return not self.one()
        if self.peek() == "(":
            self.take()
            value = self.any()
            if self.take() != ")":
                raise ValueError
            return value
        left = self.operand()
        if self.peek() in ("==", "!="):
            same = self.take() == "=="
            return (left.lower() == self.operand().lower()) == same
        return left.lower() == "true"

    def operand(self) -> str:
        word = self.take()
        if word in ("(", ")", "==", "!=", "!"):
            raise ValueError
        return re.sub(r"\$\(([^()]*(?:\([^()]*\))?)\)", self.told, word[1:-1] if word[0] == "'" else word)

    def told(self, m: re.Match) -> str:
        if call := re.fullmatch(r"\s*(\w+)\.(\w+)\(\s*'?([^']*)'?\s*\)\s*", m[1]):
            name, function, given = call.groups()
            if function.lower() not in _CALLS:
                raise ValueError
            return str(_CALLS[function.lower()](self.properties.get(name.lower(), ""), given))
        return self.properties.get(m[1].strip().lower(), "")


def condition(text: str | None, properties: dict[str, str]) -> bool:
    if not text or not text.strip():
        return True
    try:
        c = _Conditions(text, properties)
        return c.any() and c.at == len(c.words)
    except (IndexError, ValueError):
        return False


def central_versions(text: str) -> dict[str, str]:
    """Package versions that a central file of packages states, by lower-case id."""
    return {m[1].lower(): m[2] for m in re.finditer(r'<PackageVersion\b[^>]*?\bInclude="([^"]+)"[^>]*?\bVersion="([^"]+)"', text)}


def project(path: str, text: str, central: dict[str, str] | None = None, props: str | None = None) -> dict | None:
    """What a project file says; null if it is no XML. The last property that isn't empty wins, the first package of an id. `props` is a file of properties
    that is read before it."""
    try:
        root = ET.fromstring(re.sub(r'\sxmlns="[^"]*"', "", text, count=1))
    except ET.ParseError:
        return None
    properties: dict[str, str] = {"MSBuildProjectName": re.sub(r"\.[a-z]+proj$", "", path.rpartition("/")[2])}
    before = []
    if props:
        try:
            before = list(ET.fromstring(re.sub(r'\sxmlns="[^"]*"', "", props, count=1)))
        except ET.ParseError:
            before = []
    packages: dict[str, tuple[str, str | None]] = {}
    references = []
    for group in [*before, *root]:
        if not condition(group.get("Condition"), properties):
            continue
        for item in group:
            if not condition(item.get("Condition"), properties):
                continue
            if group.tag == "PropertyGroup" and (item.text or "").strip():
                properties[item.tag] = item.text.strip()
            elif item.tag == "PackageReference" and (name := item.get("Include") or item.get("Update")):
                version = item.get("Version") or item.findtext("Version") or (central or {}).get(name.lower())
                packages.setdefault(name.lower(), (name, version))
            elif item.tag == "ProjectReference" and item.get("Include"):
                references.append(normalized(re.sub(r"[^/]*$", "", path) + item.get("Include").replace("\\", "/")))
    name = re.sub(r"\.[a-z]+proj$", "", path.rpartition("/")[2])
    sdk = root.get("Sdk") or ""
    return {
        "path": path, "name": name, "dir": path.rpartition("/")[0], "sdk": sdk, "tfms": [x for x in re.split("[;,]", properties.get("TargetFrameworks") or properties.get("TargetFramework") or "") if x],
        "output_type": properties.get("OutputType"), "nullable": (properties.get("Nullable") or "").lower() in ("enable", "annotations"), "is_packable": properties.get("IsPackable", "").lower() == "true" or "PackageId" in properties,
        "version": properties.get("Version") or properties.get("VersionPrefix"), "locks": properties.get("RestorePackagesWithLockFile", "").lower() == "true", "locked_mode": properties.get("RestoreLockedMode", "").lower() == "true", "role": role(name, sdk, properties, list(packages)), "packages": list(packages.values()), "references": references,
    }


def role(name: str, sdk: str, properties: dict[str, str], packages: list[str]) -> str:
    """The first that fits: test, web, domain, application, infrastructure, executable, library."""
    has = lambda *words: any(re.search(rf"(^|[.])({'|'.join(words)})s?($|[.])", name, re.I) for _ in (0,))
    if properties.get("IsTestProject", "").lower() == "true" or has("test", "tests", "specs") or any(p.startswith(("xunit", "nunit", "mstest")) for p in packages):
        return "Test"
    if "web" in sdk.lower() or has("web", "api", "host", "server"):
        return "Web"
    for kind, words in (("Domain", ("domain", "core", "model")), ("Application", ("application", "app", "usecase")), ("Infrastructure", ("infrastructure", "persistence", "data"))):
        if has(*words):
            return kind
    return "Exe" if (properties.get("OutputType") or "").lower() == "exe" else "Library"


def normalized(path: str) -> str:
    out: list[str] = []
    for part in path.split("/"):
        if part == ".." and out:
            out.pop()
        elif part not in ("", ".", ".."):
            out.append(part)
    return "/".join(out)


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression over whole paths: ** over folders, * and ? within one."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[k], re.escape(glob[k])), k + 1
    return f"^{out}$"


def commits(lines):
    """A log cut into its commits, each beginning with its mark."""
    held: list[str] = []
    for line in lines:
        if line.startswith("\x01") and held:
            yield "".join(held)
            held = []
        held.append(line)
    if held:
        yield "".join(held)


def change_log(text: str) -> list[dict]:
    """Rows (sha, author, date, path, added, deleted) from `git log --numstat --format=%x01%H%x02%aE%x02%aI`; renamed paths take their new name, binary churn is 0."""
    out = []
    for part in text.split("\x01")[1:]:
        head, *rest = part.strip().split("\n")
        sha, author, date = head.split("\x02")
        for line in rest:
            if line.count("\t") != 2:
                continue
            added, deleted, path = line.split("\t")
            path = re.sub(r"\{[^{}]* => ([^{}]*)\}", r"\1", path)
            path = path.split(" => ")[-1].replace("//", "/")
            out.append({"sha": sha, "author": author.lower(), "date": date, "path": path, "added": int(added) if added.isdigit() else 0, "deleted": int(deleted) if deleted.isdigit() else 0})
    return out


def yaml_documents(text: str) -> list[tuple[dict, int]]:
    """(mapping, line) of each document whose root is a mapping; files that can't be read give none."""
    if yaml is None:
        return []
    try:
        nodes = list(yaml.compose_all(text, Loader=yaml.SafeLoader))
        values = list(yaml.safe_load_all(text))
    except yaml.YAMLError:
        return []
    return [(v, n.start_mark.line + 1) for v, n in zip(values, nodes, strict=True) if isinstance(v, dict)]
