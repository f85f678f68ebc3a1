"""A lexer and a brace-structured reader for C#: text to rows. No Spark in here; `tables` wires it to DataFrames.

It reads structure, not meaning: types, methods and their extents, with the counts that rules need. What depends on
resolved types is judged by names instead.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<directive>^[ \t]*\#[^\n]*)|(?P<string>\$*\"{3,}.*?\"{3,}|(?:\$@|@\$|@)\"(?:[^\"]|\"\")*\"|\$?\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+')"""
    r"""|(?P<word>@?[A-Za-z_]\w*)|(?P<number>\d[\w.]*)|(?P<op>\?\?=|=>|&&|\|\||\?\?|\?\.|==|!=|<=|>=|\+\+|--|::|->|[^\s\w])""",
    re.S | re.M,
)
_TYPE_WORDS = {"class", "struct", "interface", "record", "enum"}
_CONTROL = {"if", "for", "foreach", "while", "switch", "catch", "using", "lock", "fixed", "do", "else", "try", "finally", "checked", "unchecked", "unsafe", "get", "set", "init", "add", "remove", "when", "return", "new", "throw"}
_NESTING = {"if", "for", "foreach", "while", "switch", "catch", "do"}
_MODIFIERS = {"public", "private", "protected", "internal", "static", "async", "override", "virtual", "abstract", "sealed", "readonly", "partial", "extern", "new", "unsafe", "required", "const", "volatile"}


@dataclass
class Token:
    kind: str
    text: str
    line: int
    start: int


@dataclass
class Method:
    type: str
    name: str
    modifiers: list[str]
    returns: str
    params: list[str]
    line: int
    end_line: int
    body: str
    attributes: str
    cyclomatic: int = 1
    cognitive: int = 0
    statements: int = 0


@dataclass
class Type:
    kind: str
    name: str
    bases: list[str]
    modifiers: list[str]
    line: int
    end_line: int
    body: str
    attributes: str
    methods: int = 0
    fields: list[tuple[str, str, str]] = field(default_factory=list)  # modifiers, type, name
    props: list[tuple[str, str, str, str]] = field(default_factory=list)  # modifiers, type, name, accessors; of records also their parameters


def tokens(text: str) -> list[Token]:
    out, line, at = [], 1, 0
    for m in TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        out.append(Token(m.lastgroup, m[0], line, m.start()))
    return out


def code_lines(found: list[Token]) -> int:
    """Lines that carry a token; a token over several lines counts each."""
    lines: set[int] = set()
    for t in found:
        if t.kind not in ("comment", "directive"):
            lines.update(range(t.line, t.line + t.text.count("\n") + 1))
    return len(lines)


def metrics(body: list[Token], name: str) -> tuple[int, int, int]:
    """(cyclomatic, cognitive, statements) of a body's tokens."""
    cyclomatic, cognitive, statements = 1, 0, 0
    nest: list[bool] = []  # for each open brace whether a control statement opened it
    pending, parens, last_bool = False, 0, ""
    for k, t in enumerate(body):
        before, after = (body[k - 1].text if k else ""), (body[k + 1].text if k + 1 < len(body) else "")
        depth = sum(nest)
        if t.text in ("if", "for", "foreach", "while", "catch") and t.kind == "word":
            cyclomatic += 1
            if t.text == "if" and before == "else":
                cognitive += 0  # the else before it was counted
            else:
                cognitive += 1 + depth
            pending = True
        elif t.text in ("switch", "do") and t.kind == "word":
            cognitive += (1 + depth) if t.text == "switch" else 0
            pending = True
        elif t.text == "else":
            cognitive += 1
            pending = after != "if"
        elif t.text == "case" and t.kind == "word":
            cyclomatic += 1
        elif t.text in ("&&", "||", "??", "??="):
            cyclomatic += 1
            if t.text in ("&&", "||") and t.text != last_bool:
                cognitive += 1
                last_bool = t.text
        elif t.text == "?" and after not in (">", ",", ")", "]", "[", "=", ";", "{") and before not in ("<",) and ":" in (x.text for x in body[k : k + 60]):
            cyclomatic += 1
            cognitive += 1 + depth
        elif t.text == name and after == "(" and before not in (".", "new"):
            cognitive += 1
        if t.text == "(":
            parens += 1
        elif t.text == ")":
            parens -= 1
        elif t.text == ";":
            statements += parens == 0
            last_bool = ""
        elif t.text == "{":
            nest.append(pending)
            pending, last_bool = False, ""
        elif t.text == "}" and nest:
            nest.pop()
    return cyclomatic, cognitive, statements


def _split_params(inner: list[Token]) -> list[str]:
    out, depth, part = [], 0, []
    for t in inner:
        if t.text in "(<[{":
            depth += 1
        elif t.text in ")>]}":
            depth -= 1
        if t.text == "," and depth == 0:
            out.append(" ".join(part))
            part = []
        else:
            part.append(t.text)
    if part:
        out.append(" ".join(part))
    return out


def _header(head: list[Token]) -> tuple[list[Token], str]:
    """The header without its attributes, and the attributes' text."""
    at, attributes = 0, []
    while at < len(head) and head[at].text == "[":
        depth, begin = 0, at
        while at < len(head):
            depth += (head[at].text == "[") - (head[at].text == "]")
            at += 1
            if not depth:
                break
        attributes.append(" ".join(t.text for t in head[begin:at]))
    return head[at:], " ".join(attributes)


def _parameters_at(head: list[Token]) -> int | None:
    """Where a method's parameters open: the first parenthesis outside others that follows a name, or an operator; one that opens a tuple type doesn't."""
    depth = angle = 0
    operator = False
    for k, t in enumerate(head):
        if t.text == "(":
            before = head[k - 1] if k else None
            if not depth and not angle and before is not None and (operator or before.text == ">" or before.kind == "word" and before.text not in _MODIFIERS):
                return k
            depth += 1
        elif t.text == ")":
            depth -= 1
        elif t.text in "<>" and not operator:
            angle = max(0, angle + (1 if t.text == "<" else -1))
        operator |= t.text == "operator"
    return None


def _method_head(head: list[Token]) -> tuple[str, list[str], str, list[str]] | None:
    """(name, modifiers, return type, parameters) if the header reads as a method."""
    first = _parameters_at(head)
    if first is None or any(t.text in ("=", "=>") for t in head[:first]) and "operator" not in (t.text for t in head[:first]):
        return None
    k = first - 1
    sign = next((i for i, t in enumerate(head[:first]) if t.text == "operator"), None)
    if sign is not None:
        name, k = "operator " + "".join(t.text for t in head[sign + 1 : first]), sign
    elif head[k].text == ">":  # generic method
        depth = 0
        while k >= 0:
            depth += (head[k].text == ">") - (head[k].text == "<")
            k -= 1
            if not depth:
                break
    if k < 0 or head[k].kind != "word" or sign is None and head[k].text in _CONTROL:
        return None
    if sign is None:
        name = head[k].text
    before = [t.text for t in head[:k]]
    if not before and head[k].text in _TYPE_WORDS:
        return None
    modifiers = [x for x in before if x in _MODIFIERS]
    depth, end = 0, first
    for end in range(first, len(head)):
        depth += (head[end].text == "(") - (head[end].text == ")")
        if not depth:
            break
    return name, modifiers, "".join(x for x in before if x not in _MODIFIERS), _split_params(head[first + 1 : end])


def _record(head: list[Token], attributes: str, end: int) -> Type | None:
    """A type that is declared without a body."""
    at = next((i for i, x in enumerate(head) if x.text in _TYPE_WORDS and i + 1 < len(head) and head[i + 1].kind == "word"), None)
    if at is None or any(x.text in ("=", "(") for x in head[:at]):
        return None
    name_at = at + 1 + (head[at + 1].text in ("class", "struct"))
    if name_at >= len(head):
        return None
    t = Type(head[at].text, head[name_at].text, [], [x.text for x in head[:at] if x.text in _MODIFIERS], head[0].line, end, "".join(x.text for x in head), attributes)
    t.props = _positional(head[name_at + 1 :])
    return t


def _positional(tail: list[Token]) -> list[tuple[str, str, str, str]]:
    """The properties that a record's parameters declare."""
    if not tail or tail[0].text != "(":
        return []
    depth = 0
    for end, t in enumerate(tail):
        depth += (t.text == "(") - (t.text == ")")
        if not depth:
            break
    out = []
    for p in _split_params(tail[1:end]):
        words = p.split(" = ")[0].split()
        while words and words[0] == "[" and "]" in words:
            words = words[words.index("]") + 1 :]
        if len(words) >= 2:
            out.append(("public", "".join(words[:-1]), words[-1], "init"))
    return out


def parse(text: str) -> tuple[list[Type], list[Method]]:
    """The types and methods of a file; nested types and local functions belong to the type around them."""
    return read(tokens(text), text)


def read(all_tokens: list[Token], text: str) -> tuple[list[Type], list[Method]]:
    found = [t for t in all_tokens if t.kind not in ("comment", "directive")]
    types: list[Type] = []
    methods: list[Method] = []
    stack: list[tuple[str, object, int]] = []  # kind, what, index of the brace
    begin = 0
    line_end = lambda t: t.line + t.text.count("\n")

    def owner() -> Type | None:
        return next((w for k, w, _ in reversed(stack) if k == "type"), None)

    def in_method() -> bool:
        for kind, _, _ in reversed(stack):
            if kind == "type":
                return False
            if kind == "method":
                return True
        return False

    def finish(m: Method, body: list[Token]) -> None:
        m.cyclomatic, m.cognitive, m.statements = metrics(body, m.name)
        m.statements = max(m.statements, 1 if body else 0)
        methods.append(m)

    k = 0
    while k < len(found):
        t = found[k]
        if t.text == "{":
            head, attributes = _header(found[begin:k])
            words = [x.text for x in head]
            kind, what = "block", None
            type_at = next((i for i, x in enumerate(head) if x.text in _TYPE_WORDS and i + 1 < len(head) and head[i + 1].kind == "word"), None)
            if "namespace" in words:
                kind = "namespace"
            elif type_at is not None and not in_method() and "=" not in words[:type_at] and "(" not in words[:type_at]:
                name_at = type_at + 1 + (head[type_at + 1].text in ("class", "struct"))
                bases = []
                if ":" in words:
                    tail = head[words.index(":") + 1 :]
                    stop = next((i for i, x in enumerate(tail) if x.text == "where"), len(tail))
                    bases = [b.replace(" ", "") for b in _split_params(tail[:stop])]
                kind, what = "type", Type(head[type_at].text, head[name_at].text, bases, [w for w in words[:type_at] if w in _MODIFIERS], t.line if not head else head[0].line, 0, "", attributes)
                if head[type_at].text == "record":
                    what.props = _positional(head[name_at + 1 :])
            elif owner() is not None and not in_method() and (h := _method_head(head)):
                kind, what = "method", Method(owner().name, h[0], h[1], h[2], h[3], head[0].line, 0, "", attributes)
                owner().methods += 1
            elif owner() is not None and stack and stack[-1][0] == "type" and len(head) >= 2 and "=" not in words and "(" not in words and words[0] not in _CONTROL:
                own = [w for w in words if w in _MODIFIERS]
                indexer = "this" in words
                name = "this[]" if indexer else words[-1]
                kind, what = "property", (" ".join(own), "".join(w for w in words[: words.index("this") if indexer else -1] if w not in _MODIFIERS), name)
            stack.append((kind, what, k))
            begin = k + 1
        elif t.text == "}":
            if stack:
                kind, what, at = stack.pop()
                if kind in ("type", "method"):
                    what.end_line = line_end(t)
                    what.body = text[found[at].start : t.start + 1]
                if kind == "property" and owner() is not None:
                    inner = [x.text for x in found[at + 1 : k]]
                    told = [f"{'private ' if i and inner[i - 1] in ('private', 'protected', 'internal') else ''}{x}" for i, x in enumerate(inner) if x in ("get", "set", "init")]
                    owner().props.append((*what, " ".join(told) + (" body" if "{" in inner or "=>" in inner else "")))
                if kind == "type":
                    types.append(what)
                elif kind == "method":
                    finish(what, found[at + 1 : k])
            begin = k + 1
        elif t.text == ";" and not in_method() and (not stack or stack[-1][0] in ("type", "namespace")) and (bare := _record(*_header(found[begin:k]), t.line)):
            types.append(bare)
            begin = k + 1
        elif t.text == ";" and owner() is not None and not in_method() and stack and stack[-1][0] == "type":
            head, attributes = _header(found[begin:k])
            arrow = next((i for i, x in enumerate(head) if x.text == "=>"), None)
            h = _method_head(head[:arrow] if arrow is not None else head)
            if h and (arrow is not None or "abstract" in h[1] or owner().kind == "interface" or "partial" in h[1]):
                m = Method(owner().name, h[0], h[1], h[2], h[3], head[0].line, line_end(t), text[head[arrow].start : t.start + 1] if arrow is not None else "", attributes)
                owner().methods += 1
                if arrow is not None:
                    finish(m, head[arrow + 1 :])
                else:
                    methods.append(m)
            elif head and not h:
                words = [x.text for x in head]
                if arrow is not None and arrow >= 2:
                    words = words[:arrow]
                    owner().props.append((" ".join(w for w in words if w in _MODIFIERS), "".join(w for w in words[:-1] if w not in _MODIFIERS), words[-1], "get body"))
                    begin = k + 1
                    k += 1
                    continue
                stop = words.index("=") if "=" in words else len(words)
                if stop >= 2 and head[stop - 1].kind == "word":
                    own = [w for w in words[:stop] if w in _MODIFIERS]
                    owner().fields.append((" ".join(own), "".join(w for w in words[: stop - 1] if w not in _MODIFIERS), words[stop - 1]))
            begin = k + 1
        elif t.text == ";":
            begin = k + 1
        k += 1
    return types, methods


def uses_of(found: list[Token]) -> dict[str, int]:
    """How often each word stands in the code."""
    out: dict[str, int] = {}
    for t in found:
        if t.kind == "word":
            out[t.text] = out.get(t.text, 0) + 1
    return out


def namespace_of(found: list[Token]) -> str:
    """The first namespace that a file declares; empty if none."""
    code = [t for t in found if t.kind not in ("comment", "directive")]
    for k, t in enumerate(code):
        if t.text == "namespace" and t.kind == "word":
            out = []
            for x in code[k + 1 :]:
                if x.text in "{;":
                    return "".join(out)
                out.append(x.text)
    return ""


def usings_of(found: list[Token]) -> list[str]:
    """The namespaces that a file imports at its head."""
    code, out = [t for t in found if t.kind not in ("comment", "directive")], []
    for k, t in enumerate(code):
        if t.text == "using" and t.kind == "word" and (k == 0 or code[k - 1].text in ";{}"):
            names = []
            for x in code[k + 1 : k + 24]:
                if x.text == ";":
                    out.append("".join(names))
                    break
                if x.kind != "word" and x.text != ".":
                    break
                if x.text != "static":
                    names.append(x.text)
    return out


def il_weight(body: str) -> int:
    """A rough size of what a body compiles to, from its tokens: calls with their arguments, creations, literals, names, operators, branches, holes."""
    found = [t for t in tokens(body) if t.kind not in ("comment", "directive")]
    n = 0
    for k, t in enumerate(found):
        after = found[k + 1].text if k + 1 < len(found) else ""
        if t.kind == "word":
            n += {"new": 3, "if": 2, "case": 2, "return": 1, "throw": 1}.get(t.text, 0 if t.text in _CONTROL or t.text in _MODIFIERS else 1)
            n += 2 if after == "(" and t.text not in _CONTROL else 0
        elif t.kind == "string":
            n += 1 + (3 * t.text.count("{") if t.text.startswith("$") else 0)
        elif t.kind == "number":
            n += 1
        elif t.text in ("+", "-", "*", "/", "%", "=", "==", "!=", "<=", ">=", "&&", "||", "??", "+=", "++", "--", "!", ","):
            n += 1
        elif t.text in ("?", "["):
            n += 2
    return n


def clone_stream(found: list[Token], methods: list[Method]) -> tuple[list[str], list[int]]:
    """The tokens that stand in methods with a body, in order, and their lines; declarations of data aren't compared. Constructors that only assign are left out."""
    spans = sorted({(m.line, m.end_line) for m in methods if m.body and not (m.name == m.type and not re.search(r"\b(if|for|foreach|while|switch|try)\b", m.body))})
    out, lines, k = [], [], 0
    for t in found:
        if t.kind in ("comment", "directive"):
            continue
        while k < len(spans) and spans[k][1] < t.line:
            k += 1
        if k < len(spans) and spans[k][0] <= t.line:
            out.append(t.text)
            lines.append(t.line)
    return out, lines
