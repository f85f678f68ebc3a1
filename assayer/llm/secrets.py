"""Secret scans by assignment-aware lexing.

Base kinds are plain patterns (assign, access, hex). On top of them a lexer reads source and configuration syntax into
name-literal pairs, follows constants to where they are used, and scores each literal by the sensitive name it ends up under;
those that score enough are reported as kind `literal`.

What reads as a pair: `name = "x"`, `"name": "x"`, `name: x`, `name := 'x'`, `name => x`, `a["name"] = x`, `set(name) = x`, `name: Type = "x"`, with blanks
around the sign; values of several parts (`"a" + "b"`, adjacent literals), fallbacks (`f() or "x"`, `e ?? "x"`, `v || "x"`), literals in triple quotes, block scalars of YAML
(`name: |`), `<name>x</name>` and tags that carry name and value in two attributes (`<add key="name" value="x"/>`). Of `a: b = "x"` and `a = b = "x"` both names hold the value.

Scopes: a constant is known from its assignment on to the end of the braces, or of the indented definition, that it stands in, and to what lies
within; a parameter hides a constant of its name. What a text holds elsewhere changes no span: texts are passed over only if they
have no sensitive word at all.

Defined cases: a null text counts as empty and has no spans; whole texts are read, however long, a token at a time;
repeated rows get equal spans; an empty table gives an empty result; other columns pass through, and one called like the result is replaced by it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.shared import spare, without
from assayer.llm.text import column

KINDS = ("assign", "access", "hex", "literal")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: For RE2, which tells quickly in which texts the patterns above can match at all.
_MAY_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
_MAY_ACCESS, _MAY_HEX = "AKIA[A-Z0-9]{12}", "[0-9a-f]{32}"

#: Weight of a name by what it holds.
_NAME_WEIGHTS = (
    (re.compile(r"passw(or)?d|passphrase|(^|[_.\-])pwd|pwd$", re.I), 3),
    (re.compile(r"secret|private[_\-]?key|credential", re.I), 3),
    (re.compile(r"api[_\-]?key|access[_\-]?key|auth[_\-]?key|signing[_\-]?key|encryption[_\-]?key", re.I), 3),
    (re.compile(r"token|bearer", re.I), 2),
    (re.compile(r"(^|[_.\-])(auth|key|salt)($|[_.\-])", re.I), 1),
)
#: Every name that has a weight holds one of these, and a text without one has no pair to report.
_MAY_LEX = r"(?i)passw|passphrase|pwd|secret|private|credential|key|token|bearer|auth|salt"
_HARMLESS_NAME = re.compile(r"(token(s|izer|_?type|_?count|_?limit)|_(url|uri|path|file|dir|name|id|type|len|length|size))$", re.I)
_PLACEHOLDER = re.compile(r"^(x+|\*+|\.+|-+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|(change[_-]?me|example|placeholder|your[_-].*|none|null|true|false|undefined|redacted))$", re.I)
_LEAST_SCORE = 4
_LEAST_CHARS = 8
_MOST_NAME = 64


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def literal_score(name: str, literal: str) -> int:
    """How likely the literal assigned to that name is a secret: the name's weight, and what the literal looks like."""
    if len(literal) < _LEAST_CHARS or _PLACEHOLDER.match(literal) or _HARMLESS_NAME.search(name):
        return 0
    weight = max((w for p, w in _NAME_WEIGHTS if p.search(name)), default=0)
    if not weight:
        return 0
    look = (re.search(r"\d", literal) is not None) + (entropy(literal) >= 3.0) + (" " not in literal)
    return weight + look - (2 if re.fullmatch(r"[A-Za-z]+", literal) else 0)


def base_spans(text: str, assign: bool = True, access: bool = True, hexes: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and without overlap in each kind."""
    out = []
    if assign:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= 8]
    if access:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if hexes:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


# Tokens

_TOKEN = re.compile(
    r'''(?P<line>\r?\n[\x20\t]*)'''
    r'''|(?P<blank>[\x20\t\r\f\v]+)'''
    r'''|(?:(?<![A-Za-z0-9_])[bBrRuUfF]{1,2})?(?P<quoted>"""(?:\\.|[^\\])*?"""|\x27\x27\x27(?:\\.|[^\\])*?\x27\x27\x27|(?<![A-Za-z0-9])\x27(?:\\.|[^\x27\n\\])*\x27|"(?:\\.|[^"\n\\])*"|`(?:\\.|[^`\n\\])*`)'''
    r'''|(?P<tag><(?P<el>[A-Za-z_][\w.:\-]*)(?:\s[^<>\n]*)?>(?P<inner>[^<>\n]+)</(?P=el)\s*>)'''
    r'''|(?P<word>[A-Za-z_][A-Za-z0-9_]*(?:[.\-]+[A-Za-z0-9_]+)*[.\-]?)'''
    r'''|(?P<sign>:=|=>|==|!=|<=|>=|::|->|\?\?|\|\||[=:])'''
    r'''|(?P<mark>[\[\](){}<>+|?!,;&.\x27"`@$#/\\*%^~\-])'''
    r'''|(?P<other>[^\s"\x27`:=,;(){}\[\]<>+|]+)''',
    re.S,
)
#: A value without quotes, from where it starts.
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]+")
_BLOCK_MARK = re.compile(r"[|>][+-]?\d?[+-]?[\x20\t]*(?:#[^\n]*)?\r?\n")
_ATTRIBUTE = re.compile(r"""([A-Za-z_][\w.:\-]*)\s*=\s*(?:"([^"\n]*)"|'([^'\n]*)')""")
_TAG = re.compile(r"<[A-Za-z_][\w.:\-]*\s[^<>\n]{0,2000}/?>")
_NAMING, _VALUING = {"key", "name", "id", "property"}, {"value", "val", "content", "password", "secret"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    #: Where the literal inside the quotes starts and ends.
    inner: tuple[int, int] = (0, 0)


def tokens(text: str) -> Iterator[Token]:
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "blank":
            continue
        if m["tag"] is not None:
            yield Token("tag", m["el"], m.start(), m.end(), m.span("inner"))
        elif m["quoted"] is not None:
            a, b = m.span("quoted")
            n = 3 if b - a >= 6 and text[a : a + 3] in ('"""', "'''") else 1
            yield Token("quoted", text[a + n : b - n], a, b, (a + n, b - n))
        else:
            yield Token(kind, m[0], m.start(), m.end())


class _Window:
    """The tokens by number, of which a bounded stretch behind the reader is kept."""

    def __init__(self, text: str, behind: int = 256):
        self.source, self.behind = tokens(text), behind
        self.held: list[Token] = []
        self.base = 0

    def __getitem__(self, i: int) -> Token | None:
        while i >= self.base + len(self.held):
            t = next(self.source, None)
            if t is None:
                return None
            self.held.append(t)
        return self.held[i - self.base] if i >= self.base else None

    def passed(self, i: int) -> None:
        if i - self.base > 4 * self.behind:
            drop = i - self.behind - self.base
            del self.held[:drop]
            self.base += drop


# Scopes and pairs


@dataclass
class _Scope:
    #: "{" for braces; for an indented definition the column at which it stands.
    opened: str | int
    known: dict[str, list | None] = field(default_factory=dict)


Part = tuple[str, int, int]  # a literal, its start and end


class Reader:
    """Reads one text into (name, parts): the name and the literals that it holds, in order."""

    def __init__(self, text: str):
        self.text, self.t = text, _Window(text)
        self.scopes = [_Scope("")]
        self.done = -1  # signs up to here belong to a value that was read

    def lookup(self, name: str) -> list | None:
        for scope in reversed(self.scopes):
            if name in scope.known:
                return scope.known[name]
        return None

    def pairs(self) -> Iterator[tuple[str, list[Part]]]:
        i, column, fresh = 0, 0, True
        while (t := self.t[i]) is not None:
            if t.kind == "line":
                column, fresh = t.end - t.start - 1 - (self.text[t.start] == "\r"), True
            else:
                if fresh:
                    fresh = False
                    while isinstance(self.scopes[-1].opened, int) and column <= self.scopes[-1].opened:
                        self.scopes.pop()
                    if t.kind == "word" and t.text in ("def", "class", "async"):
                        self.scopes.append(_Scope(column))
                        self._parameters(i + 1, forward=True)
                if t.kind == "tag":
                    yield t.text, [(self.text[slice(*t.inner)], *t.inner)]
                elif t.text == "{" and t.kind == "mark":
                    self.scopes.append(_Scope("{"))
                    self._parameters(i - 1, forward=False)
                elif t.text == "}" and t.kind == "mark":
                    self._close()
                elif t.kind == "sign" and t.text in ("=", ":", ":=", "=>") and t.start > self.done and (names := self.names(i)):
                    parts = self.value(i)
                    if parts:
                        for name in names:
                            self.scopes[-1].known[name] = parts
                            yield name, parts
            i += 1
            self.t.passed(i)

    def _close(self) -> None:
        at = next((k for k in range(len(self.scopes) - 1, 0, -1) if self.scopes[k].opened == "{"), None)
        if at is not None:
            del self.scopes[at:]

    def _parameters(self, i: int, forward: bool) -> None:
        """The words between the parentheses of a definition hide constants: those after a `def`, or those before an opening brace."""
        known = self.scopes[-1].known
        if forward:
            for k in range(i, i + 4):
                if (t := self.t[k]) is None or t.kind == "line":
                    return
                if t.text == "(":
                    break
            else:
                return
            depth = 0
            while (t := self.t[k]) is not None:
                depth += (t.text == "(") - (t.text == ")") if t.kind == "mark" else 0
                if t.kind == "word" and depth:
                    known[t.text] = None
                if not depth:
                    return
                k += 1
            return
        t = self.t[i]
        while t is not None and (t.kind == "line" or t.kind == "sign" and t.text in ("=>", "->")):
            i -= 1
            t = self.t[i]
        if t is None or t.text != ")" or t.kind != "mark":
            return
        depth = 0
        while (t := self.t[i]) is not None:
            depth += (t.text == ")") - (t.text == "(") if t.kind == "mark" else 0
            if t.kind == "word" and depth:
                known[t.text] = None
            if not depth:
                return
            i -= 1

    # names before a sign

    def names(self, i: int) -> list[str]:
        """The names that the sign at i gives a value: the one before it, and the one before a type."""
        found = []
        k = i - 1
        t = self.t[k]
        if t is not None and t.kind == "line" and self.t[i].text != ":":
            k -= 1
            t = self.t[k]
        own = self._name(k, t) if t is not None and (t.text != ")" or self.t[i].text in ("=", ":=")) else None
        if own:
            found.append(own)
        if self.t[i].text in ("=", ":="):
            typed = self._typed(k)
            if typed and typed not in found:
                found.append(typed)
        return found

    def _name(self, k: int, t: Token | None) -> str | None:
        while t is not None and t.kind == "mark" and t.text in "?!":
            k -= 1
            t = self.t[k]
        if t is None:
            return None
        if t.kind == "mark" and t.text in ")]":
            inner = self.t[k - 1]
            opened = self.t[k - 2]
            if inner is None or opened is None or opened.text != {")": "(", "]": "["}[t.text]:
                return None
            if inner.kind not in ("word", "quoted"):  # `a[0] = x`
                inner = self.t[k - 3]
            t = inner
            if t is None:
                return None
        if t.kind == "word" and len(t.text) <= _MOST_NAME:
            return t.text.rstrip(".-")
        if t.kind == "quoted" and len(t.text) <= _MOST_NAME and re.fullmatch(r"[\w][\w .\-/]*", t.text):
            return t.text
        return None

    def _typed(self, k: int) -> str | None:
        """The word before `: Type`, where the type ends at k."""
        start = k
        while (t := self.t[k]) is not None and t.kind != "line" and start - k < 40:
            if t.kind == "sign" and t.text == ":":
                return self._name(k - 1, self.t[k - 1]) if k < start else None
            if t.kind not in ("word", "mark", "other") or t.kind == "mark" and t.text in "(){};":
                return None
            after, before = self.t[k + 1], self.t[k - 1]
            if k < start and t.kind == after.kind == "word" and (before is None or before.text != "'"):
                return None  # a type is no sequence of words, but for a lifetime before it
            k -= 1
        return None

    # values after a sign

    def value(self, i: int) -> list[Part]:
        """The literals of the value after the sign at i."""
        sign = self.t[i]
        j = i + 1
        if (t := self.t[j]) is None:
            return []
        if sign.text == ":" and (m := _BLOCK_MARK.match(self.text, t.start)):
            return self._block(sign, m.end())
        parts: list[Part] = []
        while True:
            t = self.t[j]
            if t is None or t.kind == "line":
                break
            if t.kind == "quoted":
                parts.append((t.text, *t.inner))
                self.done = t.end - 1
                j += 1
                if (n := self.t[j]) is not None and n.kind == "quoted":
                    continue
            elif t.kind == "word" and (n := self.t[j + 1]) is not None and n.kind == "sign" and n.text == "=" and sign.text != ":":
                return parts or self.value(j + 1)  # a = b = "x"
            elif t.kind == "word" and (held := self.lookup(t.text)) is not None and not self._more(t):
                parts += held
                j += 1
            elif t.kind == "word" and (n := self.t[j + 1]) is not None and n.text == "(" and n.start == t.end:
                j = self._call(j + 1)
            elif not parts and sign.text != "=>" and (m := _BARE.match(self.text, t.start)) and t.text not in "({[":
                return [(m[0], m.start(), m.end())] if not self._continues(m.end()) else self._after(j, m.end())
            else:
                break
            n = self.t[j]
            if n is None or not (n.kind == "mark" and n.text == "+" or n.kind == "sign" and n.text in ("??", "||") or n.kind == "word" and n.text == "or"):
                break
            j += 1
            while (t := self.t[j]) is not None and t.kind == "line":
                j += 1
        return parts

    def _more(self, t: Token) -> bool:
        """Whether a bare value goes on after a word, as in `k/x` or `k-1`."""
        return (m := _BARE.match(self.text, t.start)) is not None and m.end() > t.end and self.text[t.end] not in "+.|"

    def _continues(self, end: int) -> bool:
        return re.match(r"[\x20\t]*(?:\?\?|\|\||or\b)[\x20\t]", self.text[end : end + 40]) is not None

    def _after(self, j: int, end: int) -> list[Part]:
        """What stands after `or`, `||`, `??` behind a bare value, which it may take the place of."""
        while (t := self.t[j]) is not None and t.start < end:
            j += 1
        return self.value(j)

    def _call(self, j: int) -> int:
        depth = 0
        while (t := self.t[j]) is not None and t.kind != "line":
            depth += (t.text == "(") - (t.text == ")") if t.kind == "mark" else 0
            j += 1
            if not depth:
                break
        return j

    def _block(self, sign: Token, at: int) -> list[Part]:
        """A block scalar: the lines that stand deeper than the line of its key."""
        line = self.text.rfind("\n", 0, sign.start) + 1
        depth = re.compile(r"[\x20\t]*(?:-[\x20\t]+)?").match(self.text, line).end() - line
        start, end = None, at
        while at < len(self.text):
            stop = self.text.find("\n", at)
            stop = len(self.text) if stop < 0 else stop
            body = self.text[at:stop].rstrip()
            indent = len(body) - len(body.lstrip())
            if body.strip():
                if indent <= depth and not (depth == 0 and indent > 0):
                    break
                start = at + indent if start is None else start
                end = at + len(body)
            at = stop + 1
        if start is None:
            return []
        self.done = end - 1
        return [(self.text[start:end], start, end)]


def attribute_pairs(text: str) -> Iterator[tuple[str, list[Part]]]:
    """Tags that carry a name in one attribute and its value in another."""
    for tag in _TAG.finditer(text):
        found = [(m[1].rpartition(":")[2].lower(), m.span(2) if m[2] is not None else m.span(3)) for m in _ATTRIBUTE.finditer(tag[0])]
        names = [text[tag.start() + a : tag.start() + b] for n, (a, b) in found if n in _NAMING]
        for n, (a, b) in found:
            if n in _VALUING and b > a:
                a, b = a + tag.start(), b + tag.start()
                for name in names:
                    if name and len(name) <= _MOST_NAME:
                        yield name, [(text[a:b], a, b)]


def assignments(text: str) -> Iterator[tuple[str, list[Part]]]:
    """(name, literals) of what reads as an assignment, constants followed."""
    yield from Reader(text).pairs()
    yield from attribute_pairs(text)


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    out = set()
    for name, parts in assignments(text):
        whole = "".join(p[0] for p in parts)
        one = max((literal_score(name, p[0]) for p in parts), default=0)
        if max(one, literal_score(name, whole)) >= _LEAST_SCORE:
            out |= {(start, 3, end) for _, start, end in parts if end > start}
    return list(out)


def _can(texts: pa.Array, pattern: str) -> list[bool]:
    return pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_pylist()


def spans_of(texts: pa.Array) -> list[list[tuple[int, int, int]]]:
    may = [_can(texts, p) for p in (_MAY_ASSIGN, _MAY_ACCESS, _MAY_HEX, _MAY_LEX)]
    out: list[list[tuple[int, int, int]]] = []
    for i, (assign, access, hexes, lex) in enumerate(zip(*may, strict=True)):
        if not (assign or access or hexes or lex):
            out.append([])
            continue
        text = texts[i].as_py()
        found = base_spans(text, assign, access, hexes)
        if lex:
            found += literal_spans(text)
        out.append(sorted(found))
    return out


def redact_text(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    parts, at = [], 0
    for start, _, end in spans:
        if start > at or not parts and start == at:
            parts += [text[at:start], mark]
        elif end > at and start < at:
            pass
        at = max(at, end)
    parts.append(text[at:])
    return "".join(parts)


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "secrets") -> DataFrame:
    """The `keep` columns and the spans found in `text`, by start and kind; code points, end exclusive."""
    keep = without(keep or df.columns, out)
    own = spare(keep, "text")
    chosen = df.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias(own))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            spans = spans_of(column(b, own))
            found = pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in spans], arrow)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], names=[*b.schema.names[:-1], out])

    schema = T.StructType([*(chosen.schema[c] for c in keep), T.StructField(out, T.ArrayType(_SPAN))])
    return chosen.mapInArrow(run, schema)


def redact(df: DataFrame, text: str = "text", mark: str = "[REDACTED]", length: str | None = None) -> DataFrame:
    """The same rows and columns with every span in `text` replaced by the mark; `length`, if given, is set to the new code points of changed texts."""
    names = df.columns

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index(text)
            old, spans = b.column(i), spans_of(b.column(i))
            if any(spans):
                values = old.to_pylist()
                for k, found in enumerate(spans):
                    if found:
                        values[k] = redact_text(values[k], found, mark)
                arrays = list(b.columns)
                arrays[i] = pa.array(values, old.type)
                if length:
                    j = b.schema.get_field_index(length)
                    changed = pa.array([bool(x) for x in spans])
                    arrays[j] = pc.if_else(changed, pc.utf8_length(arrays[i]).cast(arrays[j].type), arrays[j])
                b = pa.RecordBatch.from_arrays(arrays, names=names)
            yield b

    return df.mapInArrow(run, df.schema)


def digest(df: DataFrame, spans: str = "secrets") -> DataFrame:
    """Counts by kind and the joined spans, derived from the spans column."""
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    return df.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col(spans)).alias("spans"),
        count("literal").alias("n_literal"),
    )
