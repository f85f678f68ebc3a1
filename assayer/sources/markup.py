"""Markup and style sheets: text to rows of elements and rules. No Spark in here."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CSS_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")


@dataclass
class Element:
    node_id: int
    parent_id: int
    tag: str
    attrs: dict[str, str]
    line: int
    depth: int
    text: str = ""
    path: list[int] = field(default_factory=list)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[Element] = []
        self.open: list[Element] = []

    def handle_starttag(self, tag, attrs):
        parent = self.open[-1] if self.open else None
        e = Element(len(self.nodes), parent.node_id if parent else -1, tag, {k: v or "" for k, v in attrs}, self.getpos()[0], len(self.open))
        e.path = [x.node_id for x in self.open]
        self.nodes.append(e)
        if tag not in _VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if data.strip() and not any(e.tag in ("script", "style") for e in self.open):
            for e in self.open:
                e.text = f"{e.text} {' '.join(data.split())}".strip()


def strip_razor(text: str) -> str:
    """Razor taken out of markup, line by line: code blocks, directives and comments go, expressions become a word; no line is lost."""
    blank = lambda s: re.sub(r"[^\n]", "", s)
    text = text.replace("@@", "\0")  # an escaped sign
    text = re.sub(r"@\*.*?\*@", lambda m: blank(m[0]), text, flags=re.S)
    out, at = [], 0
    for m in re.finditer(r"@(code|functions|section\s+\w+)?\s*\{", text):
        if m.start() < at:
            continue
        depth, k = 1, m.end()
        while k < len(text) and depth:
            depth += (text[k] == "{") - (text[k] == "}")
            k += 1
        out += [text[at : m.start()], blank(text[m.start() : k])]
        at = k
    text = "".join([*out, text[at:]])
    text = re.sub(r"(?m)^\s*@(page|using|inject|model|layout|inherits|attribute|namespace|implements|typeparam)\b[^\n]*", "", text)
    text = re.sub(r"(?m)^(\s*)@(if|else|foreach|for|while|switch)\b[^\n{]*\{?", r"\1", text)
    text = re.sub(r"(?m)^([ \t]*)\}([ \t]*else\b[^\n{]*)?\{?[ \t]*$", r"\1", text)
    return re.sub(r"@\(?[A-Za-z_][\w.]*(\([^()\n]*\))?\)?", "expression", text).replace("\0", "@")


def elements(html: str) -> list[Element]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.nodes


def css_rules(css: str, first_line: int = 1) -> list[tuple[str, str, int]]:
    """(selector, body, line) of each rule; comments are passed over, nested blocks give their inner rules."""
    css = re.sub(r"/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), css, flags=re.S)
    return [(" ".join(m[1].split()), m[2].strip(), first_line + css.count("\n", 0, m.start() + len(m[1]) - len(m[1].lstrip()))) for m in _CSS_RULE.finditer(css)]


def style_blocks(html: str) -> list[tuple[str, int]]:
    """(css, line) of each style element."""
    return [(m[1], html.count("\n", 0, m.start(1)) + 1) for m in re.finditer(r"<style[^>]*>(.*?)</style>", html, re.S | re.I)]
