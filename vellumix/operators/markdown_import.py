"""A subset of Markdown to blocks: headings, paragraphs, fences, quotes, lists of two levels, pipe tables, rules."""

from __future__ import annotations

import re

from vellumix.operators.importing import LINK, element, text
from vellumix.operators.styles import SPACES
from vellumix.sources.tree import Node

_ITEM = re.compile(r"([-*+]|\d+[.)])\s+(.*)", re.A)
_INNER = re.compile(r"\s{2,}([-*+]|\d+[.)])\s+(.*)", re.A)
_RULE = re.compile(r"\s*(-{3,}|\*{3,}|_{3,})\s*")
_HEAD = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*")
_FENCE = re.compile(r"```(\S*)\s*")
_DELIMITERS = re.compile(r"\s*\|?[\s:|-]+\|?\s*")
_HARD = re.compile(r"( {2}|\\)$")
#: Inline constructs in the order in which they are tried.
_INLINE = re.compile(
    r"\\(?P<escape>[!-/:-@\[-`{-~])"
    r"|(?P<ticks>`+)(?P<code>.*?)(?P=ticks)(?!`)"
    r'|!\[(?P<alt>[^\]]*)\]\((?P<src>[^)\s]*)(?:\s+"[^"]*")?\)'
    r'|\[(?P<label>[^\]]*)\]\((?P<href>[^)\s]*)(?:\s+"[^"]*")?\)'
    r"|\*\*(?!\s)(?P<strong>.+?)(?<!\s)\*\*"
    r"|(?P<mark>[*_])(?!\s)(?P<em>[^*_]+?)(?<!\s)(?P=mark)",
    re.S,
)


def inline(source: str, report: list[str]) -> list[Node]:
    out: list[Node] = []
    plain: list[str] = []

    def add(*nodes: Node) -> None:
        if plain:
            out.append(text("".join(plain)))
            plain.clear()
        out.extend(nodes)

    at = 0
    while m := _INLINE.search(source, at):
        plain.append(source[at : m.start()])
        if not plain[-1]:
            plain.pop()
        at = m.end()
        if m["escape"] is not None:
            plain.append(m["escape"])
        elif m["ticks"] is not None:
            body = m["code"].replace("\n", " ")
            if body[:1] == " " == body[-1:] and body.strip(SPACES):
                body = body[1:-1]
            add(element("code", {}, [text(body)]))
        elif m["src"] is not None:
            report.append(f'dropped Markdown image "{m["src"]}" (images must live under content/assets/)')
            plain.append(m["alt"]) if m["alt"] else None
        elif m["href"] is not None:
            label = inline(m["label"], report)
            if LINK.fullmatch(m["href"]):
                add(element("a", {"href": m["href"]}, label))
            else:
                report.append(f'unwrapped link "{m["href"]}" (scheme not permitted)')
                add(*label)
        elif m["strong"] is not None:
            add(element("strong", {}, inline(m["strong"], report)))
        else:
            add(element("em", {}, inline(m["em"], report)))
    if source[at:]:
        plain.append(source[at:])
    add()
    return out


def paragraph(lines: list[str], report: list[str]) -> list[Node]:
    out: list[Node] = []
    for k, line in enumerate(lines):
        out += inline(_HARD.sub("", line), report)
        if k + 1 < len(lines):
            out.append(element("br") if _HARD.search(line) else text(" "))
    return out


def split_row(line: str) -> list[str]:
    line = line.strip(SPACES)
    return [c.strip(SPACES) for c in line.removeprefix("|").removesuffix("|").split("|")]


class _Lines:
    def __init__(self, source: str):
        self.all = re.split(r"\r\n?|\n", source)
        self.at = 0

    def now(self, ahead: int = 0) -> str | None:
        k = self.at + ahead
        return self.all[k] if k < len(self.all) else None

    def take(self, fits) -> list[str]:
        begin = self.at
        while self.at < len(self.all) and fits(self.all[self.at]):
            self.at += 1
        return self.all[begin : self.at]


def _fence(lines: _Lines, info: str) -> Node:
    lines.at += 1
    body = lines.take(lambda x: not re.fullmatch(r"```\s*", x))
    lines.at += 1
    return element("pre", {}, [element("code", {"class": f"language-{info}"} if info else {}, [text("\n".join(body))])])


def _quote(lines: _Lines, report: list[str]) -> list[Node]:
    groups: list[list[str]] = [[]]
    for x in lines.take(lambda x: x.startswith(">")):
        x = re.sub("^> ?", "", x)
        groups[-1].append(x) if x.strip(SPACES) else groups.append([])
    inner = [element("p", {}, paragraph(g, report)) for g in groups if g]
    return [element("blockquote", {}, inner)] if inner else []


def _kind(mark: str) -> str:
    return "ol" if mark[0].isdigit() else "ul"


def _items(lines: _Lines, report: list[str], first: re.Match) -> Node:
    items: list[Node] = []
    for x in lines.take(lambda x: _ITEM.fullmatch(x) or _INNER.fullmatch(x)):
        if m := _ITEM.fullmatch(x):
            items.append(element("li", {}, inline(m[2], report)))
        else:
            m = _INNER.fullmatch(x)
            inner = items[-1].child("ul", "ol")
            if inner is None:
                inner = element(_kind(m[1]))
                items[-1].children.append(inner)
            inner.children.append(element("li", {}, inline(m[2], report)))
    return element(_kind(first[1]), {}, items)


def _table(lines: _Lines, report: list[str]) -> Node:
    head = split_row(lines.now())
    lines.at += 2
    rows = [split_row(x) for x in lines.take(lambda x: "|" in x and x.strip(SPACES))]
    report.append("synthesized empty <caption> for a Markdown table")

    def row(cells: list[str], tag: str) -> Node:
        return element("tr", {}, [element(tag, {}, inline(cells[k] if k < len(cells) else "", report)) for k in range(len(head))])

    return element("table", {}, [element("caption"), element("thead", {}, [row(head, "th")]), element("tbody", {}, [row(r, "td") for r in rows])])


def import_markdown(source: str | None) -> dict:
    """blocks and report of a Markdown text."""
    report: list[str] = []
    out: list[Node] = []
    lines = _Lines(source or "")
    opens = lambda x: re.match(r"#{1,6}\s|```|>", x) or _ITEM.fullmatch(x)
    while (x := lines.now()) is not None:
        if not x.strip(SPACES):
            lines.at += 1
        elif m := _FENCE.fullmatch(x):
            out.append(_fence(lines, m[1]))
        elif m := _HEAD.fullmatch(x):
            out.append(element(f"h{len(m[1])}", {}, inline(m[2], report)))
            lines.at += 1
        elif _RULE.fullmatch(x):
            out.append(element("hr"))
            lines.at += 1
        elif x.startswith(">"):
            out += _quote(lines, report)
        elif m := _ITEM.fullmatch(x):
            out.append(_items(lines, report, m))
        elif "|" in x and "-" in (lines.now(1) or "") and _DELIMITERS.fullmatch(lines.now(1)):
            out.append(_table(lines, report))
        else:
            para = lines.take(lambda y: y.strip(SPACES) and not opens(y))
            if para:
                out.append(element("p", {}, paragraph([y.strip(SPACES) for y in para], report)))
            else:
                lines.at += 1
    return {"blocks": out, "title": None, "language": None, "stylesheet": None, "report": report}
