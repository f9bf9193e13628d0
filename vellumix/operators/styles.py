"""Source styling as sorted declaration signatures, and the stylesheet made from them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from vellumix.sources.tree import Node

#: Properties that survive.
PROPERTIES = frozenset(
    "font-family font-size font-weight font-style font-variant color background-color background text-align text-decoration text-decoration-line text-transform "
    "text-indent letter-spacing line-height border border-top border-right border-bottom border-left border-color border-style border-width border-collapse "
    "border-radius padding padding-top padding-right padding-bottom padding-left margin margin-top margin-right margin-bottom margin-left width max-width height vertical-align".split()
)
#: What a value must not hold, and font name hints.
FORBIDDEN = re.compile(r"url\s*\(|expression|javascript|@import|@font-face|<|>|fixed|sticky", re.I)
GENERIC = re.compile(r"\b(serif|sans-serif|monospace|system-ui|cursive|fantasy)\b", re.I | re.A)
FALLBACKS = [
    ("monospace", re.compile("courier|consolas|menlo|monaco|mono", re.I)),
    ("serif", re.compile("times|georgia|garamond|cambria|palatino|book antiqua|charter|serif", re.I)),
    ("sans-serif", re.compile("")),
]
#: Fixed value: the beginning of every generated stylesheet.
BASE = """article {
  max-width: 46rem;
  margin: 0 auto;
  line-height: 1.55;
}
img {
  max-width: 100%;
  height: auto;
}
table {
  border-collapse: collapse;
}
"""
_SELECTOR = re.compile(r"(?P<tag>[a-zA-Z][a-zA-Z0-9]*)?(?:\.(?P<cls>[A-Za-z_][\w-]*))?", re.A)
#: White space as scripts on the web trim it.
SPACES = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def declarations(text: str) -> dict[str, str]:
    """property -> value; the last of a property wins, at the place of the first."""
    out: dict[str, str] = {}
    for part in text.split(";"):
        name, colon, value = part.partition(":")
        name, value = name.strip(SPACES).lower(), value.strip(SPACES)
        if colon and name and value and len(value.encode("utf-16-le")) <= 400 and not name.startswith("mso-"):
            out[name] = value
    return out


def safe(decls: dict[str, str]) -> dict[str, str]:
    """What may stay of declarations, fonts with a generic family."""

    def font(value: str) -> str:
        return value if GENERIC.search(value) else f"{value}, {next(name for name, hint in FALLBACKS if hint.search(value))}"

    return {k: font(v) if k == "font-family" else v for k, v in decls.items() if k in PROPERTIES and not FORBIDDEN.search(v)}


@dataclass(frozen=True)
class Rule:
    tag: str | None
    cls: str | None
    decls: dict


def stylesheet_rules(css: str) -> list[Rule]:
    """Flat tag, .class and tag.class rules; at-rules and other selectors are passed over whole."""
    css = re.sub(r"<!--|-->", "", re.sub(r"/\*.*?\*/", "", css, flags=re.S))
    out, start, depth, opened = [], 0, 0, 0
    for m in re.finditer(r"[{}]", css + "}"):
        if m[0] == "{":
            depth += 1
            if depth == 1:
                opened = m.start()
        elif depth:
            depth -= 1
            # the end of the text closes what is open
            if depth == 0 or m.start() == len(css):
                depth, head, body = 0, css[start:opened].strip(SPACES), css[opened + 1 : m.start()]
                start = m.end()
                decls = {} if head.startswith("@") else declarations(body)
                for one in head.split(",") if decls else ():
                    s = _SELECTOR.fullmatch(one.strip(SPACES))
                    if s and s[0]:
                        out.append(Rule(s["tag"].lower() if s["tag"] else None, s["cls"], decls))
    return out


def rules_of(root: Node) -> list[Rule]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.tag == "style":
            out += stylesheet_rules("".join(c.text for c in n.children if c.tag is None))
        else:
            todo += reversed(n.elements())
    return out


def legacy(node: Node) -> dict[str, str]:
    """Declarations that old attributes stand for."""
    out: dict[str, str] = {}
    if re.fullmatch("left|right|center|justify", node.get("align") or "", re.I):
        out["text-align"] = node.get("align").lower()
    for name, prop, tags in (("bgcolor", "background-color", None), ("face", "font-family", ("font",)), ("color", "color", ("font",))):
        if (tags is None or node.tag in tags) and node.get(name) is not None:
            out[prop] = node.get(name)
    if node.tag in ("td", "th", "table") and re.fullmatch("[0-9]+%?", width := node.get("width") or ""):
        out["width"] = width if width.endswith("%") else width + "px"
    return out


class Styles:
    """The cascade of a document: old attributes, then tag rules, class rules and the style attribute."""

    def __init__(self, rules: list[Rule]):
        self.by_tag: dict[str, list[Rule]] = {}
        self.by_class: dict[str, list[tuple[int, Rule]]] = {}
        for k, r in enumerate(rules):
            if r.cls is None:
                self.by_tag.setdefault(r.tag, []).append(r)
            else:
                self.by_class.setdefault(r.cls, []).append((k, r))

    def signature(self, node: Node) -> str | None:
        """The element's safe declarations, sorted, as prop:value;…; None without any."""
        layers = [legacy(node), *(r.decls for r in self.by_tag.get(node.tag, ()))]
        classes = set(re.split(f"[{SPACES}]+", node.get("class") or ""))
        mine = sorted(((k, r) for c in classes for k, r in self.by_class.get(c, ()) if r.tag in (None, node.tag)), key=lambda x: x[0])
        layers += [r.decls for _, r in mine]
        if (own := node.get("style")) is not None:
            layers.append(declarations(own))
        merged: dict[str, str] = {}
        for layer in layers:
            merged |= layer
        return ";".join(f"{k}:{v}" for k, v in sorted(safe(merged).items())) or None


def stylesheet_of(signatures: list[str]) -> str | None:
    """The stylesheet of classes w1, w2, … for distinct signatures in first-seen order."""
    if not signatures:
        return None
    blocks = []
    for k, signature in enumerate(signatures, 1):
        lines = "".join(f"  {d.replace(':', ': ', 1)};\n" for d in signature.split(";"))
        blocks.append(f".w{k} {{\n{lines}}}")
    return BASE + "\n".join(blocks) + "\n"
