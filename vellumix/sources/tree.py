"""HTML text to a tree: tokens and tree construction by the public HTML standard's insertion modes.

Covered are the modes of documents without frames: implied elements, the list of active formatting
elements with reconstruction and the adoption agency, foster parenting out of tables, raw text.
Comments and the contents of template are dropped; foreign elements (svg, math) are ordinary ones.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Element classes of the HTML standard.
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("style script xmp iframe noembed noframes")
ESCAPABLE_RAW = _words("title textarea")
HEAD_ONLY = _words("base basefont bgsound link meta noframes script style template title")
FORMATTING = _words("a b big code em font i nobr s small strike strong tt u")
HEADINGS = _words("h1 h2 h3 h4 h5 h6")
BLOCK = _words(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul"
)
SPECIAL = BLOCK | HEADINGS | _words(
    "applet area base basefont bgsound body br button caption col colgroup dd dt embed form frame frameset head hr html iframe img input keygen li link listing "
    "marquee meta noembed noframes noscript object param plaintext pre script select source style table tbody td template textarea tfoot th thead title tr track wbr xmp"
)
SCOPE = _words("applet caption html table td th marquee object template")
IMPLIED_END = _words("dd dt li optgroup option p rb rp rt rtc")
TABLE_PARTS = _words("caption col colgroup tbody td tfoot th thead tr")
TABLE_CONTEXT = {"tbody": "row group", "thead": "row group", "tfoot": "row group", "tr": "row", "td": "cell", "th": "cell", "caption": "caption", "colgroup": "columns", "table": "table", "select": "select", "body": "body", "html": "body"}
WHITE = "\t\n\f\r "


@dataclass(slots=True, eq=False)
class Node:
    tag: str | None  # None for text
    attrs: list[tuple[str, str]] = field(default_factory=list)
    children: list["Node"] = field(default_factory=list)
    text: str = ""
    parent: "Node | None" = None

    def get(self, name: str) -> str | None:
        return next((v for n, v in self.attrs if n == name), None)

    def elements(self) -> list["Node"]:
        return [c for c in self.children if c.tag is not None]

    def child(self, *tags: str) -> "Node | None":
        return next((c for c in self.children if c.tag in tags), None)

    def content(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if n.tag is None:
                out.append(n.text)
            else:
                todo += reversed(n.children)
        return "".join(out)


@dataclass(slots=True)
class Document:
    doctype: tuple[str, str, str] | None  # name, public and system identifier
    html: Node


_TAG = re.compile(r"<(/?)([a-zA-Z][^\t\n\f\r />]*)")
_ATTR = re.compile(r"""[\t\n\f\r /]*([^\t\n\f\r />][^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:"([^"]*)"|'([^']*)'|([^\t\n\f\r >]*)))?""")
_DOCTYPE = re.compile(r"""<!doctype[\t\n\f\r ]*([^\t\n\f\r >]*)[\t\n\f\r ]*(?:(public|system)[\t\n\f\r ]*("[^">]*"|'[^'>]*')?[\t\n\f\r ]*("[^">]*"|'[^'>]*')?)?[^>]*>?""", re.I)
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/][^>]*>?", re.S)
_IN_VALUE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")


def _value(raw: str) -> str:
    """An attribute's value; a name without semicolon stays as it is before = or a letter or digit."""

    def one(m: re.Match) -> str:
        after = raw[m.end() : m.end() + 1]
        if m[0][1] != "#" and not m[0].endswith(";") and (after == "=" or after.isalnum() or _html.unescape(m[0])[1:].isalnum()):
            return m[0]
        return _html.unescape(m[0])

    return _IN_VALUE.sub(one, raw) if "&" in raw else raw


def tokens(text: str) -> Iterator[tuple]:
    """("doctype", name, public, system), ("start", tag, attrs, self-closing), ("end", tag) and ("text", data)."""
    at, n = 0, len(text)
    while at < n:
        to = text.find("<", at)
        to = n if to < 0 else to
        if to > at:
            yield "text", _html.unescape(text[at:to])
            at = to
            continue
        if m := _TAG.match(text, at):
            at, tag, attrs, seen = m.end(), m[2].lower(), [], set()
            while a := _ATTR.match(text, at):
                at, name = a.end(), a[1].lower()
                if name not in seen:
                    seen.add(name)
                    attrs.append((name, _value(next((v for v in a.groups()[1:] if v is not None), ""))))
            end = text.find(">", at)
            if end < 0:
                return  # the end of the file inside a tag drops the tag
            closing, at = text[end - 1] == "/", end + 1
            if m[1]:
                yield "end", tag
                continue
            yield "start", tag, attrs, closing
            if tag in RAW or tag in ESCAPABLE_RAW:
                close = re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I).search(text, at)
                end = close.start() if close else n
                if end > at:
                    yield "text", _html.unescape(text[at:end]) if tag in ESCAPABLE_RAW else text[at:end]
                at = end
            elif tag == "plaintext":
                yield "text", text[at:]
                return
        elif m := _DOCTYPE.match(text, at):
            ids = [x[1:-1] if x else "" for x in m.groups()[2:]]
            public, system = ids if (m[2] or "").lower() == "public" else ("", ids[0])
            yield "doctype", m[1].lower(), public, system
            at = m.end()
        elif m := _COMMENT.match(text, at):
            at = m.end()
        else:
            yield "text", "<"
            at += 1


class _Builder:
    def __init__(self):
        self.doctype: tuple | None = None
        self.html = Node("html")
        self.head: Node | None = None
        self.body: Node | None = None
        self.open: list[Node] = [self.html]
        self.active: list[Node | None] = []  # None is a marker
        self.mode = "start"
        self.fostering = False
        self.skip_line = False
        self.pending: list[str] = []
        self.form: Node | None = None

    # --- places and insertion
    @property
    def now(self) -> Node:
        return self.open[-1]

    def _spot(self, target: Node | None = None) -> tuple[Node, Node | None]:
        """(parent, child to insert before, None for the end)."""
        target = target or self.now
        if self.fostering and target.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            k = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag == "table"), 0)
            table = self.open[k]
            if k == 0:
                return self.html, None
            return (table.parent, table) if table.parent else (self.open[k - 1], None)
        return target, None

    def _put(self, node: Node, spot: tuple[Node, Node | None]) -> None:
        parent, before = spot
        node.parent = parent
        if before is None:
            parent.children.append(node)
        else:
            parent.children.insert(next(i for i, c in enumerate(parent.children) if c is before), node)

    def _take(self, node: Node) -> None:
        if node.parent is not None:
            k = next(i for i, c in enumerate(node.parent.children) if c is node)
            del node.parent.children[k]
            node.parent = None

    def push(self, tag: str, attrs: list = (), closing: bool = False) -> Node:
        node = Node(tag, list(attrs))
        self._put(node, self._spot())
        if tag not in VOID and not (closing and tag in ("svg", "math", "path", "g", "use", "circle", "rect", "line")):
            self.open.append(node)
        return node

    def write(self, data: str) -> None:
        parent, before = self._spot()
        k = len(parent.children) if before is None else next(i for i, c in enumerate(parent.children) if c is before)
        if k and parent.children[k - 1].tag is None:
            parent.children[k - 1].text += data
        else:
            parent.children.insert(k, Node(None, text=data, parent=parent))

    def _merge(self, node: Node, attrs: list) -> None:
        have = {n for n, _ in node.attrs}
        node.attrs += [(n, v) for n, v in attrs if n not in have]

    # --- the stack
    def in_scope(self, *tags: str, more: frozenset = frozenset()) -> bool:
        for n in reversed(self.open):
            if n.tag in tags:
                return True
            if n.tag in SCOPE or n.tag in more:
                return False
        return False

    def in_table_scope(self, *tags: str) -> bool:
        for n in reversed(self.open):
            if n.tag in tags:
                return True
            if n.tag in ("html", "table", "template"):
                return False
        return False

    def pop_to(self, *tags: str) -> None:
        while len(self.open) > 1 and self.open.pop().tag not in tags:
            pass

    def clear_to(self, *tags: str) -> None:
        while len(self.open) > 1 and self.now.tag not in tags:
            self.open.pop()

    def implied(self, but: str = "") -> None:
        while self.now.tag in IMPLIED_END and self.now.tag != but:
            self.open.pop()

    def close_p(self) -> None:
        if self.in_scope("p", more=frozenset(["button"])):
            self.implied("p")
            self.pop_to("p")

    def reset(self) -> None:
        for n in reversed(self.open):
            if n.tag in TABLE_CONTEXT:
                self.mode = TABLE_CONTEXT[n.tag]
                return
        self.mode = "body"

    # --- active formatting
    def note(self, node: Node) -> None:
        same = []
        for n in reversed(self.active):
            if n is None:
                break
            if n.tag == node.tag and sorted(n.attrs) == sorted(node.attrs):
                same.append(n)
        if len(same) >= 3:
            self._forget(same[-1])
        self.active.append(node)

    def _forget(self, node: Node) -> None:
        self.active = [n for n in self.active if n is not node]

    def _opened(self, node: Node | None) -> bool:
        return any(n is node for n in self.open)

    def reconstruct(self) -> None:
        k = len(self.active)
        while k and self.active[k - 1] is not None and not self._opened(self.active[k - 1]):
            k -= 1
        for i in range(k, len(self.active)):
            self.active[i] = self.push(self.active[i].tag, self.active[i].attrs)

    def to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def adopt(self, tag: str) -> None:
        """The adoption agency: ends a formatting element that other elements overlap."""
        if self.now.tag == tag and not any(n is self.now for n in self.active):
            self.open.pop()
            return
        for _ in range(8):
            found = None
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == tag:
                    found = n
                    break
            if found is None:
                return self.other_end(tag)
            if not self._opened(found):
                return self._forget(found)
            if not self.in_scope(tag):
                return None
            at = next(i for i, n in enumerate(self.open) if n is found)
            block = next((n for n in self.open[at + 1 :] if n.tag in SPECIAL), None)
            if block is None:
                del self.open[at:]
                return self._forget(found)
            above = self.open[at - 1]
            mark = next(i for i, n in enumerate(self.active) if n is found)
            last, k, inner = block, next(i for i, n in enumerate(self.open) if n is block), 0
            while True:
                k -= 1
                inner += 1
                node = self.open[k]
                if node is found:
                    break
                where = next((i for i, n in enumerate(self.active) if n is node), None)
                if where is not None and inner > 3:
                    del self.active[where]
                    mark -= where < mark
                    where = None
                if where is None:
                    del self.open[k]
                    continue
                fresh = Node(node.tag, list(node.attrs))
                self.active[where] = self.open[k] = fresh
                if last is block:
                    mark = where + 1
                self._take(last)
                self._put(last, (fresh, None))
                last = fresh
            self._take(last)
            old, self.fostering = self.fostering, True
            self._put(last, self._spot(above))
            self.fostering = old
            fresh = Node(found.tag, list(found.attrs))
            for c in block.children:
                c.parent = fresh
            fresh.children, block.children = block.children, []
            self._put(fresh, (block, None))
            was = next(i for i, n in enumerate(self.active) if n is found)
            del self.active[was]
            self.active.insert(mark - (was < mark), fresh)
            self.open = [n for n in self.open if n is not found]
            self.open.insert(next(i for i, n in enumerate(self.open) if n is block) + 1, fresh)
        return None

    def other_end(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                self.implied(tag)
                del self.open[k:]
                return
            if self.open[k].tag in SPECIAL:
                return

    # --- the beginning
    def begin(self, tag: str | None) -> None:
        """Make the elements that the next token implies: tag of a start tag, None for text or an end tag."""
        if self.mode == "start":
            self.head = self.push("head")
            self.mode = "head"
        if self.mode == "head" and tag not in HEAD_ONLY and tag != "noscript":
            del self.open[1:]
            self.mode = "after head"
        if self.mode == "after head" and tag not in HEAD_ONLY:
            self.body = self.push("body")
            self.mode = "body"

    # --- tokens
    def text(self, data: str) -> None:
        data = data.replace("\x00", "")
        if self.skip_line:
            self.skip_line = False
            data = data[1:] if data[:1] == "\n" else data
        if self.now.tag in RAW or self.now.tag in ESCAPABLE_RAW or self.now.tag == "template":
            return self.write(data)
        if self.mode in ("start", "head", "after head"):
            rest = data.lstrip(WHITE)
            if self.mode != "start" and len(rest) < len(data):
                if self.mode == "after head":
                    self.html.children.append(Node(None, text=data[: len(data) - len(rest)], parent=self.html))
                else:
                    self.write(data[: len(data) - len(rest)])
            if not rest:
                return None
            self.begin(None)
            data = rest
        if not data:
            return None
        if self.mode in ("table", "row group", "row"):
            self.pending.append(data)
            return None
        if self.mode == "columns":
            rest = data.lstrip(WHITE)
            if len(rest) < len(data):
                self.write(data[: len(data) - len(rest)])
            if not rest:
                return None
            self.open.pop()
            self.mode = "table"
            return self.text(rest)
        if self.mode != "select":
            self.reconstruct()
        self.write(data)
        return None

    def flush(self) -> None:
        """Text between table parts: white space stays, anything else goes before the table."""
        if self.pending:
            data = "".join(self.pending)
            self.pending = []
            if data.strip(WHITE):
                self.fostering = True
                self.reconstruct()
                self.write(data)
                self.fostering = False
            else:
                self.write(data)

    def start(self, tag: str, attrs: list, closing: bool) -> None:
        self.skip_line = False
        self.flush()
        if tag == "html":
            return self._merge(self.html, attrs)
        if self.mode == "start" and tag == "head":
            self.head = self.push("head", attrs)
            self.mode = "head"
            return None
        if tag == "head":
            return None
        if tag == "body":
            if self.body is None:
                if self.mode == "start":
                    self.begin("meta")
                del self.open[1:]
                self.body = self.push("body", attrs)
                self.mode = "body"
            else:
                self._merge(self.body, attrs)
            return None
        if self.mode in ("start", "head", "after head"):
            self.begin(tag)
            if self.mode in ("head", "after head"):
                late = self.mode == "after head"
                if late:
                    self.open.append(self.head)
                node = self.push(tag, attrs)
                if late:
                    self.open = [n for n in self.open if n is not self.head]
                    if tag not in VOID:
                        self.open = [self.html, node]
                return None
        return self.dispatch(tag, attrs, closing)

    def dispatch(self, tag: str, attrs: list, closing: bool = False) -> None:
        mode = self.mode
        if mode == "table":
            return self.table_start(tag, attrs, closing)
        if mode == "row group":
            if tag == "tr":
                self.clear_to("tbody", "thead", "tfoot")
                self.push(tag, attrs)
                self.mode = "row"
                return None
            if tag in ("td", "th"):
                self.dispatch("tr", [])
                return self.dispatch(tag, attrs)
            if tag in TABLE_PARTS:
                if not self.in_table_scope("tbody", "thead", "tfoot"):
                    return None
                self.clear_to("tbody", "thead", "tfoot")
                self.open.pop()
                self.mode = "table"
                return self.dispatch(tag, attrs)
            return self.table_start(tag, attrs, closing)
        if mode == "row":
            if tag in ("td", "th"):
                self.clear_to("tr")
                self.push(tag, attrs)
                self.active.append(None)
                self.mode = "cell"
                return None
            if tag in TABLE_PARTS:
                if self.end_row():
                    self.dispatch(tag, attrs)
                return None
            return self.table_start(tag, attrs, closing)
        if mode == "cell" and tag in TABLE_PARTS:
            if self.in_table_scope("td", "th"):
                self.end_cell()
                self.dispatch(tag, attrs)
            return None
        if mode == "caption" and tag in TABLE_PARTS:
            if self.end_caption():
                self.dispatch(tag, attrs)
            return None
        if mode == "columns":
            if tag == "col":
                self.push(tag, attrs)
                return None
            if tag != "template":
                self.open.pop()
                self.mode = "table"
                return self.dispatch(tag, attrs, closing)
        if mode == "select":
            if tag in ("option", "optgroup", "hr"):
                if self.now.tag == "option":
                    self.open.pop()
                if tag != "option" and self.now.tag == "optgroup":
                    self.open.pop()
                self.push(tag, attrs)
            elif tag in ("select", "input", "keygen", "textarea") or tag in TABLE_PARTS | {"table"}:
                if self.in_scope("select"):
                    self.pop_to("select")
                    self.reset()
                    if tag != "select":
                        self.dispatch(tag, attrs, closing)
            elif tag in ("script", "template"):
                self.push(tag, attrs)
            return None
        return self.body_start(tag, attrs, closing)

    def table_start(self, tag: str, attrs: list, closing: bool) -> None:
        if tag == "caption":
            self.clear_to("table")
            self.active.append(None)
            self.push(tag, attrs)
            self.mode = "caption"
        elif tag == "colgroup":
            self.clear_to("table")
            self.push(tag, attrs)
            self.mode = "columns"
        elif tag == "col":
            self.dispatch("colgroup", [])
            self.dispatch("col", attrs)
        elif tag in ("tbody", "tfoot", "thead"):
            self.clear_to("table")
            self.push(tag, attrs)
            self.mode = "row group"
        elif tag in ("td", "th", "tr"):
            self.clear_to("table")
            self.push("tbody")
            self.mode = "row group"
            self.dispatch(tag, attrs)
        elif tag == "table":
            if self.in_table_scope("table"):
                self.pop_to("table")
                self.reset()
                self.dispatch(tag, attrs)
        elif tag in ("style", "script", "template") or tag == "input" and (dict(attrs).get("type") or "").lower() == "hidden":
            self.push(tag, attrs)
        elif tag == "form":
            if self.form is None:
                self.form = self.push(tag, attrs)
                self.open.pop()
        else:
            self.fostering = True
            self.body_start(tag, attrs, closing)
            self.fostering = False

    def body_start(self, tag: str, attrs: list, closing: bool) -> None:
        if tag in BLOCK:
            self.close_p()
            self.push(tag, attrs)
        elif tag in HEADINGS:
            self.close_p()
            if self.now.tag in HEADINGS:
                self.open.pop()
            self.push(tag, attrs)
        elif tag in ("pre", "listing"):
            self.close_p()
            self.push(tag, attrs)
            self.skip_line = True
        elif tag == "form":
            if self.form is None:
                self.close_p()
                self.form = self.push(tag, attrs)
        elif tag in ("li", "dd", "dt"):
            ends = ("li",) if tag == "li" else ("dd", "dt")
            for n in reversed(self.open):
                if n.tag in ends:
                    self.implied(n.tag)
                    self.pop_to(n.tag)
                    break
                if n.tag in SPECIAL and n.tag not in ("address", "div", "p"):
                    break
            self.close_p()
            self.push(tag, attrs)
        elif tag == "plaintext":
            self.close_p()
            self.push(tag, attrs)
        elif tag == "button":
            if self.in_scope("button"):
                self.implied()
                self.pop_to("button")
            self.reconstruct()
            self.push(tag, attrs)
        elif tag in FORMATTING:
            if tag == "a":
                for n in reversed(self.active):
                    if n is None:
                        break
                    if n.tag == "a":
                        self.adopt("a")
                        self._forget(n)
                        self.open = [x for x in self.open if x is not n]
                        break
            self.reconstruct()
            if tag == "nobr" and self.in_scope("nobr"):
                self.adopt("nobr")
                self.reconstruct()
            self.note(self.push(tag, attrs))
        elif tag in ("applet", "marquee", "object"):
            self.reconstruct()
            self.push(tag, attrs)
            self.active.append(None)
        elif tag == "table":
            if self.doctype is not None and self.doctype[0] == "html":  # without a doctype, a table stays in the paragraph
                self.close_p()
            self.push(tag, attrs)
            self.mode = "table"
        elif tag == "hr":
            self.close_p()
            self.push(tag, attrs)
        elif tag == "image":
            self.body_start("img", attrs, closing)
        elif tag == "xmp":
            self.close_p()
            self.reconstruct()
            self.push(tag, attrs)
        elif tag == "select":
            self.reconstruct()
            self.push(tag, attrs)
            self.mode = "select"
        elif tag in ("optgroup", "option"):
            if self.now.tag == "option":
                self.open.pop()
            self.reconstruct()
            self.push(tag, attrs)
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self.in_scope("ruby"):
                self.implied("rtc" if tag in ("rp", "rt") else "")
            self.push(tag, attrs)
        elif tag in HEAD_ONLY or tag in ("param", "source", "track", "textarea", "iframe", "noembed"):
            self.push(tag, attrs)
        elif tag not in TABLE_PARTS and tag not in ("frame", "frameset", "head"):
            self.reconstruct()
            self.push(tag, attrs, closing)

    def end(self, tag: str) -> None:
        self.skip_line = False
        self.flush()
        if self.now.tag in RAW or self.now.tag in ESCAPABLE_RAW:
            if self.now.tag == tag:
                self.open.pop()
                if self.mode == "after head" and self.open == [self.html] or self.mode == "head" and self.open == [self.html]:
                    self.open = [self.html] if self.mode == "after head" else [self.html, self.head]
            return None
        if tag == "template":
            if any(n.tag == tag for n in self.open):
                self.pop_to(tag)
            return None
        if self.mode in ("start", "head", "after head"):
            if tag == "head" and self.mode in ("start", "head"):
                self.begin("meta")
                del self.open[1:]
                self.mode = "after head"
                return None
            if tag == "noscript":
                if any(n.tag == tag for n in self.open):
                    self.pop_to(tag)
                return None
            if tag not in ("body", "html", "br"):
                return None
            self.begin(None)
        if tag in ("body", "html"):
            return None
        mode = self.mode
        if mode in ("table", "row group", "row"):
            return self.table_end(tag)
        if mode == "cell":
            if tag in ("td", "th"):
                if self.in_table_scope(tag):
                    self.implied()
                    self.pop_to(tag)
                    self.to_marker()
                    self.mode = "row"
                return None
            if tag in ("table", "tbody", "tfoot", "thead", "tr"):
                if self.in_table_scope(tag):
                    self.end_cell()
                    self.end(tag)
                return None
            if tag in ("caption", "col", "colgroup"):
                return None
        if mode == "caption":
            if tag == "caption":
                self.end_caption()
                return None
            if tag == "table":
                if self.end_caption():
                    self.end(tag)
                return None
            if tag in TABLE_PARTS:
                return None
        if mode == "columns":
            if tag == "colgroup":
                self.open.pop()
                self.mode = "table"
            elif tag != "col":
                self.open.pop()
                self.mode = "table"
                self.end(tag)
            return None
        if mode == "select":
            if tag == "option" and self.now.tag == "option" or tag == "optgroup" and self.now.tag == "optgroup":
                self.open.pop()
            elif tag == "optgroup" and self.now.tag == "option" and self.open[-2].tag == "optgroup":
                del self.open[-2:]
            elif tag == "select" or tag in TABLE_PARTS | {"table"} and self.in_table_scope(tag):
                if self.in_scope("select"):
                    self.pop_to("select")
                    self.reset()
                    if tag != "select":
                        self.end(tag)
            return None
        return self.body_end(tag)

    def body_end(self, tag: str) -> None:
        if tag == "p":
            if not self.in_scope("p", more=frozenset(["button"])):
                self.push("p")
            self.close_p()
        elif tag in HEADINGS:
            if self.in_scope(*HEADINGS):
                self.implied()
                self.pop_to(*HEADINGS)
        elif tag in BLOCK or tag in ("button", "listing", "pre", "fieldset"):
            if self.in_scope(tag):
                self.implied()
                self.pop_to(tag)
        elif tag == "form":
            node, self.form = self.form, None
            if node is not None and self._opened(node) and self.in_scope("form"):
                self.implied()
                self.open = [n for n in self.open if n is not node]
        elif tag in ("li", "dd", "dt"):
            if self.in_scope(tag, more=frozenset(["ol", "ul"]) if tag == "li" else frozenset()):
                self.implied(tag)
                self.pop_to(tag)
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in ("applet", "marquee", "object"):
            if self.in_scope(tag):
                self.implied()
                self.pop_to(tag)
                self.to_marker()
        elif tag == "br":
            self.reconstruct()
            self.push("br")
        else:
            self.other_end(tag)

    def end_row(self) -> bool:
        if not self.in_table_scope("tr"):
            return False
        self.clear_to("tr")
        self.open.pop()
        self.mode = "row group"
        return True

    def end_cell(self) -> None:
        self.implied()
        self.pop_to("td", "th")
        self.to_marker()
        self.mode = "row"

    def end_caption(self) -> bool:
        if not self.in_table_scope("caption"):
            return False
        self.implied()
        self.pop_to("caption")
        self.to_marker()
        self.mode = "table"
        return True

    def table_end(self, tag: str) -> None:
        if self.mode == "row" and tag in ("tr", "table", "tbody", "tfoot", "thead"):
            if tag in ("tr", "table") or self.in_table_scope(tag):
                if self.end_row() and tag != "tr":
                    self.end(tag)
            return None
        if self.mode == "row group" and tag in ("table", "tbody", "tfoot", "thead"):
            if tag == "table" or self.in_table_scope(tag):
                self.clear_to("tbody", "thead", "tfoot")
                if len(self.open) > 1:
                    self.open.pop()
                self.mode = "table"
                if tag == "table":
                    self.end(tag)
            return None
        if tag == "table":
            if self.in_table_scope("table"):
                self.pop_to("table")
                self.reset()
            return None
        if tag in TABLE_PARTS:
            return None
        self.fostering = True
        self.body_end(tag)
        self.fostering = False
        return None


def parse_document(text: str | None) -> Document:
    """The tree of a document; a null or empty text has an empty head and body, and no doctype."""
    b = _Builder()
    begun = False
    for kind, *rest in tokens((text or "").replace("\r\n", "\n").replace("\r", "\n")):
        if kind == "doctype":
            if not begun:
                b.doctype = tuple(rest)
        elif kind == "text":
            b.text(rest[0])
        elif kind == "start":
            b.start(*rest)
        else:
            b.end(rest[0])
        begun = begun or kind != "text" or bool(rest[0].strip(WHITE))
    b.flush()
    if b.body is None:
        if b.mode == "start":
            b.begin("meta")
        del b.open[1:]
        b.body = b.push("body")
    _drop_templates(b.html)
    return Document(b.doctype, b.html)


def _drop_templates(root: Node) -> None:
    todo = [root]
    while todo:
        n = todo.pop()
        if n.tag == "template":
            n.children = []
        todo += n.children


def parse(text: str | None) -> Node:
    """The html element of a document."""
    return parse_document(text).html
