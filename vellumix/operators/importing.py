"""Foreign HTML and Markdown to conforming documents.

A document's conversion is one sequential pass (ids are claimed and lists rebuilt in document
order), so it is a pure function of one row, run over Arrow batches; nothing is shuffled. The output row
has the canonical HTML, its title, language, stylesheet and the report of what was dropped.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumix.functions.tables import span, table_grid
from vellumix.operators.styles import SPACES, Styles, rules_of, stylesheet_of
from vellumix.sources.html import normal
from vellumix.sources.tree import HEADINGS, Node, parse_document

#: Elements that are dropped, and those with another name.
DROPPED = frozenset(
    "script style noscript template iframe object embed video audio canvas svg math form input button select textarea label head title meta link base".split()
)
RENAMED = {"b": "strong", "i": "em", "dfn": "em", "var": "code", "kbd": "code", "samp": "code", "font": "span"}
INLINE = frozenset("a em strong code sub sup time cite q abbr span br".split())
BLOCKS = HEADINGS | frozenset("p blockquote figure pre hr ul ol dl table".split())
SECTIONING = ("section", "header", "footer", "nav")
LISTS = ("ul", "ol")
KEPT = {"a": ("href",), "img": ("src", "alt", "width", "height"), "time": ("datetime",), "abbr": ("title",), "blockquote": ("cite",), "th": ("scope",), "table": ("data-wdf-dataset",)}
EVERYWHERE = ("id", "class", "lang", "dir")
#: Patterns of links, images and ids.
LINK = re.compile(r"(https?://[^\s<>]+|mailto:[^\s<>]+|#.+)")
IMAGE = re.compile(r"content/assets(/[A-Za-z0-9][A-Za-z0-9._-]*)+")
ID = re.compile("[a-z]+-[a-z0-9][a-z0-9-]*")
#: Prefixes of ids, and how wide their counters are.
COUNTED = {"p": ("p", 4), "li": ("li", 4), "table": ("tbl", 1), "figure": ("fig", 1), "blockquote": ("bq", 1), "section": ("sec", 1)}
#: A paragraph is a title from so many times the body's size, up to so many characters.
RATIO, MOST_CHARS = 1.15, 200
_SIZE = re.compile(r"(?:^|;)font-size:(\d+(?:\.\d+)?)(pt|px)(?:;|$)", re.A)
STYLE = "\x00style"


def element(tag: str, attrs: dict | None = None, children: list | None = None) -> Node:
    return Node(tag, list((attrs or {}).items()), children if children is not None else [])


def text(data: str) -> Node:
    return Node(None, text=data)


def put(node: Node, name: str, value: str | None) -> None:
    """Set an attribute in its place or at the end; None takes it away."""
    have = dict(node.attrs)
    have.pop(name) if value is None and name in have else have.update({name: value} if value is not None else {})
    node.attrs = list(have.items())


def slug(value: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFD", value) if not "\u0300" <= c <= "\u036f").lower()
    return re.sub("[^a-z0-9]+", "-", bare).strip("-")[:40].rstrip("-")


class HtmlImport:
    """The conversion of one page."""

    def __init__(self, styles: Styles | None, assets: dict[str, str], report: list[str]):
        self.styles, self.assets, self.report = styles, assets, report

    def image(self, node: Node, extra: dict | None = None) -> Node | None:
        """An image whose source is in the package, else None."""
        src = node.get("src") or ""
        path = self.assets.get(src) or (src if IMAGE.fullmatch(src) else None)
        if path is None:
            return None
        attrs = self.attributes(node, "img") if extra is None else {}
        attrs["src"] = path
        return element("img", attrs | (extra or {"alt": attrs.get("alt", "")}))

    def attributes(self, node: Node, tag: str) -> dict[str, str]:
        own = EVERYWHERE + KEPT.get(tag, ())
        out = {n: v for n, v in node.attrs if n in own}
        for side in ("width", "height"):
            if tag == "img" and side in out and not re.fullmatch("[1-9][0-9]*", out[side]):
                self.report.append(f'dropped img {side}="{out.pop(side)}" (must be a positive integer, §6.3.3)')
        if self.styles and (signature := self.styles.signature(node)):
            out[STYLE] = signature
        return out

    def phrasing(self, nodes: list[Node], images: bool) -> list[Node]:
        out: list[Node] = []
        for n in nodes:
            if n.tag is None:
                out.append(text(n.text))
                continue
            tag = RENAMED.get(n.tag, n.tag)
            if tag in DROPPED:
                self.report.append(f"dropped <{n.tag}> (not representable in WDF-HTML)")
            elif tag == "img":
                if not images:
                    self.report.append(f'dropped <img src="{n.get("src") or ""}"> (not inside a paragraph or figure)')
                elif made := self.image(n):
                    out.append(made)
            elif tag == "br":
                out.append(element("br"))
            elif tag == "v:imagedata":
                if images and (made := self.image(n, {"alt": n.get("o:title") or ""})):
                    out.append(made)
            elif tag not in INLINE:
                out += self.phrasing(n.children, images)
            elif tag == "a" and not LINK.fullmatch(n.get("href") or ""):
                self.report.append(f'unwrapped <a href="{n.get("href") or ""}"> (scheme not permitted)')
                out += self.phrasing(n.children, images)
            else:
                out.append(element(tag, self.attributes(n, tag), self.phrasing(n.children, images)))
        return out

    def blocks(self, nodes: list[Node]) -> list[Node]:
        """Blocks of a mixed list; runs of phrasing become paragraphs."""
        out: list[Node] = []
        run: list[Node] = []

        def close() -> None:
            if any(r.tag is not None or r.text.strip(SPACES) for r in run):
                out.append(element("p", {}, list(run)))
            run.clear()

        for n in nodes:
            tag = RENAMED.get(n.tag, n.tag)
            if tag is None:
                if run or n.text.strip(SPACES):
                    run.append(text(n.text))
            elif tag in INLINE or tag == "img":
                run += self.phrasing([n], True)
            else:
                close()
                for made in self.block(n, tag):
                    (out if made.tag in BLOCKS or made.tag in SECTIONING else run).append(made)
        close()
        return out

    def block(self, n: Node, tag: str) -> list[Node]:
        report = self.report
        if tag in DROPPED:
            report.append(f"dropped <{n.tag}> (not representable in WDF-HTML)")
            return []
        if tag == "section":
            return [element(tag, self.attributes(n, tag), self.blocks(n.children))]
        if tag in SECTIONING:
            attrs = self.attributes(n, tag)
            return [element(tag, attrs, self.flat(self.blocks(n.children)))]
        if tag in HEADINGS:
            return [element(tag, self.attributes(n, tag), self.phrasing(n.children, False))]
        if tag == "p":
            if re.search(r"\bMsoTitle\b", n.get("class") or "", re.A):
                report.append("mapped Word MsoTitle paragraph to <h1>")
                return [element("h1", self.attributes(n, "h1"), self.phrasing(n.children, False))]
            return [element("p", self.attributes(n, "p"), self.phrasing(n.children, True))]
        if tag == "blockquote":
            inner = self.blocks(n.children)
            report += [f"dropped <{b.tag}> inside blockquote (only paragraphs allowed)" for b in inner if b.tag != "p"]
            kept = [b for b in inner if b.tag == "p"]
            return [element(tag, self.attributes(n, tag), kept)] if kept else []
        if tag in LISTS:
            return [self.list(n)]
        if tag == "dl":
            items = [element(c.tag, {}, self.phrasing(c.children, False)) for c in n.elements() if c.tag in ("dt", "dd")]
            return [element(tag, self.attributes(n, tag), items)] if items else []
        if tag == "figure":
            source = n.child("img")
            img = self.image(source) if source else None
            if img is None:
                report.append("unwrapped <figure> without a packageable image")
                return self.blocks([c for c in n.children if c.tag != "img"])
            caption = n.child("figcaption")
            more = [element("figcaption", {}, self.phrasing(caption.children, False))] if caption else []
            return [element(tag, self.attributes(n, tag), [img, *more])]
        if tag == "pre":
            code = n.child("code")
            language = re.search("language-[A-Za-z0-9+-]+", (code.get("class") or "") if code else "")
            return [element(tag, self.attributes(n, tag), [element("code", {"class": language[0]} if language else {}, [text((code or n).content())])])]
        if tag == "table":
            return self.table(n)
        if tag == "hr":
            return [element("hr")]
        return self.blocks(n.children)

    def flat(self, blocks: list[Node]) -> list[Node]:
        out = []
        for b in blocks:
            if b.tag in SECTIONING:
                self.report.append(f"unwrapped <{b.tag}> nested in a transparent container (§6.2.2)")
                out += self.flat(b.elements())
            else:
                out.append(b)
        return out

    def list(self, n: Node) -> Node:
        items = []
        for li in n.elements():
            if li.tag != "li":
                self.report.append(f"dropped <{li.tag}> inside a list")
                continue
            inner = [c for c in li.elements() if c.tag in LISTS]
            kids = self.phrasing([c for c in li.children if c.tag not in LISTS], False)
            if inner:
                kids.append(self.list(inner[0]))
            if len(inner) > 1:
                self.report.append("merged multiple nested lists into one")
            items.append(element("li", self.attributes(li, "li"), kids))
        return element(n.tag, self.attributes(n, n.tag), items)

    def table(self, n: Node) -> list[Node]:
        report = self.report
        rows, todo = [], list(reversed(n.elements()))
        while todo:  # rows of nested tables count as rows, but not those inside a row
            c = todo.pop()
            if c.tag == "tr":
                rows.append(c)
            else:
                todo += reversed(c.elements())
        if not rows:
            report.append("dropped <table> with no rows")
            return []
        caption = n.child("caption")
        if caption is None:
            report.append("synthesized empty <caption> for a table")
        shown = normal(caption.content()) if caption else ""
        spans = [[(span(c.get("colspan")), span(c.get("rowspan"))) for c in r.elements()] for r in rows]
        merged = any(s != (1, 1) for r in spans for s in r)
        keep = merged and not table_grid([spans[:1], spans[1:]])[2]
        if merged:
            report.append("kept merged cells (colspan/rowspan)" if keep else "dropped colspan/rowspan (table grid could not be reconciled)")
        width = max(len(r.elements()) for r in rows)

        def row(r: Node, sizes: list, tag: str) -> Node:
            cells = []
            for c, size in zip(r.elements(), sizes):
                content = [x for x in self.phrasing(c.children, True) if x.tag != "br"]
                attrs = self.attributes(c, tag)
                if keep:
                    attrs |= {name: str(k) for name, k in zip(("colspan", "rowspan"), size) if k > 1}
                cells.append(element(tag, attrs, content))
            return element("tr", {}, cells if keep else cells + [element(tag) for _ in range(width - len(cells))])

        attrs = self.attributes(n, "table")
        if (bound := attrs.pop("data-wdf-dataset", None)) is not None:
            report.append(f'dropped data-wdf-dataset="{bound}" (import does not carry dataset files)')
        head, body = row(rows[0], spans[0], "th"), [row(r, s, "td") for r, s in zip(rows[1:], spans[1:])]
        if not body:
            report.append("table had a single row: kept as header with empty body")
        return [element("table", attrs, [element("caption", {}, [text(shown)] if shown else []), element("thead", {}, [head]), element("tbody", {}, body)])]


def has(node: Node, *tags: str) -> bool:
    return any(c.tag in tags or has(c, *tags) for c in node.elements())


def without_spacers(blocks: list[Node]) -> tuple[list[Node], int]:
    """Blocks without paragraphs of white space only, and containers that this empties."""
    out, gone = [], 0
    for b in blocks:
        if b.tag == "p" and not b.content().strip(SPACES) and not has(b, "img"):
            gone += 1
            continue
        if b.tag in SECTIONING or b.tag == "blockquote":
            inner, k = without_spacers(b.elements())
            gone += k
            b.children = [c for c in b.children if c.tag is None] + inner
            if b.tag != "section" and not inner:
                gone += 1
                continue
        out.append(b)
    return out, gone


def _points(node: Node, given: float | None) -> float | None:
    m = _SIZE.search(node.get(STYLE) or "")
    size = float(m[1]) * (0.75 if m[2] == "px" else 1) if m else 0
    return size if size > 0 else given


def uniform_size(p: Node) -> float | None:
    """The one font size of all of a paragraph's text; None if it is unknown or mixed, or there is an image or break."""
    sizes, todo = set(), [(c, _points(p, None)) for c in p.children]
    while todo:
        n, given = todo.pop()
        if n.tag in ("img", "br"):
            return None
        if n.tag is None:
            if n.text.strip(SPACES):
                sizes.add(given)
        else:
            todo += [(c, _points(n, given)) for c in n.children]
    return sizes.pop() if len(sizes) == 1 else None


def _units(value: str) -> int:
    return len(value.encode("utf-16-le")) // 2


def _js(size: float) -> str:
    return str(int(size)) if size == int(size) else repr(size)


def promote_headings(blocks: list[Node], report: list[str]) -> None:
    """Short paragraphs in type larger than the body's become headings, if the document lacks an h1."""
    heads, found = [], []  # sizes of headings; (paragraph, size, text, may be promoted, before any heading)
    state = {"any": False, "h1": False}

    def scan(nodes: list[Node], may: bool) -> None:
        for b in nodes:
            if b.tag in HEADINGS:
                state["any"] = True
                state["h1"] |= b.tag == "h1"
                if (size := uniform_size(b)) is not None:
                    heads.append(size)
            if b.tag in SECTIONING:
                scan(b.elements(), may and b.tag == "section")
            elif b.tag == "blockquote":
                scan(b.elements(), False)
            elif b.tag == "p" and (size := uniform_size(b)) is not None:
                shown = re.sub(f"[{SPACES}]+", " ", b.content()).strip(SPACES)
                if shown:
                    found.append((b, size, shown, may and _units(shown) <= MOST_CHARS, not state["any"]))

    scan(blocks, True)
    if state["h1"] or not found:
        return
    weight: Counter = Counter()
    for _, size, shown, _, _ in found:
        weight[size] += _units(shown)
    body = min(weight, key=lambda s: (-weight[s], s))
    large = [f for f in found if f[3] and f[1] >= body * RATIO]

    def promote(f: tuple, level: int) -> None:
        b, size, shown = f[:3]
        b.tag = f"h{level}"
        cut = shown.encode("utf-16-le")
        excerpt = shown if len(cut) <= 80 else cut[:80].decode("utf-16-le", "replace") + "…"
        report.append(f'promoted styled paragraph ({_js(size)}pt) to <h{level}>: "{excerpt}"')

    if state["any"]:
        titles = [f for f in large if f[4] and f[1] >= max(heads, default=0)]
        if titles:
            promote(max(titles, key=lambda f: f[1]), 1)  # the first of the largest
        return
    ladder = {size: k for k, size in enumerate(sorted({f[1] for f in large}, reverse=True), 1)}
    for f in large:
        if ladder[f[1]] <= 6:
            promote(f, ladder[f[1]])
        else:
            report.append(f"kept styled paragraph ({_js(f[1])}pt) as <p>: more than 6 heading sizes")


def walk(nodes: list[Node]) -> Iterator[Node]:
    todo = list(reversed(nodes))
    while todo:
        n = todo.pop()
        if n.tag is not None:
            yield n
            todo += reversed(n.children)


def hoist_styles(blocks: list[Node]) -> str | None:
    """Classes w1, w2, … for the styles met, in place of the source's classes; the stylesheet, if any."""
    names: dict[str, str] = {}
    for n in walk(blocks):
        signature = n.get(STYLE)
        put(n, STYLE, None)
        put(n, "class", names.setdefault(signature, f"w{len(names) + 1}") if signature else None)
    return stylesheet_of(list(names))


def ensure_ids(blocks: list[Node], report: list[str]) -> None:
    """Ids of all citable elements: sound ones stay, others are claimed in document order."""
    used: set[str] = set()
    for n in walk(blocks):
        if (own := n.get("id")) is not None:
            if ID.fullmatch(own) and own not in used:
                used.add(own)
            else:
                put(n, "id", None)
                report.append(f'replaced non-conforming or duplicate id "{own}" on <{n.tag}>')
    count: Counter = Counter()

    def claim(wanted: str) -> str:
        name, k = wanted, 2
        while name in used:
            name, k = f"{wanted}-{k}", k + 1
        used.add(name)
        return name

    todo = [(n, 0) for n in reversed(blocks)]
    while todo:
        n, depth = todo.pop()
        if n.get("id") is None and (n.tag in HEADINGS or n.tag in COUNTED and (n.tag != "li" or depth == 1)):
            if n.tag in HEADINGS:
                name = slug(n.content())
                if not name:
                    count["h"] += 1
                    name = str(count["h"])
                put(n, "id", claim(f"h-{name}"))
            else:
                prefix, width = COUNTED[n.tag]
                count[prefix] += 1
                put(n, "id", claim(f"{prefix}-{count[prefix]:0{width}d}"))
        todo += [(c, depth + (n.tag in LISTS)) for c in reversed(n.elements())]


def unwrap_dangling(blocks: list[Node], report: list[str]) -> None:
    """Links to ids that the document lacks give way to their content."""
    ids = {n.get("id") for n in walk(blocks)}

    def mend(node: Node) -> None:
        out = []
        for c in node.children:
            if c.tag is not None:
                mend(c)
            href = c.get("href") if c.tag == "a" else None
            if href is not None and href.startswith("#") and href[1:] not in ids:
                report.append(f'unwrapped link to missing fragment "{href}"')
                out += c.children
            else:
                out.append(c)
        node.children = out

    for b in blocks:
        mend(b)


#: Elements without content, and those written on one line.
EMPTY = frozenset("meta link img br hr".split())
ONE_LINE = HEADINGS | frozenset("p dt dd figcaption caption th td title".split())


def _quoted(value: str) -> str:
    return value.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _open(n: Node) -> str:
    attrs = "".join(f' {k}="{_quoted(v).replace(chr(34), "&quot;")}"' for k, v in n.attrs)
    return f"<{n.tag}{attrs}" + (" />" if n.tag in EMPTY else ">")


def _run(nodes: list[Node]) -> str:
    return "".join(_quoted(n.text) if n.tag is None else _open(n) if n.tag in EMPTY else f"{_open(n)}{_run(n.children)}</{n.tag}>" for n in nodes)


def serialize(n: Node, indent: str = "") -> str:
    """Canonical HTML of an element."""
    if n.tag in EMPTY:
        return indent + _open(n)
    if n.tag == "pre" or n.tag in ONE_LINE or not n.elements():
        return f"{indent}{_open(n)}{_run(n.children)}</{n.tag}>"
    if n.tag == "li":
        inner = [serialize(c, indent + "  ") for c in n.elements() if c.tag in LISTS]
        shown = _run([c for c in n.children if c.tag not in LISTS])
        return f"{indent}{_open(n)}{shown}" + ("\n" + "\n".join(inner) + f"\n{indent}" if inner else "") + "</li>"
    kids = [serialize(c, indent + "  ") if c.tag is not None else f"{indent}  {_quoted(c.text.strip(SPACES))}" for c in n.children if c.tag is not None or c.text.strip(SPACES)]
    return "\n".join([indent + _open(n), *kids, f"{indent}</{n.tag}>"])


def serialize_document(language: str, title: str, blocks: list[Node], styled: bool) -> str:
    link = '\n    <link rel="stylesheet" href="content/styles.css" />' if styled else ""
    lang = _quoted(language).replace('"', "&quot;")
    return (
        f'<!DOCTYPE html>\n<html lang="{lang}">\n  <head>\n    <meta charset="utf-8" />\n    <meta name="viewport" content="width=device-width, initial-scale=1" />\n'
        f"    <title>{_quoted(title)}</title>{link}\n  </head>\n  <body>\n{serialize(element('article', {}, blocks), '    ')}\n  </body>\n</html>\n"
    )


def find_landmark(body: Node) -> tuple[Node, str] | None:
    for label, fits in (("main", lambda n: n.tag == "main"), ('role="main"', lambda n: n.get("role") == "main"), ("article", lambda n: n.tag == "article")):
        if (n := next((n for n in walk(body.children) if fits(n)), None)) is not None:
            return n, label
    return None


def import_html(html: str | None, assets: dict[str, str] | None = None, *, full_page: bool = False) -> dict:
    """blocks, title, language, stylesheet and report of a page; assets maps image sources to package paths."""
    report: list[str] = []
    root = parse_document(html).html
    head, body = root.child("head"), root.child("body")
    source = body
    if not full_page and (found := find_landmark(body)):
        source = found[0]
        if normal(source.content()) != normal(body.content()):
            report.append(f"extracted the main content from <{found[1]}>; dropped the surrounding page chrome")
    blocks = HtmlImport(Styles(rules_of(root)), assets or {}, report).blocks(source.children)
    blocks, gone = without_spacers(blocks)
    if gone:
        report.append(f"dropped {gone} empty spacer paragraph(s)")
    promote_headings(blocks, report)
    sheet = hoist_styles(blocks)
    if sheet is not None:
        report.append("translated source styling into a generated content/styles.css")
    if any(c.tag == "link" and "stylesheet" in (c.get("rel") or "").lower() for c in head.elements()):
        report.append("external stylesheet not imported (site CSS is dropped; inline styles translated)")
    title = head.child("title")
    return {"blocks": blocks, "title": normal(title.content()) or None if title else None, "language": root.get("lang"), "stylesheet": sheet, "report": report}


def finish(got: dict, base_name: str, title: str | None = None, language: str | None = None) -> dict | None:
    """The canonical document of imported blocks; None without any."""
    blocks, report = got["blocks"], got["report"]
    if not blocks:
        return None
    ensure_ids(blocks, report)
    unwrap_dangling(blocks, report)
    first = next((b for b in blocks if b.tag in HEADINGS), None)
    title = title or got.get("title") or (first.content().strip(SPACES) if first is not None else base_name)
    language = language or got.get("language") or "en"
    html = serialize_document(language, title, blocks, got.get("stylesheet") is not None)
    return {"html": html, "title": title, "language": language, "stylesheet": got.get("stylesheet"), "report": report}


IMPORTED = "struct<html:string,title:string,language:string,stylesheet:string,report:array<string>>"
_ARROW = pa.struct([("html", pa.string()), ("title", pa.string()), ("language", pa.string()), ("stylesheet", pa.string()), ("report", pa.list_(pa.string()))])


def _importer(convert: Callable[[str | None], dict], base_name: str):
    @F.arrow_udf(IMPORTED)
    def imported(source: pa.Array) -> pa.Array:
        return pa.array([finish(convert(x.as_py()), base_name) for x in source], _ARROW)

    return imported


def import_pages(pages: DataFrame, id_col: str = "page_id", html_col: Column | str = "html", *, full_page: bool = False, base_name: str = "document") -> DataFrame:
    """(doc_id, html, title, language, stylesheet, report) of every page; null but for the id where nothing is left."""
    return _import(pages, id_col, html_col, _importer(lambda x: import_html(x, full_page=full_page), base_name))


def import_markdown_docs(docs: DataFrame, id_col: str = "doc_id", text_col: Column | str = "text", *, base_name: str = "document") -> DataFrame:
    """As import_pages, of Markdown texts."""
    from vellumix.operators.markdown_import import import_markdown

    return _import(docs, id_col, text_col, _importer(import_markdown, base_name))


def _import(rows: DataFrame, id_col: str, source: Column | str, udf) -> DataFrame:
    source = F.col(source) if isinstance(source, str) else source
    # one struct inside an array keeps the conversion from being repeated for every field
    return rows.select(F.col(id_col).alias("doc_id"), udf(source).alias("d")).select("doc_id", "d.html", "d.title", "d.language", "d.stylesheet", "d.report")
