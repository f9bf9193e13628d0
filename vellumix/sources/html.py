"""HTML documents as rows: a flat, interval-encoded node table from one parse per document.

One document is parsed by one sequential pass (parser state depends on everything before it), the
corpus in parallel. A node's subtree is the rows with pre <= x <= post_end. What a rule or an
outline needs of a node's surroundings (parent, list depth, child tags, the first element with
the same id, the citable ancestors) is written beside it in that pass, so that all
per-document operators are filters and expressions over one scan, without a shuffle or a second parse.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vellumix.functions.tables import span, table_grid
from vellumix.sources.tree import HEADINGS, Document, Node, parse, parse_document

__all__ = ["Node", "html_nodes", "parse", "parse_document"]

#: Citable elements and their kinds.
CITABLE = {"section": "section", "p": "paragraph", "table": "table", "figure": "figure", "blockquote": "blockquote"} | {h: "heading" for h in sorted(HEADINGS)}
#: Elements whose whole text is kept beside them.
SPOKEN = HEADINGS | {"title", "caption", "figcaption", "th", "td"}
LISTS = ("ul", "ol")
_WHITE = re.compile(r"[\t\n\f\r ]+")
#: Nodes gathered from several documents before a batch is written.
BATCH_NODES = 50_000

NODES = (
    "doc_id {id}, pre int, post_end int, parent int, depth int, elem_idx int, tag_idx int, kind string, tag string, attrs array<struct<name:string,value:string>>, text string, xpath string, "
    "parent_tag string, parent_end int, child_tags array<string>, bare_text boolean, alone boolean, list_depth int, in_paragraph boolean, content string, "
    "id_first string, target boolean, ord int, title string, cited_up array<string>, "
    "grid array<string>, head_rows int, head_bad int, spanned boolean, doctype array<string>, h1_count int"
)
_COLUMNS = [part.split()[0] for part in re.split(r", (?![^<]*>)", NODES)]


def normal(text: str) -> str:
    return _WHITE.sub(" ", text).strip(" ")


def table_groups(table: Node) -> list[list[Node]]:
    return [[r for r in s.elements() if r.tag == "tr"] for s in table.elements() if s.tag in ("thead", "tbody", "tfoot")]


def _table_facts(table: Node) -> dict:
    groups = table_groups(table)
    cells = [c for g in groups for r in g for c in r.elements()]
    head = next((s for s in table.elements() if s.tag == "thead"), None)
    rows = head.elements() if head else []
    return {
        "grid": table_grid([[[(span(c.get("colspan")), span(c.get("rowspan"))) for c in r.elements()] for r in g] for g in groups])[2],
        "head_rows": len(rows), "head_bad": sum(any(c.tag != "th" for c in r.elements()) for r in rows),
        "spanned": any(n in ("colspan", "rowspan") for c in cells for n, _ in c.attrs),
    }


def _title(node: Node) -> str | None:
    kind = CITABLE.get(node.tag)
    if kind == "heading":
        source = node
    elif kind == "section":
        source, todo = None, list(reversed(node.elements()))
        while todo and source is None:
            n = todo.pop()
            if n.tag in HEADINGS:
                source = n
            elif n.tag != "section":
                todo += reversed(n.elements())
    else:
        source = node.child({"table": "caption", "figure": "figcaption"}.get(kind, ""))
    return normal(source.content()) or None if source is not None else None


def rows_of(doc: Document) -> list[dict]:
    """Node rows of a document in document order; columns that do not apply are left out."""
    out: list[dict] = []
    first: dict[str, str] = {}  # id -> path of the first element below body that has it
    body = doc.html.child("body")
    article = body.child("article") if body else None
    ord_ = 0
    # (node, row of parent, depth, index among elements, index among its tag, path, list depth, in paragraph, list depth in the article or None, ids of citable ancestors)
    todo: list[tuple] = [(doc.html, None, 0, 1, 1, "", 0, False, None, ())]
    while todo:
        node, up, depth, nth, same, path, lists, in_p, own_lists, cited = todo.pop()
        pre, ident = len(out), node.get("id") if node.tag else None
        if node.tag is not None:
            name = node.tag + ("" if depth < 2 else f"#{ident}" if ident else f"[{nth}]")
            path = f"{path}/{name}" if path else name
        elements = node.elements()
        row = {
            "pre": pre, "post_end": pre, "parent": up, "depth": depth, "elem_idx": nth, "tag_idx": same, "kind": "text" if node.tag is None else "element", "tag": node.tag,
            "attrs": [{"name": n, "value": v} for n, v in node.attrs], "text": node.text if node.tag is None else None, "xpath": path,
            "parent_tag": None if up is None else out[up]["tag"], "list_depth": lists, "in_paragraph": in_p, "child_tags": [c.tag for c in elements],
            "alone": up is not None and len(out[up]["child_tags"]) == 1 and not out[up]["bare_text"],
            "bare_text": any(c.tag is None and normal(c.text) for c in node.children),
        }
        if depth == 0:
            row["doctype"] = list(doc.doctype) if doc.doctype else None
        if node.tag in SPOKEN:
            row["content"] = normal(node.content())
        if node.tag == "table":
            row |= _table_facts(node)
        if ident is not None and depth >= 2 and path.startswith("html/body"):
            if ident in first:
                row["id_first"] = first[ident]
            first.setdefault(ident, path)
        if own_lists is not None and ident is not None and (node.tag in CITABLE or node.tag == "li" and own_lists == 1):
            row |= {"ord": ord_, "title": _title(node), "cited_up": list(cited)}
            ord_, cited = ord_ + 1, (*cited, ident)
        out.append(row)
        in_article = node is article
        if node.tag in LISTS:
            lists, in_p = lists + 1, False
            own_lists = None if own_lists is None else own_lists + 1
        elif node.tag in ("p", "th", "td"):
            in_p = True
        seen: dict[str, int] = {}
        ahead, k = [], 0
        for c in node.children:
            if c.tag is not None:
                k += 1
                seen[c.tag] = seen.get(c.tag, 0) + 1
            ahead.append((c, pre, depth + 1, k, seen.get(c.tag, 0), path, lists, in_p, 0 if in_article else own_lists, cited))
        todo += reversed(ahead)
    for row in reversed(out):
        if row["parent"] is not None:
            up = out[row["parent"]]
            up["post_end"] = max(up["post_end"], row["post_end"])
    at = next((r for r in out if r["depth"] == 1 and r["tag"] == "body"), None)
    if at is not None:
        at["h1_count"] = sum(r["tag"] == "h1" for r in out[at["pre"] : at["post_end"] + 1])
    for row in out:
        if row["parent"] is not None:
            row["parent_end"] = out[row["parent"]]["post_end"]
        if row["tag"] == "a":
            href = next((a["value"] for a in row["attrs"] if a["name"] == "href"), None)
            if href is not None and href.startswith("#"):
                row["target"] = href[1:] in first
    return out


def html_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Node table of every document; the id column keeps its type and is named doc_id.

    Null and empty documents have the rows of an empty html, head and body. Rows that share an id
    are documents of their own. Batches are written when BATCH_NODES nodes are gathered.
    """
    schema = NODES.format(id=pages.schema[id_col].dataType.simpleString())
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in _COLUMNS}

        def written() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held[f.name], f.type) for f in arrow], schema=arrow)
            for values in held.values():
                values.clear()
            return batch

        for batch in batches:
            for i, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = rows_of(parse_document(html.as_py()))
                held["doc_id"] += [i] * len(rows)
                for c in _COLUMNS[1:]:
                    held[c] += [r.get(c) for r in rows]
                if len(held["pre"]) >= BATCH_NODES:
                    yield written()
        if held["pre"]:
            yield written()

    return pages.select(F.col(id_col), F.col(html_col)).mapInArrow(run, schema)
