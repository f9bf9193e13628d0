"""Profile rules over the node table: every rule is an expression on one row, all of them in one scan.

A row knows its parent, list depth, child tags and the first element with its id (see
``html_nodes``), so the whole check is one projection without a shuffle. ``seq`` sorts the
violations of a document in the order in which a walk over the tree meets them: document, html,
head, repeated ids, body, then each element before its children, with what concerns a phrasing
container's children after them, and last the number of h1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Element classes of the profile.
HEADING = ["h1", "h2", "h3", "h4", "h5", "h6"]
INLINE = ["a", "em", "strong", "code", "sub", "sup", "time", "cite", "q", "abbr", "span", "br"]
BLOCKS = [*HEADING, "p", "blockquote", "figure", "pre", "hr", "ul", "ol", "dl", "table"]
SECTIONING = ["section", "header", "footer", "nav"]
ELEMENTS = ["article", *SECTIONING, *BLOCKS, *INLINE, "img", "figcaption", "caption", "thead", "tbody", "tfoot", "tr", "th", "td", "li", "dt", "dd"]
CITABLE = ["section", *HEADING, "p", "table", "figure", "blockquote"]
#: Attributes of every element, and of one.
EVERYWHERE = ["id", "class", "lang", "dir"]
OWN = {
    "a": ["href"], "img": ["src", "alt", "width", "height"], "time": ["datetime"], "abbr": ["title"], "blockquote": ["cite"],
    "th": ["scope", "colspan", "rowspan"], "td": ["colspan", "rowspan"], "table": ["data-wdf-dataset"],
}
#: Patterns of attribute values.
ID, FRAGMENT = r"\A[a-z]+-[a-z0-9][a-z0-9-]*\z", r"\A#[a-z]+-[a-z0-9][a-z0-9-]*\z"
EXTERNAL = r"\A(https?://[^\s<>]+|mailto:[^\s<>]+)\z"
IMAGE = r"\Acontent/assets(/[A-Za-z0-9][A-Za-z0-9._-]*)+\z"
DATASET = r"\Adata(/[A-Za-z0-9][A-Za-z0-9._-]*)+\.json\z"
DATE_TIME = r"\A\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2}))?\z"
LANGUAGE = r"\A[a-zA-Z]{2,3}(-[a-zA-Z0-9]{2,8})*\z"
POSITIVE = r"\A[1-9][0-9]*\z"
SPAN = r"\A(?:[2-9]|[1-9][0-9]{1,2}|1000)\z"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
#: What a stylesheet must not hold.
CSS = [
    (r"(?i)@import\b", "@import is not permitted"), (r"(?i)@font-face\b", "@font-face is not permitted"), (r"(?i)\burl\s*\(", "url(…) is not permitted in any form"),
    (r"(?i)\bposition\s*:\s*fixed\b", "position: fixed is not permitted"), (r"(?i)\bposition\s*:\s*sticky\b", "position: sticky is not permitted"),
]

VIOLATION = "struct<seq:bigint,spec:string,path:string,message:string,severity:string>"
_FLOW = ["article", *SECTIONING]
#: Elements whose children are phrasing.
_PHRASING = ["p", *HEADING, "dt", "dd", "figcaption", "caption", "th", "td", *[x for x in INLINE if x != "br"]]


def attr(name: str) -> Column:
    """First value of an attribute, else null."""
    return F.get(F.filter(F.col("attrs"), lambda a: a["name"] == name), F.lit(0))["value"]


def says(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _seq(phase: int, at: Column, *, late: bool = False, rule: int = 0, k: Column | int = 0) -> Column:
    """Order of a violation: phase, position, before or after the subtree (then deeper parents first), rule, and a count."""
    deep = F.lit(0) if not late else F.lit(511) - F.least(F.col("depth"), F.lit(511))
    n = F.lit(phase).cast("bigint") * (1 << 60) + at.cast("bigint") * (1 << 34) + F.lit(int(late)).cast("bigint") * (1 << 33)
    k = k if isinstance(k, Column) else F.lit(k)
    return n + deep.cast("bigint") * (1 << 24) + F.lit(rule).cast("bigint") * (1 << 19) + F.least(k, F.lit((1 << 19) - 1)).cast("bigint")


def _found(when: Column, seq: Column, spec: str, message: Column, path: Column | None = None, severity: str = "error") -> Column:
    made = F.struct(seq.alias("seq"), F.lit("§" + spec).alias("spec"), (F.col("xpath") if path is None else path).alias("path"), message.alias("message"), F.lit(severity).alias("severity"))
    return F.when(F.coalesce(when, F.lit(False)), made).cast(VIOLATION)


def _document_rules() -> list[Column]:
    root, tag, head = F.col("depth") == 0, F.col("tag"), F.col("parent_tag") == "head"
    doc, none, here = F.lit("(document)"), F.col("doctype").isNull(), F.col("xpath")
    lang = attr("lang")
    out = [
        _found(root & none, _seq(0, F.lit(0)), "6.1.1", says("missing <!DOCTYPE html>"), doc),
        _found(root & ~none & (F.col("doctype") != F.array(F.lit("html"), F.lit(""), F.lit(""))), _seq(0, F.lit(0)), "6.1.1", says("the doctype must be exactly <!DOCTYPE html>"), doc),
        _found(root & ~F.coalesce(lang.rlike(LANGUAGE), F.lit(False)), _seq(1, F.lit(0)), "6.1.2", says('<html> must carry a BCP 47 lang attribute (got "', lang, '")')),
    ]
    is_head = (F.col("depth") == 1) & (tag == "head")
    titles = F.size(F.filter(F.col("child_tags"), lambda t: t == "title"))
    at = F.col("pre")
    first_meta = F.get("child_tags", F.lit(0)) == "meta"
    out += [
        # whether the first child is the charset is known at that child; a head without children or with another first child is known here
        _found(is_head & ~F.coalesce(first_meta, F.lit(False)), _seq(2, F.lit(0)), "6.1.3", says('the first child of <head> must be <meta charset="utf-8">')),
        _found(is_head & (titles != 1), _seq(2, F.lit(0), rule=1), "6.1.3", says("<head> must contain exactly one <title> (found ", titles, ")")),
    ]
    meta = head & (tag == "meta")
    charset = F.lower(F.coalesce(attr("charset"), F.lit("")))
    is_first = F.col("elem_idx") == 1
    named = F.coalesce(attr("name") == "viewport", F.lit(False))
    link = head & (tag == "link")
    right = F.coalesce((attr("rel") == "stylesheet") & (attr("href") == "content/styles.css"), F.lit(False))
    return out + [
        _found(meta & is_first & (charset != "utf-8"), _seq(2, F.lit(0)), "6.1.3", says('the first child of <head> must be <meta charset="utf-8">'), F.lit("html/head")),
        _found(head & (tag == "title") & (F.col("content") == "") & (F.col("tag_idx") == 1), _seq(2, F.lit(0), rule=2), "6.1.3", says("<title> must not be empty"), F.lit("html/head/title")),
        _found(meta & ~(is_first & attr("charset").isNotNull()) & ~named, _seq(2, at), "6.1.3", says('only the charset meta and <meta name="viewport"> are permitted in <head>')),
        _found(link & (F.col("tag_idx") > 1), _seq(2, at), "6.7.1", says("at most one stylesheet link is permitted")),
        _found(link & (F.col("tag_idx") == 1) & ~right, _seq(2, at), "6.7.1", says('<link> must be exactly rel="stylesheet" href="content/styles.css"')),
        _found(head & ~tag.isin("meta", "title", "link"), _seq(2, at), "6.1.3", says("<", tag, "> is not permitted in <head>"), here),
    ]


def _body_rules() -> list[Column]:
    body = (F.col("depth") == 1) & (F.col("tag") == "body")
    tags = F.col("child_tags")
    listed = F.when(F.size(tags) == 0, "nothing").otherwise(F.array_join(tags, ", "))
    h1 = says("document should contain exactly one <h1> (found ", F.col("h1_count"), ")")
    return [
        _found(body & (F.col("h1_count") != 1), _seq(6, F.lit(0)), "6.1.5", h1, severity="warning"),
        _found(body & F.col("bare_text"), _seq(4, F.lit(0)), "6.1.4", says("<body> must not contain text directly")),
        _found(body & ~((F.size(tags) == 1) & (F.get(tags, F.lit(0)) == "article")), _seq(4, F.lit(0), rule=1), "6.1.4", says("<body> must contain exactly one <article> (found: ", listed, ")")),
        _found(_visited() & F.col("id_first").isNotNull(), _seq(3, F.col("pre")), "6.4.2", says('duplicate id "', attr("id"), '" (first used at ', F.col("id_first"), ")")),
    ]


def _visited() -> Column:
    return (F.col("kind") == "element") & (F.col("depth") >= 2) & F.col("xpath").startswith("html/body/")


def _attribute_rules() -> list[Column]:
    tag, seen, at = F.col("tag"), _visited(), F.col("pre")
    value = lambda t, name, ok, spec, message, k=0: _found(
        seen & (tag == t) & attr(name).isNotNull() & ~attr(name).rlike(ok), _seq(5, at, rule=2, k=k), spec, says(*message(attr(name)))
    )
    href = attr("href")
    local = href.rlike(FRAGMENT)
    source = F.coalesce(attr("src").rlike(IMAGE), F.lit(False))
    out = [
        _found(seen & attr("id").isNotNull() & ~attr("id").rlike(ID), _seq(5, at, rule=1), "6.4.2", says('id "', attr("id"), '" does not match ^[a-z]+-[a-z0-9][a-z0-9-]*$')),
        _found(seen & (tag == "a") & href.isNull(), _seq(5, at, rule=2), "6.3.2", says("<a> requires an href attribute")),
        _found(seen & (tag == "a") & local & ~F.col("target"), _seq(5, at, rule=2), "6.3.2", says('fragment link "', href, '" has no matching id in this document')),
        _found(seen & (tag == "a") & href.isNotNull() & ~local & ~href.rlike(EXTERNAL), _seq(5, at, rule=2), "6.3.2", says('href "', href, '" is not https/http, mailto, or a local fragment')),
        _found(seen & (tag == "img") & ~source, _seq(5, at, rule=2), "6.3.3", says('img src must be a package path under content/assets/ (got "', attr("src"), '")')),
        _found(seen & (tag == "img") & attr("alt").isNull(), _seq(5, at, rule=2, k=1), "6.3.3", says("img requires an alt attribute (may be empty if decorative)")),
        value("time", "datetime", DATE_TIME, "6.3.4", lambda v: ('datetime "', v, '" is not an RFC 3339 date or date-time')),
        value("blockquote", "cite", EXTERNAL, "6.3.4", lambda v: ('blockquote cite "', v, '" must be an external https/http/mailto URL')),
        value("th", "scope", r"\A(col|row)\z", "6.3.4", lambda v: ('th scope must be "col" or "row" (got "', v, '")')),
        value("table", "data-wdf-dataset", DATASET, "6.5", lambda v: ('data-wdf-dataset "', v, '" is not a data/*.json package path')),
        _found(seen & (tag.isin(CITABLE) | (tag == "li") & (F.col("list_depth") == 1)) & attr("id").isNull(), _seq(5, at, rule=3), "6.4.1", says("citable element <", tag, "> is missing its mandatory id")),
        _found(seen & ~tag.isin(ELEMENTS), _seq(5, at, rule=4), "6.2", says("element <", tag, "> is not in the WDF-HTML whitelist")),
    ]
    for k, name in enumerate(("width", "height"), 2):
        out.append(value("img", name, POSITIVE, "6.3.3", lambda v, name=name: (f'img {name} must be a positive integer (got "', v, '")'), k))
    for k, name in enumerate(("colspan", "rowspan"), 1):
        for t in ("th", "td"):
            out.append(value(t, name, SPAN, "6.3.4", lambda v, name=name: (f'{name} must be an integer between 2 and 1000 — the value 1 is expressed by omitting the attribute (got "', v, '")'), k))
    return out


def _content_rules() -> list[Column]:
    """What an element's children must be; a rule about a child is found at the child."""
    tag, up, seen, at, above = F.col("tag"), F.col("parent_tag"), _visited(), F.col("pre"), F.col("parent")
    tags, n = F.col("child_tags"), F.size("child_tags")
    kid = _seq(5, above, rule=6, k=F.col("elem_idx"))
    shape = F.array_join(tags, ",")
    named = F.when(shape == "", "nothing").otherwise(shape)
    is_in = lambda *names: seen & up.isin(*names)
    own = lambda t: seen & (tag == t)
    bare = lambda spec, *names: _found(seen & tag.isin(*names) & F.col("bare_text"), _seq(5, at, rule=5), spec, says("<", tag, "> must not contain text directly"))
    image = "<img> may appear only inside <figure>, or inline inside <p> or a table cell"
    nested = F.transform(tags, lambda t: t.isin("ul", "ol"))
    lists = F.size(F.filter(tags, lambda t: t.isin("ul", "ol")))
    may_section = up.isin("article", "section") & tag.isin(SECTIONING)
    bound = attr("data-wdf-dataset").isNotNull()
    right_table = shape.isin("caption,thead,tbody", "caption,thead,tbody,tfoot")
    table, head = own("table"), says(F.col("xpath"), "/thead[2]")
    only_code = (n == 1) & (F.get(tags, F.lit(0)) == "code") & ~F.col("bare_text")
    return [
        bare("6.2", *_FLOW, "ul", "ol", "dl"), bare("6.2.5", "blockquote"), bare("6.2.6", "figure"), bare("6.2.8", "thead", "tbody", "tfoot", "tr"),
        _found(is_in(*_FLOW) & (tag == "img"), kid, "6.2.9", says(image)),
        _found(is_in(*_FLOW) & tag.isin(INLINE), kid, "6.2", says("inline element <", tag, "> needs a block container")),
        _found(is_in(*_FLOW) & ~tag.isin("img", *INLINE, *BLOCKS) & ~may_section, kid, "6.2", says("<", tag, "> is not permitted inside <", up, ">")),
        _found(own("section") & (n > 0) & ~F.get(tags, F.lit(0)).isin(HEADING), _seq(5, at, rule=7), "6.2.1", says("section should begin with a heading"), severity="warning"),
        _found(own("article") & (n == 0), _seq(5, at, rule=7), "6.1.4", says("article must contain at least one block element")),
        _found(is_in("th", "td") & (tag == "br"), kid, "6.2.8", says("<br> is not permitted inside table cells")),
        _found(own("li") & (F.array_position(nested, True) > 0) & (F.array_position(nested, True) < n), _seq(5, at, rule=5, k=1), "6.2.4", says("a nested list must be the last child of <li>")),
        _found(own("li") & (lists > 1), _seq(5, at, rule=5, k=2), "6.2.4", says("<li> may contain at most one nested list")),
        _found(is_in("li") & (tag == "img"), kid, "6.2.9", says("<img> is not permitted inside <li> (phrasing content plus one nested list)")),
        _found(is_in("li") & ~tag.isin("img", "ul", "ol", *INLINE), kid, "6.2.4", says("<", tag, "> is not permitted inside <li> (phrasing content plus one nested list)")),
        _found(is_in("ul", "ol") & (tag != "li"), kid, "6.2", says("<", up, "> may contain only <li>")),
        _found(is_in("dl") & ~tag.isin("dt", "dd"), kid, "6.2", says("<dl> may contain only <dt> and <dd>")),
        _found(own("blockquote") & (n == 0), _seq(5, at, rule=5, k=1), "6.2.5", says("<blockquote> must contain at least one <p>")),
        _found(is_in("blockquote") & (tag != "p"), kid, "6.2.5", says("<blockquote> may contain only <p> elements")),
        _found(own("figure") & ~shape.isin("img", "img,figcaption"), _seq(5, at, rule=7), "6.2.6", says("<figure> must contain exactly one <img>, optionally followed by <figcaption> (got: ", named, ")")),
        # a code inside pre with elements of its own is found at the code
        _found(own("pre") & (n > 0) & ~only_code, _seq(5, at, rule=7), "6.2.7", says("<pre> must contain text only, or exactly one <code> containing text only")),
        _found(is_in("pre") & (tag == "code") & (F.col("elem_idx") == 1) & (n > 0) & F.col("only_child"), _seq(5, above, rule=7), "6.2.7", says("<pre> must contain text only, or exactly one <code> containing text only"), F.col("parent_path")),
        _found(is_in("thead", "tbody", "tfoot") & (tag != "tr"), kid, "6.2.8", says("<", up, "> may contain only <tr>")),
        _found(is_in("tr") & ~tag.isin("th", "td"), kid, "6.2.8", says("<tr> may contain only <th> and <td>")),
        _found(table & ~right_table, _seq(5, at, rule=5), "6.2.8", says("<table> must contain caption, thead, tbody[, tfoot] in order (got: ", named, ")")),
        _found(table & right_table & bound & shape.endswith("tfoot"), _seq(5, at, rule=5, k=1), "6.5.2", says("a dataset-bound table must not contain <tfoot>")),
        _found(table & right_table & (F.col("head_rows") != 1), _seq(5, at, rule=5, k=2), "6.2.8", says("<thead> must contain exactly one <tr>"), head),
        _found(table & right_table & bound & F.col("spanned"), _seq(5, at, rule=5, k=500), "6.5.2", says("a dataset-bound table must not contain colspan or rowspan")),
        # phrasing containers: after what their children bring
        _found(is_in(*_PHRASING) & (tag == "img") & ~F.col("in_paragraph"), _late(), "6.2.9", says(image)),
        _found(is_in(*_PHRASING) & ~tag.isin("img", *INLINE), _late(), "6.2.3", says("<", tag, "> is not phrasing content (inside <", up, ">)")),
    ]


def _late() -> Column:
    # the container is one level up
    deep = (F.lit(511) - F.least(F.col("depth") - 1, F.lit(511))).cast("bigint")
    return F.lit(5).cast("bigint") * (1 << 60) + F.col("parent_end").cast("bigint") * (1 << 34) + F.lit(1 << 33) + deep * (1 << 24) + F.least(F.col("elem_idx"), F.lit((1 << 19) - 1)).cast("bigint")


def _many() -> list[Column]:
    """Rules that may find several things at one element, as arrays."""
    own = F.create_map(*[x for t, names in OWN.items() for x in (F.lit(t), F.array(*map(F.lit, names)))])
    tag, at = F.col("tag"), F.col("pre")
    allowed = F.concat(F.array(*map(F.lit, EVERYWHERE)), F.coalesce(F.try_element_at(own, tag), F.array().cast("array<string>")))

    def one(seq: Column, spec: str, message: Column, path: Column | None = None) -> Column:
        return F.struct(seq.alias("seq"), F.lit("§" + spec).alias("spec"), (path if path is not None else F.col("xpath")).alias("path"), message.alias("message"), F.lit("error").alias("severity")).cast(VIOLATION)

    none = F.array().cast(f"array<{VIOLATION}>")
    control = F.transform("attrs", lambda a, i: F.when(a["value"].rlike(CONTROL), one(_seq(5, at, k=i * 2), "6.3.5", says('attribute "', a["name"], '" contains a control character'))))
    foreign = F.transform("attrs", lambda a, i: F.when(~F.array_contains(allowed, a["name"]), one(_seq(5, at, k=i * 2 + 1), "6.3", says('attribute "', a["name"], '" is not permitted on <', tag, ">"))))
    html = F.transform("attrs", lambda a, i: F.when(~a["name"].isin("lang", "dir"), one(_seq(1, F.lit(0), rule=1, k=i), "6.3", says('attribute "', a["name"], '" is not permitted on <html>'))))
    right = F.array_join("child_tags", ",").isin("caption,thead,tbody", "caption,thead,tbody,tfoot")
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.col("head_bad"), F.lit(1))), lambda i: F.when(F.col("head_bad") > 0, one(_seq(5, at, rule=5, k=i + 2), "6.2.8", says("the header row must contain only <th> cells"), says(F.col("xpath"), "/thead[2]"))))
    grid = F.transform("grid", lambda g, i: one(_seq(5, at, rule=5, k=i + 1000), "6.2.8", says("table grid is not rectangular: ", g)))
    return [
        F.when(_visited(), F.concat(control, foreign)).otherwise(none),
        F.when(F.col("depth") == 0, html).otherwise(none),
        F.when(_visited() & (tag == "table") & right, F.concat(heads, grid)).otherwise(none),
    ]


def validate(nodes: DataFrame) -> DataFrame:
    """(doc_id, seq, spec, path, message, severity): all violations of every document, sortable by seq.

    One scan of one parse, without a shuffle.
    """
    # a code that is the only child of its pre: a pre's path is its code's without the last step
    rows = nodes.where("kind = 'element'").withColumn("parent_path", F.regexp_replace("xpath", r"/[^/]*\z", "")).withColumn("only_child", F.col("alone"))
    singles = F.array(*_document_rules(), *_body_rules(), *_attribute_rules(), *_content_rules())
    found = F.concat(F.array_compact(singles), F.array_compact(F.concat(*_many())))
    return rows.select("doc_id", F.inline(found))


def validate_stylesheet(styles: DataFrame) -> DataFrame:
    """(doc_id, seq, spec, path, message, severity) of styles(doc_id, css): what a stylesheet must not hold, comments left out."""
    bare = F.regexp_replace("css", r"(?s)/\*.*?\*/", "")
    found = F.array(*(_found(bare.rlike(p), F.lit(k).cast("bigint"), "6.7.2", says(m), F.lit("content/styles.css")) for k, (p, m) in enumerate(CSS)))
    return styles.select("doc_id", F.inline(F.array_compact(found)))


def validity(docs: DataFrame, violations: DataFrame) -> DataFrame:
    """(doc_id, errors, warnings, valid) of every document of docs(doc_id)."""
    n = violations.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", zero("errors"), zero("warnings")).withColumn("valid", F.col("errors") == 0)
