import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from pyspark.sql import functions as F

from vellumix import queries as Q
from vellumix.functions import schemas
from vellumix.functions import text as T
from vellumix.functions.tables import table_grid
from vellumix.operators import datasets, importing, integrity, nodes, packages, profile, reading, styles
from vellumix.operators.markdown import to_markdown
from vellumix.operators.markdown_import import import_markdown
from vellumix.sources.html import html_nodes
from vellumix.sources.tree import parse

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
PAGE = """<!doctype html><html lang=en><head><meta charset=utf-8><title>t</title></head><body><article>
<section id="s-1"><h1 id="h-0">One  <em> two </em></h1><p id="p-1">a *b* <a href="#no-where">x</a><br> c</p>
<ul><li id="l-1">first<ul><li id="l-2">deep</li></ul></li><li>second</ul>
<section id="s-2"><h2 id="h-2">Sub</h2><p>no id</section></section>
<table id="t-1"><caption>Cap</caption><thead><tr><th>A<th>B</tr></thead><tbody><tr><td rowspan="2">1<td>2</tr><tr><td>3</tr></tbody></table>
<pre id="p-1"><code class="language-py">x = `1`
</code></pre><blink>no</blink></article></body></html>"""


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_its_sql(spark, views, name):
    want = views.execute(Q.ORACLES[name])
    cols = [c[0] for c in want.description]
    got = Q.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(str(tuple(map(plain, r))) for r in got.select(cols).collect()) == sorted(str(tuple(map(plain, r))) for r in want.fetchall())


def show(n):
    if n.tag is None:
        return n.text
    return f"<{n.tag}>" + "".join(map(show, n.children)) + f"</{n.tag}>"


@pytest.mark.parametrize(
    ("text", "body"),
    [
        ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<table><tr><td>a</td>x<b>y</b></table>z", "x<b>y</b><table><tbody><tr><td>a</td></tr></tbody></table>z"),
        ("<p><b>T<br><p>u<p>v</b>w", "<p><b>T<br></br></b></p><p><b>u</b></p><p><b>v</b>w</p>"),
        ("<h1>a<h2>b</h2>", "<h1>a</h1><h2>b</h2>"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>"),
        ("<a>1<div>2<a>3</a></div>", "<a>1</a><div><a>2</a><a>3</a></div>"),
        ("<!doctype html><p>a<table><tr><td>b</table>c", "<p>a</p><table><tbody><tr><td>b</td></tr></tbody></table>c"),
        ("<p>a<table><td>b</table>c", "<p>a<table><tbody><tr><td>b</td></tr></tbody></table>c</p>"),
        ("<select><option>a<option>b</select><p>c", "<select><option>a</option><option>b</option></select><p>c</p>"),
        ("x &copy y &notit; &lt;", "x © y ¬it; <"),
        ("<table><caption>c<tr><th>h<tbody><tr><td>1<td>2</table>", "<table><caption>c</caption><tbody><tr><th>h</th></tr></tbody><tbody><tr><td>1</td><td>2</td></tr></tbody></table>"),
        ("a<template><p>x</template><!-- c -->b", "a<template></template>b"),
        ("<pre>\n\nx</pre></div></b>y", "<pre>\nx</pre>y"),
        ("<p>a<b", "<p>a</p>"),
        ("", ""),
    ],
)
def test_trees_follow_the_standard(text, body):
    assert show(parse(text).child("body")) == f"<body>{body}</body>"


def test_head_and_attributes():
    root = parse("<!doctype html><html lang=en><title>a<b>&amp;</title><style>p{</p></style><link rel=x>\n<body class=c id=1 id=2><a href='?a=1&copy=2&amp;b'>")
    assert [c.tag for c in root.child("head").elements()] == ["title", "style", "link"]
    assert root.child("head").child("title").content() == "a<b>&" and root.child("head").child("style").content() == "p{</p>"
    assert root.child("body").attrs == [("class", "c"), ("id", "1")] and root.child("body").child("a").get("href") == "?a=1&copy=2&b"


def test_markdown_of_an_article():
    assert to_markdown(PAGE) == (
        "# One *two* {#h-0} {#s-1}\n\na \\*b\\* [x](<#no-where>)\\\nc {#p-1}\n\n- first {#l-1}\n  - deep\n- second\n\n## Sub {#h-2} {#s-2}\n\nno id\n\n"
        "Cap {#t-1}\n\n| A | B |\n| --- | --- |\n| 1 | 2 |\n|  | 3 |\n\n```py\nx = `1`\n```\n"
    )
    assert to_markdown("") == to_markdown(None) == "\n"
    ragged = "<article><table><caption></caption><thead><tr><th>a</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table><p>`` <code> a`b </code>x<code>`</code></p></article>"
    assert to_markdown(ragged) == "\n\n| a |\n| --- |\n| 1 |\n\n\\`\\` ``a`b`` x`` ` ``\n"


def test_grid_spans():
    assert table_grid([[[(2, 1), (1, 2)], [(1, 1)]], [[(1, 1)]]]) == (3, [[0, None, 1], [0, None, None], [0, None, None]], ["row 2 covers 2 of 3 column(s)", "row 3 covers 1 of 3 column(s)"])
    assert table_grid([[[(1, 3)]], [[(1, 1), (1, 1)], [(2, 1)]]])[2] == [
        "row 1: rowspan 3 extends past its row group", "row 2: cell 2 does not fit (the header defines 1 column(s))", "row 3: cell 1 spans past column 1",
    ]
    assert table_grid([[[(1, 1), (1, 2), (1, 1)], [(2, 1), (1, 1)]]])[2] == ["row 2: cells overlap at column 2"]


@pytest.fixture(scope="module")
def page(spark):
    return html_nodes(spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")).cache()


def test_intervals_hold_exactly_the_subtree(page):
    rows = {r.pre: r for r in page.where("doc_id = 1").collect()}
    for r in rows.values():
        inside = set()
        for x in rows.values():
            up = x.parent
            while up is not None and up != r.pre:
                up = rows[up].parent
            if up == r.pre:
                inside.add(x.pre)
        assert inside == set(range(r.pre + 1, r.post_end + 1))


def test_outline(page):
    got = [(r.id, r.type, r.level, r.title, r.parent) for r in nodes.outline(page).orderBy("ord").collect()]
    assert got == [
        ("s-1", "section", None, "One two", None), ("h-0", "heading", 1, "One two", "s-1"), ("p-1", "paragraph", None, None, "s-1"), ("l-1", "list-item", None, None, "s-1"),
        ("s-2", "section", None, "Sub", "s-1"), ("h-2", "heading", 2, "Sub", "s-2"), ("t-1", "table", None, "Cap", None),
    ]


#: A document without any violation, and changes to it that bring the named ones, in order.
SOUND = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="x"><title>t</title><link rel="stylesheet" href="content/styles.css"></head><body><article>
<h1 id="h-1">T</h1><p id="p-1">a <a href="#h-1">l</a> <a href="mailto:x">m</a> <img src="content/assets/a.png" alt="" width="3"> <time datetime="2024-01-02T03:04:05Z">d</time></p>
<ul><li id="li-1">x<ol><li>y</li></ol></li></ul><dl><dt>a</dt><dd>b</dd></dl><blockquote id="b-1" cite="http://x.y"><p id="p-2">q</p></blockquote>
<figure id="f-1"><img src="content/assets/b.png" alt="b"><figcaption>c</figcaption></figure><pre><code>x</code></pre><hr>
<table id="t-1" data-wdf-dataset="data/n.json"><caption></caption><thead><tr><th scope="col">A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>
<section id="s-1"><h2 id="h-2">S</h2></section><nav><p id="p-3">n</p></nav></article></body></html>"""
CASES = [
    ("<!DOCTYPE html>", "", ["6.1.1"]), ("<!DOCTYPE html>", '<!DOCTYPE html PUBLIC "x">', ["6.1.1"]), (' lang="en"', "", ["6.1.2"]), (' lang="en"', ' lang="en" class="x"', ["6.3"]),
    ('<meta charset="utf-8">', "", ["6.1.3"]), ('charset="utf-8"', 'charset="latin1"', ["6.1.3"]), ("<title>t</title>", "", ["6.1.3"]), ("<title>t</title>", "<title> </title>", ["6.1.3"]),
    ('name="viewport"', 'name="x"', ["6.1.3"]), ("<title>t</title>", "<title>t</title><script></script>", ["6.1.3"]), ('rel="stylesheet"', 'rel="x"', ["6.7.1"]),
    ("</head>", '<link rel="stylesheet" href="content/styles.css"></head>', ["6.7.1"]), ("<article>", "x<article>", ["6.1.4"]), ("</article>", "</article><footer></footer>", ["6.1.4"]),
    ("<hr>", "<hr><video></video>", ["6.2", "6.2"]), ("<hr>", "<hr>text", ["6.2"]), ("<hr>", "<hr><em>e</em>", ["6.2"]), ("<hr>", '<hr><img src="content/assets/b.png" alt="">', ["6.2.9"]),
    ('<p id="p-3">n</p>', "<section id=s-9><h2 id=h-9>x</h2></section>", ["6.2"]), ('<h2 id="h-2">S</h2>', '<p id="p-9">x</p>', ["6.2.1"]), ("a <a", "a <h3-x>b</h3-x><a", ["6.2", "6.2.3"]),
    ("<dt>a</dt>", "<dt><img src='content/assets/b.png' alt=''></dt>", ["6.2.9"]), ("<td>1</td>", "<td>1<br></td>", ["6.2.8"]), ("</ol></li>", "</ol><em>z</em></li>", ["6.2.4"]),
    ("</ol></li>", "</ol><ul><li>w</li></ul></li>", ["6.2.4", "6.2.4"]), (">x<ol>", "><p id='p-8'>x</p><ol>", ["6.2.4"]), (">x<ol>", "><img src='content/assets/b.png' alt=''><ol>", ["6.2.9"]),
    ("<ul><li", "<ul><hr><li", ["6.2"]), ("<dl>", "<dl>t", ["6.2"]), ("<dl><dt>a</dt>", "<dl><hr><dt>a</dt>", ["6.2"]), ('<p id="p-2">q</p>', "", ["6.2.5"]), ('<p id="p-2">q</p>', '<p id="p-2">q</p><hr>z', ["6.2.5", "6.2.5"]),
    ("<figcaption>c</figcaption>", "<p id='p-7'>c</p>", ["6.2.6"]), ("<pre><code>x</code></pre>", "<pre>y<code>x</code></pre>", ["6.2.7"]), ("<code>x</code>", "<code><em>x</em></code>", ["6.2.7"]),
    ("<caption></caption>", "", ["6.2.8"]), ("</tbody></table>", "</tbody><tfoot><tr><td>1</td><td>2</td></tr></tfoot></table>", ["6.5.2"]), ("<td>1</td>", "<td rowspan='2'>1</td>", ["6.5.2", "6.2.8", "6.2.8"][:2]),
    ("<th>B</th>", "<td>B</td>", ["6.2.8"]), ("</tr></thead>", "</tr><tr><th>A</th><th>B</th></tr></thead>", ["6.2.8"]), ("<td>2</td>", "", ["6.2.8"]), ("<td>2</td>", "<td colspan='1'>2</td>", ["6.5.2", "6.3.4"]),
    ('scope="col"', 'scope="all"', ["6.3.4"]), ('href="mailto:x"', 'href="javascript:x"', ["6.3.2"]), ('href="mailto:x"', 'name="x"', ["6.3", "6.3.2"]), ('href="#h-1"', 'href="#h-77"', ["6.3.2"]),
    ('src="content/assets/a.png"', 'src="http://x/a.png"', ["6.3.3"]), (' alt="" width="3"', ' width="0"', ["6.3.3", "6.3.3"]), ('datetime="2024-01-02T03:04:05Z"', 'datetime="today"', ["6.3.4"]),
    ('cite="http://x.y"', 'cite="x"', ["6.3.4"]), ('data-wdf-dataset="data/n.json"', 'data-wdf-dataset="n.csv"', ["6.5"]), (' id="p-3"', "", ["6.4.1"]), (' id="li-1"', "", ["6.4.1"]),
    (' id="p-3"', ' id="P3"', ["6.4.2"]), (' id="p-3"', ' id="p-1"', ["6.4.2"]), ('<h1 id="h-1">T</h1>', '<h2 id="h-1">T</h2>', ["6.1.5"]), ("<hr>", '<hr title="a\x07">', ["6.3.5", "6.3"]),
]


def test_every_profile_rule(spark):
    rows = [(0, SOUND)] + [(k, SOUND.replace(a, b, 1)) for k, (a, b, _) in enumerate(CASES, 1)]
    assert all(SOUND != html for k, html in rows if k)
    got = {}
    for r in profile.validate(html_nodes(spark.createDataFrame(rows, "page_id long, html string"))).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append(r.spec.removeprefix("§"))
    assert 0 not in got
    wrong = {k: (CASES[k - 1][:2], got.get(k), CASES[k - 1][2]) for k in range(1, len(rows)) if got.get(k) != CASES[k - 1][2]}
    assert not wrong


def test_violations(page):
    got = [(r.doc_id, r.spec, r.message) for r in profile.validate(page).orderBy("doc_id", "seq").collect()]
    assert got == [
        (1, "§6.4.2", 'duplicate id "p-1" (first used at html/body/article[1]/section#s-1/p#p-1)'), (1, "§6.2", "<blink> is not permitted inside <article>"),
        (1, "§6.3.2", 'fragment link "#no-where" has no matching id in this document'), (1, "§6.4.1", "citable element <li> is missing its mandatory id"),
        (1, "§6.4.1", "citable element <p> is missing its mandatory id"), (1, "§6.2", "element <blink> is not in the WDF-HTML whitelist"),
        (2, "§6.1.1", "missing <!DOCTYPE html>"), (2, "§6.1.2", '<html> must carry a BCP 47 lang attribute (got "")'), (2, "§6.1.3", 'the first child of <head> must be <meta charset="utf-8">'),
        (2, "§6.1.3", "<head> must contain exactly one <title> (found 0)"), (2, "§6.1.4", "<body> must contain exactly one <article> (found: nothing)"),
        (2, "§6.1.5", "document should contain exactly one <h1> (found 0)"),
    ]


def test_text_functions(spark):
    dates = ["2024-02-29", "2023-02-29", "0000-02-29", "1900-02-29", "2024-13-01", "x", "2024-1-1"]
    got = spark.createDataFrame([(d,) for d in dates], "d string").select(T.is_date(F.col("d")).alias("v")).collect()
    assert [r.v for r in got] == [True, False, True, False, False, False, False]
    numbers = [43776.0, 1e21, 1e-7, 0.000001, -0.0, 1.5, 123456789012345680000.0, -2.5e-9, 0.1]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select(T.number_text("x").alias("t")).collect()
    assert [r.t for r in got] == ["43776", "1e+21", "1e-7", "0.000001", "0", "1.5", "123456789012345680000", "-2.5e-9", "0.1"]
    got = spark.createDataFrame([("1. x",), ("- x",), ("-x",), ("12) y",), ("+",)], "s string").select(T.positional_escape(F.col("s")).alias("e")).collect()
    assert [r.e for r in got] == ["1\\. x", "\\- x", "-x", "12\\) y", "\\+"]
    got = spark.createDataFrame([("0",), ("007",), ("99999",), ("x",), (None,), ("12",)], "s string").select(T.parse_span(F.col("s")).alias("n")).collect()
    assert [r.n for r in got] == [1, 7, 1000, 1, 1, 12]
    assert spark.createDataFrame([("Città è Più!",)], "s string").select(T.slugify("s").alias("n")).first().n == "citta-e-piu"
    got = spark.createDataFrame([("a.PNG",), ("x/b.html",), ("c",)], "p string").select(T.media_type(F.col("p")).alias("t")).collect()
    assert [r.t for r in got] == ["image/png", "application/octet-stream", "application/octet-stream"]


def test_blocks_and_paths(spark):
    docs = spark.createDataFrame([(1, "# a {#x-1}\n\nplain\n\nb {#y-1}\n"), (2, "z\n")], "doc_id long, markdown string")
    got = [(r.doc_id, r.block_no, r.ids) for r in integrity.split_blocks(docs).orderBy("doc_id", "block_no").collect()]
    assert got == [(1, 0, ["x-1"]), (1, 1, ["x-1"]), (1, 2, ["y-1"]), (2, 0, [])]
    files = spark.createDataFrame([(1, p) for p in ("manifest.json", "a/.b", "x.css", "x.css")], "doc_id long, path string")
    assert {(r.path, r.reason) for r in integrity.bad_paths(files).collect()} == {("a/.b", "syntax"), ("x.css", "duplicate")}


def test_read_and_cite(spark, page):
    blocks = integrity.split_blocks(spark.createDataFrame([(1, to_markdown(PAGE))], "doc_id long, markdown string"))
    listed = nodes.outline(page, with_up=True)
    got = {r.id: r for r in reading.read_and_cite(listed, blocks).collect()}
    assert got["s-2"].content == "## Sub {#h-2} {#s-2}\n\nno id" and got["s-2"].uri == "wdf:1#s-2"
    assert got["t-1"].content.startswith("Cap {#t-1}\n\n| A | B |")
    assert got["h-0"].cited == "# One *two* {#h-0} {#s-1}"
    tree = {r.id: (r.root, r.children) for r in reading.outline_tree(listed).collect()}
    assert tree["s-1"] == (True, 4) and tree["s-2"] == (False, 1)
    summary = {r.doc_id: r for r in reading.open_summary(page, blocks, listed).collect()}
    assert summary[1].elements == 7 and summary[1].sections == ["One two", "Cap"] and summary[2].blocks == 0


def test_html_import_rebuilds_foreign_markup():
    html = """<html lang=it><head><title> A  title </title><style>/* x */ .t, p { font-size: 20pt; color:red; mso-x:1 } p { font-size:10px } @media x { p { color: blue } } b.z {width:1px}</style><link rel=stylesheet href=x></head>
    <body><div class=chrome>menu</div><main><p class=t>Big title</p><p>small text that is longer than the title above <b>bold</b> <a href="javascript:1">bad</a> <a href="#gone">gone</a></p>
    loose <i>run</i><ul><li>a<ul><li>b</ul><ol><li>c</ol><li>d</ul><blockquote><p>q</p><hr></blockquote><p>&nbsp;</p>
    <table><tr><td colspan=2>h</td></tr><tr><td>1</td><td align=right>2<br></td></tr></table><table><tr><td rowspan=9>x</table><form>f</form><p id=p-0002>kept</p></main></body></html>"""
    got = importing.finish(importing.import_html(html), "base")
    out, report = got["html"], got["report"]
    assert got["title"] == "A title" and got["language"] == "it"
    for part in (
        '<h1 class="w1" id="h-big-title">Big title</h1>', "<strong>bold</strong> bad gone</p>", 'id="p-0003">q</p>', 'id="p-0002-2">', "<em>run</em>", '<li id="li-0001">a', "<li>b</li>", '<blockquote id="bq-1">', '<th colspan="2">h</th>',
        '<td class="w3">2</td>', '<p id="p-0002" class="w2">kept</p>', '<table id="tbl-1">',
    ):
        assert part in out, part
    assert "&nbsp;" not in out and "menu" not in out and "<form" not in out
    assert report == [
        "extracted the main content from <main>; dropped the surrounding page chrome", 'unwrapped <a href="javascript:1"> (scheme not permitted)', "merged multiple nested lists into one",
        "dropped <hr> inside blockquote (only paragraphs allowed)", "synthesized empty <caption> for a table", "kept merged cells (colspan/rowspan)", "synthesized empty <caption> for a table",
        "dropped colspan/rowspan (table grid could not be reconciled)", "table had a single row: kept as header with empty body", "dropped <form> (not representable in WDF-HTML)",
        "dropped 1 empty spacer paragraph(s)", 'promoted styled paragraph (20pt) to <h1>: "Big title"', "translated source styling into a generated content/styles.css",
        "external stylesheet not imported (site CSS is dropped; inline styles translated)", 'unwrapped link to missing fragment "#gone"',
    ]
    assert ".w1 {\n  color: red;\n  font-size: 20pt;\n}" in got["stylesheet"] and ".w3 {\n  text-align: right;\n}" in got["stylesheet"]


def test_styles_and_ids():
    assert styles.declarations("a:1; b : x:y ;;c;A:2") == {"a": "2", "b": "x:y"}
    assert styles.safe({"color": "url(x)", "position": "fixed", "font-family": "Times", "left": "1"}) == {"font-family": "Times, serif"}
    assert [(r.tag, r.cls) for r in styles.stylesheet_rules("p, .a, b.c, d > e {x:1} @page { q {x:1} } f {")] == [("p", None), (None, "a"), ("b", "c")]
    blocks = [importing.element("p", {"id": "p-0001"}), importing.element("p", {"id": "p-0001"}), importing.element("h2", {}, [importing.text("Ü b!")]), importing.element("h2", {}, [importing.text("u B")]), importing.element("h3")]
    report = []
    importing.ensure_ids(blocks, report)
    assert [b.get("id") for b in blocks] == ["p-0001", "p-0001-2", "h-u-b", "h-u-b-2", "h-1"]
    assert report == ['replaced non-conforming or duplicate id "p-0001" on <p>']


def test_markdown_import():
    source = "# A *b* `c`\r\n\r\npara\\\nnext **x _y_** [l](#no) [m](http://a \"t\") ![i](z) \\* `` q`r ``\n- a\n  1. b\n- c\n\n> q\n>\n> r\n\n| a | b |\n|---|:-:|\n| 1 |\n\n```py\nx\n\ny\n```\n* * *\n***\n1) z\ntail ** open"
    got = importing.finish(import_markdown(source), "base")
    for part in (
        '<h1 id="h-a-b-c">A <em>b</em> <code>c</code></h1>', 'para<br />next <strong>x <em>y</em></strong> l <a href="http://a">m</a> i * <code>q`r</code></p>', "<ol>\n            <li>b</li>",
        '<blockquote id="bq-1">', "<td></td>", '<pre><code class="language-py">x\n\ny</code></pre>', "<hr />", '<li id="li-0003">* *</li>', "tail ** open",
    ):
        assert part in got["html"], part
    assert got["title"] == "A b c" and got["report"] == ['dropped Markdown image "z" (images must live under content/assets/)', "synthesized empty <caption> for a Markdown table", 'unwrapped link to missing fragment "#no"']
    assert importing.finish(import_markdown(None), "base") is None


MANIFEST = {"wdf": "0.1", "id": "urn:uuid:00000000-0000-5000-8000-000000000000", "title": "t", "language": "en", "created": "2024-01-01T00:00:00Z", "modified": "2024-01-01T00:00:00Z", "entry": "content/index.html"}


def sound_files(**changes):
    files = {"manifest.json": packages.pretty(MANIFEST | changes.pop("manifest", {})).encode(), "content/index.html": PAGE.encode()}
    return packages.build(files) | {k: v for k, v in changes.items()}


def test_structure_is_checked_in_order(spark):
    extra = {"resources": [{"path": "content/assets/a.png", "mediaType": "image/png"}], "extensions": [{"name": "x"}]}
    whole = packages.build({"manifest.json": packages.pretty(MANIFEST | extra).encode(), "content/index.html": PAGE.encode(), "content/assets/a.png": b"1", "ext/x/y": b"2"})
    cases = [
        (whole, None), ({**whole, "a/../b": b""}, "§3.2.1"), ({**whole, "readme": b""}, "§3.2.3"), ({**whole, "integrity/x": b""}, "§3.3.3"), ({k: v for k, v in whole.items() if k != "ai/content.md"}, "§3.3.1"),
        ({**whole, "manifest.json": b"\xef\xbb\xbf{}"}, "§2"), ({**whole, "manifest.json": b"{"}, "§4"), ({**whole, "manifest.json": b'{"wdf":NaN}'}, "§4"), ({**whole, "manifest.json": b"{}"}, "§4"),
        ({k: v for k, v in whole.items() if "assets" not in k}, "§4.1.1"), ({**whole, "content/more.png": b""}, "§3.3.4"), ({**whole, "data/x.json": b""}, "§3.3.4"), ({**whole, "ext/q/z": b""}, "§10.2"),
        ({**whole, "ext/x": b""}, "§10.2"), ({k: v for k, v in whole.items() if "ext/" not in k}, "§10.2"),
    ]
    for files, spec in cases:
        try:
            packages.check_structure(files)
            assert spec is None
        except packages.Refused as e:
            assert e.args[0] == spec, (spec, e.args)
    packed = packages.pack(whole)
    assert packages.pack(dict(reversed(list(packages.unpack(packed).items())))) == packed
    rows = [(1, packed), (2, b"no zip"), (3, None), (4, packed[:-30])]
    got = {r.doc_id: r for r in packages.open_packages(spark.createDataFrame(rows, "doc_id long, bytes binary")).collect()}
    assert got[1].problem is None and len(got[1].files) == len(whole) and {got[k].problem.spec for k in (2, 3, 4)} == {"§3.1"}


def test_schemas():
    assert schemas.problems("manifest", MANIFEST) == []
    assert schemas.problems("manifest", MANIFEST | {"x": 1, "title": "", "created": "2024-02-30T00:00:00Z"}) == [
        "/ must NOT have additional properties", "/title must NOT have fewer than 1 characters", '/created must match format "date-time"',
    ]
    node = {"id": "h-1", "type": "heading", "parent": None}
    assert schemas.problems("outline", [node]) == ["/0 must have required property 'level'"] and schemas.problems("outline", [node | {"level": 2}]) == []
    assert schemas.problems("outline", [node | {"type": "section", "level": 2}]) == ["/0 must NOT be valid"]
    assert schemas.problems("pagination", {"pagination": "0.1", "breakBefore": ["p-1", "p-1"]}) == ["/breakBefore must NOT have duplicate items"]
    assert schemas.problems("hashes", {"algorithm": "md5", "files": {"x": "0"}}) == ["/algorithm must be equal to constant", "/files property name must be valid", '/files/x must match pattern "^[0-9a-f]{64}$"']
    view = {"width": 1.5, "height": 2, "devicePixelRatio": 0}
    capture = {"capture": "0.1", "url": "ftp://x", "capturedAt": "x", "userAgent": "u", "viewport": view, "mode": "all"}
    assert len(schemas.problems("capture", capture)) == 5


def test_verification_and_page_breaks(spark):
    rows = [(1, sound_files()), (2, sound_files(**{"ai/outline.json": b"[]\n"})), (3, sound_files(**{"integrity/hashes.json": b"{}"}))]
    files = spark.createDataFrame([(i, p, bytearray(b)) for i, f in rows for p, b in f.items()], "doc_id long, path string, bytes binary")
    got = {r.doc_id: (r.integrity, r.determinism, [p.spec for p in r.problems]) for r in packages.verify(files).collect()}
    assert got == {1: (True, True, []), 2: (False, False, ["§8.2", "§7.1.2"]), 3: (False, True, ["§8.1"])}
    tree = html_nodes(spark.createDataFrame([(i, PAGE) for i in (1, 2, 3)], "page_id long, html string"))
    breaks = spark.createDataFrame([(1, 0, "h-0"), (1, 1, "t-1"), (2, 0, "t-1"), (2, 1, "h-0"), (3, 0, "t-1"), (3, 1, "x-1")], "doc_id long, list_no int, id string")
    assert sorted(map(tuple, packages.page_breaks(breaks, tree).collect())) == [(2, "order", None), (3, "missing", "x-1")]


def test_dataset_problems(spark):
    columns = [("a", "integer"), ("a", "date")]
    cases = [b"{", b"[]", b'{"columns":[],"rows":[]}', b'{"columns":[{"name":"a","type":"integer"},{"name":"a","type":"date"}],"rows":[[1e3,"2024-02-29"],[1.5,"2023-02-29"],[null,null],[1],[1e400,"x"],[43776.0,null]]}']
    rows = [(k, "data/a.json", bytearray(c), columns) for k, c in enumerate(cases)]
    parsed = datasets.parse_datasets(spark.createDataFrame(rows, "doc_id long, path string, bytes binary, columns array<struct<name:string,type:string>>"))
    got = [(r.doc_id, r.spec, r.message[:22]) for r in datasets.dataset_problems(parsed).orderBy("doc_id", "rank", "message").collect()]
    assert [g[:2] for g in got] == [(0, "§5.1"), (1, "§5.1"), (2, "§5.1.1"), (2, "§5.1.2"), (3, "§5.1.2"), (3, "§5.1.3")] + [(3, "§5.1.4")] * 4
    assert [g[2][:5] for g in got[-4:]] == ["row 2", "row 2", "row 5", "row 5"]


def test_rest_works_without_the_training_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    for keep in (False, True):
        if keep:  # the pipeline's file alone must not break the entry either
            shutil.copy(f"{ROOT}/corpus_pipeline.py", copy)
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and o and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q)"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
