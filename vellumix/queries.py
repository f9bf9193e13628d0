"""Registered queries of the document engine and their DuckDB restatements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumix.functions import text as T
from vellumix.operators import datasets, importing, integrity, nodes, packages, profile, reading
from vellumix.operators.markdown import with_markdown
from vellumix.sources.html import html_nodes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


@query("page_digest", "SELECT page_id, sha256(html) AS digest FROM pages")
def page_digest(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html"), 256).alias("digest"))


@query(
    "verify_digests",
    """
    WITH a AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'content/only-here.html' ELSE 'content/index.html' END AS path, sha256(coalesce(text, '')) AS have FROM documents),
         b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'content/only-told.html' ELSE 'content/index.html' END AS path,
                      sha256(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END) AS want FROM documents)
    SELECT doc_id, path, have, want, CASE WHEN want IS NULL THEN 'missing-digest' WHEN have IS NULL THEN 'missing-file' ELSE 'mismatch' END AS outcome
    FROM a FULL OUTER JOIN b USING (doc_id, path) WHERE want IS NULL OR have IS NULL OR want <> have""",
)
def verify_digests(spark, sf_dir):
    """Files and declared digests of all documents, made to disagree so that each outcome is met."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    place = lambda k, other: F.when(F.col("doc_id") % k == 0, other).otherwise("content/index.html").alias("path")
    files = docs.select("doc_id", place(7, "content/only-here.html"), F.col("text").cast("binary").alias("bytes"))
    told = F.concat("text", F.when(F.col("doc_id") % 5 == 0, "!").otherwise(""))
    declared = docs.select("doc_id", place(11, "content/only-told.html"), F.sha2(told.cast("binary"), 256).alias("digest"))
    return integrity.compare_digests(integrity.digests(files), declared)


#: Documents as Markdown with blocks: a comma ends a block without an anchor, a stop or an exclamation one with.
ANCHORED = r"replace(replace(replace(text, '! ', ' {#s-bang}' || chr(10) || chr(10)), '. ', ' {#p-dot}' || chr(10) || chr(10)), ', ', chr(10) || chr(10))"


@query(
    "split_blocks",
    rf"""
    WITH m AS (SELECT doc_id, regexp_replace({ANCHORED}, '\n\z', '') AS md FROM documents WHERE text IS NOT NULL AND text NOT IN ('', chr(10))),
         b AS (SELECT doc_id, unnest(range(len(p))) AS block_no, unnest(p) AS text FROM (SELECT doc_id, string_split(md, chr(10) || chr(10)) AS p FROM m)),
         o AS (SELECT *, CASE WHEN contains(text, '{{#s-bang}}') OR contains(text, '{{#p-dot}}') THEN array_to_string(regexp_extract_all(text, '\{{#([a-z]+-[a-z0-9-]*)\}}', 1), ',') END AS own FROM b)
    SELECT doc_id, block_no::INT AS block_no, text, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no), '') AS ids FROM o""",
)
def split_blocks(spark, sf_dir):
    """Blocks with the ids that they have or inherit from the block before."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.expr(ANCHORED).alias("markdown"))
    return integrity.split_blocks(docs).withColumn("ids", F.array_join("ids", ","))


@query("escape_text", r"SELECT doc_id, regexp_replace(text, '([\\`*_\[\]{}<>&|#])', '\\\1', 'g') AS escaped FROM documents")
def escape_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.escape_text(F.col("text")).alias("escaped"))


@query(
    "source_uuid",
    """
    WITH h AS (SELECT page_id, sha256(url) AS h FROM pages)
    SELECT page_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16],
        CASE WHEN h[17] IN ('0', '4', '8', 'c') THEN '8' WHEN h[17] IN ('1', '5', '9', 'd') THEN '9' WHEN h[17] IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || h[18:20],
        h[21:32]) AS uuid FROM h""",
)
def source_uuid(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.deterministic_uuid(F.col("url")).alias("uuid"))


@query(
    "order_dates",
    """WITH t AS (SELECT o_orderkey, lpad((1895 + o_orderkey % 210)::VARCHAR, 4, '0') || '-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 33)::VARCHAR, 2, '0') AS text FROM orders)
       SELECT o_orderkey, text, try_cast(text AS DATE) IS NOT NULL AS valid FROM t""",
)
def order_dates(spark, sf_dir):
    """Dates of every order's number, many of them impossible, centuries' leap days among them."""
    two = lambda k: F.lpad((F.col("o_orderkey") % k).cast("string"), 2, "0")
    year = F.lpad((F.col("o_orderkey") % 210 + 1895).cast("string"), 4, "0")
    text = F.concat_ws("-", year, two(14), two(33))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).withColumn("valid", T.is_date(F.col("text")))


@query(
    "line_report",
    r"""
    WITH l AS (SELECT doc_id, unnest(range(len(p))) AS seq, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
         g AS (SELECT doc_id, line, count(*) AS n, min(seq) AS seq FROM l GROUP BY doc_id, line)
    SELECT doc_id, seq::INT AS seq, CASE WHEN n > 1 THEN line || ' (×' || n || ')' ELSE line END AS line FROM g""",
)
def line_report(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    return integrity.aggregate_report(lines)


#: Pages are regular: one article of an h1 and paragraphs, of which some open a b that nothing closes.
#: Every paragraph then reopens the b elements still active, three at most, and its own one comes on top.
PARAGRAPHS = r"""
    WITH a AS (SELECT page_id, html, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS s FROM pages),
    t AS (SELECT page_id, html, trim(replace(replace(regexp_extract(s, '(?s)<h1>(.*?)</h1>', 1), '&quot;', '"'), '&amp;', '&')) AS title FROM a),
    p0 AS (SELECT page_id, string_split(s, '<p>') AS x FROM a),
    p1 AS (SELECT page_id, unnest(range(1, len(x))) AS n, x FROM p0),
    p2 AS (SELECT page_id, n::INT AS n, x[n + 1] AS raw FROM p1),
    p3 AS (SELECT *, sum(contains(raw, '<b>')::INT) OVER (PARTITION BY page_id ORDER BY n) AS k FROM p2),
    p AS (SELECT page_id, n, k, contains(raw, '<br>') AS ends, (CASE WHEN contains(raw, '<b>') THEN least(k - 1, 3) + 1 ELSE least(k, 3) END)::INT AS depth,
                 replace(replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&') AS text FROM p3),
    h0 AS (SELECT page_id, title, regexp_replace(substr(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', '') AS slug FROM t),
    h AS (SELECT page_id, title, 'h-' || CASE WHEN slug = '' THEN '1' ELSE slug END AS id FROM h0)"""
#: Markdown blocks of pages: the heading is number 0.
BLOCKS = PARAGRAPHS + r""",
    b AS (SELECT page_id, 0 AS n, id, '# ' || regexp_replace(title, '([\\`*_\[\]{}<>&|#])', '\\\1', 'g') || ' {#' || id || '}' AS block FROM h
          UNION ALL
          SELECT page_id, n, 'p-' || lpad(n::VARCHAR, 4, '0'), repeat('**', depth) || regexp_replace(text, '([\\`*_\[\]{}<>&|#])', '\\\1', 'g')
                 || CASE WHEN ends THEN '\' || chr(10) ELSE '' END || repeat('**', depth) || ' {#p-' || lpad(n::VARCHAR, 4, '0') || '}' FROM p)"""


def imported(spark, sf_dir):
    return importing.import_pages(table(spark, sf_dir, "pages"))


def imported_nodes(spark, sf_dir):
    return html_nodes(imported(spark, sf_dir), "doc_id")


@query("page_title_lang", PARAGRAPHS + r""" SELECT page_id AS doc_id, title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language FROM t""")
def page_title_lang(spark, sf_dir):
    return imported(spark, sf_dir).select("doc_id", "title", "language")


@query("page_landmark", "SELECT page_id AS doc_id, 'article' AS label FROM pages")
def page_landmark(spark, sf_dir):
    return nodes.landmark(html_nodes(table(spark, sf_dir, "pages"))).select("doc_id", "label")


@query("page_emphasis_depth", PARAGRAPHS + " SELECT page_id AS doc_id, 'p-' || lpad(n::VARCHAR, 4, '0') AS id, depth FROM p")
def page_emphasis_depth(spark, sf_dir):
    """How many strong elements hold each paragraph's text once b elements that nothing closes are reopened."""
    rows = imported_nodes(spark, sf_dir)
    # each strong holds the next one, so a paragraph's strong elements are the depth; the id is carried by its outline row
    mine = rows.where("tag in ('p', 'strong')").withColumn("id", F.when(F.col("tag") == "p", nodes.attr("id")))
    path = F.regexp_extract("xpath", r"\A(html/body/article\[1\]/p#[^/]*)", 1)
    return mine.groupBy("doc_id", path.alias("path")).agg(F.max("id").alias("id"), F.count_if(F.col("tag") == "strong").cast("int").alias("depth")).drop("path")


@query("page_markdown", BLOCKS + " SELECT page_id AS doc_id, string_agg(block, chr(10) || chr(10) ORDER BY n) || chr(10) AS markdown FROM b GROUP BY page_id")
def page_markdown(spark, sf_dir):
    return with_markdown(imported(spark, sf_dir)).select("doc_id", "markdown")


@query(
    "page_outline",
    PARAGRAPHS + r"""
    SELECT page_id AS doc_id, 0 AS ord, id, 'heading' AS type, 1 AS level, nullif(title, '') AS title, NULL::VARCHAR AS parent FROM h
    UNION ALL SELECT page_id, n, 'p-' || lpad(n::VARCHAR, 4, '0'), 'paragraph', NULL, NULL, NULL FROM p""",
)
def page_outline(spark, sf_dir):
    return nodes.outline(imported_nodes(spark, sf_dir))


@query("read_and_cite", BLOCKS + " SELECT page_id AS doc_id, id, 'wdf:' || page_id || '#' || id AS uri, block AS content, block AS cited FROM b")
def read_and_cite(spark, sf_dir):
    """Every citable element of every page with its URI, the blocks of its subtree, and the block that a citation shows."""
    docs = imported(spark, sf_dir)
    listed = nodes.outline(html_nodes(docs, "doc_id"), with_up=True)
    return reading.read_and_cite(listed, integrity.split_blocks(with_markdown(docs).select("doc_id", "markdown")))


@query("page_validity", "SELECT page_id AS doc_id, 0 AS errors, 0 AS warnings, true AS valid FROM pages")
def page_validity(spark, sf_dir):
    """Imported pages conform to the profile."""
    rows = imported_nodes(spark, sf_dir)
    docs = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    return profile.validity(docs, profile.validate(rows)).withColumns({c: F.col(c).cast("int") for c in ("errors", "warnings")})


@query("page_violations", PARAGRAPHS + r""",
    l AS (SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS items FROM a),
    q AS (SELECT page_id, count(*) AS n, sum(depth) AS bs, count(*) FILTER (depth > 0) AS bold, max(k) AS k FROM p GROUP BY page_id),
    c AS (SELECT page_id, unnest([
        {'spec': '§6.1.3', 'n': 2}, {'spec': '§6.1.4', 'n': 1}, {'spec': '§6.3.2', 'n': items}, {'spec': '§6.4.1', 'n': items + 1 + q.n}, {'spec': '§6.2.3', 'n': bold},
        {'spec': '§6.2', 'n': 1 + bs + least(k, 3) + 1}]) AS v FROM l JOIN q USING (page_id))
    SELECT page_id AS doc_id, v.spec AS spec, v.n::BIGINT AS n FROM c WHERE v.n > 0""")
def page_violations(spark, sf_dir):
    """Violations of the pages as they are, by section."""
    return profile.validate(html_nodes(table(spark, sf_dir, "pages"))).groupBy("doc_id", "spec").agg(F.count("*").alias("n"))


@query("page_tags", PARAGRAPHS + r""",
    l AS (SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS items FROM a),
    q AS (SELECT page_id, count(*) AS n, sum(depth) AS bs, count(*) FILTER (ends) AS br, max(k) AS k FROM p GROUP BY page_id),
    c AS (SELECT page_id, unnest([
        {'tag': 'li', 'n': items}, {'tag': 'a', 'n': items}, {'tag': 'p', 'n': q.n}, {'tag': 'b', 'n': bs + least(k, 3)}, {'tag': 'br', 'n': br},
        {'tag': 'html', 'n': 1}, {'tag': 'head', 'n': 1}, {'tag': 'body', 'n': 1}, {'tag': 'meta', 'n': 1}, {'tag': 'title', 'n': 1}, {'tag': 'style', 'n': 1}, {'tag': 'script', 'n': 1},
        {'tag': 'nav', 'n': 1}, {'tag': 'ul', 'n': 1}, {'tag': 'div', 'n': 1}, {'tag': 'article', 'n': 1}, {'tag': 'h1', 'n': 1}, {'tag': 'footer', 'n': 1}]) AS v FROM l JOIN q USING (page_id))
    SELECT page_id AS doc_id, v.tag AS tag, v.n::BIGINT AS n FROM c WHERE v.n > 0""")
def page_tags(spark, sf_dir):
    """Elements of the parsed pages by tag, implied and reopened ones included."""
    return html_nodes(table(spark, sf_dir, "pages")).where("kind = 'element'").groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


@query("page_nodes")
def page_nodes(spark, sf_dir):
    return html_nodes(table(spark, sf_dir, "pages")).select("doc_id", "pre", "post_end", "parent", "depth", "kind", "tag", "text", "xpath")


def page_packages(spark, sf_dir):
    """Canonical packages of all imported pages."""
    docs = imported(spark, sf_dir).where("html is not null")
    urn = F.concat(F.lit("urn:uuid:"), T.deterministic_uuid(F.col("html")))
    date = F.lit("2024-01-01T00:00:00Z")
    manifest = F.to_json(F.struct(
        F.lit("0.1").alias("wdf"), urn.alias("id"), "title", "language", date.alias("created"), date.alias("modified"), F.lit("content/index.html").alias("entry"),
    ))
    one = lambda path, text: F.struct(F.lit(path).alias("path"), text.cast("binary").alias("bytes"))
    styles = F.when(F.col("stylesheet").isNotNull(), one("content/styles.css", F.col("stylesheet")))
    files = F.array_compact(F.array(one("manifest.json", manifest), one("content/index.html", F.col("html")), styles))
    return packages.build_packages(docs.select("doc_id", files.alias("files")))


@query(
    "package_roundtrip",
    "SELECT page_id AS doc_id, 'ai/content.md,ai/outline.json,content/index.html,content/styles.css,integrity/hashes.json,manifest.json' AS paths, true AS verified, 'verified' AS badge FROM pages",
)
def package_roundtrip(spark, sf_dir):
    """Packages of all pages, written, read again, checked and verified."""
    opened = packages.open_packages(page_packages(spark, sf_dir))
    files = packages.files_of(opened)
    paths = files.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("paths"))
    state = packages.verify(files).select("doc_id", "verified")
    shown = packages.badge(F.lit(None).cast("string"), F.lit(0), F.col("verified"))
    return paths.join(state, "doc_id").select("doc_id", "paths", "verified", shown.alias("badge"))


@query(
    "package_tamper",
    """SELECT page_id AS doc_id, page_id % 4 IN (0) AS integrity, page_id % 4 IN (0, 3) AS determinism,
              CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '§8.2 ai/content.md,§7.1.1 ai/content.md' WHEN 2 THEN '§8.1 content/index.html,§7.1.1 ai/content.md,§7.1.2 ai/outline.json' ELSE '§8.1 data/more.json' END AS problems
       FROM pages""",
)
def package_tamper(spark, sf_dir):
    """Files of all pages' packages, in four states: as they are, a changed file, an entry whose digest is not told, a file too many."""
    files = packages.files_of(packages.open_packages(page_packages(spark, sf_dir)))
    state = F.col("doc_id") % 4
    changed = F.when((state == 1) & (F.col("path") == "ai/content.md"), F.lit(b"other\n")).when(
        (state == 2) & (F.col("path") == "content/index.html"), F.lit(b"<article><p id=p-1>x</article>")).otherwise(F.col("bytes"))
    # in the third state the digest list names the entry by another name
    renamed = F.regexp_replace(F.col("bytes").cast("string"), r'\n    "content/index.html": "[0-9a-f]{64}",', "").cast("binary")
    files = files.withColumn("bytes", F.when((state == 2) & (F.col("path") == packages.HASHES), renamed).otherwise(changed))
    more = files.where((state == 3) & (F.col("path") == "manifest.json")).select("doc_id", F.lit("data/more.json").alias("path"), F.lit(b"{}").alias("bytes"))
    got = packages.verify(files.unionByName(more))
    said = F.array_join(F.transform("problems", lambda p: F.concat(p["spec"], F.lit(" "), p["path"])), ",")
    return got.select("doc_id", "integrity", "determinism", said.alias("problems"))


@query(
    "required_files",
    """WITH r AS (SELECT unnest(range(5)) AS k, unnest(['manifest.json', 'content/index.html', 'ai/content.md', 'ai/outline.json', 'integrity/hashes.json']) AS path)
       SELECT s_suppkey AS doc_id, path FROM supplier, r WHERE s_suppkey % 6 = k OR s_suppkey % 6 = 5""",
)
def required_files(spark, sf_dir):
    """Packages that each lack one required file, and some without any file."""
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"))
    files = docs.select("doc_id", F.posexplode(F.array(*map(F.lit, packages.REQUIRED))).alias("k", "path")).where((F.col("doc_id") % 6 != F.col("k")) & (F.col("doc_id") % 6 != 5))
    return packages.missing_files(docs, files)


@query(
    "listing_bijection",
    """WITH f AS (SELECT DISTINCT p_size AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN 'data/' || p_partkey || '.json' ELSE 'content/assets/' || p_partkey || '.png' END AS path, p_partkey AS k FROM part),
            l AS (SELECT doc_id, path FROM f WHERE k % 5 <> 0 UNION ALL SELECT doc_id, path FROM f WHERE k % 7 = 0 AND k % 5 <> 0 UNION ALL SELECT doc_id, 'content/lost-' || k || '.png' FROM f WHERE k % 11 = 0),
            n AS (SELECT doc_id, path, count(*) AS n FROM l GROUP BY ALL),
            b AS (SELECT doc_id, path, n, f.path IS NOT NULL AS there FROM n FULL JOIN f USING (doc_id, path))
       SELECT doc_id, CASE WHEN starts_with(path, 'data/') THEN 'dataset' ELSE 'resource' END AS kind, path, outcome FROM (
            SELECT doc_id, path, 'duplicate' AS outcome FROM b WHERE n > 1 UNION ALL SELECT doc_id, path, 'missing' FROM b WHERE NOT there UNION ALL SELECT doc_id, path, 'unlisted' FROM b WHERE n IS NULL)""",
)
def listing_bijection(spark, sf_dir):
    """Parts as files of packages (one for each size), and listings with files left out, twice there or lost."""
    key = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("data/"), key, F.lit(".json"))).otherwise(F.concat(F.lit("content/assets/"), key, F.lit(".png")))
    files = table(spark, sf_dir, "part").select(F.col("p_size").alias("doc_id"), path.alias("path"), F.col("p_partkey").alias("k"))
    kept = files.where("k % 5 <> 0")
    lost = files.where("k % 11 = 0").select("doc_id", F.concat(F.lit("content/lost-"), F.col("k").cast("string"), F.lit(".png")).alias("path"))
    told = kept.select("doc_id", "path").unionByName(kept.where("k % 7 = 0").select("doc_id", "path")).unionByName(lost)
    kind = F.when(F.col("path").startswith("data/"), "dataset").otherwise("resource")
    return packages.listing_problems(files, told.withColumn("kind", kind))


@query(
    "extension_bijection",
    """WITH f AS (SELECT DISTINCT c_nationkey AS doc_id, lower(replace(c_mktsegment, ' ', '-')) AS name FROM customer WHERE c_custkey % 23 = 0),
            d AS (SELECT DISTINCT c_nationkey AS doc_id, lower(replace(c_mktsegment, ' ', '-')) AS name FROM customer WHERE c_custkey % 19 = 0)
       SELECT doc_id, name, 'undeclared' AS outcome FROM f ANTI JOIN d USING (doc_id, name) UNION ALL SELECT doc_id, name, 'without files' FROM d ANTI JOIN f USING (doc_id, name)""",
)
def extension_bijection(spark, sf_dir):
    """Extension folders and declarations, from market segments of each nation."""
    name = F.lower(F.replace("c_mktsegment", F.lit(" "), F.lit("-")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), name.alias("name"), "c_custkey")
    files = rows.where("c_custkey % 23 = 0").select("doc_id", F.concat(F.lit("ext/"), "name", F.lit("/"), F.col("c_custkey").cast("string")).alias("path"))
    return packages.extension_problems(files, rows.where("c_custkey % 19 = 0").select("doc_id", "name"))


@query(
    "package_paths",
    r"""WITH p AS (SELECT page_id, substr(url, position('://' IN url) + 3) AS path FROM pages) SELECT page_id, path, regexp_full_match(path, '[A-Za-z0-9][A-Za-z0-9._-]*(/[A-Za-z0-9][A-Za-z0-9._-]*)*') AS valid FROM p""",
)
def package_paths(spark, sf_dir):
    path = F.expr("substr(url, instr(url, '://') + 3)")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("valid", T.is_package_path(F.col("path")))


@query(
    "dataset_cell_types",
    r"""WITH e AS (SELECT event_id, unnest([{'t': 'integer', 'v': props->'$.k'}, {'t': 'string', 'v': props->'$.k'}, {'t': 'number', 'v': to_json(value)}, {'t': 'integer', 'v': to_json(value)},
                                          {'t': 'string', 'v': to_json(event_type)}, {'t': 'date', 'v': to_json(ts::DATE::VARCHAR)}, {'t': 'date', 'v': to_json(event_type)}, {'t': 'boolean', 'v': to_json(value > 50)}]) AS c FROM events)
       SELECT event_id, c.t AS type, count(*) AS n, count(*) FILTER (c.v IS NULL OR CASE c.t WHEN 'integer' THEN json_type(c.v) IN ('BIGINT', 'UBIGINT') OR json_type(c.v) = 'DOUBLE' AND (c.v::VARCHAR)::DOUBLE = floor((c.v::VARCHAR)::DOUBLE)
            WHEN 'number' THEN json_type(c.v) IN ('BIGINT', 'UBIGINT', 'DOUBLE') WHEN 'string' THEN json_type(c.v) = 'VARCHAR' WHEN 'boolean' THEN json_type(c.v) = 'BOOLEAN'
            ELSE json_type(c.v) = 'VARCHAR' AND try_cast(c.v->>'$' AS DATE) IS NOT NULL END) AS valid
       FROM e GROUP BY ALL""",
)
def dataset_cell_types(spark, sf_dir):
    """Cells of all events tested against several types; how many of each event's are valid."""
    value = F.col("value").cast("string")
    cell = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("raw"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    k = F.get_json_object("props", "$.k")
    made = F.array(
        cell("integer", k), cell("string", k), cell("number", value), cell("integer", value), cell("string", quoted(F.col("event_type"))),
        cell("date", quoted(F.date_format("ts", "yyyy-MM-dd"))), cell("date", quoted(F.col("event_type"))), cell("boolean", (F.col("value") > 50).cast("string")),
    )
    rows = table(spark, sf_dir, "events").select("event_id", F.inline(made))
    ok = F.col("raw").isNull() | datasets.cell_matches(F.col("raw"), F.col("type"))
    return rows.groupBy("event_id", "type").agg(F.count("*").alias("n"), F.count_if(F.coalesce(ok, F.lit(True))).alias("valid"))


@query(
    "dataset_roundtrip",
    """WITH c AS (SELECT n_regionkey AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, n_nationkey AS k, n_name AS name FROM nation)
       SELECT doc_id, 'row ' || r || ', cell 2: table shows "' || lower(name) || '", canonical rendering of "' || name || '" is "' || name || '"' AS message FROM c WHERE k % 3 = 0
       UNION ALL SELECT doc_id, 'row ' || r || ', cell 1: table shows "' || k || '.0", canonical rendering of ' || k || '.0 is "' || k || '"' FROM c WHERE k % 4 = 1""",
)
def dataset_roundtrip(spark, sf_dir):
    """A dataset and a bound table of the nations of each region; some shown values differ from the data."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("string")
    number = F.when(F.col("n_nationkey") % 4 == 1, F.concat(k, F.lit(".0"))).otherwise(k)
    name = F.when(F.col("n_nationkey") % 3 == 0, F.lower("n_name")).otherwise(F.col("n_name"))
    data = F.concat(F.lit("["), number, F.lit(',"'), "n_name", F.lit('"]'))
    shown = F.concat(F.lit("<tr><td>"), number, F.lit("</td><td>"), name, F.lit("</td></tr>"))
    rows = n.groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", data.alias("data"), shown.alias("shown")))).alias("rows"))
    joined = lambda field, sep: F.array_join(F.transform("rows", lambda x: x[field]), sep)
    html = F.concat(
        F.lit('<!DOCTYPE html><body><article><table id="tbl-1" data-wdf-dataset="data/n.json"><caption></caption><thead><tr><th>key</th><th>name</th></tr></thead><tbody>'),
        joined("shown", ""), F.lit("</tbody></table></article></body>"),
    )
    json = F.concat(F.lit('{"columns":[{"name":"key","type":"integer"},{"name":"name","type":"string"}],"rows":['), joined("data", ","), F.lit("]}"))
    columns = F.array(*(F.struct(F.lit(a).alias("name"), F.lit(b).alias("type")) for a, b in (("key", "integer"), ("name", "string"))))
    files = rows.select("doc_id", F.lit("data/n.json").alias("path"), json.cast("binary").alias("bytes"), columns.alias("columns"))
    return datasets.correspondence(html_nodes(rows.select("doc_id", html.alias("html")), "doc_id"), datasets.parse_datasets(files)).select("doc_id", "message")


@query("body_size", "WITH w AS (SELECT p_brand AS doc_id, p_size AS size, sum(length(p_name)) AS w FROM part GROUP BY ALL) SELECT doc_id, arg_max(size, w * 1000 - size) AS size FROM w GROUP BY doc_id")
def body_size(spark, sf_dir):
    """The size that most text has, with parts as paragraphs of their brand's document."""
    return datasets.body_size(table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_size").alias("size"), F.col("p_name").alias("text")))


@query(
    "style_classes",
    """WITH f AS (SELECT p_brand, p_type, min(p_partkey) AS f FROM part GROUP BY ALL), k AS (SELECT *, dense_rank() OVER (PARTITION BY p_brand ORDER BY f) AS k FROM f)
       SELECT p_partkey, 'w' || k AS class FROM part JOIN k USING (p_brand, p_type)""",
)
def style_classes(spark, sf_dir):
    """Class names of distinct signatures in first-seen order, with types as signatures of their brand's document."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("doc_id"), "p_type")
    return datasets.first_of_each(rows, "p_type", "p_partkey").select("p_partkey", F.concat(F.lit("w"), F.col("k").cast("string")).alias("class"))


@query(
    "style_lines",
    r"""WITH s AS (SELECT s_suppkey AS doc_id, '/* ' || CASE WHEN s_suppkey % 2 = 0 THEN '@import' ELSE 'url(x)' END || ' */ p { color: red' || CASE s_suppkey % 6 WHEN 0 THEN '; background: URL (a)' WHEN 1 THEN '; position : fixed' WHEN 2 THEN '} @Import "x"; a {' WHEN 3 THEN '; position:sticky' WHEN 4 THEN '} @font-face {' ELSE '' END || ' }' AS css FROM supplier),
            c AS (SELECT doc_id, regexp_replace(css, '(?s)/\*.*?\*/', '', 'g') AS css FROM s),
            r AS (SELECT unnest(['@import\b', '@font-face\b', '\burl\s*\(', '\bposition\s*:\s*fixed\b', '\bposition\s*:\s*sticky\b']) AS p,
                         unnest(['@import is not permitted', '@font-face is not permitted', 'url(…) is not permitted in any form', 'position: fixed is not permitted', 'position: sticky is not permitted']) AS message)
       SELECT doc_id, message FROM c, r WHERE regexp_matches(css, p, 'i')""",
)
def style_lines(spark, sf_dir):
    """Stylesheets with what they must not hold, in and outside comments."""
    k = F.col("s_suppkey") % 6
    note = F.when(F.col("s_suppkey") % 2 == 0, "@import").otherwise("url(x)")
    more = F.when(k == 0, "; background: URL (a)").when(k == 1, "; position : fixed").when(k == 2, '} @Import "x"; a {').when(k == 3, "; position:sticky").when(k == 4, "} @font-face {").otherwise("")
    css = F.concat(F.lit("/* "), note, F.lit(" */ p { color: red"), more, F.lit(" }"))
    return profile.validate_stylesheet(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), css.alias("css"))).select("doc_id", "message")


@query(
    "canonical_numbers",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice = floor(l_extendedprice) THEN l_extendedprice::BIGINT::VARCHAR ELSE l_extendedprice::VARCHAR END AS price,
              CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity::BIGINT::VARCHAR ELSE l_quantity::VARCHAR END AS quantity FROM lineitem""",
)
def canonical_numbers(spark, sf_dir):
    """Numbers as bound tables show them."""
    text = lambda c: datasets.canonical_text(F.col(c).cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text("l_extendedprice").alias("price"), text("l_quantity").alias("quantity"))


@query(
    "parsed_spans",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '-' || o_orderkey ELSE o_orderkey::VARCHAR END AS raw, (CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE least(greatest(o_orderkey, 1), 1000) END)::INT AS span FROM orders""",
)
def parsed_spans(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("-"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).withColumn("span", T.parse_span(F.col("raw")))


@query(
    "slugs",
    r"""SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(strip_accents(substr(text, 1, 80))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', '') AS slug FROM documents WHERE text IS NOT NULL""",
)
def slugs(spark, sf_dir):
    """Slugs of the titles (first eighty characters) of all documents."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.slugify(F.substring("text", 1, 80)).alias("slug"))


@query("image_types", "SELECT l_orderkey, l_linenumber, CASE l_orderkey % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'webp' WHEN 3 THEN 'svg' END AS type FROM lineitem")
def image_types(spark, sf_dir):
    """Kinds of images by their first bytes."""
    k = F.col("l_orderkey") % 5
    data = (
        F.when(k == 0, F.lit(b"\x89PNG\r\n\x1a\n...")).when(k == 1, F.lit(b"\xff\xd8\xff\xe0")).when(k == 2, F.lit(b"RIFF\x01\x02\x03\x04WEBPVP8 "))
        .when(k == 3, F.lit(b"<?xml version='1.0'?>\n<svg xmlns='x'/>")).otherwise(F.lit(b"GIF89a"))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.image_type(data).alias("type"))


@query("citations", "SELECT page_id, 'wdf:' || page_id || '#h-1' AS uri FROM pages")
def citations(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.citation(F.col("page_id").cast("string"), F.lit("h-1")).alias("uri"))


@query(
    "capped_assets",
    """WITH RECURSIVE r AS (SELECT DISTINCT ON (user_id, event_id) user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id AS seq, 'img-' || event_id AS src, (value * 100)::BIGINT AS size FROM events),
            f(doc_id, i, seq, src, state, n, total) AS (
                SELECT doc_id, 0::BIGINT, 0::BIGINT, '', '', 0, 0::BIGINT FROM (SELECT DISTINCT doc_id FROM r)
                UNION ALL SELECT f.doc_id, r.i, r.seq, r.src, x.state, f.n + (x.state = 'accepted')::INT, f.total + CASE WHEN x.state = 'accepted' THEN r.size ELSE 0 END
                FROM f JOIN r ON f.doc_id = r.doc_id AND r.i = f.i + 1,
                     LATERAL (SELECT CASE WHEN r.size IS NULL THEN 'missing' WHEN f.n >= 5 THEN 'too many' WHEN r.size > 9000 THEN 'too large' WHEN f.total + r.size > 12000 THEN 'beyond total' ELSE 'accepted' END AS state) x)
       SELECT doc_id, seq::INT AS seq, src, state FROM f WHERE i > 0""",
)
def capped_assets(spark, sf_dir):
    """Images of each user's document under caps: five of at most 9,000 bytes, 12,000 bytes together."""
    src = F.concat(F.lit("img-"), F.col("event_id").cast("string"))
    size = F.round(F.col("value") * 100).cast("bigint")
    refs = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), src.alias("src"), src.alias("digest"), size.alias("size"))
    return datasets.capped_assets(refs, most=5, most_bytes=9000, most_total=12_000)


@query("documents_as_markdown")
def documents_as_markdown(spark, sf_dir):
    """All documents read as Markdown and written as canonical documents."""
    return importing.import_markdown_docs(table(spark, sf_dir, "documents")).select("doc_id", "title", F.sha2("html", 256).alias("html_sha256"), F.size("report").alias("n_report"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_markdown(spark, sf_dir)
