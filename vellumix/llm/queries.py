"""Registered queries of the training-data operators, and their DuckDB restatements where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


_oracle(
    "op1_url_reputation",
    r"""
    WITH u AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
    r AS (SELECT page_id, CASE WHEN position('://' IN u) > 0 THEN substr(u, position('://' IN u) + 3) ELSE '' END AS rest FROM u),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    l AS (SELECT doc_id AS page_id, count(*) AS k, sum(greatest(1 - quality, toxic)) AS b FROM labels
          WHERE doc_id IS NOT NULL AND greatest(1 - quality, toxic) IS NOT NULL GROUP BY 1),
    h0 AS (SELECT host, coalesce(sum(k), 0)::DOUBLE AS n, coalesce(sum(b), 0)::DOUBLE AS bad FROM p LEFT JOIN l USING (page_id) GROUP BY host),
    h1 AS (SELECT *, string_split(regexp_replace(host, '(^[^@]*@)|(:[0-9]*$)|(\.$)', '', 'g'), '.') AS a FROM h0),
    h2 AS (SELECT *, CASE WHEN len(a) >= 3 AND length(a[-1]) = 2 AND a[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS s FROM h1),
    h AS (SELECT host, n, bad, array_to_string(a[greatest(len(a) - s + 1, 1):], '.') AS suffix, array_to_string(a[greatest(len(a) - s, 1):], '.') AS domain FROM h2),
    d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
    x AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
    t AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS share FROM x),
    levels AS (SELECT 'x' AS level, n, bad FROM x UNION ALL SELECT 'd', n, bad FROM d UNION ALL SELECT 'h', n, bad FROM h),
    m AS (SELECT level, any_value(share) AS share, count(*) AS g, sum(n) AS n, sum(n * n) AS nn, sum(n * (bad / n - share) ** 2) AS s FROM levels, t WHERE n > 0 GROUP BY level),
    m1 AS (SELECT level, g, n, share * (1 - share) AS v, s, share * (1 - share) * (n - nn / n - (g - 1)) AS room FROM m),
    m2 AS (SELECT level, CASE WHEN g < 2 OR v = 0 OR room <= 0 THEN 0 ELSE (s - v * (g - 1)) / room END AS rho FROM m1),
    k AS (SELECT level, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1.0), 200.0) ELSE 200.0 END AS k FROM m2),
    ks AS (SELECT coalesce(max(k) FILTER (level = 'x'), 200.0) AS kx, coalesce(max(k) FILTER (level = 'd'), 200.0) AS kd, coalesce(max(k) FILTER (level = 'h'), 200.0) AS kh FROM k),
    mx AS (SELECT suffix, (bad + kx * share) / (n + kx) AS m_suffix FROM x, t, ks),
    md AS (SELECT domain, d.suffix, (bad + kd * m_suffix) / (n + kd) AS m_domain FROM d JOIN mx ON d.suffix = mx.suffix, ks),
    mh AS (SELECT host, n, kh, share, (bad + kh * m_domain) / (n + kh) AS mean FROM h JOIN md USING (domain, suffix), ks, t),
    rep AS (SELECT host, n::BIGINT AS n_labelled, round(mean, 6) AS mean, round(greatest(mean - 1.645 * sqrt(mean * (1 - mean) / (n + kh + 1)), 0.0), 6) AS bound, round(share, 6) AS "limit" FROM mh),
    f AS (SELECT page_id, host, path,
                 CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                      WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                      WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                      WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bound > "limit" THEN 'block' ELSE 'allow' END AS verdict,
           n_labelled, mean, bound, "limit"
    FROM f JOIN rep USING (host)""",
)

_oracle(
    "op9_decontaminate",
    r"""
    WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    iw AS (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS pos FROM i WHERE len(w) > 0),
    grams AS (SELECT DISTINCT item_id, size, array_to_string(w[pos:pos + size - 1], ' ') AS g FROM iw),
    sizes AS (SELECT DISTINCT size FROM grams),
    dw AS (SELECT r, size, w, unnest(range(1, greatest(len(w) - size + 2, 1))) AS pos FROM w, sizes),
    met AS (SELECT r, size, pos, item_id FROM (SELECT r, size, pos, array_to_string(w[pos:pos + size - 1], ' ') AS g FROM dw) JOIN grams USING (size, g)),
    hit AS (SELECT r, count(DISTINCT word) AS n FROM (SELECT DISTINCT r, unnest(range(pos, pos + size)) AS word FROM met) GROUP BY r),
    items AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM met WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
    FROM w LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""",
)


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe_roundtrip

    docs = table(spark, sf_dir, "documents")
    return bpe_roundtrip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fmindex import contamination_report

    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_languages

    return identify_languages(table(spark, sf_dir, "documents")).drop("mixture")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crf import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .urlrep import judge_urls

    # labels name documents; no table labels pages, so a page has the outcome of the document of its number
    labels = table(spark, sf_dir, "labels")
    bad = F.greatest(1 - F.col("quality"), F.col("toxic")).cast("int")
    return judge_urls(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


@query
def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"))


@query
def op4_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .transcripts import parse_transcripts, with_markers

    return parse_transcripts(with_markers(table(spark, sf_dir, "conversations")))
