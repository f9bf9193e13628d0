"""Empirical-Bayes reputation of hosts, and block or allow verdicts for urls.

Outcomes of labelled pages (bad: 1, else 0) are counted by host, registered domain and suffix.
The share of bad pages is shrunk from level to level: a suffix towards the overall share, a domain
towards its suffix, a host towards its domain. The weight of each prior is the beta-binomial
precision that the method of moments finds among that level's members. A host is blocked if the
lower bound of its posterior share (mean less Z standard deviations) is above the share of bad
pages overall by the factor WORSE: it is worse than the rest beyond doubt, whatever that share is.
Explicit (host, path) rules come before the reputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut_lineage, look_up

#: Standard deviations below the posterior mean.
Z = 1.645
#: A host is blocked if the bound of its share of bad pages is above so many times the overall share.
WORSE = 1.0
#: Precision of a prior stays in this range, whatever the moments say.
PRECISION = (1.0, 200.0)
HEAVY = 1000

#: Verdict, host and path of the rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Labels that make a two-label suffix before a two-letter one.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ://, A-Z lower-cased, and the path before ? and #; both empty without ://."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Suffix (one label, or two such as co.uk) and registered domain of a host; ports are left out."""
    labels = F.split(F.regexp_replace(host, r"(^[^@]*@)|(:[0-9]*$)|(\.$)", ""), r"\.")
    n = F.size(labels)
    two = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(SECOND_LEVEL)
    k = F.when(two, 2).otherwise(1)
    end = lambda m: F.array_join(F.slice(labels, F.greatest(n - m + 1, F.lit(1)), m), ".")
    return end(k), end(k + 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(verdict, rule) of the longest fitting rule, else null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


def _precision(level: DataFrame, share: float) -> float:
    """Beta-binomial precision of the labelled members of a level, by the method of moments."""
    p = F.col("bad") / F.col("n")
    r = level.where("n > 0").agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") * 1.0).alias("nn"), F.sum(F.col("n") * (p - share) ** 2).alias("s")
    ).first()
    low, high = PRECISION
    v = share * (1 - share)
    if not r.n or r.g < 2 or not v:
        return high
    room = v * (r.n - r.nn / r.n - (r.g - 1))
    rho = (r.s - v * (r.g - 1)) / room if room > 0 else 0.0
    return min(max(1 / rho - 1, low), high) if rho > 0 else high


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, domain, suffix, rows, n, bad, mean, bound, limit) of every host of pages(page_id, host).

    limit is what the bound must pass for the host to be blocked.

    outcomes(page_id, bad) are the labelled pages; an id labelled twice counts twice, null ids
    and null outcomes count for nothing.
    """
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.count("*").alias("k"), F.sum("bad").alias("b"))
    # rows are counted by (id, host) before the join, so that neither a hot host nor an id that repeats gets one task
    seen = pages.groupBy("page_id", "host").agg(F.count("*").alias("rows")).join(known, "page_id", "left")
    hosts = seen.groupBy("host").agg(F.sum("rows").alias("rows"), F.coalesce(F.sum(F.col("rows") * F.col("k")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("rows") * F.col("b")), F.lit(0)).alias("bad"))
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = cut_lineage(hosts.select("host", "rows", "n", "bad", domain.alias("domain"), suffix.alias("suffix")))
    domains = cut_lineage(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = cut_lineage(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    share = (total.bad + 1) / (total.n + 2)
    ks, kd, kh = (_precision(level, share) for level in (suffixes, domains, hosts))
    shrunk = lambda k, prior: (F.col("bad") + k * prior) / (F.col("n") + k)
    top = suffixes.select("suffix", shrunk(ks, F.lit(share)).alias("m_suffix"))
    middle = domains.join(top, "suffix").select("domain", "suffix", shrunk(kd, F.col("m_suffix")).alias("m_domain"))
    middle = middle.select(F.struct("domain", "suffix").alias("place"), "m_domain")
    low = look_up(hosts.withColumn("place", F.struct("domain", "suffix")), cut_lineage(middle), "place").drop("place")
    low = low.withColumn("mean", shrunk(kh, F.col("m_domain"))).withColumn("limit", F.lit(float(WORSE * share)))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + kh + 1))
    return low.withColumn("bound", F.greatest(F.col("mean") - Z * sd, F.lit(0.0))).drop("m_domain")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Verdict for every row of pages(page_id, url), by rule or else by its host's reputation.

    Returns page_id, host, path, rule, verdict, and the host's labelled pages, posterior mean,
    bound and limit, rounded to six digits. A null url, or one without ://, has an empty host, whose pages
    share one reputation. Repeated rows and null ids are judged like any other; other columns are
    ignored; an empty table gives no rows, and without a labelled page every host has the overall
    share 1/2 as its mean and is allowed.

    Hosts of more than one HEAVY-th of all rows (so fewer than HEAVY hosts) are looked up by
    broadcast, the others by a join on the host, so that no join task gets a hot host.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rep = cut_lineage(host_reputation(rows.select("page_id", "host"), outcomes).select("host", "rows", "n", "mean", "bound", "limit"))
    total = rep.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first().n
    heavy = rep.where(F.col("rows") * HEAVY > total).drop("rows")
    light = rep.where(F.col("rows") * HEAVY <= total).drop("rows")
    both = rows.join(F.broadcast(heavy), "host").unionByName(rows.join(F.broadcast(heavy.select("host")), "host", "left_anti").join(light, "host"))
    ruled = both.withColumn("r", rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules))
    own = F.when(F.round("bound", 6) > F.round("limit", 6), "block").otherwise("allow")
    return ruled.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"),
        F.col("n").cast("long").alias("n_labelled"), F.round("mean", 6).alias("mean"), F.round("bound", 6).alias("bound"), F.round("limit", 6).alias("limit"),
    )
