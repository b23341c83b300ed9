"""Operator 1: url filtering by an empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes (1 good, 0 bad) are counted by host, registered domain and suffix. Each level's rate is shrunk to
the level above by a beta-binomial prior: suffix to the overall rate, domain to suffix, host to domain. The strength of a
level's prior comes from the spread of its own rates, by moments over its groups with outcomes. With prior rate p, n
outcomes and intra-group correlation c, the expectation of n (rate - p)^2 is p (1 - p) (1 + (n - 1) c), so

    c = (sum n (rate - p)^2 - sum p (1 - p)) / sum p (1 - p) (n - 1),        strength = 1 / c - 1.

A c below its own standard error under c = 0, sqrt(2 sum (p (1 - p))^2) / sum p (1 - p) (n - 1), cannot be told from none
and is taken as that error: this bounds the strength by what the data can tell, with no fixed limit. A prior counts as one
page at least, and as one where no group has two outcomes. A page passes if the lower bound of its host's posterior good
rate, mean minus ``z`` standard deviations of the beta posterior, reaches ``least``. Explicit rules come first: the
longest that fits wins.

Levels are read off the host without user part, port and closing dot. An address (IPv4, or bracketed IPv6) is its own
domain, and all addresses share one suffix. The suffix is the last label, or the last two where a country's label follows
one of SECOND; the registered domain has one label more.

Outcomes are aggregated before anything is joined and the host table is written once; the join back to the pages is a
plain equi-join on the host, so a host with a third of all pages is split by adaptive execution. What comes to the driver
is one row a level.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged as host '';
a host without labels gets its domain's, suffix's or the overall posterior; without any outcome at all the rate is that
of one good and one bad page; a page with several outcomes counts each; outcomes other than 0 and 1, nulls included, count
nothing; repeated pages are judged one by one; other columns of pages are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, table

#: (action, host, start of path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labels that form a suffix together with a country's two letters (fixed values).
SECOND = ("ac", "co", "com", "edu", "gov", "net", "ne", "or", "org")
TWO_LABELS = rf"(^|\.)({'|'.join(SECOND)})\.[a-z][a-z]\z"
ADDRESS = r"^(\[.*|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\z"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWERED)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, action) of the longest rule that fits, or null."""
    out = None
    for action, at, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        value = F.struct(F.lit(at + start).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,action:string>")


def name_of(host: Column) -> Column:
    """The host without user part, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"\.?(:\d*)?\z", "")


def domain_of(name: Column) -> Column:
    two = F.when(name.rlike(TWO_LABELS), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return F.when(name.rlike(ADDRESS), name).otherwise(two)


def suffix_of(name: Column) -> Column:
    two = F.when(name.rlike(TWO_LABELS), F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    return F.when(name.rlike(ADDRESS), "(address)").otherwise(two)


def strength(level: DataFrame) -> float:
    """level: (good, n, prior), one row a group. See the module's text."""
    pq, n = F.col("prior") * (1 - F.col("prior")), F.col("n")
    found = level.where("n > 0").agg(
        F.sum(n * F.pow(F.col("good") / n - F.col("prior"), 2)).alias("ss"), F.sum(pq).alias("pq"), F.sum(pq * pq).alias("pq2"),
            F.sum(pq * (n - 1)).alias("free"),
    ).first()
    if not found.free:
        return 1.0
    c = max((found.ss - found.pq) / found.free, math.sqrt(2 * found.pq2) / found.free)
    return max(1.0, 1 / c - 1)


def shrunk(level: DataFrame, *keep: str) -> DataFrame:
    """level: (*keep, good, n, prior) -> (*keep, a, b, mean) of the beta posterior."""
    k = strength(level)
    a, b = F.col("good") + k * F.col("prior"), F.col("n") - F.col("good") + k * (1 - F.col("prior"))
    return level.select(*keep, a.alias("a"), b.alias("b"), (a / (a + b)).alias("mean"))


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """pages (page_id, name), outcomes (page_id, good 0/1) -> name, a, b, for every name of pages."""
    labelled = pages.join(outcomes.where(F.col("good").isin(0, 1)), "page_id", "left")
    names = labelled.groupBy("name").agg(F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("good"), F.count("good").cast("double").alias("n"))
    names = cut(names.withColumn("domain", domain_of(F.col("name"))).withColumn("suffix", suffix_of(F.col("name"))), "hosts")
    sums = F.sum("good").alias("good"), F.sum("n").alias("n")
    total = names.agg(*sums).first()
    overall = ((total.good or 0.0) + 1) / ((total.n or 0.0) + 2)
    suffixes = shrunk(names.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(overall)), "suffix")
    domains = names.groupBy("domain", "suffix").agg(*sums).join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix")
    domains = cut(shrunk(domains, "domain"), "domains")
    return shrunk(names.join(domains.select("domain", F.col("mean").alias("prior")), "domain"), "name").select("name", "a", "b")


def lower_bound(a: Column, b: Column, z: float) -> Column:
    mean = a / (a + b)
    return F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1)))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, least: float = 0.5, z: float = 1.645) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict, reputation (the posterior bound)."""
    host = host_of(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path_of(F.col("url")).alias("path"), name_of(host).alias("name"))
    known = reputations(named.select("page_id", "name"), outcomes).select("name", lower_bound(F.col("a"), F.col("b"), z).alias("reputation"))
    ruled = named.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).join(known, "name", "left")
    method = F.when(F.col("reputation") >= least, F.lit("allow")).otherwise(F.lit("block"))
    return ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.action", method).alias("verdict"), "reputation")


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; its outcome is the quality label of the document with the same number, where there is one."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes).select("page_id", "host", "path", "rule", "verdict")


_LEVEL = """
{name}_j AS (SELECT l.*, u.mean AS prior FROM ({rows}) l JOIN {above} u USING ({above_key})),
{name}_m AS (SELECT sum(n * pow(good / n - prior, 2)) AS ss, sum(prior * (1 - prior)) AS pq, sum(pow(prior * (1 - prior), 2)) AS pq2,
  sum(prior * (1 - prior) * (n - 1)) AS free
  FROM {name}_j WHERE n > 0),
{name}_k AS (SELECT CASE WHEN coalesce(free, 0) = 0 THEN 1e0 ELSE greatest(1e0, 1 / greatest((ss - pq) / free,
  sqrt(2 * pq2) / free) - 1) END AS k FROM {name}_m),
{name} AS (SELECT {key}, good + k * prior AS a, n - good + k * (1 - prior) AS b, (good + k * prior) / (n + k) AS mean FROM {name}_j, {name}_k)"""


def op1_sql() -> str:
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for _, h, p in longest) + " END"
    action = "CASE rule " + " ".join(f"WHEN '{h + p}' THEN '{a}'" for a, h, p in RULES) + " END"
    levels = ",".join((
        _LEVEL.format(name="suffixes", key="suffix", above="overall", above_key="al",
            rows="SELECT suffix, 0 AS al, sum(good) AS good, sum(n) AS n FROM hosts GROUP BY suffix"),
        _LEVEL.format(name="domains", key="domain", above="suffixes", above_key="suffix",
            rows="SELECT domain, suffix, sum(good) AS good, sum(n) AS n FROM hosts GROUP BY domain, suffix"),
        _LEVEL.format(name="posteriors", key="name", above="domains", above_key="domain", rows="SELECT name, domain, good, n FROM hosts"),
    ))
    return f"""
WITH named AS (
  SELECT *, regexp_replace(regexp_replace(host, '^.*@', '', 's'), '\\.?(:\\d*)?\\z', '') AS name FROM (
    SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWERED}') AS host,
           coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages)),
counted AS (
  SELECT name, CAST(coalesce(sum(quality), 0) AS DOUBLE) AS good, CAST(count(quality) AS DOUBLE) AS n, string_split(name, '.') AS parts,
         regexp_matches(name, '{ADDRESS}') AS address, regexp_matches(name, '{TWO_LABELS}') AS two
  FROM named LEFT JOIN (SELECT doc_id, quality FROM labels WHERE quality IN (0, 1)) ON page_id = doc_id GROUP BY name),
hosts AS (
  SELECT name, good, n, CASE WHEN address THEN name WHEN two THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain,
         CASE WHEN address THEN '(address)' WHEN two THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix FROM counted),
overall AS (SELECT 0 AS al, (coalesce(sum(good), 0) + 1e0) / (coalesce(sum(n), 0) + 2e0) AS mean FROM hosts),{levels},
bounds AS (SELECT name, greatest(0e0, mean - 1.645e0 * sqrt(mean * (1 - mean) / (a + b + 1))) AS reputation FROM posteriors),
ruled AS (SELECT *, {rule} AS rule FROM named)
SELECT page_id, host, path, rule, coalesce({action}, CASE WHEN reputation >= 0.5e0 THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled LEFT JOIN bounds USING (name)"""
