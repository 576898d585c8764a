"""URL filters: rules indexed by their rarest literal token; a URL's tokens fetch the candidates and only those run a regular expression.

Everything is DataFrame expressions. Each rule has literal tokens that any URL it fits must hold as whole tokens; a count over
the URLs picks the rarest one per rule, so that a rule is looked up for few URLs. Rules without tokens are looked up for every
URL. The rule index is broadcast only when it has at most ``broadcast_rules`` rows, which bounds its size; a larger one is joined
by a shuffle on the token.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, literal_table

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SEPARATORS = r"[^a-z0-9]+"


class Rule(NamedTuple):
    rule: str
    verdict: str
    pattern: str
    tokens: list[str]
    rank: int
    named: bool


#: Host and path rules that the query names.
NAMED = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The method's own patterns: (name, regular expression over host and path, its whole literal tokens).
SPAM = [
    ("cheap-pills", r"^(?:[^/]*[.-])?cheap-pills[./-]", ["cheap", "pills"]),
    ("spam-farm", r"^(?:[^/]*[.-])?spam-farm[./-]", ["spam", "farm"]),
    ("casino", r"^(?:[^/]*[.-])?casino[./-]", ["casino"]),
    ("doubleclick", r"^(?:[^/]*\.)?doubleclick\.[a-z]+/", ["doubleclick"]),
    ("adserver", r"^(?:[^/]*\.)?adserver\.", ["adserver"]),
    ("tracking-pixel", r"/pixel\.(?:gif|png)$", ["pixel"]),
]


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule that fits its host and all subdomains where the URL's path starts with the rule's. The longest rule wins, then the longest host."""
    whole = path if path.endswith(tuple("/.-_")) else path[: -len(re.split(SEPARATORS, path.lower())[-1]) or None]
    tokens = sorted({t for t in re.split(SEPARATORS, f"{host} {whole}".lower()) if t})
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{'(?=/|$)' if not path else ''}{re.escape(path)}", tokens, 1000 * len(host + path) + len(host), True)


def default_rules() -> list[Rule]:
    return [host_rule(*r) for r in NAMED] + [Rule(n, "block", p, t, 0, False) for n, p, t in SPAM]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def url_tokens(host_path: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(ascii_lower(host_path), SEPARATORS)))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return literal_table(spark, [tuple(r) for r in rules], "rule string, verdict string, pattern string, tokens array<string>, rank int, named boolean")


def rarest_tokens(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """rules with ``token``: of each rule's tokens the one that the fewest rows of urls (host_path) hold; '' for a rule without tokens."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = urls.select(F.explode(url_tokens(F.col("host_path"))).alias("token")).join(F.broadcast(wanted), "token").groupBy("token").agg(F.count("*").alias("n"))
    each = rules.select("rule", F.explode_outer("tokens").alias("token")).join(F.broadcast(seen), "token", "left")
    best = each.groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token"))).alias("b"))
    return rules.join(best, "rule").withColumn("token", F.col("b.token")).drop("b")


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = 10_000) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict, pattern.

    rule: the winning named rule, else null; verdict: its verdict, else ``block`` if one of the method's own patterns fits (its
    name is in pattern), else default. A null URL or one without :// has empty host and path and default. Rows of the same id
    and URL, repeated ids, empty tables and further columns are fine: each row gets its own verdict.
    """
    rules = default_rules() if rules is None else rules
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = rows.select("id", F.concat("host", "path").alias("host_path"))
    index = rarest_tokens(urls, rule_table(spark, rules)).select("token", "rule", "verdict", "pattern", "rank", "named")
    if len(rules) <= broadcast_rules:
        index = F.broadcast(index)
    hits = (
        urls.select("id", "host_path", F.explode(url_tokens(F.col("host_path"))).alias("token"))
        .join(index, "token")
        .where(F.expr("host_path rlike pattern"))
        .groupBy("id", "host_path")
        .agg(
            F.max(F.when(F.col("named"), F.struct("rank", "rule", "verdict"))).alias("best"),
            F.min(F.when(~F.col("named"), F.struct("rule", "verdict"))).alias("own"),
        )
    )
    r, h = rows.withColumn("host_path", F.concat("host", "path")), hits
    return r.join(h, r["id"].eqNullSafe(h["id"]) & (r["host_path"] == h["host_path"]), "left").select(
        r["id"].alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", "own.verdict", F.lit(default)).alias("verdict"), F.col("own.rule").alias("pattern")
    )


ORACLE = r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(rhost, rpath, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
s(pattern, re) AS (VALUES ('cheap-pills', '^(?:[^/]*[.-])?cheap-pills[./-]'), ('spam-farm', '^(?:[^/]*[.-])?spam-farm[./-]'), ('casino', '^(?:[^/]*[.-])?casino[./-]'),
    ('doubleclick', '^(?:[^/]*\.)?doubleclick\.[a-z]+/'), ('adserver', '^(?:[^/]*\.)?adserver\.'), ('tracking-pixel', '/pixel\.(?:gif|png)$')),
m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule, arg_max(v, length(rhost || rpath) * 1000 + length(rhost)) AS v
    FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
o AS (SELECT page_id, min(s.pattern) AS pattern FROM u JOIN s ON regexp_matches(host || path, s.re) GROUP BY page_id)
SELECT u.page_id, host, path, m.rule AS rule, coalesce(m.v, CASE WHEN o.pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, o.pattern AS pattern
FROM u LEFT JOIN m USING (page_id) LEFT JOIN o USING (page_id)
"""
