"""URL rules by a blocked Bloom filter and an exact hash join.

A URL is cut into the keys that could be a rule: every suffix of its host (at dots), each with the
prefixes of its path that have the length of some rule's path. A blocked Bloom filter of the listed rules
passes the keys that may be listed; only those go on to the exact hash join, which removes false hits.
Everything is column expressions; the filter is a few longs per block, with its size fixed by the rules'
count and ``max_blocks``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.llm.bloom import blocks_for, bloom, may_hold
from depweave.llm.store import save
from depweave.operators.spread import spread_join


@dataclass(frozen=True)
class UrlRules:
    """``default``: the verdict without a rule. ``bits_per_rule`` and ``max_blocks`` (of 256 bits) bound the
    filter: 2**18 blocks are 8 MB. With more rules than that suits, more keys reach the exact join; results
    stay the same. Up to ``few_rules`` rules are broadcast for the exact hash join; more are shuffled."""

    default: str = "allow"
    bits_per_rule: int = 32
    max_blocks: int = 1 << 18
    few_rules: int = 1 << 16


def url_host(url: str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.when(F.locate("://", F.col(url)) > 0, F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.when(F.locate("://", F.col(url)) > 0, F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(""), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``rules``: (verdict, host, path) triples."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def judge_urls(pages: DataFrame, rules: DataFrame, how: UrlRules | None = None, url: str = "url") -> DataFrame:
    """``pages`` plus host, path, rule, verdict.

    A rule fits its host and all subdomains if the URL's path starts with the rule's; the longest rule
    (host and path together) wins, ties to the smaller text, and of repeated rules the smaller verdict.
    A null URL or one without ``://`` has an empty host and path and gets the default verdict. Repeated
    pages keep their rows; an empty page or rule table works. Columns of ``pages`` named like the new ones
    are replaced; any others stay, whatever their names.
    """
    how = how or UrlRules()
    lower = F.translate(F.coalesce("host", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    listed = rules.select(F.concat(lower, F.coalesce("path", F.lit(""))).alias("key"), F.length(F.coalesce("path", F.lit(""))).alias("cut"), lower.alias("host"), F.lower("verdict").alias("verdict"))
    listed = listed.where("host <> ''").groupBy("key", "cut").agg(F.min("verdict").alias("verdict"))
    # Bounded: one row for each length that a rule's path has.
    cuts = sorted(r.cut for r in listed.select("cut").distinct().collect())
    n = listed.count()
    blocks = blocks_for(n, how.bits_per_rule, how.max_blocks)

    new = ["host", "path", "rule", "verdict"]
    kept = [c for c in pages.columns if c.lower() not in new]
    body = F.struct(*(pages[c] for c in kept)) if kept else F.struct(F.lit(0).alias("none"))
    pages = pages.select(body.alias("body"), url_host(url).alias("host"), url_path(url).alias("path"))
    own = [F.col("body")[c].alias(c) for c in kept]
    if not cuts:
        return pages.select(*own, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(how.default).alias("verdict"))

    # A URL's verdict hangs on host and path only: each pair that may match is judged once.
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    at = F.array(*(F.lit(c) for c in cuts))
    prefixes = F.transform(F.filter(at, lambda c: c <= F.length("path")), lambda c: F.struct(c.alias("cut"), F.col("path").substr(F.lit(1), c).alias("start")))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.struct(F.concat(h, p["start"]).alias("key"), p["cut"].alias("cut")))))
    distinct = pages.select("host", "path").where("host <> ''").distinct()
    possible = distinct.select("host", "path", F.explode(keys).alias("k")).select("host", "path", "k.key", "k.cut")
    possible = may_hold(possible, "key", bloom(listed, "key", blocks), blocks)
    if n <= how.few_rules:
        hits = possible.join(F.broadcast(listed), ["key", "cut"])
    else:
        hits = spread_join(save(possible, "url-keys"), listed, ["key", "cut"], hint="shuffle_hash")
    best = F.min_by(F.struct("key", "verdict"), F.struct(-F.length("key"), F.col("key"), F.col("verdict")))
    judged = save(hits.groupBy("host", "path").agg(best.alias("best")), "url-verdicts")
    # One URL may be that of many pages.
    return spread_join(pages, judged, ["host", "path"], "left").select(
        *own, "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(how.default)).alias("verdict")
    )
