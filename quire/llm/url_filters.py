"""URL verdicts by rules and by trust along links: DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

#: The host of a link in HTML that names one, with a scheme or without.
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""
DAMPING, BLOCK_SHARE = 0.85, 0.5
#: Rounds go on until what one still moves is less than this share of the seeds.
TOLERANCE = 1e-4


def _lower(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    there = F.coalesce(at > 0, F.lit(False))
    return F.when(there, _lower(host)).otherwise(""), F.when(there, path).otherwise("")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null.

    A rule (verdict, host, path) fits its host and all subdomains when the path starts with its
    path; of two rules that are equally long the first by text wins. Rules are a short list that
    becomes part of the expression.
    """
    options = []
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        options.append(F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    options.append(F.lit(None).cast("struct<rule: string, verdict: string>"))
    return F.coalesce(*options)


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, links) between different hosts; `pages` has host and html."""
    links = F.when(F.col("html").contains("//"), F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    return pages.select(F.col("host").alias("source"), F.explode(links).alias("link")).select("source", _lower(F.col("link")).alias("target")).where("source <> target AND source <> ''").groupBy("source", "target").agg(F.count("*").alias("links"))


def propagated(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) over edges (source, target, links).

    Personalised PageRank: trust flows along links, distrust against them, both dealt out by the
    number of links and damped at each step; a host's rank is its own seed and all that reaches it.
    A round moves on what the last one brought, and rounds end when that is less than `tolerance`
    of all seeds, so no rank lacks more than tolerance * damping / (1 - damping) of them. Every
    round is written to the shared folder and the one before deleted. Without edges there is none.
    """
    out = edges.groupBy(F.col("source").alias("s")).agg(F.sum("links").alias("all"))
    into = edges.groupBy(F.col("target").alias("t")).agg(F.sum("links").alias("all"))
    forward = edges.join(out, F.col("source") == F.col("s")).select(F.lit("trust").alias("kind"), F.col("source").alias("giver"), F.col("target").alias("taker"), (F.col("links") / F.col("all")).alias("part"))
    backward = edges.join(into, F.col("target") == F.col("t")).select(F.lit("distrust").alias("kind"), F.col("target").alias("giver"), F.col("source").alias("taker"), (F.col("links") / F.col("all")).alias("part"))
    flow = staged(forward.union(backward), "host-flow")
    own = staged(seeds.select("host", F.expr("stack(2, 'trust', cast(trust as double), 'distrust', cast(distrust as double)) as (kind, own)")).where("own > 0"), "host-seeds")
    now = staged(own.select("kind", "host", F.col("own").alias("rank"), F.col("own").alias("new")), "host-ranks")
    total = moving = now.agg(F.sum("new")).first()[0] or 0.0
    while moving > tolerance * total:
        giving = now.where("new > 0").select(F.col("kind").alias("k"), F.col("host").alias("h"), "new")
        given = giving.join(flow, (F.col("k") == flow["kind"]) & (F.col("h") == flow["giver"])).select("kind", F.col("taker").alias("host"), (F.col("new") * F.col("part") * damping).alias("new"))
        both = given.select("kind", "host", F.col("new").alias("rank"), "new").union(now.select("kind", "host", "rank", F.lit(0.0)))
        last, now = now, staged(both.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("new").alias("new")), "host-ranks")
        moving = now.agg(F.sum("new")).first()[0]
        discard(last)
    rank = now
    sums = [F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")]
    return rank.groupBy("host").agg(*sums)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], damping: float = DAMPING, tolerance: float = TOLERANCE, block_share: float = BLOCK_SHARE) -> DataFrame:
    """Verdict for every page: that of its longest rule, else that of its host.

    Pages that a rule allows or blocks are the seeds of their hosts, one unit each. A host is
    blocked when its distrust is more than `block_share` of its distrust, trust and pages without
    a rule together; hosts that nothing reaches are allowed. Null or broken urls have an empty
    host and path, no rule, and are allowed; null html has no links. Repeated rows are judged
    each. An empty table gives no rows.

    Returns page_id, host, path, rule, verdict, trust, distrust.
    """
    host, path = url_parts(F.col("url").cast("string"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    ruled = parsed.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    edges = staged(host_edges(ruled.select("host", "html")), "host-edges")
    verdict = F.col("found.verdict")
    seeds = ruled.where("host <> ''").groupBy("host").agg(F.count_if(verdict == "allow").alias("trust"), F.count_if(verdict == "block").alias("distrust"), F.count_if(verdict.isNull()).alias("open"))
    seeds = staged(seeds, "host-counts")
    ranks = propagated(seeds, edges, damping, tolerance)
    hosts = seeds.select("host", "open").join(ranks, "host", "left").select(F.col("host").alias("h"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"), "open")
    blocked = F.col("distrust") > block_share * (F.col("distrust") + F.col("trust") + F.col("open"))
    hosts = staged(hosts.withColumn("blocked", blocked), "host-verdicts")
    judged = ruled.select("page_id", "host", "path", "found").join(hosts, F.col("host") == F.col("h"), "left")
    by_host = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "trust", "distrust")
