"""URL filter: longest rule first, else trust and distrust spread over the link graph of hosts.

Rules name a host and a path prefix; a rule fits its host and all subdomains.
Pages without a rule get their host's verdict: personalised PageRank from all
hosts with allowed pages along the links, and from all hosts with blocked pages
against them (who links to a blocked host loses trust), as joins and sums over
host edges. A seed weighs the share of its pages that rules of its kind decide,
and ranks are kept on that scale: what a host gets depends on the hosts that lead
to it, not on how many others have rules. (That is the rank in which hosts without
links return theirs to the seeds, times a constant.) Ranks grow by what the last
round moved, until that is below ``TOLERANCE`` for every host. A host is blocked
if its distrust is above its trust and at least ``LEAST``.

Edges are counted per host pair before any shuffle of links, so a host with a
third of all pages is one row per task and target; ranks are one row per host.

Edge cases: a url that is null or has no ``://`` has empty host and path, fits
no rule and is allowed. A null html has no links. Links without a host stay on
their site and add nothing; a link may lack the scheme (``//host/path``). Repeated pages count as often as they occur. Without
links, seeds keep their own rank only. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.llm.tables import discard, written

# --- Fixed values: rules (verdict, host, path) -----------------------------------
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
LINK = r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""

DAMPING = 0.85
TOLERANCE = 1e-3
#: The least distrust of a blocked host: as if this share of its own pages were blocked.
LEAST = 0.1


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none."""
    out = F.lit(None)
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(src, dst, links): links between different hosts."""
    links = pages.select(
        host_of(F.col(url_column)).alias("src"), F.explode(F.regexp_extract_all(html_column, F.lit(LINK), 1)).alias("dst")
    )
    links = links.withColumn("dst", F.translate("dst", string.ascii_uppercase, string.ascii_lowercase))
    return links.where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): each seed's weight, and what reaches a host along the edges, damped at each step."""
    moved = seeds.select("host", F.col("weight").cast("double").alias("rank"))
    if edges.isEmpty():
        return moved
    out = edges.groupBy("src").agg(F.sum("links").alias("all"))
    flow = written(edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("all")).alias("share")), "flow")
    rounds = [written(moved, "rank")]
    while (rounds[-1].agg(F.max("rank")).first()[0] or 0.0) > tolerance:
        step = flow.join(rounds[-1], flow.src == F.col("host")).groupBy("dst")
        step = step.agg(F.sum(F.lit(damping) * F.col("rank") * F.col("share")).alias("rank"))
        rounds.append(written(step.select(F.col("dst").alias("host"), "rank"), "rank"))
    ranks = written(reduce(DataFrame.unionByName, rounds).groupBy("host").agg(F.sum("rank").alias("rank")), "ranks")
    discard(flow, *rounds)
    return ranks


def judge(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    rules: Sequence[tuple[str, str, str]] = RULES,
    damping: float = DAMPING,
    least: float = LEAST,
) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every page."""
    ruled = pages.select(
        F.col(id_column), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path")
    ).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.col("r.verdict")
    hosts = ruled.where("host <> ''").groupBy("host").agg(
        (F.count_if(verdict == "allow") / F.count("*")).alias("allowed"),
        (F.count_if(verdict == "block") / F.count("*")).alias("blocked"),
    )
    hosts = written(hosts, "hosts")
    edges = written(host_edges(pages, url_column, html_column), "host-edges")
    trusted = hosts.where("allowed > 0").select("host", F.col("allowed").alias("weight"))
    banned = hosts.where("blocked > 0").select("host", F.col("blocked").alias("weight"))
    trust = spread(edges, trusted, damping).withColumnRenamed("rank", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    distrust = spread(back, banned, damping).withColumnRenamed("rank", "distrust")
    ranks = trust.join(distrust, "host", "full").select(
        F.col("host").alias("_host"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
    ranks = written(ranks, "host-ranks")
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= least)
    out = ruled.join(ranks, ruled.host == ranks._host, "left")
    by_host = F.when(F.coalesce(bad, F.lit(False)), "block").otherwise("allow")
    return out.select(
        id_column,
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce(verdict, by_host).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
