"""Verdicts on page urls by rules, and by trust and distrust spread over host links (operator 8).

Rules decide where one fits.  They also seed the graph: a host most of whose urls, those of its pages
and those that other hosts link to, are allowed by rules is trusted, one most of whose are blocked is
blocked; it need not have been fetched.  Trust is personalised PageRank
from the trusted hosts along links; distrust is the same from the blocked hosts against the links,
for a host that links to bad ones is suspect.  Pages that no rule fits are blocked where their
host's distrust is beyond a floor and outweighs its trust.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passband.llm.common import small, stored


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("block", "net"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
#: Share of a host's pages and of links to it under rules of one verdict that makes it a seed.
SEED_SHARE = 0.5
DAMPING = 0.85
#: What ranks may still move, all hosts together, as a share of what one host has if all have the same.
SETTLED = 0.01
#: A host is blocked if its distrust, as a multiple of an even share among all hosts, exceeds the
#: floor and its trust.
FLOOR = 0.5


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``pages`` with host, path, rule and rule_verdict; the longest rule that fits wins."""
    rows = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):  # later, longer ones override
        under = (F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))
        fits = under & F.startswith(F.col("path"), F.lit(r.path))
        rule = F.when(fits, r.name).otherwise(rule)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return rows.withColumns({"rule": rule, "rule_verdict": verdict})


def host_links(pages: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """src, dst, n: links between different hosts; pre-aggregated, so a page's html is never moved.

    With ``rules``, also how many of the linked urls they allow and block.
    """
    links = F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?([a-z][a-z0-9+.-]*://[^\"'\s>]*)"), 1)
    linked = pages.select(host_of(F.col("url")).alias("src"), F.explode(links).alias("url"))
    judged = [F.count_if(F.col("rule_verdict") == v).alias(v) for v in ("allow", "block")]
    return (
        ruled(linked, rules or ())
        .withColumnRenamed("host", "dst")
        .filter("src <> '' AND dst <> '' AND src <> dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n"), *(judged if rules is not None else []))
    )


def spread(hosts: DataFrame, edges: DataFrame, seed: str, settled: float = SETTLED) -> DataFrame:
    """host, rank: personalised PageRank from the hosts where ``seed`` holds, along src -> dst.

    Edges count by how often they are linked.  What hosts without links hold goes back to the seeds.
    A step leaves at most ``DAMPING`` of the distance to the final ranks, so what is still to come is
    bounded by the last change; the steps end when that is below ``settled`` of an even share.  Every
    step is written out, and a host with very many links only has its shares summed before they move.
    """
    size, seeds = hosts.agg(F.count(F.lit(1)), F.count_if(F.col(seed))).first()
    start = F.when(F.col(seed), F.lit(1.0 / seeds) if seeds else F.lit(0.0)).otherwise(F.lit(0.0))
    base = stored(hosts.select("host", start.alias("start")))
    if not seeds or edges.isEmpty():
        return base.select("host", F.col("start").alias("rank"))
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    shares = stored(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share")))
    ranks = base.select("host", "start", F.col("start").alias("rank"))
    while True:
        moved = (
            ranks.join(shares, ranks.host == shares.src)
            .groupBy(F.col("dst").alias("host"))
            .agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        )
        held = stored(ranks.join(moved, "host", "left").select("host", "start", "rank", F.coalesce("got", F.lit(0.0)).alias("got")))
        lost = 1.0 - float(held.agg(F.sum("got")).first()[0])
        to = F.col("start") * ((1 - DAMPING) + DAMPING * F.lit(lost)) + DAMPING * F.col("got")
        change = float(held.agg(F.sum(F.abs(to - F.col("rank")))).first()[0])
        ranks = held.select("host", "start", to.alias("rank"))
        if change * DAMPING / (1 - DAMPING) * size <= settled:
            return ranks.select("host", "rank")


def host_verdicts(pages: DataFrame, edges: DataFrame, settled: float = SETTLED) -> DataFrame:
    """host, trust, distrust, host_verdict from pages with rules (:func:`ruled`) and host links.

    Links seed together with pages if they were counted with rules, else pages alone do.
    Ranks are multiples of an even share, so that the floor does not hang on the number of hosts.
    """
    told = {"allow": F.col("rule_verdict") == "allow", "block": F.col("rule_verdict") == "block"}
    seen = (
        pages.filter("host <> ''")
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(v) for v, c in told.items()))
    )
    counted = {*told} <= {*edges.columns}
    sums = [F.sum(c if counted else F.lit(0)).alias(c) for c in ("n", *told)]
    into = edges.groupBy(F.col("dst").alias("host")).agg(*sums)
    outof = edges.select(F.col("src").alias("host"), *(F.lit(0).alias(c) for c in ("n", *told)))
    most = lambda v: F.sum(v) > SEED_SHARE * F.sum("n")
    hosts = stored(
        seen.unionByName(into)
        .unionByName(outof.distinct())
        .groupBy("host")
        .agg(most("allow").alias("trusted"), most("block").alias("blocked"))
    )
    n = F.lit(float(hosts.count()))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    trust = spread(hosts, edges, "trusted", settled).select("host", (F.col("rank") * n).alias("trust"))
    distrust = spread(hosts, back, "blocked", settled).select("host", (F.col("rank") * n).alias("distrust"))
    bad = (F.col("distrust") > FLOOR) & (F.col("distrust") > F.col("trust"))
    return trust.join(distrust, "host").select(
        "host", "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("host_verdict")
    )


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, settled: float = SETTLED) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A null url, or one without ``://``, has an empty host and is allowed; null html has no links;
    repeated rows are judged each.  Pages of one host may be a third of all: verdicts per host are
    joined as a size-checked broadcast, beyond that by a join whose skewed partitions Spark splits.
    """
    rows = ruled(pages.select("page_id", "url"), rules)
    edges = stored(host_links(pages, rules))
    hosts = stored(host_verdicts(rows, edges, settled).select("host", "host_verdict"))
    return rows.join(small(hosts, 128), "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"),
    )
