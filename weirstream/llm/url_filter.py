"""Operator 10: URL filters with link-graph propagation.

Explicit rules decide first. For the rest, trust flows from trusted hosts along links and distrust flows from blocked hosts
against them (who links to blocked hosts becomes suspect), both as personalised PageRank over distinct host edges, in
units of what a seed starts with. A host is blocked if its distrust reaches `least` and exceeds `ratio` times its trust.

A host is a seed if at least half of its pages fall under allow (block) rules. Link targets without a scheme and a host stay
on their own host and are no edges; self-links are none either.

Defined cases: a null url, or one without ``://``, has an empty host and path, matches no rule and is allowed; null html has
no links; html of any length is searched whole, and hosts and white space in it may have any length; hosts without links or
seeds in reach are allowed; repeated rows give repeated results and add no links, but count for what part of a host's pages
fall under rules; a null page_id is kept; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialise, table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: A link's host: after // of an href value.
LINK = r"(?i)href\s*+=\s*+[\"']?(?:https?:)?//([^/?#\"'\s>]++)"
#: Parts that the links of a host are dealt in, by their other end.
PARTS = 64


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls; for rule lists that fit in an expression (some hundred)."""
    rule = verdict = F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: len(r[0])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def host_scores(judged: DataFrame, edges: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """(host, trust, distrust): personalised PageRank in units of a seed's own start; a seed that nothing else reaches has 1.

    judged: (host, verdict) of pages; edges: distinct (src, dst). Each round is one join and one pre-aggregated sum over both
    directions, written to the shared folder; rounds go on until no score moves by more than the tolerance. A round shrinks the
    sum of all moves by the damping, which bounds the number of rounds; beyond it this raises.
    """
    share = lambda v: F.avg(F.when(F.col("verdict") == v, 1.0).otherwise(0.0))
    hosts = judged.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")).where("host <> ''")
    seeds = materialise(
        hosts.where("allowed >= 0.5").select(F.lit("trust").alias("kind"), "host")
        .unionByName(hosts.where("blocked >= 0.5").select(F.lit("distrust").alias("kind"), "host"))
        .withColumn("seed", F.lit(1.0)),
        "seeds",
    )
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    flow = materialise(both.withColumn("part", F.pmod(F.xxhash64("dst"), F.lit(PARTS)).cast("int")), "flow")
    # a host with very many links is met in parts: (kind, src, part) has a row for each part that holds links, and no more rows than links
    parts = flow.groupBy("kind", "src", "part").agg(F.count("*").alias("n"))
    degree = parts.groupBy("kind", "src").agg(F.sum("n").alias("degree"))
    parts = materialise(parts.select("kind", "src", "part").join(degree, ["kind", "src"]), "parts")
    ranks = seeds.select("kind", "host", F.col("seed").alias("rank"))
    n_seeds = seeds.count()
    # if nothing flows, the scores are the seeds
    rounds = 0 if flow.isEmpty() or not n_seeds else 2 + math.ceil(math.log(tolerance / n_seeds) / math.log(damping))
    for _ in range(rounds):
        given = parts.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"])
        given = given.select("kind", "src", "part", (F.col("rank") * damping / F.col("degree")).alias("share"))
        moved = flow.join(given, ["kind", "src", "part"]).select("kind", F.col("dst").alias("host"), F.col("share").alias("gain"), F.lit(0.0).alias("was"))
        start = seeds.select("kind", "host", F.col("seed").alias("gain"), F.lit(0.0).alias("was"))
        old = ranks.select("kind", "host", F.lit(0.0).alias("gain"), F.col("rank").alias("was"))
        new = materialise(
            moved.unionByName(start).unionByName(old).groupBy("kind", "host").agg(F.sum("gain").alias("rank"), F.sum("was").alias("was")),
            "ranks",
        )
        change = new.agg(F.max(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0
        ranks = new.where("rank > 0").select("kind", "host", "rank")
        if change <= tolerance:
            break
    else:
        if rounds:
            raise RuntimeError(f"host scores still move by {change} after {rounds} rounds")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, ratio: float = 2.0, least: float = 0.05, **options
) -> DataFrame:
    """(page_id, host, path, rule, verdict, by): by says whether the rule or the method decided."""
    url = F.col(url_col)
    split = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    links = pages.select(host_of(url).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    edges = materialise(links.where("src <> '' AND src <> dst").distinct(), "edges")
    scores = host_scores(ruled.select("host", F.col("ruled").alias("verdict")), edges, **options)
    bad = materialise(scores.where((F.col("distrust") >= least) & (F.col("distrust") > ratio * F.col("trust"))).select(F.col("host").alias("bad_host")), "bad")
    decided = ruled.join(bad, ruled["host"] == bad["bad_host"], "left")
    return decided.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("bad_host").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.when(F.col("rule").isNotNull(), F.lit("rule")).otherwise(F.lit("links")).alias("by"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
