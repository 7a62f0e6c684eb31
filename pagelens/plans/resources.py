"""Reference tables: what platforms draw their answers from, and how to work through an audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import patterns as P
from pagelens.operators import checks, planning

#: What is asked of a page in each layer, in the order in which to work.
LAYER_NOTES = {
    "crawl": "Can bots reach the page, and is its text in the HTML?",
    "parse": "Do title, description, headings and structured data say what the page is?",
    "cite": "Can passages be quoted as they stand: conclusions first, figures, dates, lists?",
    "entity": "Is it clear, and everywhere the same, who speaks?",
    "reach": "Do sitemap and feed lead to the page, and are they up to date?",
    "trust": "Are author, sources and data named, so that claims can be checked?",
}


def checklist(spark: SparkSession) -> DataFrame:
    """(id, layer, weight, title, advice) of every check."""
    return planning.catalog(spark)


def playbook(spark: SparkSession) -> DataFrame:
    """(place, layer, question, weight, n_checks): the layers in order, with the weight of their checks."""
    rows = [(n, layer, LAYER_NOTES[layer], sum(c.weight for c in checks.CHECKS if c.layer == layer), sum(c.layer == layer for c in checks.CHECKS)) for n, layer in enumerate(checks.LAYERS, 1)]
    return spark.createDataFrame(rows, "place int, layer string, question string, weight int, n_checks int")


def platform_profiles(samples: DataFrame, results: DataFrame) -> DataFrame:
    """(platform, n, mention_share, role_score, hosts): what each platform's sampled answers cite, most cited host first.

    Profiles are measured from answers and from the hosts of the results of their questions, instead of being given.
    """
    from pagelens.operators import pool, visibility

    asked = samples.select(F.coalesce(F.nullif("platform", F.lit("")), F.lit("unlabelled")).alias("platform"), "question").distinct()
    hosts = asked.join(pool.hits(results), "question").groupBy("platform", "host").agg(F.count("*").alias("n_host"))
    listed = hosts.groupBy("platform").agg(F.array_sort(F.collect_list(F.struct((-F.col("n_host")).alias("n"), "host"))).alias("all")).select("platform", F.transform(F.slice("all", 1, 10), lambda h: h["host"]).alias("hosts"))
    return visibility.by_platform(samples).select("platform", "n", "mention_share", "role_score").join(listed, "platform", "left")


def known_hosts(spark: SparkSession) -> DataFrame:
    """(host, kind): platforms on which profiles count, and authorities whose citation does."""
    return spark.createDataFrame([(h, "platform") for h in P.PLATFORMS] + [(h, "authority") for h in P.AUTHORITIES], "host string, kind string")


def prompt(kind: str, target: str) -> str:
    """A text that asks for a full audit of a page, or for a study of a question over several runs."""
    if kind == "audit":
        return f"Audit {target}: give the score by layer, then the fixes in order of weight, each with its evidence."
    return f"Ask \"{target}\" on each platform at least {P.MIN_N} times, note role, sentiment and facts of each answer, and report the indicators with their sample sizes."
