"""Who holds a question's search results: host shares and whether a brand or domain is among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import urls


def hits(results: DataFrame) -> DataFrame:
    """(question, pos, title, url, host) of results (question, pos, title, url); those without a URL go."""
    kept = results.where(F.coalesce("url", F.lit("")) != "")
    return kept.select("question", "pos", F.left(F.coalesce("title", F.lit("")), F.lit(80)).alias("title"), F.left("url", F.lit(160)).alias("url"), urls.host(F.col("url")).alias("host"))


def host_distribution(results: DataFrame, most: int = 12) -> DataFrame:
    """(question, host, n, place): most frequent first, ties by first appearance."""
    counted = hits(results).groupBy("question", "host").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    order = Window.partitionBy("question").orderBy(F.desc("n"), "first_pos", "host")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("question", "host", "n", "place")


def verdicts(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """(question, n_results, hit_brand, hit_domain, verdict) for wanted (question, brand, domain, source_status).

    A source that didn't answer (any source_status but "ok") is told apart from a pool without the brand.
    """
    brand, domain = F.trim(F.coalesce("brand", F.lit(""))), F.replace(F.lower(F.trim(F.coalesce("domain", F.lit("")))), F.lit("www."), F.lit(""))
    joined = wanted.join(hits(results), "question", "left")
    in_brand = (brand != "") & F.contains(F.concat("title", "url"), brand)
    in_domain = (domain != "") & ((F.col("host") == domain) | F.col("host").endswith(F.concat(F.lit("."), domain)))
    found = joined.groupBy("question", "brand", "domain", "source_status").agg(F.count("url").alias("n_results"), F.coalesce(F.bool_or(in_brand), F.lit(False)).alias("hit_brand"), F.coalesce(F.bool_or(in_domain), F.lit(False)).alias("hit_domain"))
    verdict = (
        F.when(F.trim("question") == "", "missing_question").when(F.coalesce("source_status", F.lit("ok")) != "ok", "source_unavailable")
        .when((brand == "") & (domain == ""), "not_asked").when(F.col("hit_domain"), "own_site_present").when(F.col("hit_brand"), "brand_mentioned").otherwise("absent")
    )
    return found.select("question", "n_results", "hit_brand", "hit_domain", verdict.alias("verdict"))
