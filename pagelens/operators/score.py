"""Scores, grades, layers, priorities and comparisons, from long tables of check results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import patterns as P


def points(status: Column) -> Column:
    return F.when(status == "ok", 1.0).when(status == "warn", 0.5).otherwise(0.0)


def percent(got: Column, total: Column) -> Column:
    """Whole percent, ties to even; 0 without weight."""
    return F.coalesce(F.bround(F.try_divide(got, total) * 100, 0), F.lit(0)).cast("long")


def grade(score: Column) -> Column:
    out = F.lit("F")
    for least, name in reversed(P.GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def _sums(checks: DataFrame, *keys: str) -> DataFrame:
    weighed = checks.where("weight > 0").groupBy(*keys)
    return weighed.agg(F.sum(F.col("weight") * points(F.col("status"))).alias("got"), F.sum("weight").cast("long").alias("total"), F.count_if(F.col("status") == "fail").alias("n_fail"), F.count_if(F.col("status") == "warn").alias("n_warn"))


def page_scores(checks: DataFrame, key: str = "page_id") -> DataFrame:
    return _sums(checks, key).withColumn("score", percent(F.col("got"), F.col("total"))).withColumn("grade", grade(F.col("score")))


def layer_scores(checks: DataFrame, key: str = "page_id") -> DataFrame:
    return _sums(checks, key, "layer").withColumn("score", percent(F.col("got"), F.col("total")))


def priority_fixes(checks: DataFrame, key: str = "page_id", most: int = 10) -> DataFrame:
    """(key, place, check_id, weight, status): heaviest first, failures before warnings, then in the order of the checks."""
    order = Window.partitionBy(key).orderBy(F.desc("weight"), F.desc(F.col("status") == "fail"), "check_pos")
    bad = checks.where(F.col("status").isin("fail", "warn"))
    return bad.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(key, "place", "check_id", "weight", "status")


def status_by_check(checks: DataFrame) -> DataFrame:
    return checks.groupBy("check_id", "layer").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "warn", "fail", "info")])


def grade_histogram(scores: DataFrame) -> DataFrame:
    return scores.groupBy("grade").agg(F.count("*").alias("n_pages"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def _sides(pairs: DataFrame) -> DataFrame:
    """(a, b, page, first): each pair twice, so that both of its pages are looked up in one join."""
    return pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("page"), F.lit(True).alias("first")), F.struct(F.col("b").alias("page"), F.lit(False).alias("first")))).alias("s")).select("a", "b", "s.*")


def compare(pairs: DataFrame, checks: DataFrame, key: str = "page_id") -> DataFrame:
    """(a, b, check_id, status_a, status_b, winner) of the weighty checks that differ by half a point or more.

    A check that one page lacks counts as failed there and is shown as "missing".
    """
    kept = checks.where("weight > 0").select(F.col(key).alias("page"), "check_id", "status")
    status = lambda first: F.max(F.when(F.col("first") == first, F.col("status")))
    both = _sides(pairs).join(kept, "page").groupBy("a", "b", "check_id").agg(status(True).alias("status_a"), status(False).alias("status_b"))
    gap = points(F.col("status_a")) - points(F.col("status_b"))
    return both.where(F.abs(gap) >= 0.5).select("a", "b", "check_id", F.coalesce("status_a", F.lit("missing")).alias("status_a"), F.coalesce("status_b", F.lit("missing")).alias("status_b"), F.when(gap > 0, "A").otherwise("B").alias("winner"))


def compare_scores(pairs: DataFrame, scores: DataFrame, key: str = "page_id") -> DataFrame:
    """(a, b, score_a, score_b, winner, gap) of pairs of which both pages have a score; A wins ties."""
    score = lambda first: F.max(F.when(F.col("first") == first, F.col("score")))
    both = _sides(pairs).join(scores.select(F.col(key).alias("page"), "score"), "page").groupBy("a", "b").agg(score(True).alias("score_a"), score(False).alias("score_b")).where("score_a IS NOT NULL AND score_b IS NOT NULL")
    return both.select("a", "b", "score_a", "score_b", F.when(F.col("score_a") >= F.col("score_b"), "A").otherwise("B").alias("winner"), F.abs(F.col("score_a") - F.col("score_b")).alias("gap"))
