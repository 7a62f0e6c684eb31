"""Fix plans: failing checks joined with the catalog of advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators.checks import CHECKS

DEFAULT_TOP, MOST = 8, 20


def catalog(spark: SparkSession) -> DataFrame:
    """(id, layer, weight, title, advice): one row for each check; a short fixed list."""
    return spark.createDataFrame([(c.key, c.layer, c.weight, c.title, c.advice) for c in CHECKS], "id string, layer string, weight int, title string, advice string")


def split_ids(text: Column) -> Column:
    return F.filter(F.split(text, r"[,，\s\x{a0}\x{3000}]+"), lambda s: s != "")


def targets(requests: DataFrame, top: int = DEFAULT_TOP) -> DataFrame:
    """(request, pos, id) of requests (request, ids); the list is cut first and sorted later."""
    cut = max(1, min(top, MOST))
    return requests.select("request", F.posexplode(F.slice(split_ids(F.col("ids")), 1, cut)).alias("pos", "id"))


def plan(requests: DataFrame, advice: DataFrame, top: int = DEFAULT_TOP) -> DataFrame:
    """(request, place, id, layer, weight, title, advice): heaviest first, else as given."""
    from pyspark.sql import Window

    known = targets(requests, top).join(F.broadcast(advice), "id")
    return known.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("weight"), "pos"))).select("request", "place", "id", "layer", "weight", "title", "advice")


def unknown(requests: DataFrame, advice: DataFrame, top: int = DEFAULT_TOP) -> DataFrame:
    return targets(requests, top).join(F.broadcast(advice.select("id")), "id", "left_anti").select("request", "pos", "id")


def outcome(requests: DataFrame) -> DataFrame:
    """(request, ok, error): a request without ids is an error value, not an exception."""
    empty = F.size(split_ids(F.coalesce("ids", F.lit("")))) == 0
    return requests.select("request", (~empty).alias("ok"), F.when(empty, "no_targets").alias("error"))
