"""Rows without an id, and ids that most rows repeat, in one range or one sample."""

from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from pagelens.llm import common, mixing, quality, toxicity


def test_rows_without_an_id_are_dealt_over_ranges(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat_ws(" ", F.lit("w"), "id").alias("text"), F.lit("s").alias("source"))
    sizes = mixing.keyed(docs, 3).groupBy(mixing.RANGE).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 12 and sizes[1] > 2000
    got = mixing.queue(docs).collect()
    assert len(got) == 4000 and abs(sum(r["_mix_taken"] for r in got) - got[0]["_mix_target"]) <= 1
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.queue(docs.repartition(7)).collect()))


def test_repeated_ids_do_not_swell_a_sample(spark, monkeypatch):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(20)], "doc_id long, quality int, toxic int")
    text = F.concat(F.lit("some words of "), F.when(F.col("id") % 2 == 1, "vile hateful ").otherwise("plain "), F.col("id") % 20)
    docs = spark.range(20).select((F.col("id") % 20).alias("doc_id"), text.alias("text"))
    many = docs.unionByName(docs.where("doc_id = 3").join(spark.range(5000).select(F.col("id").alias("x"))).select("doc_id", F.concat("text", F.lit(" tail "), "x").alias("text")))
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda p, u, prior: seen.append((len(p), len(u))) or fit(p, u, prior))
    quality.train(many, labels)
    assert seen and all(p <= 20 and u <= 20 for p, u in seen)
    assert toxicity.train(many, labels) == toxicity.train(many.repartition(5), labels)


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    """They would stay beside those of all later steps, until the driver's JVM collects garbage."""
    disk = spark._jsc.sc().env().blockManager().diskBlockManager()
    names = lambda: set(re.findall(r"shuffle_\w+\.data", disk.getAllFiles().mkString(" ")))
    before = names()
    made = common.checkpoint(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    for _ in range(50):
        if not names() - before:
            break
        time.sleep(0.2)
    assert not names() - before
    assert sum(r["n"] for r in made.collect()) == 1000 and spark.conf.get(common.CLEANUP, "false") == "false"
