"""The trained operators on held-out labels, and the pipeline stage by stage."""

from __future__ import annotations

import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline
from pagelens.llm import decontamination, mixing, quality, toxicity

MIDDLE = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = quality.op9_quality(spark, MIDDLE).collect()
    assert all(r["held_out"] == quality.held_out(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    good = [r["score"] for r in rows if r["held_out"] and labels.get(r["doc_id"]) == 1]
    bad = [r["score"] for r in rows if r["held_out"] and labels.get(r["doc_id"]) == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert np.mean([g >= 0.3 for g in good]) > 0.97 and np.mean([b < 0.3 for b in bad]) > 0.8


def test_quality_reads_neither_held_out_nor_negative_labels(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(quality.held_out_column(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = quality.train(docs, labels)
    for other in (flipped, labels.where("quality = 1")):
        b = quality.train(docs, other)
        assert (a.weights == b.weights).all() and (a.scale, a.shift, a.bias) == (b.scale, b.shift, b.bias)


def test_quality_scores_are_what_the_weights_say(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.scored(docs, model).collect():
        x, n = quality.features(text[r["doc_id"]] or ""), model.edges.shape[1]
        g = model.bias + sum(w for k, v in enumerate(x) for e, w in zip(model.edges[k], model.weights[k * n : k * n + n], strict=True) if v > e)
        assert abs(r["score"] - 1 / (1 + np.exp(-(model.scale * g + model.shift)))) < 1e-4


def test_prior_is_estimated_from_positive_and_unlabelled_rows():
    rng = np.random.default_rng(2)
    for prior in (0.3, 0.6, 0.9):
        n = 3000
        good, many = rng.normal(1, 1, (1500, len(quality.NAMES))), int(prior * n)
        mixed = np.concatenate([rng.normal(1, 1, (many, len(quality.NAMES))), rng.normal(-1, 1, (n - many, len(quality.NAMES)))])[rng.permutation(n)]
        assert abs(quality.estimated_prior(good, mixed) - prior) < 0.06
        model = quality.calibrated(quality.fit(good, mixed, prior), good, mixed, prior)
        assert abs(model.score(mixed).mean() - prior) < 0.03


def test_risk_is_not_negative():
    rng = np.random.default_rng(0)
    n = len(quality.NAMES)
    model = quality.fit(rng.normal(1, 1, (300, n)), np.concatenate([rng.normal(1, 1, (300, n)), rng.normal(-1, 1, (300, n))]), 0.5)
    good, bad = model.score(rng.normal(1, 1, (200, n))), model.score(rng.normal(-1, 1, (200, n)))
    assert (good > 0.5).mean() > 0.95 and (bad < 0.5).mean() > 0.95


def test_toxicity_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = [r for r in toxicity.op2_toxicity(spark, MIDDLE).collect() if r["doc_id"] in labels]
    clean = [r for r in rows if labels[r["doc_id"]] == 0]
    assert np.mean([r["toxic"] for r in clean]) < 0.02
    english = {r["doc_id"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").where("lang = 'en'").collect()}
    held = [r for r in rows if labels[r["doc_id"]] == 1 and toxicity.held_out(r["doc_id"]) and r["doc_id"] in english]
    assert held and np.mean([r["toxic"] for r in held]) >= 0.7
    assert len({r["grade"] for r in rows if labels[r["doc_id"]] == 1}) >= 3


def test_ordinal_fit():
    rng = np.random.default_rng(1)
    x = rng.poisson(0.4, (600, 5)).astype(float)
    y = np.minimum(3, x[:, :3].sum(axis=1)).astype(int)
    model = toxicity.fit(x, y, [f"w{k}" for k in range(5)])
    assert list(model.thresholds) == sorted(model.thresholds)
    total = x @ np.array([model.weights[f"w{k}"] for k in range(5)])
    severity = model.severity(total)
    assert all(severity[y == a].mean() + 0.3 < severity[y == a + 1].mean() for a in range(3))
    assert (model.grade(total) == y).mean() > 0.9
    assert (severity >= 0).all() and (severity <= toxicity.GRADES).all()


def ordinal_corpus(spark, seed=5):
    """Texts whose grades are known: of grade g, 2 g - 1 to 2 g foul words of growing strength, in lengths of 20 to 400."""
    import random

    rng = random.Random(seed)
    plain, foul = [f"calm{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)], [[f"{c}oul{chr(97 + k)}ness" for k in range(8)] for c in "fgh"]
    rows, labels, known = [], [], {}
    for n in range(900):
        g = 0 if n % 3 else 1 + n // 3 % 3
        words = rng.choices(plain, k=rng.randint(20, 400)) + [rng.choice(foul[rng.randint(0, g - 1)]) for _ in range(2 * g - rng.randint(0, 1))] * bool(g)
        rng.shuffle(words)
        rows.append((n, " ".join(words)))
        labels.append((n, int(g > 0)))
        known[n] = g
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), known


def test_toxicity_orders_known_grades_and_is_what_the_weights_say(spark):
    docs, labels, known = ordinal_corpus(spark)
    model = toxicity.train(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in toxicity.graded(docs, model).collect()}
    held = [d for d in known if toxicity.held_out(d)]
    mean = [np.mean([got[d]["severity"] for d in held if known[d] == g]) for g in range(4)]
    assert mean[0] < 0.3 < mean[1] < mean[2] < mean[3]
    for d, t in text.items():  # severity, word by word, from the weights alone
        counts = Counter(f for w in t.split() for f in [f"={w}", w[:4], w[:5], w[:6]] if f in model.weights and len(f) >= 4)
        total = sum(model.weights[f] * 2 * n / (n + 1) for f, n in counts.items())
        over = [1 / (1 + np.exp(t - total)) for t in model.thresholds]
        assert abs(got[d]["severity"] - sum(over)) < 1e-9
        assert got[d]["grade"] == sum(o > 0.5 for o in over) and got[d]["toxic"] == (sum(over) >= 0.5)


def test_repeating_a_word_does_not_make_a_text_toxic(spark):
    docs, labels, known = ordinal_corpus(spark)
    model = toxicity.train(docs, labels)
    clean = next(t for d, t in ((r["doc_id"], r["text"]) for r in docs.collect()) if known[d] == 0)
    rows = [(n, " ".join([clean] * n)) for n in (1, 10, 100)]
    assert not any(r["toxic"] for r in toxicity.graded(spark.createDataFrame(rows, "doc_id long, text string"), model).collect())
    weak = toxicity.Model({"=mild": 0.12, "mild": 0.12}, model.thresholds)
    one, many = toxicity.graded(spark.createDataFrame([(1, "mild"), (2, "mild " * 2000)], "doc_id long, text string"), weak).collect()
    assert not many["toxic"] and many["severity"] < 1.5 * one["severity"]


def test_pipeline_stage_by_stage(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs
        old, new = Counter(r["doc_id"] for r in before.collect()), Counter(r["doc_id"] for r in docs.collect())
        text = {r["doc_id"]: r["text"] for r in before.collect()}
        if name == "quality":
            scores = quality.scored(before, quality.train(before, spark.read.parquet(f"{small}/labels.parquet"))).collect()
            assert new == Counter(r["doc_id"] for r in scores if r["score"] >= quality.THRESHOLD)
        elif name == "near_duplicates":
            assert new == Counter(d for d, g in brute.shingle_groups(list(text.items()), 5, 80, 100).items() if g[1] == d)
        elif name == "decontamination":
            items = [decontamination.normal(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            exact = {d for d, t in text.items() if any(i in decontamination.normal(t) for i in items)}
            assert set(old) - set(new) == exact
        elif name == "mixing":
            served = {r["doc_id"]: r for r in mixing.queue(before).collect()}
            assert new == Counter({d: n for d, r in served.items() if (n := int(r["_mix_taken"] / max(1, r["_mix_size"]) + 0.5))})
        else:
            assert new == old and docs.where("shard IS NULL").isEmpty()
        assert name == "sharding" or docs.columns == columns
    sizes = defaultdict(int)
    for r in kept["sharding"].collect():
        sizes[r["shard"]] += len(r["text"].encode())
    assert all(r["shard_bytes"] == sizes[r["shard"]] for r in kept["sharding"].collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).select("doc_id", "shard").collect())) == sorted(map(tuple, kept["sharding"].select("doc_id", "shard").collect()))
