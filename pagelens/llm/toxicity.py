"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= j) = logistic(threshold_j - w.x) with one weight vector for all ordered thresholds; the expected
severity is the sum over j of P(grade > j). Features are whole words and word beginnings; those that a sample of
labelled texts associates with toxicity (log-odds with a standard error) enter x, all others have weight 0. A feature
that stands n times counts 2n / (n + 1), in training and in scoring alike: however long a text is, a repeated word comes
to less than twice its weight.

Labels say toxic or not. A toxic text's grade is where its score by a first, binary regression lies among the toxic
texts of the sample: the lower, middle or upper third (1, 2, 3). That regression is cross-fitted in two folds, so a
text is graded by weights that were learned from other texts. Texts labelled not toxic have grade 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import checkpoint, map_batches, one_text, partitions, prepare, sampled_ids, table, texts

#: Bounds of the training sample (by a hash of doc_id) and of the features that enter the regression.
MAX_TOXIC, MAX_CLEAN, MAX_FEATURES = 4_000, 12_000, 1_000
#: Pieces that the sample, which is bounded, is dealt to at most.
SAMPLE_PARTS = 64
PREFIXES = (4, 5, 6)
GRADES = 3
#: A feature needs this log-odds z-score and ratio of rates, in at least SUPPORT toxic texts.
MIN_Z, MIN_RATIO, SUPPORT = 2.5, 20.0, 3
STEPS, RATE, PENALTY = 400, 0.05, 1e-3
#: Expected severity from which a text counts as toxic.
THRESHOLD = 0.5
#: Words whose features a worker remembers.
CACHE = 1 << 19

SPLIT = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return SPLIT.findall(text.lower())


def features_of(word: str) -> list[str]:
    """The word, marked as whole, and its beginnings."""
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def severity(self, total: np.ndarray) -> np.ndarray:
        return sum((0.5 * (1 + np.tanh((total - t) / 2)) for t in self.thresholds), np.zeros(len(total)))

    def grade(self, total: np.ndarray) -> np.ndarray:
        """The median: the highest grade that is rather reached than not."""
        return (np.asarray(total)[:, None] > np.array(self.thresholds)).sum(axis=1)


class Finder(dict):
    """word -> those of its features that the model knows, filled on demand."""

    def __init__(self, known):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= CACHE:
            self.clear()
        self[word] = found = tuple(f for f in features_of(word) if f in self.known)
        return found

    def x(self, text: str) -> dict[str, float]:
        """Feature -> value, of a whole text; the same for training and scoring."""
        counts = Counter(chain.from_iterable(map(self.__getitem__, words(text))))
        return {f: 2 * n / (n + 1) for f, n in counts.items()}


def fit(x: np.ndarray, y: np.ndarray, names: list[str], times: np.ndarray | None = None, levels: int = GRADES) -> Model:
    """Adam on the ordinal log-likelihood of grades 0 to ``levels``, classes weighted to balance grade 0 against the
    others; ``times`` says how often each row counts."""
    times = np.ones(len(y)) if times is None else times
    w, first, gaps = np.zeros(x.shape[1]), 1.0, np.zeros(levels - 1)
    weight = times * np.where(y == 0, 0.5 / max(1, times[y == 0].sum()), 0.5 / max(1, times[y > 0].sum()))
    theta = np.concatenate([w, [first], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, first, gaps = theta[: len(w)], theta[len(w)], theta[len(w) + 1 :]
        t = first + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(gaps)))])
        over = 0.5 * (1 + np.tanh(((x @ w)[:, None] - t) / 2))  # P(y > j)
        full = np.concatenate([np.ones((len(y), 1)), over, np.zeros((len(y), 1))], axis=1)
        at = np.arange(len(y))
        p = np.maximum(full[at, y] - full[at, y + 1], 1e-9)
        slope = np.concatenate([np.zeros((len(y), 1)), over * (1 - over), np.zeros((len(y), 1))], axis=1)
        d_total = -weight * (slope[at, y] - slope[at, y + 1]) / p
        d_t = np.zeros((len(y), levels + 2))
        d_t[at, y] += weight * slope[at, y] / p
        d_t[at, y + 1] -= weight * slope[at, y + 1] / p
        d_t = d_t.sum(axis=0)[1:-1]
        tails = np.cumsum(d_t[::-1])[::-1]
        grad = np.concatenate([x.T @ d_total + PENALTY * w, [tails[0]], tails[1:] / (1 + np.exp(-gaps))])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, first, gaps = theta[: len(w)], theta[len(w)], theta[len(w) + 1 :]
    t = first + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(gaps)))])
    return Model({n: float(k) for n, k in zip(names, w, strict=True)}, tuple(map(float, t)))


def grades(x: np.ndarray, toxic: np.ndarray, names: list[str], times: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Grades of the rows from their cross-fitted scores; rows of fold 2 belong to no fold and count half in each."""
    score = np.zeros(len(toxic))
    for f in (0, 1):
        first = fit(x, toxic, names, np.where(fold == 2, times / 2, times * (fold != f)), levels=1)
        score[fold == f] = (x @ np.array([first.weights[n] for n in names]))[fold == f]
    low, high = np.quantile(np.repeat(score[toxic == 1], times[toxic == 1].astype(int)), [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + (score > low).astype(int) + (score > high), 0)


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fit on at most the given numbers of labelled texts, smallest hashes of doc_id first, one text for each id.

    Rows whose crc32 of doc_id modulo 5 is 0 are left out, for evaluation. Without toxic rows, or without features
    that tell them, every severity is close to 0.
    """
    spark = docs.sparkSession
    prepare(spark)
    shown = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = lambda value, most: sampled_ids(shown.where(F.col("toxic") == value), most).withColumn("toxic", F.lit(value))
    chosen = part(1, max_toxic).unionByName(part(0, max_clean))
    sample = checkpoint(one_text(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxic").repartition(min(partitions(spark), SAMPLE_PARTS)))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1:
        return Model({}, (10.0, 11.0, 12.0))

    def counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for toxic, text in zip(batch.column("toxic").to_pylist(), texts(batch), strict=True):
            seen[toxic].update({f for w in set(words(text)) for f in features_of(w)})
        names = list(seen[0] | seen[1])
        return pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "clean": pa.array([seen[0][f] for f in names], pa.int64()), "toxic": pa.array([seen[1][f] for f in names], pa.int64())})

    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    rate = F.log(a / (n1 + 1 - a)) - F.log(b / F.greatest(F.lit(n0) + 1 - b, F.lit(0.5)))
    table_ = map_batches(sample.select("toxic", "text"), counts, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= max(SUPPORT, n1 // 200))
    table_ = table_.where((a / n1) / (b / max(n0, 1)) >= MIN_RATIO).withColumn("z", rate / F.sqrt(1 / a + 1 / b)).where(F.col("z") >= MIN_Z)
    names = [r["feature"] for r in table_.orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()]
    if not names:
        return Model({}, (10.0, 11.0, 12.0))
    known = frozenset(names)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        finder = Finder(known)
        found = [finder.x(t) for t in texts(batch)]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "names": pa.array([sorted(x) for x in found], pa.list_(pa.string())), "x": pa.array([[x[f] for f in sorted(x)] for x in found], pa.list_(pa.float64()))})

    got = map_batches(sample, rows, "doc_id long, toxic int, names array<string>, x array<double>")
    got = got.groupBy("toxic", "names", "x", F.when(F.size("names") > 0, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2).otherwise(2).cast("int").alias("fold")).agg(F.count("*").alias("times"))
    got = sorted(got.collect(), key=lambda r: (r["toxic"], r["fold"], r["names"], r["x"]))
    place = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(got), len(names)))
    for k, r in enumerate(got):
        x[k, [place[f] for f in r["names"]]] = r["x"]
    toxic, times, fold = (np.array([r[c] for r in got]) for c in ("toxic", "times", "fold"))
    return fit(x, grades(x, toxic, names, times, fold), names, times)


def graded(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, severity, grade, toxic), a row for every row, whatever its doc_id; null and empty texts have no features.

    severity: the expected grade, 0 to 3; grade: the median one; toxic: severity is ``threshold`` or more. Texts are
    read whole, however long; repeated rows are graded alike; an empty table gives no rows; columns other than doc_id
    and text are not looked at.
    """
    names = sorted(f for f, w in model.weights.items() if w)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        finder = Finder(frozenset(names))
        total = np.array([sum(model.weights[f] * v for f, v in sorted(finder.x(t).items())) for t in texts(batch)])
        severity = model.severity(total)
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "severity": severity, "grade": pa.array(model.grade(total), pa.int32()), "toxic": pa.array(severity >= threshold, pa.bool_())})

    return map_batches(docs.select("doc_id", "text"), kernel, "doc_id long, severity double, grade int, toxic boolean")


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return graded(docs, train(docs, table(spark, sf_dir, "labels")))
