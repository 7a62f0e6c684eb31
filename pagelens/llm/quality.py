"""A quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are rows labelled 1 and the unlabelled set is web text as it comes; rows labelled 0 are not used at
all. The risk of a score g is pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)]) with the logistic loss (Kiryo et
al., "Positive-unlabeled learning with non-negative risk estimator"); where the second term falls under zero, only the
first one counts. The model is additive over binned surface statistics of the whole text.

The class prior pi is estimated from the same two samples by best-bin estimation (Garg et al., "Mixture proportion
estimation and PU learning"): a classifier of positives against unlabelled text is fit on one half of them, and on the
other half pi is at most the share of unlabelled text over any score divided by the share of positives over it, since
the best-scored texts are nearly all positive. Platt scaling by the same risk makes g a probability of which the mean
over unlabelled text is the prior, so that a threshold means what it says.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import filter_batches, map_batches, prepare, sampled_ids, table, texts

#: Bounds of the training sample, which is taken by a hash of doc_id.
MAX_POSITIVE, MAX_UNLABELLED = 8_000, 16_000
BINS = 12
STEPS, RATE = 300, 0.03
#: Weight decay, shared out over the trusted positives: the fewer there are, the plainer the model.
PENALTY = 3.0
THRESHOLD = 0.3
#: Confidence of the prior's estimate: the chance of an error beyond its bounds, and how far those count.
DELTA, GAMMA = 0.1, 0.01
#: How much calibration is held to the scale it finds.
HOLD = 0.1

# The byte classes whose shares are features.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\n\r\x0b\f", "line": b"\n", "stop": b".,;:?", "shout": b"!", "mark": b"#$%&*@^~+=<>", "bar": b"|", "quote": b"\"'()[]{}", "high": bytes(range(128, 256))}
NAMES = (*CLASSES, "bytes", "words", "word_length", "word_spread", "distinct", "echo", "title", "all_upper", "stopped", "lines", "line_distinct", "short_lines", "top_word", "long_words")
_TABLE = np.zeros((256, len(CLASSES)))
for _k, _chars in enumerate(CLASSES.values()):
    _TABLE[list(_chars), _k] = 1


def features(text: str) -> list[float]:
    """Surface statistics of a whole text; those of an empty one are zeros."""
    raw = text.encode()
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE / max(1, len(raw))
    words = raw.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [
        *shares, np.log1p(len(raw)), np.log1p(len(words)), float(lengths.mean()), float(lengths.std()),
        len(counts) / n**0.9, sum(map(bytes.__eq__, words, words[1:])) / n, sum(map(bytes.istitle, words)) / n, sum(map(bytes.isupper, words)) / n,
        sum(w.endswith((b".", b"!", b"?")) for w in words) / n, np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), sum(len(x) < 20 for x in lines) / max(1, len(lines)),
        max(counts.values(), default=0) / n, float((lengths > 14).mean()),
    ]


@dataclass(frozen=True)
class Model:
    """Piecewise-linear effects: ``weights`` of features x edges, added up along each feature's cumulative bins."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def risk(self, x: np.ndarray) -> np.ndarray:
        return binned(x, self.edges) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.risk(x) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each feature and edge: is the value over the edge?"""
    return (x[:, :, None] > edges[None, :, :]).reshape(len(x), -1).astype(np.float32)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> Model:
    """Adam on the non-negative risk, full batch; the same rows in the same order give the same model.

    Without a prior, unlabelled rows count as negative, both kinds alike: a classifier of positive against unlabelled.
    """
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros((len(NAMES), 1)), np.zeros(len(NAMES)), 0.0)
    both = np.concatenate([positive, unlabelled])
    # Edges at quantiles, the outer ones close to the ends, where junk is.
    edges = np.quantile(both, [0.002, 0.01, 0.03, *np.linspace(0.08, 0.92, BINS - 6), 0.97, 0.99, 0.998], axis=0).T
    p, u = binned(positive, edges), binned(unlabelled, edges)
    share, take = (1.0, 0.0) if prior is None else (prior, prior)
    w, b = np.zeros(p.shape[1]), float(np.log(prior / (1 - prior))) if prior is not None and prior < 1 else 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        w32 = w.astype(np.float32)
        gp, gu = sigmoid(p @ w32 + np.float32(b)), sigmoid(u @ w32 + np.float32(b))
        rest = np.mean(-np.log1p(-np.minimum(gu, 1 - 1e-7))) - take * np.mean(-np.log1p(-np.minimum(gp, 1 - 1e-7)))
        toward = np.concatenate([p.T @ (gp - 1), [np.sum(gp - 1)]]) * share / len(p)
        away = np.concatenate([u.T @ gu, [gu.sum()]]) / len(u) - np.concatenate([p.T @ gp, [gp.sum()]]) * take / len(p)
        grad = toward + away if rest >= 0 else toward
        grad[:-1] += PENALTY / len(p) * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * min(1.0, 2 * (1 - step / (STEPS + 1)))
        w, b = w - move[:-1], b - move[-1]
    return Model(edges, w, b)


def best_bin(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior by best-bin estimation, from scores of positive and unlabelled rows that the scorer wasn't fit on."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    doubt = np.sqrt(np.log(4 / DELTA) / (2 * len(unlabelled))) + np.sqrt(np.log(4 / DELTA) / (2 * len(positive)))
    at = np.argmin((u + (1 + GAMMA) * doubt) / p)
    return float(np.clip(u[at] / p[at], 0.01, 0.99))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The mean of two estimates, each from the half that the other one's scorer was fit on."""
    halves = [(positive[k::2], unlabelled[k::2]) for k in (0, 1)]
    return float(np.mean([best_bin(*(fit(*halves[1 - k], None).risk(x) if len(x) else np.zeros(0) for x in halves[k])) for k in (0, 1)]))


def calibrated(model: Model, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Platt scaling by the unbiased PU risk, which is convex: E_u[log(1 + exp(z))] - prior * E_p[z] for z = scale * g +
    shift. At its minimum the mean score of unlabelled text is the prior. Newton steps, scale held near 1 by a little."""
    gp, gu = model.risk(positive).mean(), model.risk(unlabelled)
    z = np.stack([gu, np.ones(len(gu))], axis=1)
    beta, hold = np.array([1.0, 0.0]), np.diag([HOLD, 0.0])

    def loss(b: np.ndarray) -> float:
        return float(np.logaddexp(0, z @ b).mean() - prior * (b @ [gp, 1.0]) + HOLD / 2 * (b[0] - 1) ** 2)

    for _ in range(100):
        p = sigmoid(z @ beta)
        slope = z.T @ p / len(gu) - prior * np.array([gp, 1.0]) + hold @ (beta - [1.0, 0.0])
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(gu) + hold + 1e-9 * np.eye(2), slope)
        size = 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta - size * step
    return replace(model, scale=float(beta[0]), shift=float(beta[1])) if np.isfinite(beta).all() and beta[0] > 0 else model


def held_out_column() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on samples of at most the given sizes, smallest hashes of doc_id first, one text for each id.

    Of the labels only positive ones of rows that aren't held out (crc32 of doc_id modulo 5 is not 0) are used. Without
    positives every score is 0.5.
    """
    prepare(docs.sparkSession)
    trusted = labels.where(~held_out_column() & (F.col("quality") == 1) & F.col("doc_id").isNotNull())
    trusted = sampled_ids(trusted, max_positive).withColumn("trusted", F.lit(True))
    web = sampled_ids(docs.where(~held_out_column()), max_unlabelled, 1).withColumn("web", F.lit(True))
    # At most max_positive + max_unlabelled ids.
    chosen = trusted.join(web, "doc_id", "full")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "trusted": batch.column("trusted"), "web": batch.column("web"), "x": pa.array([list(map(float, features(t))) for t in texts(batch)], pa.list_(pa.float64()))})

    # Of several texts of an id the one with the least features counts, so that the rows are bounded as the ids are.
    rows = map_batches(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), kernel, "doc_id long, trusted boolean, web boolean, x array<double>")
    rows = rows.groupBy("doc_id", "trusted", "web").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    part = lambda name: np.array([r["x"] for r in rows if r[name]]).reshape(-1, len(NAMES))
    positive, unlabelled = part("trusted"), part("web")
    if not len(positive):
        return fit(positive, unlabelled, 0.5)
    prior = estimated_prior(positive, unlabelled)
    return calibrated(fit(positive, unlabelled, prior), positive, unlabelled, prior)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for every row, whatever its doc_id.

    Only the text is scored, whole, however long; null texts count as empty, and equal texts score alike. An empty table
    gives no rows; columns other than doc_id and text are not looked at.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id").to_pylist()
        score = model.score(np.array([features(t) for t in texts(batch)]))
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "held_out": [held_out(i) for i in ids], "score": pa.array(score, pa.float64()), "predicted": pa.array(score >= threshold).cast(pa.int32())})

    return map_batches(docs.select("doc_id", "text"), kernel, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is ``threshold`` or more, all columns as they were, without a shuffle; null texts
    count as empty."""
    return filter_batches(docs, lambda batch: (model.score(np.array([features(t) for t in texts(batch)])) >= threshold).tolist())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
