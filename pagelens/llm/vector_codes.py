"""Vector codes: each of the equal parts of a vector becomes the number of its nearest codebook entry.

Codebooks are fit by rounds of assignment and averaging over all vectors, in integers, so a code and an error don't
depend on how rows are dealt out. The nearest entry is found as in a VA-file (Weber, Schek and Blott, "A quantitative
analysis and performance study for similarity-search methods in high-dimensional spaces"): the entries' coordinates
are quantised to a few bits, which gives cells; for a query a table for each coordinate holds the least and the greatest
squared distance to each cell, and sums of looked-up values bound the distance to every entry. Only entries whose lower
bound is not over the least upper bound are measured, in integers, so the filter loses neither a nearest entry nor a tie.

A round sends each task's counts and sums by part and entry through one small aggregate, and the codebooks (at most
entries times width integers) to the tasks; vectors are never moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import checkpoint, map_batches, prepare, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits of a coordinate's cell.
BITS = 4
#: Integers of at least this magnitude (components of 32,768) are summed and squared as Python's own, slowly.
WIDE = 1 << 27
#: Up to so many labels their sums of errors are sent to every executor; beyond, they are joined.
BROADCAST_LABELS = 1 << 16


@dataclass(frozen=True)
class Cells:
    """Entries of one part's codebook (entries, coordinates), the cell of each of their coordinates, and the cells' bounds."""

    entries: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(entries: np.ndarray, bits: int = BITS) -> Cells:
        least = entries.min(axis=0)
        width = (entries.max(axis=0) - least) // (1 << bits) + 1
        low = least + np.arange(1 << bits)[:, None] * width
        return Cells(entries, ((entries - least) // width).astype(np.int64), low, low + width - 1)

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        """(queries, entries): True where an entry may be the nearest one or tie with it. ``queries``: (coordinates, n)."""
        lower = upper = 0
        for j, q in enumerate(queries):
            over, under = q - self.low[:, j, None], self.high[:, j, None] - q
            least, most = np.minimum(np.minimum(over, under), 0), np.maximum(over, under)
            lower = lower + (least * least)[self.cell[:, j]]
            upper = upper + (most * most)[self.cell[:, j]]
        return (lower <= upper.min(axis=0)).T

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry (ties: the lowest) and squared distance, for every query."""
        at, entry = np.nonzero(self.candidates(queries))
        gaps = queries[:, at] - self.entries[entry].T
        far = (gaps * gaps).sum(axis=0)
        starts = np.flatnonzero(np.diff(at, prepend=-1))  # every query has a candidate
        least = np.minimum.reduceat(far, starts)
        ties = np.flatnonzero(far == least[at])
        return entry[ties[np.flatnonzero(np.diff(at[ties], prepend=-1))]], least


@dataclass(frozen=True)
class Codebooks:
    """``books``: for each part an array (entries, coordinates); none where there was no vector."""

    books: tuple[np.ndarray, ...]

    @property
    def width(self) -> int:
        return sum(b.shape[1] for b in self.books)

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()


def _array(values: list) -> np.ndarray:
    """Integers as 64 bits where their squares and sums of squares fit, else as Python's own."""
    small = all(-WIDE < v < WIDE for row in values for v in row)
    return np.array(values, np.int64 if small else object)


def scaled(embedding: pa.Array, width: int, parts: int) -> np.ndarray:
    """(parts, coordinates, n): floor(SCALE * x) of lists that all have ``width`` finite components."""
    flat = np.floor(embedding.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).reshape(-1, width)
    whole = flat.astype(np.int64) if not flat.size or np.abs(flat).max() < WIDE else np.array([[int(v) for v in row] for row in flat], object)
    return np.ascontiguousarray(whole.T).reshape(parts, width // parts, len(flat))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and label of the rows whose vector is there and all finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "embedding", "label").where(F.col("embedding").isNotNull() & finite)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of vectors (vec_id, embedding, label), begun with those of the smallest vec_ids and fit to all.

    Their width is that of the smallest vec_id (null last; ties by components) whose vector can be cut into equal
    parts; vectors of another width are left out. With fewer vectors than ``entries`` there are as many entries;
    without any there are no codebooks. An entry that no vector is nearest to stays as it was.
    """
    prepare(vectors.sparkSession)
    rows, order = usable(vectors), (F.col("vec_id").asc_nulls_last(), F.col("embedding"))
    first = rows.where((F.size("embedding") > 0) & (F.size("embedding") % parts == 0)).orderBy(*order).select(F.size("embedding")).first()
    if first is None:
        return Codebooks(())
    width = first[0]
    rows = rows.where(F.size("embedding") == width)
    seeds = np.array([[int(np.floor(x * SCALE)) for x in r[0]] for r in rows.orderBy(*order).select("embedding").limit(entries).collect()], object)
    books = tuple(_array(part.tolist()) for part in np.split(seeds, parts, axis=1))
    for _ in range(rounds):
        sums = _sums(rows, Codebooks(books), width).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width // parts)])
        new = [b.tolist() for b in books]
        for r in sums.collect():  # a row for each entry
            new[r["part"]][r["entry"]] = [int(s) // int(r["n"]) for s in r[3:]]
        books = tuple(map(_array, new))
    return Codebooks(books)


def _sums(rows: DataFrame, codebooks: Codebooks, width: int) -> DataFrame:
    """(part, entry, n, sums): of each task, how many parts are nearest to an entry, and their sums."""
    parts = len(codebooks.books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells.of(b) for b in codebooks.books]
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for part, values in enumerate(scaled(batch.column(0), width, parts)):
                entry, _ = cells[part].nearest(values)
                order = np.argsort(entry, kind="stable")
                starts = np.flatnonzero(np.diff(entry[order], prepend=-1))
                added = np.add.reduceat(values[:, order], starts, axis=1).T.tolist()
                for e, n, s in zip(entry[order[starts]].tolist(), np.diff(starts, append=len(entry)).tolist(), added, strict=True):
                    old = held.setdefault((part, e), [0, [0] * len(s)])
                    old[0] += n
                    old[1] = [a + b for a, b in zip(old[1], s, strict=True)]
        if held:
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([[str(s) for s in v[1]] for v in held.values()], kind)], ["part", "entry", "n", "sums"])

    made = rows.select("embedding").mapInArrow(run, "part int, entry int, n long, sums array<string>")
    return made.withColumn("sums", F.col("sums").cast("array<decimal(38,0)>"))


def encode(vectors: DataFrame, codebooks: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of every row whose vector is there and finite, however often rows are repeated.

    ``code`` has two hexadecimal digits for each part, ``error`` is the sum of the squared distances. A vector of another
    width than that of the codebooks can't be coded and has nulls. No rows, no results; extra columns are not
    looked at. Components of 2**40 or more pass 64 bits and are an error.
    """
    width, parts = codebooks.width, len(codebooks.books)
    fits = F.when(F.size("embedding") == width, F.col("embedding"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = batch.column("embedding").is_valid().to_numpy(zero_copy_only=False)
        code, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
        if known.any():
            found = [Cells.of(b).nearest(v) for b, v in zip(codebooks.books, scaled(batch.column("embedding").drop_null(), width, parts), strict=True)]
            code[known] = [bytes(row).hex() for row in np.stack([e for e, _ in found], axis=1).astype(np.uint8)]
            error[known] = sum(d for _, d in found)
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error.tolist(), pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.select("vec_id", "label").schema}
    return map_batches(usable(vectors).withColumn("embedding", fits), kernel, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def code_digest(vectors: DataFrame) -> DataFrame:
    """``encode`` with the codebooks of ``train``, the error summed over each label (nulls together), and a hash of the
    codebooks. Codes are written to the shared folder once; labels' sums are joined, so that a label may have most rows."""
    codebooks = train(vectors)
    codes = checkpoint(encode(vectors, codebooks))
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(codebooks.sha256).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_digest(table(spark, sf_dir, "embeddings"))


def op12_sql() -> str:
    """The same codes in DuckDB, every distance computed."""
    far = "cast(list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS bigint)"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"near{k} AS MATERIALIZED (SELECT c.row, c.part, any_value(c.v) AS v, arg_min(b.entry, ({far}, b.entry)) AS entry, min({far}) AS far FROM part c JOIN book{k} b USING (part) GROUP BY c.row, c.part)")
        if k < ROUNDS:
            total, mean = f"(SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS pos FROM near{k}) GROUP BY ALL)", "cast((s - ((s % n) + n) % n) // n AS bigint)"
            steps.append(f"mean{k} AS (SELECT part, entry, list({mean} ORDER BY pos) AS v FROM {total} GROUP BY part, entry)")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: cast(floor(x::double * {SCALE}) AS bigint)) AS x
 FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT row, p AS part, x[p * (len(x) // {PARTS}) + 1:(p + 1) * (len(x) // {PARTS})] AS v FROM kept, range({PARTS}) t(p)),
book0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v FROM part WHERE row <= {ENTRIES}),
{", ".join(steps)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, cast(sum(far) AS bigint) AS error FROM near{ROUNDS} JOIN kept USING (row) GROUP BY row, vec_id, label)
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error,
 (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256 FROM coded"""
