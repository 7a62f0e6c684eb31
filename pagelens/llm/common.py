"""What the operators of this subpackage share: input tables, Arrow kernels, checkpoints, components."""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch handed to Python, so that a worker's memory has a bound.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session and give checkpoints a folder where none is set.

    This holds for the whole session: its Arrow batches stay small for other Python functions too, and on a local master
    its workers' PYTHONPATH gets this package's folder.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    root = str(Path(__file__).parents[2])
    if context.master.startswith("local") and root not in context.environment.get("PYTHONPATH", ""):
        # Python workers find the package wherever the session was started; a cluster gets it with --py-files.
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, context.environment.get("PYTHONPATH")]))
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="pagelens-checkpoint-")
        context.setCheckpointDir(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Makes Spark delete the shuffle files of a query when it ends. Else they stay until the driver's JVM collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder, which outlive any executor. The shuffle files behind them go at
    once, so that the disk holds those of one step and not of all before it."""
    spark = df.sparkSession
    prepare(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan is bound to the setting when it is made
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as Parquet in the shared folder, read again, and where they are; ``discard`` them when they are done with."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a kernel that takes one batch and returns one (None: no rows)."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := kernel(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, keep: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """The rows for which ``keep`` answers True, all columns as they were, without a shuffle."""
    return map_batches(df, lambda batch: batch.filter(pa.array(keep(batch), pa.bool_())), df.schema)


def set_aside(docs: DataFrame, prefix: str) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns that begin with ``prefix``, which an operator needs for its own, under other names, and the
    names to give back: {other: own}."""
    taken, back = {c.lower() for c in docs.columns}, {}
    for name in (c for c in docs.columns if c.lower().startswith(prefix)):
        other = next(f"_aside_{k}" for k in itertools.count() if f"_aside_{k}" not in taken)
        taken.add(other)
        back[other] = name
    return docs.withColumnsRenamed({own: other for other, own in back.items()}), back


def texts(batch: pa.RecordBatch) -> list[str]:
    """Column text, null as empty."""
    return [t or "" for t in batch.column("text").to_pylist()]


def sampled_ids(rows: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """doc_id of at most ``most`` distinct ids, those with the smallest hashes, null never.

    Of many rows only every m-th hash is looked at, about four times as many as are wanted, so that the sort stays
    small whatever the table.
    """
    key = F.xxhash64("doc_id", F.lit(seed))
    ids = rows.where("doc_id IS NOT NULL").select("doc_id")
    m = max(1, ids.count() // (4 * most))
    return ids.where(F.pmod(key, F.lit(m)) == 0).distinct().orderBy(key, "doc_id").limit(most)


def one_text(rows: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text and ``keep`` (alike in all rows of an id) with one row for each doc_id, the text with the smallest hash, so
    that a sample of ids bounds the rows however often ids are repeated."""
    return rows.groupBy("doc_id", *keep).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that have all keys alike, from batches in which such rows are neighbours."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for low, high in itertools.pairwise(cuts):
            key = tuple(cols[:, low])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        yield pa.Table.from_batches(held)


#: Minima of stars are sent to every executor up to this many edges; beyond, edges are shuffled to them, and the
#: engine's handling of skewed joins splits very large stars.
BROADCAST_EDGES = 1 << 19


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al., "Connected components in MapReduce and
    beyond". Minima are partially aggregated and stars are joined, never gathered, so a centre with very
    many neighbours is no single task. Each round is checkpointed. No edges: no rows.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    stars = checkpoint(edges.where("a <> b").select(most.alias("a"), least.alias("b")).distinct())
    before, n = None, stars.count()
    for _ in range(max_rounds):
        sent = F.broadcast if n <= BROADCAST_EDGES else lambda df: df
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(sent(low), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(sent(low), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        stars = checkpoint(small)
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.col("m").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
