"""Tables dealt out by a key when they are written, so that joins on it move the other side alone."""

from __future__ import annotations

import functools
import hashlib
import tempfile

from pyspark.sql import DataFrame, SparkSession

from pagelens.sources.jsonl import _file_system

#: Fewest buckets; there are as many as shuffle partitions where those are more.
LEAST = 8


def name_of(spark: SparkSession, kind: str, *paths: str) -> str:
    """A table's name that follows from the files under the paths: their places, sizes and times."""
    marks = []
    for path in paths:
        fs, at = _file_system(spark, path)
        found = fs.listStatus(at)
        marks += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in found]
    return f"pagelens_{kind}_{hashlib.sha256('|'.join(sorted(marks)).encode()).hexdigest()[:16]}"


def known(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="pagelens-tables-")


def folder(spark: SparkSession) -> str:
    """Where tables go: the shared folder of spark.checkpoint.dir, else a folder of this process on a local master, else the
    warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tables"
    return _own_folder() if spark.sparkContext.master.split("[")[0] == "local" else spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """The rows as table ``name``, in buckets by ``key`` and sorted by it within them.

    Files that an earlier session left under that name are removed first. Many small tasks would each write a file into each
    bucket, so rows are dealt out by the key before.
    """
    spark = df.sparkSession
    n, place = max(LEAST, int(spark.conf.get("spark.sql.shuffle.partitions"))), f"{folder(spark)}/{name}"
    if not known(spark, name):
        fs, at = _file_system(spark, place)
        fs.delete(at, True)
    df.repartition(n, key).write.mode("overwrite").bucketBy(n, key).sortBy(key).format("parquet").option("path", place).saveAsTable(name)
    return spark.table(name)
