"""Recordings of observations into a versioned table, each once, with signals that follow the batch.

A version holds the observations, a ledger of the recordings, the last two points of each series, and the signals. The last
two are dealt into BUCKETS by series. A batch reads and writes the buckets that it has points for and nothing else of what is
older: its work follows its own size (and at most one row pair for each series), not the history. All parts come with one
commit, so a batch that is done again, or half done, changes nothing.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.operators import history
from pagelens.sources import snapshots

RAW = "ts string, identity string, kind string, series string, value double, unit string, n int, source string, note string"
#: How a row arrived: the recording it belongs to, when that was made, and its place there (a block, and a number within it).
ARRIVAL = ("recording", "made_at", "block", "row")
LEDGER = "recording string, run_id string, ts string"
RUN = "run_id string, ts string, source string, series string, note string, recorded long, skipped long"
#: Buckets of a new table; it keeps the number it began with.
BUCKETS = 64


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64(*history.KEYS), F.lit(n)).cast("int").alias("bucket")


def in_order(rows: DataFrame, first: int) -> DataFrame:
    """The rows with ``seq`` from ``first`` on, in the order of arrival: recordings by the time they were made (ties: by
    name), then as they stand there. Numbers rise and need not be dense.

    Only one row for each block of a file is ordered at once; where a block's numbers begin goes back to its rows.
    """
    blocks = rows.groupBy("made_at", "recording", "block").agg(F.min("row").alias("least"), (F.max("row") - F.min("row") + 1).alias("size"))
    before = Window.orderBy("made_at", "recording", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("recording", "block", "least", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, ["recording", "block"]).withColumn("seq", F.lit(first) + F.col("start") + F.col("row") - F.col("least")).drop("least", "start")


def _of(version: dict[str, Any], part: str, buckets: list[int]) -> list[str]:
    held = version.get(part, {})
    return [held[str(b)] for b in buckets if str(b) in held]


def observations(spark: SparkSession, root: str, version: dict[str, Any] | None = None) -> DataFrame:
    return snapshots.read(spark, root, (version or snapshots.current(spark, root)).get("data", []), history.OBSERVATION)


def signals(spark: SparkSession, root: str, version: dict[str, Any] | None = None) -> DataFrame:
    return snapshots.read(spark, root, sorted((version or snapshots.current(spark, root)).get("signals", {}).values()), history.SIGNAL)


def runs(spark: SparkSession, root: str) -> DataFrame:
    return snapshots.read(spark, root, snapshots.current(spark, root).get("runs", []), RUN)


def record(rows: DataFrame, root: str, run: dict[str, str], as_of: str, buckets: int = BUCKETS) -> dict[str, int]:
    """Take in rows (RAW and ARRIVAL) but for those of recordings that are in the ledger: {recorded, skipped, repeated}.

    ``repeated`` is the number of recordings that were known. Signals of the series that have new points are recomputed
    from their last two points; what is still there keeps its first_seen, what is gone is resolved at ``as_of``.
    """
    spark = rows.sparkSession
    version = {"buckets": buckets} | snapshots.current(spark, root)
    ledger = snapshots.read(spark, root, version.get("ledger", []), LEDGER)
    asked = rows.select("recording").distinct()
    new = asked.join(ledger, "recording", "left_anti")
    n_asked, n_new = asked.count(), new.count()
    if not n_new:
        return {"recorded": 0, "skipped": 0, "repeated": n_asked}
    known = ledger.join(asked, "recording", "left_semi").select("recording")
    fresh = in_order(rows.join(known, "recording", "left_anti"), version.get("seq", 0))
    kept, _ = history.ingest(fresh, run)
    data = snapshots.write(kept, root)
    batch = snapshots.read(spark, root, [data], history.OBSERVATION)
    facts = batch.agg(F.count("*").alias("n"), F.max("seq").alias("last")).first()
    total = fresh.count()
    row = spark.createDataFrame([(*(run.get(k, "") for k in ("run_id", "ts", "source", "series", "note")), facts["n"], total - facts["n"])], RUN)
    parts = {
        "data": [*version.get("data", []), data], "runs": [*version.get("runs", []), snapshots.write(row.coalesce(1), root)],
        "ledger": [*version.get("ledger", []), snapshots.write(new.select("recording", F.lit(run.get("run_id", "")).alias("run_id"), F.lit(as_of).alias("ts")).coalesce(1), root)],
    }
    if facts["n"]:
        parts |= _followed(spark, root, version, batch, as_of) | {"seq": facts["last"] + 1}
    snapshots.commit(spark, root, version, **parts)
    return {"recorded": facts["n"], "skipped": total - facts["n"], "repeated": n_asked - n_new}


def _followed(spark: SparkSession, root: str, version: dict[str, Any], batch: DataFrame, as_of: str) -> dict[str, Any]:
    """State and signals after a batch, in the buckets that it has points for."""
    bucket = _bucket(version["buckets"])
    touched = sorted(r["bucket"] for r in batch.select(bucket).distinct().collect())  # at most that many
    points = snapshots.read(spark, root, _of(version, "state", touched), history.OBSERVATION).unionByName(batch)
    state = snapshots.write(history.last_points(points, 2).drop("place").withColumn("bucket", bucket).repartition("bucket"), root, "bucket")
    series = batch.select(*history.KEYS).distinct()
    last = snapshots.read(spark, root, [f"{state}/bucket={b}" for b in touched], history.OBSERVATION).join(series, list(history.KEYS), "left_semi")
    old = snapshots.read(spark, root, _of(version, "signals", touched), history.SIGNAL)
    made = history.recomputed(last, old.join(series, list(history.KEYS), "left_semi"), F.lit(as_of))
    made = made.unionByName(old.join(series, list(history.KEYS), "left_anti").select(*made.columns)).withColumn("bucket", bucket)
    found = snapshots.write(made.repartition("bucket"), root, "bucket")
    written = {r["bucket"] for r in made.select("bucket").distinct().collect()}
    signals = {b: f for b, f in version.get("signals", {}).items() if int(b) not in touched}
    return {"state": version.get("state", {}) | {str(b): f"{state}/bucket={b}" for b in touched}, "signals": signals | {str(b): f"{found}/bucket={b}" for b in written}}


def compact(spark: SparkSession, root: str) -> None:
    """Merge the folders of observations, ledger and runs into one each, since a version names a folder for each batch."""
    version = snapshots.current(spark, root)
    kinds = {"data": history.OBSERVATION, "ledger": LEDGER, "runs": RUN}
    merged = {k: [snapshots.write(snapshots.read(spark, root, version[k], schema), root)] for k, schema in kinds.items() if len(version.get(k, [])) > 1}
    if merged:
        snapshots.commit(spark, root, version, **merged)
