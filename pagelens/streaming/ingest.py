"""Observations as they arrive: a file stream whose batches are recorded like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelens.operators import recording
from pagelens.sources import jsonl


def arrived(lines: DataFrame) -> DataFrame:
    """Rows of JSON lines (``value`` and the file source's ``_metadata``), with how they arrived: a file is a recording, known
    by its path, time and size, and lines are in the order of files by time, blocks and places in them."""
    meta = F.col("_metadata")
    named = F.concat_ws("|", meta["file_path"], meta["file_modification_time"].cast("string"), meta["file_size"].cast("string"))
    marked = lines.select("value", named.alias("recording"), meta["file_modification_time"].cast("string").alias("made_at"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"))
    return jsonl.parse_lines(marked, recording.RAW, *recording.ARRIVAL)


def start(spark: SparkSession, incoming: str, root: str, checkpoint: str, run: dict[str, str] | None = None) -> StreamingQuery:
    """Record JSON-line files as they come into ``incoming`` in the table at ``root``.

    The ledger makes it exactly once: a batch that is done again after a failure, and a file that comes again after the
    stream's own checkpoint was lost, change nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        recording.record(arrived(batch), root, {"run_id": f"batch-{number}"} | (run or {}), str(number))

    lines = spark.readStream.text(incoming).select("value", "_metadata")
    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
