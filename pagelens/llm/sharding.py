"""Sharding by extendible hashing, with DataFrame operations only.

A directory indexed by the first bits of each row's hash starts with one bucket; a bucket over the byte limit
is split on its next bit, the others stay, until every one fits. A shard is thus the shortest prefix that
fits. Rows are summed once by a prefix a few bits longer than the mean shard needs, and those sums, not the rows, are
split level by level. Only rows of prefixes that are still too large, as repeated ids make them, are looked at
further, as pairs of hash and size. The finished directory is joined to the texts at the end, once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.llm.common import checkpoint, set_aside, table

LIMIT_BYTES = 64 << 20
#: The limit of the query: small, so that tables of any size split over several depths.
QUERY_LIMIT = 128 << 10
#: Bits of the id's hash, and of all: then come those of the text's. Bits of the first directory beyond the mean
#: shard's, and of each further step.
ID_BITS, ALL_BITS, SPARE, STEP = 32, 64, 3, 16
#: Directories of up to so many entries are sent to every executor; beyond, they are joined.
BROADCAST_ROWS = 1 << 16
#: Identical rows that overflow a shard are numbered in parts of about this many.
PART_ROWS = 1 << 16
MINE = "_shard_"
BITS, BYTES, CELL, ROW, PART = (f"{MINE}{c}" for c in ("bits", "bytes", "cell", "row", "part"))


def _hash_bits(text: Column) -> Column:
    """32 bits as text, of an MD5 (null: of the empty string)."""
    return F.lpad(F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 8), 16, 2), ID_BITS, "0")


def hash_bits() -> Column:
    return _hash_bits(F.col("doc_id").cast("string"))


def all_bits() -> Column:
    """The bits of doc_id and then those of the text, so that rows of one id with different texts part too."""
    return F.concat(hash_bits(), _hash_bits(F.col("text")))


def directory(cells: DataFrame, limit: int, start: int, depth: int) -> DataFrame:
    """(cell, shard, shard_depth, shard_bytes) for cells (cell, bytes) of ``depth`` bits, split from ``start`` bits on.

    A cell that is over the limit by itself has a null shard.
    """
    levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("depth")).withColumn("prefix", F.expr("substring(cell, 1, depth)"))
    sums = checkpoint(levels.groupBy("prefix", "depth").agg(F.sum("bytes").alias("bytes")))
    full = sums.where(F.col("bytes") > limit).select(F.col("prefix").alias("up"), (F.col("depth") + 1).alias("depth"))
    fits = sums.where(F.col("bytes") <= limit).withColumn("up", F.expr("substring(prefix, 1, greatest(depth - 1, 0))"))
    leaves = fits.where(F.col("depth") == start).drop("up").unionByName(fits.where(F.col("depth") > start).join(full, ["up", "depth"], "left_semi").drop("up"))
    leaves = leaves.select(F.col("prefix"), F.col("depth").alias("shard_depth"), F.col("bytes").alias("shard_bytes"))
    found = levels.select("cell", "prefix").join(leaves, "prefix").select("cell", F.col("prefix").alias("shard"), "shard_depth", "shard_bytes")
    return cells.select("cell").join(found, "cell", "left")


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def deeper(rows: DataFrame, limit: int, depth: int) -> DataFrame:
    """(bits, n, largest, shard, shard_depth, shard_bytes) of all hashes among ``rows`` (bits, bytes, n, largest) of open
    cells of ``depth`` bits; a hash that is over the limit by itself has a null shard."""
    out, open_rows = None, rows
    while True:
        start, depth = depth + 1, min(depth + STEP, ALL_BITS)
        cell = F.substring("bits", 1, depth)
        cells = checkpoint(open_rows.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes")))
        placed = checkpoint(open_rows.join(_small(checkpoint(directory(cells, limit, start, depth))), cell == F.col("cell")).drop("cell"))
        done = placed if depth == ALL_BITS else placed.where("shard IS NOT NULL")
        out = done if out is None else out.unionByName(done)
        open_rows = placed.where("shard IS NULL").select(*rows.columns)
        if depth == ALL_BITS or open_rows.isEmpty():
            return checkpoint(out)


def assign(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """The rows of ``docs`` with shard (prefix bits; "root" if one shard holds all), shard_depth and shard_bytes.

    The hash is of doc_id, a null one as empty, then of the text. Identical rows that are over the limit together are
    dealt to overflow pages ("prefix.part.page"), which of them to which page is left open; only a single text over the
    limit makes a page that is over it. Null and empty texts weigh 0 bytes; a text of any length is one row of its
    shard. An empty table gives no rows. Columns named shard, shard_depth and shard_bytes are replaced, others kept.
    """
    docs, names = set_aside(docs.drop("shard", "shard_depth", "shard_bytes"), MINE)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    total = docs.agg(F.sum(size)).first()[0] or 0
    depth = min(ID_BITS, max(0, math.ceil(math.log2(max(1, total) / limit)) + SPARE))
    cells = checkpoint(docs.select(F.substring(hash_bits(), 1, depth).alias("cell"), size.alias("bytes")).groupBy("cell").agg(F.sum("bytes").alias("bytes")))
    book = checkpoint(directory(cells, limit, 0, depth).withColumnRenamed("cell", CELL))
    placed = docs.withColumn(ROW, F.monotonically_increasing_id()).withColumn(CELL, F.substring(hash_bits(), 1, depth)).join(_small(book), CELL)
    out = placed.where("shard IS NOT NULL").drop(CELL, ROW)
    if not book.where("shard IS NULL").isEmpty():
        open_rows = placed.where("shard IS NULL").withColumn(BITS, all_bits()).withColumn(BYTES, size).drop(CELL, "shard", "shard_depth", "shard_bytes")
        sums = checkpoint(open_rows.groupBy(F.col(BITS).alias("bits")).agg(F.sum(BYTES).alias("bytes"), F.count("*").alias("n"), F.max(BYTES).alias("largest")))
        deep = deeper(sums, limit, depth).select(F.col("bits").alias(BITS), F.col("n").alias(f"{MINE}n"), F.col("largest").alias(f"{MINE}largest"), "shard", "shard_depth", "shard_bytes")
        found = open_rows.join(_small(deep), BITS)
        out = out.unionByName(found.where("shard IS NOT NULL").select(*out.columns))
        if not deep.where("shard IS NULL").isEmpty():
            out = out.unionByName(pages(found.where("shard IS NULL"), limit).select(*out.columns))
    return out.withColumn("shard", F.when(F.col("shard") == "", "root").otherwise(F.col("shard"))).withColumnsRenamed(names)


def pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages for rows that all their bits can't part: full ones in parts of about PART_ROWS rows, so that a row
    that very many share is no single task."""
    parts, per = F.ceil(F.col(f"{MINE}n") / F.lit(PART_ROWS)), F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col(f"{MINE}largest")))
    rows = rows.withColumn(PART, F.pmod(F.xxhash64(ROW), parts))
    number = F.row_number().over(Window.partitionBy(BITS, PART).orderBy(ROW)) - 1
    named = rows.withColumn("shard", F.concat_ws(".", BITS, PART, F.floor(number / per))).withColumn("shard_depth", F.lit(ALL_BITS))
    return named.withColumn("shard_bytes", F.sum(BYTES).over(Window.partitionBy("shard")))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """One folder of Parquet files for each shard, with all rows of ``docs`` as ``assign`` deals them; none for an empty table."""
    assign(docs, limit).repartition("shard").write.partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str, limit: int = QUERY_LIMIT) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign(docs, limit).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), "shard", "shard_depth", "shard_bytes")


def op3_sql(limit: int = QUERY_LIMIT) -> str:
    """The same split, level by level over all bits; of overflow pages only those of single texts over the limit."""
    bits = lambda text: f"lpad(to_base(('0x' || md5(coalesce({text}, ''))[1:8])::ubigint::bigint, 2), 32, '0')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS bytes, {bits("cast(doc_id AS varchar)")} || {bits("text")} AS bits FROM documents),
levels AS (SELECT cast(unnest(generate_series(0, {ALL_BITS})) AS integer) AS depth),
sums AS (SELECT depth, bits[1:depth] AS prefix, sum(bytes) AS total, count(*) AS n FROM d, levels GROUP BY ALL),
leaves AS (SELECT s.* FROM sums s LEFT JOIN sums up ON up.depth = s.depth - 1 AND up.prefix = s.prefix[1:s.depth - 1] WHERE (s.total <= {limit} OR s.depth = {ALL_BITS} AND s.n = 1) AND (s.depth = 0 OR up.total > {limit}))
SELECT doc_id, cast(bytes AS bigint) AS bytes, CASE WHEN depth = 0 THEN 'root' WHEN total > {limit} THEN prefix || '.0.0' ELSE prefix END AS shard, depth AS shard_depth, cast(total AS bigint) AS shard_bytes
FROM d JOIN leaves ON bits[1:depth] = prefix"""
