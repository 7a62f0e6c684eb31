"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, queued again as often as ``max_repeats`` allows. A serving's
virtual finish time is the number of its source's tokens up to and including it, divided by the source's target. All
servings of all sources are sorted by that time, in ranges, and the sorted stream is cut where its running total comes
to the total budget. A document that is in service at virtual time 1 is served in two parts, up to then and after, so
that every source stands at its target when the budget is spent, however long its documents are.

Fair queueing spends the budget evenly over virtual time, so ranges of equal length hold about as many tokens each.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.llm.common import WORD, checkpoint, map_batches, partitions, set_aside, table, texts

WEIGHTS = (5, 2, 1)
SHARE_PERCENT, MAX_REPEATS = 150, 2
MINE = "_mix_"
KEY, RANGE, SIZE, TIE, ROW = (f"{MINE}{c}" for c in ("key", "range", "size", "tie", "row"))
#: Up to so many sources their cuts are sent to every executor; beyond, they are joined.
BROADCAST_SOURCES = 1 << 16
#: Documents of a range of a queue, and servings of a range of virtual time, at about which ranges are made narrower.
RANGE_ROWS = 1 << 16


def with_size(docs: DataFrame, name: str) -> DataFrame:
    """All columns and the number of words of the whole text (null: 0)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", {name} long"

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = pa.array([len(t.encode().split()) for t in texts(batch)], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns, sizes], [*batch.schema.names, name])

    return map_batches(docs, kernel, schema)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size), one per source.

    Weights go round the sources by code point, null last. Targets share ``share_percent`` of all sizes by
    weight; none is over ``max_repeats`` times its source, and what is over is shared out again by weight. That
    fixed point is target = least(cap, level * weight), and the sources at their cap are those with the lowest
    cap per weight, so one ordered pass finds the level. The table has a row per source only.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    done, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", w.cast("long"))
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("budget", F.sum("source_size").over(everything) * share_percent)
        .withColumn("left_over", F.col("budget") - 100 * F.coalesce(F.sum("cap").over(done), F.lit(0)))
        .withColumn("level", F.col("left_over").cast("double") / F.lit(100.0) / F.sum("weight").over(rest))
        # The first source whose cap is not reached sets the level for itself and all after it.
        .withColumn("open_level", F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level")))
        .withColumn("open_level", F.first("open_level", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("open_level") * F.col("weight"), F.col("cap").cast("double"))))
        .select("source", "source_size", "target")
    )


def keyed(docs: DataFrame, digits: int) -> DataFrame:
    """The documents with their place in the shuffled order; its first hexadecimal digits are its range.

    Rows without an id share one place; their texts deal them out over ranges of their own, which come after that of their
    place. So do only identical rows, and rows that repeat one id, stay together.
    """
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    within = F.when(F.col("doc_id").isNull(), F.concat(F.substring(KEY, 1, digits), F.lit("-"), F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, digits))).otherwise(F.substring(KEY, 1, digits))
    return docs.withColumn(KEY, place).withColumn(RANGE, within)


def range_digits(docs: DataFrame) -> int:
    """So many that a range of a source holds about RANGE_ROWS documents at most; 4,096 ranges at least."""
    return max(3, math.ceil(math.log(max(1, docs.count() / RANGE_ROWS), 16)))


def ranges(docs: DataFrame, weights, share_percent: int, max_repeats: int) -> DataFrame:
    """One row for each source and range of ``docs`` (source, _mix_range, _mix_size): words before it and in it, and what
    belongs to the source. The columns' names are those of the documents with _mix_r_ before them."""
    light = checkpoint(docs.groupBy("source", RANGE).agg(F.sum(SIZE).alias("inside")))
    targets = source_targets(light.groupBy("source").agg(F.sum("inside").alias("source_size")), weights, share_percent, max_repeats)
    before = Window.partitionBy("source").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    placed = light.withColumn("before", F.coalesce(F.sum("inside").over(before), F.lit(0)))
    both = placed.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    return both.select(F.col("r.source").alias(f"{MINE}r_source"), F.col(RANGE).alias(f"{MINE}r_range"), F.col("inside").alias(f"{MINE}inside"), F.col("before").alias(f"{MINE}before"), F.col("source_size").alias(f"{MINE}source_size"), F.col("target").alias(f"{MINE}target"))


def served(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Keyed and sized documents with _mix_upto, the tokens of their source up to and including them, from running sums
    within ranges, and with _mix_source_size and _mix_target."""
    inside = Window.partitionBy("source", RANGE).orderBy(KEY, "doc_id", SIZE, TIE).rowsBetween(Window.unboundedPreceding, 0)
    rows = docs.withColumn(f"{MINE}in", F.sum(SIZE).over(inside))
    rows = rows.join(places, rows["source"].eqNullSafe(places[f"{MINE}r_source"]) & (rows[RANGE] == places[f"{MINE}r_range"]))
    return rows.withColumn(f"{MINE}upto", F.col(f"{MINE}before") + F.col(f"{MINE}in")).drop(*[f"{MINE}{c}" for c in ("in", "before", "inside", "r_source", "r_range")])


def taken_alone(upto: Column, size: Column, source_size: Column, target: Column, max_repeats: int) -> Column:
    """What a document is served by virtual time 1, over all of its servings."""
    part = [F.greatest(F.lit(0), F.least(size, F.floor(target).cast("long") - turn * source_size - (upto - size))) for turn in range(max_repeats)]
    return sum(part[1:], part[0])


def servings(rows: DataFrame, max_repeats: int) -> DataFrame:
    """(_mix_row, source, begin, tokens, finish): every serving of every document that has words, in two parts where it
    is in service at virtual time 1."""
    size, source_size, target = F.col(SIZE), F.col(f"{MINE}source_size"), F.col(f"{MINE}target")
    whole, begin = F.floor(target).cast("long"), F.col("turn") * source_size + F.col(f"{MINE}upto") - size
    ends = F.when((begin < whole) & (whole < begin + size), F.array(whole, begin + size)).otherwise(F.array(begin + size))
    parts = rows.where((size > 0) & (target > 0)).select("*", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("turn")).select("*", begin.alias("begin"), F.posexplode(ends).alias("part", "end"))
    begin = F.when(F.col("part") == 1, whole).otherwise(F.col("begin"))
    return parts.select(ROW, "source", begin.alias("begin"), (F.col("end") - begin).alias("tokens"), (F.col("end") / target).alias("finish"))


def stream(rows: DataFrame, budget: int, max_repeats: int) -> DataFrame:
    """(_mix_row, begin, tokens, finish, place, taken): the servings that the budget reaches, in the order of ``place``.

    The global order is by finish time, then source, then place in its queue. Ranges of virtual time are summed first;
    only the servings of ranges that begin under the budget are numbered one by one, each range by itself.
    """
    parts = servings(rows, max_repeats)
    n = max(partitions(rows.sparkSession), rows.count() // RANGE_ROWS)
    # From time 2 on ranges grow with the time; no serving there is reached.
    at = F.when(F.col("finish") < 2, F.floor(F.col("finish") * n)).otherwise(n + F.floor(F.log2("finish") * n)).cast("long")
    parts = parts.withColumn("range", at)
    totals = parts.groupBy("range").agg(F.sum("tokens").alias("inside"))
    before = F.coalesce(F.sum("inside").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = checkpoint(totals.withColumn("before", before).where(F.col("before") < budget).select("range", "before"))
    own = Window.partitionBy("range").orderBy("finish", F.col("source").isNull(), "source", "begin").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.join(F.broadcast(reached) if reached.count() <= BROADCAST_SOURCES else reached, "range").withColumn("place", F.col("before") + F.sum("tokens").over(own) - F.col("tokens"))
    return placed.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("tokens"), F.lit(budget) - F.col("place")))).where("taken > 0").select(ROW, "begin", "tokens", "finish", "place", "taken")


def queue(docs: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, source, _mix_size, _mix_source_size, _mix_target, _mix_taken, _mix_finish, _mix_place), a row for every row.

    _mix_finish: the first serving's virtual finish time; _mix_place: the number of tokens before the document in the
    mixed stream (null: not in it). Order within a source: a hash of doc_id, then doc_id, size and a hash of the text,
    so that reruns agree; rows alike in all of these are interchangeable. Null and empty texts have size 0 and are
    not served, long ones are sized whole; null sources are one source, null doc_ids are queued like others. An empty
    table gives no rows. Columns other than doc_id, text and source are not looked at.
    """
    docs = docs.select("doc_id", "text", "source")
    rows = keyed(with_size(docs, SIZE), range_digits(docs)).withColumn(TIE, F.xxhash64("text")).drop("text")
    places = checkpoint(ranges(rows, weights, share_percent, max_repeats))
    sources = places.groupBy(f"{MINE}r_source").agg(F.max(F.floor(f"{MINE}target").cast("long")).alias("whole"))
    budget = sources.agg(F.sum("whole")).first()[0] or 0
    rows = checkpoint(served(rows, places).select("doc_id", "source", SIZE, f"{MINE}source_size", f"{MINE}target", f"{MINE}upto", F.monotonically_increasing_id().alias(ROW)))
    taken = stream(rows, budget, max_repeats).groupBy(ROW).agg(F.sum("taken").alias(f"{MINE}taken"), F.min("place").alias(f"{MINE}place"))
    finish = F.when(F.col(f"{MINE}target") > 0, F.col(f"{MINE}upto") / F.col(f"{MINE}target"))
    return rows.join(taken, ROW, "left").select("doc_id", "source", SIZE, f"{MINE}source_size", f"{MINE}target", F.coalesce(f"{MINE}taken", F.lit(0)).cast("long").alias(f"{MINE}taken"), finish.alias(f"{MINE}finish"), f"{MINE}place")


def mix(docs: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as ``queue`` takes it, in no order.

    A serving taken in part counts as whole from half on, else not; documents of size 0 are left out. The stream is cut
    at virtual time 1, so a document's copies follow from its queue alone: only one range of a source holds its cut,
    only the documents of that range are looked at one by one, and no other texts are shuffled. Where texts are wanted
    in the stream's order, sort them by ``queue``'s _mix_place. All columns are kept, whatever their names. Null texts have
    no words; a null source is a source of its own; rows without an id and repeated rows are documents like any other;
    an empty table gives no rows.
    """
    docs, names = set_aside(docs, MINE)
    digits = range_digits(docs)
    narrow = keyed(with_size(docs.select("doc_id", "text", "source"), SIZE), digits)
    places = checkpoint(ranges(narrow, weights, share_percent, max_repeats))
    size, whole = F.col(f"{MINE}source_size"), F.floor(f"{MINE}target").cast("long")
    rest = F.coalesce(F.try_mod(whole, size), F.lit(0))
    turns = F.coalesce(F.try_divide(whole - rest, size), F.lit(0)).cast("int")
    holds = (F.col(f"{MINE}before") < rest) & (rest <= F.col(f"{MINE}before") + F.col(f"{MINE}inside"))
    cuts = places.groupBy(F.col(f"{MINE}r_source").alias(f"{MINE}c_source")).agg(F.max(turns).alias(f"{MINE}turns"), F.max(F.when(holds, F.col(f"{MINE}r_range"))).alias(f"{MINE}cut"))
    cuts = checkpoint(cuts)
    few = cuts.count() <= BROADCAST_SOURCES
    rows = keyed(docs, digits).join(F.broadcast(cuts) if few else cuts, F.col("source").eqNullSafe(F.col(f"{MINE}c_source")))
    cut = F.coalesce(F.col(RANGE) == F.col(f"{MINE}cut"), F.lit(False))
    clear = rows.where(~cut & F.col("text").rlike(WORD)).withColumn(f"{MINE}copies", F.col(f"{MINE}turns") + F.coalesce(F.col(RANGE) < F.col(f"{MINE}cut"), F.lit(False)).cast("int"))
    close = served(with_size(rows.where(cut), SIZE).where(f"{SIZE} > 0").withColumn(TIE, F.xxhash64("text")), places)
    taken = taken_alone(F.col(f"{MINE}upto"), F.col(SIZE), F.col(f"{MINE}source_size"), F.col(f"{MINE}target"), max_repeats)
    close = close.withColumn(f"{MINE}copies", F.floor(taken / F.col(SIZE) + 0.5).cast("int"))
    columns = [*docs.columns, f"{MINE}copies"]
    both = clear.select(*columns).unionByName(close.select(*columns))
    return both.withColumn(f"{MINE}turn", F.explode(F.array_repeat(F.lit(0), F.col(f"{MINE}copies")))).select(*docs.columns).withColumnsRenamed(names)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    served = queue(table(spark, sf_dir, "documents"))
    return served.select("doc_id", *[F.col(f"{MINE}{c}").alias(c) for c in ("size", "source_size", "target", "taken", "finish", "place")])


def op8_sql(weights=WEIGHTS, share_percent: int = SHARE_PERCENT, max_repeats: int = MAX_REPEATS) -> str:
    """The same stream in DuckDB, sorted as a whole; only the arithmetic's order has to be that of source_targets."""
    return f"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS size, md5(coalesce(cast(doc_id AS varchar), '')) AS key FROM documents),
s AS (SELECT source, cast(sum(size) AS bigint) AS source_size FROM d GROUP BY source),
w AS (SELECT *, {list(weights)}[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(weights)} + 1] AS weight, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place, source_size * {max_repeats} AS cap, cast(sum(source_size) OVER () AS bigint) * {share_percent} AS budget FROM s),
c AS (SELECT *, budget - 100 * cast(coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS left_over, sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w),
l AS (SELECT *, cast(left_over AS double) / 100.0::double / cast(open_weight AS double) AS level FROM c),
t AS (SELECT *, (SELECT arg_min(level, (cap / weight, place)) FROM l WHERE level * weight < cap) AS open_level FROM l),
g AS (SELECT source, source_size, least(cast(cap AS double), coalesce(open_level * weight, cast(cap AS double))) AS target FROM t),
q AS (SELECT doc_id, d.source, size, source_size, target, cast(floor(target) AS bigint) AS whole, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size, text ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
v AS (SELECT *, turn * source_size + upto - size AS b, turn * source_size + upto AS e FROM q, range({max_repeats}) r(turn) WHERE size > 0),
p AS (SELECT doc_id, source, target, b, CASE WHEN b < whole AND whole < e THEN whole ELSE e END AS e FROM v UNION ALL SELECT doc_id, source, target, whole, e FROM v WHERE b < whole AND whole < e),
o AS (SELECT doc_id, e - b AS tokens, sum(e - b) OVER (ORDER BY cast(e AS double) / target, source IS NULL, source, b ROWS UNBOUNDED PRECEDING) - (e - b) AS place FROM p),
k AS (SELECT doc_id, sum(greatest(0, least(tokens, total - place))) AS taken, min(place) AS place FROM o, (SELECT sum(floor(target)) AS total FROM g) WHERE place < total GROUP BY doc_id)
SELECT q.doc_id, cast(size AS bigint) AS size, source_size, target, cast(coalesce(taken, 0) AS bigint) AS taken, CASE WHEN target > 0 THEN cast(upto AS double) / target END AS finish, cast(k.place AS bigint) AS place FROM q LEFT JOIN k USING (doc_id)"""
