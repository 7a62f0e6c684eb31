"""Observations over time: series, changes between the last two points, and signals with a life cycle.

Observations have ts, run_id, identity, kind, series, value, unit, n, source and note, and ``seq``, their place of
arrival, which breaks ties of time. Series of different identities are never mixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import patterns as P

KEYS = ("identity", "kind", "series")
#: How both tables are stored.
OBSERVATION = "ts string, run_id string, identity string, kind string, series string, value double, unit string, n int, source string, note string, seq long"
SIGNAL = "dedup_key string, identity string, kind string, series string, previous_value double, previous_ts string, current_value double, current_ts string, change_value double, change_ratio double, direction string, severity string, n int, source string, detected_at string, resolved_at string, first_seen string"


def classify_sql(prev: str, cur: str, n: str, half_even: str = "bround", what: str = "severity") -> str:
    """SQL for one part (direction, severity, change or ratio) of a change; thresholds compare rounded values."""
    p, c, k = f"try_cast({prev} AS double)", f"try_cast({cur} AS double)", f"try_cast({n} AS int)"
    change = f"{half_even}({c} - {p}, 6)"
    ratio = f"{half_even}({change} / nullif(abs({p}), 0), 4)"
    big = f"(abs({change}) >= {P.ABSOLUTE} AND ({p} = 0 OR abs({ratio}) >= {P.RELATIVE}))"
    none = f"{p} IS NULL OR {c} IS NULL"
    return {
        "change": change,
        "ratio": ratio,
        "direction": f"CASE WHEN {none} THEN 'unknown' WHEN {change} = 0 THEN 'flat' WHEN {change} > 0 THEN 'up' ELSE 'down' END",
        "severity": f"CASE WHEN {none} THEN 'uncomparable' WHEN {k} IS NULL OR {k} < {P.MIN_N} THEN 'low_n' WHEN {change} = 0 THEN 'flat' WHEN {change} > 0 THEN CASE WHEN {big} THEN 'rise' ELSE 'rise_small' END ELSE CASE WHEN {big} THEN 'sharp_drop' ELSE 'drop_small' END END",
    }[what]


PARTS = ("direction", "severity", "change", "ratio")
#: Parts in which the last points of a series are looked for, so that a very long one is no single task.
PARTS_OF_SERIES = 16


def parsed_ts(ts: Column) -> Column:
    return F.try_to_timestamp(ts)


def _order() -> tuple[Column, ...]:
    """By time as it reads, then as it is written, then by arrival; times that don't read come before all others."""
    return (parsed_ts(F.col("ts")), F.col("ts"), F.col("seq"))


def _latest_first() -> list[Column]:
    return [c.desc_nulls_last() for c in _order()]


def numbered(rows: DataFrame, first: int = 0) -> DataFrame:
    """The rows with ``seq`` from ``first`` on, in the order in which they come.

    Only the sizes of the partitions are gathered.
    """
    rows = rows.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, upto = {}, first
    for part, n in sizes:
        starts[part], upto = upto, upto + n
    start = F.element_at(F.create_map(*[F.lit(v).cast("long") for pair in (starts or {-1: 0}).items() for v in pair]), F.col("part").cast("long"))
    return rows.withColumn("seq", start + F.expr("row & 8589934591")).drop("part", "row")


def ingest(rows: DataFrame, run: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(observations, run row) of one recording: defaults filled in; rows without identity, kind or value are counted. A
    column ``seq`` is kept."""
    text = lambda name, default: F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))
    whole = (F.coalesce("identity", F.lit("")) != "") & (F.coalesce("kind", F.lit("")) != "") & F.col("value").isNotNull()
    kept = rows.where(whole).select(
        text("ts", run.get("ts", "")).alias("ts"), F.lit(run.get("run_id", "")).alias("run_id"), "identity", "kind", text("series", run.get("series") or "default").alias("series"), "value",
        text("unit", "ratio").alias("unit"), "n", text("source", run.get("source") or "").alias("source"), text("note", "").alias("note"),
        *(["seq"] if "seq" in rows.columns else []),
    )
    counts = rows.agg(F.count_if(whole).alias("recorded"), F.count_if(~whole).alias("skipped"))
    row = counts.select(*[F.lit(run.get(k, "")).alias(k) for k in ("run_id", "ts", "source", "series", "note")], "recorded", "skipped")
    return kept, row


def selected(observations: DataFrame, identity: str = "", kind: str = "", series: str = "") -> DataFrame:
    """Rows of the given identity, kind and series; an empty one doesn't filter."""
    for name, value in (("identity", identity), ("kind", kind), ("series", series)):
        if value:
            observations = observations.where(F.col(name) == value)
    return observations


def history(observations: DataFrame) -> DataFrame:
    """One row for each series: points, first and last time, latest value and n, low_n, sorted sources."""
    at = F.struct(*_order())
    latest = lambda c: F.max_by(c, at)
    out = observations.groupBy(*KEYS).agg(F.count("*").alias("points"), F.min_by("ts", at).alias("first_ts"), latest("ts").alias("last_ts"), latest("value").alias("latest_value"), latest("n").alias("latest_n"), F.array_join(F.array_sort(F.collect_set(F.nullif("source", F.lit("")))), ",").alias("sources"))
    return out.withColumn("low_n", F.coalesce(F.expr("try_cast(latest_n AS int)"), F.lit(0)) < P.MIN_N)


def last_points(observations: DataFrame, most: int) -> DataFrame:
    """The latest points of each series, with ``place`` from 1 for the latest.

    Ranked in parts of each series first, dealt by a hash, and then among what the parts have left, at most ``most`` points
    each, so that a very long series is no single task.
    """
    most = max(1, most)
    part = Window.partitionBy(*KEYS, "_part").orderBy(*_latest_first())
    parted = observations.withColumn("_part", F.pmod(F.xxhash64("ts", "seq"), F.lit(PARTS_OF_SERIES)))
    left = parted.withColumn("_place", F.row_number().over(part)).where(F.col("_place") <= most).drop("_place", "_part")
    order = Window.partitionBy(*KEYS).orderBy(*_latest_first())
    return left.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def changes(observations: DataFrame) -> DataFrame:
    """The last two points of each series and what changed; series of one point are not comparable.

    They are looked for in parts of each series first, which are dealt by a hash, so that a very long one is no single
    task, and then among the at most two points that each part has left.
    """
    point = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(_order())], F.col("value"), F.col("n"), F.col("source"))
    two = F.slice(F.sort_array(F.collect_list("p"), asc=False), 1, 2)
    parted = observations.select(*KEYS, point.alias("p"), F.pmod(F.xxhash64("ts", "seq"), F.lit(PARTS_OF_SERIES)).alias("part"))
    own = Window.partitionBy(*KEYS, "part").orderBy(F.col("p").desc())
    last = parted.withColumn("back", F.row_number().over(own)).where("back <= 2").groupBy(*KEYS).agg(two.alias("last"))
    rows = last.select(*KEYS, (F.size("last") > 1).alias("comparable"), F.get("last", 1)["value"].alias("previous_value"), F.get("last", 1)["o1"].alias("previous_ts"), F.get("last", 0)["value"].alias("current_value"), F.get("last", 0)["o1"].alias("current_ts"), F.get("last", 0)["n"].alias("n"), F.get("last", 0)["source"].alias("source"))
    parts = [F.when(F.col("comparable"), F.expr(classify_sql("previous_value", "current_value", "n", what=p))).alias(p) for p in PARTS]
    return rows.select("*", *parts)


def dedup_key() -> Column:
    return F.concat_ws("|", *KEYS)


def fresh_signals(observations: DataFrame, as_of: Column) -> DataFrame:
    """Signals of all series whose last two points differ, or are too few samples or not comparable."""
    moved = changes(observations).where("comparable AND NOT (direction = 'flat' AND severity = 'flat')")
    return moved.select(dedup_key().alias("dedup_key"), *KEYS, "previous_value", "previous_ts", "current_value", "current_ts", F.col("change").alias("change_value"), F.col("ratio").alias("change_ratio"), "direction", "severity", "n", "source", as_of.alias("detected_at"))


def recomputed(observations: DataFrame, old: DataFrame | None, as_of: Column, resolve: bool = True) -> DataFrame:
    """The signal table after new observations.

    A signal that is still there keeps first_seen; resolved ones stay. An open one that is no longer there is
    resolved at ``as_of``, or dropped where ``resolve`` is False.
    """
    new = fresh_signals(observations, as_of)
    if old is None:
        return new.withColumn("resolved_at", F.lit(None).cast("string")).withColumn("first_seen", F.col("detected_at"))
    before = old.where("resolved_at IS NULL").select("dedup_key", F.coalesce("first_seen", "detected_at").alias("seen")).groupBy("dedup_key").agg(F.min("seen").alias("seen"))
    out = new.join(before, "dedup_key", "left").withColumn("resolved_at", F.lit(None).cast("string")).withColumn("first_seen", F.coalesce("seen", "detected_at")).drop("seen")
    out = out.unionByName(old.where("resolved_at IS NOT NULL").select(*out.columns))
    if resolve:
        gone = old.where("resolved_at IS NULL").join(new.select("dedup_key"), "dedup_key", "left_anti")
        out = out.unionByName(gone.withColumn("resolved_at", as_of).select(*out.columns))
    return out


def listed(signals: DataFrame, status: str = "open", most: int = 50) -> DataFrame:
    """The last signals of a status (open, resolved, anything else: all), by first_seen, resolved ones after open ones."""
    kept = {"open": signals.where("resolved_at IS NULL"), "resolved": signals.where("resolved_at IS NOT NULL")}.get(status, signals)
    return kept.orderBy(F.col("resolved_at").isNotNull().desc(), F.desc("first_seen"), F.desc("dedup_key")).limit(max(1, most))
