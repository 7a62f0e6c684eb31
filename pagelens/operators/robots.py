"""robots.txt as tables: rules in file order, verdicts of bots, declared bots.

Two readings of a file: "rfc9309" (consecutive User-agent lines share their rules; the group whose name is the longest
that the bot's begins with is chosen by its name alone, * where there is none; its longest fitting pattern decides, * and
a final $ being special, and where none fits the bot is let in) and "file_order" (each User-agent line starts a group of
its own, and the first group in the file that matches and has a fitting rule decides; patterns are prefixes). In both
allow wins ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import patterns as P
from pagelens.functions.text import strip

MODES = ("rfc9309", "file_order")


def lines(files: DataFrame) -> DataFrame:
    """(site, pos, kind, value) of the lines "kind: value" of files (site, body), comments cut off."""
    split = files.select("site", F.posexplode(F.split("body", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")).alias("pos", "line"))
    cut = split.select("site", "pos", strip(F.substring_index("line", "#", 1)).alias("line")).where(F.col("line").contains(":"))
    at = F.instr("line", ":")
    return cut.select("site", "pos", F.lower(strip(F.left("line", at - 1))).alias("kind"), strip(F.substring(F.col("line"), at + 1, F.length("line"))).alias("value"))


def rules(files: DataFrame, mode: str = "rfc9309") -> DataFrame:
    """(site, ua, group_pos, kind, pattern): a row for each rule of each group, one with null kind for the group itself.

    Groups of the same name are one, placed where it is named first. Rules before any User-agent line belong to none.
    """
    here = Window.partitionBy("site").orderBy("pos")
    kept = lines(files).where(F.col("kind").isin("user-agent", "allow", "disallow"))
    named = F.col("kind") == "user-agent"
    if mode == "file_order":
        rows = kept.withColumn("ua", F.last(F.when(named, F.col("value")), ignorenulls=True).over(here))
    else:
        # A block of User-agent lines starts where the line before it is a rule; its names share what follows.
        starts = named & F.coalesce(F.lag("kind").over(here) != "user-agent", F.lit(True))
        rows = kept.withColumn("block", F.sum(starts.cast("int")).over(here)).where("block > 0")
        names = rows.where(named).select("site", "block", F.col("value").alias("ua"), F.col("pos").alias("ua_pos"))
        rows = rows.join(names, ["site", "block"]).withColumn("pos", F.when(named, F.col("ua_pos")).otherwise(F.col("pos"))).where(~named | (F.col("value") == F.col("ua"))).drop("block", "ua_pos")
    rows = rows.where("ua IS NOT NULL").withColumn("group_pos", F.min("pos").over(Window.partitionBy("site", "ua")))
    return rows.select("site", "ua", "group_pos", F.when(named, F.lit(None)).otherwise(F.col("kind")).alias("kind"), F.when(named, F.lit(None)).otherwise(F.col("value")).alias("pattern")).distinct()


def like(pattern: Column) -> Column:
    """A robots pattern in the language of LIKE: * is any run, a final $ the end, all else stands for itself."""
    plain = pattern
    for special in ("\\", "%", "_"):
        plain = F.replace(plain, F.lit(special), F.lit("\\" + special))
    plain = F.replace(plain, F.lit("*"), F.lit("%"))
    return F.when(plain.endswith("$"), F.left(plain, F.length(plain) - 1)).otherwise(F.concat(plain, F.lit("%")))


def verdicts(files: DataFrame, bots: DataFrame, path: str = "/", mode: str = "rfc9309") -> DataFrame:
    """(site, bot, verdict, matched_ua) for every file and bot: allow, deny or undeclared (with null).

    ``bots`` (bot) is a short fixed list and is sent to every executor.
    """
    best = _first_group(files, bots, path) if mode == "file_order" else _named_group(files, bots, path)
    everyone = files.select("site").distinct().join(F.broadcast(bots.select("bot")))
    return everyone.join(best, ["site", "bot"], "left").select("site", "bot", F.when(F.col("kind") == "disallow", "deny").otherwise(F.coalesce("kind", F.lit("undeclared"))).alias("verdict"), F.col("ua").alias("matched_ua"))


def _first_group(files: DataFrame, bots: DataFrame, path: str) -> DataFrame:
    found = rules(files, "file_order")
    fits = found.where(F.col("pattern") != "").where(F.lit(path).startswith(F.replace("pattern", F.lit("*"), F.lit(""))))
    decided = fits.groupBy("site", "ua", "group_pos").agg(F.max_by("kind", F.struct(F.length("pattern"), F.col("kind") == "allow")).alias("kind"))
    bot, ua = F.lower("bot"), F.lower("ua")
    pairs = decided.join(F.broadcast(bots), (F.col("ua") == "*") | bot.startswith(ua) | ua.startswith(bot))
    return pairs.groupBy("site", "bot").agg(F.min_by(F.struct("kind", "ua"), "group_pos").alias("best")).select("site", "bot", "best.kind", "best.ua")


def _named_group(files: DataFrame, bots: DataFrame, path: str) -> DataFrame:
    found = rules(files).where(F.col("ua") != "").withColumn("name", F.lower("ua"))
    fits = found.where(F.col("pattern") != "").withColumn("like", like(F.col("pattern"))).where(F.like(F.lit(path), F.col("like")))
    # One row for each name, however it is written; the rules that don't fit leave the group standing.
    decided = fits.groupBy("site", "name").agg(F.max_by("kind", F.struct(F.length("pattern"), F.col("kind") == "allow")).alias("kind"))
    groups = found.groupBy("site", "name").agg(F.min("ua").alias("ua")).join(decided, ["site", "name"], "left")
    pairs = groups.join(F.broadcast(bots), (F.col("name") == "*") | F.lower("bot").startswith(F.col("name")))
    best = F.max_by(F.struct("kind", "ua"), F.when(F.col("name") == "*", 0).otherwise(F.length("name"))).alias("best")
    return pairs.groupBy("site", "bot").agg(best).select("site", "bot", F.coalesce("best.kind", F.lit("allow")).alias("kind"), "best.ua")


def path_verdicts(files: DataFrame, bots: DataFrame, paths: DataFrame, mode: str = "rfc9309") -> DataFrame:
    """(site, path, bot, verdict, matched_ua) for every distinct path of ``paths`` (site, path) and every bot.

    Plain patterns are prefixes: a path is expanded into its prefixes of the lengths that its site's patterns have, which are
    joined with the patterns by equality. Patterns with * or $ are a rest set, an array for each site, tried on its paths
    row by row. A path of a site without a file is undeclared to all. ``bots`` (bot) is a short fixed list.
    """
    found = rules(files, mode).where("true" if mode == "file_order" else "ua <> ''").withColumn("name", F.col("ua") if mode == "file_order" else F.lower("ua"))
    groups = found.groupBy("site", "name").agg(F.min("ua").alias("ua"), F.min("group_pos").alias("group_pos"))
    bot = F.lower("bot")
    fits = (F.col("name") == "*") | bot.startswith(F.lower("name"))
    fits = fits | F.lower("name").startswith(bot) if mode == "file_order" else fits
    chosen = groups.join(F.broadcast(bots.select("bot")), fits)
    if mode != "file_order":
        # By its name alone, so there is one group for each site and bot.
        chosen = chosen.groupBy("site", "bot").agg(F.max_by(F.struct("name", "ua", "group_pos"), F.when(F.col("name") == "*", 0).otherwise(F.length("name"))).alias("g")).select("site", "bot", "g.*")

    pattern = F.col("pattern")
    listed = found.where("pattern <> ''").select("site", "name", "kind", F.length(pattern).alias("weight"), *([F.replace(pattern, F.lit("*"), F.lit("")).alias("prefix"), F.lit(None).cast("string").alias("like")] if mode == "file_order" else [F.when(~pattern.contains("*") & ~pattern.endswith("$"), pattern).alias("prefix"), like(pattern).alias("like")])).distinct()
    plain, rest = listed.where("prefix IS NOT NULL"), listed.where("prefix IS NULL")
    asked = paths.select("site", "path").distinct()
    lengths = plain.groupBy("site").agg(F.collect_set(F.length("prefix")).alias("lengths"))  # at most one for each length
    tried = asked.join(lengths, "site").select("site", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")).select("site", "path", F.left("path", F.col("n")).alias("prefix"))
    hits = tried.join(plain.drop("like"), ["site", "prefix"]).select("site", "path", "name", "kind", "weight")
    if mode != "file_order":
        others = rest.groupBy("site").agg(F.collect_list(F.struct("name", "kind", "weight", "like")).alias("rest"))  # one file's patterns
        starred = asked.join(others, "site").select("site", "path", F.explode(F.filter("rest", lambda r: F.like(F.col("path"), r["like"]))).alias("r"))
        hits = hits.unionByName(starred.select("site", "path", "r.name", "r.kind", "r.weight"))
    decided = hits.groupBy("site", "path", "name").agg(F.max_by("kind", F.struct("weight", F.col("kind") == "allow")).alias("kind"))
    if mode == "file_order":
        best = decided.join(chosen, ["site", "name"]).groupBy("site", "path", "bot").agg(F.min_by(F.struct("kind", "ua"), "group_pos").alias("b")).select("site", "path", "bot", "b.*")
    else:
        best = asked.join(chosen, "site").join(decided, ["site", "path", "name"], "left").select("site", "path", "bot", F.coalesce("kind", F.lit("allow")).alias("kind"), "ua")
    everyone = asked.join(F.broadcast(bots.select("bot")))
    return everyone.join(best, ["site", "path", "bot"], "left").select("site", "path", "bot", F.when(F.col("kind") == "disallow", "deny").otherwise(F.coalesce("kind", F.lit("undeclared"))).alias("verdict"), F.col("ua").alias("matched_ua"))


def declared(files: DataFrame, bots: DataFrame, mode: str = "rfc9309") -> DataFrame:
    """(site, n_declared): how many bots some group names by their first six characters."""
    groups = rules(files, mode).select("site", "ua").distinct()
    hits = groups.join(F.broadcast(bots), F.lower("ua").startswith(F.lower(F.left("bot", F.lit(6)))))
    counts = hits.groupBy("site").agg(F.count_distinct("bot").alias("n"))
    return files.select("site").distinct().join(counts, "site", "left").select("site", F.coalesce("n", F.lit(0)).cast("long").alias("n_declared"))


BOTS = tuple((b, "citation") for b in P.CITATION_BOTS) + tuple((b, "training") for b in P.TRAINING_BOTS)
