"""End to end: from pages (and fetches) to check results, and from those to a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import urls
from pagelens.operators import checks, score, signals, site


def page_checks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Results of the checks that need the page alone."""
    return checks.results(signals.page_signals(pages, key), checks.PAGE, key)


def site_checks(pages: DataFrame, fetches: DataFrame, key: str = "page_id", **options) -> DataFrame:
    return checks.results(site.site_signals(pages, fetches, key, **options), checks.SITE, key)


def full_checks(pages: DataFrame, fetches: DataFrame, key: str = "page_id", **options) -> DataFrame:
    """All checks of pages (key, url); the html is the body of the page's own fetch."""
    own = site.contents(pages, fetches, F.col("body").alias("html"), site.header(F.col("headers"), "x-robots-tag").alias("robots_header"))
    with_html = pages.select(key, "url").join(own.drop("status"), "url", "left")
    page = checks.results(signals.page_signals(with_html, key, F.col("robots_header")), checks.PAGE, key)
    other = site_checks(pages, fetches, key, **options)
    return page.unionByName(other)


def report(results: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, score, grade, layers, fixes, text): one row for each page, made of an array of its results (one for each check).

    Layers go by name; a layer, like a page, without weighty checks has no score. Pages without any have no row.
    """
    one = F.struct("check_pos", "check_id", "layer", "weight", "status")
    rows = results.groupBy(key).agg(F.collect_list(one).alias("c")).withColumn("weighty", F.filter("c", lambda x: x["weight"] > 0)).where("size(weighty) > 0")
    got = lambda of: F.aggregate(of, F.lit(0.0), lambda s, x: s + x["weight"] * score.points(x["status"]))
    total = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda s, x: s + x["weight"])
    failed = lambda of: F.size(F.filter(of, lambda x: x["status"] == "fail")).cast("long")
    layers = F.transform(F.array(*map(F.lit, sorted(checks.LAYERS))), lambda name: F.struct(name.alias("layer"), F.filter("weighty", lambda x: x["layer"] == name).alias("own")))
    layers = F.transform(F.filter(layers, lambda x: F.size(x["own"]) > 0), lambda x: F.struct(x["layer"].alias("layer"), score.percent(got(x["own"]), total(x["own"])).alias("score"), failed(x["own"]).alias("n_fail")))
    order = lambda x: F.struct(-x["weight"], F.when(x["status"] == "fail", 0).otherwise(1), x["check_pos"], x["check_id"].alias("check_id"), x["status"].alias("status"))
    bad = F.slice(F.array_sort(F.transform(F.filter("c", lambda x: x["status"].isin("fail", "warn")), order)), 1, 10)
    known = F.array(*[F.struct(F.lit(c.title).alias("title"), F.lit(c.advice).alias("advice")) for c in checks.CHECKS])
    fixes = F.transform(bad, lambda x, n: F.struct((n + 1).alias("place"), x["check_id"].alias("check_id"), x["status"].alias("status"), F.get(known, x["check_pos"])["title"].alias("title"), F.get(known, x["check_pos"])["advice"].alias("advice")))
    out = rows.select(key, score.percent(got(F.col("weighty")), total(F.col("weighty"))).alias("score"), layers.alias("layers"), fixes.alias("fixes")).withColumn("grade", score.grade(F.col("score")))
    lines = F.concat(
        F.array(F.format_string("Score %d of 100 (%s)", "score", "grade")),
        F.transform("layers", lambda x: F.format_string("- %s: %d%%, %d failed", x["layer"], x["score"], x["n_fail"])),
        F.transform("fixes", lambda x: F.format_string("%d. [%s] %s: %s", x["place"], x["check_id"], x["title"], x["advice"])),
    )
    return out.select(key, "score", "grade", "layers", "fixes", F.array_join(lines, "\n").alias("text"))


#: Ids of a host are ordered in spans of so many, so that a host with most pages is no single task.
SPAN = 1 << 16


def neighbours(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(a, b): each page with the next one of its host, by number.

    Within spans of ids first; the last page of a span goes with the first of the host's next span that has any, which
    takes one row for each host and span.
    """
    rows = pages.select(F.col(key).alias("a"), urls.host(F.col("url")).alias("host")).withColumn("span", F.floor(F.col("a") / SPAN))
    inside = rows.withColumn("b", F.lead("a").over(Window.partitionBy("host", "span").orderBy("a")))
    spans = rows.groupBy("host", "span").agg(F.min("a").alias("first"))
    after = spans.select("host", "span", F.lead("first").over(Window.partitionBy("host").orderBy("span")).alias("next")).where("next IS NOT NULL")
    across = inside.where("b IS NULL").drop("b").join(after, ["host", "span"]).select("a", F.col("next").alias("b"))
    return inside.where("b IS NOT NULL").select("a", "b").unionByName(across)
