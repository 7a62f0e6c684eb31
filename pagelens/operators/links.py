"""Links of pages and what became of them: extraction, resolution, and a lookup in stored fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions import urls
from pagelens.functions.text import all_of

ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"'<>]*)["']"""
#: Into so many parts the links to one address are dealt when they get its status.
SALTS = 8


def page_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, url): the addresses that a page's anchors lead to, as seen from the page, fragments cut off.

    Links within the page itself and those of other schemes than http and https are left out; ``pos`` is a link's place
    among all anchors, from 0. Null pages have no links.
    """
    found = pages.select(key, F.col("url").alias("base"), F.posexplode(all_of(F.col("html"), ANCHOR, 1)).alias("pos", "link"))
    found = found.select(key, "base", "pos", F.trim("link").alias("link")).where("link <> '' AND NOT startswith(link, '#')")
    return found.select(key, "pos", urls.absolute(F.col("base"), F.col("link")).alias("url")).where(F.col("url").rlike(r"(?i)^https?://[^/?#]"))


def link_status(pages: DataFrame, known: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, url, status, verdict) of every link: ok, dead (400 and up), failed (no answer) or unknown (never fetched).

    ``known`` is ``site.evidence``; stored in buckets by url it isn't moved. An address is looked up once, however many
    pages link it, and its status goes back to the links in parts, so one that most pages link is no single task.
    """
    links = page_links(pages, key)
    status = links.select("url").distinct().join(known.select("url", F.col("default.status").alias("status")), "url", "left")
    salted = status.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = links.withColumn("salt", F.pmod(F.xxhash64(key, "pos"), F.lit(SALTS)).cast("int")).join(salted, ["url", "salt"], "left")
    verdict = F.when(F.col("status").isNull(), "unknown").when(F.col("status") == 0, "failed").when(F.col("status") >= 400, "dead").otherwise("ok")
    return out.select(key, "pos", "url", "status", verdict.alias("verdict"))


def broken_links(status: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, n_links, n_dead, n_failed, n_unknown) of every page with links."""
    count = lambda v: F.count_if(F.col("verdict") == v).alias(f"n_{v}")
    return status.groupBy(key).agg(F.count("*").alias("n_links"), count("dead"), count("failed"), count("unknown"))
