"""Evidence from the other fetches of a site: robots.txt, sitemap, host variants, bot access, liveness.

``fetches`` has url, ua ("default", "bot", "sitemap"), status, headers (map), body (text), final_url, hops, error; a
lookup that failed is a row with status 0, and one that is missing counts as that. Header names are read in any
case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import patterns as P
from pagelens.functions import urls
from pagelens.functions.text import all_of, decoded, first_of
from pagelens.operators import robots

FETCH = "url string, ua string, status int, headers map<string,string>, body string, final_url string, hops int, error string"
SAMPLE = 6


def header(headers: Column, name: str) -> Column:
    return F.get(F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name.lower())), 0)


def _rank() -> list[Column]:
    return [(F.col("status") == 200).alias("fine"), F.col("status"), F.col("final_url"), F.col("hops"), F.col("error")]


def _mark() -> list[Column]:
    """What decides among fetches of one rank: the hash of the body, one that SQL has too, then that of the headers."""
    return [F.md5("body").alias("mark"), F.xxhash64(F.array_sort(F.map_entries("headers"))).alias("head")]


def outcomes(fetches: DataFrame) -> DataFrame:
    """(url, ua, status, final_url, hops, error): one outcome for each url and user agent, the one with the best status, so
    that repeated rows don't repeat pages. Headers and bodies are not read."""
    return fetches.groupBy("url", "ua").agg(F.max(F.struct(*_rank())).alias("f")).select("url", "ua", "f.status", "f.final_url", "f.hops", "f.error")


def contents(asked: DataFrame, fetches: DataFrame, *wanted: Column) -> DataFrame:
    """(url, status, ...): what browsers get at the urls of ``asked``, with columns made of headers and body.

    Rows of other urls are left before anything is moved, and one shuffle by url serves the choice of a row for each
    url and the join that follows. Of several rows the one counts that ``evidence`` takes, in whatever order they come.
    """
    rows = fetches.where("ua = 'default'").join(asked.select("url").distinct(), "url", "left_semi").select("url", *_rank()[1:], *_mark(), *wanted)
    names = [c for c in rows.columns if c not in ("url", "final_url", "hops", "error", "mark", "head")]
    best = F.max_by(F.struct(*names), F.struct(*_rank(), "mark", "head"))
    return rows.groupBy("url").agg(best.alias("f")).select("url", "f.*")


def liveness(candidates: DataFrame, fetches: DataFrame) -> DataFrame:
    """candidates (..., url, ua) with status, final_url, hops and error of their fetch; status 0 where there is none."""
    out = candidates.join(outcomes(fetches), ["url", "ua"], "left")
    return out.withColumn("status", F.coalesce("status", F.lit(0)))


def from_live(rows: DataFrame) -> DataFrame:
    """Fetches as the live source makes them, with bodies of bytes, as fetches with bodies of text."""
    return rows.withColumn("body", decoded(F.col("body"), header(F.col("headers"), "content-type")))


VARIANTS = ("http://", "https://", "http://www.", "https://www.")


def _apex(url: Column) -> Column:
    name = F.lower(urls.authority(url))
    return F.when(name.startswith("www."), F.substring(name, F.lit(5), F.length(name))).otherwise(name)


def fetch_plan(pages: DataFrame, files=P.ACCESS_FILES) -> DataFrame:
    """(url, ua): what has to be fetched for pages (url), but for what sitemaps and pages name."""
    own = pages.select("url", F.explode(F.array(F.lit("default"), F.lit("bot"))).alias("ua"))
    variants = pages.select(F.explode(F.array(*[F.concat(F.lit(p), _apex(F.col("url"))) for p in VARIANTS])).alias("url"), F.lit("default").alias("ua"))
    read = pages.select(F.explode(F.array(*[F.concat(urls.origin(F.col("url")), F.lit(f)) for f in files])).alias("url"), F.lit("default").alias("ua"))
    return own.unionByName(variants).unionByName(read).distinct()


def further_urls(pages: DataFrame, fetches: DataFrame) -> dict[str, list[str]]:
    """User agent -> urls that fetched sitemaps and pages name, for a handful of pages: the first entries and previews."""
    maps = pages.select(F.concat(urls.origin(F.col("url")), F.lit("/sitemap.xml")).alias("url"))
    named = maps.join(contents(maps, fetches, F.col("body")).where("status = 200"), "url").select(F.explode(F.slice(all_of(F.col("body"), P.LOC, 1), 1, SAMPLE)).alias("u"))
    shown = pages.join(contents(pages, fetches, first_of(F.coalesce("body", F.lit("")), P.OG_IMAGE).alias("og")), "url").where("og <> ''").select(urls.resolved(F.col("url"), F.col("og")).alias("u"))
    return {agent: [r["u"] for r in rows.distinct().orderBy("u").collect()] for agent, rows in (("sitemap", named), ("default", shown))}


def bot_access(pages: DataFrame, fetches: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, home_status, bot_status, blocked): a bot that gets no answer is not blocked, one that gets another is."""
    asked = pages.select(key, "url", F.explode(F.array(F.lit("default"), F.lit("bot"))).alias("ua"))
    status = lambda ua: F.max(F.when(F.col("ua") == ua, F.col("status")))
    out = liveness(asked, fetches).groupBy(key).agg(status("default").alias("home_status"), status("bot").alias("bot_status"))
    return out.withColumn("blocked", (F.col("bot_status") != 0) & (F.col("bot_status") != F.col("home_status")))


def host_variants(pages: DataFrame, fetches: DataFrame, key: str = "page_id", by_status: bool = False) -> DataFrame:
    """(key, n_statuses, n_hosts, agree): do http, https, apex and www lead to one place?

    They agree if all answer 200 and end on one host; ``by_status`` asks for the 200 alone.
    """
    asked = pages.select(key, F.explode(F.array(*[F.concat(F.lit(p), _apex(F.col("url"))) for p in VARIANTS])).alias("url"), F.lit("default").alias("ua"))
    out = liveness(asked, fetches).groupBy(key).agg(F.count_distinct("status").alias("n_statuses"), F.min("status").alias("least"), F.count_distinct(F.lower(urls.authority(F.col("final_url")))).alias("n_hosts"))
    agree = (F.col("n_statuses") == 1) & (F.col("least") == 200)
    return out.select(key, "n_statuses", "n_hosts", (agree if by_status else agree & (F.col("n_hosts") <= 1)).alias("agree"))


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """(site, pos, loc, cjk) of sitemaps (site, body)."""
    return sitemaps.select("site", F.posexplode(all_of(F.col("body"), P.LOC, 1)).alias("pos", "loc")).withColumn("cjk", urls.has_cjk(F.col("loc")))


def sitemap_freshness(sitemaps: DataFrame) -> DataFrame:
    """(site, n_lastmod, last_mod, last_year)."""
    dates = all_of(F.col("body"), P.LASTMOD, 1)
    return sitemaps.select("site", F.size(dates).cast("long").alias("n_lastmod"), F.array_max(dates).alias("last_mod")).withColumn("last_year", F.expr("try_cast(left(last_mod, 4) AS int)"))


AGENTS = ("default", "bot", "sitemap")


def evidence(fetches: DataFrame) -> DataFrame:
    """(url, default, bot, sitemap): for each url the best outcome of each agent, with what the audit reads in it.

    An outcome has status, final_url, hops, error and, made before anything is moved: ``og`` (the preview image a page names),
    ``shown`` (it could be an image), and ``file``, the body where the url is that of a robots file or a sitemap. Pages'
    bodies stay where they are. Stored in buckets by url, this serves all joins of an audit without a shuffle.
    """
    is_file = F.col("url").endswith("/robots.txt") | F.col("url").endswith("/sitemap.xml")
    shown = F.coalesce(header(F.col("headers"), "content-type"), F.lit("")).contains("image") | (F.octet_length(F.coalesce("body", F.lit(""))) > 1000)
    outcome = F.struct(*_rank(), *_mark(), F.nullif(first_of(F.coalesce("body", F.lit("")), P.OG_IMAGE), F.lit("")).alias("og"), shown.alias("shown"), F.when(is_file, F.col("body")).alias("file"))
    return fetches.select("url", "ua", outcome.alias("f")).groupBy("url").agg(*[F.max(F.when(F.col("ua") == a, F.col("f"))).alias(a) for a in AGENTS])


def site_signals(pages: DataFrame, fetches: DataFrame | None, key: str = "page_id", fresh_year: int = 2026, mode: str = "rfc9309", known: DataFrame | None = None) -> DataFrame:
    """One row for each page (key, url) with everything that the site checks look at.

    ``known`` is the ``evidence`` of the fetches where it is stored already; fetches aren't read then. What belongs to a site
    (its files and names) is looked up once for all of its pages.
    """
    known = evidence(fetches) if known is None else known
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = pages.select(key, F.coalesce("url", F.lit("")).alias("url"), urls.origin(F.coalesce("url", F.lit(""))).alias("origin"))
    # A page without an image asks for one that nobody has, so that such rows are dealt out evenly.
    image = F.coalesce(urls.resolved(F.col("url"), F.col("default.og")), F.concat(F.lit("none:"), F.col(key).cast("string")))
    home = base.join(known.select("url", "default", "bot"), "url", "left").select(
        key, "url", "origin", zero("default.status").alias("home_status"), F.col("default.error").alias("home_error"), zero("default.hops").alias("hops"), zero("bot.status").alias("bot_status"), image.alias("image"))
    home = home.join(known.select(F.col("url").alias("image"), ((F.col("default.status") == 200) & F.col("default.shown")).alias("og_image_loads")), "image", "left").drop("image")

    files = [F.struct(F.lit(f).alias("role"), F.concat("origin", F.lit(f)).alias("url")) for f in P.ACCESS_FILES]
    names = [F.struct(F.lit("name").alias("role"), F.concat(F.lit(p), _apex(F.col("origin"))).alias("url")) for p in VARIANTS]
    asked = base.select("origin").distinct().select("origin", F.explode(F.array(*files, *names)).alias("a")).select("origin", "a.*")
    status, named = zero("f.status"), F.col("role") == "name"
    of = lambda role, c=status: F.max(F.when(F.col("role") == role, c))
    good = lambda role: of(role, F.when(F.col("f.status") == 200, F.col("f.file")))
    per_site = asked.join(known.select("url", F.col("default").alias("f")), "url", "left").groupBy("origin").agg(
        of("/robots.txt").alias("robots_status"), of("/sitemap.xml").alias("sitemap_status"), of("/llms.txt").alias("llms_status"), of("/rss.xml").alias("rss_status"), F.count_if(~named & (status == 200)).alias("n_access_files"),
        ((F.min(F.when(named, status)) == 200) & (F.max(F.when(named, status)) == 200) & (F.size(F.collect_set(F.when(named, F.lower(urls.authority(F.col("f.final_url")))))) <= 1)).alias("variants_agree"),
        good("/robots.txt").alias("robots"), good("/sitemap.xml").alias("sitemap"),
    )
    last = F.left(F.array_max(all_of(F.col("sitemap"), P.LASTMOD, 1)), F.lit(4))
    per_site = per_site.withColumn("locs", all_of(F.col("sitemap"), P.LOC, 1)).withColumns({
        "robots_closed": F.coalesce(F.col("robots").rlike(P.BARE_DISALLOW), F.lit(False)), "n_locs": F.coalesce(F.size("locs"), F.lit(0)).cast("long"), "n_cjk_slugs": F.coalesce(F.size(F.filter("locs", urls.has_cjk)), F.lit(0)).cast("long"),
        "last_year": last.try_cast("int"),
    })
    sampled = per_site.select("origin", F.explode(F.slice("locs", 1, SAMPLE)).alias("url")).join(known.select("url", F.col("sitemap.status").alias("status")), "url", "left")
    bad = sampled.groupBy("origin").agg(F.count_if(zero("status") != 200).alias("n_bad_locs"))
    texts = per_site.where("robots IS NOT NULL").select(F.col("origin").alias("site"), F.col("robots").alias("body"))
    bots = pages.sparkSession.createDataFrame([(b,) for b in P.CITATION_BOTS], "bot string")
    denied = robots.verdicts(texts, bots, mode=mode).groupBy("site").agg(F.count_if(F.col("verdict") == "deny").alias("n_denied")).withColumnRenamed("site", "origin")
    declared = robots.declared(texts, bots, mode).withColumnRenamed("site", "origin")

    per_site = per_site.drop("robots", "sitemap", "locs").join(denied, "origin", "left").join(declared, "origin", "left").join(bad, "origin", "left")
    out = home.join(per_site, "origin", "left").withColumns({c: zero(c) for c in ("n_denied", "n_declared", "n_bad_locs")})
    return out.withColumns({"og_image_loads": F.coalesce("og_image_loads", F.lit(False)), "variants_agree": F.coalesce("variants_agree", F.lit(False)), "fresh_year": F.lit(fresh_year)})
