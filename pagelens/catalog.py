"""All queries of the audit engine, by name, and the SQL that answers them over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import patterns as P
from pagelens.functions import provenance, urls
from pagelens.functions.text import count_of, visible_text
from pagelens.operators import checks, history, links, planning, pool, presence, robots, score, signals, site, visibility
from pagelens.plans import audit
from pagelens.plans import derived as D
from pagelens.plans import samples as S
from pagelens.sources import buckets, jsonl

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- pages ----------------------------------------------------------------------------------------------------

_SIGNALS = signals.signals_sql()
_CHECKS = f"WITH s AS ({_SIGNALS}), s2 AS (SELECT *, 0 AS llms_status FROM s), checks AS ({checks.results_sql('s2', checks.PAGE)})"
_POINTS = "CASE status WHEN 'ok' THEN 1.0 WHEN 'warn' THEN 0.5 ELSE 0.0 END"
_GRADE = "CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END"
_SUMS = f"cast(sum(weight * {_POINTS}) AS double) AS got, cast(sum(weight) AS bigint) AS total, count(*) FILTER (status = 'fail') AS n_fail, count(*) FILTER (status = 'warn') AS n_warn"
_SCORES = f"SELECT *, {_GRADE} AS grade FROM (SELECT *, cast(round_even(got / total * 100, 0) AS bigint) AS score FROM (SELECT page_id, {_SUMS} FROM checks WHERE weight > 0 GROUP BY page_id))"
_EVIDENCE = "n_html, n_text, title_len, n_words, n_facts, n_lists, n_quotes"
_HOST = f"replace(lower(regexp_extract(url, {_q(P.AUTHORITY_PART)}, 1)), 'www.', '')"
_PAIRS = f"SELECT a, b FROM (SELECT page_id AS a, lead(page_id) OVER (PARTITION BY {_HOST} ORDER BY page_id) AS b FROM pages) WHERE b IS NOT NULL"


@query("visible_text", f"SELECT page_id, n_text AS text_chars, n_words FROM ({_SIGNALS})")
def _(spark, d):
    text = _table(spark, d, "pages").select("page_id", visible_text(F.col("html")).alias("text"))
    return text.select("page_id", F.length("text").cast("long").alias("text_chars"), count_of(F.col("text"), P.WORD).alias("n_words"))


@query("page_signals", f"SELECT * REPLACE (round_even(text_ratio, 6) AS text_ratio) FROM ({_SIGNALS})")
def _(spark, d):
    return signals.page_signals(_table(spark, d, "pages")).withColumn("text_ratio", F.bround("text_ratio", 6))


@query("page_checks", f"{_CHECKS} SELECT * FROM checks")
def _(spark, d):
    return audit.page_checks(_table(spark, d, "pages"))


@query("page_scores", f"{_CHECKS} SELECT c.*, {_EVIDENCE} FROM ({_SCORES}) c JOIN s USING (page_id)")
def _(spark, d):
    """Scores with the evidence behind them; the evidence rides along, so pages are read once."""
    made = signals.page_signals(_table(spark, d, "pages"))
    names = _EVIDENCE.split(", ")
    long = made.select("page_id", *names, F.explode(F.expr("array(" + ", ".join(f"CASE WHEN {c.when} THEN struct({c.weight} AS weight, {checks.status_sql(c)} AS status) END" for c in checks.PAGE) + ")")).alias("c")).where("c IS NOT NULL AND c.weight > 0")
    sums = long.groupBy("page_id").agg(F.sum(F.col("c.weight") * score.points(F.col("c.status"))).alias("got"), F.sum("c.weight").cast("long").alias("total"), F.count_if(F.col("c.status") == "fail").alias("n_fail"), F.count_if(F.col("c.status") == "warn").alias("n_warn"), *[F.first(n).alias(n) for n in names])
    return sums.withColumn("score", score.percent(F.col("got"), F.col("total"))).withColumn("grade", score.grade(F.col("score")))


@query("layer_scores", f"{_CHECKS} SELECT *, cast(round_even(got / total * 100, 0) AS bigint) AS score FROM (SELECT page_id, layer, {_SUMS} FROM checks WHERE weight > 0 GROUP BY page_id, layer)")
def _(spark, d):
    return score.layer_scores(audit.page_checks(_table(spark, d, "pages")))


@query("grade_histogram", f"{_CHECKS} SELECT grade, count(*) AS n_pages, min(score) AS min_score, max(score) AS max_score FROM ({_SCORES}) GROUP BY grade")
def _(spark, d):
    return score.grade_histogram(score.page_scores(audit.page_checks(_table(spark, d, "pages"))))


@query("priority_fixes", f"{_CHECKS} SELECT page_id, place, check_id, weight, status FROM (SELECT *, cast(row_number() OVER (PARTITION BY page_id ORDER BY weight DESC, status = 'fail' DESC, check_pos) AS int) AS place FROM checks WHERE status IN ('fail', 'warn')) WHERE place <= 10")
def _(spark, d):
    return score.priority_fixes(audit.page_checks(_table(spark, d, "pages")))


@query("status_by_check", f"{_CHECKS} SELECT check_id, layer, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in ("ok", "warn", "fail", "info")) + " FROM checks GROUP BY check_id, layer")
def _(spark, d):
    return score.status_by_check(audit.page_checks(_table(spark, d, "pages")))


_COMPARE = f"""SELECT a, b, check_id, coalesce(status_a, 'missing') AS status_a, coalesce(status_b, 'missing') AS status_b, CASE WHEN pa > pb THEN 'A' ELSE 'B' END AS winner FROM (
 SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, coalesce(x.check_id, y.check_id) AS check_id, x.status AS status_a, y.status AS status_b, {_POINTS.replace('status', 'x.status')} AS pa, {_POINTS.replace('status', 'y.status')} AS pb
 FROM (SELECT a, b, check_id, status FROM pairs JOIN checks ON page_id = a WHERE weight > 0) x FULL JOIN (SELECT a, b, check_id, status FROM pairs JOIN checks ON page_id = b WHERE weight > 0) y ON x.a = y.a AND x.b = y.b AND x.check_id = y.check_id) WHERE abs(pa - pb) >= 0.5"""


@query("compare_pages", f"{_CHECKS}, pairs AS ({_PAIRS}) {_COMPARE}")
def _(spark, d):
    pages = _table(spark, d, "pages")
    return score.compare(audit.neighbours(pages), audit.page_checks(pages))


@query("compare_scores", f"{_CHECKS}, pairs AS ({_PAIRS}), scores AS ({_SCORES}) SELECT a, b, x.score AS score_a, y.score AS score_b, CASE WHEN x.score >= y.score THEN 'A' ELSE 'B' END AS winner, abs(x.score - y.score) AS gap FROM pairs JOIN scores x ON x.page_id = a JOIN scores y ON y.page_id = b")
def _(spark, d):
    pages = _table(spark, d, "pages")
    return score.compare_scores(audit.neighbours(pages), score.page_scores(audit.page_checks(pages)))


@query("page_types", f"SELECT page_type, count(*) AS n_pages FROM ({_SIGNALS}) GROUP BY page_type")
def _(spark, d):
    return _table(spark, d, "pages").groupBy(urls.page_type(F.col("url")).alias("page_type")).agg(F.count("*").alias("n_pages"))


@query("source_pool_hosts", f"SELECT question, host, n, place FROM (SELECT *, cast(row_number() OVER (PARTITION BY question ORDER BY n DESC, first_pos, host) AS int) AS place FROM (SELECT 'q' || page_id % 7 AS question, {_HOST} AS host, count(*) AS n, min(page_id) AS first_pos FROM pages GROUP BY ALL)) WHERE place <= 12")
def _(spark, d):
    results = _table(spark, d, "pages").select(F.concat(F.lit("q"), F.col("page_id") % 7).alias("question"), F.col("page_id").alias("pos"), F.lit("").alias("title"), "url")
    return pool.host_distribution(results)


# ---- pages with richer markup, robots, sitemaps, fetches: derived from all pages ------------------------------------

_PAGE_ROWS = f"({D.rich_sql()})"
_SAMPLE_SIGNALS = signals.signals_sql(_PAGE_ROWS)
_SAMPLE_CHECKS = _CHECKS.replace(_SIGNALS, _SAMPLE_SIGNALS)


def _pages(spark, d):
    return D.rich_pages(spark, _table(spark, d, "pages"))


@query("sample_signals", f"SELECT * REPLACE (round_even(text_ratio, 6) AS text_ratio) FROM ({_SAMPLE_SIGNALS})")
def _(spark, d):
    return signals.page_signals(_pages(spark, d)).withColumn("text_ratio", F.bround("text_ratio", 6))


@query("sample_checks", f"{_SAMPLE_CHECKS} SELECT * FROM checks")
def _(spark, d):
    return audit.page_checks(_pages(spark, d))


@query("sample_scores", f"{_SAMPLE_CHECKS} {_SCORES}")
def _(spark, d):
    return score.page_scores(audit.page_checks(_pages(spark, d)))


def _robot_lines(files: str) -> str:
    """Common table expressions from files (site, body) to the lines that count."""
    return f"""files AS ({files}),
 raw AS (SELECT site, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS pos FROM files),
 cut AS (SELECT site, pos, trim(string_split(line, '#')[1]) AS line FROM raw),
 kv AS (SELECT site, pos, lower(trim(line[1:instr(line, ':') - 1])) AS kind, trim(line[instr(line, ':') + 1:]) AS value FROM cut WHERE contains(line, ':'))"""


def _robot_verdicts(bots: str) -> str:
    """From those lines to found (site, bot, kind, ua): the group of the bot's own name, and what it says of the path /."""
    return f"""bots AS (SELECT * FROM {bots}),
 kept AS (SELECT *, kind = 'user-agent' AND coalesce(lag(kind) OVER (PARTITION BY site ORDER BY pos) <> 'user-agent', true) AS starts FROM kv WHERE kind IN ('user-agent', 'allow', 'disallow')),
 block AS (SELECT *, sum(cast(starts AS int)) OVER (PARTITION BY site ORDER BY pos) AS block FROM kept),
 name AS (SELECT DISTINCT site, block, lower(value) AS name, value AS ua FROM block WHERE kind = 'user-agent' AND value <> ''),
 rule AS (SELECT n.site, n.name, b.kind, b.value AS pattern FROM name n JOIN block b USING (site, block) WHERE b.kind <> 'user-agent' AND b.value <> ''),
 fits AS (SELECT * FROM rule WHERE regexp_full_match('/', replace(regexp_escape(CASE WHEN ends_with(pattern, '$') THEN left(pattern, length(pattern) - 1) ELSE pattern || '*' END), '\\*', '.*'))),
 decided AS (SELECT site, name, max_by(kind, length(pattern) * 2 + cast(kind = 'allow' AS int)) AS kind FROM fits GROUP BY ALL),
 own AS (SELECT g.site, g.name, g.ua, coalesce(d.kind, 'allow') AS kind FROM (SELECT site, name, min(ua) AS ua FROM name GROUP BY ALL) g LEFT JOIN decided d USING (site, name)),
 found AS (SELECT site, bot, arg_max(kind, CASE WHEN name = '*' THEN 0 ELSE length(name) END) AS kind, arg_max(ua, CASE WHEN name = '*' THEN 0 ELSE length(name) END) AS ua FROM own JOIN bots ON name = '*' OR starts_with(lower(bot), name) GROUP BY ALL)"""


_ROBOT_FILES = f"SELECT site, robots AS body FROM ({D.sites_sql()})"
_ROBOT_LINES = f"""WITH {_robot_lines(_ROBOT_FILES)},
 filled AS (SELECT *, last_value(CASE WHEN kind = 'user-agent' THEN value END IGNORE NULLS) OVER (PARTITION BY site ORDER BY pos) AS ua FROM kv WHERE kind IN ('user-agent', 'allow', 'disallow')),
 rules AS (SELECT DISTINCT site, ua, cast(min(pos) OVER (PARTITION BY site, ua) AS int) AS group_pos, CASE WHEN kind <> 'user-agent' THEN kind END AS kind, CASE WHEN kind <> 'user-agent' THEN value END AS pattern FROM filled WHERE ua IS NOT NULL)"""
_BOTS = S.values_sql(robots.BOTS, "bot, class")


def _sites_of(spark, d):
    return D.sites(spark, _table(spark, d, "pages"))


def _robots(spark, d):
    return _sites_of(spark, d).select("site", F.col("robots").alias("body")), S.frame(spark, robots.BOTS, "bot string, class string")


@query("robots_rules", f"{_ROBOT_LINES} SELECT * FROM rules")
def _(spark, d):
    return robots.rules(_robots(spark, d)[0], "file_order")


@query("robots_verdicts", f"""{_ROBOT_LINES}, bots AS (SELECT * FROM {_BOTS}),
 decided AS (SELECT site, ua, group_pos, max_by(kind, length(pattern) * 2 + cast(kind = 'allow' AS int)) AS kind FROM rules WHERE pattern <> '' AND starts_with('/', replace(pattern, '*', '')) GROUP BY ALL),
 best AS (SELECT site, bot, min_by(kind, group_pos) AS kind, min_by(ua, group_pos) AS ua FROM decided JOIN bots ON ua = '*' OR starts_with(lower(bot), lower(ua)) OR starts_with(lower(ua), lower(bot)) GROUP BY ALL)
 SELECT f.site, b.bot, CASE WHEN kind = 'disallow' THEN 'deny' WHEN kind = 'allow' THEN 'allow' ELSE 'undeclared' END AS verdict, ua AS matched_ua FROM files f CROSS JOIN bots b LEFT JOIN best USING (site, bot)""")
def _(spark, d):
    files, bots = _robots(spark, d)
    return robots.verdicts(files, bots.select("bot"), mode="file_order")


@query("robots_verdicts_rfc9309", f"WITH {_robot_lines(_ROBOT_FILES)}, {_robot_verdicts(_BOTS)} SELECT f.site, b.bot, CASE WHEN kind = 'disallow' THEN 'deny' WHEN kind = 'allow' THEN 'allow' ELSE 'undeclared' END AS verdict, ua AS matched_ua FROM files f CROSS JOIN bots b LEFT JOIN found USING (site, bot)")
def _(spark, d):
    files, bots = _robots(spark, d)
    return robots.verdicts(files, bots.select("bot"))


@query("robots_declared", f"{_ROBOT_LINES}, bots AS (SELECT * FROM {_BOTS}) SELECT f.site, count(DISTINCT bot) AS n_declared FROM files f LEFT JOIN rules r USING (site) LEFT JOIN bots b ON starts_with(lower(r.ua), lower(b.bot[1:6])) GROUP BY f.site")
def _(spark, d):
    files, bots = _robots(spark, d)
    return robots.declared(files, bots.select("bot"), "file_order")


_MAPS = f"(SELECT site, sitemap AS body FROM ({D.sites_sql()}))"


def _maps(spark, d):
    return _sites_of(spark, d).select("site", F.col("sitemap").alias("body"))


@query("sitemap_slugs", f"SELECT site, cast(pos - 1 AS int) AS pos, loc, regexp_matches(coalesce(try(url_decode(loc)), loc), '{P.CJK}') AS cjk FROM (SELECT site, unnest(locs) AS loc, generate_subscripts(locs, 1) AS pos FROM (SELECT site, regexp_extract_all(body, {_q(P.LOC)}, 1) AS locs FROM {_MAPS}))")
def _(spark, d):
    return site.sitemap_entries(_maps(spark, d))


@query("sitemap_freshness", f"SELECT site, len(dates) AS n_lastmod, list_max(dates) AS last_mod, coalesce(cast(left(list_max(dates), 4) AS int), 0) AS last_year FROM (SELECT site, regexp_extract_all(body, {_q(P.LASTMOD)}, 1) AS dates FROM {_MAPS})")
def _(spark, d):
    return site.sitemap_freshness(_maps(spark, d)).fillna({"last_year": 0})


_ALL_FETCHES = D.fetches_sql()
_FETCHES = f"(SELECT DISTINCT ON (url, ua) * FROM {_ALL_FETCHES} ORDER BY url, ua, status = 200 DESC, status DESC)"
_SITES = "(SELECT page_id, url FROM pages)"


def _stored(spark, d, kind, made):
    """A table in buckets by url, written once for the files that it is made of."""
    name = buckets.name_of(spark, kind, f"{d}/pages.parquet")
    return spark.table(name) if buckets.known(spark, name) else buckets.bucketed(made(), name, "url")


def _fetches(spark, d):
    return _stored(spark, d, "fetches", lambda: D.crawl(spark, _table(spark, d, "pages")))


def _evidence(spark, d):
    return _stored(spark, d, "evidence", lambda: site.evidence(_fetches(spark, d)))


def _sites(spark, d):
    return _table(spark, d, "pages").select("page_id", "url")


@query("ua_block", f"SELECT page_id, home_status, bot_status, bot_status <> 0 AND bot_status <> home_status AS blocked FROM (SELECT s.page_id, coalesce(max(status) FILTER (ua = 'default'), 0) AS home_status, coalesce(max(status) FILTER (ua = 'bot'), 0) AS bot_status FROM {_SITES} s LEFT JOIN {_FETCHES} f USING (url) GROUP BY s.page_id)")
def _(spark, d):
    return site.bot_access(_sites(spark, d), _fetches(spark, d))


_VARIANTS = f"SELECT page_id, unnest(['http://', 'https://', 'http://www.', 'https://www.']) || regexp_replace(lower(regexp_extract(url, {_q(P.AUTHORITY_PART)}, 1)), '^www\\.', '') AS url FROM {_SITES}"


@query("host_variants", f"SELECT page_id, n_statuses, n_hosts, n_statuses = 1 AND least = 200 AND n_hosts <= 1 AS agree FROM (SELECT page_id, count(DISTINCT coalesce(status, 0)) AS n_statuses, min(coalesce(status, 0)) AS least, count(DISTINCT lower(regexp_extract(final_url, {_q(P.AUTHORITY_PART)}, 1))) AS n_hosts FROM ({_VARIANTS}) v LEFT JOIN {_FETCHES} f ON f.url = v.url AND f.ua = 'default' GROUP BY page_id)")
def _(spark, d):
    return site.host_variants(_sites(spark, d), _fetches(spark, d))


@query("liveness", f"SELECT site, loc AS url, coalesce(status, 0) AS status FROM (SELECT site, unnest(regexp_extract_all(body, {_q(P.LOC)}, 1)) AS loc FROM {_MAPS}) m LEFT JOIN {_FETCHES} f ON f.url = m.loc AND f.ua = 'sitemap'")
def _(spark, d):
    asked = site.sitemap_entries(_maps(spark, d)).select("site", F.col("loc").alias("url"), F.lit("sitemap").alias("ua"))
    return site.liveness(asked, _fetches(spark, d)).select("site", "url", "status")


_CITATION_BOTS = S.values_sql([(b,) for b in P.CITATION_BOTS], "bot")
_ORIGIN = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_SITE_SIGNALS = f"""page AS (SELECT page_id, url, {_ORIGIN} AS origin FROM {_SITES}), answers AS (SELECT * FROM {_FETCHES}), plain AS (SELECT * FROM answers WHERE ua = 'default'),
 site AS (SELECT DISTINCT origin FROM page),
 {_robot_lines("SELECT origin AS site, body FROM site JOIN plain ON url = origin || '/robots.txt' WHERE status = 200")}, {_robot_verdicts(_CITATION_BOTS)},
 denied AS (SELECT site AS origin, count(*) FILTER (kind = 'disallow') AS n_denied FROM found GROUP BY site),
 named AS (SELECT n.site AS origin, count(DISTINCT bot) AS n_declared FROM name n JOIN bots ON starts_with(n.name, lower(bot[1:6])) GROUP BY n.site),
 map AS (SELECT origin, regexp_extract_all(body, {_q(P.LOC)}, 1) AS locs, regexp_extract_all(body, {_q(P.LASTMOD)}, 1) AS dates FROM site JOIN plain ON url = origin || '/sitemap.xml' WHERE status = 200),
 loc AS (SELECT origin, unnest(locs) AS loc, generate_subscripts(locs, 1) AS pos FROM map),
 locs AS (SELECT origin, count(*) AS n_locs, count(*) FILTER (regexp_matches(coalesce(try(url_decode(loc)), loc), '{P.CJK}')) AS n_cjk_slugs, count(*) FILTER (pos <= {site.SAMPLE} AND coalesce(f.status, 0) <> 200) AS n_bad_locs FROM loc LEFT JOIN answers f ON f.url = loc AND f.ua = 'sitemap' GROUP BY origin),
 variant AS (SELECT page_id, count(DISTINCT coalesce(status, 0)) = 1 AND min(coalesce(status, 0)) = 200 AND count(DISTINCT lower(regexp_extract(final_url, {_q(P.AUTHORITY_PART)}, 1))) <= 1 AS variants_agree FROM ({_VARIANTS}) v LEFT JOIN plain f ON f.url = v.url GROUP BY page_id),
 og AS (SELECT page_id, origin, regexp_extract(p.url, '^([^?#]*/)', 1) AS folder, regexp_extract(body, {_q(P.OG_IMAGE)}, 1) AS link FROM page p JOIN plain USING (url)),
 image AS (SELECT page_id, status = 200 AND (contains(coalesce(content_type, ''), 'image') OR strlen(coalesce(body, '')) > 1000) AS og_image_loads FROM (SELECT page_id, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN 'https:' || link WHEN starts_with(link, '/') THEN origin || link ELSE folder || link END AS url FROM og WHERE link <> '') JOIN plain USING (url)),
 sig AS (SELECT p.page_id, coalesce(h.status, 0) AS home_status, h.error AS home_error, coalesce(h.hops, 0) AS hops, coalesce(b.status, 0) AS bot_status, coalesce(variants_agree, false) AS variants_agree, coalesce(og_image_loads, false) AS og_image_loads,
  coalesce(r.status, 0) AS robots_status, coalesce(r.status = 200 AND regexp_matches(r.body, {_q(P.BARE_DISALLOW)}), false) AS robots_closed, coalesce(m.status, 0) AS sitemap_status, coalesce(l.status, 0) AS llms_status, coalesce(s.status, 0) AS rss_status,
  coalesce(n_denied, 0) AS n_denied, coalesce(n_declared, 0) AS n_declared, coalesce(n_locs, 0) AS n_locs, coalesce(n_cjk_slugs, 0) AS n_cjk_slugs, coalesce(n_bad_locs, 0) AS n_bad_locs, try_cast(left(list_max(map.dates), 4) AS int) AS last_year, 2026 AS fresh_year
  FROM page p LEFT JOIN plain h ON h.url = p.url LEFT JOIN answers b ON b.url = p.url AND b.ua = 'bot' LEFT JOIN variant USING (page_id) LEFT JOIN image USING (page_id)
  LEFT JOIN plain r ON r.url = p.origin || '/robots.txt' LEFT JOIN plain m ON m.url = p.origin || '/sitemap.xml' LEFT JOIN plain l ON l.url = p.origin || '/llms.txt' LEFT JOIN plain s ON s.url = p.origin || '/rss.xml'
  LEFT JOIN denied ON denied.origin = p.origin LEFT JOIN named ON named.origin = p.origin LEFT JOIN locs ON locs.origin = p.origin LEFT JOIN map ON map.origin = p.origin)"""


@query("site_checks", f"WITH {_SITE_SIGNALS} {checks.results_sql('sig', checks.SITE)}")
def _(spark, d):
    return audit.site_checks(_sites(spark, d), None, known=_evidence(spark, d))


_HOME_PAGES = f"(SELECT s.page_id, s.url, f.body AS html FROM {_SITES} s LEFT JOIN {_FETCHES} f ON f.url = s.url AND f.ua = 'default')"
_FULL_CHECKS = f"WITH {_SITE_SIGNALS}, mine AS ({signals.signals_sql(_HOME_PAGES)}), mine2 AS (SELECT *, 0 AS llms_status FROM mine), checks AS ({checks.results_sql('mine2', checks.PAGE)} UNION ALL {checks.results_sql('sig', checks.SITE)})"
_TITLES = S.values_sql([(c.key, c.title, c.advice) for c in checks.CHECKS], "check_id, title, advice")
_FIXES = "SELECT *, cast(row_number() OVER (PARTITION BY page_id ORDER BY weight DESC, status = 'fail' DESC, check_pos) AS int) AS place FROM checks WHERE status IN ('fail', 'warn')"


@query("full_checks", f"{_FULL_CHECKS} SELECT * FROM checks")
def _(spark, d):
    return audit.full_checks(_sites(spark, d), _fetches(spark, d), known=_evidence(spark, d))


@query("full_fixes", f"{_FULL_CHECKS} SELECT page_id, place, check_id, weight, status FROM ({_FIXES}) WHERE place <= 10")
def _(spark, d):
    return score.priority_fixes(audit.full_checks(_sites(spark, d), _fetches(spark, d), known=_evidence(spark, d)))


@query("full_report", f"""{_FULL_CHECKS}, layer AS (SELECT page_id, layer, cast(round_even(got / total * 100, 0) AS bigint) AS score, n_fail FROM (SELECT page_id, layer, {_SUMS} FROM checks WHERE weight > 0 GROUP BY page_id, layer)),
 layers AS (SELECT page_id, string_agg('- ' || layer || ': ' || score || '%, ' || n_fail || ' failed', chr(10) ORDER BY layer) AS lines FROM layer GROUP BY page_id),
 fixes AS (SELECT page_id, string_agg(place || '. [' || check_id || '] ' || title || ': ' || advice, chr(10) ORDER BY place) AS lines FROM ({_FIXES}) JOIN {_TITLES} USING (check_id) WHERE place <= 10 GROUP BY page_id)
 SELECT page_id, score, grade, concat_ws(chr(10), 'Score ' || score || ' of 100 (' || grade || ')', layers.lines, fixes.lines) AS text FROM ({_SCORES}) JOIN layers USING (page_id) LEFT JOIN fixes USING (page_id)""")
def _(spark, d):
    return audit.report(audit.full_checks(_sites(spark, d), _fetches(spark, d), known=_evidence(spark, d))).select("page_id", "score", "grade", "text")


_ANCHOR = _q(links.ANCHOR)
_NO_QUERY = "regexp_extract(base, '^([^?#]*)', 1)"
_FOLDER = f"{_ORIGIN.replace('(url', '(base')} || coalesce(nullif(regexp_extract(regexp_extract(base, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^(.*/)', 1), ''), '/')"
_LINKS = f"""anchor AS (SELECT page_id, base, cast(i - 1 AS int) AS pos, trim(link) AS link FROM (SELECT page_id, url AS base, unnest(found) AS link, generate_subscripts(found, 1) AS i FROM (SELECT page_id, url, regexp_extract_all(html, {_ANCHOR}, 1) AS found FROM {_PAGE_ROWS}))),
 target AS (SELECT page_id, pos, regexp_extract(CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link WHEN starts_with(link, '//') THEN split_part(base, ':', 1) || ':' || link WHEN starts_with(link, '/') THEN {_ORIGIN.replace('(url', '(base')} || link WHEN starts_with(link, '?') THEN {_NO_QUERY} || link ELSE {_FOLDER} || link END, '^([^#]*)', 1) AS url FROM anchor WHERE link <> '' AND NOT starts_with(link, '#')),
 link AS (SELECT page_id, pos, o || regexp_replace(regexp_replace(regexp_replace(substring(url, length(o) + 1), '/[.]/', '/', 'g'), '/[^/]+/[.][.]/', '/', 'g'), '^/[.][.]/', '/') AS url FROM (SELECT *, {_ORIGIN} AS o FROM target) WHERE regexp_matches(url, '(?i)^https?://[^/?#]'))"""
_LINK_STATUS = f"WITH {_LINKS} SELECT page_id, pos, url, status, CASE WHEN status IS NULL THEN 'unknown' WHEN status = 0 THEN 'failed' WHEN status >= 400 THEN 'dead' ELSE 'ok' END AS verdict FROM link LEFT JOIN (SELECT url, status FROM {_FETCHES} WHERE ua = 'default') USING (url)"


@query("page_link_status", _LINK_STATUS)
def _(spark, d):
    """Every link of every page with its status; the stored evidence isn't moved."""
    return links.link_status(_pages(spark, d), _evidence(spark, d))


@query("page_broken_links", f"SELECT page_id, count(*) AS n_links, count(*) FILTER (verdict = 'dead') AS n_dead, count(*) FILTER (verdict = 'failed') AS n_failed, count(*) FILTER (verdict = 'unknown') AS n_unknown FROM ({_LINK_STATUS}) GROUP BY page_id")
def _(spark, d):
    return links.broken_links(links.link_status(_pages(spark, d), _evidence(spark, d)))


_PATH = "coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1), ''), '/')"
_ONE_OF_BOTS = "SELECT page_id, p.bot, CASE WHEN kind = 'disallow' THEN 'deny' WHEN kind = 'allow' THEN 'allow' ELSE 'undeclared' END AS verdict, ua AS matched_ua FROM (SELECT * FROM path CROSS JOIN bots) p LEFT JOIN best USING (page_id, bot)"


def _page_paths(spark, d):
    path = F.coalesce(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    return _table(spark, d, "pages").select("page_id", urls.origin(F.col("url")).alias("site"), path.alias("path"))


def _page_verdicts(spark, d, mode):
    files, bots = _robots(spark, d)
    paths = _page_paths(spark, d)
    return robots.path_verdicts(files, bots, paths, mode).join(paths, ["site", "path"]).select("page_id", "bot", "verdict", "matched_ua")


@query("robots_page_verdicts", f"""WITH {_robot_lines(_ROBOT_FILES)}, {_robot_verdicts(_BOTS).split(' fits AS')[0]} path AS (SELECT page_id, {_ORIGIN} AS site, {_PATH} AS path FROM pages),
 fits AS (SELECT page_id, name, kind, pattern FROM path JOIN rule USING (site) WHERE regexp_full_match(path, replace(regexp_escape(CASE WHEN ends_with(pattern, '$') THEN left(pattern, length(pattern) - 1) ELSE pattern || '*' END), '\\*', '.*'))),
 decided AS (SELECT page_id, name, max_by(kind, length(pattern) * 2 + cast(kind = 'allow' AS int)) AS kind FROM fits GROUP BY ALL),
 chosen AS (SELECT site, bot, arg_max(name, CASE WHEN name = '*' THEN 0 ELSE length(name) END) AS name, arg_max(ua, CASE WHEN name = '*' THEN 0 ELSE length(name) END) AS ua FROM (SELECT site, name, min(ua) AS ua FROM name GROUP BY ALL) JOIN bots ON name = '*' OR starts_with(lower(bot), name) GROUP BY ALL),
 best AS (SELECT page_id, bot, coalesce(kind, 'allow') AS kind, ua FROM path JOIN chosen USING (site) LEFT JOIN decided USING (page_id, name)) {_ONE_OF_BOTS}""")
def _(spark, d):
    """What each site's robots file says of each of its pages to each bot."""
    return _page_verdicts(spark, d, "rfc9309")


@query("robots_page_verdicts_file_order", f"""{_ROBOT_LINES}, bots AS (SELECT * FROM {_BOTS}), path AS (SELECT page_id, {_ORIGIN} AS site, {_PATH} AS path FROM pages),
 decided AS (SELECT page_id, site, ua, group_pos, max_by(kind, length(pattern) * 2 + cast(kind = 'allow' AS int)) AS kind FROM path JOIN rules USING (site) WHERE pattern <> '' AND starts_with(path, replace(pattern, '*', '')) GROUP BY ALL),
 best AS (SELECT page_id, bot, min_by(kind, group_pos) AS kind, min_by(ua, group_pos) AS ua FROM decided JOIN bots ON ua = '*' OR starts_with(lower(bot), lower(ua)) OR starts_with(lower(ua), lower(bot)) GROUP BY ALL) {_ONE_OF_BOTS}""")
def _(spark, d):
    return _page_verdicts(spark, d, "file_order")


# ---- source pool and plans --------------------------------------------------------------------------------------

_RESULTS = f"({D.RESULTS.format(pages='pages')})"
_WANTED = f"({D.WANTED.format(results=_RESULTS)})"


@query("source_pool_verdict", f"""WITH h AS (SELECT question, coalesce(title, '')[1:80] AS title, url[1:160] AS url, {_HOST} AS host FROM {_RESULTS} WHERE url <> ''), w AS (SELECT *, replace(lower(trim(domain)), 'www.', '') AS dom FROM {_WANTED}),
 f AS (SELECT w.question, w.brand, w.dom, w.source_status, count(h.url) AS n_results, coalesce(bool_or(w.brand <> '' AND contains(h.title || h.url, w.brand)), false) AS hit_brand, coalesce(bool_or(dom <> '' AND (host = dom OR ends_with(host, '.' || dom))), false) AS hit_domain FROM w LEFT JOIN h USING (question) GROUP BY ALL)
 SELECT question, n_results, hit_brand, hit_domain, CASE WHEN source_status <> 'ok' THEN 'source_unavailable' WHEN brand = '' AND dom = '' THEN 'not_asked' WHEN hit_domain THEN 'own_site_present' WHEN hit_brand THEN 'brand_mentioned' ELSE 'absent' END AS verdict FROM f""")
def _(spark, d):
    results = D.rows(spark, D.RESULTS, pages=_table(spark, d, "pages"))
    return pool.verdicts(results, D.rows(spark, D.WANTED.replace("({results})", "{results}"), results=results))


# Brands: the first two words of the titles of every tenth page, and of every tenth document, with a word that is nowhere.
_NORMAL = lambda t: f"' ' || trim(regexp_replace(lower(coalesce({t}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
_BRANDS = {"pages": "SELECT DISTINCT regexp_extract(html, '<title>([^ <]+ [^ <]+)', 1) AS brand FROM {t} WHERE page_id % 10 = 0 UNION SELECT 'Nowhere Inc' UNION SELECT '?!'",
           "documents": "SELECT DISTINCT regexp_extract(text, '^([^ ]+ [^ ]+)', 1) AS brand FROM {t} WHERE doc_id % 10 = 0 UNION SELECT 'Nowhere Inc' UNION SELECT '?!'"}


def _presence_sql(brands: str, texts: str) -> str:
    return f"""WITH t AS MATERIALIZED (SELECT key, host, {_NORMAL('text')} AS text FROM ({texts})), b AS MATERIALIZED (SELECT * FROM (SELECT brand, {_NORMAL('brand')} AS phrase FROM ({brands})) WHERE phrase <> '  ')
 SELECT brand, host, n_pages, round_even(cast(n_pages AS double) / n * 100, 1) AS share FROM (SELECT brand, host, count(*) AS n_pages FROM t JOIN b ON contains(text, phrase) GROUP BY ALL) JOIN (SELECT host, count(*) AS n FROM t GROUP BY host) USING (host)"""


@query("brand_presence_pages", _presence_sql(_BRANDS["pages"].format(t="pages"), f"SELECT page_id AS key, {_HOST} AS host, html AS text FROM pages"))
def _(spark, d):
    """Brands in the markup of pages, by host."""
    pages = _table(spark, d, "pages")
    texts = pages.select(F.col("page_id").alias("key"), urls.host(F.col("url")).alias("host"), F.col("html").alias("text"))
    return presence.presence(texts, D.rows(spark, _BRANDS["pages"].replace("{t}", "{pages}"), pages=pages))


@query("brand_presence_documents", _presence_sql(_BRANDS["documents"].format(t="documents"), "SELECT doc_id AS key, source AS host, text FROM documents"))
def _(spark, d):
    docs = _table(spark, d, "documents")
    texts = docs.select(F.col("doc_id").alias("key"), F.col("source").alias("host"), "text")
    return presence.presence(texts, D.rows(spark, _BRANDS["documents"].replace("{t}", "{documents}"), documents=docs))


_ADVICE = S.values_sql([(c.key, c.layer, c.weight, c.title, c.advice) for c in checks.CHECKS], "id, layer, weight, title, advice")
# A request for each page: what its checks found wrong, and an id that no check has; every ninth asks for nothing.
_REQUESTS = f"({_CHECKS} SELECT cast(page_id AS varchar) AS request, CASE WHEN page_id % 9 = 4 THEN ' , ' ELSE concat('u', page_id, '，', replace(string_agg(check_id, ',' ORDER BY check_pos), ',', CASE WHEN page_id % 2 = 0 THEN ',' ELSE ' ' END)) END AS ids FROM checks WHERE status IN ('warn', 'fail') GROUP BY page_id)"
_TARGETS = f"SELECT request, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos FROM (SELECT request, list_filter(regexp_split_to_array(ids, '[,，\\s]+'), lambda s: s <> '')[1:8] AS ids FROM {_REQUESTS})"


def _requests(spark, d):
    found = audit.page_checks(_table(spark, d, "pages")).where(F.col("status").isin("warn", "fail")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("check_pos", "check_id"))).alias("c"))
    ids = F.concat(F.lit("u"), F.col("page_id"), F.lit("，"), F.when(F.col("page_id") % 2 == 0, F.array_join("c.check_id", ",")).otherwise(F.array_join("c.check_id", " ")))
    return found.select(F.col("page_id").cast("string").alias("request"), F.when(F.col("page_id") % 9 == 4, " , ").otherwise(ids).alias("ids"))


@query("fix_plan", f"SELECT request, cast(row_number() OVER (PARTITION BY request ORDER BY weight DESC, pos) AS int) AS place, id, layer, weight, title, advice FROM ({_TARGETS}) JOIN {_ADVICE} USING (id)")
def _(spark, d):
    return planning.plan(_requests(spark, d), planning.catalog(spark))


@query("unknown_fix_ids", f"SELECT request, cast(pos AS int) AS pos, id FROM ({_TARGETS}) t ANTI JOIN {_ADVICE} a USING (id)")
def _(spark, d):
    return planning.unknown(_requests(spark, d), planning.catalog(spark))


@query("fix_plan_outcome", f"SELECT request, NOT none AS ok, CASE WHEN none THEN 'no_targets' END AS error FROM (SELECT request, len(list_filter(regexp_split_to_array(ids, '[,，\\s]+'), lambda s: s <> '')) = 0 AS none FROM {_REQUESTS})")
def _(spark, d):
    return planning.outcome(_requests(spark, d))


# ---- answers ----------------------------------------------------------------------------------------------------

_ROLES, _FACT_POINTS, _BASELINE = ("independent", "joint", "citation_only", "none"), 6, 50
_DOC_SAMPLES = f"SELECT doc_id AS pos, source AS question, lang AS platform, {S.literal(_ROLES)}[doc_id % 4 + 1] AS role, CASE toxic WHEN 1 THEN 'negative' WHEN 0 THEN 'positive' END AS sentiment, CASE quality WHEN 1 THEN 'accurate' WHEN 0 THEN 'wrong' ELSE 'unverifiable' END AS facts, ['f' || doc_id % 5] AS facts_found, text AS answer FROM documents LEFT JOIN labels USING (doc_id)"
_INLINE_SAMPLES = D.answers_sql()
_MENTION = "coalesce(nullif(role, ''), 'none') <> 'none'"
_WEIGHT = "CASE role WHEN 'independent' THEN 1.0 WHEN 'joint' THEN 0.6 WHEN 'citation_only' THEN 0.25 ELSE 0.0 END::double"
_PCT = lambda part, whole: f"round_even(cast({part} AS double) / nullif({whole}, 0) * 100, 1)"


def _doc_samples(spark, d):
    docs = _table(spark, d, "documents").join(_table(spark, d, "labels"), "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("pos"), F.col("source").alias("question"), F.col("lang").alias("platform"), F.element_at(F.array(*map(F.lit, _ROLES)), (F.col("doc_id") % 4 + 1).cast("int")).alias("role"),
        F.when(F.col("toxic") == 1, "negative").when(F.col("toxic") == 0, "positive").alias("sentiment"), F.when(F.col("quality") == 1, "accurate").when(F.col("quality") == 0, "wrong").otherwise("unverifiable").alias("facts"),
        F.array(F.concat(F.lit("f"), F.col("doc_id") % 5)).alias("facts_found"), F.col("text").alias("answer"),
    )


def _inline_samples(spark, d):
    return D.answers(spark, _table(spark, d, "conversations"), _table(spark, d, "pages"))


def _indicators_sql(rows: str, points: int, base: int) -> str:
    return f"""WITH s AS ({rows}) SELECT n, {_PCT('(SELECT count(DISTINCT fact) FROM (SELECT unnest(facts_found) AS fact FROM s))', points)} AS coverage, {_PCT('m', 'n')} AS mention_share, {_PCT('acc', 'judged')} AS accuracy, coalesce({_PCT('pos_', 'm')}, 0.0) AS positive_share, {_PCT(f'{base} - neg', base)} AS negative_reduction, {_PCT('roles', 'n')} AS role_score
 FROM (SELECT count(*) AS n, count(*) FILTER ({_MENTION}) AS m, count(*) FILTER ({_MENTION} AND sentiment = 'positive') AS pos_, count(*) FILTER ({_MENTION} AND sentiment = 'negative') AS neg, count(*) FILTER ({_MENTION} AND facts = 'accurate') AS acc, count(*) FILTER ({_MENTION} AND facts IN ('accurate', 'partial', 'wrong')) AS judged, sum({_WEIGHT}) AS roles FROM s)"""


_PLATFORM_SQL = f"SELECT platform, n, mentions, {_PCT('mentions', 'n')} AS mention_share, {_PCT('roles', 'n')} AS role_score FROM (SELECT coalesce(nullif(platform, ''), 'unlabelled') AS platform, count(*) AS n, count(*) FILTER ({_MENTION}) AS mentions, sum({_WEIGHT}) AS roles FROM ({{}}) GROUP BY 1)"
_RUNS_SQL = "SELECT min(n) AS min_runs, max(n) AS max_runs, count(*) AS questions FROM (SELECT coalesce(nullif(question, ''), '-') AS question, count(*) AS n FROM ({}) GROUP BY 1)"
_STRIP = lambda t: f"regexp_replace({t}, {_q(P.EDGES)}, '', 'g')"
_EXCERPT_SQL = "SELECT pos, question, platform, role, " + _STRIP("CASE WHEN at_ > 0 THEN substring(answer, greatest(at_ - 60, 1), at_ + 140 - greatest(at_ - 60, 1)) ELSE answer[1:160] END") + " AS excerpt FROM (SELECT *, instr(answer, @brand@) AS at_ FROM (SELECT * REPLACE (coalesce(answer, '') AS answer) FROM (@rows@) WHERE " + _MENTION + ") ORDER BY pos LIMIT 8)"
_CITED = P.CITED_URL.replace("'", "''")


@query("visibility_indicators", _indicators_sql(_DOC_SAMPLES, _FACT_POINTS, _BASELINE))
def _(spark, d):
    return visibility.indicators(_doc_samples(spark, d), _FACT_POINTS, _BASELINE)


@query("visibility_by_platform", _PLATFORM_SQL.format(_DOC_SAMPLES))
def _(spark, d):
    return visibility.by_platform(_doc_samples(spark, d))


@query("runs_per_question", _RUNS_SQL.format(_DOC_SAMPLES))
def _(spark, d):
    return visibility.runs_per_question(_doc_samples(spark, d))


@query("visibility_excerpts", _EXCERPT_SQL.replace("@brand@", "'the'").replace("@rows@", _DOC_SAMPLES))
def _(spark, d):
    return visibility.excerpts(_doc_samples(spark, d), "the")


@query("visibility_claims", f"SELECT pos, cast(i - 1 AS int) AS place, claim FROM (SELECT pos, i, {_STRIP('c')} AS claim FROM (SELECT pos, unnest(found) AS c, generate_subscripts(found, 1) AS i FROM (SELECT doc_id AS pos, regexp_extract_all(text, {_q(P.CLAIM)}) AS found FROM documents))) WHERE length(claim) BETWEEN 1 AND 59")
def _(spark, d):
    return visibility.claims(_doc_samples(spark, d))


@query("sample_indicators", _indicators_sql(_INLINE_SAMPLES, 3, 2))
def _(spark, d):
    return visibility.indicators(_inline_samples(spark, d), 3, 2)


@query("sample_by_platform", _PLATFORM_SQL.format(_INLINE_SAMPLES))
def _(spark, d):
    return visibility.by_platform(_inline_samples(spark, d))


@query("sample_excerpts", _EXCERPT_SQL.replace("@brand@", "'Acme'").replace("@rows@", _INLINE_SAMPLES))
def _(spark, d):
    return visibility.excerpts(_inline_samples(spark, d), "Acme")


@query("sample_claims", f"SELECT pos, cast(i - 1 AS int) AS place, claim FROM (SELECT pos, i, {_STRIP('c')} AS claim FROM (SELECT pos, unnest(found) AS c, generate_subscripts(found, 1) AS i FROM (SELECT pos, regexp_extract_all(answer, {_q(P.CLAIM)}) AS found FROM ({_INLINE_SAMPLES})))) WHERE length(claim) BETWEEN 1 AND 59")
def _(spark, d):
    return visibility.claims(_inline_samples(spark, d))


@query("cited_urls", f"SELECT pos, cast(i - 1 AS int) AS place, url FROM (SELECT pos, unnest(found) AS url, generate_subscripts(found, 1) AS i FROM (SELECT pos, regexp_extract_all(answer, '{_CITED}')[1:5] AS found FROM ({_INLINE_SAMPLES})))")
def _(spark, d):
    return visibility.cited_urls(_inline_samples(spark, d))


@query("citation_checks", f"SELECT pos, place, c.url, coalesce(status, 0) AS status, CASE WHEN status = 200 THEN 'verified' WHEN status > 0 THEN 'unreachable' ELSE 'error' END AS verdict FROM (SELECT pos, cast(i - 1 AS int) AS place, url FROM (SELECT pos, unnest(found) AS url, generate_subscripts(found, 1) AS i FROM (SELECT pos, regexp_extract_all(answer, '{_CITED}')[1:5] AS found FROM ({_INLINE_SAMPLES})))) c LEFT JOIN (SELECT url, status FROM {_FETCHES} WHERE ua = 'default') f USING (url)")
def _(spark, d):
    return visibility.citation_checks(_inline_samples(spark, d), _fetches(spark, d))


# ---- observations -----------------------------------------------------------------------------------------------

_OBS = "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id AS seq, cast(user_id AS varchar) AS identity, event_type AS kind, 'default' AS series, value / 1000 AS value, cast(props ->> '$.k' AS int) AS n, 'src' || event_id % 3 AS source FROM events"


def _observations(spark, d):
    e = _table(spark, d, "events")
    return e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("identity"), F.col("event_type").alias("kind"), F.lit("default").alias("series"), (F.col("value") / 1000).alias("value"), F.get_json_object("props", "$.k").cast("int").alias("n"), F.concat(F.lit("src"), F.col("event_id") % 3).alias("source"))


_W = "OVER (PARTITION BY identity, kind, series ORDER BY ts, seq)"
_PART = {p: history.classify_sql("previous_value", "current_value", "n", "round_even", p) for p in history.PARTS}
_CHANGES = f"SELECT identity, kind, series, comparable, previous_value, previous_ts, current_value, current_ts, n, source, " + ", ".join(f"CASE WHEN comparable THEN {_PART[p]} END AS {p}" for p in history.PARTS) + f" FROM (SELECT identity, kind, series, n, source, value AS current_value, ts AS current_ts, lag(value) {_W} AS previous_value, lag(ts) {_W} AS previous_ts, row_number() {_W} > 1 AS comparable, row_number() OVER (PARTITION BY identity, kind, series ORDER BY ts DESC, seq DESC) AS back FROM ({{}})) WHERE back = 1"
_FRESH = "SELECT concat_ws('|', identity, kind, series) AS dedup_key, identity, kind, series, previous_value, previous_ts, current_value, current_ts, change AS change_value, ratio AS change_ratio, direction, severity, n, source, '{as_of}' AS detected_at FROM ({changes}) WHERE comparable AND NOT (direction = 'flat' AND severity = 'flat')"


@query("obs_history", f"SELECT identity, kind, series, count(*) AS points, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(value, (ts, seq)) AS latest_value, arg_max(n, (ts, seq)) AS latest_n, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, arg_max(n, (ts, seq)) < {P.MIN_N} AS low_n FROM ({_OBS}) GROUP BY ALL")
def _(spark, d):
    return history.history(_observations(spark, d))


@query("obs_last_points", f"SELECT identity, kind, series, ts, value, n, place FROM (SELECT *, cast(row_number() OVER (PARTITION BY identity, kind, series ORDER BY ts DESC, seq DESC) AS int) AS place FROM ({_OBS})) WHERE place <= 3")
def _(spark, d):
    return history.last_points(_observations(spark, d), 3).select(*history.KEYS, "ts", "value", "n", "place")


@query("obs_changes", _CHANGES.format(_OBS))
def _(spark, d):
    return history.changes(_observations(spark, d))


@query("obs_signals", _FRESH.format(as_of="t", changes=_CHANGES.format(_OBS)))
def _(spark, d):
    return history.fresh_signals(_observations(spark, d), F.lit("t"))


_EARLY = f"SELECT * FROM ({_OBS}) WHERE seq % 10 < 6"
_LIFE = f"WITH old AS ({_FRESH.format(as_of='t1', changes=_CHANGES.format(_EARLY))}), new AS ({_FRESH.format(as_of='t2', changes=_CHANGES.format(_OBS))}) SELECT n.*, NULL::varchar AS resolved_at, coalesce(o.detected_at, n.detected_at) AS first_seen FROM new n LEFT JOIN old o USING (dedup_key) UNION ALL SELECT o.*, 't2', o.detected_at FROM old o ANTI JOIN new n USING (dedup_key)"


def _lifecycle(spark, d):
    obs = _observations(spark, d)
    old = history.recomputed(obs.where("seq % 10 < 6"), None, F.lit("t1"))
    return history.recomputed(obs, old, F.lit("t2"))


@query("signals_lifecycle", _LIFE)
def _(spark, d):
    return _lifecycle(spark, d)


@query("signals_open", f"SELECT dedup_key, severity, first_seen FROM ({_LIFE}) WHERE resolved_at IS NULL ORDER BY first_seen DESC, dedup_key DESC LIMIT 50")
def _(spark, d):
    return history.listed(_lifecycle(spark, d)).select("dedup_key", "severity", "first_seen")


_CASES = f"({D.CHANGES.format(events='events')})"


@query("change_classes", "SELECT id, " + ", ".join(f"{_PART[p]} AS {p}" for p in history.PARTS) + f" FROM {_CASES}")
def _(spark, d):
    rows = D.rows(spark, D.CHANGES, events=_table(spark, d, "events"))
    return rows.select("id", *[F.expr(history.classify_sql("previous_value", "current_value", "n", what=p)).alias(p) for p in history.PARTS])


_RUN = {"run_id": "r1", "ts": "2026-03-01", "source": "cli", "series": "weekly", "note": ""}
_OBSERVED = f"({D.OBSERVED.format(events='events')})"


def _observed(spark, d):
    rows = D.rows(spark, D.OBSERVED, events=_table(spark, d, "events"))
    return rows.withColumns({"unit": F.lit(None).cast("string"), "note": F.lit(None).cast("string")})


@query("ingest_rows", f"SELECT coalesce(nullif(ts, ''), '2026-03-01') AS ts, 'r1' AS run_id, identity, kind, coalesce(nullif(series, ''), 'weekly') AS series, cast(value AS double) AS value, 'ratio' AS unit, coalesce(n, -1) AS n, coalesce(nullif(source, ''), 'cli') AS source, '' AS note FROM {_OBSERVED} WHERE coalesce(identity, '') <> '' AND coalesce(kind, '') <> '' AND value IS NOT NULL")
def _(spark, d):
    return history.ingest(_observed(spark, d), _RUN)[0].fillna({"n": -1})


@query("ingest_run", f"SELECT 'r1' AS run_id, '2026-03-01' AS ts, 'cli' AS source, 'weekly' AS series, '' AS note, count(*) FILTER (ok) AS recorded, count(*) FILTER (NOT ok) AS skipped FROM (SELECT coalesce(identity, '') <> '' AND coalesce(kind, '') <> '' AND value IS NOT NULL AS ok FROM {_OBSERVED})")
def _(spark, d):
    return history.ingest(_observed(spark, d), _RUN)[1]


@query("jsonl_tolerant", f"SELECT value ->> '$.identity' AS identity, value ->> '$.kind' AS kind, try_cast(value ->> '$.value' AS double) AS value, coalesce(try_cast(value ->> '$.n' AS int), -1) AS n FROM (SELECT CASE WHEN json_valid(line) THEN line::json END AS value FROM ({D.LINES.format(events='events')})) WHERE json_type(value) = 'OBJECT'")
def _(spark, d):
    return jsonl.parse_lines(D.rows(spark, D.LINES, events=_table(spark, d, "events")).withColumnRenamed("line", "value"), "identity string, kind string, value double, n int").fillna({"n": -1})


# ---- provenance -------------------------------------------------------------------------------------------------


@query("trace_ids", "SELECT doc_id, left(sha256(concat_ws('|', 'v1', cast(doc_id AS varchar), coalesce(lang, 'None'))), 16) AS trace_id, left(sha256(concat_ws('|', 'salt', 'v1', cast(doc_id AS varchar), lang)), 8) AS code FROM documents")
def _(spark, d):
    docs = _table(spark, d, "documents")
    return docs.select("doc_id", provenance.trace_id(F.col("doc_id"), F.col("lang"), version="v1").alias("trace_id"), provenance.fingerprint(F.col("doc_id"), F.col("lang"), salt="salt", version="v1").alias("code"))


@query("mark_roundtrip", "SELECT doc_id, left(sha256(concat_ws('|', 'salt', 'v1', cast(doc_id AS varchar))), 8) AS found, cast(length(text) + 34 AS bigint) AS marked_chars, true AS restored, true AS again_same FROM documents")
def _(spark, d):
    code = provenance.fingerprint(F.col("doc_id"), salt="salt", version="v1")
    marked = _table(spark, d, "documents").select("doc_id", "text", code.alias("code"), provenance.embedded(F.col("text"), code).alias("marked"))
    return marked.select("doc_id", provenance.extracted(F.col("marked")).alias("found"), F.length("marked").cast("long").alias("marked_chars"), (provenance.stripped(F.col("marked")) == F.col("text")).alias("restored"), (provenance.embedded(F.col("marked"), F.lit("00000000")) == F.col("marked")).alias("again_same"))
