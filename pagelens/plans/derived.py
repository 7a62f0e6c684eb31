"""Inputs of the site audit made of the tables at hand: pages with richer markup, a crawl of their sites, answers with links.

The tables hold bare pages, so what an audit looks at beyond them (robots files, sitemaps, bots that are turned away,
dead links, structured data) is derived, by arithmetic on ids and lengths, from every page and every site: the inputs grow
with the tables, and plans over them can be measured. Each is one SELECT that Spark and DuckDB read alike, so both sides
of a comparison start from equal rows; ``{name}`` stands for a relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelens.plans import samples as S

NEWLINE = "\n"
_ORIGIN = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_SAMPLES = [(n, p[2] or "") for n, p in enumerate(S.PAGES)]
_ROBOTS = [(n, body) for n, (_, body) in enumerate(S.ROBOTS)]
_MAPS = [(n, body) for n, (_, body) in enumerate(S.SITEMAPS)]
_ANSWERS = [(n, *a[3:]) for n, a in enumerate(S.ANSWERS)]

#: Pages with the markup of one of the sample pages before their own; every fourth names a preview image.
RICH = f"""SELECT p.page_id, p.url, {_ORIGIN.replace('url', 'p.url')} AS origin,
 concat(CASE WHEN p.page_id % 4 = 0 THEN concat('<meta property="og:image" content="/og/', cast(p.page_id AS varchar(20)), '.png">') ELSE '' END, coalesce(s.html, ''), coalesce(p.html, ''), CASE p.page_id % 3 WHEN 0 THEN '<a class="x" href="../up/./to.html#part">up</a><a href="?page=2">next</a><a href="mailto:a@b.example">mail</a>' WHEN 1 THEN concat('<a href="//www.example.org/', cast(p.page_id % 10 AS varchar(9)), '">out</a><a href="#top">top</a><a href="deep/er/">down</a>') ELSE '' END) AS html
 FROM {{pages}} p LEFT JOIN {{samples}} s ON s.n = p.page_id % {len(_SAMPLES) + 1}"""

_FOLDER = "regexp_extract(o.first, '^[a-z]+://[^/]*(/[a-z]+/)', 1)"

#: (site, first, last, n_pages, robots, sitemap): one row for each site. Its robots file is one of the samples with rules for the
#: folder of its first page, its sitemap names its first and last page.
SITES = f"""SELECT o.site, o.first, o.last, o.n_pages,
 CASE length(o.first) % 4 WHEN 0 THEN r.body WHEN 1 THEN concat(r.body, '{NEWLINE}User-agent: *{NEWLINE}Disallow: ', {_FOLDER}, '{NEWLINE}Allow: ', {_FOLDER}, '1{NEWLINE}Allow: ', {_FOLDER}, '*html$')
  WHEN 2 THEN concat('User-agent: Googlebot{NEWLINE}User-agent: Bytespider{NEWLINE}Disallow: ', {_FOLDER}, '9{NEWLINE}Disallow: /*?{NEWLINE}Allow: ', {_FOLDER}, '*page={NEWLINE}', r.body) ELSE concat(r.body, '{NEWLINE}User-agent: GPTBot{NEWLINE}Disallow: ', {_FOLDER}, '*/$') END AS robots,
 concat(coalesce(m.body, ''), '<url><loc>', o.first, '</loc><lastmod>202', cast(4 + length(o.site) % 3 AS varchar(9)), '-02-0', cast(1 + length(o.first) % 9 AS varchar(9)), '</lastmod></url><url><loc> ', o.last, ' </loc></url>') AS sitemap
 FROM (SELECT origin AS site, min(url) AS first, max(url) AS last, count(*) AS n_pages FROM {{rich}} GROUP BY origin) o
 LEFT JOIN {{robots}} r ON r.n = (length(o.site) + o.n_pages) % {len(_ROBOTS)} LEFT JOIN {{maps}} m ON m.n = length(o.site) % {len(_MAPS) + 1}"""

_ROW = "url, ua, status, content_type, body, final_url, hops, error"
_APEX = "regexp_replace(lower(regexp_extract(site, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[.]', '')"
_file = lambda name, ok, body: f"SELECT concat(site, '/{name}'), 'default', CASE WHEN {ok} THEN 200 WHEN length(site) % 2 = 0 THEN 503 ELSE 404 END, 'text/plain', {body}, concat(site, '/{name}'), 0, NULL FROM {{sites}} WHERE n_pages % 7 <> 6"
_variant = lambda prefix, k: f"SELECT concat('{prefix}', apex), 'default', CASE WHEN length(apex) % 5 = {k} THEN 404 ELSE 200 END, 'text/html', '', concat('https://', CASE WHEN length(apex) % 3 = 0 THEN 'www.' ELSE '' END, apex, '/'), {k}, NULL FROM (SELECT DISTINCT {_APEX} AS apex FROM {{sites}})"

#: A fetch of every page by browser and bot (some again, with a worse outcome), of every site's files, of its names with and
#: without www, of the pages its sitemap names, of the preview images, and of the links that stand in pages.
FETCHES = " UNION ALL ".join([
    "SELECT url, 'default' AS ua, CASE WHEN page_id % 11 = 5 THEN 404 WHEN page_id % 13 = 7 THEN 0 ELSE 200 END AS status, 'text/html' AS content_type, html AS body, url AS final_url, cast(page_id % 4 AS int) AS hops, CASE WHEN page_id % 13 = 7 AND page_id % 11 <> 5 THEN 'timeout' END AS error FROM {rich}",
    "SELECT url, 'bot', CASE WHEN page_id % 7 = 2 THEN 403 WHEN page_id % 17 = 3 THEN 0 ELSE 200 END, 'text/html', '', url, 0, NULL FROM {rich}",
    "SELECT url, 'default', 500, 'text/html', 'worse', url, 5, 'again' FROM {rich} WHERE page_id % 10 = 3 AND page_id % 13 <> 7 AND page_id % 11 <> 5",
    _file("robots.txt", "length(site) % 6 <> 1", "robots"), _file("sitemap.xml", "length(site) % 5 <> 2", "sitemap"), _file("llms.txt", "n_pages % 3 = 0", "'x'"), _file("rss.xml", "n_pages % 2 = 0", "'x'"),
    *(_variant(p, k) for k, p in enumerate(("http://", "https://", "http://www.", "https://www."))),
    "SELECT first, 'sitemap', CASE WHEN length(first) % 4 = 0 THEN 404 ELSE 200 END, 'text/html', '', first, 0, NULL FROM {sites}",
    "SELECT last, 'sitemap', 200, 'text/html', '', last, 0, NULL FROM {sites} WHERE last <> first",
    "SELECT concat(origin, '/og/', cast(page_id AS varchar(20)), '.png'), 'default', CASE WHEN page_id % 12 = 8 THEN 404 ELSE 200 END, CASE WHEN page_id % 3 = 0 THEN 'image/png' END, CASE WHEN page_id % 8 = 0 THEN repeat('p', 1200) ELSE 'p' END, NULL, 0, NULL FROM {rich} WHERE page_id % 4 = 0",
    """SELECT concat(origin, link), 'default', CASE WHEN length(link) % 5 = 0 THEN 404 WHEN length(link) % 7 = 0 THEN 0 ELSE 200 END, 'text/html', '', concat(origin, link), 0, NULL FROM (SELECT origin, regexp_extract(html, '<a href="(/[^/"][^"]*)"', 1) AS link FROM {rich}) WHERE link <> ''""",
])

#: Answers as a study holds them: what was said, a sample answer before it, and the page of the conversation's number cited.
ANSWERS = f"""SELECT c.conv_id * 1000 + c.turn AS pos, concat('q', cast(c.conv_id % 9 AS varchar(9))) AS question, c.role AS platform, a.role, a.sentiment, a.facts, a.facts_found,
 concat(coalesce(a.answer, ''), ' ', coalesce(c.text, ''), CASE WHEN p.url IS NOT NULL THEN concat(' ', p.url) ELSE '' END) AS answer
 FROM {{conversations}} c LEFT JOIN {{pages}} p ON p.page_id = c.conv_id LEFT JOIN {{answers}} a ON a.n = (c.conv_id + c.turn) % {len(_ANSWERS) + 1}"""

#: Results of seven questions and what is asked of them: the pages, by turns.
RESULTS = "SELECT concat('q', cast(page_id % 7 AS varchar(9))) AS question, page_id AS pos, regexp_extract(html, '<title>([^<]*)', 1) AS title, url FROM {pages}"
WANTED = """SELECT question, CASE WHEN question < 'q4' THEN left(min(title), 12) ELSE '' END AS brand, CASE WHEN question IN ('q1', 'q4') THEN concat('www.', regexp_extract(min(url), '^[a-z]+://([^/]*)', 1)) WHEN question = 'q2' THEN 'absent.example' ELSE '' END AS domain,
 CASE WHEN question = 'q6' THEN 'timeout' ELSE 'ok' END AS source_status FROM ({results}) GROUP BY question UNION ALL SELECT 'q9', 'Acme', 'acme.example', 'ok'"""

#: Recordings as they arrive, some rows of them without what they need; lines of JSON, some of them broken; changes to class.
OBSERVED = """SELECT CASE WHEN event_id % 6 = 0 THEN NULL ELSE cast(cast(ts AS date) AS varchar(20)) END AS ts, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 11 = 0 THEN NULL ELSE cast(user_id AS varchar(20)) END AS identity,
 CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS kind, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 's' END AS series, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE cast(event_id % 40 AS int) END AS n, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'feed' END AS source FROM {events}"""
LINES = """SELECT CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'not json' WHEN 2 THEN props WHEN 3 THEN '[1,2]' WHEN 4 THEN concat('{{"identity":"', cast(user_id AS varchar(20)), '","kind":"', event_type, '","value":"0.5","n":"', cast(event_id % 30 AS varchar(9)), '"}}')
 WHEN 5 THEN concat('{{"identity":"', cast(user_id AS varchar(20)), '","value":null,"extra":1}}') WHEN 6 THEN '"text"' ELSE concat(' {{"identity":"u', cast(user_id AS varchar(20)), '","kind":7,"value":', cast(event_id % 100 AS varchar(9)), ',"n":', cast(event_id % 9 AS varchar(9)), '}} ') END AS line FROM {events}"""
CHANGES = "SELECT event_id AS id, CASE WHEN event_id % 23 = 0 THEN 'x' ELSE concat(cast(user_id % 50 AS varchar(9)), 'e-2') END AS previous_value, concat(cast(event_id % 50 AS varchar(9)), 'e-2') AS current_value, CASE WHEN event_id % 19 = 0 THEN NULL ELSE cast(event_id % 40 AS varchar(9)) END AS n FROM {events}"

_ANSWER_ROW = "n int, role string, sentiment string, facts string, facts_found array<string>, answer string"


def _names(schema: str) -> str:
    return ", ".join(c.split()[0] for c in schema.split(", "))


def rich_sql() -> str:
    return RICH.format(pages="pages", samples=S.values_sql(_SAMPLES, "n, html"))


def sites_sql(rich: str = "") -> str:
    return SITES.format(rich=rich or f"({rich_sql()})", robots=S.values_sql(_ROBOTS, "n, body"), maps=S.values_sql(_MAPS, "n, body"))


def fetches_sql() -> str:
    """One relation (url, ua, status, content_type, body, final_url, hops, error)."""
    return f"(WITH rich AS MATERIALIZED ({rich_sql()}), sites AS MATERIALIZED ({sites_sql('rich')}) {FETCHES.format(rich='rich', sites='sites')})"


def answers_sql() -> str:
    return ANSWERS.format(conversations="conversations", pages="pages", answers=S.values_sql(_ANSWERS, _names(_ANSWER_ROW)))


def _spark(text: str) -> str:
    return text.replace("AS varchar(20)", "AS string").replace("AS varchar(9)", "AS string")


def rows(spark: SparkSession, text: str, **relations: DataFrame) -> DataFrame:
    """One of the texts above over DataFrames."""
    return spark.sql(_spark(text), **relations)


def rich_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, origin, html) for every page."""
    return rows(spark, RICH, pages=pages, samples=S.frame(spark, _SAMPLES, "n int, html string"))


def sites(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(site, first, last, n_pages, robots, sitemap) for every site of the pages."""
    return rows(spark, SITES, rich=rich_pages(spark, pages), robots=S.frame(spark, _ROBOTS, "n int, body string"), maps=S.frame(spark, _MAPS, "n int, body string"))


def crawl(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Fetches (url, ua, status, headers, body, final_url, hops, error) of the pages' sites."""
    from pyspark.sql import functions as F

    made = rows(spark, FETCHES, rich=rich_pages(spark, pages), sites=sites(spark, pages))
    return made.withColumn("headers", F.create_map(F.lit("content-TYPE"), "content_type")).drop("content_type")


def answers(spark: SparkSession, conversations: DataFrame, pages: DataFrame) -> DataFrame:
    """Samples of a visibility study (pos, question, platform, role, sentiment, facts, facts_found, answer)."""
    return rows(spark, ANSWERS, conversations=conversations, pages=pages, answers=S.frame(spark, _ANSWERS, _ANSWER_ROW))
