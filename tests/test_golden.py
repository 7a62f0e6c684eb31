"""Small literal inputs with cases that the tables lack, through the same functions as the queries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagelens.operators import checks, history, planning, pool, robots, signals, site, visibility
from pagelens.plans import audit
from pagelens.plans import samples as S
from pagelens.sources import jsonl


def test_sample_pages(spark):
    duckdb = pytest.importorskip("duckdb")
    sql = signals.signals_sql(S.values_sql(S.PAGES, "page_id, url, html"))
    pages = S.frame(spark, S.PAGES, "page_id int, url string, html string")
    want = duckdb.execute(f"WITH s AS ({sql}), s2 AS (SELECT *, 0 AS llms_status FROM s) {checks.results_sql('s2', checks.PAGE)}")
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, audit.page_checks(pages).select(*names).collect())) == sorted(want.fetchall())


def test_sample_robots(spark):
    files = S.frame(spark, S.ROBOTS, "site string, body string")
    bots = spark.createDataFrame([("Googlebot",), ("ClaudeBot",), ("Bytespider",)], "bot string")
    got = {(r["site"][0], r["bot"]): r["verdict"] for r in robots.verdicts(files, bots).collect()}
    deny = {k for k, v in got.items() if v == "deny"}
    assert deny == {("a", "Googlebot"), ("a", "ClaudeBot"), ("b", "Googlebot"), ("b", "ClaudeBot"), ("f", "ClaudeBot"), ("g", "ClaudeBot"), ("g", "Bytespider"), ("h", "ClaudeBot"), ("h", "Bytespider"), ("m", "ClaudeBot"), ("m", "Bytespider"), ("o", "Googlebot"), ("o", "ClaudeBot"), ("o", "Bytespider"), ("p", "Googlebot"), ("p", "ClaudeBot"), ("p", "Bytespider")}
    assert {k[0] for k, v in got.items() if v == "undeclared"} == {"e", "f", "k", "l", "n", "q"}
    declared = {r["site"][0]: r["n_declared"] for r in robots.declared(files, bots).collect()}
    assert declared["h"] == 1 and declared["b"] == 1 and declared["c"] == 0


def test_sample_sitemaps(spark):
    maps = S.frame(spark, S.SITEMAPS, "site string, body string")
    assert [(r["site"][0], r["pos"], r["cjk"]) for r in site.sitemap_entries(maps).orderBy("site", "pos").collect()] == [("a", 0, False), ("a", 1, True), ("a", 2, False), ("b", 0, True), ("b", 1, False)]
    assert {r["site"][0]: (r["n_lastmod"], r["last_mod"], r["last_year"]) for r in site.sitemap_freshness(maps).collect()} == {"a": (2, "2026-01-05", 2026), "b": (0, None, None), "c": (0, None, None)}


def test_sample_fetches(spark):
    fetches = S.frame(spark, S.FETCHES, "url string, ua string, status int, content_type string, body string, final_url string, hops int, error string")
    fetches = fetches.withColumn("headers", F.create_map(F.lit("content-TYPE"), "content_type")).drop("content_type")
    pages = S.frame(spark, S.SITES, "page_id int, url string")
    assert {r["page_id"]: (r["home_status"], r["bot_status"], r["blocked"]) for r in site.bot_access(pages, fetches).collect()} == {1: (200, 403, True), 2: (200, 0, False), 3: (0, 0, False), 4: (404, 0, False)}
    assert {r["page_id"]: (r["n_statuses"], r["n_hosts"], r["agree"]) for r in site.host_variants(pages, fetches).collect()} == {1: (1, 1, True), 2: (1, 2, False), 3: (1, 0, False), 4: (1, 0, False)}
    got = {r["page_id"]: r for r in site.site_signals(pages, fetches).collect()}
    assert [(got[k]["home_status"], got[k]["hops"], got[k]["bot_status"], got[k]["variants_agree"], got[k]["og_image_loads"]) for k in (1, 2, 3, 4)] == [(200, 0, 403, True, False), (200, 1, 0, False, True), (0, 0, 0, False, False), (404, 4, 0, False, True)]
    assert [(got[k]["robots_status"], got[k]["sitemap_status"], got[k]["llms_status"], got[k]["rss_status"], got[k]["n_locs"], got[k]["n_cjk_slugs"], got[k]["n_bad_locs"], got[k]["last_year"]) for k in (1, 2, 3, 4)] == [(200, 200, 200, 0, 3, 1, 2, 2026), (200, 200, 0, 200, 1, 0, 0, 2024), (0, 0, 0, 0, 0, 0, 0, None), (503, 0, 0, 0, 0, 0, 0, None)]


def test_sample_questions_and_requests(spark):
    results, wanted = S.frame(spark, S.RESULTS, "question string, pos int, title string, url string"), S.frame(spark, S.WANTED, "question string, brand string, domain string, source_status string")
    assert {r["question"]: r["verdict"] for r in pool.verdicts(results, wanted).collect()} == {"q1": "own_site_present", "q2": "brand_mentioned", "q3": "absent", "q4": "not_asked", "q5": "source_unavailable"}
    requests, catalog = S.frame(spark, S.REQUESTS, "request string, ids string"), planning.catalog(spark)
    assert [(r["request"], r["id"]) for r in planning.plan(requests, catalog).orderBy("request", "place").collect()] == [("r1", "robots"), ("r1", "title"), ("r1", "faq"), ("r2", "indexable"), ("r2", "sources"), ("r2", "canonical"), ("r2", "page_type")]
    assert [(r["request"], r["id"]) for r in planning.unknown(requests, catalog).orderBy("pos").collect()] == [("r2", "nothing"), ("r2", "unknown_too")]
    assert {r["request"]: r["error"] for r in planning.outcome(requests).collect()} == {"r1": None, "r2": None, "r3": "no_targets"}


def test_sample_answers_and_recordings(spark):
    rows = S.frame(spark, S.ANSWERS, "pos int, question string, platform string, role string, sentiment string, facts string, facts_found array<string>, answer string")
    r = visibility.indicators(rows, 3, 2).first()
    assert (r["n"], r["coverage"], r["mention_share"], r["accuracy"], r["positive_share"], r["negative_reduction"]) == (4, 66.7, 75.0, 50.0, 33.3, 50.0)
    assert [(r["pos"], r["place"], r["url"]) for r in visibility.cited_urls(rows).orderBy("pos", "place").collect()] == [(1, 0, "https://a.example/x"), (1, 1, "https://b.example/y")]
    observed = S.frame(spark, S.OBSERVED, "ts string, identity string, kind string, series string, value double, n int, source string").withColumns({"unit": F.lit(None).cast("string"), "note": F.lit(None).cast("string")})
    kept, run = history.ingest(observed, {"run_id": "r1", "ts": "2026-03-01", "source": "cli", "series": "weekly"})
    assert sorted((r["ts"], r["series"], r["source"]) for r in kept.collect()) == [("2026-01-01", "weekly", "cli"), ("2026-02-01", "weekly", "cli"), ("2026-03-01", "s", "cli")]
    assert (run.first()["recorded"], run.first()["skipped"]) == (3, 3)
    lines = jsonl.parse_lines(S.frame(spark, [(x,) for x in S.LINES], "value string"), "identity string, kind string, value double, n int")
    assert sorted(map(str, (tuple(r) for r in lines.collect()))) == sorted(map(str, [("acme", "mention", 0.25, 20), ("acme", "rank", 0.5, 7), ("b", None, None, None)]))
