from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagelens.operators import checks, history, robots, score, site, visibility
from pagelens.plans import audit, samples

BOTS = "bot string"


def verdict(spark, body, bot, mode):
    return tuple(robots.verdicts(spark.createDataFrame([("s", body)], "site string, body string"), spark.createDataFrame([(bot,)], BOTS), mode=mode).select("verdict", "matched_ua").first())


SHARED = "User-agent: *\nDisallow: /\n\nUser-agent: GPTBot\nUser-agent: Bytespider\nAllow: /\n"


@pytest.mark.parametrize(
    "body, bot, first, standard",
    [
        (SHARED, "Bytespider", ("deny", "*"), ("allow", "Bytespider")),
        (SHARED, "GPTBot", ("deny", "*"), ("allow", "GPTBot")),
        (SHARED, "Other", ("deny", "*"), ("deny", "*")),
        ("User-agent: Bytespider\nAllow: /\nUser-agent: *\nDisallow: /", "Bytespider", ("allow", "Bytespider"), ("allow", "Bytespider")),
        ("User-agent: *\nDisallow: /\nAllow: /", "x", ("allow", "*"), ("allow", "*")),
        # A group is chosen by its name; where none of its rules fits, the bot is let in.
        ("User-agent: *\nDisallow: /private", "x", ("undeclared", None), ("allow", "*")),
        ("User-agent: *\nDisallow:", "x", ("undeclared", None), ("allow", "*")),
        ("User-agent: *\nDisallow: /\nUser-agent: Googlebot\nDisallow:", "Googlebot", ("deny", "*"), ("allow", "Googlebot")),
        ("User-agent: *\nDisallow: /\nUser-agent: Googlebot\nDisallow: /private", "Googlebot", ("deny", "*"), ("allow", "Googlebot")),
        ("User-agent: *\nDisallow: /\nAllow: /$", "x", ("deny", "*"), ("allow", "*")),
        ("User-agent: *\nDisallow: /*?x\nDisallow: /_%", "x", ("undeclared", None), ("allow", "*")),
        ("User-agent: googlebot\nDisallow: /\nUser-agent: GoogleBot\nAllow: /", "Googlebot", ("deny", "googlebot"), ("allow", "GoogleBot")),
        ("User-agent: Google\nDisallow: /\nUser-agent: Googlebot\nAllow: /", "Googlebot", ("deny", "Google"), ("allow", "Googlebot")),
        ("User-agent: Googlebot\nDisallow: /", "x", ("undeclared", None), ("undeclared", None)),
        ("", "x", ("undeclared", None), ("undeclared", None)),
    ],
)
def test_robots(spark, body, bot, first, standard):
    assert verdict(spark, body, bot, "file_order") == first
    assert verdict(spark, body, bot, "rfc9309") == standard


def test_change_classes(spark):
    want = [
        ("up", "rise", 0.25, None), ("down", "sharp_drop", -0.25, -1.0), ("up", "rise_small", 0.02, 0.1), ("up", "low_n", 0.25, None), ("flat", "flat", 0.0, 0.0), ("up", "rise", 0.05, 0.2), ("up", "rise_small", 0.03, 0.3),
        ("up", "rise_small", 0.04, None), ("unknown", "uncomparable", None, None), ("flat", "low_n", 0.0, None), ("flat", "low_n", 0.0, 0.0), ("up", "rise", 0.3, 0.6), ("down", "low_n", -0.1, -0.2), ("down", "sharp_drop", -0.1, -0.2),
    ]
    rows = spark.createDataFrame([(n, *c) for n, c in enumerate(samples.CHANGES)], "id int, p string, c string, n string").orderBy("id")
    got = rows.select(*[F.expr(history.classify_sql("p", "c", "n", what=x)).alias(x) for x in history.PARTS]).collect()
    assert [tuple(r) for r in got] == want


def observations(spark, rows):
    return spark.createDataFrame([(*r, 20, "cli", k) for k, r in enumerate(rows)], "ts string, identity string, kind string, series string, value double, n int, source string, seq long")


def test_signal_lifecycle(spark):
    first = observations(spark, [("1", "a", "k", "s", 0.1), ("2", "a", "k", "s", 0.5), ("1", "b", "k", "s", 0.1), ("1", "c", "k", "s", 1.0), ("2", "c", "k", "s", 2.0)])
    one = history.recomputed(first, None, F.lit("t1"))
    assert {(r["identity"], r["severity"]) for r in one.collect()} == {("a", "rise"), ("c", "rise")}
    second = first.unionByName(observations(spark, [("3", "a", "k", "s", 0.5), ("3", "c", "k", "s", 1.0)]))
    two = history.recomputed(second, one, F.lit("t2"))
    assert {(r["identity"], r["severity"], r["first_seen"], r["resolved_at"]) for r in two.collect()} == {("a", "rise", "t1", "t2"), ("c", "sharp_drop", "t1", None)}
    assert {r["identity"] for r in history.recomputed(second, one, F.lit("t2"), resolve=False).collect()} == {"c"}
    assert history.listed(two, "resolved").count() == 1 and history.listed(two, "all").count() == 2 and history.listed(two).count() == 1
    three = history.recomputed(second, two, F.lit("t3"))
    assert {r["dedup_key"] for r in three.collect()} == {"a|k|s", "c|k|s"}


def test_points_are_ordered_by_the_time_they_name(spark):
    rows = observations(spark, [("2026-01-01T23:30:00-05:00", "a", "k", "s", 0.9), ("2026-01-02T01:00:00+00:00", "a", "k", "s", 0.1), ("odd", "a", "k", "s", 0.5)])
    (r,) = history.changes(rows).collect()
    assert (r["previous_value"], r["current_value"], r["severity"]) == (0.1, 0.9, "rise")
    (h,) = history.history(rows).collect()
    assert (h["first_ts"], h["last_ts"], h["latest_value"]) == ("odd", "2026-01-01T23:30:00-05:00", 0.9)
    assert [r["value"] for r in history.last_points(rows, 2).orderBy("place").collect()] == [0.9, 0.1]


def test_changes_of_a_long_series(spark):
    rows = observations(spark, [(f"2026-01-{1 + k % 28:02}", "a", "k", "s", float(k)) for k in range(500)])
    (r,) = history.changes(rows).collect()
    assert (r["previous_value"], r["current_value"]) == (475.0 - 28 + 0, 475.0) and r["comparable"]


def test_history_of_one_identity(spark):
    rows = observations(spark, [("2", "a", "k", "s", 2.0), ("1", "a", "k", "s", 1.0), ("1", "b", "k", "s", 9.0)])
    (r,) = history.history(history.selected(rows, identity="a", kind="k")).collect()
    assert (r["points"], r["first_ts"], r["last_ts"], r["latest_value"], r["low_n"]) == (2, "1", "2", 2.0, False)


@pytest.mark.parametrize("statuses, want", [(["ok", "ok"], (100, "A")), (["warn", "warn"], (50, "D")), (["fail", "fail"], (0, "F")), (["ok", "fail"], (75, "B"))])
def test_scores(spark, statuses, want):
    rows = [(1, n, f"c{n}", "l", (3, 1)[n], s) for n, s in enumerate(statuses)]
    r = score.page_scores(spark.createDataFrame(rows, "page_id int, check_pos int, check_id string, layer string, weight int, status string")).first()
    assert (r["score"], r["grade"]) == want


def test_half_even_score(spark):
    rows = [(1, n, f"c{n}", "l", w, s) for n, (w, s) in enumerate([(5, "ok"), (3, "fail"), (0, "info")])]
    r = score.page_scores(spark.createDataFrame(rows, "page_id int, check_pos int, check_id string, layer string, weight int, status string")).first()
    assert (r["score"], r["grade"]) == (62, "C")


def test_compare(spark):
    rows = [(1, 0, "x", "l", 2, "ok"), (2, 0, "x", "l", 2, "warn"), (1, 1, "y", "l", 2, "fail"), (2, 2, "z", "l", 2, "ok"), (1, 3, "w", "l", 0, "ok")]
    long = spark.createDataFrame(rows, "page_id int, check_pos int, check_id string, layer string, weight int, status string")
    pairs = spark.createDataFrame([(1, 2)], "a int, b int")
    got = sorted(tuple(r)[2:] for r in score.compare(pairs, long).collect())
    assert got == [("x", "ok", "warn", "A"), ("z", "missing", "ok", "B")]
    same = spark.createDataFrame([(1, 50), (2, 50)], "page_id int, score long")
    assert tuple(score.compare_scores(pairs, same).first())[-2:] == ("A", 0)


# Every check in the order in which it is reported, with its layer and weight.
ORDER = """status crawl 3, redirects crawl 2, robots crawl 3, bot_access crawl 3, text_present crawl 3, ascii_slugs crawl 2, title parse 3, description parse 3, headings parse 2,
structured_data parse 3, language parse 2, canonical parse 2, questions cite 3, conclusion_first cite 3, facts cite 2, faq cite 2, dated cite 2, entity entity 2, same_as entity 2, about entity 2,
sitemap reach 3, sitemap_sample reach 3, llms_txt reach 0, feed reach 2, author trust 2, sources trust 3, open_data trust 2, indexable crawl 3, robots_health crawl 3, host_variants parse 2,
og_image parse 1, structures cite 2, substance cite 2, self_contained cite 2, image_alt cite 1, entity_name entity 2, platforms entity 2, citation_strength cite 2, access_files reach 0,
freshness reach 2, page_type trust 0, manual_review trust 0"""


def test_order_and_weights_of_all_checks():
    assert [f"{c.key} {c.layer} {c.weight}" for c in checks.CHECKS] == [x.strip() for x in ORDER.replace("\n", " ").split(",")]


# The values at which each check's status changes: signal(s), then the status there.
STATUSES = {
    "status": [({"home_error": "x"}, "fail"), ({"home_status": 0}, "fail"), ({"home_status": 400}, "fail"), ({"home_status": 399}, "ok")],
    "redirects": [({"hops": 0}, "ok"), ({"hops": 1}, "warn"), ({"hops": 2}, "warn"), ({"hops": 3}, "fail")],
    "robots": [({"robots_status": 200, "n_denied": 1, "n_declared": 1}, "fail"), ({"robots_status": 404, "n_denied": 1, "n_declared": 1}, "warn"), ({"robots_status": 200, "n_denied": 0, "n_declared": 0}, "warn"), ({"robots_status": 200, "n_denied": 0, "n_declared": 1}, "ok")],
    "bot_access": [({"bot_status": 403, "home_status": 200}, "fail"), ({"bot_status": 0, "home_status": 200}, "ok"), ({"bot_status": 200, "home_status": 200}, "ok")],
    "text_present": [({"n_text": 199}, "fail"), ({"n_text": 200}, "warn"), ({"n_text": 599}, "warn"), ({"n_text": 600}, "ok")],
    "ascii_slugs": [({"n_cjk_slugs": 1}, "fail"), ({"n_cjk_slugs": 0}, "ok")],
    "title": [({"title_len": 0}, "fail"), ({"title_len": 90}, "ok"), ({"title_len": 91}, "warn")],
    "description": [({"description_len": 0}, "fail"), ({"description_len": 39}, "warn"), ({"description_len": 40}, "ok")],
    "headings": [({"n_h1": 0, "n_h2": 3, "n_h3": 0}, "fail"), ({"n_h1": 2, "n_h2": 3, "n_h3": 0}, "warn"), ({"n_h1": 1, "n_h2": 1, "n_h3": 1}, "warn"), ({"n_h1": 1, "n_h2": 2, "n_h3": 1}, "ok")],
    "structured_data": [({"n_ld": 0, "has_organization": False}, "fail"), ({"n_ld": 1, "has_organization": False}, "warn"), ({"n_ld": 1, "has_organization": True}, "ok")],
    "language": [({"has_lang": True}, "ok"), ({"has_lang": False}, "warn")],
    "canonical": [({"has_canonical": True}, "ok"), ({"has_canonical": False}, "warn")],
    "questions": [({"n_questions": 1}, "warn"), ({"n_questions": 2}, "ok")],
    "conclusion_first": [({"has_conclusion": True}, "ok"), ({"has_conclusion": False}, "warn")],
    "facts": [({"n_facts": 4}, "warn"), ({"n_facts": 5}, "ok")],
    "faq": [({"has_faq": True}, "ok"), ({"has_faq": False}, "warn")],
    "dated": [({"has_date": True}, "ok"), ({"has_date": False}, "warn")],
    "entity": [({"has_organization": True, "n_ld_names": 0}, "warn"), ({"has_organization": False, "n_ld_names": 1}, "warn"), ({"has_organization": True, "n_ld_names": 1}, "ok")],
    "same_as": [({"n_same_as": 1}, "warn"), ({"n_same_as": 2}, "ok")],
    "about": [({"has_about": True}, "ok"), ({"has_about": False}, "warn")],
    "sitemap": [({"sitemap_status": 200, "n_locs": 1}, "ok"), ({"sitemap_status": 200, "n_locs": 0}, "fail"), ({"sitemap_status": 404, "n_locs": 1}, "fail")],
    "sitemap_sample": [({"n_bad_locs": 0}, "ok"), ({"n_bad_locs": 1}, "fail")],
    "llms_txt": [({"llms_status": 200}, "ok"), ({"llms_status": 404}, "info")],
    "feed": [({"rss_status": 200}, "ok"), ({"rss_status": 0}, "warn")],
    "author": [({"has_author": True}, "ok"), ({"has_author": False}, "warn")],
    "sources": [({"has_source": True}, "ok"), ({"has_source": False}, "warn")],
    "open_data": [({"has_open_data": True}, "ok"), ({"has_open_data": False}, "warn")],
    "indexable": [({"n_no_index": 0}, "ok"), ({"n_no_index": 1}, "fail")],
    "robots_health": [({"robots_status": 500, "robots_closed": False}, "fail"), ({"robots_status": 499, "robots_closed": True}, "ok"), ({"robots_status": 200, "robots_closed": True}, "fail"), ({"robots_status": 200, "robots_closed": False}, "ok")],
    "host_variants": [({"variants_agree": True}, "ok"), ({"variants_agree": False}, "warn")],
    "og_image": [({"og_image_loads": True}, "ok"), ({"og_image_loads": False}, "warn")],
    "structures": [({"n_lists": 1, "n_tables": 1, "n_definitions": 0}, "warn"), ({"n_lists": 1, "n_tables": 1, "n_definitions": 1}, "ok")],
    "substance": [({"text_ratio": 0.02, "n_words": 900}, "fail"), ({"text_ratio": 0.5, "n_words": 199}, "fail"), ({"text_ratio": 0.05, "n_words": 900}, "warn"), ({"text_ratio": 0.5, "n_words": 599}, "warn"), ({"text_ratio": 0.06, "n_words": 600}, "ok")],
    "self_contained": [({"n_dependent": 0}, "ok"), ({"n_dependent": 1}, "warn")],
    "image_alt": [({"n_img": 0, "n_img_bare": 0}, None), ({"n_img": 10, "n_img_bare": 2}, "ok"), ({"n_img": 10, "n_img_bare": 3}, "warn")],
    "entity_name": [({"n_entity_names": 0, "names_nested": False}, "warn"), ({"n_entity_names": 1, "names_nested": False}, "ok"), ({"n_entity_names": 2, "names_nested": False}, "warn"), ({"n_entity_names": 2, "names_nested": True}, "ok"), ({"n_entity_names": 3, "names_nested": True}, "warn")],
    "platforms": [({"n_platforms": 2}, "warn"), ({"n_platforms": 3}, "ok")],
    "citation_strength": [({"n_authorities": 1, "n_quotes": 1, "n_statistics": 4}, "warn"), ({"n_authorities": 1, "n_quotes": 2, "n_statistics": 4}, "ok"), ({"n_authorities": 0, "n_quotes": 2, "n_statistics": 5}, "warn"), ({"n_authorities": 1, "n_quotes": 0, "n_statistics": 5}, "ok")],
    "access_files": [({}, "info")],
    "freshness": [({"last_year": None}, "warn"), ({"last_year": 2025}, "warn"), ({"last_year": 2026}, "ok")],
    "page_type": [({}, "info")],
    "manual_review": [({}, "info")],
}


def test_status_of_every_check(spark):
    assert set(STATUSES) == {c.key for c in checks.CHECKS}
    kinds = {bool: "boolean", int: "int", float: "double", str: "string", type(None): "int"}
    names = {k: kinds[type(v)] for cases in STATUSES.values() for given, _ in cases for k, v in given.items() if v is not None}
    rows, want = [], {}
    for key, cases in STATUSES.items():
        for given, status in cases:
            rows.append((len(rows), 2026, *(given.get(n) for n in names)))
            want[len(rows) - 1, key] = status
    table = spark.createDataFrame(rows, "page_id int, fresh_year int, " + ", ".join(f"{n} {k}" for n, k in names.items()))
    got = {(r["page_id"], r["check_id"]): r["status"] for r in checks.results(table, checks.CHECKS).collect()}
    assert {k: got.get(k) for k in want} == want


def test_weights_of_all_checks():
    by_layer = {}
    for c in checks.PAGE + checks.SITE:
        by_layer[c.layer] = by_layer.get(c.layer, 0) + c.weight
    assert by_layer == {"crawl": 22, "parse": 18, "cite": 21, "entity": 10, "reach": 10, "trust": 7}
    assert len({c.key for c in checks.PAGE + checks.SITE}) == 42


def test_site_checks(spark):
    fetches = [
        ("https://a.example/", "default", 200, "text/html", '<meta property="og:image" content="/i.png">', "https://a.example/", 1, None), ("https://a.example/", "bot", 503, None, "", "", 0, None),
        ("https://a.example/robots.txt", "default", 200, None, "User-agent: Googlebot\nAllow: /\nUser-agent: *\nDisallow: /\n", "", 0, None), ("https://a.example/sitemap.xml", "default", 200, None, samples.SITEMAPS[0][1], "", 0, None),
        ("https://a.example/one", "sitemap", 200, None, "", "", 0, None), ("https://a.example/i.png", "default", 200, "image/png", "", "", 0, None), ("https://a.example/rss.xml", "default", 404, None, "", "", 0, None),
    ]
    table = samples.frame(spark, fetches, "url string, ua string, status int, content_type string, body string, final_url string, hops int, error string").withColumn("headers", F.create_map(F.lit("Content-Type"), "content_type")).drop("content_type")
    pages = spark.createDataFrame([(1, "https://a.example/"), (2, "https://gone.example/")], "page_id int, url string")
    got = {(r["page_id"], r["check_id"]): r["status"] for r in audit.site_checks(pages, table).collect()}
    want = {"status": "ok", "redirects": "warn", "robots": "fail", "bot_access": "fail", "ascii_slugs": "fail", "robots_health": "fail", "host_variants": "warn", "og_image": "ok", "sitemap": "ok", "sitemap_sample": "fail", "llms_txt": "info", "feed": "warn", "access_files": "info", "freshness": "ok"}
    assert {k: v for (p, k), v in got.items() if p == 1} == want
    assert got[2, "status"] == "fail" and got[2, "robots"] == "warn" and got[2, "bot_access"] == "ok" and got[2, "sitemap"] == "fail"
    full = audit.full_checks(pages, table)
    assert full.groupBy("page_id").agg(F.sum("weight")).collect()[0][1] == 87
    assert "Score" in audit.report(full).first()["text"]


def test_headers_can_exclude_a_page(spark):
    rows = [("https://a.example/", "default", 200, {"x-ROBOTS-Tag": "noindex"}, "<p>x</p>", "", 0, None), ("https://b.example/", "default", 200, {"X-Robots-Tag": "all"}, "<p>x</p>", "", 0, None)]
    pages = spark.createDataFrame([(1, "https://a.example/"), (2, "https://b.example/")], "page_id int, url string")
    got = audit.full_checks(pages, spark.createDataFrame(rows, site.FETCH)).where("check_id = 'indexable'").collect()
    assert {r["page_id"]: r["status"] for r in got} == {1: "fail", 2: "ok"}


def test_bodies_are_moved_once_and_outcomes_narrow(spark):
    """No body is sorted or aggregated but for the pages' own and the files that are read."""
    fetches = spark.createDataFrame([("https://a.example/", "default", 200, {}, "<p>x</p>", "", 0, None)], site.FETCH)
    asked = spark.createDataFrame([("https://a.example/", "default")], "url string, ua string")
    plan = site.liveness(asked, fetches)._jdf.queryExecution().optimizedPlan().toString()
    assert "body" not in plan.split("LogicalRDD")[0] and "headers" not in plan.split("LogicalRDD")[0]


def test_header_names_in_any_case(spark):
    df = spark.createDataFrame([({"X-ROBOTS-tag": "noindex"},)], "h map<string,string>")
    assert df.select(site.header(F.col("h"), "x-robots-tag")).first()[0] == "noindex"


def test_visibility_sample(spark):
    rows = [("Q1", "P1", "joint", "positive", "accurate", ["f1"]), ("Q2", "P2", "citation_only", "neutral", "unverifiable", [])]
    df = spark.createDataFrame(rows, "question string, platform string, role string, sentiment string, facts string, facts_found array<string>")
    r = visibility.indicators(df, 3, 2).first()
    assert (r["coverage"], r["mention_share"], r["accuracy"], r["positive_share"], r["negative_reduction"], r["role_score"]) == (33.3, 100.0, 100.0, 50.0, 100.0, 42.5)
    assert {r["platform"]: r["role_score"] for r in visibility.by_platform(df).collect()} == {"P1": 60.0, "P2": 25.0}
    assert tuple(visibility.runs_per_question(df).first()) == (1, 1, 2)
    empty = visibility.indicators(df.limit(0), 0, None).first()
    assert empty["coverage"] is None and empty["positive_share"] == 0.0 and empty["negative_reduction"] is None


def test_text_is_made_once(spark, small):
    plan = audit.page_checks(spark.read.parquet(f"{small}/pages.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("noscript") <= 2 and "Relation [page_id" in plan
