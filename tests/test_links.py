"""Links and their status, robots verdicts of paths, brand presence, stored evidence, and cases that once went wrong."""

from __future__ import annotations

import http.server
import itertools
import re
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelens import catalog
from pagelens.functions import urls
from pagelens.operators import history, links, presence, robots, signals, site, visibility
from pagelens.sources import buckets, live


def test_relative_links(spark):
    base = "http://a.example/b/c/d;p?q"
    want = {  # as in RFC 3986, 5.4, without fragments
        "g": "http://a.example/b/c/g", "./g": "http://a.example/b/c/g", "g/": "http://a.example/b/c/g/", "/g": "http://a.example/g", "//g.example": "http://g.example", "?y": "http://a.example/b/c/d;p?y", "g?y": "http://a.example/b/c/g?y",
        "g#s": "http://a.example/b/c/g", "g?y#s": "http://a.example/b/c/g?y", ";x": "http://a.example/b/c/;x", ".": "http://a.example/b/c/", "./": "http://a.example/b/c/", "..": "http://a.example/b/", "../g": "http://a.example/b/g",
        "../..": "http://a.example/", "../../g": "http://a.example/g", "../../../g": "http://a.example/g", "/./g": "http://a.example/g", "/../g": "http://a.example/g", "g.": "http://a.example/b/c/g.", "..g": "http://a.example/b/c/..g",
        "./../g": "http://a.example/b/g", "g/./h": "http://a.example/b/c/g/h", "g/../h": "http://a.example/b/c/h", "g?y/../x": "http://a.example/b/c/g?y/../x", "https://x.example/a/../b": "https://x.example/b",
    }
    rows = spark.createDataFrame([(base, k) for k in want], "base string, link string")
    assert {r["link"]: r["u"] for r in rows.select("link", urls.absolute(F.col("base"), F.col("link")).alias("u")).collect()} == want


def test_links_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, "https://a.example/x/y", '<a href="#top">t</a><A class="z" HREF = "z.html">z</A><a href="mailto:a@b.example">m</a><a href="">e</a><a name="n">n</a><abbr href="no">'), (2, None, None), (3, "https://a.example/", '<a href="//b.example/p#q">')], "page_id int, url string, html string")
    assert sorted(map(tuple, links.page_links(pages).collect())) == [(1, 1, "https://a.example/x/z.html"), (3, 0, "https://b.example/p")]


def test_stored_evidence_is_not_moved(spark, small):
    """One address that all pages link, looked up once; the bucketed side of the join has no exchange."""
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.example/"), "id").alias("url"), F.lit('<a href="/home">h</a>').alias("html"))
    fetches = spark.createDataFrame([("https://a.example/home", "default", 200, {}, "x", "", 0, None), ("https://a.example/home", "default", 404, {}, "x", "", 0, None), ("https://a.example/7", "bot", 200, {}, "", "", 0, None)], site.FETCH)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        known = buckets.bucketed(site.evidence(fetches), "pagelens_test_evidence", "url")
        out = links.link_status(pages, known)
        plan = out._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        at = next(k for k, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        own, level = [], depth(lines[at])
        for line in lines[at - 1 :: -1]:  # the scan's ancestors
            if depth(line) < level:
                own.append(line)
                level = depth(line)
        join = next(k for k, line in enumerate(own) if "SortMergeJoin" in line)
        assert not any("Exchange" in line for line in own[:join])
        assert {(r["status"], r["verdict"]) for r in out.collect()} == {(200, "ok")} and out.count() == 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sql("DROP TABLE pagelens_test_evidence")


FILE = "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\nDisallow: /x*y\nUser-agent: GPTBot\nDisallow: /\nAllow: /a/\n"


def test_robots_of_paths(spark):
    files = spark.createDataFrame([("s", FILE), ("empty", "")], "site string, body string")
    bots = spark.createDataFrame([("GPTBot",), ("Other",)], "bot string")
    paths = spark.createDataFrame([("s", p) for p in ("/", "/a", "/a/b", "/a/c", "/d.pdf", "/d.pdf?x", "/x1y2", "/a/b.pdf")] + [("empty", "/"), ("none", "/a"), ("s", "/a")], "site string, path string")
    got = {(r["site"], r["path"], r["bot"]): r["verdict"] for r in robots.path_verdicts(files, bots, paths).collect()}
    assert {p: got["s", p, "Other"] for p in ("/", "/a", "/a/b", "/a/c", "/d.pdf", "/d.pdf?x", "/x1y2", "/a/b.pdf")} == {"/": "allow", "/a": "deny", "/a/b": "allow", "/a/c": "deny", "/d.pdf": "deny", "/d.pdf?x": "allow", "/x1y2": "deny", "/a/b.pdf": "deny"}
    assert [got["s", p, "GPTBot"] for p in ("/", "/a", "/a/b")] == ["deny", "deny", "allow"] and got["empty", "/", "Other"] == got["none", "/a", "GPTBot"] == "undeclared" and len(got) == 20


@pytest.mark.parametrize("mode", robots.MODES)
def test_robots_of_the_root_are_those_of_the_file(spark, small, mode):
    files, bots = catalog._robots(spark, small)
    paths = files.select("site", F.lit("/").alias("path"))
    columns = ("site", "bot", "verdict", "matched_ua")
    of = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert of(robots.path_verdicts(files, bots, paths, mode)) == of(robots.verdicts(files, bots.select("bot"), mode=mode))


@pytest.mark.parametrize("most", [presence.BROADCAST_BRANDS, 0])
def test_presence(spark, monkeypatch, most):
    monkeypatch.setattr(presence, "BROADCAST_BRANDS", most)
    texts = spark.createDataFrame([(1, "h", "Acme  Corp, and acme."), (2, "h", "acmecorp Corp Acme"), (3, "g", None), (4, None, "the ACME-corp"), (5, "g", "")], "key int, host string, text string")
    brands = spark.createDataFrame([("Acme Corp",), ("acme",), ("corp acme",), ("zzz acme",), ("",), (None,), ("?",), ("acme",)], "brand string")
    got = sorted((r["key"], r["brand"]) for r in presence.mentions(texts, brands).collect())
    assert got == [(1, "Acme Corp"), (1, "acme"), (2, "acme"), (2, "corp acme"), (4, "Acme Corp"), (4, "acme")]
    shares = {(r["brand"], r["host"]): (r["n_pages"], r["share"]) for r in presence.presence(texts, brands).collect()}
    assert shares["acme", "h"] == (2, 100.0) and shares["Acme Corp", "h"] == (1, 50.0) and shares["acme", None] == (1, 100.0)


@pytest.mark.parametrize("buffer", [presence.BUFFER, 1])
def test_presence_moves_neither_texts_nor_lists_of_brands(spark, monkeypatch, buffer):
    """Few words and many brands made of them, so that each text has the words of most brands and holds few of them."""
    monkeypatch.setattr(presence, "BUFFER", buffer)
    words = ["".join(p) for p in itertools.product("abc", "xyzé")]
    rows = [(n, "h" if n % 3 else None, " ".join(words[n * k % 11 % len(words)] for k in range(1, 9))) for n in range(60)]
    known = [" ".join(b) for size in (1, 2, 3) for b in itertools.product(words, repeat=size)][::3] + [rows[7][2]]
    texts, brands = spark.createDataFrame(rows, "key int, host string, text string"), spark.createDataFrame([(b,) for b in known], "brand string")
    found = presence.presence(texts, brands)
    want = Counter((b, host) for _, host, text in rows for b in known if f" {b} " in f" {text} ")
    assert {(r["brand"], r["host"]): r["n_pages"] for r in found.collect()} == want and len(want) > 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_citations_don_t_depend_on_the_order_of_fetches(spark):
    samples = spark.createDataFrame([(1, "see https://a.example/x and https://b.example/")], "pos int, answer string")
    rows = [("https://a.example/x", "default", 200, {}, "", "", 0, None), ("https://a.example/x", "bot", 403, {}, "", "", 0, None), ("https://a.example/x", "default", 500, {}, "", "", 0, None), ("https://b.example/", "bot", 200, {}, "", "", 0, None)]
    for order in (rows, rows[::-1]):
        got = [(r["url"], r["verdict"]) for r in visibility.citation_checks(samples, spark.createDataFrame(order, site.FETCH)).orderBy("place").collect()]
        assert got == [("https://a.example/x", "verified"), ("https://b.example/", "error")]


def test_tied_fetches_equal_sql_with_its_order_completed(spark, small, tmp_path):
    """Pages that share a url tie in the SQL's ORDER BY, which leaves open whose fetch counts; with the rest of the order written
    out, both sides take the same. Ids 32,032 apart agree in all that ranks a fetch, so bodies alone decide there."""
    duckdb = pytest.importorskip("duckdb")
    pages = spark.read.parquet(f"{small}/pages.parquet")
    same = [pages.where(F.col("page_id") % 2 == n).withColumn("page_id", F.col("page_id") + k) for n, k in ((0, 32_032), (1, 1_001))]
    other = [p.withColumn("html", F.concat("html", F.lit("<h2>What else?</h2><p>According to 3 of 5 sources in 2024.</p>"))) for p in same]
    pages.unionByName(other[0]).unionByName(other[1]).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    order = "ORDER BY url, ua, status = 200 DESC, status DESC"
    for name in ("site_checks", "full_checks", "full_fixes"):
        assert order in catalog.ORACLE_SQL[name]
        asked = con.execute(catalog.ORACLE_SQL[name].replace(order, f"{order}, final_url DESC NULLS LAST, hops DESC, error DESC NULLS LAST, md5(body) DESC NULLS LAST"))
        got = catalog.QUERIES[name](spark, str(tmp_path)).select(*[d[0] for d in asked.description]).collect()
        assert sorted(map(tuple, got)) == sorted(asked.fetchall())


def test_fetches_that_differ_in_headers_alone_give_one_answer(spark):
    """Whatever order they come in, and the same one for a page's own checks and for those of its site."""
    pages = spark.createDataFrame([(1, "https://a.example/x")], "page_id int, url string")
    kinds = [{"content-type": "text/html"}, {"content-type": "image/png", "x": "a"}, {"x": "b", "content-type": "text/plain"}, {"content-type": "image/gif"}]
    took = set()
    for order in itertools.permutations([("https://a.example/x", "default", 200, h, "", "", 0, None) for h in kinds]):
        fetches = spark.createDataFrame(order, site.FETCH).coalesce(1)
        own = site.contents(pages, fetches, site.header(F.col("headers"), "content-type").alias("kind"))
        took.add(tuple(own.join(site.evidence(fetches), "url").select("kind", "default.shown").first()))
    assert len(took) == 1 and all(("image" in kind) == shown for kind, shown in took)


def test_json_ld_with_a_repeated_key(spark):
    html = '<script type="application/ld+json">{"@type":"Organization","name":"A","name":"B","sameAs":["https://x.example/1","https://x.example/2"]}</script><script type="application/ld+json">{broken</script>'
    r = signals.page_signals(spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")).first()
    assert r["has_organization"] and r["n_entity_names"] == 1 and r["n_same_as"] == 2 and r["n_ld"] == 2


def test_last_points_of_a_long_series(spark):
    rows = spark.range(20_000).select(F.format_string("2026-01-%02d", 1 + F.col("id") % 28).alias("ts"), F.lit("a").alias("identity"), F.lit("k").alias("kind"), F.lit("s").alias("series"), F.col("id").cast("double").alias("value"), F.lit(20).alias("n"), F.lit("").alias("source"), F.col("id").alias("seq"))
    got = [(r["place"], r["seq"]) for r in history.last_points(rows, 3).orderBy("place").collect()]
    last = [k for k in range(20_000) if k % 28 == 27][-3:][::-1]
    assert got == list(enumerate(last, 1))
    assert len(re.findall(r"\+- Window ", history.last_points(rows, 3)._jdf.queryExecution().executedPlan().toString())) == 2


class _Page(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        body = f"{self.headers['Host']} {self.path}".encode()
        self.send_response(302 if self.path == "/away" else 200)
        self.send_header("Location" if self.path == "/away" else "X-Name", "/there")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_a_request_goes_to_the_address_that_was_checked(monkeypatch):
    server = http.server.HTTPServer(("127.0.0.1", 0), _Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        host = f"nowhere.example:{server.server_port}"
        status, headers, body = live.request(f"http://{host}/ä b?q=1", {}, 5, 1000, "127.0.0.1")
        assert (status, headers["X-Name"], body.decode()) == (200, "/there", f"{host} /%C3%A4%20b?q=1")
        assert live.request(f"http://{host}/", {}, 5, 4, "127.0.0.1")[2] == host[:4].encode()
        monkeypatch.setattr(live, "checked", lambda url: (None, "127.0.0.1"))
        assert live.fetch(f"http://{host}/away")[2:] == (200, live.fetch(f"http://{host}/there")[3], f"{host} /there".encode(), f"http://{host}/there", 1, None)
    finally:
        server.shutdown()


def test_site_audit_has_few_exchanges(spark, small):
    """Lookups in stored evidence; what is computed twice is counted twice here and run once."""
    from pagelens.plans import audit

    checks = audit.site_checks(catalog._sites(spark, small), None, known=catalog._evidence(spark, small))
    plan = checks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") >= 4 and "rich" not in plan
