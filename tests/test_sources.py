from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from pagelens.operators import history, recording
from pagelens.sources import jsonl, live, snapshots
from pagelens.streaming import ingest

SCHEMA = "identity string, kind string, value double, n int"
GOOD = '{"ts":"1","identity":"a","kind":"k","value":"0.5","n":20}'


def test_tolerant_reading(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join([GOOD, "", "broken", "[1]", '"s"', '{"identity":"b","kind":"k","value":1}']))
    rows = jsonl.read(spark, str(tmp_path / "x.jsonl"), SCHEMA).orderBy("identity").collect()
    assert [tuple(r) for r in rows] == [("a", "k", 0.5, 20), ("b", "k", 1.0, None)]


def test_append(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", "k", 1.0, 1)], SCHEMA)
    jsonl.append(df, path)
    jsonl.append(df, path)
    assert spark.read.schema(SCHEMA).json(path).count() == 2


def test_a_reader_sees_old_or_new_rows_at_any_step(spark, tmp_path, monkeypatch):
    """A reader between any two steps of a writer, also one that breaks off, finds one whole version."""
    root = str(tmp_path / "t")
    frame = lambda *values: spark.createDataFrame([(v,) for v in values], "v int").coalesce(1)
    rows = lambda: sorted(r["v"] for r in snapshots.read(spark, root, snapshots.current(spark, root).get("data", []), "v int").collect())
    assert rows() == []
    first = snapshots.commit(spark, root, snapshots.current(spark, root), data=[snapshots.write(frame(1, 2), root)])
    assert rows() == [1, 2]
    folder = snapshots.write(snapshots.read(spark, root, first["data"], "v int").selectExpr("v + 10 AS v"), root)  # rows that come from the table itself
    assert rows() == [1, 2]
    held = snapshots.read(spark, root, first["data"], "v int")
    log = tmp_path / "t" / snapshots.LOG
    (log / ".half").write_text('{"number": 2, "da')  # a log file that is being written
    assert rows() == [1, 2]
    snapshots.commit(spark, root, first, data=[folder])
    assert rows() == [11, 12] and held.count() == 2
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, root, first, data=[snapshots.write(frame(7), root)])
    assert rows() == [11, 12] and sorted(f.name for f in log.iterdir() if f.name.endswith(".json")) == [f"{n:012}.json" for n in (1, 2)]
    assert snapshots.vacuum(spark, root, keep=1) == 0 and snapshots.vacuum(spark, root, keep=1, idle_s=-1) == 2 and rows() == [11, 12]


def run_stream(spark, incoming, root, checkpoint):
    query = ingest.start(spark, str(incoming), root, str(checkpoint))
    query.awaitTermination()
    assert query.exception() is None


def test_stream(spark, tmp_path):
    incoming, root = tmp_path / "in", str(tmp_path / "t")
    incoming.mkdir()
    for n, value in enumerate((0.1, 0.9)):
        (incoming / f"{n}.jsonl").write_text(f'{{"ts":"{n}","identity":"a","kind":"k","value":{value},"n":20}}\nbroken\n{{"kind":"k"}}\n')
        run_stream(spark, incoming, root, tmp_path / "cp")
    assert recording.observations(spark, root).count() == 2
    (row,) = recording.signals(spark, root).collect()
    assert (row["identity"], row["severity"]) == ("a", "rise")
    assert [(r["run_id"], r["recorded"], r["skipped"]) for r in recording.runs(spark, root).orderBy("run_id").collect()] == [("batch-0", 1, 1), ("batch-1", 1, 1)]


def test_stream_keeps_first_seen_resolves_and_keeps_the_order_of_lines(spark, tmp_path):
    incoming, root = tmp_path / "in", str(tmp_path / "t")
    incoming.mkdir()
    line = lambda value: f'{{"ts":"2026-01-01","identity":"a","kind":"k","value":{value},"n":20}}\n'
    seen = []
    for n, values in enumerate(((0.1, 0.9), (0.2,), (0.2,), (0.2, 0.5, 0.9))):
        (incoming / f"{n}.jsonl").write_text("".join(map(line, values)))
        run_stream(spark, incoming, root, tmp_path / "cp")
        seen.append(sorted((r["severity"], r["previous_value"], r["current_value"], r["first_seen"], r["resolved_at"] or "") for r in recording.signals(spark, root).collect()))
    assert seen[0] == [("rise", 0.1, 0.9, "0", "")]
    assert seen[1] == [("sharp_drop", 0.9, 0.2, "0", "")]
    assert seen[2] == [("sharp_drop", 0.9, 0.2, "0", "2")]
    assert seen[3] == [("rise", 0.5, 0.9, "3", ""), ("sharp_drop", 0.9, 0.2, "0", "2")]
    assert [r["seq"] for r in recording.observations(spark, root).orderBy("seq").collect()] == list(range(7))


def test_files_of_one_batch_keep_their_order_and_come_once(spark, tmp_path):
    """The first file is the smaller one, so that Spark reads it last; both come again when the stream's checkpoint is lost."""
    incoming, root = tmp_path / "in", str(tmp_path / "t")
    incoming.mkdir()
    line = lambda value, note="": f'{{"ts":"2026-01-01","identity":"a","kind":"k","value":{value},"n":20,"note":"{note}"}}\n'
    for n, (name, text) in enumerate((("z.jsonl", line(0.1)), ("a.jsonl", line(0.9, "x" * 5000)))):
        (incoming / name).write_text(text)
        os.utime(incoming / name, (1_700_000_000 + n, 1_700_000_000 + n))
    for cp in ("cp1", "cp1", "cp2"):
        run_stream(spark, incoming, root, tmp_path / cp)
        assert [r["value"] for r in recording.observations(spark, root).orderBy("seq").collect()] == [0.1, 0.9]
        assert [r["severity"] for r in recording.signals(spark, root).collect()] == ["rise"]
    assert snapshots.current(spark, root)["number"] == 1


def test_a_batch_that_breaks_off_leaves_the_version_before(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    rows = lambda name, *values: spark.createDataFrame([("2026-01-01", "a", "k", "s", v, None, 20, None, None, name, name, 0, n) for n, v in enumerate(values)], f"{recording.RAW}, recording string, made_at string, block long, row long")
    recording.record(rows("r1", 0.1, 0.2), root, {}, "1", buckets=4)
    commit = snapshots.commit
    monkeypatch.setattr(snapshots, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        recording.record(rows("r2", 0.9), root, {}, "2")
    assert recording.observations(spark, root).count() == 2
    monkeypatch.setattr(snapshots, "commit", commit)
    assert recording.record(rows("r2", 0.9), root, {}, "2") == {"recorded": 1, "skipped": 0, "repeated": 0}
    assert recording.record(rows("r2", 0.9), root, {}, "3") == {"recorded": 0, "skipped": 0, "repeated": 1}
    recording.compact(spark, root)
    assert [r["value"] for r in recording.observations(spark, root).orderBy("seq").collect()] == [0.1, 0.2, 0.9] and len(snapshots.current(spark, root)["data"]) == 1


def test_batches_give_what_one_run_over_all_gives(spark, small, tmp_path):
    """Signals of the events in three batches, and the rows that each batch reads of what is older."""
    from pagelens import catalog

    root, columns = str(tmp_path / "t"), ("dedup_key", "severity", "direction", "previous_value", "current_value", "previous_ts", "current_ts", "change_value", "n")
    all_rows = catalog._observations(spark, small)
    raw = all_rows.select("ts", "identity", "kind", "series", "value", F.lit(None).cast("string").alias("unit"), "n", "source", F.lit(None).cast("string").alias("note"), "seq")
    for k in range(3):
        part = raw.where(f"seq % 3 = {k}")
        recording.record(part.select("*", F.lit(f"b{k}").alias("recording"), F.lit(str(k)).alias("made_at"), F.lit(0).cast("long").alias("block"), F.col("seq").alias("row")).drop("seq"), root, {"run_id": f"b{k}"}, str(k), buckets=4)
    got = {tuple(r[c] for c in columns) for r in recording.signals(spark, root).where("resolved_at IS NULL").collect()}
    assert got == {tuple(r[c] for c in columns) for r in history.fresh_signals(recording.observations(spark, root), F.lit("x")).collect()} and got
    assert recording.observations(spark, root).count() == all_rows.count()
    version = snapshots.current(spark, root)
    state = snapshots.read(spark, root, list(version["state"].values()), history.OBSERVATION)
    assert state.groupBy(*history.KEYS).count().agg(F.max("count")).first()[0] == 2
    # A batch of one series leaves the other buckets' files alone.
    one = spark.createDataFrame([("2030-01-01", "newer", "k", "s", 1.0, None, 20, None, None, "x", "x", 0, 0)], f"{recording.RAW}, recording string, made_at string, block long, row long")
    recording.record(one, root, {}, "9")
    after = snapshots.current(spark, root)["state"]
    assert sum(after.get(b) != f for b, f in version["state"].items()) + len(set(after) - set(version["state"])) == 1


def test_live_source_is_guarded(spark):
    assert live.guard("ftp://a.example/") == "scheme" and live.guard("http://localhost/") == "host" and live.guard("http://127.0.0.1/") == "address"
    assert live.fetch("http://127.0.0.1/")[2:] == (0, {}, b"", "http://127.0.0.1/", 0, "address")
    spark.dataSource.register(live.LiveFetch)
    rows = spark.read.format("live_fetch").option("urls", "http://10.0.0.1/ http://127.0.0.1/x").load().collect()
    assert sorted((r["url"], r["status"], r["error"]) for r in rows) == [("http://10.0.0.1/", 0, "address"), ("http://127.0.0.1/x", 0, "address")]


def test_bodies_that_are_cut_off():
    import gzip
    import zlib

    text = bytes(range(256)) * 4000
    for packed, encoding in ((gzip.compress(text), "gzip"), (zlib.compress(text), "deflate"), (zlib.compress(text)[2:-4], "deflate"), (text, "")):
        assert live.decompressed(packed, encoding) == text
        part = live.decompressed(packed[: len(packed) // 2], encoding)
        assert part and text.startswith(part)
    assert len(live.decompressed(gzip.compress(text), "gzip", 1000)) == 1000


def test_search_tries_again_and_tells_why():
    answers = [b"nonsense", b'{"results": []}', b'{"results": [{"title": "A", "url": "https://a.example/"}]}']
    asked = []

    def ask(url):
        asked.append(url)
        return answers[len(asked) - 1]

    assert live.search("q one", "https://s.example/", "x", pause=0, ask=ask) == [("q one", 0, "A", "https://a.example/", "ok")]
    assert len(asked) == 3 and asked[0] == "https://s.example/search?q=q+one&format=json&engines=x"
    asked.clear()
    answers[2] = answers[1]
    assert live.search("q", "https://s.example", pause=0, ask=ask) == [("q", 0, None, None, "ok")]
    asked.clear()
    answers[:] = [b"x"] * 3
    ((*row, status),) = live.search("q", "https://s.example", pause=0, ask=ask)
    assert row == ["q", 0, None, None] and status.startswith("failed")


def test_search_source_without_an_endpoint(spark):
    from pagelens.plans.service import Service

    spark.dataSource.register(live.LiveSearch)
    rows = spark.read.format("live_search").option("endpoint", "http://127.0.0.1:9").option("questions", "q1\n\nq2").load()
    got = rows.collect()
    assert sorted(r["question"] for r in got) == ["q1", "q2"] and all(r["source_status"].startswith("failed") for r in got)
    out = json.loads(Service(spark, results=spark.createDataFrame(got, live.RESULT)).probe("q1", "Acme"))
    assert out["verdict"] == "source_unavailable" and out["n_results"] == 0


def test_live_rows_are_audited_as_text(spark):
    from pagelens.operators import site
    from pagelens.plans import audit

    html = '<html lang="zh"><title>标题</title><h1>合</h1>' + "结论是可以的。" * 40
    rows = [("https://a.example/", "default", 200, {"Content-Type": "text/html; charset=gbk"}, html.encode("gbk"), "https://a.example/", 0, None), ("https://b.example/", "default", 200, {}, html.encode(), "https://b.example/", 0, None)]
    fetches = site.from_live(spark.createDataFrame(rows, "url string, ua string, status int, headers map<string,string>, body binary, final_url string, hops int, error string"))
    assert [r["body"] for r in fetches.collect()] == [html, html]
    pages = spark.createDataFrame([(1, "https://a.example/"), (2, "https://b.example/")], "page_id int, url string")
    got = {(r["page_id"], r["check_id"]): r["status"] for r in audit.full_checks(pages, fetches).collect()}
    assert all(got[p, "title"] == "ok" and got[p, "language"] == "ok" and got[p, "text_present"] == "warn" and got[p, "conclusion_first"] == "ok" for p in (1, 2))
    planned = {(r["url"], r["ua"]) for r in site.fetch_plan(pages).collect()}
    assert {("https://a.example/", "bot"), ("https://www.a.example", "default"), ("https://b.example/robots.txt", "default")} <= planned and len(planned) == 2 * (2 + 4 + 7)
    named = fetches.unionByName(spark.createDataFrame([("https://a.example/sitemap.xml", "default", 200, {}, "<loc>https://a.example/x</loc>", "", 0, None)], site.FETCH))
    assert site.further_urls(pages, named) == {"sitemap": ["https://a.example/x"], "default": []}


def test_workers_need_not_find_the_package(tmp_path):
    """Page signals from another folder, by a session whose workers can't import this package."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from pagelens.operators import signals
from pagelens.plans import samples
rows = signals.page_signals(samples.frame(spark, samples.PAGES, "page_id int, url string, html string")).select("page_id", "n_entity_names").collect()
assert dict(map(tuple, rows))[1] == 2, rows
print("fine")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in out.stdout, out.stderr[-2000:]
