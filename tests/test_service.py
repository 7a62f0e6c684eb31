from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pagelens.plans import samples
from pagelens.plans.service import Service


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    rows = samples.frame(spark, samples.FETCHES, "url string, ua string, status int, content_type string, body string, final_url string, hops int, error string")
    fetches = rows.withColumn("headers", F.create_map(F.lit("Content-Type"), "content_type")).drop("content_type")
    results = samples.frame(spark, samples.RESULTS, "question string, pos int, title string, url string")
    return Service(spark, fetches, results, str(tmp_path_factory.mktemp("data")))


def test_audit(service):
    out = json.loads(service.audit("a.example/", compare_with="https://b.example/"))
    assert out["ok"] and 0 <= out["score"] <= 100 and out["grade"] in "ABCDF" and len(out["fixes"]) == 10
    ids = [d["check_id"] for d in out["comparison"]["differing_checks"]]
    assert ids == sorted(ids) and "bot_access" in ids and out["comparison"]["winner"] in "AB"
    assert json.loads(service.audit("https://nowhere.example/"))["error"] == "audit_failed"
    assert json.loads(service.audit("a.example/", compare_with="nowhere.example"))["comparison"]["error"] == "compare_failed"
    assert out["attribution"]["tool"] == "audit"


def test_probe(service):
    out = json.loads(service.probe("q1", "Acme", "acme.example:80"))
    assert out["verdict"] == "own_site_present" and out["host_distribution"][0] == {"host": "zhihu.com", "n": 2} and len(out["top_results"]) == 3
    assert json.loads(service.probe(" "))["error"] == "missing_question"
    assert json.loads(Service(service.spark).probe("q"))["error"] == "search_backend_unreachable"


def test_visibility(service):
    study = {"brand": "Acme", "baseline_negative": 2, "fact_points": ["f1", "f2", "f3"], "samples": [{"question": "Q1", "platform": "P1", "role": "joint", "sentiment": "positive", "facts": "accurate", "facts_found": ["f1"], "answer": "Acme 提升 25%，见 https://a.example/"}, {"question": "Q2", "platform": "P2", "role": "citation_only"}]}
    out = json.loads(service.visibility(json.dumps(study)))
    assert out["indicators"]["role_score"] == 42.5 and out["indicators"]["coverage"] == 33.3
    assert out["citation_checks"][0]["verdict"] == "verified" and out["claims"][0]["claim"] == "Acme 提升 25%"
    assert json.loads(service.visibility("nope"))["error"] == "bad_json" and json.loads(service.visibility("{}"))["error"] == "no_samples"


def test_plan(service):
    assert [p["id"] for p in json.loads(service.plan("faq, title ,nothing"))["plan"]] == ["title", "faq"]
    assert json.loads(service.plan("faq, nothing", url="a.example/"))["unknown_ids"] == ["nothing"]
    assert json.loads(service.plan(url="a.example/", top=3))["plan"] and json.loads(service.plan())["error"] == "no_targets"


def test_recording(service):
    assert json.loads(service.history("acme"))["series"] == [] and json.loads(service.signals())["count"] == 0
    first = {"run": {"run_id": "r1", "ts": "2026-01-01", "series": "w"}, "observations": [{"identity": "acme", "kind": "mention", "value": 0.2, "n": 30}, {"kind": "mention", "value": 1}]}
    assert service.record(json.dumps(first), "t1") == {"recorded": 1, "skipped": 1, "signals": 0}
    second = [{"ts": "2026-02-01", "identity": "acme", "kind": "mention", "series": "w", "value": 0.6, "n": 30}]
    assert service.record(json.dumps(second), "t2") == {"recorded": 1, "skipped": 0, "signals": 1}
    (series,) = json.loads(service.history("acme", limit=1))["series"]
    assert series["points"] == 2 and [v["value"] for v in series["values"]] == [0.6] and not series["low_n"]
    (change,) = json.loads(service.changes("acme"))["results"]
    assert change["severity"] == "rise" and change["previous_value"] == 0.2
    (signal,) = json.loads(service.signals())["signals"]
    assert signal["first_seen"] == "t2" and json.loads(service.signals("resolved"))["count"] == 0
    assert service.record(json.dumps([{"ts": "2026-03-01", "identity": "acme", "kind": "mention", "series": "w", "value": 0.6, "n": 30}]), "t3")["signals"] == 0
    assert json.loads(service.signals("resolved"))["signals"][0]["resolved_at"] == "t3"


def test_recordings_keep_the_order_of_arrival(spark, tmp_path):
    service = Service(spark, folder=str(tmp_path))
    point = lambda value: {"ts": "2026-01-01", "identity": "acme", "kind": "mention", "value": value, "n": 30}
    for n, values in enumerate(([0.3, 0.2, 0.1], [0.9], [0.4, 0.5])):
        service.record(json.dumps([point(v) for v in values]), f"t{n}")
        (change,) = json.loads(service.changes("acme"))["results"]
        assert (change["previous_value"], change["current_value"]) == ((0.2, 0.1), (0.1, 0.9), (0.4, 0.5))[n]


def test_command_line(spark, tmp_path, capsys):
    from pagelens import __main__ as cli

    assert cli.main([]) == 2 and cli.main([str(tmp_path), "audit"]) == 2 and cli.main([str(tmp_path), "unheard"]) == 2
    assert cli.main([str(tmp_path), "selftest"]) == 0
    assert capsys.readouterr().out.count(": ok") == 8
    fetches = samples.frame(spark, samples.FETCHES, "url string, ua string, status int, content_type string, body string, final_url string, hops int, error string")
    fetches.withColumn("headers", F.create_map(F.lit("Content-Type"), "content_type")).drop("content_type").write.parquet(f"{tmp_path}/fetches")
    samples.frame(spark, samples.RESULTS, "question string, pos int, title string, url string").write.parquet(f"{tmp_path}/results")
    (tmp_path / "study.json").write_text(json.dumps({"samples": [{"question": "q", "platform": "P", "role": "joint", "answer": "Acme 25%"}]}))
    for args in (["audit", "a.example/", "b.example/"], ["probe", "q1", "Acme"], ["visibility", str(tmp_path / "study.json")], ["plan", "faq"], ["signals"]):
        assert cli.main([str(tmp_path), *args]) == 0
        assert json.loads(capsys.readouterr().out)["ok"]


def test_resources(spark):
    from pagelens.plans import resources

    assert resources.checklist(spark).count() == 42
    book = resources.playbook(spark).orderBy("place").collect()
    assert [(r["layer"], r["weight"]) for r in book] == [("crawl", 22), ("parse", 18), ("cite", 21), ("entity", 10), ("reach", 10), ("trust", 7)] and sum(r["n_checks"] for r in book) == 42
    asked = spark.createDataFrame([("q1", "P1", "joint"), ("q2", "P1", "none"), ("q2", "", "joint")], "question string, platform string, role string")
    profiles = {r["platform"]: r for r in resources.platform_profiles(asked, samples.frame(spark, samples.RESULTS, "question string, pos int, title string, url string")).collect()}
    assert profiles["P1"]["hosts"][0] == "blog.example" and profiles["P1"]["mention_share"] == 50.0 and profiles["unlabelled"]["hosts"] == ["blog.example"]
    assert {r["kind"] for r in resources.known_hosts(spark).collect()} == {"platform", "authority"}
    assert "a.example" in resources.prompt("audit", "a.example") and "20" in resources.prompt("study", "q")


def test_attribution_has_a_notice_of_its_own(service):
    given = json.loads(service.plan("faq"))["attribution"]
    assert {"brand", "product", "tool", "version", "trace_id", "issued_at", "source", "citation", "attribution_required", "license", "notice", "note"} == set(given)
    assert given["notice"].startswith("Whoever passes this on") and len(given["notice"]) > 40
