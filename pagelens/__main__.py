"""python -m pagelens FOLDER COMMAND ...

    record FILE | history IDENTITY | changes IDENTITY | signals [STATUS] | plan IDS
    audit URL [OTHER] | probe QUESTION [BRAND [DOMAIN]] | visibility FILE | selftest

audit and probe read the tables FOLDER/fetches and FOLDER/results (Parquet) where they are there; with --live ENDPOINT at
the end they ask the sites, and the search endpoint, themselves.
"""

from __future__ import annotations

import datetime
import json
import sys
from pathlib import Path

ASKED = ("history", "changes", "signals", "plan", "audit", "probe", "visibility")


def live_tables(spark, command: str, args: list[str], endpoint: str):
    """(fetches, results) for one question to the live sources; fetches cover all that a site's checks look at."""
    from pagelens.functions import patterns as P
    from pagelens.operators import site
    from pagelens.sources import live

    if command == "probe":
        spark.dataSource.register(live.LiveSearch)
        return None, spark.read.format("live_search").option("endpoint", endpoint).option("questions", args[0]).load()
    spark.dataSource.register(live.LiveFetch)
    load = lambda urls, agents: site.from_live(spark.read.format("live_fetch").option("urls", " ".join(urls)).option("agents", agents).load()).persist()
    pages = spark.createDataFrame([(a if a.startswith("http") else f"https://{a}",) for a in args], "url string")
    first = site.fetch_plan(pages, P.ACCESS_FILES)
    out = load([r["url"] for r in first.where("ua = 'default'").collect()], "default").unionByName(load([r["url"] for r in first.where("ua = 'bot'").collect()], "bot"))
    for agent, urls in site.further_urls(pages, out).items():
        out = out.unionByName(load(urls, agent)) if urls else out
    return out, None


def selftest(service) -> int:
    """Ask every question once, over the built-in samples; prints a line each and counts what fails."""
    from pagelens.operators import history
    from pagelens.plans import samples

    study = {"brand": "Acme", "baseline_negative": 2, "fact_points": ["f1"], "samples": [{"question": "q", "platform": "P1", "role": "joint", "sentiment": "positive", "facts": "accurate", "facts_found": ["f1"], "answer": "Acme 25%"}]}
    asked = {
        "audit": lambda: service.audit(samples.SITES[0][1]), "plan": lambda: service.plan("robots, structured_data, faq"), "visibility": lambda: service.visibility(json.dumps(study)), "probe": lambda: service.probe("q1", "Acme"),
        "history": lambda: service.history("acme"), "changes": lambda: service.changes("acme"), "signals": lambda: service.signals("all"),
    }
    bad = 0
    for name, ask in asked.items():
        ok = json.loads(ask())["ok"]
        bad += not ok
        print(f"{name}: {'ok' if ok else 'FAILED'}")
    cases = [(0.0, 0.25, 20, "rise"), (0.25, 0.0, 20, "sharp_drop"), (0.2, 0.22, 20, "rise_small"), (0.0, 0.25, 5, "low_n"), (0.1, 0.1, 20, "flat")]
    rows = service.spark.createDataFrame([c[:3] for c in cases], "p double, c double, n int").selectExpr("p", "c", "n", history.classify_sql("p", "c", "n") + " AS severity").collect()
    wrong = sum(r["severity"] != c[3] for r, c in zip(rows, cases, strict=True))
    print(f"classes of changes: {'ok' if not wrong else 'FAILED'}")
    return bad + wrong


def main(args: list[str]) -> int:
    live = args.index("--live") if "--live" in args else len(args)
    args, endpoint = args[:live], (args[live + 1 :] or [""])[0] if live < len(args) else None
    least = {"record": 3, "signals": 2, "selftest": 2}.get(args[1] if len(args) > 1 else "", 3)
    if len(args) < least or args[1] not in (*ASKED, "record", "selftest"):
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from pagelens.plans import samples
    from pagelens.plans.service import Service

    spark, (folder, command, *rest) = SparkSession.builder.getOrCreate(), args
    table = lambda name: spark.read.parquet(f"{folder}/{name}") if Path(folder, name).exists() else None
    fetches, results = table("fetches"), table("results")
    if command == "selftest":
        rows = samples.frame(spark, samples.FETCHES, "url string, ua string, status int, content_type string, body string, final_url string, hops int, error string")
        fetches, results = rows.withColumn("headers", F.create_map(F.lit("Content-Type"), "content_type")).drop("content_type"), samples.frame(spark, samples.RESULTS, "question string, pos int, title string, url string")
    elif endpoint is not None and command in ("audit", "probe"):
        fetches, results = live_tables(spark, command, rest, endpoint)
    service = Service(spark, fetches, results, folder)
    if command == "selftest":
        return 1 if selftest(service) else 0
    if command == "record":
        print(service.record(Path(rest[0]).read_text(encoding="utf-8"), datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")))
    elif command == "visibility":
        print(service.visibility(Path(rest[0]).read_text(encoding="utf-8")))
    else:
        print(getattr(service, command)(*rest))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
