"""The seven questions one can ask about one target, answered as JSON text, and recording from a file.

Errors are values: {"ok": false, "error": code, "hint": ...}. The codes and the keys of results are fixed values, which
callers read. Each answer is a handful of rows about one URL, question,
study or identity, so it is collected; the plans behind it are those of the set-at-a-time queries. Every answer
carries an attribution under the caller's brand.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import wraps
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions.provenance import Brand, provenance
from pagelens.functions import patterns as P
from pagelens.operators import history, planning, pool, recording, score, site, visibility
from pagelens.operators.checks import CHECKS
from pagelens.plans import audit
from pagelens.sources import jsonl

SAMPLE = "pos int, question string, platform string, run int, answer string, role string, sentiment string, facts string, facts_found array<string>, as_of string"


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _error(code: str, hint: str) -> dict[str, Any]:
    return {"ok": False, "error": code, "hint": hint}


def answer(f: Callable[..., dict[str, Any]]) -> Callable[..., str]:
    """JSON text of what a method returns, with an attribution where it has none."""

    @wraps(f)
    def wrapped(self: Service, *args, **kwargs) -> str:
        out = f(self, *args, **kwargs)
        if "attribution" not in out:
            inputs = [F.lit(str(a)[:200]) for a in (*args, *(f"{k}={v}" for k, v in sorted(kwargs.items())))]
            row = self.spark.range(1).select(provenance(f.__name__, self.brand, *inputs, issued_at=F.current_timestamp().cast("string")).alias("p")).first()
            out = out | {"attribution": row["p"].asDict()}
        return json.dumps(out, ensure_ascii=False, default=str)

    return wrapped


class Service:
    """Over tables of fetches and search results, and a folder of observations and signals (JSON lines)."""

    def __init__(self, spark: SparkSession, fetches: DataFrame | None = None, results: DataFrame | None = None, folder: str | None = None, brand: Brand = Brand()):
        self.spark, self.fetches, self.results, self.folder, self.brand = spark, fetches, results, folder, brand

    def _checks(self, *urls: str) -> DataFrame:
        """Results for these URLs, numbered from 1: a row for each check, so they are fetched and looked at again."""
        pages = self.spark.createDataFrame(list(enumerate(urls, 1)), "page_id int, url string")
        found = audit.full_checks(pages, self.fetches)
        return self.spark.createDataFrame(found.collect(), found.schema)

    def _known(self, url: str) -> bool:
        return self.fetches is not None and not self.fetches.where((F.col("url") == url) & (F.col("ua") == "default")).isEmpty()

    def _named(self, checks: DataFrame) -> DataFrame:
        """Results of checks with title and advice, as the answer names them."""
        words = self.spark.createDataFrame([(c.key, c.title, c.advice) for c in CHECKS], "check_id string, title string, fix string")
        return checks.join(F.broadcast(words), "check_id").withColumnRenamed("check_id", "id")

    @staticmethod
    def _full(url: str) -> str:
        return url if url.startswith("http") else f"https://{url}"

    @answer
    def audit(self, url: str, compare_with: str = "") -> dict[str, Any]:
        url = self._full(url)
        if not self._known(url):
            return _error("audit_failed", "no fetch of this URL in the table of fetches")
        checks = self._checks(url)
        own = self.fetches.where((F.col("url") == url) & (F.col("ua") == "default"))
        out = {"ok": True, "url": url, "final_url": site.outcomes(own).first()["final_url"]} | {k: v for k, v in _rows(audit.report(checks))[0].items() if k != "page_id"}
        out["checks"] = _rows(self._named(checks).orderBy("check_pos").drop("page_id", "check_pos"))
        if compare_with:
            other = self._full(compare_with)
            if not self._known(other):
                return out | {"comparison": _error("compare_failed", "no fetch of the other URL in the table of fetches")}
            pairs, checks = self.spark.createDataFrame([(1, 2)], "a int, b int"), self._checks(url, other)
            differing = score.compare(pairs, checks).drop("a", "b").orderBy("check_id")
            out["comparison"] = _rows(score.compare_scores(pairs, score.page_scores(checks)).drop("a", "b"))[0] | {"differing_checks": _rows(differing)}
        return out

    @answer
    def probe(self, question: str, brand: str = "", domain: str = "") -> dict[str, Any]:
        if not question.strip():
            return _error("missing_question", "give the question as users ask it")
        if self.results is None:
            return _error("search_backend_unreachable", "there is no table of search results")
        own = self.results.where(F.col("question") == question)
        bad = own.where("source_status <> 'ok'").select("source_status").first() if "source_status" in own.columns else None
        wanted = self.spark.createDataFrame([(question, brand, domain, bad[0] if bad else "ok")], "question string, brand string, domain string, source_status string")
        hosts = _rows(pool.host_distribution(own).orderBy("place").select("host", "n"))
        top = _rows(pool.hits(own).orderBy("pos").limit(12).select("title", "url", "host"))
        return {"ok": True} | _rows(pool.verdicts(own, wanted))[0] | {"host_distribution": hosts, "top_results": top}

    @answer
    def visibility(self, samples: str, verify_citations: bool = True, extract_claims: bool = True) -> dict[str, Any]:
        try:
            study = json.loads(samples)
        except ValueError as e:
            return _error("bad_json", str(e)[:160])
        given = study.get("samples") if isinstance(study, dict) else None
        if not given:
            return _error("no_samples", "give at least one sample")
        names = [f.split()[0] for f in SAMPLE.split(", ")][1:]
        rows = self.spark.createDataFrame([(n, *(s.get(k) for k in names)) for n, s in enumerate(given)], SAMPLE)
        out = {
            "ok": True, "indicators": _rows(visibility.indicators(rows, len(study.get("fact_points") or []), study.get("baseline_negative") or None))[0],
            "per_platform": _rows(visibility.by_platform(rows)), "runs_per_question": _rows(visibility.runs_per_question(rows))[0],
            "role_weights": P.ROLE_WEIGHTS, "extracts": _rows(visibility.excerpts(rows, study.get("brand") or "")), "cited_urls": _rows(visibility.cited_urls(rows)),
        }
        if verify_citations and self.fetches is not None:
            out["citation_checks"] = _rows(visibility.citation_checks(rows, self.fetches))
        if extract_claims:
            out["claims"] = [c | {"status": "unverified"} for c in _rows(visibility.claims(rows))]
        return out

    @answer
    def plan(self, fail_ids: str = "", url: str = "", top: int = planning.DEFAULT_TOP) -> dict[str, Any]:
        """Ids that are given go before those of the URL's audit."""
        ids = fail_ids
        if not ids.strip(" ,，") and url.strip():
            if not self._known(self._full(url.strip())):
                return _error("audit_failed", "no fetch of this URL in the table of fetches")
            bad = self._checks(self._full(url.strip())).where(F.col("status").isin("fail", "warn")).orderBy("check_pos").select("check_id")
            ids = ",".join(r["check_id"] for r in bad.collect())
        request = self.spark.createDataFrame([("r", ids)], "request string, ids string")
        if not planning.outcome(request).first()["ok"]:
            return _error("no_targets", "give fail_ids or url")
        advice = planning.catalog(self.spark)
        return {"ok": True, "plan": _rows(planning.plan(request, advice, top).orderBy("place").drop("request")), "unknown_ids": [r["id"] for r in planning.unknown(request, advice, top).orderBy("pos").collect()]}

    def _observations(self, *wanted: str) -> DataFrame:
        return history.selected(recording.observations(self.spark, self.folder), *wanted)

    @answer
    def history(self, identity: str, kind: str = "", series: str = "", limit: int = 50) -> dict[str, Any]:
        own = self._observations(identity, kind, series)
        values = own.transform(lambda df: history.last_points(df, limit)).groupBy(*history.KEYS).agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "value", "n", "source"))).alias("values"))
        return {"ok": True, "identity": identity, "series": _rows(history.history(own).join(values, list(history.KEYS)).orderBy("kind", "series")), "sample_gate": P.MIN_N}

    @answer
    def changes(self, identity: str, kind: str = "", series: str = "") -> dict[str, Any]:
        found = _rows(history.changes(self._observations(identity, kind, series)).orderBy("kind", "series"))
        return {"ok": True, "identity": identity, "thresholds": {"min_n": P.MIN_N, "relative": P.RELATIVE, "absolute": P.ABSOLUTE}, "results": found}

    @answer
    def signals(self, status: str = "open", limit: int = 50) -> dict[str, Any]:
        found = _rows(history.listed(recording.signals(self.spark, self.folder), status, limit))
        return {"ok": True, "status": status, "count": len(found), "signals": found}

    def record(self, payload: str, as_of: str) -> dict[str, int]:
        """Take in a recording (a list of observations, or {"run": ..., "observations": [...]}) and recompute signals.

        Reading is open to all, writing is not a question: it has no answer envelope and is meant for the command line.
        Observations are numbered in the order in which they stand, after all that are there. A recording is known by its
        text: one that comes again, after a failure say, changes nothing (``repeated`` is 1).
        """
        given = json.loads(payload)
        run, rows = ({}, given) if isinstance(given, list) else (given.get("run") or {}, given.get("observations") or [])
        run = {"run_id": as_of, "ts": as_of} | {k: v for k, v in run.items() if v}
        name = hashlib.sha256(payload.encode()).hexdigest()
        lines = self.spark.createDataFrame([(json.dumps(r), name, as_of, 0, n) for n, r in enumerate(rows)], "value string, recording string, made_at string, block long, row long")
        counts = recording.record(jsonl.parse_lines(lines, recording.RAW, *recording.ARRIVAL), self.folder, run, as_of)
        counts = counts if counts["repeated"] else {k: v for k, v in counts.items() if k != "repeated"}
        return counts | {"signals": recording.signals(self.spark, self.folder).where("resolved_at IS NULL").count()}
