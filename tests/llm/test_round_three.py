"""License scan, vector codes and collocations against SQL, plain Python versions, and odd inputs."""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))

from pagelens.llm import collocations, licenses, queries, vector_codes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def duck(small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_licenses", "op12_vector_codes", "op13_collocations"])
def test_sql(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    asked = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(dict(zip(names, r, strict=True))[c] for c in columns)) for r in asked.fetchall()) and got


# ---- licenses

LONG = "x " * 300_000
LICENSED = [
    (1, "Released UNDER the MIT-License. under the mit license"), (1, "Released UNDER the MIT-License. under the mit license"), (2, None), (3, ""), (4, "under the mit permissive license"), (None, "cc by nc cc by nc"),
    (5, LONG + "Apache License, Version 2" + LONG + "apache license version 2"), (6, "underthe mit license cc-by_nc"), (7, "under the miK license; under the mİt license; CC BY NCé"), (8, "cc by cc by nc nc by"),
    (9, "Permission is hereby granted, free of charge, to any good person obtaining a copy of this software and associated documentation files"), (10, "permission is granted to any person to copy this software and its documentation files"),
    (11, "This work is licensed under the GNU General Public License, version 3."), (12, "this work is licensed under the gnu general public license version 2 of 3 parts"), (13, "the license " * 50),
]


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = [(k, label) for label, phrase in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    starts, labels = [k for k, _ in found], ",".join(sorted({x for _, x in found}))
    return len(words), len(found), min(starts, default=None), max(starts, default=None), labels


def test_licenses_of_odd_rows(spark):
    rows = [(d, t, "x", "y") for d, t in LICENSED]
    got = licenses.license_digest(spark.createDataFrame(rows, "doc_id long, text string, matches string, words string")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_base"], str(r["first_word"]), str(r["last_word"]), r["base_labels"]) for r in got) == sorted((str(d), *(str(v) if k in (2, 3) else v for k, v in enumerate(base_places(t)))) for d, t in LICENSED)
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[9] == "mit" and labels[10] == "" and labels[11] == "gpl-3" and labels[12] == "gpl-2" and labels[13] == "" and labels[1] == "mit"
    assert all((r["score"] > 0) == (r["labels"] != "") and 0 <= r["score"] <= 1 for r in got)
    assert licenses.license_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_license_plan_is_native(spark, small):
    plan = licenses.license_digest(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


# ---- vector codes


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 16), st.integers(1, 9), st.sampled_from([3, 200, 10**6, 2**29]))
def test_the_filter_loses_no_nearest_entry_and_no_tie(seed, entries, width, size):
    draw = np.random.default_rng(seed)
    books, asked = draw.integers(-size, size + 1, (entries, width)), draw.integers(-2 * size, 2 * size + 1, (40, width))
    asked[:entries] = books[: len(asked)]
    kind = object if size > vector_codes.WIDE else np.int64
    cells = vector_codes.Cells.of(books.astype(kind))
    entry, far = cells.nearest(np.ascontiguousarray(asked.T).astype(kind))
    all_far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(q, e, strict=True)) for e in books] for q in asked]
    assert [(int(e), int(f)) for e, f in zip(entry, far, strict=True)] == [(min(range(entries), key=lambda k: (d[k], k)), min(d)) for d in all_far]
    if entries == 16 and width > 3 and size == 10**6:
        assert cells.candidates(np.ascontiguousarray(asked.T)).mean() < 0.5  # it does filter


def test_few_bits_leave_more_candidates_and_the_same_entries():
    draw = np.random.default_rng(1)
    books, asked = draw.integers(-1000, 1000, (16, 8)), np.ascontiguousarray(draw.integers(-1000, 1000, (8, 500)))
    by_bits = [vector_codes.Cells.of(books, b) for b in (1, 2, 4, 8)]
    shares = [c.candidates(asked).mean() for c in by_bits]
    assert shares == sorted(shares, reverse=True) and all((c.nearest(asked)[0] == by_bits[0].nearest(asked)[0]).all() for c in by_bits)


def plain_codes(rows):
    """The contract, with every distance computed; rows (vec_id, embedding, label)."""
    kept = [(v, [int(np.floor(np.float64(np.float32(x)) * 4096)) for x in e], lab) for v, e, lab in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(order[0][1]) // 8
    cut = lambda x: [x[p * d : p * d + d] for p in range(8)]
    books = [[cut(r[1])[p] for r in order[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, v: min(range(len(books[p])), key=lambda k: (far(books[p][k], v), k))
    for _ in range(6):
        at = [[nearest(p, cut(r[1])[p]) for p in range(8)] for r in kept]
        for p in range(8):
            for k in range(len(books[p])):
                own = [cut(r[1])[p] for r, a in zip(kept, at, strict=True) if a[p] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(r[0], bytes(nearest(p, cut(r[1])[p]) for p in range(8)).hex(), sum(min(far(b, cut(r[1])[p]) for b in books[p]) for p in range(8)), r[2]) for r in kept]
    total = Counter()
    for _, _, e, lab in out:
        total[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(v), c, e, total[lab], digest) for v, c, e, lab in out)


@pytest.mark.parametrize("most", [vector_codes.BROADCAST_LABELS, 0])
def test_vector_codes_of_odd_rows(spark, monkeypatch, most):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", most)
    draw = np.random.default_rng(7)
    rows = [(int(v), [float(np.float32(x)) for x in draw.normal(size=16)], [None, 1, 2][v % 3]) for v in draw.permutation(60)]
    rows += [rows[0]] * 20 + [(5, rows[1][1], 1), (None, rows[2][1], None)]  # repeated rows, one id twice, none
    bad = [(70, None, 1), (71, [1.0] * 15 + [None], 1), (0, [float("nan")] * 16, 1), (1, [float("inf")] * 16, None), (72, [-float("inf")] * 16, 2)]
    schema = "vec_id long, embedding array<float>, label int, code string, error string"
    got = vector_codes.code_digest(spark.createDataFrame([(*r, "x", "y") for r in rows + bad], schema).repartition(5)).collect()
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == plain_codes(rows)
    few = vector_codes.code_digest(spark.createDataFrame([(*r, "x", "y") for r in rows[:5]], schema)).collect()
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in few) == plain_codes(rows[:5])
    assert vector_codes.code_digest(spark.createDataFrame([], schema)).collect() == []
    mixed = vector_codes.code_digest(spark.createDataFrame([(*r, "x", "y") for r in [*rows[:5], (90, [1.0] * 8, 1), (91, [], 1)]], schema)).collect()
    assert {r["vec_id"]: r["code"] for r in mixed if r["vec_id"] in (90, 91)} == {90: None, 91: None}


def test_wide_vectors(spark):
    rows = [(k, [float(np.float32(50_000.0 * (k - 3) + j)) for j in range(8)], 1) for k in range(20)]
    got = vector_codes.code_digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == plain_codes(rows)


# ---- collocations


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.uint64)
    made = collocations.PerfectHash(keys)
    assert made.n == len(keys) and sorted(made.slots(keys)) == list(range(len(keys)))


def test_a_phrase_with_a_candidates_hash_is_counted_aside(monkeypatch):
    keys = np.array([[3, 5, 3, 5, 3], [4, 6, 4, 6, 4], [0, 0, 0, 0, 0]], np.uint64)
    monkeypatch.setattr(collocations, "hashes_of", lambda k: np.full(k.shape[1], 9, np.uint64))
    block = collocations._Block(0)
    block.hold(np.array([9, 11], np.uint64))
    block.add(keys, np.array([9, 20, 4, 1, 2], np.uint32))
    block.add(keys[:, :2], np.array([1, 2], np.uint32))
    assert sorted(map(tuple, block.rows().to_pandas().to_numpy().tolist())) == [(3, 4, 0, 16), (5, 6, 0, 23)]


def plain_collocations(rows, top):
    ones, phrases = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            ones.update((lang, x) for x in w)
            phrases.update((lang, *w[k : k + n]) for n in (2, 3) for k in range(len(w) - n + 1))
    f = lambda lang, w: ones[lang, w[0]] if len(w) == 1 else phrases[lang, *w]
    found = {p: a for p, a in phrases.items() if a >= 10}
    out = {}
    for (lang, *w), a in found.items():
        if len(w) == 2 and any(100 * b >= 50 * a for (x, *v), b in found.items() if x == lang and len(v) == 3 and w in (v[:2], v[1:])):
            continue
        cuts = [(1_000_000 * a * a // (f(lang, w[:k]) * f(lang, w[k:])), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), a, f(lang, w[:k]), f(lang, w[k:])))
    n = Counter()
    for (lang, _), k in ones.items():
        n[lang] += k
    return {(lang, r, p.decode(), a, left, right, n[lang], -s) for lang, all_ in out.items() for r, (s, _, p, a, left, right) in enumerate(sorted(all_)[:top], 1)}


@pytest.mark.parametrize("small_steps", [False, True])
def test_collocations_of_odd_rows(spark, monkeypatch, small_steps):
    if small_steps:
        for name, value in (("BLOCK", 4), ("BUFFER_WORDS", 50), ("BUFFER_PHRASES", 60), ("BROADCAST_WORDS", 0), ("RANKED", 8)):
            monkeypatch.setattr(collocations, name, value)
    draw = np.random.default_rng(3)
    names = ["Alpha", "beta", "éta", "x y", "w" * 500, "日本", "a-b", "(c)"]
    text = lambda n: " ".join(("\t" if draw.random() < 0.1 else "") + str(draw.choice(names)) + str(draw.choice(["", "", "", ".", "\n", "!"])) for _ in range(n))
    rows = [(str(draw.choice(["en", "en", "en", "de"])), text(int(draw.integers(0, 60)))) for _ in range(60)]
    rows += [(None, "one two three four. " * 12), ("und", "one two. three"), ("fr", None), (None, None), ("fr", ""), ("", "a b " * 15), ("en", "New York City " * 11), ("en", "same row here"), *[("it", "san marino; san marino; la san remo")] * 10]
    schema = "lang string, text string, key string, h string, n string, block string"
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], schema).repartition(4)
    got = {tuple(r) for r in collocations.best(collocations.phrases(docs), 40).collect()}
    assert got == plain_collocations(rows, 40) and {r[0] for r in got} >= {"en", "und", "", "it"}


def test_collocations_of_empty_tables(spark):
    for rows in ([], [("en", "a b c")], [(None, None)]):
        assert collocations.best(collocations.phrases(spark.createDataFrame(rows, "lang string, text string"))).collect() == []
