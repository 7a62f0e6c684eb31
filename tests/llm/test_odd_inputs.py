"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute
from conftest import BASE, CLASHING, DOCS, ROWS

import corpus_pipeline
from pagelens.llm import decontamination, media, mixing, ngram_join, pii, quality, secrets, sharding, substrings, toxicity


def bench(spark):
    return spark.createDataFrame([(1, "alpha3 beta3 gamma3 alpha4 beta4 gamma4 alpha5 beta5 gamma5"), (2, None), (None, "x"), (3, "")], "item_id long, text string")


def applied(spark, docs, labels):
    """name -> result of each operator over any table of documents."""
    return {
        "secrets": secrets.secret_digest(docs),
        "toxicity": toxicity.graded(docs, toxicity.train(docs, labels)),
        "sharding": sharding.assign(docs, 20_000),
        "ngram_join": ngram_join.joined(docs, ngram_join.CONTRACT),
        "decontamination": decontamination.decontaminated(docs, bench(spark)),
        "pii": pii.pii_digest(docs),
        "substrings": substrings.digest(docs),
        "mixing": mixing.queue(docs),
        "quality": quality.scored(docs, quality.train(docs, labels)),
        "media": media.media_digest(docs),
    }


@pytest.fixture(scope="module")
def results(spark, odd, labels):
    return {k: df.collect() for k, df in applied(spark, odd, labels).items()}


@pytest.mark.parametrize("name", ["secrets", "toxicity", "sharding", "ngram_join", "pii", "substrings", "mixing", "quality", "media"])
def test_a_row_for_every_row(results, name):
    assert sorted(map(str, (r["doc_id"] for r in results[name]))) == sorted(str(r[0]) for r in ROWS)


def test_empty_tables(spark, none, labels):
    for name, df in applied(spark, none, labels).items():
        assert df.collect() == [], name
    no_labels = labels.limit(0)
    assert quality.train(none, no_labels) is not None and toxicity.train(none, no_labels).weights == {}


def test_without_labels(spark, odd, labels):
    assert {r["score"] for r in quality.scored(odd, quality.train(odd, labels.limit(0))).collect()} == {0.5}
    assert not any(r["toxic"] for r in toxicity.graded(odd, toxicity.train(odd, labels.limit(0))).collect())


def test_ngram_join_of_odd_rows(results):
    got = {}
    for r in results["ngram_join"]:
        got.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"], r["n_links"]))
    want = brute.shingle_groups([(d, t) for d, t, *_ in ROWS if d is not None], 3, 90, 100)
    assert {d: {w} for d, w in want.items()} == {d: g for d, g in got.items() if d is not None}
    assert all(c is None and n_links == 0 for _, c, n_links in got[None])


def test_rows_of_one_id_with_different_texts_are_one_node(spark):
    one, two = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    docs = spark.createDataFrame([(3, one), (3, two), (1, one), (7, two + " tail"), (9, "c d e f"), (None, one)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.joined(docs, ngram_join.CONTRACT).collect()}
    assert got == {(3, 1), (1, 1), (7, 1), (9, 9), (None, None)}


def test_substrings_of_odd_rows(results):
    # A null doc_id comes last, and repeated rows are one document.
    rows = {(d if d is not None else 2**62 + k): t for k, (d, t, *_) in enumerate(ROWS)}
    want = brute.substrings(list(rows.items()))
    for r in results["substrings"]:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]
    assert {(r["n_words"], r["n_removed"]) for r in results["substrings"] if r["doc_id"] is None} == {(0, 0), (181, 180)}


@pytest.mark.parametrize("most", [substrings.BROADCAST_ROWS, 0])
def test_substrings_of_rows_that_share_an_id(spark, monkeypatch, most):
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", most)
    word = lambda name, n=20: " ".join(f"{name}{k}" for k in range(n))
    p, q, r, last = word("p"), word("q", 25), word("r", 30), 2**63 - 1
    rows = [(1, p), (None, f"{p} {word('a')}"), (None, f"{word('b')} {p}")]  # lose p alone
    rows += [(None, f"{q} {word('c')}"), (None, f"{q} {word('d')}")]  # one of them loses q
    rows += [(2, f"{r} {word('e')}"), (2, f"{r} {word('f')}")]  # one of them loses r
    rows += [(None, word("g", 50)), (None, word("g", 50)), (3, word("h", 50)), (3, word("h", 50))]  # repeated rows
    rows += [(last, word("i", 50)), (None, word("i", 50))]  # a null comes after the greatest id
    rows += [(None, None), (None, ""), (2, None)]
    got = [(r["doc_id"], r["text"]) for r in substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    for one in ((1, p), (None, word("a")), (None, word("b")), (last, word("i", 50))):
        assert got.count(one) == 1
    for doc, shared, a, b in ((None, q, "c", "d"), (2, r, "e", "f")):
        kept = sorted(t for d, t in got if d == doc and (word(a) in t or word(b) in t))
        assert kept in (sorted([f"{shared} {word(a)}", word(b)]), sorted([word(a), f"{shared} {word(b)}"]))
    assert got.count((None, word("g", 50))) == 2 and got.count((3, word("h", 50))) == 2
    assert got.count((None, "")) == 3 and got.count((2, "")) == 1 and len(got) == len(rows)


def test_mixing_of_odd_rows(results):
    sizes = {}
    for r in results["mixing"]:
        sizes.setdefault(r["source"], []).append(r)
    for rows in sizes.values():
        assert abs(sum(r["_mix_taken"] for r in rows) - rows[0]["_mix_target"]) <= 1
        assert all(0 <= r["_mix_taken"] <= 2 * r["_mix_size"] for r in rows)


def test_sharding_keeps_clashing_columns(results):
    for r in results["sharding"]:
        assert {c for c, v in r.asDict().items() if v == "x"} == set(CLASHING) - {"shard"}  # which is replaced


def test_decontaminated_keeps_columns(results, odd):
    left = results["decontamination"]
    assert set(left[0].asDict()) == set(odd.columns)
    assert sorted(str(r["doc_id"]) for r in left) == sorted(str(d) for d, t, *_ in ROWS if not (t or "").startswith(BASE[:50]))


def test_near_duplicates_of_odd_rows(odd):
    left = [r["doc_id"] for r in ngram_join.deduplicated(odd).collect()]
    assert sorted(d for d in left if d is not None) == [1, 4, 5, 6, 7, 8, 9] and left.count(None) == 2


@pytest.mark.parametrize("most", [ngram_join.BROADCAST_ROWS, 0])
def test_near_duplicates_of_rows_that_share_an_id(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", most)
    one, two, three, four, five = (" ".join(f"{name}{k}" for k in range(40)) for name in "abcde")
    kept = [(1, one, "x"), (3, two, "x"), (5, three, "x"), (5, None, "x"), (6, "", "x"), (6, " ", "x"), (6, " ", "x"), (8, four, "x"), (8, five, "x"), (None, one, "x")]
    gone = [(3, one, "x"), (7, f"{two} tail", "x"), (9, four, "x"), (9, f"{five} tail", "x"), (8, four, "x")]
    schema = "doc_id long, text string, source string"
    for rows in (kept + gone, gone[::-1] + kept[::-1]):
        got = [tuple(r) for r in ngram_join.deduplicated(spark.createDataFrame(rows, schema)).collect()]
        assert sorted(got, key=str) == sorted(kept, key=str)
    # Repeated rows that differ elsewhere: the same one stays however they come, and so does one of near copies.
    rows = [(1, one, s) for s in "abcdef"] + [(2, two, "a"), (2, f"{two} tail", "a")]
    left = [sorted(ngram_join.deduplicated(spark.createDataFrame(r, schema).repartition(n)).collect()) for r, n in ((rows, 1), (rows[::-1], 3))]
    assert left[0] == left[1] and [r["doc_id"] for r in left[0]] == [1, 2]


def rows_of(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()), key=str)


def test_pipeline_of_odd_rows(spark, odd, labels, tmp_path):
    """Every stage's rows are what its operator says of the rows before; columns and their values stay as they were."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, columns, held = odd, odd.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        held[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == columns and all(r[c] == "x" for r in held[name] for c in CLASHING)
        old, new = rows_of(before), rows_of(docs)
        if name == "quality":
            model = quality.train(before, labels)
            scores = {(r["doc_id"], r["score"]) for r in quality.scored(before, model).collect()}
            assert {r[0] for r in new} == {d for d, s in scores if s >= quality.THRESHOLD}
        elif name == "near_duplicates":
            nodes = {k: (r[0] if r[0] is not None else None, r[1]) for k, r in enumerate(old)}
            groups = brute.shingle_groups([(d, t) for d, t in nodes.values() if d is not None and (t or "").split()], 5, 80, 100)
            kept = {d for d, g in groups.items() if g[1] == d} | {d for d, t in nodes.values() if d is not None and not (t or "").split()}
            assert {r[0] for r in new if r[0] is not None} == kept and [r for r in new if r[0] is None] == [r for r in old if r[0] is None]
        elif name == "decontamination":
            assert new == [r for r in old if not (r[1] or "").startswith(BASE[:50])]
        elif name == "mixing":
            taken = mixing.queue(before).collect()
            assert sorted(str(r[0]) for r in new) == sorted(str(r["doc_id"]) for r in taken for _ in range(int(r["_mix_taken"] / max(1, r["_mix_size"]) + 0.5)))
        else:
            assert new == old and {c for r in held[name] for c in r.asDict()} == {*columns, "shard", "shard_depth", "shard_bytes"}
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(corpus_pipeline.run(spark, str(tmp_path))) == rows_of(docs)


def test_pipeline_of_an_empty_table(spark, none, labels, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and set(out.columns) == {*none.columns, "shard", "shard_depth", "shard_bytes"}
