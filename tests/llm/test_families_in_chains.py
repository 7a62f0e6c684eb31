"""Groups without counts: families that chance meetings chain together move each set a few times, not once a signature."""

from __future__ import annotations

import random

import brute
import pytest

from pagelens.llm import ngram_join


def chained_families():
    """(doc_id, text): ten families of near copies; every family shares passages with the next, and some copies are edited so much that they link with few or none."""
    rnd, rows = random.Random(7), []
    passages = [[f"p{k}w{i}" for i in range(60)] for k in range(11)]
    for family in range(10):
        words = [*passages[family], *(f"f{family}w{i}" for i in range(160)), *passages[family + 1]]
        for n in range(24):
            changed = list(words)
            for _ in range(rnd.choice((0, 1, 1, 2, 3, 9, 12))):
                changed[rnd.randrange(len(changed))] = f"z{rnd.getrandbits(30)}"
            rows.append((family * 100 + n, " ".join(changed)))
    return rows


@pytest.mark.parametrize("small", [1 << 14, 1 << 16, ngram_join.SMALL])
def test_groups_without_counts(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    rows, rule = chained_families(), ngram_join.Rule()
    want = {d: v[1] for d, v in brute.shingle_groups(rows, rule.words, rule.num, rule.den).items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.joined(docs, rule, counted=False).collect()}
    assert got == want and len(set(want.values())) > 10
    assert {r["doc_id"] for r in ngram_join.deduplicated(docs).collect()} == set(want.values())


def test_a_family_in_blocks_is_not_moved_once_a_block(spark, monkeypatch):
    """200 near copies of one text in 27 blocks: a set was moved once a block."""
    rnd, words, rows = random.Random(3), [f"w{k}" for k in range(300)], []
    for n in range(200):
        changed = list(words)
        changed[rnd.randrange(300)] = f"z{n}"
        rows.append((n, " ".join(changed)))
    checked, moved = ngram_join.verified, []
    monkeypatch.setattr(ngram_join, "SMALL", 1 << 14)
    monkeypatch.setattr(ngram_join, "verified", lambda rows, rule: moved.append(rows.count()) or checked(rows, rule))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert [r["doc_id"] for r in ngram_join.deduplicated(docs).collect()] == [0]
    without = sum(moved)
    moved.clear()
    ngram_join.joined(docs, ngram_join.Rule()).collect()
    assert 4 * without < sum(moved), (without, moved)  # counts of links need all pairs of blocks, as groups did before
