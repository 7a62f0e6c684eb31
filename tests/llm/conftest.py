from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k * 7919 % 5003}" for k in range(30_000))
BASE = " ".join(f"alpha{k} beta{k % 7} gamma{k % 11}" for k in range(60))

ROWS = [
    (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, BASE + " tail", None, "b", None), (4, None, None, None, None), (5, "", "en", "a", 0), (6, " \t\n ", "en", "b", 3),
    (7, LONG, "en", "a", 9), (None, BASE + " nobody", "en", "a", 4), (None, None, None, None, None), (8, "short text", "de", "b", 1), (8, "short text", "de", "b", 1), (9, "héllo wörld 😀 " * 3, "fr", "c", 2),
    (10, LONG + " end", "en", "c", 9), (11, "short  text", "de", None, 1),
]
CLASHING = ("size", "key", "shard", "bytes", "h", "at", "name", "target", "copies", "n", "depth", "component", "cluster", "rep", "word", "cell", "prefix", "bucket", "taken", "score", "toxic", "trusted", "_sub_key", "_sub_tie", "_mix_key", "_mix_range", "_mix_size", "_mix_copies", "_shard_cell", "_shard_bits", "_shard_row", "_dedup_node", "_dedup_order", "_aside_0", "shard_", "found", "spans", "tokens", "place", "finish")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns of clashing names."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, DOCS)
    return docs.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (7, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
