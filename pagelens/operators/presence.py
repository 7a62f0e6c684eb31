"""Which brands stand in which texts: runs of a text's words are looked up among the brands where the text lies.

Texts and brands are words: lower case, runs of letters and digits. Runs of as many words as some brand has are hashed and
held against a bit filter of the brands, of fixed size; those it lets through are counted by their words, and the counts
are joined with the brands, so no text is moved, and nothing for a brand that it might but does not hold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many brands go to every executor; beyond, the counts are dealt out to them.
BROADCAST_BRANDS = 1 << 16
#: Bits of the filter, 8 MiB; how many counts a task holds before it sends them on.
FILTER_BITS, BUFFER = 26, 1 << 17


def normal(text: Column) -> Column:
    """The words of a text with one space between and around them; a space where there are none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def _sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_BRANDS else rows


def _places():
    """words, length -> for every run of that many words the bit that stands for it. (Made here, so that workers get it whole.)"""
    import zlib

    import numpy as np

    factor, shift, held = 0x9E3779B97F4A7C15, np.uint64(64 - FILTER_BITS), {}

    def powers(base: int, n: int) -> np.ndarray:
        if len(held.get(base, ())) <= n:
            held[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, base, np.uint64)]), dtype=np.uint64)
        return held[base][:n]

    def places(words: list[bytes], lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        n = len(words)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(np.fromiter(map(zlib.crc32, words), np.uint64, n) * powers(factor, n), out=sums[1:])
        back = powers(pow(factor, -1, 1 << 64), n)
        for size in lengths:
            if size <= n:
                runs = (sums[size:] - sums[: n + 1 - size]) * back[: n + 1 - size]
                yield size, ((runs ^ (runs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift

    return places


def _filter(phrases: DataFrame) -> tuple[list[int], bytes]:
    """The numbers of words that phrases (phrase) have, and the filter: a bit for each phrase."""

    places = _places()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(w), int(next(places(w, [len(w)]))[1][0])) for w in (p.encode().split() for p in batch.column("phrase").to_pylist())]
            yield pa.RecordBatch.from_pydict({"n": pa.array([n for n, _ in found], pa.int32()), "bit": pa.array([b for _, b in found], pa.int64())})

    marks = phrases.select("phrase").mapInArrow(run, "n int, bit long")
    at = F.col("bit") + 1
    parts = marks.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"), F.collect_set("n").alias("n"))
    out, lengths = bytearray(1 << (FILTER_BITS - 3)), set()
    for r in parts.collect():  # 2,048 parts of 4 KiB at most
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = r["bits"]
        lengths.update(r["n"])
    return sorted(lengths), bytes(out)


def _counts(texts: DataFrame, phrases: DataFrame, by: str) -> DataFrame:
    """(by, phrase, n): how many texts (by, text) hold a phrase, for runs of words that the filter lets through."""
    lengths, bits = _filter(phrases)
    sent, most, places = texts.sparkSession.sparkContext.broadcast(bits), BUFFER, _places()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known, held = np.frombuffer(sent.value, np.uint8), Counter()

        def rows(kind: pa.DataType) -> pa.RecordBatch:
            who, phrase = zip(*held, strict=True)
            return pa.RecordBatch.from_pydict({by: pa.array(who, kind), "phrase": pa.array([f" {p.decode()} " for p in phrase], pa.string()), "n": pa.array(held.values(), pa.int64())})

        kind = None
        for batch in batches:
            kind = batch.schema.field(by).type
            for who, text in zip(batch.column(by).to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = text.encode().split()
                found = set()
                for size, at in places(words, lengths):
                    hits = np.flatnonzero(known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                    found.update(b" ".join(words[i : i + size]) for i in hits.tolist())
                held.update((who, p) for p in found)
                if len(held) >= most:
                    yield rows(kind)
                    held.clear()
        if held:
            yield rows(kind)

    made = texts.select(by, normal(F.col("text")).alias("text"))
    return made.mapInArrow(run, f"{by} {made.schema[by].dataType.simpleString()}, phrase string, n long").groupBy(by, "phrase").agg(F.sum("n").alias("n"))


def _named(texts: DataFrame, brands: DataFrame, by: str) -> DataFrame:
    named = brands.select("brand", normal(F.col("brand")).alias("phrase")).where("phrase <> '  '").distinct()
    return _counts(texts, named, by).join(_sent(named), "phrase").select("brand", by, "n")


def mentions(texts: DataFrame, brands: DataFrame) -> DataFrame:
    """(key, brand) for every text (key, text) that holds all words of a brand (brand) one after the other.

    Null texts hold nothing, brands without words are nowhere. Keys must be distinct.
    """
    return _named(texts, brands, "key").select("key", "brand")


def presence(texts: DataFrame, brands: DataFrame) -> DataFrame:
    """(brand, host, n_pages, share): how many texts (host, text) of each host hold a brand, and their share in percent."""
    sizes = texts.groupBy("host").agg(F.count("*").alias("n"))
    found = _named(texts, brands, "host").withColumnRenamed("n", "n_pages")
    joined = found.join(sizes.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")))
    return joined.select("brand", "host", "n_pages", F.bround(F.col("n_pages").cast("double") / F.col("n") * 100, 1).alias("share"))
