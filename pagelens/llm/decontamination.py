"""Benchmark decontamination by pigeonhole edit matching.

An item may be changed in up to ``budget`` characters. Cut into budget + 1 pieces, at least one piece stands
unchanged in whatever matches it; cut into SPARE more, 1 + SPARE pieces do. So exact hits of that many pieces
(found in one pass by an Aho-Corasick automaton over the pieces of all items) name the stretches in which the item
can stand, and Myers' bit-parallel edit distance decides there. Texts and items are compared in lower case with white space runs as one space.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import filter_batches, map_batches, table, texts

#: Share of an item's characters that may be changed.
BUDGET = 0.1
#: Pieces beyond budget + 1; each makes one more hit necessary, and chance hits of two pieces in one place are rare.
SPARE = 1
#: Items are sent to the executors in blocks of about this many characters; each block is one pass over the texts.
BLOCK_CHARS = 1 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(start, piece) of budget + 1 + SPARE pieces, or as many as there are characters; lengths differ by one at most. An
    item that must stand as it is, as short ones must, is one piece."""
    n = min(budget + 1 + SPARE, len(item)) if budget else 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(item: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best stretch of ``text`` (the first of the best), or None if all are over the budget."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = defaultdict(int)
    for k, c in enumerate(item):
        eq[c] |= 1 << k
    plus, minus, score, best, end = full, 0, m, budget + 1, -1
    for at, c in enumerate(text):
        e = eq.get(c, 0)
        v = e | minus
        h = (((e & plus) + plus) ^ plus) | e
        up, down = minus | (full & ~(h | plus)), plus & h
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, at + 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(v | up)), up & v
    return (best, end) if end >= 0 else None


class Matcher:
    """The items of one block; made once a worker."""

    def __init__(self, items: tuple[tuple[int, str], ...], budget: float):
        self.items = [(i, t, int(len(t) * budget)) for i, t in items if t]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for n, (_, text, most) in enumerate(self.items):
            cut = pieces(text, most)
            self.needed.append(len(cut) - most)
            for start, piece in cut:
                where[piece].append((n, start))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), tuple(at)))
        if where:
            self.automaton.make_automaton()
        self.any = bool(where)

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item_id, distance, end) of the best match of each item that the normal text holds."""
        if not self.any:
            return
        near: dict[int, list[tuple[int, int, set[int]]]] = defaultdict(list)
        for last, (length, at) in self.automaton.iter(text):
            first = last + 1 - length
            for n, start in at:
                _, item, most = self.items[n]
                low, high = max(0, first - start - most), first - start + len(item) + most
                spans = near[n]
                starts = {start}
                # Hits come in order of their ends, so a stretch may begin before those of several earlier hits.
                while spans and low <= spans[-1][1]:
                    low_, high_, starts_ = spans.pop()
                    low, high, starts = min(low, low_), max(high, high_), starts_ | starts
                spans.append((low, high, starts))
        for n in sorted(near):
            number, item, most = self.items[n]
            found = [(m[0], low + m[1]) for low, high, starts in near[n] if len(starts) >= self.needed[n] and (m := best_match(item, text[low:high], most))]
            if found:
                yield number, *min(found)


@functools.lru_cache(maxsize=2)
def matcher(items: tuple[tuple[int, str], ...], budget: float) -> Matcher:
    return Matcher(items, budget)


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, unnamed: bool = False) -> Iterator[tuple[tuple[int | None, str], ...]]:
    """The items in blocks of a bounded size, so that a benchmark of any size fits the executors' memory.

    Items without an id are left out unless ``unnamed``; they are dealt to blocks by their text.
    """
    if not unnamed:
        benchmark = benchmark.where("item_id IS NOT NULL")
    dealt = F.when(F.col("item_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("item_id"))
    total = benchmark.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)))).first()[0] or 0
    n = -(-total // block_chars)
    for k in range(n):
        part = benchmark.where(F.pmod(dealt, F.lit(n)) == k) if n > 1 else benchmark
        items = ((r["item_id"], normal(r["text"])) for r in part.select("item_id", "text").collect())
        yield tuple(sorted(items, key=lambda i: (i[0] is None, i[0] or 0, i[1])))


def matches(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block_chars: int = BLOCK_CHARS, unnamed: bool = False) -> DataFrame:
    """(doc_id, item_id, distance, match_end): a row for each document and item that it holds within the budget.

    The budget is a share of the item's characters, rounded down; match_end is an offset in the text in lower case
    with single spaces. Null and empty texts hold nothing; null or empty items are held by nothing.
    Items without an id are matched only if ``unnamed``, with a null item_id. Repeated rows each give their matches.
    Texts are searched whole, however long; an empty table on either side gives no rows; columns other than doc_id and
    text, item_id and text are not looked at.
    """
    out = None
    for items in blocks(benchmark, block_chars, unnamed):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def kernel(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            block = matcher(sent.value, budget)
            rows = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True) for m in block.find(normal(t))]
            return pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(("doc_id", "item_id", "distance", "match_end"))})

        part = map_batches(docs.select("doc_id", "text"), kernel, "doc_id long, item_id long, distance long, match_end long")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance long, match_end long")


def decontaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block_chars: int = BLOCK_CHARS, unnamed: bool = False) -> DataFrame:
    """The rows of ``docs`` that hold no item (none with an id, unless ``unnamed``), all columns as they were, without a shuffle.

    Null and empty texts hold nothing and stay, and so do all rows where there are no items; of repeated rows all stay or all
    go. Texts are searched whole, however long; columns may have any names.
    """
    for items in blocks(benchmark, block_chars, unnamed):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def keep(batch: pa.RecordBatch, sent=sent) -> list[bool]:
            block = matcher(sent.value, budget)
            return [next(block.find(normal(t)), None) is None for t in texts(batch)]

        docs = filter_batches(docs, keep)
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True)
