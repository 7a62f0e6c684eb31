"""Removal of repeated word sequences, found by difference-cover anchors.

COVER is a perfect difference set modulo PERIOD: for any two positions there is a shift under PERIOD that takes
both into the cover. So if two windows of WINDOW words are equal, they hold equal runs of WINDOW - PERIOD + 1
words that start, in both, at cover positions and under PERIOD words from the windows' starts. Hence:

1. hash those shorter runs at cover positions only (4 of 13) and keep the anchors found more than once;
2. extend: hash the full windows around kept anchors only, and order equal ones by where they start;
3. every window but the first of its kind is repeated, and its words go.

A task gathers the entries of many batches before it sends them. Among those, equal anchors or windows are settled on
the spot and only the first goes on, so a passage that very many documents share reaches one reducer once in about half
a million entries, not once a document; the others go in rows by buckets of hashes, each full of entries.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import checkpoint, grouped, map_batches, partitions, prepare, table, texts
from pagelens.llm.hashing import C1, C3, join_hashes, scramble, windows, word_hashes

WINDOW = 20
# The perfect difference set of order 3.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: What a row is known by and ordered by: its doc_id (null as the last), and a hash of its text where that is not enough.
KEY, TIE = "_sub_key", "_sub_tie"
#: Ids that stand with several texts are sent to every executor only up to this many; beyond, the texts are shuffled.
BROADCAST_ROWS = 1 << 20
#: Bytes of text whose entries make one bucket, and whose found places make one slice at most.
BUCKET_BYTES, SLICE_BYTES = 16 << 20, 128 << 20
#: Entries that a task gathers before it sends them: at least and at most, and for each bucket in between, so that rows
#: hold eight entries or more up to some 8 TB of text, and a worker needs some 100 to 500 MB for them.
GATHER, GATHER_MOST, GATHER_PER_BUCKET = 1 << 19, 1 << 22, 8


def _words(text: str) -> list[bytes]:
    return text.encode().split()


def _laid_out(batch: pa.RecordBatch, least: int):
    """The batch's documents of at least ``least`` words by key: (keys, starts, lengths, hashes of all words, rows).

    Keys, here and below, have two rows: KEY and TIE.
    """
    keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (KEY, TIE)])
    rows = np.lexsort(keys[::-1])
    words = [_words(t) for t in texts(batch)]
    rows = rows[[len(words[r]) >= least for r in rows]] if len(rows) else rows
    lengths = np.array([len(words[r]) for r in rows], np.int64)
    hashes = word_hashes([w for r in rows for w in words[r]])
    return keys[:, rows], np.cumsum(lengths) - lengths, lengths, hashes, rows


def _settled(hashes: list[np.ndarray], key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """For entries in order of (key, pos): 0 alone among them, 1 first of several or a repeated row of it, 2 a later one."""
    if not len(pos):
        return np.zeros(0, np.int8)
    order, starts, count = _runs(hashes)
    first = np.repeat(order[starts], count)
    same = (key[:, order] == key[:, first]).all(axis=0) & (pos[order] == pos[first])
    known = np.empty(len(pos), np.int8)
    known[order] = np.where(same, np.repeat(count > 1, count), 2)
    return known


def _runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stable order by all columns, starts of runs of equal entries in it, their lengths)."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    starts = np.flatnonzero(new)
    return order, starts, np.diff(np.append(starts, len(order)))


SENT = "bucket int, found boolean, h1 binary, h2 binary, places binary, n int"


def _send(n_buckets: int, hashes: list[np.ndarray], key: np.ndarray, pos: np.ndarray, go: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket of hashes that the entries ``go`` are in, and one with the places already found.

    A row holds columns of entries: hashes as they are, places compressed, which costs half of what a row for
    each entry would.
    """
    bucket = (hashes[0] % np.uint64(n_buckets)).astype(np.int64)
    rows: dict[str, list] = {n: [] for n in ("bucket", "found", "h1", "h2", "places", "n")}
    at = np.flatnonzero(go)
    at = at[np.argsort(bucket[at], kind="stable")]
    cuts = np.flatnonzero(np.diff(bucket[at])) + 1
    for part in np.split(at, cuts) if len(at) else []:
        _row(rows, int(bucket[part[0]]), False, [h[part] for h in hashes], key[:, part], pos[part])
    at = np.flatnonzero(found)
    if len(at):
        _row(rows, int(bucket[at[0]]), True, [], key[:, at], pos[at])
    kinds = {"bucket": pa.int32(), "found": pa.bool_(), "h1": pa.binary(), "h2": pa.binary(), "places": pa.binary(), "n": pa.int32()}
    return pa.RecordBatch.from_pydict({n: pa.array(v, kinds[n]) for n, v in rows.items()})


def _gathered(docs: DataFrame, n_buckets: int, entries, split) -> DataFrame:
    """Rows SENT of the entries (hashes, key, pos) of all batches, settled by many batches at once; ``split`` says from
    what is known of each which go on and which are found."""
    most = min(GATHER_MOST, max(GATHER, n_buckets * GATHER_PER_BUCKET))

    def flushed(held: list) -> pa.RecordBatch:
        hashes = [np.concatenate(h) for h in zip(*(x[0] for x in held), strict=True)]
        key, pos = np.concatenate([x[1] for x in held], axis=1), np.concatenate([x[2] for x in held])
        order = np.lexsort((pos, *key[::-1]))
        hashes, key, pos = [h[order] for h in hashes], key[:, order], pos[order]
        go, found = split(_settled(hashes, key, pos))
        return _send(n_buckets, hashes, key, pos, go, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows and (got := entries(batch)) is not None and len(got[2]):
                held.append(got)
                n += len(got[2])
            if n >= most:
                yield flushed(held)
                held, n = [], 0
        if held:
            yield flushed(held)

    prepare(docs.sparkSession)
    return docs.mapInArrow(run, SENT)


def _row(rows: dict[str, list], bucket: int, found: bool, hashes: list[np.ndarray], key: np.ndarray, pos: np.ndarray) -> None:
    second = (hashes[1] >> np.uint64(32)).astype(np.uint32).tobytes() if len(hashes) > 1 else None
    for name, value in zip(rows, (bucket, found, hashes[0].tobytes() if hashes else None, second, _packed(key, pos), len(pos)), strict=True):
        rows[name].append(value)


def _packed(key: np.ndarray, pos: np.ndarray) -> bytes:
    return zlib.compress(np.diff(key, axis=1, prepend=np.int64(0)).tobytes() + pos.astype(np.int32).tobytes(), 1)


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, positions = [], []
    for blob, n in zip(rows.column("places").to_pylist(), rows.column("n").to_pylist(), strict=True):
        raw = zlib.decompress(blob)
        keys.append(np.cumsum(np.frombuffer(raw, np.int64, 2 * n).reshape(2, n), axis=1))
        positions.append(np.frombuffer(raw, np.int32, n, 16 * n))
    return np.concatenate(keys, axis=1), np.concatenate(positions)


def _received(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(hashes, keys, positions) of rows with hashes or of rows without."""
    hashes = [np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in (("h1", np.uint64), ("h2", np.uint32)) if rows.column(c).null_count == 0]
    return hashes, *_unpacked(rows)


def _resolved(sent: DataFrame, n_slices: int, choose) -> DataFrame:
    """(key, at): the places found already, and those that ``choose`` (hashes, keys, positions) -> mask picks from each bucket.

    What a bucket finds goes on by slices of the keys, packed as it came.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["bucket"]):
            done = group.column("found")
            keys, places = [], []
            for part, known in ((group.filter(done), True), (group.filter(pa.compute.invert(done)), False)):
                if part.num_rows:
                    hashes, key, pos = _received(part)
                    picked = slice(None) if known else choose(hashes, key, pos)
                    keys.append(key[:, picked])
                    places.append(pos[picked])
            key, pos = np.concatenate(keys, axis=1), np.concatenate(places)
            to = (scramble(join_hashes(*key.view(np.uint64))) % np.uint64(n_slices)).astype(np.int32)
            order = np.lexsort((pos, *key[::-1], to))
            key, pos, to = key[:, order], pos[order], to[order]
            parts = np.split(np.arange(len(pos)), np.flatnonzero(np.diff(to)) + 1) if len(pos) else []
            yield pa.RecordBatch.from_pydict({"slice": pa.array([int(to[p[0]]) for p in parts], pa.int32()), "places": pa.array([_packed(key[:, p], pos[p]) for p in parts], pa.binary()), "n": pa.array(map(len, parts), pa.int32())})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["slice"]):
            key, pos = _unpacked(group)
            order = np.lexsort(key[::-1])
            key, pos = key[:, order], pos[order]
            cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(pos)]]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({KEY: key[0, cuts[:-1]], TIE: key[1, cuts[:-1]], "at": pa.ListArray.from_arrays(pa.array(cuts), pa.array(pos))})

    found = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(pick, "slice int, places binary, n int")
    return found.repartition("slice").sortWithinPartitions("slice").mapInArrow(gather, f"{KEY} long, {TIE} long, at array<int>")


def anchors(docs: DataFrame, window: int, n_buckets: int, n_slices: int) -> DataFrame:
    """(key, at): positions of the anchors that stand more than once."""
    run = window - PERIOD + 1

    def entries(batch: pa.RecordBatch):
        keys, starts, lengths, words, _ = _laid_out(batch, window)
        h = windows(words, run)
        doc = np.repeat(np.arange(len(lengths)), lengths)[: len(h)]
        pos = np.arange(len(h)) - starts[doc]
        at = np.flatnonzero(np.isin(pos % PERIOD, COVER) & (pos + run <= lengths[doc]))
        return [h[at]], keys[:, doc[at]], pos[at]

    def repeated(hashes: list[np.ndarray], key: np.ndarray, pos: np.ndarray) -> np.ndarray:
        order, _, count = _runs(hashes)
        return order[np.repeat(count > 1, count)]

    return _resolved(_gathered(docs, n_buckets, entries, lambda known: (known < 2, known > 0)), n_slices, repeated)


def later_windows(docs: DataFrame, window: int, n_buckets: int, n_slices: int) -> DataFrame:
    """(key, at): starts of windows that start earlier elsewhere, of documents with ``at`` (the kept anchors' positions)."""

    def entries(batch: pa.RecordBatch):
        keys, starts, lengths, words, rows = _laid_out(batch, window)
        if not len(lengths):
            return None
        at = batch.column("at").take(pa.array(rows))
        n = np.asarray(pa.compute.list_value_length(at).fill_null(0), np.int64)
        p = np.asarray(at.flatten(), np.int64)
        doc = np.repeat(np.arange(len(lengths)), n)
        low = np.maximum(p - PERIOD + 1, 0) + starts[doc]
        high = np.minimum(p, lengths[doc] - window) + starts[doc]
        ok = high >= low
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, low[ok], 1)
        np.add.at(edge, high[ok] + 1, -1)
        where = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        doc = np.repeat(np.arange(len(lengths)), lengths)[where]
        return [windows(words, window, by)[where] for by in (C1, C3)], keys[:, doc], where - starts[doc]

    def later(hashes: list[np.ndarray], key: np.ndarray, pos: np.ndarray) -> np.ndarray:
        by_place = np.lexsort((pos, *key[::-1]))
        order, starts, count = _runs([h[by_place] for h in hashes])
        order = by_place[order]
        first = np.repeat(order[starts], count)
        # Repeated rows of the first one are not copies of it.
        return order[(key[:, order] != key[:, first]).any(axis=0) | (pos[order] != pos[first])]

    return _resolved(_gathered(docs, n_buckets, entries, lambda known: (known < 2, known == 2)), n_slices, later)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, KEY and TIE, which only identical rows share.

    TIE is the text's hash for null ids, the hash's complement for ids that stand with several texts and -1 for all
    others, so that entries of most rows carry no hash. Nulls come after all ids, the greatest included.
    """
    hashed = F.shiftrightunsigned(F.xxhash64("text"), 1)
    several = docs.where("doc_id IS NOT NULL").select("doc_id", hashed.alias("h")).groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("doc_id", F.lit(True).alias(TIE))
    several = checkpoint(several)
    n = several.count()
    rows = docs.select("doc_id", "text")
    rows = rows.join(F.broadcast(several) if n <= BROADCAST_ROWS else several, "doc_id", "left") if n else rows.withColumn(TIE, F.lit(None).cast("boolean"))
    tie = F.when(F.col("doc_id").isNull(), hashed).when(F.col(TIE), -1 - hashed).otherwise(F.lit(-1).cast("long"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)).alias(KEY), tie.alias(TIE), "text")


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text and ``at``: the starts of the document's windows that start earlier elsewhere (null: none)."""
    if window < PERIOD + 1:
        raise ValueError(f"windows of at least {PERIOD + 1} words")
    rows = _keyed(docs)
    # Buckets and slices follow the text, so that one's entries fit a worker whatever the input.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = partitions(docs.sparkSession)
    n = (max(least, size // BUCKET_BYTES), max(least, size // SLICE_BYTES))
    # One shuffle of the texts serves both joins.
    by_doc = rows.repartition(KEY, TIE)
    near = by_doc.join(anchors(rows.select(KEY, TIE, "text"), window, *n).hint("shuffle_hash"), [KEY, TIE])
    again = later_windows(near, window, *n)
    return by_doc.join(again.hint("shuffle_hash"), [KEY, TIE], "left").select("doc_id", "text", "at")


def _kept(text: str, at: list[int] | None, window: int) -> tuple[list[bytes], int]:
    words = _words(text)
    if not at:
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int64)
    inside = np.array(at)[np.array(at) <= len(words) - window]
    edge[inside] += 1
    edge[inside + window] -= 1
    keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return [words[k] for k in keep], len(words)


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and text without its repeated words; the kept ones are joined by one space.

    Null and empty texts give an empty text. Null doc_ids come after all others. Rows of one doc_id with
    different texts are documents of their own, in an order by a hash of the text, and so are rows without an id.
    Identical rows are one document: neither is a copy of the other. Texts are read whole, however long; an empty
    table gives no rows; columns other than doc_id and text are not looked at.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [b" ".join(_kept(t, at, window)[0]).decode() for t, at in zip(texts(batch), batch.column("at").to_pylist(), strict=True)]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "text": pa.array(out, pa.string())})

    return map_batches(removals(docs, window), kernel, "doc_id long, text string")


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of what ``deduplicated`` keeps; a row for every row. An empty table gives no
    rows; texts of any length are worked on whole; columns other than doc_id and text are not looked at."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [_kept(t, at, window) for t, at in zip(texts(batch), batch.column("at").to_pylist(), strict=True)]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "n_words": pa.array([n for _, n in out], pa.int64()), "n_removed": pa.array([n - len(k) for k, n in out], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k, _ in out])})

    return map_batches(removals(docs, window), kernel, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def op7_sql(window: int = WINDOW) -> str:
    """The same removals in DuckDB, with every window spelled out."""
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + {window - 1}], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - {window - 2})) AS i FROM w WHERE len(words) >= {window})),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS place FROM win) WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM later, range({window}) r(k)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = w.doc_id"""
