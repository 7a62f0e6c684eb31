"""Phrase collocations: phrases of two or three words that stand together more often than their parts foretell.

Words are counted first, exactly and as strings. A phrase can only be frequent if its words are, and one of three words
only if both pairs in it are (Apriori), so the texts are read again for pairs of frequent words and then for triples
of frequent pairs; hashes of those that may be frequent are the candidates. For the exact counts they are dealt out by
hash in blocks, and a block numbers its candidates by a minimal perfect hash of its own (Limasset et al., "Fast and
scalable minimal perfect hashing for massive key sets"): mappers send what they have counted of a candidate with its
key, the words' hashes; a block finds the slot, verifies the stored key, and adds numpy arrays by slot, batch by batch. A
phrase that only shares a candidate's hash fails the verification and is counted aside, so counts are exact.
The counts of a cut's two parts lie in other blocks and are joined by key.

No step holds more than a block of candidates, a mapper's buffer or a filter of fixed size; as a corpus grows the
filters let more through, which costs shuffle and changes no result.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.llm.common import checkpoint, partitions, prepare, table
from pagelens.llm.hashing import C1, C2, C3, C4, U, join_hashes, scramble, signed

LEAST, KEEP, COVERED, TOP = 10, 1_000_000, 50, 2000
#: Bits of the filters of frequent words, pairs and candidates: 16 MiB each.
FILTER_BITS = 27
#: Words or phrases that a mapper counts before it sends the counts on; candidates of a block, about.
BUFFER_WORDS, BUFFER_PHRASES, BLOCK = 1 << 17, 1 << 21, 1 << 13
#: Up to so many frequent words they are sent to every executor; beyond, they are joined.
BROADCAST_WORDS = 1 << 18
#: Rows that are ranked at once.
RANKED = 1 << 16

# What ends a piece becomes a full stop, tabs become spaces, A to Z are lowered.
_TABLE = bytearray(range(256))
_TABLE[0x41:0x5B] = range(0x61, 0x7B)
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 0x2E
_TABLE[0x09] = 0x20
STOP = b"."


def tokens(text: str) -> list[bytes]:
    """The words of a text, with STOP wherever a piece ends."""
    return [*text.encode().translate(_TABLE).replace(STOP, b" . ").split(), STOP]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        if text:
            yield "und" if lang is None else lang, tokens(text)


def word_keys(words: list[bytes], lang: str, seed: int) -> np.ndarray:
    """64-bit keys of words of a language, never 0."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words, itertools.repeat(seed)), U, len(words))
    return np.maximum(join_hashes(hashes, U(xxhash.xxh3_64_intdigest(lang, seed))), U(1))


def phrase_hashes(keys: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of two or three keys."""
    pairs = join_hashes(keys[:-1], keys[1:], C2)
    return scramble(pairs) if size == 2 else scramble(join_hashes(pairs[:-1], keys[2:], C4), C3)


def hashes_of(keys: np.ndarray) -> np.ndarray:
    """The same hashes from columns (three, n) of keys, the third 0 for pairs."""
    pairs = join_hashes(keys[0], keys[1], C2)
    return np.where(keys[2] == 0, scramble(pairs), scramble(join_hashes(pairs, keys[2], C4), C3))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: each gets a slot of its own under their number.

    On each level a key that nothing else collides with takes the next slot; the others go on to the next level, under
    another hash. Other keys get any slot, or -1.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        self.n = 0
        while len(keys):
            at = self._place(keys, len(self.levels), 2 * len(keys))
            alone = np.bincount(at, minlength=2 * len(keys)) == 1
            self.levels.append(np.where(alone, self.n + np.cumsum(alone) - 1, -1))
            self.n += int(alone.sum())
            keys = keys[~alone[at]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (scramble(keys ^ U(int(C1) * (2 * level + 1) % (1 << 64))) % U(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, taken in enumerate(self.levels):
            out[left] = taken[self._place(keys[left], level, len(taken))]
            left = left[out[left] < 0]
        return out


def words(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(key, lang, word, f, shared) of the words with f >= LEAST; for each lang a row with an empty word, whose f is the number
    of all words. ``shared`` is the number of words with that key: over 1 where two words have one hash."""

    def rows(held: dict[str, Counter]) -> pa.RecordBatch:
        keys, langs, names, counts = [], [], [], []
        for lang, found in held.items():
            found.pop(STOP, None)
            found[b""] = found.total()
            keys.append(word_keys(list(found), lang, seed))
            langs += [lang] * len(found)
            names += [w.decode() for w in found]
            counts += found.values()
        return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(langs), pa.array(names), pa.array(counts, pa.int64())], ["key", "lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, found in _texts(batch):
                held.setdefault(lang, Counter()).update(found)
            if sum(map(len, held.values())) >= BUFFER_WORDS:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    made = docs.mapInArrow(run, "key long, lang string, word string, n long")
    # Dealt out by key, the rows of a word and those of a key are together; mappers have added them up already.
    counted = made.repartition(partitions(docs.sparkSession), "key").groupBy("key", "lang", "word").agg(F.sum("n").alias("f"))
    shared = counted.withColumn("shared", F.count("*").over(Window.partitionBy("key")).cast("int"))
    return shared.where((F.col("f") >= LEAST) | (F.col("word") == ""))


def filter_of(keys: DataFrame, name: str) -> np.ndarray:
    """A bit for each value that the last FILTER_BITS bits of the keys take."""
    bit = F.pmod(name, F.lit(1 << FILTER_BITS)) + 1
    parts = keys.select(F.bitmap_bucket_number(bit).alias("part"), F.bitmap_bit_position(bit).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in parts.collect():  # 4,096 parts of 4 KiB at most
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def passed(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = keys & U((1 << FILTER_BITS) - 1)
    return (bits[at >> U(3)] >> (at & U(7)).astype(np.uint8) & 1).astype(bool)


def _map_phrases(docs: DataFrame, found: Callable[[np.ndarray], list[np.ndarray]], rows: Callable[[list[np.ndarray], np.ndarray], pa.RecordBatch], schema: str, seed: int) -> DataFrame:
    """What ``found`` makes of the word keys of texts (0 where a piece ends), a buffer at a time: columns of which the first is
    sorted, equal rows once, and their numbers, handed to ``rows``."""

    def counted(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        columns = [c[order] for c in columns]
        starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))
        return rows([c[starts] for c in columns], np.diff(starts, append=len(order)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in _texts(batch):
                by_lang.setdefault(lang, []).extend(text)
            for lang, text in by_lang.items():
                keys = word_keys(text, lang, seed)
                keys[np.fromiter((w == STOP for w in text), bool, len(text))] = 0
                held.append(found(keys))
                size += len(held[-1][0])
            if size >= BUFFER_PHRASES:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    return docs.mapInArrow(run, schema)


def _candidates(docs: DataFrame, size: int, filters, seed: int) -> DataFrame:
    """(h): hashes that phrases of ``size`` words have LEAST times or more, all of whose shorter phrases may be frequent."""

    def found(keys: np.ndarray) -> list[np.ndarray]:
        known = (keys != 0) & passed(keys, filters.value[0])
        usable = known[:-1] & known[1:]
        if size == 3:
            usable &= passed(phrase_hashes(keys, 2), filters.value[1])
            usable = usable[:-1] & usable[1:]
        return [phrase_hashes(keys, size)[usable]]

    rows = lambda columns, n: pa.RecordBatch.from_arrays([pa.array(signed(columns[0])), pa.array(n, pa.int64())], ["h", "n"])
    return _map_phrases(docs, found, rows, "h long, n long", seed).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).select("h")


def _counted(docs: DataFrame, candidates: DataFrame, filters, seed: int) -> DataFrame:
    """(k1, k2, k3, a) of every phrase with a candidate's hash and a >= LEAST; k3 is 0 for pairs."""
    n = candidates.count()
    shift = 63 - max(0, (max(1, n) // BLOCK).bit_length())
    block = F.shiftrightunsigned("h", shift).cast("int")

    def found(keys: np.ndarray) -> list[np.ndarray]:
        out = [[] for _ in range(4)]
        for size in (2, 3):
            if len(keys) < size:
                continue
            runs = [keys[k : len(keys) - size + 1 + k] for k in range(size)]
            h = phrase_hashes(keys, size)
            held = np.flatnonzero(np.all([r != 0 for r in runs], axis=0) & passed(h, filters.value[size]))
            for column, values in zip(out, [h, *runs, np.zeros(len(h), U)], strict=False):
                column.append(values[held])
        return [np.concatenate(c) if c else np.zeros(0, U) for c in out]

    def packed(columns: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        """A row for each block: its phrases' keys and numbers, sorted, so that they compress."""
        blocks = (columns[0] >> U(shift)).astype(np.int32)
        order = np.lexsort((*columns[:0:-1], blocks))
        keys, n, starts = np.stack(columns[1:])[:, order], n[order].astype(np.uint32), np.flatnonzero(np.diff(blocks, prepend=-1))
        data = [keys[:, low:high].tobytes() + n[low:high].tobytes() for low, high in itertools.pairwise([*starts, len(blocks)])]
        return pa.RecordBatch.from_arrays([pa.array(blocks[starts]), pa.array(data, pa.binary())], ["block", "data"])

    entries = _map_phrases(docs, found, packed, "block int, data binary", seed)
    both = entries.withColumn("h", F.lit(None).cast("long")).unionByName(candidates.select(block.alias("block"), F.lit(None).cast("binary").alias("data"), "h"))
    dealt = both.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", F.col("h").isNull())  # a block's candidates come first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Block | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = batch.column("block").to_numpy()
            for low, high in itertools.pairwise([0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]):
                if now is None or now.number != blocks[low]:
                    if now is not None:
                        yield now.rows()
                    now = _Block(blocks[low])
                part = batch.slice(low, high - low)
                now.hold(part.column("h").drop_null().to_numpy().view(U))
                for data in part.column("data").drop_null().to_pylist():
                    size = len(data) // 28
                    now.add(np.frombuffer(data, U, 3 * size).reshape(3, size), np.frombuffer(data, np.uint32, size, 24 * size))
        if now is not None:
            yield now.rows()

    return dealt.mapInArrow(run, "k1 long, k2 long, k3 long, a long")


class _Block:
    """Counts of a block's candidates by slot; ``hold`` takes the candidates, which come first, and ``add`` what mappers counted."""

    def __init__(self, number: int):
        self.number, self.waiting, self.hash = number, [], None
        self.aside: Counter = Counter()

    def hold(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)

    def _close(self) -> None:
        hashes = np.unique(np.concatenate([*self.waiting, np.zeros(0, U)]))
        self.hash = PerfectHash(hashes)
        self.stored = np.zeros(len(hashes), U)
        self.stored[self.hash.slots(hashes)] = hashes
        self.keys, self.known, self.counts = np.zeros((3, len(hashes)), U), np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        if self.hash is None:
            self._close()
        if not len(self.stored):
            return
        h = hashes_of(keys)
        slot = self.hash.slots(h)
        mine = (slot >= 0) & (self.stored[slot] == h)
        slot, keys, n = slot[mine], keys[:, mine], n[mine]
        new, first = np.unique(slot, return_index=True)
        first, new = first[~self.known[new]], new[~self.known[new]]
        self.keys[:, new], self.known[new] = keys[:, first], True
        same = (self.keys[:, slot] == keys).all(axis=0)
        # Sums of one mapper's numbers are far below 2 ** 53, so they are exact.
        self.counts += np.bincount(slot[same], weights=n[same], minlength=len(self.counts)).astype(np.int64)
        for *key, more in zip(*signed(keys[:, ~same]).tolist(), n[~same].tolist(), strict=True):
            self.aside[tuple(key)] += more

    def rows(self) -> pa.RecordBatch:
        if self.hash is None:
            self._close()
        often = self.counts >= LEAST
        others = np.array([(*key, n) for key, n in self.aside.items() if n >= LEAST], np.int64).reshape(-1, 4).T
        columns = np.concatenate([np.concatenate([signed(self.keys), self.counts[None]])[:, often], others], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k1", "k2", "k3", "a"])


def phrases(docs: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, n, k1, k2, k3) of all phrases of two or three words with a >= LEAST that no longer one covers.

    Languages are kept apart (null: und); null and empty texts have no words; repeated rows count again; texts of any length
    are read whole. An empty table, or one without frequent phrases, gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("lang", "text")
    for seed in range(8):
        known = checkpoint(words(docs, seed))
        if known.where("shared > 1").isEmpty():
            break
    else:
        raise RuntimeError("words share hashes under every seed")
    frequent = known.where("word <> ''")
    sent = lambda bits: spark.sparkContext.broadcast(bits)
    one = filter_of(frequent, "key")
    pairs = checkpoint(_candidates(docs, 2, sent({0: one}), seed))
    two = filter_of(pairs, "h")
    triples = checkpoint(_candidates(docs, 3, sent({0: one, 1: two}), seed))
    counted = checkpoint(_counted(docs, pairs.union(triples).distinct(), sent({2: two, 3: filter_of(triples, "h")}), seed))

    word = F.broadcast(frequent) if frequent.count() <= BROADCAST_WORDS else frequent
    named = lambda k, name, f: word.select(F.col("key").alias(k), F.col("lang").alias(f"lang_{k}"), F.col("word").alias(name), F.col("f").alias(f))
    score = lambda l, r: F.expr(f"({KEEP}BD * a * a) div (cast({l} AS decimal(19,0)) * {r})")
    double = counted.where("k3 = 0").drop("k3").join(named("k1", "w1", "l"), "k1").join(named("k2", "w2", "r"), "k2")
    double = checkpoint(double.where("lang_k1 = lang_k2").select(F.col("lang_k1").alias("lang"), "k1", "k2", "w1", "w2", "a", "l", "r").withColumn("score", score("l", "r")))
    left = double.select("lang", "k1", "k2", "w1", "w2", F.col("l").alias("f1"), F.col("a").alias("f12"))
    right = double.select(F.col("k1").alias("k2"), F.col("k2").alias("k3"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("r").alias("f3"))
    triple = counted.where("k3 <> 0").join(left, ["k1", "k2"]).join(right, ["k2", "k3"])
    triple = triple.withColumns({"s1": score("f1", "f23"), "s2": score("f12", "f3")})
    early = F.col("s1") <= F.col("s2")
    triple = checkpoint(triple.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"), "k1", "k2", "k3"))
    inside = triple.select(F.explode(F.array(F.struct("k1", "k2"), F.struct(F.col("k2").alias("k1"), F.col("k3").alias("k2")))).alias("p"), "a").groupBy("p.k1", "p.k2").agg(F.max("a").alias("longer"))
    uncovered = double.join(inside, ["k1", "k2"], "left").where(f"longer IS NULL OR 100 * longer < {COVERED} * a")
    double = uncovered.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", "score", "k1", "k2", F.lit(0).cast("long").alias("k3"))
    total = known.where("word = ''").select("lang", F.col("f").alias("n"))
    return double.unionByName(triple).join(total, "lang")


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` by score, count and phrase.

    Ranks are taken in parts that become fewer, each passing on its first ``top`` rows, so that a language may have
    most phrases.
    """
    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    rows = found.withColumn("part", F.pmod(F.xxhash64("k1", "k2", "k3"), F.lit(max(1, found.count() // RANKED))))
    parts = max(1, found.count() // RANKED)
    while parts > 1:
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
        parts = parts // 16
        rows = rows.withColumn("part", F.pmod("part", F.lit(max(1, parts))))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(checkpoint(phrases(table(spark, sf_dir, "documents"))))


def op13_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    score = lambda l, r: f"({KEEP}::hugeint * a * a) // ({l}::hugeint * {r})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents),
p AS (SELECT doc, lang, unnest(pieces) AS piece, unnest(range(len(pieces))) AS nr FROM d),
w AS (SELECT doc, lang, nr, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT *, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p)),
run AS MATERIALIZED (SELECT lang, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc, nr ORDER BY pos)),
one AS MATERIALIZED (SELECT lang, w1, count(*) AS f FROM run GROUP BY ALL),
total AS (SELECT lang, cast(sum(f) AS bigint) AS n FROM one GROUP BY lang),
two AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS a FROM run WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
three AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS a FROM run WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
inside AS (SELECT lang, w1, w2, max(a) AS longer FROM (SELECT lang, w1, w2, a FROM three UNION ALL SELECT lang, w2, w3, a FROM three) GROUP BY ALL),
double AS (SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, a, x.f AS l, y.f AS r, {score("x.f", "y.f")} AS score FROM two t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w2
 LEFT JOIN inside i ON i.lang = t.lang AND i.w1 = t.w1 AND i.w2 = t.w2 WHERE longer IS NULL OR 100 * longer < {COVERED} * a),
triple AS (SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.a, x.f AS f1, q.a AS f23, p.a AS f12, y.f AS f3 FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w3
 JOIN two p ON p.lang = t.lang AND p.w1 = t.w1 AND p.w2 = t.w2 JOIN two q ON q.lang = t.lang AND q.w1 = t.w2 AND q.w2 = t.w3),
scored AS (SELECT *, {score("f1", "f23")} AS s1, {score("f12", "f3")} AS s2 FROM triple),
found AS (SELECT * FROM double UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN f1 ELSE f12 END, CASE WHEN s1 <= s2 THEN f23 ELSE f3 END, least(s1, s2) FROM scored)
SELECT lang, rank, phrase, a, l, r, n, cast(score AS bigint) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM found) JOIN total USING (lang) WHERE rank <= {TOP}"""
