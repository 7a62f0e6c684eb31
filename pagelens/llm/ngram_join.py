"""Set-similarity join of word-shingle sets by PartEnum signatures, and the groups that its links make.

Sets are banded by size so that partners stand in the same or in neighbouring bands, and a Jaccard threshold is
a bound k on the symmetric difference. For each instance (a band and the one under it) the shingle domain is cut
into parts by hash range, and each part into pieces. By the pigeonhole principle partners differ by at most one
shingle in some part, so they agree there on all pieces but one: a set's signatures are hashes of its content in all
subsets of the right number of pieces of each part, and partners share a signature. With k // 2 + m parts they share one
in m parts at least, so up to m - 1 parts of which some subset holds very few shingles, which say little, can be left
out and no link is lost. (Where k is large against the sets, parts are one piece each and k + m in number, and for k up
to 3 the numbers are set by hand.)

Taking any fixed set of shingles out of all sets can only bring partners nearer, so signatures are made without
shingles that are common in a sample of the corpus: else a passage that many documents share would be the whole
content of some part in many of them. A set with m or more small parts is signed again with other parts, then in
full, up to STAGES times: partners share a signature of the first stage in which one of them has few small parts.

Sets that share signatures are chained to the least document of the signature, chains make candidate clusters,
and clusters are verified exactly in blocks of bounded size. A cluster of several blocks in which few pairs share a
signature, as a chain of chance meetings makes it, is taken apart and verified by signatures instead, so that no more
pairs are compared than PartEnum names. Copies (equal sets) are one node throughout.

Where links need not be counted, as for leaving out near copies, sets of large clusters are first held against the one
that they were chained to. Families are one group after that, so only signatures are left whose sets stand in
several groups, and no set of a family goes on for each signature or for each block of it.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.llm.common import WORD, checkpoint, connected_components, grouped, map_batches, partitions, prepare, sampled_ids, set_aside, table, texts
from pagelens.llm.hashing import C1, C4, U, join_hashes, scramble, signed, windows, word_hashes

#: Clusters of more shingles than SMALL, a set counting as NODE at least, are verified in blocks of about that size, and
#: of up to BLOCK in clusters of more than MANY such blocks.
SMALL, BLOCK, NODE, MANY = 1 << 18, 1 << 20, 1 << 11, 24
#: Candidate sets are sent to every executor only up to this many rows; beyond, the texts are shuffled.
BROADCAST_ROWS = 1 << 20
#: Documents of the sample (by a hash of doc_id) in which shingles are counted, in how many a shingle is common, and
#: how many common ones are kept at most. Whatever they come to, the links are the same; only the work differs.
SAMPLE_DOCS, COMMON_IN, COMMON_MOST = 8_192, 3, 1 << 19
COLUMNS = 1024
#: From so many shingles for each that may differ, parts are cut into pieces too. That takes 1.5 to 1.8 times as many
#: signatures, of 1.3 times the length; at a threshold of 0.8 they would hold three shingles and not repay their cost.
DENSE = 6
#: One in so many signatures is counted to tell chains from families.
EVERY = 16
#: Signatures that a task remembers as repeated, so that each of them goes on once a task; beyond, once a batch.
REPEATED = 1 << 16
#: How often a set is signed at most, and how often of that without common shingles.
STAGES, RARE_STAGES = 6, 2


@dataclass(frozen=True)
class Rule:
    """Sets of ``words``-word shingles link when den * intersection >= num * union."""

    words: int = 5
    num: int = 80
    den: int = 100

    def links(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * both >= self.num * (a + b - both)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text; a shorter text is one shingle, an empty one none."""
    tokens = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not tokens:
        return np.zeros(0, U)
    h = word_hashes(tokens)
    if len(h) < words:
        return scramble(windows(h, len(h)) + U(len(h)))
    return np.unique(windows(h, words))


def identity(s: np.ndarray) -> tuple[int, int]:
    return int(signed(scramble(s, C1).sum(keepdims=True, dtype=U))[0]), int(signed(scramble(s, C4).sum(keepdims=True, dtype=U))[0])


@dataclass(frozen=True)
class Instance:
    """How sets of band ``number`` and the one under it are cut: parts, pieces in each, pieces that may differ;
    subsets of under ``least`` shingles are left out by sets that have fewer than ``spare`` parts with such."""

    number: int
    parts: int
    pieces: int
    differ: int
    spare: int
    least: int


@functools.cache
def bands(num: int, den: int) -> list[int]:
    """The first size of each band, up to sizes of about 2**31; a band ends where its first size's partners do."""
    firsts = [1]
    while firsts[-1] < 1 << 31:
        firsts.append(firsts[-1] * den // num + 1)
    return firsts


@functools.cache
def instance(number: int, num: int, den: int) -> Instance:
    firsts = bands(num, den)
    low, last = firsts[max(0, number - 1)], firsts[number + 1] - 1
    k = 2 * last * (den - num) // (den + num)
    if k == 0:
        return Instance(number, 0, 0, 0, 1, 0)  # only equal sets link, and those are one node
    if k <= 2:
        return Instance(number, 1, 6 if k == 1 else 8, k, 1, 0)
    return Instance(number, 2, 4, 1, 1, 0) if k == 3 else _wide(number, k, low)


def _wide(number: int, k: int, low: int) -> Instance:
    """Enough spare parts that few sets have as many small ones. Parts have three pieces, one of which may differ, where
    that leaves signatures of some length; else, as for low thresholds, one piece that must not differ."""
    pieces, differ = (3, 1) if low >= DENSE * k else (1, 0)
    least_parts, kept = k // (differ + 1), (pieces - differ) / pieces
    for least in (3, 2, 1):
        for m in range(1, max(2, k // 3) + 1):
            mean = low / (least_parts + m) * kept
            small = (least_parts + m) * min(1, pieces * sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(least)))
            if small + 1.5 * math.sqrt(small) + 1 <= m:
                return Instance(number, least_parts + m, pieces, differ, m, least)
    return Instance(number, least_parts + 1 + k // 4, pieces, differ, 1 + k // 4, 1)


@functools.cache
def choices(pieces: int, keep: int) -> np.ndarray:
    return np.array([[U(p in c) for p in range(pieces)] for c in itertools.combinations(range(pieces), keep)], U)


def without(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common):
        return s
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    return s[common[at] != s]


def _cells(s: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the content, size) of each cell; cells are hash ranges, so the sorted set is already in their order."""
    mixed = np.concatenate([np.zeros(1, U), np.cumsum(scramble(s, C4), dtype=U)])
    cut = np.searchsorted(((s >> U(32)) * U(cells)) >> U(32), np.arange(cells + 1))
    return mixed[cut[1:]] - mixed[cut[:-1]], np.diff(cut)


def dealt(s: np.ndarray, stage: int) -> np.ndarray:
    """The set under another order for each stage, so that it falls into other parts."""
    return s if stage == 0 else np.sort(scramble(s + U(stage * int(C1) % 2**64)))


def signatures(s: np.ndarray, rule: Rule, common: np.ndarray) -> np.ndarray:
    """All PartEnum signatures of a sorted set of hashes."""
    band = bisect.bisect(bands(rule.num, rule.den), len(s)) - 1
    rare = without(s, common)
    out = []
    for inst in (instance(n, rule.num, rule.den) for n in (band, band + 1)):
        cells = inst.parts * inst.pieces
        if not cells:
            continue
        name = lambda kind, n, inst=inst: scramble(np.arange(n, dtype=U) + U((inst.number << 36) + (kind << 32)))
        subsets = choices(inst.pieces, inst.pieces - inst.differ)
        for stage in range(STAGES) if inst.least else (STAGES,):
            sums, sizes = _cells(s if stage == STAGES else dealt(rare if stage < RARE_STAGES else s, stage), cells)
            sig = sums.reshape(inst.parts, inst.pieces) @ subsets.T
            small = sizes.reshape(inst.parts, inst.pieces) @ subsets.T.astype(np.int64) < inst.least
            sig = join_hashes(name(stage, sig.size), sig.ravel())
            few = small.any(axis=1).sum() < inst.spare
            out.append(sig if stage == STAGES - 1 and not few else sig[~small.ravel()])
            if few:
                break
    return scramble(np.concatenate(out)) if out else np.zeros(0, U)


def common_shingles(docs: DataFrame, rule: Rule) -> np.ndarray:
    """Sorted hashes of the shingles that COMMON_IN or more of the sampled documents have."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate([np.zeros(0, U), *(shingles(t, rule.words) for t in texts(batch))]), return_counts=True)
        return pa.RecordBatch.from_pydict({"h": signed(h), "n": n})

    sample = sampled_ids(docs, SAMPLE_DOCS)
    rows = map_batches(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), kernel, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = rows.where(F.col("n") >= COMMON_IN).orderBy(F.desc("n"), "h").limit(COMMON_MOST).select("h").toArrow().column("h").to_numpy()
    return np.sort(found.astype(np.int64).view(U))


def classes(docs: DataFrame, rule: Rule) -> DataFrame:
    """(docs, n_shingles, rep): doc_ids of one batch with equal sets, and the least doc_id with that set anywhere (null
    for empty sets). A set that very many documents share is a row for each batch here, not for each document."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[tuple, list] = {}
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            s = shingles(text, rule.words)
            found.setdefault((*identity(s), len(s)) if len(s) else (None, None, 0), []).append(doc)
        return pa.RecordBatch.from_pydict({"docs": pa.array(list(found.values()), pa.list_(pa.int64())), "s1": pa.array([k[0] for k in found], pa.int64()), "s2": pa.array([k[1] for k in found], pa.int64()), "n_shingles": pa.array([k[2] for k in found], pa.int64())})

    rows = checkpoint(map_batches(docs.select("doc_id", "text"), kernel, "docs array<long>, s1 long, s2 long, n_shingles long"))
    least = rows.where("s1 IS NOT NULL").groupBy("s1", "s2").agg(F.min(F.array_min("docs")).alias("rep"), F.count("*").alias("batches")).where("batches > 1").drop("batches")
    return rows.join(least, ["s1", "s2"], "left").select("docs", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("rep", F.array_min("docs"))).alias("rep"))


def candidate_pairs(docs: DataFrame, rule: Rule, common) -> DataFrame:
    """(a, b): documents that share a signature, each with the least one that has it, or one that leads to that.

    Documents that share a signature inside a batch are paired there and one of them goes on; the next batches of the
    task pair with that one, so a signature that a third of all documents have reaches its reducer once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, leader = np.zeros(0, U), np.zeros(0, np.int64)
        for batch in batches:
            seen, sigs, owners = set(), [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                s = shingles(text, rule.words)
                if doc is None or not len(s) or (name := identity(s)) in seen:
                    continue
                seen.add(name)  # copies are found by their classes
                sigs.append(signatures(s, rule, common.value))
                owners.append(np.full(len(sigs[-1]), doc, np.int64))
            sig, owner = np.concatenate(sigs), np.concatenate(owners)
            if not len(sig):
                continue
            order = np.lexsort((owner, sig))
            sig, owner = sig[order], owner[order]
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            first = owner[np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))]
            left, right = [owner[~new]], [first[~new]]
            heads, head, several = sig[new], owner[new], np.diff(np.append(np.flatnonzero(new), len(sig))) > 1
            old = np.zeros(len(heads), bool)
            if len(known):
                at = np.minimum(np.searchsorted(known, heads), len(known) - 1)
                old = known[at] == heads
                left.append(head[old])
                right.append(leader[at[old]])
            add = np.flatnonzero(several & ~old)[: REPEATED - len(known)]
            known, leader = np.append(known, heads[add]), np.append(leader, head[add])
            order = np.argsort(known)
            known, leader = known[order], leader[order]
            pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
            alone = scramble(join_hashes(pairs[0].view(U), pairs[1].view(U)))
            heads, head = heads[~old], head[~old]
            peer = np.concatenate([np.zeros(len(heads), np.int64), pairs[1]])
            yield pa.RecordBatch.from_pydict({"sig": signed(np.concatenate([heads, alone])), "doc": np.concatenate([head, pairs[0]]), "peer": pa.array(peer, mask=np.arange(len(peer)) < len(heads))})

    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text").mapInArrow(run, "sig long, doc long, peer long")
    same = Window.partitionBy("sig").orderBy("doc")
    return rows.withColumn("b", F.coalesce("peer", F.first("doc").over(same))).where("doc <> b").select(F.col("doc").alias("a"), "b").distinct()


def taken_apart(docs: DataFrame, members: DataFrame, rule: Rule, common) -> DataFrame:
    """The units of verification, (cluster, sig, node, cost, pairs), of cluster members (cluster, node, cost).

    A cluster is one unit (sig 0) unless it is over SMALL and the groups of its members that share a signature have
    less than a quarter of its pairs; then each of those groups is one, equal groups once, and ``pairs`` is true. The
    groups' pairs are counted over one in EVERY signatures of all members; whichever way it goes, the links are the same.
    """
    whole = members.select("cluster", F.lit(0).cast("long").alias("sig"), "node", "cost", F.lit(False).alias("pairs"))
    large = checkpoint(members.groupBy("cluster").agg(F.sum("cost").alias("cost"), F.count("*").alias("n_members")).where(F.col("cost") > SMALL))
    if large.isEmpty():
        return whole
    inside = checkpoint(members.join(_small(large.select("cluster")), "cluster"))

    def signed_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, node, signature), a row for each signature of each document."""
        sigs = [np.unique(signatures(s, rule, common.value)) if len(s := shingles(t, rule.words)) else np.zeros(0, U) for t in texts(batch)]
        each = [len(x) for x in sigs]
        return np.repeat(batch.column("cluster").to_numpy(), each), np.repeat(batch.column("doc_id").to_numpy(), each), signed(np.concatenate([np.zeros(0, U), *sigs]))

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        """One in EVERY signatures, by their value, with the number of the batch's documents that have them."""
        cluster, _, sig = signed_rows(batch)
        kept = sig.view(U) % U(EVERY) == 0
        pairs, n = np.unique(np.stack([cluster[kept], sig[kept]]), axis=1, return_counts=True)
        return pa.RecordBatch.from_pydict({"cluster": pairs[0], "sig": pairs[1], "n": n})

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
        cluster, node, sig = signed_rows(batch)
        return pa.RecordBatch.from_pydict({"cluster": cluster, "node": node, "sig": sig})

    own = lambda part: docs.join(_small(part.select(F.col("node").alias("doc_id"), "cluster")), "doc_id").select("doc_id", "cluster", "text")
    counts = map_batches(own(inside), counted, "cluster long, sig long, n long").groupBy("cluster", "sig").agg(F.sum("n").cast("double").alias("n"))
    named = counts.groupBy("cluster").agg(F.sum(F.when(F.col("n") > 1, EVERY * F.col("n") * F.col("n")).otherwise(0.0)).alias("named"))
    chains = checkpoint(large.join(named, "cluster", "left").where(4 * F.coalesce("named", F.lit(0.0)) < F.col("n_members") * F.col("n_members").cast("double")).select("cluster"))
    if chains.isEmpty():
        return whole
    chains = _small(chains)
    apart = checkpoint(map_batches(own(inside.join(chains, "cluster")), listed, "cluster long, node long, sig long").distinct())
    # Sums of two halves of a hash tell which signatures have the same documents.
    name = F.xxhash64("node")
    groups = apart.groupBy("cluster", "sig").agg(F.count("*").alias("n"), F.sum(F.shiftrightunsigned(name, 33)).alias("high"), F.sum(name.bitwiseAND(0x7FFFFFFF)).alias("low")).where("n > 1")
    groups = groups.groupBy("cluster", "n", "high", "low").agg(F.min("sig").alias("sig")).select("cluster", "sig")
    apart = apart.join(groups, ["cluster", "sig"]).join(members.select("cluster", "node", "cost"), ["cluster", "node"])
    return whole.join(chains, "cluster", "left_anti").unionByName(apart.select("cluster", "sig", "node", "cost", F.lit(True).alias("pairs")))


def _size(cost):
    """Size of the blocks of a unit of that cost, which are three quarters full on average."""
    return F.least(F.lit(float(BLOCK)), F.greatest(F.lit(float(SMALL)), cost / MANY))


def unsettled(docs: DataFrame, members: DataFrame, pairs: DataFrame, rule: Rule, common) -> tuple[DataFrame, DataFrame | None]:
    """What is left to verify to know the groups, (cluster, sig, node, cost, pairs, block, blocks), of cluster members (cluster,
    node, cost, n, least), and (node, peer) of groups found on the way (None: no cluster is over SMALL).

    The candidate ``pairs`` of clusters over SMALL are verified first; a member stands for each of its pairs. Linked sets of
    different groups share a signature, and two that are alone with it were a pair. So the signatures left to verify are
    those of three sets or more, of several groups, a unit for all that have the same groups; a cluster is verified whole
    where that moves fewer shingles.
    """
    whole = members.select("cluster", F.lit(0).cast("long").alias("sig"), "node", "cost", F.lit(False).alias("pairs"), F.lit(0).alias("block"), F.lit(1).alias("blocks"))
    large = checkpoint(members.groupBy("cluster").agg(F.sum("cost").alias("cost")).where(F.col("cost") > SMALL).select("cluster"))
    if large.isEmpty():
        return whole, None
    large = _small(large)
    inside = checkpoint(members.join(large, "cluster"))
    side = lambda end: inside.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("cost", "n", "least")])
    near = rule.den * F.least("n_a", "n_b") >= rule.num * F.greatest("least_a", "least_b")
    stars = checkpoint(pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b", F.col("cost_a").alias("cost")))
    chunks = stars.groupBy("b").agg(F.ceil(F.sum("cost") / (SMALL * 0.75)).cast("int").alias("chunks"))
    chunks = checkpoint(stars.join(chunks, "b").select(F.col("b").alias("cluster"), F.pmod(F.xxhash64("a"), "chunks").cast("long").alias("sig"), F.col("a").alias("node"), "cost"))
    one = lambda df, block: df.select("cluster", "sig", F.lit(False).alias("pairs"), F.lit(0).alias("i"), F.lit(1).alias("j"), F.lit(block).alias("block"), "node")
    wanted = one(chunks, 1).unionByName(one(chunks.withColumn("node", F.col("cluster")), 0).distinct())
    n = max(partitions(docs.sparkSession), int((chunks.agg(F.sum("cost")).first()[0] or 0) // (4 * BLOCK)))
    found = checkpoint(verified(with_shingles(docs, checkpoint(wanted), rule).repartition(n, "cluster", "sig").sortWithinPartitions("cluster", "sig", "i", "j"), rule).select("node", "peer"))

    groups = connected_components(found.select(F.col("node").alias("a"), F.col("peer").alias("b"))).withColumnRenamed("component", "part")
    inside = checkpoint(inside.join(groups, "node", "left").withColumn("part", F.coalesce("part", "node")))
    several = checkpoint(inside.groupBy("cluster").agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first <> last").select("cluster"))
    mine = checkpoint(inside.join(_small(several), "cluster"))

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
        sigs = [np.unique(signatures(s, rule, common.value)) if len(s := shingles(t, rule.words)) else np.zeros(0, U) for t in texts(batch)]
        each = [len(x) for x in sigs]
        node, part = (np.repeat(batch.column(c).to_numpy(), each) for c in ("doc_id", "part"))
        return pa.RecordBatch.from_pydict({"sig": signed(np.concatenate([np.zeros(0, U), *sigs])), "node": node, "part": part})

    own = docs.join(_small(mine.select(F.col("node").alias("doc_id"), "part")), "doc_id").select("doc_id", "part", "text")
    same, name = Window.partitionBy("sig"), F.xxhash64("part")
    before = F.lag("part").over(same.orderBy("part"))
    apart = map_batches(own, listed, "sig long, node long, part long").withColumn("new", before.isNull() | (before != F.col("part")))
    # Signatures whose sets stand in the same groups are one unit; sums of two halves of a hash name it.
    apart = apart.select(
        "node", F.count("*").over(same).alias("sets"), F.count_if("new").over(same).alias("parts"),
        F.sum(F.when(F.col("new"), F.shiftrightunsigned(name, 33))).over(same).alias("high"), F.sum(F.when(F.col("new"), name.bitwiseAND(0x7FFFFFFF))).over(same).alias("low"),
    ).where("parts > 1 AND sets > 2")
    apart = checkpoint(apart.select("node", F.xxhash64("parts", "high", "low").alias("sig")).distinct())
    apart = _against_largest(apart.join(mine.select("cluster", "node", "cost", "n", "part"), "node"))
    together = _against_largest(mine.withColumn("sig", F.lit(0).cast("long")))
    moved = lambda rows, name: rows.groupBy("cluster").agg(F.sum(F.col("n") * F.col("blocks")).alias(name))
    dear = _small(checkpoint(moved(apart, "apart").join(moved(together, "together"), "cluster").where("apart > together").select("cluster")))
    apart, together = (rows.drop("n") for rows in (apart.join(dear, "cluster", "left_anti"), together.join(dear, "cluster", "left_semi")))
    return whole.join(large, "cluster", "left_anti").unionByName(apart).unionByName(together), found


def _against_largest(units: DataFrame) -> DataFrame:
    """Units (cluster, sig, node, cost, n, part) dealt to blocks: members outside of the largest part (a group that is known) to
    the first ones, which meet all blocks, and those of that part, which need not meet each other, to the others.
    ``blocks``: how many a member's block meets, from the first on."""
    cost = units.groupBy("cluster", "sig", "part").agg(F.sum("cost").alias("own")).groupBy("cluster", "sig").agg(F.sum("own").alias("total"), F.max(F.struct("own", "part")).alias("most"))
    size, small = _size(F.col("total")) * 0.75, F.col("total") <= SMALL
    first = F.when(small, 1).otherwise(F.greatest(F.lit(1), F.ceil((F.col("total") - F.col("most.own")) / size).cast("int")))
    rest = F.when(small, 0).otherwise(F.ceil(F.col("most.own") / size).cast("int"))
    rows = units.join(cost.select("cluster", "sig", first.alias("first"), rest.alias("rest"), F.col("most.part").alias("largest")), ["cluster", "sig"])
    later, place = (F.col("part") == F.col("largest")) & (F.col("rest") > 0), F.xxhash64("node")
    block = F.when(later, F.col("first") + F.pmod(place, F.greatest(F.lit(1), "rest"))).otherwise(F.pmod(place, "first")).cast("int")
    return checkpoint(rows.select("cluster", "sig", "node", "cost", "n", F.lit(False).alias("pairs"), block.alias("block"), F.when(later, F.col("first")).otherwise(F.col("first") + F.col("rest")).alias("blocks")))


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right], by products of 0/1 matrices in column blocks."""
    if len(left) * len(right) == 1:
        return np.array([[len(np.intersect1d(sets[left[0]], sets[right[0]], assume_unique=True))]])
    flat = np.concatenate(sets)
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = count > 1
    number = np.cumsum(shared) - 1
    use = shared[col]
    row, col = row[use], number[col[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = int(shared.sum())
    out = np.zeros((len(left), len(right)))
    for low in range(0, total, COLUMNS):
        a, b = np.searchsorted(col, [low, low + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, total - low)), np.float32)
        m[row[a:b], col[a:b] - low] = 1
        out += m[left] @ m[right].T
    return out.astype(np.int64)


def verified(rows: DataFrame, rule: Rule) -> DataFrame:
    """(node, peer, links) from rows (cluster, sig, i, j, pairs, block, node, shingles): the least node that ``node``
    reaches by links inside the task (cluster, sig, i, j), and how many it links with there; where ``pairs``, a row for
    each linked pair, with null links, since other signatures of the cluster may name it too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["cluster", "sig", "i", "j"]):
            node = group.column("node").to_numpy()
            order = np.argsort(node, kind="stable")
            node, block = node[order], group.column("block").to_numpy()[order]
            blobs = group.column("shingles").combine_chunks()
            raw = [blobs[int(k)].as_py() for k in order]
            # Repeated rows of a document are one member.
            order = np.array([k for k in range(len(raw)) if k == 0 or node[k] != node[k - 1] or raw[k] not in raw[np.searchsorted(node, node[k]) : k]])
            node, block, sets = node[order], block[order], [np.frombuffer(raw[k], U) for k in order]
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            size = np.array([len(s) for s in sets], np.int64)
            linked = rule.links(intersections(sets, left, right), size[left][:, None], size[right][None, :])
            if i == j:
                np.fill_diagonal(linked, False)
            if group.column("pairs")[0].as_py():
                a, b = np.nonzero(linked)
                a, b = node[left[a]], node[right[b]]
                found = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
                yield pa.RecordBatch.from_pydict({"node": found[0], "peer": found[1], "links": pa.nulls(found.shape[1], pa.int64())})
                continue
            links = np.zeros(len(node), np.int64)
            links[left] += linked.sum(axis=1)
            if i != j:
                links[right] += linked.sum(axis=0)
            label = np.arange(len(node))
            while True:
                new = label.copy()
                np.minimum.at(new, left, np.where(linked, label[right][None, :], len(node)).min(axis=1, initial=len(node)))
                np.minimum.at(new, right, np.where(linked, label[left][:, None], len(node)).min(axis=0, initial=len(node)))
                new = new[new]
                if (new == label).all():
                    break
                label = new
            yield pa.RecordBatch.from_pydict({"node": node, "peer": node[label], "links": links})

    return rows.mapInArrow(run, "node long, peer long, links long")


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def with_shingles(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """The rows ``wanted`` (node, ...), each with the ``shingles`` of its document's text, made once for all of its rows."""
    units = wanted.groupBy(F.col("node").alias("doc_id")).agg(F.collect_list(F.struct(*[c for c in wanted.columns if c != "node"])).alias("units"))
    near = docs.join(F.broadcast(units) if wanted.count() <= BROADCAST_ROWS else units, "doc_id").select("doc_id", "units", "text")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, rule.words).tobytes() for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("units"), pa.array(sets, pa.binary())], ["node", "units", "shingles"])

    rows = map_batches(near, kernel, f"node long, units {units.schema['units'].dataType.simpleString()}, shingles binary")
    return rows.select("node", "shingles", F.inline("units"))


def joined(docs: DataFrame, rule: Rule, counted: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), a row for every row of ``docs``; without n_links unless ``counted``.

    component_id: the smallest doc_id reachable by links, its own included. n_links: how many other shingle sets its
    set links with; copies count once. A null or empty text, or one without words, has no shingles and links with
    nothing; a text of any length gives all of its shingles. A null doc_id links with nothing and has a null component.
    Rows of one doc_id are one node, which has the links of each; repeated rows are repeated. An empty table gives no
    rows. Columns other than doc_id and text are not looked at.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    known = checkpoint(classes(docs, rule))
    to_rep = known.where("rep IS NOT NULL").select(F.explode("docs").alias("doc_id"), "rep").where("doc_id IS NOT NULL").distinct()
    # Rows of one doc_id that differ in text make their sets' representatives one node.
    first = to_rep.groupBy("doc_id").agg(F.min("rep").alias("b"), F.count("*").alias("sets")).where("sets > 1").drop("sets")
    twice = checkpoint(to_rep.join(first, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, rule))  # at most 8 * COMMON_MOST bytes
    pairs = candidate_pairs(docs, rule, common)
    for end in ("a", "b"):
        pairs = pairs.join(to_rep.withColumnRenamed("doc_id", end), end).drop(end).withColumnRenamed("rep", f"rep_{end}")
    pairs = pairs.where("rep_a <> rep_b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()
    pairs = pairs if counted else checkpoint(pairs)
    clusters = connected_components(pairs)

    sizes = known.where("rep IS NOT NULL").groupBy("rep").agg(F.max("n_shingles").alias("n"), F.min("n_shingles").alias("least"))
    members = clusters.join(sizes.withColumnRenamed("rep", "node"), "node").select(F.col("component").alias("cluster"), "node", F.greatest("n", F.lit(NODE)).alias("cost"), "n", "least")
    unit = ["cluster", "sig"]
    if counted:
        members, early = taken_apart(docs, checkpoint(members.drop("n", "least")), rule, common), None
        # Members of a unit over a block's size are dealt to blocks by hash.
        large = checkpoint(members.groupBy(*unit).agg(F.sum("cost").alias("cost")).where(F.col("cost") > SMALL).select(*unit, F.ceil(F.col("cost") / (_size(F.col("cost")) * 0.75)).cast("int").alias("blocks")))
        split = not large.isEmpty() or not members.where("pairs").isEmpty()
        blocks = members.join(_small(large), unit, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        blocks = checkpoint(blocks.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")))
    else:
        blocks, early = unsettled(docs, checkpoint(members), pairs, rule, common)
        blocks, split = checkpoint(blocks), early is not None
    rows = with_shingles(docs, blocks.select("node", *unit, "pairs", "block", "blocks"), rule)
    # Each pair of blocks of a unit is one task: a member goes to the tasks that its block is part of. A unit's tasks are
    # dealt round the partitions one by one, so that those of a large unit are spread evenly.
    tasks = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*unit, "pairs", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "shingles")
    n = max(partitions(docs.sparkSession), int((blocks.agg(F.sum(F.col("cost") * F.col("blocks"))).first()[0] or 0) // (4 * BLOCK)))
    place = F.pmod(F.xxhash64(*unit) % n + (F.col("j").cast("long") * (F.col("j") + 1) / 2).cast("long") + F.col("i"), F.lit(n)).cast("int")
    found = checkpoint(verified(tasks.repartitionById(n, place).sortWithinPartitions(*unit, "i", "j"), rule))
    # Where every cluster is one block, its task has already found the groups.
    if split or not twice.isEmpty():
        links = found.select("node", "peer") if early is None else found.select("node", "peer").unionByName(early)
        groups = connected_components(links.select(F.col("node").alias("a"), F.col("peer").alias("b")).unionByName(twice))
    else:
        groups = found.groupBy("node").agg(F.min("peer").alias("component"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id")
    if not counted:
        return known.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(F.explode("docs").alias("doc_id"), "n_shingles", "rep", "component").select("doc_id", "n_shingles", own)
    named = found.where("links IS NULL").select("node", "peer").distinct()
    named = named.unionByName(named.select(F.col("peer").alias("node"), F.col("node").alias("peer"))).groupBy("node").agg(F.count("*").alias("links"))
    degree = found.where("links IS NOT NULL").select("node", "links").unionByName(named).groupBy("node").agg(F.sum("links").alias("n_links"))
    by_rep = groups.join(degree, "node", "left").withColumnRenamed("node", "rep")
    out = known.join(by_rep, "rep", "left").select(F.explode("docs").alias("doc_id"), "n_shingles", "rep", "component", "n_links")
    return out.select("doc_id", "n_shingles", own, F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def deduplicated(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` with one document of each group, the one with the smallest doc_id; of repeated rows one.

    Rows with a null doc_id and texts without words are all kept. Rows of one doc_id with different texts are documents
    of their own, so that one goes only for a linked or equal set. Of rows of one doc_id and text, and of the texts of
    one doc_id in a group, the one with the smallest hash stays. An empty table gives no rows; all columns are kept,
    whatever their names.
    """
    docs, names = set_aside(docs, "_dedup_")
    node, order = "_dedup_node", "_dedup_order"
    wordy = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    several = docs.where(wordy).select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    several = checkpoint(several.where("low <> high").select("doc_id", F.lit(True).alias(order)))
    split = not several.isEmpty()
    # A node is a doc_id, or a hash of doc_id and text where an id stands with several texts; null stays whatever comes.
    rows = docs.join(_small(several), "doc_id", "left") if split else docs.withColumn(order, F.lit(None).cast("boolean"))
    rows = rows.withColumn(node, F.when(wordy, F.when(F.col(order), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")))).drop(order)
    groups = checkpoint(joined(rows.select(F.col(node).alias("doc_id"), "text"), rule, counted=False))
    nodes = groups.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(node)).agg(F.min("component_id").alias("component"), F.count("*").alias("rows"))
    gone = nodes.where(F.col(node) != F.col("component")).select(node)
    if split:
        named = nodes.join(rows.where(F.col(node).isNotNull()).select(node, "doc_id").distinct(), node)
        kept = named.groupBy("component").agg(F.min(F.struct("doc_id", node))[node].alias("kept"))
        gone = checkpoint(nodes.join(kept, "component").where(F.col(node) != F.col("kept")).select(node))
    out = rows.join(_small(gone), node, "left_anti")
    repeated = nodes.where("rows > 1").select(node)
    if not repeated.isEmpty():
        same = out.join(repeated, node, "left_semi").withColumn(order, F.xxhash64(F.to_json(F.struct(*docs.columns))))
        least = same.groupBy(node).agg(F.min(order).alias(order))
        out = out.join(repeated, node, "left_anti").unionByName(same.join(least, [node, order]).dropDuplicates([node]).drop(order))
    return out.select(*docs.columns).withColumnsRenamed(names)


CONTRACT = Rule(words=3, num=90)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"), CONTRACT)


def op4_sql(rule: Rule = CONTRACT) -> str:
    """The same links and groups in DuckDB, by counting the shingles that each pair of sets has in common."""
    n = rule.words
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS words FROM documents),
g AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {n} THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - {n - 2}), lambda i: array_to_string(words[i:i + {n - 1}], ' '))) END AS items FROM w),
k AS (SELECT doc_id, len(items) AS size, md5(array_to_string(list_sort(items), chr(10))) AS name, items FROM g),
rep AS (SELECT name, min(doc_id) AS rep, any_value(size) AS size, any_value(items) AS items FROM k WHERE size > 0 GROUP BY name),
item AS (SELECT rep, size, unnest(items) AS item FROM rep),
link AS (SELECT a.rep AS a, b.rep AS b FROM item a JOIN item b ON a.item = b.item AND a.rep <> b.rep AND {rule.den} * least(a.size, b.size) >= {rule.num} * greatest(a.size, b.size) GROUP BY a.rep, b.rep, a.size, b.size HAVING {rule.den} * count(*) >= {rule.num} * (a.size + b.size - count(*))),
reach AS (SELECT rep AS a, rep AS b FROM rep UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
part AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a), degree AS (SELECT a AS rep, count(*) AS n FROM link GROUP BY a)
SELECT doc_id, k.size AS n_shingles, coalesce(part.component_id, doc_id) AS component_id, coalesce(degree.n, 0) AS n_links FROM k LEFT JOIN rep USING (name) LEFT JOIN part USING (rep) LEFT JOIN degree USING (rep)"""
