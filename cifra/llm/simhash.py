"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked when at most 4 bits differ.

Four differing bits spread over three segments leave one segment with at most one of them. So each segment is indexed
once for every one of its bits, with that bit taken out: fingerprints whose segments differ in at most one bit agree in
one of these deletion variants. An equality join on the variants finds all candidates; each is verified by its number
of differing bits.

Within a variant's members links are found by expanding one member at a time against those not reached yet, so that
members of a dense group leave the comparison at once; only a spanning forest of the links is passed on, never all
pairs. Components follow from that forest by alternating star contraction, whose rounds are checkpointed. Equal
fingerprints are one node throughout, so exact copies cost nothing.

A variant that very many different fingerprints share is not compared in one task. Two fingerprints differ in at most 4
bits exactly if some number differs from each in at most 2. So each member names all such numbers, and the members that
name the same one are linked with the smallest of them: an aggregation, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cifra.llm.common import fresh, row_hash, sent_if_small, settled, short_batches, text_bytes

SHINGLE = 4
SEED = 42
MOST_BITS = 4
#: First bit of each segment, and the end.
SEGMENTS = (0, 21, 42, 64)
#: Different fingerprints of one variant that a task holds and compares; those of a larger one are linked by balls.
TOGETHER = 1 << 17
#: One in so many fingerprints is looked at to foresee such variants, before their rows are dealt out.
FORESEEN = 64


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it; shingles count as often as they occur."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    starts = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), (starts[shingle:] - 1).tolist(), strict=True)], "<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those that more than half of the hashes have.

    Eight counters of a byte each run in one word; blocks of 255 hashes keep them from overflowing.
    """
    n = len(hashes)
    blocks = np.concatenate([hashes, np.zeros(-n % 255, "<u8")]).reshape(-1, 255)
    lanes = np.stack([((blocks >> np.uint64(b)) & np.uint64(0x0101010101010101)).sum(axis=1) for b in range(8)])
    ones = lanes.astype("<u8").view(np.uint8).reshape(8, -1, 8).sum(axis=1, dtype=np.int64)  # bit of the byte, byte
    return int(np.packbits(2 * ones.T.ravel() > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, row: Column | None = None) -> DataFrame:
    """doc_id, print, the fingerprint as a signed long, and row (a long, null if not given) of each row of docs."""
    short_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints), b.column(2)], names=["doc_id", "print", "row"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes(), (F.lit(None) if row is None else row).cast("long").alias("row")).mapInArrow(each, "doc_id long, print long, row long")


def forest(prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect exactly what all links of at most `most` differing bits connect; fewer than members."""
    left, links = np.arange(1, len(prints)), []
    queue = [0]
    while queue or len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        at = queue.pop()
        near = np.bitwise_count(prints[left] ^ prints[at]) <= most
        links += [(at, x) for x in left[near].tolist()]
        queue += left[near].tolist()
        left = left[~near]
    return links


def balls(members: DataFrame, most: int) -> DataFrame:
    """a, b: links between members (node long, print long) that connect what all links connect, without comparing any.

    Each member names the numbers near it: those within half of `most` bits (close), or, for an odd `most`, one bit more.
    A close member of a number and any other member of it differ in at most `most` bits, and two members that differ in
    no more have such a number in common; so all members of a number are linked with its smallest close one.
    """
    near = most // 2
    masks = [sum(1 << bit for bit in bits) for n in range(most - near + 1) for bits in combinations(range(64), n)]
    named = members.select("node", "print", F.explode(F.lit([m - (m >> 63 << 64) for m in masks])).alias("mask"))
    named = named.select("node", F.col("print").bitwiseXOR(F.col("mask")).alias("number"), (F.bit_count("mask") <= near).alias("close"))
    least = named.groupBy("number").agg(F.min(F.when(F.col("close"), F.col("node"))).alias("least"), F.count("*").alias("n")).filter("n > 1 and least is not null")
    linked = named.join(least, "number").filter("node <> least")
    return linked.select(F.greatest("node", "least").alias("a"), F.least("node", "least").alias("b")).distinct()


def links(nodes: DataFrame, most: int = MOST_BITS, together: int = TOGETHER) -> DataFrame:
    """a, b: links between nodes (node long, print long; distinct prints) that connect what all links connect."""
    shift = [SEGMENTS[max(i for i in range(3) if SEGMENTS[i] <= bit)] for bit in range(64)]
    size = {SEGMENTS[i]: SEGMENTS[i + 1] - SEGMENTS[i] for i in range(3)}
    variants = F.array(*[F.shiftrightunsigned("print", shift[bit]).bitwiseAND(F.lit((2 ** size[shift[bit]] - 1) & ~(1 << bit - shift[bit]))).bitwiseOR(F.lit(bit << 24)) for bit in range(64)])
    of = lambda some: some.select(F.explode(variants).alias("variant"), "node", "print")

    def batch(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], names=["a", "b"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, passed = np.zeros((3, 0), "<i8"), None  # passed: a variant of too many members, whose rows are passed over
        for b in batches:
            rows = np.stack([b.column(i).to_numpy() for i in range(3)])
            rows = np.concatenate([rest, rows if passed is None else rows[:, rows[0] != passed]], axis=1)
            if not rows.shape[1]:
                continue
            last = np.searchsorted(rows[0], rows[0][-1])  # the last variant may go on in the next batch
            yield from found(rows[:, :last])
            rest = rows[:, last:]
            if rest.shape[1] > together:
                passed, rest = rest[0, 0], rest[:, :0]
                yield batch(np.array([passed]), None)
        yield from found(rest)

    def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        variant, node, prints = rows[0], rows[1], np.ascontiguousarray(rows[2]).view("<u8")
        if not len(variant):
            return
        cut = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
        count = np.diff(np.r_[cut, len(variant)])
        pairs = cut[count == 2]
        pairs = pairs[np.bitwise_count(prints[pairs] ^ prints[pairs + 1]) <= most]
        a, b = [node[pairs]], [node[pairs + 1]]
        several = (count > 2) & (count <= together)
        for start, n in zip(cut[several].tolist(), count[several].tolist(), strict=True):
            got = np.array(forest(prints[start : start + n], most), "<i8").reshape(-1, 2) + start
            a.append(node[got[:, 0]])
            b.append(node[got[:, 1]])
        yield batch(np.concatenate(a), np.concatenate(b))
        yield batch(variant[cut[count > max(2, together)]], None)

    # The sample only foresees which variants are crowded, so that these aren't dealt out; the task that meets a crowded
    # one all the same passes it over. Either way its members are linked by balls.
    sample = of(nodes.filter(F.pmod(F.xxhash64("print"), F.lit(FORESEEN)) == 0))
    foreseen = settled(sample.groupBy("variant").count().filter(F.col("count") > together / FORESEEN).select("variant"))
    rows = of(nodes) if foreseen.isEmpty() else of(nodes).join(foreseen, "variant", "left_anti")
    dealt = rows.repartition("variant").sortWithinPartitions("variant")
    checked = settled(dealt.mapInArrow(verified, "a long, b long"))
    linked = checked.filter("b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    crowded = foreseen.unionByName(checked.filter("b is null").select(F.col("a").alias("variant")))
    if crowded.isEmpty():
        return linked
    members = of(nodes).join(crowded, "variant", "left_semi").select("node", "print").distinct()
    return linked.unionByName(balls(members, most))


def components(edges: DataFrame) -> DataFrame:
    """node, root: of each node in edges (a > b), the smallest node it is connected with.

    Large stars hang each larger neighbour on a node's smallest one, small stars each smaller one, until nothing moves.
    Stars are pre-aggregated before they meet. What they meet with is settled, so that the joins deal out both sides
    themselves and can split a node on which very many hang.
    """

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = settled(edges)
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settled(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = settled(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = settled(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = settled(small)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def clusters(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_BITS, seed: int = SEED, together: int = TOGETHER) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id, the smallest doc_id reachable, of each row.

    docs needs doc_id and text; further columns don't matter. A null or wordless text has fingerprint zero and is
    linked like any other. Rows that repeat a doc_id each count. A row without doc_id has its fingerprint, links others
    through it, and is never a component_id unless its whole component has none, which gives null. An empty table gives
    an empty result.
    """
    return clustered(docs, shingle, most, seed, together).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def clustered(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_BITS, seed: int = SEED, together: int = TOGETHER, row: Column | None = None) -> DataFrame:
    """doc_id, print, row (as in fingerprints()), component (a print of it) and component_id of each row of docs.

    A node is a fingerprint, not a doc_id: rows of quite different texts that repeat a doc_id aren't linked by it.
    """
    if most > 4:
        raise ValueError("three segments with one deletion find at most 4 differing bits")
    prints = settled(fingerprints(docs, shingle, seed, row))
    nodes = settled(prints.groupBy("print").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("print")))
    roots = components(links(nodes, most, together))
    # Only components of several fingerprints are brought together; the root of one isn't among the nodes of roots.
    linked = settled(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(nodes, "node").select("print", F.col("root").alias("component"), "least"))
    least = settled(linked.groupBy("component").agg(F.min("least").alias("component_id")))
    of_linked = linked.join(least, "component").select("print", "component", "component_id")
    # Settled, so that the join deals out both sides itself and can split a print that very many rows have.
    known = settled(nodes.join(of_linked, "print", "left").select("print", F.coalesce("component", "print").alias("component"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")))
    return prints.join(known, "print").select("doc_id", "print", "row", "component", "component_id")


def stage(docs: DataFrame) -> DataFrame:
    """docs with exactly one row of each component: the smallest doc_id; rows without doc_id come last, and of rows that
    repeat an id a hash of the whole row decides. Of rows equal in every column one stays."""
    same_id, same_row = fresh(docs, "_doc_id", "_row")
    row, key = row_hash(docs.columns), F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    found = settled(clustered(docs, row=row).select("component", "doc_id", "row"))
    firsts = settled(found.groupBy("component").agg(F.min(key).alias("first"), F.max(key).alias("last")).filter("first < last").select("component", "first"))
    gone = found.join(firsts, "component").filter(key > F.col("first")).select(F.col("doc_id").alias(same_id), F.col("row").alias(same_row)).distinct()
    same = (F.col(same_row) == row) & F.col(same_id).eqNullSafe(F.col("doc_id").cast("long"))
    left = docs.join(sent_if_small(gone), same, "left_anti")
    alike = settled(found.groupBy("doc_id", "row").count().filter("count > 1").select(F.col("doc_id").alias(same_id), F.col("row").alias(same_row)))
    if not alike.isEmpty():
        left = left.join(alike, same, "left_anti").unionByName(left.join(alike, same, "left_semi").dropDuplicates(docs.columns))
    return left.select(*docs.columns)
