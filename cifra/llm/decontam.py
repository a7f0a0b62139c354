"""Benchmark decontamination by a positional inverted index over the training documents.

Documents are packed into shards of bounded size. Each shard is one row that stores, for every term it has, the sorted
positions of its tokens (a posting list); positions run through the shard, so the lists of different documents are one.
The index is stored in the cluster's shared folder before it is searched, and a task searches the shards it reads.

A window of consecutive item words is looked up from the term that is rarest in the whole corpus, its anchor. Windows of
which the shard lacks a term end at once. Then come two searches:
* proximity: places of the anchor with every term of the window at most `within` words away, in the same document;
* exact phrases, where proximity found something: the shard's rarest list, moved back by the term's offset, is
  intersected with the others from rare to frequent until it is empty or all terms are met.

Items are the query set. They are packed into blocks of bounded size, and every block is searched in every shard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cifra.llm.common import fresh, packed, row_hash, sent_if_small, settled, short_batches, text_bytes, unpacked

WINDOW = 13
#: Words on either side of the anchor in which a proximity match has all other terms.
WITHIN = 26
#: Words are runs of digits, letters a-z and everything beyond ASCII.
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
SHARD_BYTES = 4 << 20
#: Words of items in one block of queries.
BLOCK_WORDS = 1 << 20
#: Pairs of an anchor and another term whose places are kept while a shard is searched.
KEPT_PAIRS = 1 << 16


def tokens(data: bytes) -> list[bytes]:
    return TOKEN.findall(data.lower())


class Numbers(dict):
    """Numbers of terms in the order in which they are first seen."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


class Queries:
    """A block of items: their distinct windows as term numbers, and which items have each window."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.terms = Numbers()
        seen: dict[tuple, int] = {}
        self.items: list[set] = []
        for item, data in items:
            words = [self.terms[w] for w in tokens(data)]
            for i in range(max(1, len(words) - window + 1)) if words else ():
                k = seen.setdefault(tuple(words[i : i + window]), len(seen))
                if k == len(self.items):
                    self.items.append(set())
                self.items[k].add(item)
        self.sizes = np.array([len(w) for w in seen], int)
        self.windows = np.full((len(seen), max([1, *self.sizes])), -1, "<i4")
        for i, w in enumerate(seen):
            self.windows[i, : len(w)] = w
        self.distinct: list[list[int]] = []

    def order(self, counts: dict[bytes, int]) -> None:
        """Sets the different terms of each window from the corpus's rarest, the anchor, to the most frequent."""
        rank = np.empty(len(self.terms), int)
        rank[[self.terms[t] for t in sorted(self.terms, key=lambda t: (counts.get(t, 0), t))]] = np.arange(len(self.terms))
        self.distinct = [sorted(set(w[:n].tolist()), key=rank.__getitem__) for w, n in zip(self.windows, self.sizes, strict=True)]


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """shard, payload: a row a shard with its documents (ids, whether there is one, words), its terms, the lengths of
    their posting lists and the lists, each place as the distance from the one before."""
    short_batches(docs.sparkSession)

    def flush(shard: int, ids: list, found: list, terms: Numbers) -> pa.RecordBatch:
        codes = np.concatenate(found) if found else np.zeros(0, "<u4")
        places = np.argsort(codes, kind="stable").astype("<u4")
        own = np.array([i or 0 for i in ids], "<i8"), np.array([i is not None for i in ids], np.uint8), np.array([len(f) for f in found], "<i8")
        value = packed(*own, b" ".join(terms), np.bincount(codes, minlength=len(terms)).astype("<u4"), np.diff(places, prepend=np.zeros(1, "<u4")))
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([value], pa.binary())], names=["shard", "payload"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        ids, found, terms, size = [], [], Numbers(), 0
        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = tokens(data)
                ids.append(doc)
                found.append(np.fromiter(map(terms.__getitem__, words), "<u4", len(words)))
                size += len(data)
                if size >= shard_bytes:
                    yield flush(part << 32 | k, ids, found, terms)
                    ids, found, terms, size, k = [], [], Numbers(), 0, k + 1
        if ids:
            yield flush(part << 32 | k, ids, found, terms)

    return settled(docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(each, "shard long, payload binary"))


class Shard:
    """A shard's documents, and the posting lists of the terms that are asked for."""

    def __init__(self, payload: bytes, asked: Numbers):
        ids, named, counts, terms, sizes, deltas = unpacked(payload)
        self.ids, self.named, self.counts = np.frombuffer(ids, "<i8"), np.frombuffer(named, np.uint8), np.frombuffer(counts, "<i8")
        self.starts = np.r_[0, np.cumsum(self.counts)]
        ends = np.cumsum(np.frombuffer(sizes, "<u4"), dtype="<i8")
        places = np.cumsum(np.frombuffer(deltas, "<u4"), dtype="<u4").astype("<i8")
        self.postings = [places[:0]] * len(asked)
        for term, begin, end in zip(terms.split(b" ") if terms else (), np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            if (t := dict.get(asked, term)) is not None:
                self.postings[t] = places[begin:end]


def occurrences(postings: list[np.ndarray], window: np.ndarray) -> np.ndarray:
    """Places at which all terms of the window follow one another, from the rarest list to the longest."""
    order = np.argsort([len(postings[t]) for t in window], kind="stable")
    found = postings[window[order[0]]] - order[0]
    for k in order[1:]:
        if not len(found):
            break
        other = postings[window[k]]
        i = np.searchsorted(other, found + k)
        i[i == len(other)] = 0
        found = found[other[i] == found + k]
    return found


def around(places: np.ndarray, other: np.ndarray, within: int, starts: np.ndarray) -> np.ndarray:
    """Of each place, whether the other list has one at most `within` words away in the same document; starts has the
    first place of each document, and the end."""
    doc = np.searchsorted(starts, places, "right") - 1
    low, high = np.maximum(places - within, starts[doc]), np.minimum(places + within, starts[doc + 1] - 1)
    return np.searchsorted(other, low) < np.searchsorted(other, high, "right")


def search(shard: Shard, queries: Queries, within: int) -> tuple[np.ndarray, list[tuple[int, int]], list[tuple[int, int]]]:
    """Hit flags of the shard's words, and the (document, window) pairs of exact and of proximity matches."""
    postings, starts = shard.postings, shard.starts
    hit, exact, near = np.zeros(starts[-1] + 1, np.int64), [], []
    masks: dict[tuple[int, int], np.ndarray] = {}
    sizes = np.array([len(p) for p in postings], int)
    alive = ((queries.windows < 0) | (sizes[queries.windows] > 0)).all(axis=1) if len(queries.windows) else ()
    for w in np.flatnonzero(alive).tolist():
        anchor, *others = queries.distinct[w]
        met = np.ones(len(postings[anchor]), bool)
        for t in others:
            if (mask := masks.get((anchor, t))) is None:
                if len(masks) >= KEPT_PAIRS:
                    masks.clear()
                mask = masks[anchor, t] = around(postings[anchor], postings[t], within, starts)
            met = met & mask
            if not met.any():
                break
        if not met.any():
            continue
        near += [(d, w) for d in np.unique(np.searchsorted(starts, postings[anchor][met], "right") - 1).tolist()]
        n = int(queries.sizes[w])
        found = occurrences(postings, queries.windows[w, :n])
        found = found[found >= 0]
        doc = np.searchsorted(starts, found, "right") - 1
        inside = found + n <= starts[np.minimum(doc + 1, len(shard.counts))]
        found, doc = found[inside], doc[inside]
        np.add.at(hit, found, 1)
        np.add.at(hit, found + n, -1)
        exact += [(d, w) for d in np.unique(doc).tolist()]
    return np.cumsum(hit)[:-1] > 0, exact, near


def names_of(pairs: list[tuple[int, int]], items: list[set]) -> dict[int, list[str]]:
    """Of each document the sorted ids of the items whose windows it has; items without id aren't named."""
    found: dict[int, set] = {}
    for d, w in pairs:
        found.setdefault(d, set()).update(items[w])
    return {d: sorted(i for i in own if i is not None) for d, own in found.items()}


FOUND = {"shard": pa.int64(), "place": pa.int32(), "doc_id": pa.int64(), "n_words": pa.int64(), "runs": pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), "item_ids": pa.list_(pa.string()), "near_ids": pa.list_(pa.string())}
SCHEMA = "shard long, place int, doc_id long, n_words long, runs array<struct<begin: long, end: long>>, item_ids array<string>, near_ids array<string>"


def _searched(index: DataFrame, queries: Queries, within: int, all_documents: bool) -> DataFrame:
    """A row for each document, or each one with a match: the runs of words hit, and the items matched."""
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        for b in batches:
            for number, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(payload, asked.terms)
                hit, exact, near = search(shard, asked, within)
                items, close, rows = names_of(exact, asked.items), names_of(near, asked.items), []
                for d in range(len(shard.ids)) if all_documents else sorted({d for d, _ in near}):
                    own = hit[shard.starts[d] : shard.starts[d + 1]]
                    edges = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist() if d in items else []
                    runs = [{"begin": x, "end": y} for x, y in zip(edges[::2], edges[1::2], strict=True)]
                    rows.append((number, d, int(shard.ids[d]) if shard.named[d] else None, int(shard.counts[d]), runs, items.get(d, []), close.get(d, [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(FOUND), FOUND.values(), strict=True)], names=list(FOUND))

    return index.mapInArrow(each, SCHEMA)


def _counts(index: DataFrame, queries: Queries) -> dict[bytes, int]:
    """How often the documents have each term that is asked for; at most the terms of a block come to the driver."""
    sent = index.sparkSession.sparkContext.broadcast(queries.terms)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        total = np.zeros(len(asked), "<i8")
        for b in batches:
            for payload in b.column(0).to_pylist():
                total += np.array([len(p) for p in Shard(payload, asked).postings], "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["term", "n"])

    rows = index.select("payload").mapInArrow(each, "term long, n long").filter("n > 0").groupBy("term").agg(F.sum("n")).collect()
    names = list(queries.terms)
    return {names[t]: n for t, n in rows}


def _covered(runs: Column) -> Column:
    """How many words runs cover together; they may overlap."""
    begin = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("till"))
    add = lambda done, r: F.struct((done["total"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["begin"], done["till"]))).alias("total"), F.greatest(done["till"], r["end"]).alias("till"))
    return F.aggregate(F.array_sort(runs), begin, add)["total"]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = 5, within: int = WITHIN, block_words: int = BLOCK_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, near_sha256 and the sorted
    item_ids and near_ids.

    docs needs doc_id and text, items item_id and text; further columns don't matter. A null text has no words, a
    document without words is clean, an item without words matches nothing. Items that repeat an item_id count once.
    An item without item_id marks words but isn't counted or listed. Rows that repeat a doc_id are judged one by one;
    a null doc_id stays null. Empty tables give an empty result or clean documents. contaminated: at least one word is
    hit and at least `percent` percent of all. Near are items with a window all of whose terms stand at most `within`
    words from a place of the one that the documents have least often (of equally rare ones the first in byte order);
    within is at least window - 1, so items that match exactly are among them.

    Items come to the driver block by block (about block_words words each), never all at once if they are many; each
    block reads the index once.
    """
    if within < window - 1:
        raise ValueError("within must be at least window - 1")
    short_batches(docs.sparkSession)
    asked = items.select(F.col("item_id").cast("string"), text_bytes())
    total = asked.agg(F.sum(F.length("data"))).first()[0] or 0
    blocks = int(total // (4 * block_words)) + 1
    index, found = build_index(docs, shard_bytes), None
    for b in range(blocks):
        own = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id", "data"), F.lit(blocks)) == b)
        queries = Queries([(r[0], bytes(r[1])) for r in own.collect()], window)
        queries.order(_counts(index, queries))
        part = _searched(index, queries, within, all_documents=b == 0)
        found = part if found is None else found.unionByName(settled(part))
    if blocks > 1:
        together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        found = found.groupBy("shard", "place", "doc_id", "n_words").agg(F.flatten(F.collect_list("runs")).alias("runs"), together("item_ids"), together("near_ids"))
    digest = lambda c: F.sha2(F.array_join(c, ",").cast("binary"), 256)
    found = found.withColumn("n_hit", _covered(F.col("runs")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest("item_ids").alias("items_sha256"), ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"),
        F.size("near_ids").cast("long").alias("n_near"), digest("near_ids").alias("near_sha256"), "item_ids", "near_ids",
    )


def stage(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark passage, however long the rest of their text is.

    Each row is judged by its own text: the verdict comes back by a hash of id and text, so that rows without doc_id are
    judged too and rows that repeat one don't share a verdict. Null and wordless texts stay. An empty table gives an
    empty result, and without items all rows stay.
    """
    row, (name,) = row_hash(["doc_id", "text"]), fresh(docs, "_row")
    bad = contamination(docs.select(row.alias("doc_id"), "text"), items).filter("n_hit > 0").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(sent_if_small(bad), row == F.col(name), "left_anti").select(*docs.columns)
