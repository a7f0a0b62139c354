"""Substring dedup by difference-cover anchors: removes words covered by a long word sequence of an earlier document.

A difference cover D modulo a period v holds, for any two residues i and j, a shift s below v with (i + s) mod v and
(j + s) mod v both in D. So if two documents agree in a window of `window` words, there is a place in the first v words
of it that is a cover position in both, and the anchors of `window - v + 1` words that start there agree. Hashing the
anchors at cover positions alone (6 of 31) therefore misses no match.

1. Groups of consecutive documents send their distinct anchor hashes to buckets, which answer which of them other
   groups have as well.
2. Each matched anchor is extended to all windows around it. Groups send the hashes of these windows, once per group.
   A bucket answers with one bit each: does a group of smaller documents have the window?
3. Groups remove the words of windows that an earlier group or an earlier document of their own has.

Messages hold an anchor or window once per group however often it occurs, so popular passages stay small. Anchors that
collide cost only extra windows. A window is told by 128 bits, those of two hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cifra.llm.common import MESSAGE, Grouped, are_copies, bucket_rows, copies_of, packed, unpacked

WINDOW = 50
PERIOD = 31
#: A perfect difference set modulo 31: every residue other than 0 is the difference of exactly one pair.
COVER = (1, 5, 11, 24, 25, 27)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so that their powers can be inverted modulo 2**64
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"


class WordHashes(dict):
    """The 64-bit hash of a word, computed when it is first seen."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Sequences:
    """The words of a group's documents by ascending id, with rolling hashes over all of them."""

    def __init__(self, pdf: pd.DataFrame, copies: set[tuple[int, bytes]]):
        rows = sorted(zip(pdf["doc_id"].tolist(), map(bytes, pdf["data"]), strict=True))
        self.ids = np.array([r[0] for r in rows], "<i8")
        self.copy = are_copies(rows, copies)
        self.words = [r[1].split() for r in rows]
        self.sizes = np.array([len(w) for w in self.words], "<i8")
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        self._sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def hashes(self, at: np.ndarray, length: int, base: int) -> np.ndarray:
        """Of the `length` words that start at each place: the polynomial in base over their hashes, modulo 2**64."""
        if not self._sums:
            seen = WordHashes()
            self._values = np.array([seen[w] for words in self.words for w in words], "<u8")
        if base not in self._sums:
            n = len(self._values)
            powers, inverse = (np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), b, "<u8")]) for b in (base, pow(base, -1, 2**64)))
            mixed = self._values ^ (self._values >> np.uint64(31)) * np.uint64(base)
            self._sums[base] = np.r_[np.uint64(0), np.cumsum(mixed * powers[:n])], inverse
        sums, inverse = self._sums[base]
        h = (sums[at + length] - sums[at]) * inverse[at]
        h ^= h >> np.uint64(32)
        h *= np.uint64(BASES[1])
        return h ^ (h >> np.uint64(29))

    def anchors(self, window: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Document and place of each cover position at which a whole anchor fits."""
        length = window - period + 1
        fits = np.where(self.copy | (self.sizes < window), 0, self.sizes - length + 1)
        doc = np.repeat(np.arange(len(fits)), fits)
        local = np.arange(fits.sum()) - np.repeat(np.r_[0, np.cumsum(fits)[:-1]], fits)
        chosen = np.isin(np.arange(period), cover)[local % period]
        return doc[chosen], (self.starts[doc] + local)[chosen]

    def windows_around(self, doc: np.ndarray, at: np.ndarray, window: int, period: int) -> np.ndarray:
        """Places of all windows of a document that hold one of the given anchors."""
        if not len(at):
            return at
        n = int(self.starts[-1]) + 1
        low = np.maximum(at - period + 1, self.starts[doc])
        high = np.minimum(at, self.starts[doc + 1] - window) + 1
        low = np.minimum(low, high)
        return np.flatnonzero(np.cumsum(np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1)) > 0)


def _messages(rows) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["g", "kind", "key", "payload"])


def _anchor_keys(s: Sequences, buckets: int, window: int, period: int, cover: tuple[int, ...]):
    doc, at = s.anchors(window, period, cover)
    h = s.hashes(at, window - period + 1, BASES[0])
    key = ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
    return doc, at, *np.unique(key, return_inverse=True)


def _send_anchors(buckets: int, *shape):
    def send(left: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return _messages([])
        _, _, keys, _ = _anchor_keys(Sequences(left, copies_of(side)), buckets, *shape)
        low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        return _messages(bucket_rows(int(left["g"].iloc[0]), "anchors", np.arange(len(low)), (keys >> np.uint64(32)).astype("<i8"), lambda i: low[i].tobytes()))

    return send


def _answer_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    lists = [np.frombuffer(p, "<u4") for p in pdf["payload"]]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    return _messages((g, "shared", key, packed(np.array([len(own)]), np.packbits(counts[np.searchsorted(values, own)] > 1))) for g, key, own in zip(pdf["g"], pdf["key"], lists, strict=True))


def _all_bits(side: pd.DataFrame, kind: str) -> np.ndarray:
    """A group's answers, in the order of its sorted entries."""
    out = []
    for p in side[side["kind"] == kind].sort_values("key")["payload"]:
        n, bits = unpacked(p)
        out.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=int(np.frombuffer(n, "<i8")[0])).astype(bool))
    return np.concatenate(out) if out else np.zeros(0, bool)


def _window_keys(s: Sequences, at: np.ndarray, buckets: int, window: int):
    """Bucket and both hashes (two rows) of each distinct window, its first place, and of each window which distinct one
    it is. `at` ascends."""
    h, k = (s.hashes(at, window, base) for base in BASES)
    order = np.lexsort((k, h))  # stable, so that equal windows stay in the order of their places
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (k[order][1:] != k[order][:-1])]
    which = np.empty(len(order), "<i8")
    which[order] = np.cumsum(new) - 1
    distinct = order[new]
    of = (k[distinct] % np.uint64(buckets)).astype("<i8")
    order = np.lexsort((k[distinct], h[distinct], of))
    rank = np.empty(len(order), "<i8")
    rank[order] = np.arange(len(order))
    return of[order], np.stack([h[distinct], k[distinct]])[:, order], distinct[order], rank[which]


def _send_windows(buckets: int, window: int, period: int, cover: tuple[int, ...]):
    def send(left: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return _messages([])
        g, s = int(left["g"].iloc[0]), Sequences(left, copies_of(side))
        doc, at, keys, which = _anchor_keys(s, buckets, window, period, cover)
        shared = _all_bits(side, "shared")
        pairs = np.unique(which.astype("<i8") << 32 | doc)
        shared |= np.bincount(pairs >> 32, minlength=len(keys)) > 1
        picked = shared[which] if len(which) else np.zeros(0, bool)
        places = s.windows_around(doc[picked], at[picked], window, period)
        if not len(places):
            return _messages([])
        of, values, _, _ = _window_keys(s, places, buckets, window)
        cut = np.flatnonzero(np.r_[True, places[1:] != places[:-1] + 1])
        state = np.stack([places[cut], np.diff(np.r_[cut, len(places)])])
        rows = [(g, "state", -1 - g, packed(state.astype("<i8")))]
        rows += bucket_rows(g, "windows", np.arange(len(of)), of, lambda i: values[:, i].tobytes())
        return _messages(rows)

    return send


def _answer_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    if pdf["key"].iloc[0] < 0:
        return pdf[["g", "kind", "key", "payload"]]
    groups = pdf["g"].to_numpy()
    lists = [np.frombuffer(p, "<u8").reshape(2, -1) for p in pdf["payload"]]
    order = np.argsort(groups, kind="stable")
    h, k = np.concatenate([lists[i] for i in order], axis=1)
    sizes = np.array([lists[i].shape[1] for i in order])
    owner = np.repeat(groups[order], sizes)
    by = np.lexsort((k, h))  # stable, so that of equal windows the smallest group comes first
    new = np.r_[True, (h[by][1:] != h[by][:-1]) | (k[by][1:] != k[by][:-1])]
    smallest = np.empty(len(by), owner.dtype)
    smallest[by] = owner[by[new]][np.cumsum(new) - 1]
    parts = np.split(smallest < owner, np.cumsum(sizes)[:-1])
    return _messages((groups[i], "earlier", pdf["key"].iloc[i], packed(np.array([len(part)]), np.packbits(part))) for i, part in zip(order.tolist(), parts, strict=True))


def _remove(buckets: int, window: int, with_text: bool):
    def remove(left: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
        if left.empty:
            return pd.DataFrame(columns=columns)
        s = Sequences(left, copies_of(side))
        gone = np.zeros(s.starts[-1], bool)
        for i in np.flatnonzero(s.copy & (s.sizes >= window)):
            gone[s.starts[i] : s.starts[i + 1]] = True
        state = side.loc[side["kind"] == "state", "payload"]
        if len(state):
            begin, count = np.frombuffer(unpacked(state.iloc[0])[0], "<i8").reshape(2, -1)
            places = np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            _, _, first, which = _window_keys(s, places, buckets, window)
            own = s.ids[np.searchsorted(s.starts, places, "right") - 1]
            hit = places[_all_bits(side, "earlier")[which] | (own[first[which]] < own)]
            n = len(gone) + 1
            gone |= np.cumsum(np.bincount(hit, minlength=n) - np.bincount(hit + window, minlength=n))[:-1] > 0
        out = []
        for i, words in enumerate(s.words):
            mask = gone[s.starts[i] : s.starts[i + 1]]
            kept = b" ".join([w for w, x in zip(words, mask.tolist(), strict=True) if not x] if mask.any() else words)
            out.append((s.ids[i], len(words), int(mask.sum()), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return pd.DataFrame(out, columns=columns)

    return remove


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, on demand, the kept words (joined by a space) of each row of docs.

    docs needs doc_id and text; further columns don't matter. A null text has no words. A row without doc_id is neither
    earlier nor later than another: nothing is removed from it or because of it. Rows that repeat a doc_id don't remove
    each other. An empty table gives an empty result. cover must hold every residue as a difference modulo period, and
    period must be at most window.
    """
    if period > window or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("cover must be a difference cover modulo a period of at most window")
    docs = docs.select("doc_id", "text")
    dealt = Grouped(docs, per_bucket=0.05)
    base, copies, n, shape = dealt.frame.groupBy("g"), dealt.copies, dealt.buckets, (window, period, tuple(cover))
    anchors = base.cogroup(copies.groupBy("g")).applyInPandas(_send_anchors(n, *shape), MESSAGE)
    shared = anchors.groupBy("key").applyInPandas(_answer_anchors, MESSAGE)
    windows = base.cogroup(copies.unionByName(shared).groupBy("g")).applyInPandas(_send_windows(n, *shape), MESSAGE)
    earlier = windows.groupBy("key").applyInPandas(_answer_windows, MESSAGE)
    result = base.cogroup(copies.unionByName(earlier).groupBy("g")).applyInPandas(_remove(n, window, with_text), RESULT)
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    unnamed = docs.filter("doc_id is null").select(F.col("doc_id").cast("long"), words.alias("words")).select("doc_id", F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(F.array_join("words", " ").cast("binary"), 256).alias("kept_sha256"), (F.array_join("words", " ").cast("binary") if with_text else F.lit(None).cast("binary")).alias("kept"))
    out = result.unionByName(unnamed)
    return out if with_text else out.drop("kept")
