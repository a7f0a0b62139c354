"""Suffix-array dedup: removes every byte covered by a long string that already starts in an earlier document.

The longest previous factor of a position is the longest string starting there that also starts earlier, here in a
document with a smaller id. Sorting the suffixes puts those that share a prefix side by side; the nearest suffix before
and the nearest after with a smaller document are its previous and next smaller ones, and its longest previous factor is
what it has in common with the one or the other. The bytes of factors of `length` or more go, and the first copy stays.
As no shorter factor matters, suffixes are compared, and factors measured, to that depth.

No machine can sort the suffixes of the whole corpus, so they are dealt out by content:

1. The smallest hash among the short grams inside a window of `length` bytes (its minimizer) is a function of the
   window's content: equal windows have equal minimizers, and neighbouring windows mostly share theirs. Each group of
   documents sends its distinct minimizers to buckets, which answer which of them other groups have too.
2. Runs of windows with a shared minimizer are sent, once per group and content, to the bucket of the minimizer. There
   the windows' suffixes are sorted and their longest previous factors found. Of a content that several groups have, all
   but the smallest document have the whole run as a factor. A minimizer that very many groups have would gather the
   surroundings of a popular passage in one bucket; its windows are dealt out one by one by their own hash instead.
3. The answers, a bit for each window of a run, go back to the groups, which remove the covered bytes. Documents of a
   group that repeat a run of a smaller one in it need no answer.

Whole copies of a smaller document are recognised first and don't take part. Bytes, not hashes, decide on equality.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cifra.llm.common import MESSAGE, Grouped, are_copies, bucket_rows, copies_of, packed, text_bytes, unpacked

LENGTH = 50
GRAM = 20
#: A minimizer in so many groups has its windows dealt out one by one.
POPULAR = 48
PIECE = 1 << 19
MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """A hash of the gram at each position, from unaligned 8-byte words."""
    n = len(data) - gram + 1
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = np.zeros(n, "<u8")
    for i, at in enumerate([*range(0, gram - 8, 8), gram - 8]):
        x = words[at : at + n] * MULTIPLIERS[i % 4]
        h ^= x + (x >> np.uint64(29))
        h *= MULTIPLIERS[(i + 1) % 4]
    h ^= h >> np.uint64(32)
    h *= MULTIPLIERS[0]
    return h ^ (h >> np.uint64(29))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[: -(width - done)], h[width - done :]) if done < width else h


class Runs:
    """The windows of a group's documents in runs of one minimizer: document, first window, windows, key."""

    def __init__(self, pdf: pd.DataFrame, copies: set[tuple[int, bytes]], buckets: int, length: int, gram: int, hashed: bool = True):
        rows = sorted(zip(pdf["doc_id"].tolist(), map(bytes, pdf["data"]), strict=True))
        self.ids = np.array([r[0] for r in rows], "<i8")
        self.texts = [r[1] for r in rows]
        self.copy = are_copies(rows, copies)
        self.starts = np.cumsum([0, *map(len, self.texts)])
        self.buckets = buckets
        if hashed:
            found = [r for piece in self._pieces(length) for r in self._runs(*piece, length, gram)]
            self.doc, self.at, self.count = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, "<i8") for i in range(3))
            h = np.concatenate([f[3] for f in found]) if found else np.zeros(0, "<u8")
            self.key = ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
            self.keys, self.which = np.unique(self.key, return_inverse=True)

    def _pieces(self, length: int):
        """Bytes of whole documents up to PIECE together, or overlapping parts of a longer one: (bytes, document of each part, offset in it, its end in bytes)."""
        batch, parts, size = [], [], 0
        for i, text in enumerate(self.texts):
            if self.copy[i] or len(text) < length:
                continue
            for a in range(0, max(1, len(text) - length + 1), PIECE):
                part = text[a : a + PIECE + length - 1]
                if size and size + len(part) > 2 * PIECE:
                    yield b"".join(batch), parts
                    batch, parts, size = [], [], 0
                batch.append(part)
                size += len(part)
                parts.append((i, a, size))
        if parts:
            yield b"".join(batch), parts

    def _runs(self, data: bytes, parts: list, length: int, gram: int):
        m = sliding_min(gram_hashes(data, gram), length - gram + 1)
        valid = np.ones(len(m), bool)
        ends = np.array([p[2] for p in parts])
        for end in ends:
            valid[end - length + 1 : end] = False
        at = np.flatnonzero(valid)
        value = m[at]
        cut = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)])
        first = at[cut]
        part = np.searchsorted(ends, first, "right")
        begin = np.r_[0, ends[:-1]][part]
        yield np.array([p[0] for p in parts])[part], first - begin + np.array([p[1] for p in parts])[part], np.diff(np.r_[cut, len(at)]), value[cut]

    def in_several_documents(self) -> np.ndarray:
        """Of each distinct key, whether two documents of this group have it."""
        pairs = np.unique(self.which.astype("<i8") << 32 | self.doc)
        return np.bincount(pairs >> 32, minlength=len(self.keys)) > 1


def _messages(rows) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["g", "kind", "key", "payload"])


def _send_keys(buckets: int, length: int, gram: int):
    def send(left: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return _messages([])
        runs = Runs(left, copies_of(side), buckets, length, gram)
        low = (runs.keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        return _messages(bucket_rows(int(left["g"].iloc[0]), "keys", np.arange(len(low)), (runs.keys >> np.uint64(32)).astype("<i8"), lambda i: low[i].tobytes()))

    return send


def _answer_keys(popular: int):
    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of each group's keys in a bucket: does another group have it, and do very many."""
        lists = [np.frombuffer(p, "<u4") for p in pdf["payload"]]
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        out = []
        for g, key, own in zip(pdf["g"], pdf["key"], lists, strict=True):
            n = counts[np.searchsorted(values, own)]
            out.append((g, "shared", key, np.packbits(np.r_[n > 1, n >= popular]).tobytes()))
        return _messages(out)

    return answer


def _bits(side: pd.DataFrame, sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The answers to all keys of a group, in the order of its keys."""
    rows = side[side["kind"] == "shared"].sort_values("key")
    both = [np.unpackbits(np.frombuffer(p, np.uint8), count=2 * sizes[k]).reshape(2, -1) for k, p in zip(rows["key"], rows["payload"], strict=True)]
    all_of = np.concatenate(both, axis=1) if both else np.zeros((2, 0), np.uint8)
    return all_of[0].astype(bool), all_of[1].astype(bool)


def _send_segments(buckets: int, length: int, gram: int):
    def send(left: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return _messages([])
        g = int(left["g"].iloc[0])
        runs = Runs(left, copies_of(side), buckets, length, gram)
        at, n = np.unique(runs.keys >> np.uint64(32), return_counts=True)
        shared, popular = _bits(side, dict(zip(at.tolist(), n.tolist(), strict=True)))
        shared |= runs.in_several_documents()
        seen: dict[bytes, int] = {}
        keys, docs, state = [], [], []
        picked = np.flatnonzero(shared[runs.which]) if len(runs.which) else np.zeros(0, int)
        for doc, start, count, key, hot in zip(runs.doc[picked].tolist(), runs.at[picked].tolist(), runs.count[picked].tolist(), runs.key[picked].tolist(), popular[runs.which[picked]].tolist(), strict=True):
            text = runs.texts[doc]
            for a, c in ((i, 1) for i in range(start, start + count)) if hot else ((start, count),):
                segment = text[a : a + c + length - 1]
                k = seen.setdefault(segment, len(seen))
                if k == len(keys):  # documents come by ascending id, so the first is the smallest
                    if hot:
                        h = xxhash.xxh64_intdigest(segment)
                        key = (h >> 32) % buckets << 32 | h & 0xFFFFFFFF
                    keys.append(key)
                    docs.append(doc)
                state.append((doc, a, c, k, runs.ids[doc] > runs.ids[docs[k]]))
        if not seen:
            return _messages([])
        keys, segments = np.array(keys, "<u8"), list(seen)
        of = (keys >> np.uint64(32)).astype("<i8")
        sizes, ids = np.array([len(s) for s in segments], "<u4"), runs.ids[docs]
        # By column and as differences, which compress well: documents, places and segments mostly go up by little.
        state = np.diff(np.array(state, "<i8"), axis=0, prepend=0).astype("<i4").T
        rows = [(g, "state", -1 - g, packed(*state, of.astype("<u4"), (sizes - length + 1).astype("<u4")))]
        rows += bucket_rows(g, "segments", np.argsort(of, kind="stable"), of, lambda i: packed((keys[i] & np.uint64(0xFFFFFFFF)).astype("<u4"), sizes[i], ids[i], b"".join([segments[x] for x in i.tolist()])))
        return _messages(rows)

    return send


def suffix_order(data: bytes, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that start at `at` by their first `depth` bytes, which each must have, and in how many
    of these bytes each one agrees with the one before it in that order (0 for the first)."""
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    offsets = [*range(0, depth - 8, 8), depth - 8]
    columns = [words[at + i].astype("<u8") for i in offsets]
    order = np.lexsort(columns[::-1])
    common = np.full(len(order), depth)
    common[:1] = 0
    for i, c in zip(offsets[::-1], columns[::-1], strict=True):
        s = c[order]
        differ = np.flatnonzero(s[1:] != s[:-1])
        x = s[differ + 1] ^ s[differ]
        common[differ + 1] = i + sum((x < np.uint64(1 << 8 * k)).astype(int) for k in range(1, 8))
    return order, common


def previous_smaller(doc: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """What each suffix, in order, has in common with the nearest one before it that has a smaller document: 0 if there
    is none, or where it is shorter than `least`.

    Every suffix points to the one before it. While that has no smaller document, the pointer goes on to where that one
    points, as those in between have none either; so pointers double their reach in each round.
    """
    at, low = np.arange(-1, len(doc) - 1), common.copy()
    left = np.flatnonzero((at >= 0) & (low >= least))
    while len(left := left[doc[at[left]] >= doc[left]]):
        low[left], at[left] = np.minimum(low[left], low[at[left]]), at[at[left]]
        left = left[(at[left] >= 0) & (low[left] >= least)]
    low[(at < 0) | (low < least)] = 0
    return low


def longest_previous_factors(data: bytes, at: np.ndarray, doc: np.ndarray, depth: int, least: int = 1) -> np.ndarray:
    """Of the suffixes starting at `at` in data, each at least `depth` bytes long and of document `doc`: the length, up
    to depth, of the longest prefix with which a suffix of a smaller document starts too; 0 if it is under `least`."""
    order, common = suffix_order(data, at, depth)
    own = doc[order]
    before = previous_smaller(own, common, least)
    after = previous_smaller(own[::-1], np.r_[0, common[:0:-1]], least)[::-1]
    out = np.empty(len(order), int)
    out[order] = np.maximum(before, after)
    return out


def _answer_segments(length: int):
    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["key"].iloc[0] < 0:
            return pdf[["g", "kind", "key", "payload"]]
        seen: dict[bytes, int] = {}
        entry, unique, doc = [], [], []
        for value in pdf["payload"]:
            keys, sizes, ids, joined = unpacked(value)
            ends = np.cumsum(np.frombuffer(sizes, "<u4"), dtype="<i8").tolist()
            parts = [joined[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            unique.append(np.array([seen.setdefault(p, len(seen)) for p in parts]))
            entry.append(np.frombuffer(keys, "<u4"))
            doc.append(np.frombuffer(ids, "<i8"))
        all_unique = np.concatenate(unique)
        first = np.full(len(seen), np.iinfo("<i8").max)
        np.minimum.at(first, all_unique, np.concatenate(doc))
        of = np.zeros(len(seen), "<u4")
        of[all_unique] = np.concatenate(entry)
        windows = np.array([len(s) - length + 1 for s in seen])
        offset = np.r_[0, np.cumsum(windows)]
        hit = np.zeros(offset[-1], bool)
        # A content alone under its minimizer stands next to its own copies only: its smallest document has no factor.
        _, inverse, n = np.unique(of, return_inverse=True, return_counts=True)
        several = np.flatnonzero(n[inverse] > 1)
        if len(several):
            segments = list(seen)
            data = b"".join([segments[i] for i in several.tolist()])
            begin = np.r_[0, np.cumsum(windows[several] + length - 1)[:-1]]
            index = np.repeat(offset[several] - np.r_[0, np.cumsum(windows[several])[:-1]], windows[several]) + np.arange(windows[several].sum())
            local = index - np.repeat(offset[several], windows[several])
            hit[index] = longest_previous_factors(data, np.repeat(begin, windows[several]) + local, np.repeat(first[several], windows[several]), length, length) >= length
        out = []
        for g, key, own, ids in zip(pdf["g"], pdf["key"], unique, doc, strict=True):
            w = windows[own]
            index = np.repeat(offset[own] - np.r_[0, np.cumsum(w)[:-1]], w) + np.arange(w.sum())
            out.append((g, "hits", key, np.packbits(hit[index] | np.repeat(ids > first[own], w)).tobytes()))
        return _messages(out)

    return answer


def _remove(length: int, with_text: bool):
    def remove(left: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        runs = Runs(left, copies_of(side), 1, length, GRAM, hashed=False)
        gone = np.zeros(runs.starts[-1], bool)
        for i in np.flatnonzero(runs.copy):
            if len(runs.texts[i]) >= length:
                gone[runs.starts[i] : runs.starts[i + 1]] = True
        state = side.loc[side["kind"] == "state", "payload"]
        if len(state):
            *lines, of, windows = unpacked(state.iloc[0])
            lines = [np.cumsum(np.frombuffer(c, "<i4"), dtype="<i8") for c in lines]
            of, windows = np.frombuffer(of, "<u4"), np.frombuffer(windows, "<u4").astype("<i8")
            order = np.argsort(of, kind="stable")
            size = np.bincount(of, windows).astype(int)
            answers = side[side["kind"] == "hits"].sort_values("key")
            bits = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8), count=size[k]) for k, p in zip(answers["key"], answers["payload"], strict=True)]).astype(bool)
            offset = np.empty(len(of), "<i8")
            offset[order] = np.r_[0, np.cumsum(windows[order])[:-1]]
            doc, at, count, segment, later = lines
            ramp = np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
            hit = bits[np.repeat(offset[segment], count) + ramp] | np.repeat(later > 0, count)
            begin = (np.repeat(runs.starts[doc] + at, count) + ramp)[hit]
            n = len(gone) + 1
            gone |= np.cumsum(np.bincount(begin, minlength=n) - np.bincount(begin + length, minlength=n))[:-1] > 0
        out = []
        for i, text in enumerate(runs.texts):
            mask = gone[runs.starts[i] : runs.starts[i + 1]]
            if mask.any():
                kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
                spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
            else:
                kept, spans = text, 0
            out.append((runs.ids[i], len(text), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return remove


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, popular: int = POPULAR, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on demand, the kept bytes of each row of docs.

    docs needs doc_id and text; further columns don't matter. A null text is empty. A row without doc_id is neither
    earlier nor later than another: nothing is removed from it or because of it. Rows that repeat a doc_id don't remove
    each other. An empty table gives an empty result. length must be at least gram, gram at least 9.
    """
    if not 9 <= gram <= length:
        raise ValueError("9 <= gram <= length")
    docs = docs.select("doc_id", "text")
    dealt = Grouped(docs, per_bucket=0.25)
    base, copies, n = dealt.frame.groupBy("g"), dealt.copies, dealt.buckets
    keys = base.cogroup(copies.groupBy("g")).applyInPandas(_send_keys(n, length, gram), MESSAGE)
    shared = keys.groupBy("key").applyInPandas(_answer_keys(popular), MESSAGE)
    segments = base.cogroup(copies.unionByName(shared).groupBy("g")).applyInPandas(_send_segments(n, length, gram), MESSAGE)
    answers = segments.groupBy("key").applyInPandas(_answer_segments(length), MESSAGE)
    result = base.cogroup(copies.unionByName(answers).groupBy("g")).applyInPandas(_remove(length, with_text), RESULT)
    unnamed = docs.filter("doc_id is null").select(F.col("doc_id").cast("long"), text_bytes()).select("doc_id", F.length("data").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("data", 256).alias("kept_sha256"), (F.col("data") if with_text else F.lit(None).cast("binary")).alias("kept"))
    out = result.unionByName(unnamed)
    return out if with_text else out.drop("kept")
