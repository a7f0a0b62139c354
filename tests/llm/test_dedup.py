import hashlib
import random
import re

from cifra.llm import common, cover_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, n_bytes string, g int, kind string, data string"


def corpus(seed=3, n=60):
    """Invented documents with copies, edits, shared and repeated passages, and every kind of edge case."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ß"[: rng.choice([3, 8])]) for _ in range(rng.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(40) for _ in range(4)]
    rows = []
    for i in range(n):
        t = text(rng.randint(1, 120))
        kind = rng.random()
        if rows and kind < 0.2:
            t = rng.choice(rows)[1] or ""
        elif rows and kind < 0.5:
            words = (rng.choice(rows)[1] or "x").split(" ")
            words[rng.randrange(len(words))] = "edit"
            t = " ".join(words)
        elif kind < 0.7:
            t = t + "\n" + rng.choice(passages) + " " + text(5)
        rows.append([i * 7 - 100, t])
    rows += [[1000, None], [1001, ""], [1002, "a" * 300], [1003, "b" + "a" * 70 + "c"], [1004, "a" * 49], [1004, "a" * 60], [1005, "x y " * 200], [1006, "z" + " y x" * 60], [1007, "  \t\x0b "], [None, "a" * 300], [None, None]]
    return [(*r, "clash", 5, "clash", "clash") for r in rows]


def brute(rows, tokens, join, size):
    """The removal rule, read literally: (units, removed flags) of each row."""
    smallest = {}
    for r in rows:
        if r[0] is not None:
            t = tokens(r[1] or "")
            for i in range(len(t) - size + 1):
                k = join(t[i : i + size])
                smallest[k] = min(r[0], smallest.get(k, r[0]))
    out = []
    for r in rows:
        t = tokens(r[1] or "")
        gone = [False] * len(t)
        for i in range(len(t) - size + 1) if r[0] is not None else ():
            if smallest[join(t[i : i + size])] < r[0]:
                gone[i : i + size] = [True] * size
        out.append((t, gone))
    return out


def test_bytes_removed_as_the_rule_says(spark):
    rows = corpus()
    for popular in (2, 1000):
        got = sorted(map(tuple, suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), popular=popular).collect()), key=str)
        want = []
        for r, (t, gone) in zip(rows, brute(rows, lambda x: x.encode(), bytes, 50), strict=True):
            kept = bytes(b for b, x in zip(t, gone, strict=True) if not x)
            spans = sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone))
            want.append((r[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
        assert got == sorted(want, key=str)
        assert sum(w[2] for w in want) > 1000


def test_words_removed_as_the_rule_says(spark):
    rows = corpus(5)
    got = sorted(map(tuple, cover_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = []
    for r, (t, gone) in zip(rows, brute(rows, lambda x: re.findall(r"[^\x20\x09-\x0D]+", x), tuple, 50), strict=True):
        kept = " ".join(w for w, x in zip(t, gone, strict=True) if not x).encode()
        want.append((r[0], len(t), sum(gone), hashlib.sha256(kept).hexdigest(), kept))
    assert got == sorted(want, key=str)
    assert sum(w[2] for w in want) > 300


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert cover_dedup.remove_repeats(empty).count() == 0


def test_long_documents_are_cut_without_losing_windows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefghij") for _ in range(1000))
    rows = [(1, a), (2, "x" * 30 + a[200:700] + "y" * 30 + a[:49])]
    pdf = __import__("pandas").DataFrame({"doc_id": [r[0] for r in rows], "data": [r[1].encode() for r in rows]})
    runs = suffix_dedup.Runs(pdf, set(), 8, 50, 20)
    assert sum(runs.count) == sum(len(r[1]) - 49 for r in rows)
    assert sum(runs.count[runs.doc == 1][runs.key[runs.doc == 1][:, None].__eq__(runs.key[runs.doc == 0]).any(axis=1)]) >= 451


def test_groups_of_any_ids(spark):
    bounds = [-(2**63), -5, 0, 3, 2**40]
    ids = [-(2**63), -(2**62), -6, -5, -1, 0, 2, 3, 4, 2**40 - 1, 2**40, 2**62]
    for n in range(len(bounds) + 1):
        got = spark.createDataFrame([(i,) for i in ids], "id long").select(common.group_of(common.F.col("id"), bounds[:n])).collect()
        assert [r[0] for r in got] == [sum(b <= i for b in bounds[:n]) for i in ids]


def test_longest_previous_factors():
    rng, np = random.Random(4), suffix_dedup.np
    agree = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))
    for depth, letters in ((9, b"ab"), (16, b"abc"), (20, b"ab"), (50, b"a")):
        data = bytes(rng.choice(letters) for _ in range(200)) + b"abba" * 30
        at = np.arange(len(data) - depth + 1)
        for most in (1, 5, 1000):
            doc = np.array([rng.randint(0, most) for _ in at], "<i8")
            want = [max((agree(data[i : i + depth], data[j : j + depth]) for j in at.tolist() if doc[j] < doc[i]), default=0) for i in at.tolist()]
            assert suffix_dedup.longest_previous_factors(data, at, doc, depth).tolist() == want
            assert suffix_dedup.longest_previous_factors(data, at, doc, depth, depth).tolist() == [w if w >= depth else 0 for w in want]


def test_texts_longer_than_a_piece(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(7)) for _ in range(n))
    long = prose(150_000)  # 1.2 million bytes
    edge = suffix_dedup.PIECE
    parts = [long[edge - 500 : edge + 500], long[2 * edge - 30 : 2 * edge + 60], long[edge - 49 : edge]]
    rows = [(1, long), (2, "\n".join(parts)), (3, f"{prose(100_000)}\n{long[100_000:900_000]}\n{prose(9)}")]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3)] == [0, 1090, 800_000] and [got[i]["n_spans"] for i in (2, 3)] == [2, 1]
    assert got[2]["kept"] == f"\n\n{parts[2]}".encode()
    got = {r["doc_id"]: r for r in cover_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and 122 <= got[2]["n_removed"] <= 125 and 99_990 <= got[3]["n_removed"] <= 100_000


def test_difference_cover_is_checked(spark):
    try:
        cover_dedup.remove_repeats(spark.createDataFrame([], SCHEMA), cover=(0, 1))
    except ValueError:
        return
    raise AssertionError


def test_a_copy_and_another_text_under_one_id(spark):
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(70))
    copied, unique = text(), text()
    rows = [(3, copied), (5, copied), (5, unique), (5, copied), (9, "x " + unique), (9, unique)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for got, tokens, join in ((suffix_dedup.remove_repeats(df), str.encode, bytes), (cover_dedup.remove_repeats(df), str.split, tuple)):
        want = sorted((r[0], len(t), sum(gone)) for r, (t, gone) in zip(rows, brute(rows, tokens, join, 50), strict=True))
        assert sorted((r[0], r[1], r["n_removed"]) for r in got.collect()) == want
        assert [w[2] for w in want if w[0] == 5].count(0) == 1
