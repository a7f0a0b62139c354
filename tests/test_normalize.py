import pytest
from pyspark.sql import functions as F

from cifra.functions import lexicon, verbalize
from cifra.operators import fold, normalize

BOTH = [
    ("двести пятьдесят рублей", "250 рублей"), ("первого числа", "1 числа"), ("две тысячи двадцать третий", "2023"), ("дветысячи пятьсот", "2500"), ("тыща четыреста", "1400"),
    ("с чем то тыщ", "с чем то тыщ"), ("от десяти и выше тыщ", "от 10 и выше тыщ"), ("двадцати тысячам", "20000"), ("двести восемьдесят четвёртый", "284"),
    ("семьдесят миллионов два миллиона", "70000000 2000000"), ("на четырнадцатое число", "на 14 число"), ("двести два два", "200 2 2"), ("двеси триста пятьдесят тысяч", "235000"),
    ("пять с половиной тыщ", "5 с половиной тыщ"), ("дваста рублей", "200 рублей"), ("двадцатый пятый", "20 5"), ("двести сто на", "200 100 на"), ("десять пять", "15"), ("пятнадцать пять", "20"),
    ("двадцать пять пять", "20 5 5"), ("двадцать ноль", "20"), ("пять тысяч ноль", "5000"), ("ноль ноль семь", "0 0 7"), ("один ноль", "1 0"), ("ноль двадцать", "0 20"), ("ноль тысяч", "1000"),
    ("тысяча миллионов", "1001000"), ("два миллиона три тысячи четыре миллиона", "6003000"), ("тысяча тысяча", "1000 1000"), ("двеси триста девяносто тысяч", "200 390000"), ("стая", "100"),
    ("семья", "7"), ("стою", "100"), ("два миллионы", "2 миллионы"), ("двадцатью", "двадцатью"), ("двестипятьсот", "2500"), ("тристапятьдесят", "тристапятьдесят"), ("девять)", "девять)"),
    ("один,5", "один,5"), ("седьмая", "7"), ("  ", "  "), (None, None), ("", ""), ("а   пять", "а 5"), ("а\u00a0пять", "а 5"),
]
APART = [
    ("девятьтысяч", "9", "9000"), ("Дветысячи пятьсот", "2000 500", "2500"), ("двадцатое пятое", "20 5", "25"), ("двести пятнадцать пять", "220", "200 20"), ("двести пять пятый", "200 5 5", "205 5"),
    ("почти тыщ", "почти 1000", "почти тыщ"), ("половиной тыщ", "половиной тыщ", "половиной 1000"), ("около Тыщ", "около 1000", "около Тыщ"), ("я сто", "я сто", "я 100"), ("сто на", "сто на", "100 на"),
    ("три те", "три те", "3 те"), ("сорок птиц", "сорок птиц", "40 птиц"),
]


@pytest.mark.parametrize("mode", ["current", "sequence"])
def test_golden_phrases(spark, mode):
    rows = [(a, b) for a, b in BOTH] + [(a, c if mode == "current" else s) for a, c, s in APART]
    got = spark.createDataFrame(rows, "t string, want string").select("t", "want", normalize.normalize(F.col("t"), mode).alias("got")).collect()
    assert [(r["t"], r["got"]) for r in got if r["got"] != r["want"]] == []


def test_round_trip(spark):
    numbers = spark.range(0, 4000).select((F.col("id") * 249_989 % 1_000_000_000).alias("n")).union(spark.range(0, 1200))
    for mode in normalize.MODES:
        assert numbers.filter(normalize.normalize(verbalize.number_to_words(F.col("n")), mode) != F.col("n").cast("string")).count() == 0


def test_words_of_numbers(spark):
    row = spark.range(1).select(*[verbalize.number_to_words(F.lit(n)) for n in (0, 21000, 2_000_001, 999_999_999, 10**9, -1)], verbalize.number_to_words(F.lit(2_000_000), False), verbalize.ordinal_words(F.lit(21)), verbalize.ordinal_words(F.lit(40)), verbalize.spoken_words(F.lit(2000)), verbalize.spoken_words(F.lit(10**6))).first()
    assert list(row) == ["ноль", "двадцать одна тысяч", "два миллиона один", "девятьсот девяносто девять миллионов девятьсот девяносто девять тысяч девятьсот девяносто девять", None, None, "два миллионов", "двадцать первый", "40", "два тысячи", "1000000"]


CASES = [
    ([(200, 3, 0), (50, 2, 0)], ["250"]), ([(200, 3, 0), (300, 3, 0)], ["200", "300"]), ([(2, 0, 0), (1000, 4, 1), (800, 3, 0), (40, 2, 0), (3, 0, 0)], ["2843"]), ([(70, 2, 0), (10**6, 5, 1), (2, 0, 0), (10**6, 5, 1)], ["70000000", "2000000"]),
    ([(1000, 4, 1)], ["1000"]), ([(0, 0, 0)], ["0"]), ([(0, 0, 0), (7, 0, 0)], ["0", "7"]), ([(200, 3, 0), (80, 1, 0), (5, 0, 2)], ["285"]), ([], []), ([(2, 0, 0), (2, 0, 0)], ["2", "2"]), ([(5, 0, 0), (1000, 4, 1), (200, 3, 0)], ["5200"]),
]


def test_groups(spark):
    df = spark.createDataFrame(CASES, f"parts {lexicon.PARTS}, want array<string>")
    for sequence in (False, True):
        assert df.filter(fold.parse_group(F.col("parts"), sequence) != F.col("want")).count() == 0


def test_classes(spark):
    words = {"пять": [(5, 0, 0)], "четырнадцать": [(14, 1, 0)], "двадцатое": [(20, 2, 2)], "компьютер": [], "двеси": [(200, 3, 0)], "тысячами": [(1000, 4, 1)], "дветысячи": [(2, 0, 0), (1000, 4, 1)], "x": []}
    df = spark.createDataFrame([(list(words),)], "t array<string>").select(normalize.classified(F.col("t"), True).alias("c"))
    assert [[tuple(p) for p in x["parts"]] for x in df.first()["c"]] == list(words.values())
    assert len(lexicon.words()) == 2647


def test_confidence_and_hybrid(spark):
    rows = [("сто рублей", "100 рублей", 1.0), ("пять тыщ", "5000", 0.6), ("двеси триста тысяч", "200 300000", 0.7), ("два два", "2 2", 0.7), ("двадцать тысячам", "20 тысячам", 0.7), ("шестьтысяч", "первый пятый", 0.1), ("", "второй", 1.0)]
    got = spark.createDataFrame(rows, "t string, p string, want double").select("t", "want", normalize.confidence(F.col("t"), F.col("p")).alias("got")).collect()
    assert [(r["t"], r["got"]) for r in got] == [(r[0], r[2]) for r in rows]
    df = spark.createDataFrame([("пять тыщ", "иначе"), ("пять", "иначе"), ("пять тыщ", None)], "t string, f string")
    assert [r[0] for r in df.select(normalize.hybrid(F.col("t"), F.col("f"))).collect()] == ["иначе", "5", "5000"]


def phrases() -> list[str]:
    """Number words, contexts and odd separators in seeded disorder."""
    import random

    r = random.Random(7)
    said = [w for line in lexicon.CARDINALS.strip().splitlines() for w in line.split()[2:]]
    contexts = "с чем то где половиной около выше почти тыщ тыща Тыщ я сто на у перед и рубл до более сорок птиц три ся те двеси триста пятьсот пятьдесят тысяч пятдесят тристо дветысячи девятьтысяч стотысячами слово 25".split()
    gaps = [" ", "  ", " ", "\u001c", "\n", "-", "́ ", "‍", "_ ", "² ", " ²", "ͅ "]
    texts = ["".join(r.choice(r.choice((said, contexts, lexicon.words()))) + (r.choice(gaps) if r.random() < 0.3 else " ") for _ in range(r.randint(1, 8))) for _ in range(3000)]
    return [t.upper() if i % 29 == 0 else t.title() if i % 31 == 0 else t.strip() if i % 2 else t for i, t in enumerate(texts)]


@pytest.mark.parametrize("mode", normalize.MODES)
def test_the_pass_over_tokens_says_what_the_expression_says_and_sooner(spark, mode):
    import time

    rows = [(t,) for t in [*phrases(), *(a for a, *_ in BOTH + APART), "\u001f  ", "двеси\u001cтриста тысяч", "x" * 100_000 + " пять"]]
    df = spark.createDataFrame(rows, "t string").repartition(4).persist()
    fast, slow = normalize.normalize(F.col("t"), mode), normalize.as_expression(F.col("t"), mode)
    assert df.count() == len(rows) and df.filter(~fast.eqNullSafe(slow)).count() == 0
    took = []
    for c in (fast, slow):
        began = time.time()
        df.crossJoin(spark.range(6)).select(c).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    df.unpersist()
    assert took[0] < took[1]


def test_bytes_that_are_no_text_do_not_end_the_run(spark):
    bad = spark.createDataFrame([(bytearray(b"\xff ") + bytearray("пять".encode()),)], "b binary").select(normalize.normalize(F.col("b").cast("string")).alias("a"))
    assert bad.first()["a"] == "� 5"


def test_words_are_looked_up_whole(spark):
    n = spark.range(0, 1_000_000, 37).select(F.col("id").alias("n"), verbalize.number_to_words(F.col("id")).alias("w"))
    assert n.filter(normalize.as_expression(F.col("w"), "sequence") != F.col("n").cast("string")).count() == 0


def reader(mode: str):
    """The pass over a batch as a plain function, made anew."""
    from cifra.operators import rewriting

    vague = normalize.VAGUE_SEQUENCE if mode == "sequence" else normalize.VAGUE_CURRENT
    return rewriting.rewriter.__wrapped__(mode == "sequence", *map(tuple, (normalize.HUNDRED_VERB, normalize.HUNDRED_NUMBER, normalize.FORTY_BIRD, normalize.THREE_VERB, vague))).func


def test_a_text_is_read_once_in_a_batch(spark):
    import pandas as pd

    class Said(bytes):
        read = 0

        def decode(self, *a):
            Said.read += 1
            return super().decode(*a)

    got = reader("current")(pd.Series([*(Said("сто пять".encode()) for _ in range(500)), None, Said("два".encode())], dtype=object))
    assert got.tolist() == ["105"] * 500 + [None, "2"] and Said.read == 2


def test_long_patterns_are_read_only_where_they_may_match(spark, monkeypatch):
    import re
    from types import SimpleNamespace

    import pandas as pd

    from cifra.operators import rewriting

    lengths = []
    noted = lambda f: lambda p, *a: lengths.append(len(p)) or f(p, *a)
    monkeypatch.setattr(rewriting, "re", SimpleNamespace(compile=noted(re.compile), search=noted(re.search), sub=re.sub, Pattern=re.Pattern))
    read = reader("current")
    said = lambda t: read(pd.Series([t.encode()], dtype=object))[0]
    assert said("двеси сто сорок три рубля") == "200 143 рубля" and max(lengths) < 1000
    assert said("я сто") == "я сто" and max(lengths) > 1000
