"""Classification of tokens and the two normalizers: no join, no shuffle, so streams can use them too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cifra.functions import lexicon, text
from cifra.operators.fold import rewritten
from cifra.operators.rewriting import rewritten_text

MODES = ("current", "sequence")
# Words before a vague thousand.
VAGUE_CURRENT = ("выше", "ниже", "около")
VAGUE_SEQUENCE = (*VAGUE_CURRENT, "почти")
# Contexts in which a hundred, a forty and a three are other words, and in which a hundred surely is none.
HUNDRED_NUMBER = ["\\bсто\\s+(рубл|доллар|евро|тысяч|миллион|процент|раз|человек|штук)", "\\b(до|около|более|менее|свыше|почти)\\s+сто\\b"]
HUNDRED_VERB = ["\\bя\\s+сто\\b", "\\bсто\\s+(на|в|у|за|перед)\\b", "\\bсто\\s+и\\s+"]
FORTY_BIRD = ["\\bсорок\\s+(летит|птиц|синиц|вороб)"]
THREE_VERB = ["\\bтри\\s+(ся|те)\\b"]


def _any(c: Column, patterns: list[str]) -> Column:
    return F.regexp_like(c, F.lit("(?U)" + "|".join(patterns)))


def doubtful(c: Column) -> Column:
    """array<string>: number words that a whole text uses otherwise."""
    has = lambda word: F.contains(c, F.lit(word))  # noqa: E731  spares most texts the patterns
    words = [F.when(has("сто") & _any(c, HUNDRED_VERB) & ~_any(c, HUNDRED_NUMBER), F.lit("сто")), F.when(has("сорок") & _any(c, FORTY_BIRD), F.lit("сорок")), F.when(has("три") & _any(c, THREE_VERB), F.lit("три"))]
    return F.filter(F.array(*words), lambda w: w.isNotNull())


def is_vague(tokens: Column, i: Column, sequence: bool) -> Column:
    """Whether a thousand at place i is said of no number: after a marker word or one of a few phrases."""
    back = lambda k: F.get(tokens, F.when(i >= k, i - k).otherwise(-1))
    word = F.lower(back(0)) if sequence else back(0)
    before = back(1).isin(*(VAGUE_SEQUENCE if sequence else VAGUE_CURRENT))
    phrase = ((back(3) == "с") & (back(2) == "чем") & (back(1) == "то")) | ((back(2) == "где") & (back(1) == "то"))
    half = (back(2) == "с") & (back(1) == "половиной") if sequence else (back(1) == "половиной") | ((back(1) == "с") & (back(2) == "половиной"))
    return word.isin("тыщ", "тыща") & F.coalesce(before, F.lit(False)) | word.isin("тыщ", "тыща") & F.coalesce(phrase | half, F.coalesce(phrase, half), F.lit(False))


def classified(tokens: Column, sequence: bool) -> Column:
    """array<struct<raw, parts>>: each token with the parts of a number it stands for; empty for other words."""
    return text.let(tokens, lambda t: _classified(t, sequence))


def _classified(tokens: Column, sequence: bool) -> Column:
    none = F.array().cast(lexicon.PARTS)
    known = F.transform(tokens, lambda t, i: F.struct(t.alias("raw"), lexicon.lookup(F.lower(t)).alias("e"), is_vague(tokens, i, sequence).alias("vague"), F.lower(t).alias("low")))

    def fused(low: Column) -> Column:
        pattern = lexicon.fused_pattern()
        first = F.array(lexicon.root_lookup(F.regexp_extract(low, pattern, 1)))
        value, magnitude = lexicon.multiplier_of(F.regexp_extract(low, pattern, 2))
        head = F.transform(first, lambda p: F.struct(p["v"].alias("v"), p["m"].alias("m"), F.lit(lexicon.CARDINAL).alias("k")).cast("struct<v:bigint,m:int,k:int>"))
        tail = F.array(F.struct(value.alias("v"), magnitude.alias("m"), F.lit(lexicon.MULTIPLIER).alias("k")).cast("struct<v:bigint,m:int,k:int>"))
        found = F.filter(head, lambda p: p["v"].isNotNull())
        # The current mode keeps only the first half of a fused word.
        return F.when(F.size(found) > 0, F.concat(found, tail) if sequence else found).otherwise(none)

    def parts(x: Column) -> Column:
        own = F.coalesce(x["e"]["seq" if sequence else "cur"], none)
        if not sequence:
            two, thousand = (F.struct(F.lit(v).cast("bigint").alias("v"), F.lit(m).alias("m"), F.lit(k).alias("k")) for v, m, k in ((2, 0, 0), (1000, 4, 1)))
            own = F.when(x["raw"] == "дветысячи", F.array(two, thousand).cast(lexicon.PARTS)).otherwise(own)
        found = F.when(F.size(own) > 0, own).when(F.regexp_like(x["low"], F.lit("миллиард|миллион|тысяч|тыщ")), fused(x["low"])).otherwise(none)
        return F.when(x["vague"], none).otherwise(found)

    return F.transform(known, lambda x: F.struct(x["raw"].alias("raw"), parts(x).alias("parts")))


def normalize(c: Column, mode: str = "current") -> Column:
    """The text with spoken numbers as digits; null and blank texts stay as they are. A Python function over batches."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    sequence = mode == "sequence"
    return rewritten_text(c, sequence, *map(tuple, (HUNDRED_VERB, HUNDRED_NUMBER, FORTY_BIRD, THREE_VERB, VAGUE_SEQUENCE if sequence else VAGUE_CURRENT)))


def as_expression(c: Column, mode: str = "current") -> Column:
    """The same without Python, for use within lambdas; far slower for each text."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    sequence = mode == "sequence"
    word_type = "struct<raw:string,v:bigint,m:int,k:int,num:boolean,held:boolean>"

    def items(x: Column, held: Column) -> Column:
        null = F.lit(None)
        word = F.array(F.struct(x["raw"].alias("raw"), null.alias("v"), null.alias("m"), null.alias("k"), F.lit(False).alias("num"), F.lit(False).alias("held")).cast(word_type))
        kept = F.array_contains(held, F.lower(x["raw"]))
        numbers = F.transform(x["parts"], lambda p: F.struct(x["raw"].alias("raw"), p["v"].alias("v"), p["m"].alias("m"), p["k"].alias("k"), F.lit(True).alias("num"), kept.alias("held")).cast(word_type))
        return F.when(F.size(x["parts"]) > 0, numbers).otherwise(word)

    def answer(mended: Column) -> Column:
        held = F.array().cast("array<string>") if sequence else doubtful(mended)
        flat = text.let(held, lambda h: F.flatten(F.transform(classified(text.tokens(mended), sequence), lambda x: items(x, h))))
        return F.array_join(rewritten(flat, sequence), " ")

    return F.when(text.blank(c), c).otherwise(text.let(text.mended(c), answer))


# What lowers the confidence in a result.
ORDINAL_ROOTS = "перв втор трет четверт пят шест седьм восьм девят десят одиннадцат двенадцат тринадцат четырнадцат пятнадцат шестнадцат семнадцат восемнадцат девятнадцат двадцат тридцат".split()
ORDINAL_TAILS = "ый ий ой ая ое ые".split()
NUMBER_HEADS = "две три четыре пять шест сем восем девят десят".split()
PLAIN_WORDS = (
    "какой такой другой любой каждой самой самый самое новая новый простой главный большой хороший плохой маленький маленькая высокий низкий нужный последний ближайший разный целый полный "
    "важный точный активный интересный обычный подобный отдельный значительный собственный человеческий прежний дополнительный практический технический экономический политический исторический "
    "физический юридический медицинский социальный культурный научный международный современный второй"
).split()


def confidence(c: Column, predicted: Column) -> Column:
    """0.1 to 1: what is left of 1 after the signs that a result may be wrong."""
    return text.let(F.struct(text.tokens(F.lower(c)).alias("said"), text.tokens(F.lower(predicted)).alias("got"), text.digit_runs(predicted).alias("numbers")), _confidence)


def _confidence(x: Column) -> Column:
    said, got = x["said"], x["got"]
    numbers = F.transform(x["numbers"], lambda n: n.cast("decimal(38,0)"))
    jump = text.let(numbers, lambda all_of: F.exists(F.transform(all_of, lambda n, i: (n <= 300) & (F.get(all_of, i + 1) >= 1000)), lambda y: F.coalesce(y, F.lit(False))))
    stripped = F.transform(got, lambda w: F.translate(F.regexp_replace(w, '^[.,!?;:()\\[\\]{}«»"]+|[.,!?;:()\\[\\]{}«»"]+$', ""), "ё", "е"))
    ordinal = F.size(F.filter(stripped, lambda w: ~w.isin(*PLAIN_WORDS) & F.regexp_like(w, F.lit(f"({'|'.join(ORDINAL_TAILS)})$")) & F.regexp_like(w, F.lit("|".join(ORDINAL_ROOTS)))))
    headed = "|".join(f"{h}.{{4,}}" for h in NUMBER_HEADS)
    fused = F.size(F.filter(said, lambda w: F.contains(w, F.lit("тысяч")) & F.regexp_like(w, F.lit(f"^(?:{headed})"))))
    pair = F.exists(F.transform(said, lambda w, i: (w == "два") & (F.get(said, i + 1) == "два")), lambda y: F.coalesce(y, F.lit(False)))
    flag = lambda y: F.when(y, 3).otherwise(0)
    tenths = 10 - F.when(F.arrays_overlap(said, F.array(F.lit("тыщ"), F.lit("тыща"))), 4).otherwise(0) - flag(F.array_contains(said, "двеси") & jump) - 3 * ordinal - flag(F.arrays_overlap(got, F.array(F.lit("тысячам"), F.lit("тысячами")))) - 3 * fused - flag(pair)
    return F.round(F.greatest(F.lit(1), F.least(F.lit(10), tenths)) / 10, 1)


def hybrid(c: Column, fallback: Column | None = None, least: float = 0.75) -> Column:
    """The current mode's result, or, where confidence in it is below `least`, a given fallback that differs from the text."""
    if fallback is None:
        return normalize(c, "current")
    return text.let(normalize(c, "current"), lambda rule: F.when((confidence(c, rule) < least) & fallback.isNotNull() & (fallback != c), fallback).otherwise(rule))


def normalizer(parser_type: str = "current", use_hybrid: bool = False, fallback: Column | None = None):
    """The column function that a command line asks for; sequence wins over hybrid."""
    if parser_type == "sequence":
        return lambda c: normalize(c, "sequence")
    return (lambda c: hybrid(c, fallback)) if use_hybrid else normalize


def with_answer(df: DataFrame, mode: str = "current", column: str = "task_text") -> DataFrame:
    """df with the normalized text in `answer`, every other column as it is."""
    return df.withColumn("answer", normalize(F.col(column), mode))
