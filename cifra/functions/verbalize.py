"""Numbers as Russian words."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of the parts of a number.
ONES = ["", "один", "два", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять"]
FEMININE = ["", "одна", "две", *ONES[3:]]
TEENS = ["десять", "одиннадцать", "двенадцать", "тринадцать", "четырнадцать", "пятнадцать", "шестнадцать", "семнадцать", "восемнадцать", "девятнадцать"]
TENS = ["", "", "двадцать", "тридцать", "сорок", "пятьдесят", "шестьдесят", "семьдесят", "восемьдесят", "девяносто"]
HUNDREDS = ["", "сто", "двести", "триста", "четыреста", "пятьсот", "шестьсот", "семьсот", "восемьсот", "девятьсот"]
FIRST_ORDINALS = ["первый", "второй", "третий", "четвертый", "пятый", "шестой", "седьмой", "восьмой", "девятый", "десятый", "одиннадцатый", "двенадцатый", "тринадцатый", "четырнадцатый", "пятнадцатый", "шестнадцатый", "семнадцатый", "восемнадцатый", "девятнадцатый"]


@functools.cache
def _table(feminine: bool) -> str:
    """The words of 0 (none) to 999, a line each."""
    below = lambda n: [TEENS[n - 10]] if 10 <= n <= 19 else [TENS[n // 10], (FEMININE if feminine else ONES)[n % 10]]
    return "\n".join(" ".join(filter(None, [HUNDREDS[n // 100], *below(n % 100)])) for n in range(1000))


def _below_thousand(n: Column, feminine: bool = False) -> Column:
    """Looked up whole in a constant: word by word the code gets too long to be compiled."""
    return F.when(n > 0, F.get(F.split(F.lit(_table(feminine)), "\n"), n.cast("int")))


def _counted(n: Column, one: str, few: str, many: str) -> Column:
    """The counted noun by the whole count: only 1 to 4 are told from the rest."""
    return F.when(n == 1, one).when(n.between(2, 4), few).when(n > 0, many)


def number_to_words(n: Column, few_millions: bool = True) -> Column:
    """Words of 0 <= n < 10**9, null beyond. few_millions: after 2 to 4 the genitive singular, else always the plural."""
    n = n.cast("long")
    millions, thousands, rest = F.floor(n / 1_000_000), F.floor(n / 1000) % 1000, n % 1000
    words = [_below_thousand(millions), _counted(millions, "миллион", "миллиона" if few_millions else "миллионов", "миллионов"), _below_thousand(thousands, True), _counted(thousands, "тысяча", "тысячи", "тысяч"), _below_thousand(rest)]
    return F.when(n == 0, "ноль").when(n.between(1, 999_999_999), F.concat_ws(" ", *words))


def spoken_words(n: Column) -> Column:
    """The variant that counts thousands in the masculine and leaves a million and more in digits."""
    n = n.cast("long")
    thousands = F.floor(n / 1000)
    words = [_below_thousand(thousands), _counted(thousands, "тысяча", "тысячи", "тысяч"), _below_thousand(n % 1000)]
    return F.when(n == 0, "ноль").when(n.between(1, 999_999), F.concat_ws(" ", *words)).otherwise(n.cast("string"))


def ordinal_words(n: Column) -> Column:
    """Nominative masculine ordinals of 1 to 31, digits of anything else."""
    words = [*FIRST_ORDINALS, "двадцатый", *[f"двадцать {w}" for w in FIRST_ORDINALS[:9]], "тридцатый", "тридцать первый"]
    return F.coalesce(F.when(n.between(1, 31), F.get(F.array(*map(F.lit, words)), (n - 1).cast("int"))), n.cast("string"))
