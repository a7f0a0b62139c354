"""The closed lexicon of number words, as constant columns that are looked up by hash without a join or shuffle."""

from __future__ import annotations

import functools
import json
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of cardinal numbers. Each line: value, magnitude, forms.
CARDINALS = """
0 0 ноль
1 0 один одна одно одного одной одному одним одном одни одних
2 0 два две двух двум двумя двое
3 0 три трёх трех трем тремя трое
4 0 четыре четырёх четырех четырем четырьмя четверо
5 0 пять пяти пятью пятеро
6 0 шесть шести шестью шестеро
7 0 семь семи семью семеро
8 0 восемь восьми восемью восьмеро
9 0 девять девяти девятью девятеро
10 0 десятеро
10 1 десять десяти десятью
11 1 одиннадцать одиннадцати
12 1 двенадцать двенадцати
13 1 тринадцать тринадцати
14 1 четырнадцать четырнадцати
15 1 пятнадцать пятнадцати
16 1 шестнадцать шестнадцати
17 1 семнадцать семнадцати
18 1 восемнадцать восемнадцати
19 1 девятнадцать девятнадцати
20 2 двадцать двадцати
30 2 тридцать тридцати тридцатью
40 2 сорок сорока
50 2 пятьдесят пятидесяти
60 2 шестьдесят шестидесяти
70 2 семьдесят семидесяти
80 2 восемьдесят восьмидесяти
90 2 девяносто девяноста
100 3 сто ста
200 3 двести двухсот двумстам двумястами двухстах двеси дваста двесте
300 3 триста трёхсот трехсот тремстам тремястами трёхстах
400 3 четыреста четырёхсот четырехсот четыремстам четырьмястами
500 3 пятьсот пятисот
600 3 шестьсот шестисот
700 3 семьсот семисот
800 3 восемьсот восьмисот
900 3 девятьсот девятисот
2500 0 двестипятьсот
1000 4 тысяча тысячи тысяч тысячу тысяче тысячей тысячам тысячами тысячах тыщ тыщи тыща
1000000 5 миллион миллиона миллионов миллионом миллионам миллионами миллионах
1000000000 6 миллиард миллиарда миллиардов миллиардам миллиардами миллиардах
"""
# Forms of ordinal numbers. Each line: value, forms.
ORDINALS = """
1 первый первого первому первым первом первая первой первую первое первые первых первыми
2 второй второго второму вторым втором вторая вторую второе вторые вторых вторыми
3 третий третьего третьему третьим третьем третья третьей третью третье третьи третьих третьими
4 четвертый четвертого четвертому четвертым четвертом четвертая четвертой четвертую четвертое четвертые четвертых
4 четвёртый четвёртого четвёртому четвёртым четвёртом четвёртая четвёртой четвёртую четвёртое четвёртые четвёртых
5 пятый пятого пятому пятым пятом пятая пятой пятую пятое пятые пятых
6 шестой шестого шестому шестым шестом шестая шестую шестое шестые шестых
7 седьмой седьмого седьмому седьмым седьмом седьмая седьмую седьмое седьмые седьмых
8 восьмой восьмого восьмому восьмым восьмом восьмая восьмую восьмое восьмые восьмых
9 девятый девятого девятому девятым девятом девятая девятой девятую девятое девятые девятых
10 десятый десятого десятому десятым десятом
11 одиннадцатый одиннадцатого одиннадцатому одиннадцатым одиннадцатом одиннадцатое
12 двенадцатый двенадцатого двенадцатому двенадцатым двенадцатом двенадцатое
13 тринадцатый тринадцатого тринадцатому тринадцатым тринадцатом тринадцатое
14 четырнадцатый четырнадцатого четырнадцатое
15 пятнадцатый пятнадцатого пятнадцатое
16 шестнадцатый шестнадцатого шестнадцатое
17 семнадцатый семнадцатого семнадцатое
18 восемнадцатый восемнадцатого восемнадцатое
19 девятнадцатый девятнадцатого девятнадцатое
20 двадцатый двадцатого
30 тридцатый тридцатого
40 сороковой сорокового
50 пятидесятый пятидесятого
60 шестидесятый
70 семидесятый
80 восьмидесятый
90 девяностый девяностого
100 сотый сотого
200 двухсотый двухсотая двухсотую
300 трёхсотый
400 четырехсотый
500 пятисотый
600 шестисотый
700 семисотый
800 восьмисотый
900 девятисотый
"""
# Distorted words of speech recognition, by the word meant.
DISTORTED = """
двести двеси дваста
тысяч тыщ тысич тысеч тисяч тищ тыc тыс
тысячи тыщи
пятьдесят петьсят петьдесят писят пядсят пьсят
пятнадцать пядцить пятнадцить питнадцать петнадцать
семнадцать симнадцить семнадцить
шестнадцать шиснатцать шеснатцать
восемнадцать восимнадцить восемнадцить
девяносто дивяносто
девяноста дивяноста
миллион милион
миллиона милиона
миллионов милионов
триста тристи
семьсот семсот
восемьсот восимсот
девятьсот девятсот
двенадцать двенацтать
тринадцать тринацать
четырнадцать четырнацать
восемьдесят восемсат восимдесат восимисят
десять дисять дисят десят
"""
# Roots in the order in which they are tried. Each line: value, magnitude, roots.
ROOTS = """
1000000000 6 миллиард
1000000 5 миллион
1000 4 тысяч тыщ
50 2 пятидесят пятьдесят
60 2 шестидесят шестьдесят
70 2 семидесят семьдесят
80 2 восьмидесят восемьдесят
20 2 двадцат
30 2 тридцат
90 2 девяност
10 1 десят
40 2 сорок
900 3 девятисот девятьсот
800 3 восьмисот восемьсот
700 3 семисот семьсот
600 3 шестисот шестьсот
500 3 пятисот пятьсот
400 3 четырехсот четырёхсот четыреста
300 3 трехсот трёхсот триста
200 3 двухсот двумстам двумястами двухстах двести двеси дваста
100 3 сот ста сто
4 0 четыр
3 0 трое трёх трех трем тремя три
2 0 двое двух двум двумя две два
1 0 один одна одно одного одной одному одним одном одни одних
5 0 пят
6 0 шест
7 0 сем
8 0 восемь восьм восем
9 0 девят
0 0 нол нул
11 1 одиннадцат
12 1 двенадцат
13 1 тринадцат
14 1 четырнадцат
15 1 пятнадцат
16 1 шестнадцат
17 1 семнадцат
18 1 восемнадцат
19 1 девятнадцат
"""
# Endings a root may have, and those of them that make an ordinal.
ENDINGS = ["", *"а у е и ой ых ым ыми ом ам ами ах ей ю я ь ый ий ая ое ые ого его ому ему ую ья ье ьи".split()]
ORDINAL_ENDINGS = set("ый ий ой ая ья ое ье ые ьи ого его ому ему ым ими ыми ом ем ых их ую ю ей".split())

CARDINAL, MULTIPLIER, ORDINAL = 0, 1, 2
KINDS = ("cardinal", "multiplier", "ordinal")
Part = tuple[int, int, int]
#: Slots of the constant hash tables; a power of two well above the number of words keeps slots short.
SLOTS = 4096


def _lines(text: str, numbers: int) -> list[tuple]:
    rows = (line.split() for line in text.strip().splitlines())
    return [(*map(int, r[:numbers]), r[numbers:]) for r in rows]


@functools.cache
def cardinals() -> dict[str, Part]:
    return {w: (v, m, MULTIPLIER if m >= 4 else CARDINAL) for v, m, words in _lines(CARDINALS, 2) for w in words}


@functools.cache
def ordinals() -> dict[str, int]:
    return {w: v for v, words in _lines(ORDINALS, 1) for w in words}


@functools.cache
def distorted() -> dict[str, str]:
    return {w: line.split()[0] for line in DISTORTED.strip().splitlines() for w in line.split()[1:]}


@functools.cache
def root_forms() -> dict[str, tuple[int, int, str]]:
    """Every root with every ending: value, magnitude, ending. The first root that fits a word counts."""
    forms: dict[str, tuple[int, int, str]] = {}
    for value, magnitude, roots in _lines(ROOTS, 2):
        for root in roots:
            for ending in ENDINGS:
                forms.setdefault(root + ending, (value, magnitude, ending))
    return forms


def sequence_class(word: str) -> list[Part]:
    """The class of a lower-case word in the sequence mode: cardinal, ordinal, distorted, by root. Fused words aside."""
    if word in cardinals():
        return [cardinals()[word]]
    if word in ordinals():
        return [(ordinals()[word], 0, ORDINAL)]
    if word in distorted():
        return [cardinals()[distorted()[word]]]
    if word in root_forms():
        value, magnitude, ending = root_forms()[word]
        return [(value, magnitude, ORDINAL if ending in ORDINAL_ENDINGS else MULTIPLIER if magnitude >= 4 else CARDINAL)]
    return []


def current_class(word: str) -> list[Part]:
    """The same in the current mode: ordinals add like units, and a fused two thousand is one number."""
    if word == "дветысячи":
        return [(2000, 0, CARDINAL)]
    return [(v, 0 if k == ORDINAL else m, k) for v, m, k in sequence_class(word)]


def words() -> list[str]:
    """All single words with a class, in a fixed order."""
    return sorted({*cardinals(), *ordinals(), *distorted(), *root_forms(), "дветысячи"})


def _table(rows: list[tuple[str, dict]], schema: str) -> Column:
    """rows hashed into slots, as a constant; from_json of a literal is folded once, at planning."""
    slots: list[list] = [[] for _ in range(SLOTS)]
    for word, row in rows:
        slots[zlib.crc32(word.encode()) % SLOTS].append({"w": word, **row})
    return F.from_json(F.lit(json.dumps({"t": slots}, ensure_ascii=False)), f"t array<array<struct<w:string,{schema}>>>")["t"]


def _find(table: Column, word: Column) -> Column:
    slot = F.get(table, (F.crc32(word.cast("binary")) % SLOTS).cast("int"))
    return F.get(F.filter(slot, lambda e: e["w"] == word), F.lit(0))


PARTS = "array<struct<v:bigint,m:int,k:int>>"


def _parts(parts: list[Part]) -> list[dict]:
    return [{"v": v, "m": m, "k": k} for v, m, k in parts]


def lookup(word: Column) -> Column:
    """struct<w, seq, cur> of a lower-case word, or null; seq and cur are arrays of value v, magnitude m and kind k."""
    return _find(_table([(w, {"seq": _parts(sequence_class(w)), "cur": _parts(current_class(w))}) for w in words()], f"seq:{PARTS},cur:{PARTS}"), word)


def root_lookup(word: Column) -> Column:
    """struct<w, v, m> of a lower-case root form that is no multiplier, or null."""
    return _find(_table([(w, {"v": v, "m": m}) for w, (v, m, _) in root_forms().items() if m <= 3], "v:bigint,m:int"), word)


def fused_pattern() -> str:
    """A multiplier with its ending at the end of a word of which at least two letters come before."""
    roots = "|".join(r for _, m, rs in _lines(ROOTS, 2) if m >= 4 for r in rs)
    return f"^(.{{2,}}?)({roots})({'|'.join(sorted(ENDINGS[1:], key=len, reverse=True))}|)$"


def multiplier_of(root: Column) -> tuple[Column, Column]:
    rows = [(r, v, m) for v, m, rs in _lines(ROOTS, 2) if m >= 4 for r in rs]
    value, magnitude = F.lit(None).cast("bigint"), F.lit(None).cast("int")
    for r, v, m in rows:
        value, magnitude = F.when(root == r, F.lit(v).cast("bigint")).otherwise(value), F.when(root == r, F.lit(m)).otherwise(magnitude)
    return value, magnitude
