"""Both normalizers as one pass over a text's tokens: what normalize.as_expression says, at some ten microseconds a text.
Its lambdas are interpreted token by token, at many times that."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cifra.functions import lexicon, text

#: White space of a pattern under (?U). Tokens are cut at the four ASCII separators too, which is what split() does.
S = "[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


@functools.cache
def word_class() -> str:
    """The characters of a word, at whose end \\b is under (?U): letters, marks, digits, connectors, joiners, and letters in
    circles and boxes. Python's \\b has no marks."""
    more = {0x200C, 0x200D, *range(0x24B6, 0x24EA), *range(0x1F130, 0x1F14A), *range(0x1F150, 0x1F16A), *range(0x1F170, 0x1F18A)}
    ranges: list[list[int]] = []
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))
        if kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or i in more:
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]"


@functools.cache
def table() -> dict[str, tuple[tuple, tuple]]:
    """The lexicon: the parts of each word in the sequence and the current mode."""
    return {w: (tuple(lexicon.sequence_class(w)), tuple(lexicon.current_class(w))) for w in lexicon.words()}


@functools.cache
def rewriter(sequence: bool, hundred_verb: tuple, hundred_number: tuple, forty_bird: tuple, three_verb: tuple, vague_before: tuple):
    """The normalizer as a function of a batch of texts. All of it is local, so that it is sent along with the plan."""
    words = {w: p[0 if sequence else 1] for w, p in table().items()}
    roots = {w: (v, m) for w, (v, m, _) in lexicon.root_forms().items() if m <= 3}
    multipliers = {r: (v, m, lexicon.MULTIPLIER) for v, m, rs in lexicon._lines(lexicon.ROOTS, 2) if m >= 4 for r in rs}
    fused, multiplier, cardinal = re.compile(lexicon.fused_pattern()), lexicon.MULTIPLIER, lexicon.CARDINAL
    shifts, mended_words = text.shifts(), list(text.MENDED.items())
    verb, number, bird, other_three = map("|".join, (hundred_verb, hundred_number, forty_bird, three_verb))
    before, letter, space, most = frozenset(vague_before), word_class(), S, 50_000
    ready: dict[str, re.Pattern] = {}

    def compiled(source: str) -> re.Pattern:
        """A pattern as it reads under (?U) there. Its \\b all stand beside letters; one before a word is looked for after it,
        so that the search is for the word, and a plain space is no letter without asking the long class. It is compiled
        when a text first needs it, as the class takes seconds, and held, as re compares all of so long a pattern."""
        if source not in ready:
            p = re.sub(r"\\b(\w+)", lambda m: f"{m[1]}(?:(?<= {m[1]})|(?<!{letter}{m[1]}))", source)
            p = re.sub(r"\\b(?=\()", lambda _: f"(?:(?<= )|(?<!{letter}))", p)
            ready[source] = re.compile(p.replace("\\b", f"(?:(?= )|(?!{letter}))").replace("\\s", space))
        return ready[source]

    # What matches without its \b may match with them.
    loose = {p: re.compile(p.replace("\\b", "").replace("\\s", space)) for p in (*(said for said, _ in shifts), verb, number, bird, other_three)}

    def fits(source: str, c: str) -> bool:
        return loose[source].search(c) is not None and compiled(source).search(c) is not None

    def parts(raw: str) -> tuple:
        """The parts of a token as (value, magnitude, kind), by the token alone."""
        if not sequence and raw == "дветысячи":
            return (2, 0, cardinal), (1000, 4, multiplier)
        low = raw.lower()
        found = words.get(low, ())
        if not found and ("тысяч" in low or "тыщ" in low or "миллион" in low or "миллиард" in low) and (m := fused.search(low)) and (root := roots.get(m[1])):
            # The current mode keeps only the first half of a fused word.
            found = ((*root, cardinal), multipliers[m[2]]) if sequence else ((*root, cardinal),)
        return found

    def may_be_vague(raw: str) -> bool:
        return (raw.lower() if sequence else raw) in ("тыщ", "тыща")

    def vague(tokens: list, i: int) -> bool:
        """Whether a thousand at place i is said of no number."""
        one, two, three = (tokens[i - k] if i >= k else None for k in (1, 2, 3))
        if one in before or one == "то" and (two == "где" or two == "чем" and three == "с"):
            return True
        return two == "с" and one == "половиной" if sequence else one == "половиной" or one == "с" and two == "половиной"

    class Seen(dict):
        """The part of a token met before; None for another word, () where there are more or the words before it count."""

        def __missing__(self, raw: str):
            found = parts(raw)
            one = None if not found else found[0] if len(found) == 1 and not may_be_vague(raw) else ()
            if len(raw) <= 64:
                if len(self) >= most:
                    self.clear()
                self[raw] = one
            return one

    seen = Seen()

    def mended(c: str) -> str:
        if "двеси" in c:
            for p, by in shifts:
                c = compiled(p).sub(by, c) if loose[p].search(c) else c
        for w, by in mended_words:
            if w in c:
                c = compiled(f"\\b{w}\\b").sub(by, c)
        return c

    def doubtful(c: str) -> list:
        held = ["сто"] if "сто" in c and fits(verb, c) and not fits(number, c) else []
        if "сорок" in c and fits(bird, c):
            held.append("сорок")
        if "три" in c and fits(other_three, c):
            held.append("три")
        return held

    def normalized(c: str) -> str:
        c = mended(c)
        tokens = c.split()
        if not tokens:
            return c
        found = [seen[t] for t in tokens]
        if () in found:
            items = [(raw, p) for i, raw in enumerate(tokens) for p in (not (may_be_vague(raw) and vague(tokens, i)) and parts(raw) or (None,))]
            tokens, found = [raw for raw, _ in items], [p for _, p in items]
        held = () if sequence else doubtful(c)
        out, opened, compound, now, last, last_mult = [], False, 0, 0, -1, -1
        for i, p in enumerate(found):
            if p is None or held and not opened and tokens[i].lower() in held:
                if opened:
                    out.append(str(compound + now))
                    opened, compound, now, last, last_mult = False, 0, 0, -1, -1
                out.append(tokens[i])
                continue
            v, m, k = p
            opened = True
            if k == multiplier:
                product = now * v if now > 0 else v
                if m == last_mult:
                    out.append(str(compound))
                    compound = product
                else:
                    compound += product
                now, last, last_mult = 0, -1, m
                continue
            if last != -1:
                ahead = found[i + 1] if m <= 1 and i + 1 < len(found) else None
                if m < last and not (ahead and (ahead[2] == cardinal and ahead[1] <= 1 if sequence else ahead[1] == m)):
                    now, last = now + v, m
                    continue
                out.append(str(compound + now))
                compound, last_mult = 0, -1
            now, last = v, m
        if opened:
            out.append(str(compound + now))
        return " ".join(out)

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        # Texts come again, short ones above all; each of a batch is read once.
        answers = {c: None if c is None else normalized(c.decode("utf-8", "replace")) for c in set(texts)}
        return pd.Series([answers[c] for c in texts], dtype=object)

    return rewrite


def rewritten_text(c: Column, sequence: bool, *patterns: tuple) -> Column:
    return rewriter(sequence, *patterns)(c.cast("binary"))
