"""Quality rules, line first: lines that fail a rule go, then documents that lose too much of their text go.

A line with words fails when it is
* symbols: a word in five or more ends in, or is, one of the symbols #*$%&|<> or has two exclamation marks after it;
* navigation: three or more short parts between bars or arrows, a line that is a known navigation phrase, or one of
  three or more unfinished lines of few words in a row, as menus are;
* punctuation: a line as long as a sentence that neither ends like one, in a mark or a closing quote or bracket, nor
  holds the end of one;
* boilerplate: a known phrase of licences, cookie notices and sign-up prompts, in a short line;
* repeated: a sequence of `run` words of it occurs more than once in the line and covers over half of it;
* copied: an earlier line of the document has the same words, and the line is long enough to matter.
A short line without a full stop that stands alone may be a heading and stays. The phrases are those of four languages
(en, fr, de, es), the other rules know no language. A document is kept if the lines left hold at least `least_left` of
its words' bytes, unless a base rule fails (see measures()).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cifra.llm.common import short_batches

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
# Phrases of navigation and boilerplate, lower-cased, in en, fr, de, es.
NAVIGATION = frozenset(
    phrase.encode()
    for phrase in (
        "home", "menu", "search", "login", "log in", "signin", "sign in", "signup", "sign up", "next", "previous", "back to top", "skip to content", "read more", "share", "print", "related articles",
        "accueil", "recherche", "rechercher", "connexion", "se connecter", "suivant", "précédent", "haut de page", "lire la suite", "partager", "imprimer", "articles liés",
        "startseite", "menü", "suche", "anmelden", "registrieren", "weiter", "zurück", "nach oben", "zum inhalt", "weiterlesen", "teilen", "drucken", "ähnliche artikel",
        "inicio", "menú", "buscar", "iniciar sesión", "registrarse", "siguiente", "anterior", "volver arriba", "ir al contenido", "leer más", "compartir", "imprimir", "artículos relacionados",
    )
)
BOILERPLATE = tuple(
    phrase.encode()
    for phrase in (
        "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "subscribe to our newsletter", "javascript is disabled", "javascript is required", "accept cookies", "accept all cookies", "this site uses cookies",
        "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "abonnez-vous à notre", "accepter les cookies", "ce site utilise des cookies",
        "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "abonnieren sie unseren", "cookies akzeptieren", "diese website verwendet cookies",
        "todos los derechos reservados", "política de privacidad", "aviso legal", "términos de uso", "suscríbete a nuestro", "aceptar cookies", "este sitio utiliza cookies",
    )
)
#: What a sentence ends in, and a finished line: such a mark, or a closing quote or bracket.
MARKS = tuple(mark.encode() for mark in (".", "!", "?", "…", "。", "！", "？"))
ENDS = (*MARKS, *(mark.encode() for mark in (":", ";", '"', "'", "”", "’", "»", "“", ")", "]")))
NOISY = re.compile(rb"[#*$%&|<>!]")
NOISY_WORD = re.compile(rb"(?:[#*$%&|<>]|!!)(?![^\x20\x09-\x0D])")
SEPARATORS = tuple(c.encode() for c in "|>»›•·")
BARS = re.compile(r"\s(?:[|>]|»|›|•|·)\s".encode())


@dataclass(frozen=True)
class Rules:
    """The limits of the rules. Shares are of words of a line, or of word characters of a document."""

    noisy_share: float = 0.2
    least_parts: int = 3
    menu_words: int = 3
    sentence_words: int = 8
    boilerplate_words: int = 25
    run: int = 4
    repeated_share: float = 0.5
    copied_words: int = 4
    least_left: float = 0.5
    least_words: int = 20
    repeat_percent: int = 30


def word_numbers(words: list[bytes]) -> np.ndarray:
    """64 bits for each word, equal for equal words of one process."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view("<u8")


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def in_repeats(numbers: np.ndarray, size: int) -> int:
    """How many words lie in a sequence of `size` words that occurs twice or more, each occurrence counted."""
    n = len(numbers) - size + 1
    if n < 2:
        return 0
    h, have = mixed(numbers.copy()), 1
    while have < size:  # from hashes of `have` words to those of twice as many, or of `size`
        step = min(have, size - have)
        h = mixed(h[:-step] * np.uint64(0xD6E8FEB86659FD93) + h[step:])
        have += step
    s = np.sort(h)
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    again = np.unique(s[1:][same])
    twice = again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h
    ends = np.cumsum(np.r_[twice, np.zeros(size - 1, bool)].astype(np.int64))
    return int((ends > np.r_[np.zeros(size, np.int64), ends[:-size]]).sum())


def in_any(line: bytes, phrases: tuple[bytes, ...]) -> bool:
    return any(phrase in line for phrase in phrases)


def fails(words: list[bytes], line: bytes, rules: Rules) -> str | None:
    """The first rule a line with words fails on its own."""
    n = len(words)
    if NOISY.search(line) and len(NOISY_WORD.findall(line)) >= max(1, rules.noisy_share * n):
        return "symbols"
    if n <= 3 and lowered(b" ".join(words)).rstrip(b" .!>") in NAVIGATION or n < 8 * rules.least_parts and in_any(line, SEPARATORS) and len(BARS.split(line)) >= rules.least_parts:
        return "navigation"
    if n >= rules.sentence_words and not words[-1].endswith(ENDS) and not any(w.endswith(MARKS) for w in words):
        return "punctuation"
    if 2 <= n <= rules.boilerplate_words and in_any(lowered(line), BOILERPLATE):
        return "boilerplate"
    # Words in repeats occur twice, so a line of which over a share is in repeats has fewer different words.
    if n >= 2 * rules.run and len(set(words)) <= (1 - rules.repeated_share / 2) * n and in_repeats(word_numbers(words), rules.run) > rules.repeated_share * n:
        return "repeated"
    return None


def lowered(line: bytes) -> bytes:
    return line.lower() if line.isascii() else line.decode("utf-8", "replace").lower().encode()


def in_menus(lines: list[list[bytes]], rules: Rules) -> set[int]:
    """Places of lines (their words) that stand in a run of unfinished lines of few words; lines without words between
    them don't count."""
    out, run = set(), []
    for i, words in enumerate([*lines, [b"."]]):
        if words and len(words) <= rules.menu_words and not words[-1].endswith(ENDS):
            run.append(i)
        elif words:
            if len(run) >= rules.least_parts:
                out.update(run)
            run = []
    return out


def cleaned(data: bytes, rules: Rules) -> tuple[bytes, int, int]:
    """The text without failing lines, its word bytes before and after."""
    kept, before, after, seen = [], 0, 0, set()
    lines = data.split(b"\n")
    split = [line.split() for line in lines]
    menus = in_menus(split, rules)
    for i, (line, words) in enumerate(zip(lines, split, strict=True)):
        key = b" ".join(words)
        size = len(key) - len(words) + 1 if words else 0
        before += size
        if words:
            if i in menus or len(words) >= rules.copied_words and key in seen or fails(words, line, rules):
                continue
            seen.add(key)
        kept.append(line)
        after += size
    return b"\n".join(kept), before, after


def measures(data: bytes | None, rules: Rules = Rules()) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text."""
    data = data or b""
    words = data.split()
    n, seen, copied = len(words), set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            copied += 1
        elif line.strip():
            seen.add(line)
    repeats = in_repeats(word_numbers(words), WINDOW)
    failed = n < rules.least_words or 100 * repeats > rules.repeat_percent * n
    clean, before, after = cleaned(data, rules)
    return n, len(b"".join(words).decode()), sum(map(data.count, SYMBOLS)), copied, repeats, failed, not failed and after >= rules.least_left * before, clean.decode()


FIELDS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "clean_text": pa.string()}
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, clean_text string"


def judged(docs: DataFrame, rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """docs (doc_id and any other columns, carried along) with the measures, the verdict and, on demand, the text that
    is left after the failing lines went.

    Needs a text column; columns of docs named like a result column are replaced. A null text has no words and is
    rejected like an empty one. Each row is judged on its own: repeated rows and null ids don't matter, and an empty
    table gives an empty result.
    """
    short_batches(docs.sparkSession)
    names = [n for n in FIELDS if with_text or n != "clean_text"]
    carried = [c for c in docs.columns if c not in FIELDS]
    at = carried.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(measures(t, rules) for t in b.column(at).cast(pa.binary()).to_pylist()), strict=True)) or [()] * len(FIELDS)
            made = [pa.array(v, FIELDS[n]) for n, v in zip(FIELDS, rows, strict=True) if n in names]
            own = [c for i, c in enumerate(b.columns) if with_text or i != at]
            yield pa.RecordBatch.from_arrays([*own, *made], names=[*(c for c in carried if with_text or c != "text"), *names])

    slim = docs.select(*carried)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if with_text or f.name != "text"]
    return slim.mapInArrow(each, ", ".join([*fields, *[p for p in SCHEMA.split(", ") if p.split()[0] in names]]))


def stage(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents kept, with their cleaned text and its length in n_chars, and the columns of docs.

    Each row is judged on its own, as in judged(): rows that repeat an id or have none stay or go by their own text, a
    null or empty text goes, and an empty table gives an empty result.
    """
    out = judged(docs, rules).filter("kept").withColumn("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)
