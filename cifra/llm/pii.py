"""Personal data by candidate gradient boosting.

Base patterns (emails, IP addresses, payment cards, phone numbers; see base_spans) are always reported. Besides them
generators of high recall propose overlapping spans that the patterns miss or reject as a whole: cards inside longer
runs of digit groups, phone numbers without a plus sign, IPv6 addresses, addresses spelled with (at) and (dot). Boosted
trees judge each candidate by its format and context, calibrated probabilities are compared with a threshold chosen on
examples kept apart from the training, and of overlapping candidates the likeliest stays.

The trees are trained here, on `EXAMPLES` invented sentences with known spans and look-alikes (order numbers, dates,
versions, hashes). They take no data of the corpus, so training costs the same at every size.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cifra.llm.calibration import isotonic
from cifra.llm.common import short_batches

KINDS = ("email", "ip", "card", "phone")
EXAMPLES = 6000
SEED = 17
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
PRECISION = 0.99
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match never starts inside a run of digits, as the run's start would have matched; so such starts aren't tried.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@:]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def byte_part(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the base patterns, leftmost and not overlapping per kind, by kind and start."""
    out, end = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            end = m.end()
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(byte_part, m.group().split(".")))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]


#: Groups of digits with the separators that phone and card numbers are written with.
GROUPS = re.compile(r"\(?[0-9]+\)?(?:(?: ?[.\-/–] ?| {1,2})\(?[0-9]+\)?|\([0-9]+\)|(?<=\))[0-9]+)*")
GROUP = re.compile(r"[0-9]+")
COLONS = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}(?![0-9A-Za-z:])")
OPEN, CLOSE, NAME = r"\s?[\[({]\s?", r"\s?[\])}]\s?", r"[A-Za-z0-9-]++"
SPELLED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:{OPEN}(?:at|AT|@){CLOSE}{NAME}(?:(?:{OPEN}(?:dot|DOT|\.){CLOSE}|\s(?:dot|DOT)\s|\.){NAME})+|\s(?:at|AT)\s{NAME}(?:(?:{OPEN}(?:dot|DOT){CLOSE}|\s(?:dot|DOT)\s){NAME})+)"
)
#: Every match of SPELLED holds one of these: a bracketed at, or after a plain one a dot word with a bracket or space behind.
AT_MARK = re.compile(rf"[\[({{]\s?(?:at|AT|@)\s?[\])}}]")
DOT_MARK = re.compile(r"(?:dot|DOT)[\])}\s]")


def marked(text: str) -> bool:
    """Whether SPELLED may match at all; never false where it does."""
    return AT_MARK.search(text) is not None or DOT_MARK.search(text) is not None


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal data: more than are, overlapping, at most 40 for each group of digits."""
    out = []
    if re.search(r"[0-9]", text):
        for m in GROUPS.finditer(text):
            groups = [(g.start() + m.start(), g.end() + m.start()) for g in GROUP.finditer(m.group())]
            sizes = [b - a for a, b in groups]
            for i, (a, _) in enumerate(groups):
                total = 0
                for j in range(i, len(groups)):
                    total += sizes[j]
                    if total > 19:
                        break
                    if 13 <= total:
                        out.append(("card", a, groups[j][1]))
                    if 8 <= total <= 15:
                        start = a - 1 if a and text[a - 1] == "(" else a
                        out.append(("phone", start, groups[j][1]))
    if ":" in text:
        out += [("ip", *m.span()) for m in COLONS.finditer(text) if "::" in m.group() or m.group().count(":") == 7]
    if marked(text):
        out += [("email", *m.span()) for m in SPELLED.finditer(text)]
    return out


HINTS = {
    "email": re.compile(r"(?i)\b(e-?mail|mail|contact|write|reach|courriel|écrivez|schreiben|kontakt|correo|escriba)\b"),
    "ip": re.compile(r"(?i)\b(ip|ipv6|host|server|address|ping|client)\b"),
    "card": re.compile(r"(?i)\b(card|visa|credit|debit|payment|pay|mastercard|carte|karte|kreditkarte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(phone|tel|call|mobile|cell|fax|ring|dial|téléphone|appelez|portable|telefon|handy|rufen|teléfono|móvil|llame)\b"),
}
OTHER = re.compile(r"(?i)\b(order|invoice|version|isbn|id|no|ticket|article|serial|token|hash|page|date|item|ref)\b")
FEATURES = 22


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of a candidate."""
    span, before, after = text[a:b], text[max(0, a - 24) : a], text[b : b + 24]
    digits = digits_of(span)
    groups = [len(g) for g in GROUP.findall(span)] or [0]
    others = [c for c in span if not c.isalnum()]
    edge = lambda c: 0.0 if not c else 1.0 if c.isalnum() else 2.0 if c.isspace() else 3.0 if c in ".,;:!?\"')" else 4.0
    return [
        *(float(kind == k) for k in KINDS), len(span), len(digits), len(digits) / len(span), len(others), len(set(others)), len(groups), max(groups), min(groups),
        float(bool(digits) and luhn(digits)), float("(" in span), float(digits[:1] == "0"), edge(before[-1:]), edge(after[:1]),
        float(HINTS[kind].search(before) is not None), float(OTHER.search(before) is not None), len(digits_of(before[-6:] + after[:6])),
        float(re.search(r"[\[({]\s?(at|AT|dot|DOT)\s?[\])}]", span) is not None), float("::" in span) + float(sum(c in "abcdefABCDEF" for c in span) > 1) + span.count(":"),
    ]


def invented(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence and its true spans."""
    some = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeioutrnsldkm") for _ in range(rng.randint(2, 8)))

    def card() -> str:
        body = rng.choice("3456") + some(14)
        whole = next(body + d for d in "0123456789" if luhn(body + d))
        return rng.choice([whole, " ".join(whole[i : i + 4] for i in range(0, 16, 4)), "-".join(whole[i : i + 4] for i in range(0, 16, 4))])

    def phone() -> str:
        a, b, c = some(3), some(3), some(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{some(2)} {a} {b} {c}", f"0{a} {b}{c}", f"{a} {b} {c}", f"{a} {b} {some(3)}", "0" + some(1) + "".join(f" {some(2)}" for _ in range(4)), f"0{a} / {b}{c}", f"0{a}/{b}{c}", f"{a} - {b} - {c}", a + b + c, some(rng.randint(8, 15))])

    def spelled() -> str:
        at, dot = rng.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", "."), (" at ", " dot "), (" at ", " (dot) "), (" at ", "[dot]"), ("\n(at)\n", "\n(dot)\n"), ("\tat\t", "\tdot\t")])
        return f"{word()}.{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de'])}"

    colons = lambda: rng.choice([":".join(f"{rng.getrandbits(16):x}" for _ in range(8)), f"2001:db8::{rng.getrandbits(16):x}:{rng.getrandbits(12):x}", f"dead:beef::{rng.choice(['cafe', 'feed', 'babe'])}", f"fe80::{rng.getrandbits(16):x}:{rng.getrandbits(16):x}"])
    true = {"card": card, "phone": phone, "email": spelled, "ip": colons}
    hint = {"card": ["card", "visa", "payment by card", "pay with"], "phone": ["call", "tel", "phone:", "mobile", "fax", "téléphone", "appelez le", "telefon", "teléfono", "llame al"], "email": ["mail", "contact", "write to", "email:"], "ip": ["host", "from ip", "server", "address"]}
    fakes = [
        lambda: f"order {some(rng.randint(8, 16))}", lambda: f"version {some(1)}.{some(1)}.{some(2)}", lambda: f"{some(4)}-{rng.randint(10, 12)}-{some(2)}", lambda: f"isbn {some(3)}-{some(1)}-{some(5)}-{some(3)}-{some(1)}",
        lambda: f"{rng.randint(0, 23):02}:{some(2)}:{some(2)}", lambda: f"{some(3)} {some(3)} {some(3)}", lambda: f"{some(13)}", lambda: f"{some(16)}", lambda: f"{some(2)}.{some(2)}.{some(4)}", lambda: f"{some(1)}.{some(8)}",
        lambda: f"look at {word()}. {word()}", lambda: f"{word()} at {word()}.{word()}", lambda: f"token {hashlib.md5(word().encode()).hexdigest()}", lambda: f"ticket {some(3)}-{some(4)}-{some(4)}", lambda: " ".join(some(rng.randint(1, 3)) for _ in range(6)),
        lambda: f"{word()} at the {word()} . {word()}", lambda: f"{some(3)}/{some(4)}/{some(4)}", lambda: f"{rng.randint(1, 9)}:{some(1)}:{some(1)}", lambda: f"page {some(4)}-{some(4)}", lambda: "::" + word()[:3], lambda: some(rng.randint(8, 15)), lambda: f"{word()} id {some(rng.randint(8, 15))}",
    ]
    parts, spans = [word()], []
    for _ in range(rng.randint(1, 3)):
        if rng.random() < 0.5:
            kind = rng.choice(KINDS)
            value = true[kind]()
            if rng.random() < 0.6 or kind == "phone" and value.isdigit():  # a bare run of digits is a number only by its hint
                parts.append(rng.choice(hint[kind]))
            at = len(" ".join(parts)) + 1
            parts.append(value)
            spans.append((kind, at, at + len(parts[-1])))
            if kind == "card" and rng.random() < 0.3:  # next to another run of digits, which the base pattern rejects
                at = len(" ".join(parts)) + 1
                parts.append(card())
                spans.append((kind, at, at + len(parts[-1])))
        else:
            parts.append(rng.choice(fakes)())
        parts += [word() + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(1, 4))]
    return " ".join(parts), spans


class Trees:
    """Gradient boosting for the logistic loss: trees of fixed depth over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, bins: int):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        codes = self._codes(x)
        self.depth, self.nodes = depth, []
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(len(y), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p) + 1e-9
            node, splits = np.zeros(len(y), int), []
            for _ in range(depth):
                level = [self._best(codes, grad, hess, np.flatnonzero(node == k), bins) for k in range(2 ** len(splits))]
                splits.append(np.array(level))
                node = 2 * node + (codes[np.arange(len(y)), splits[-1][node, 0]] > splits[-1][node, 1])
            n = 2**depth
            leaf = rate * np.bincount(node, grad, n) / (np.bincount(node, hess, n) + 1.0)
            self.nodes.append((splits, leaf))
            score += leaf[node]

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)

    @staticmethod
    def _best(codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, bins: int) -> tuple[int, int]:
        best = (0.0, 0, bins)
        for f in range(codes.shape[1]):
            g, h = (np.cumsum(np.bincount(codes[rows, f], v[rows], bins + 1)) for v in (grad, hess))
            gain = g**2 / (h + 1) + (g[-1] - g) ** 2 / (h[-1] - h + 1) - g[-1] ** 2 / (h[-1] + 1)
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), f, k)
        return best[1], best[2]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        codes, score = self._codes(x), np.full(len(x), self.start)
        for splits, leaf in self.nodes:
            node = np.zeros(len(x), int)
            for s in splits:
                node = 2 * node + (codes[np.arange(len(x)), s[node, 0]] > s[node, 1])
            score += leaf[node]
        return score


class Model:
    """Trees, their calibration, and the threshold of each kind."""

    def __init__(self, examples: int = EXAMPLES, seed: int = SEED, precision: float = PRECISION):
        rng, x, y, kinds, apart = random.Random(seed), [], [], [], []
        for i in range(examples):
            text, spans = invented(rng)
            for c in candidates(text):
                x.append(features(text, *c))
                y.append(c in spans)
                kinds.append(c[0])
                apart.append(i % 3 == 0)
        x, y, kinds, apart = np.array(x), np.array(y, float), np.array(kinds), np.array(apart)
        self.trees = Trees(x[~apart], y[~apart], TREES, DEPTH, RATE, BINS)
        raw = self.trees(x[apart])
        self.curve = isotonic(raw, y[apart], np.ones(len(raw)))
        p, truth, kind = self._calibrated(raw), y[apart], kinds[apart]
        self.threshold = {}
        for k in KINDS:
            order = np.argsort(-p[kind == k], kind="stable")
            right = np.cumsum(truth[kind == k][order]) / np.arange(1, len(order) + 1)
            good = np.flatnonzero(right >= precision)
            self.threshold[k] = max(0.5, float(p[kind == k][order][good[-1]])) if len(good) else 2.0

    def _calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, *self.curve)

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """The base spans, and the spans added, which overlap neither those nor one another."""
        if not ANY.search(text) and not marked(text):
            return [], []
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        starts = np.array([a for a, _ in taken], int)
        ends = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0, int)

        def free(a: int, b: int) -> bool:
            i = int(np.searchsorted(starts, b))
            return i == 0 or ends[i - 1] <= a

        found = [c for c in dict.fromkeys(candidates(text)) if free(c[1], c[2])]
        if not found:
            return base, []
        p = self._calibrated(self.trees(np.array([features(text, *c) for c in found])))
        added: list[tuple[str, int, int]] = []
        covered: set[int] = set()
        for i in np.lexsort((np.array([c[1] - c[2] for c in found]), -p)).tolist():
            kind, a, b = found[i]
            if p[i] >= self.threshold[kind] and covered.isdisjoint(range(a, b)):
                added.append(found[i])
                covered.update(range(a, b))
        return base, added


@functools.cache
def model() -> Model:
    """Trained once a process; the training is seeded and gives the same model everywhere."""
    return Model()


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first one."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def found(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all) and, on demand, the redacted text.

    docs needs doc_id and text; further columns don't matter. A null text is empty, and stays null when redacted. Rows
    are searched one by one, whether or not ids repeat or are null. An empty table gives an empty result.
    """
    short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model())
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *["redacted"] * with_text]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = sent.value
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, added = trained.spans(text or "")
                kinds = [s[0] for s in base]
                row = [*(kinds.count(k) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added)]
                rows.append(row + [text if text is None else redacted(text, base + added)] * with_text)
            kinds = [pa.int64()] * 4 + [pa.string()] * (2 + with_text)
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", redacted string" * with_text
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, schema)


def stage(docs: DataFrame) -> DataFrame:
    """docs with every span found replaced by its kind, and the length in n_chars where there is such a column.

    Rows are searched one by one, whether or not ids repeat or are null; a null text stays null, and an empty table gives
    an empty result.
    """
    short_batches(docs.sparkSession)
    sent, names, at = docs.sparkSession.sparkContext.broadcast(model()), docs.columns, docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = sent.value
        for b in batches:
            clean = [t if t is None else redacted(t, sum(trained.spans(t), [])) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(clean, b.schema.field(at).type) if i == at else c for i, c in enumerate(b.columns)], names=names)

    out = docs.mapInArrow(each, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars").cast("long"))).select(*names) if "n_chars" in names else out
