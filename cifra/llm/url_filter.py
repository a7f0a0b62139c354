"""URL filters: pattern rules found by their rarest literal token, then checked by regular expression.

A rule is a literal or a regular expression over host and path. Each has literal tokens, runs of letters and digits that
must stand whole in every URL it matches. The rule is indexed by the one of them that the fewest URLs of the corpus
have. The tokens of a URL fetch candidate rules from that index, and only the candidates' regular expressions run. Rules
without any whole token have no key; they are a constant array whose expressions run on every URL. Of the rules that
match, the longest wins.

Everything is DataFrame expressions and joins. Each distinct URL is judged once, so a URL that many rows have costs one
lookup, and html is never read. Rows without a URL pass the joins by. The verdicts are settled before they go back to
the rows, so that this join deals out both sides itself and can split a URL that very many rows have.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cifra.llm.common import ascii_lower, settled

TOKEN = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: Rules up to this many characters are sent to every task; more are joined by token like any other table.
SENT_CHARS = 4_000_000


@dataclass(frozen=True)
class Rule:
    """A rule of host and path prefix, or, with a regex over host + path, a pattern rule that yields no rule string."""

    verdict: str
    host: str = ""
    path: str = ""
    regex: str = ""
    #: Of a regex: tokens that stand whole in everything it matches.
    literals: tuple[str, ...] = ()

    @property
    def name(self) -> str | None:
        return None if self.regex else self.host + self.path

    @property
    def pattern(self) -> str:
        return self.regex or r"(?s)\A(?:[^/]*\.)?" + "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in self.host) + "(?:" + "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in self.path) + ")"

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that any match holds whole. A prefix's last token may go on in the URL, unless it is closed."""
        if self.regex:
            return list(self.literals)
        whole = f"{self.host}{self.path}".translate(LOWER)
        return [m.group() for m in re.finditer(r"[0-9a-z\x80-\U0010ffff]+", whole) if m.end() < len(whole)]


def whole(word: str) -> str:
    """A regex for the word as a whole token."""
    return r"(?<![0-9a-z\x{80}-\x{10FFFF}])" + word + r"(?![0-9a-z\x{80}-\x{10FFFF}])"


LOWER = {c: c + 32 for c in range(65, 91)}
#: The rules with a name to report, and below them patterns for what no such rule covers.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
PATTERNS = tuple(Rule("block", regex=r"\A[^/]*" + whole(w), literals=(w,)) for w in ("adult", "porn", "xxx", "sex", "casino", "poker", "betting", "pills", "viagra", "warez", "torrent", "malware", "phishing", "spam")) + (
    Rule("block", regex=r"\A[^/]*/(?:.*/)?wp-login\.php\z", literals=("wp", "login", "php")),
    Rule("block", regex=r"\A[^/]*/cgi-bin/", literals=("cgi", "bin")),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, up to / ? # or the end, A-Z lower-cased) and path (then up to ? # or the end)."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_array(rules: dict[int, Rule]) -> Column:
    """The rules by their numbers, as a constant array."""
    rows = [{"rule_no": i, "rule": r.name, "verdict": r.verdict, "pattern": r.pattern, "tokens": list(dict.fromkeys(r.tokens))} for i, r in rules.items()]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<rule_no:int,rule:string,verdict:string,pattern:string,tokens:array<string>>>")


def ranked(rule: Column) -> Column:
    """rank, rule and verdict of a rule: named ones before patterns, then by length, longer host, block, number."""
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    rank = F.struct(rule["rule"].isNotNull().alias("named"), size(rule["rule"]).alias("size"), size(F.substring_index(rule["rule"], "/", 1)).alias("host_size"), (rule["verdict"] == "block").alias("blocks"), (-rule["rule_no"]).alias("no"))
    return F.struct(rank.alias("rank"), rule["rule"].alias("rule"), rule["verdict"].alias("verdict"))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, patterns: tuple[Rule, ...] = PATTERNS, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages.

    pages needs page_id and url; further columns don't matter. A null url or one without :// has empty host and path, no
    rule, and the verdict `otherwise`. Rows that repeat a page_id or have none are judged each. Of rules of equal length
    the one with the longer host wins, then block. Named rules come before patterns. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    every = dict(enumerate(tuple(rules) + tuple(patterns)))
    table = spark.range(1).select(F.explode(rule_array({i: r for i, r in every.items() if r.tokens})).alias("own")).select("own.rule_no", "own.tokens", "own")
    everywhere = rule_array({i: r for i, r in every.items() if not r.tokens})
    small = sum(len(r.pattern) for r in every.values()) <= SENT_CHARS
    send = F.broadcast if small else (lambda df: df)
    split = pages.select(F.col("page_id").cast("long"), *[c.alias(n) for c, n in zip(parts(F.col("url").cast("string")), ("host", "path"), strict=True)])
    urls = split.filter("host <> '' or path <> ''").select("host", "path").distinct()
    tokens = F.array_distinct(F.regexp_extract_all(F.concat("host", ascii_lower(F.col("path"))), F.lit(TOKEN), F.lit(0)))
    tokened = urls.select("host", "path", F.explode(tokens).alias("token"))
    # The literal tokens of the rules, by how many URLs have them; the rarest one of each rule is its index key.
    literal = table.select("rule_no", F.explode("tokens").alias("token"))
    seen = tokened.join(send(literal.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = literal.join(seen, "token", "left").groupBy("rule_no").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = table.join(rarest, "rule_no").select("token", "own")
    matched = tokened.join(send(index), "token").filter(F.expr("rlike(concat(host, path), own.pattern)"))
    found = matched.select("host", "path", ranked(F.col("own")).alias("found"))
    if not all(r.tokens for r in every.values()):
        fits = F.filter(everywhere, lambda r: F.rlike(F.concat("host", "path"), r["pattern"]))
        found = found.unionByName(urls.select("host", "path", F.explode(F.transform(fits, ranked)).alias("found")))
    best = settled(found.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.max("found").alias("best")))
    known = split.filter("host <> '' or path <> ''").join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    out = known.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
    none = split.filter("host = '' and path = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    return out.unionByName(none)
