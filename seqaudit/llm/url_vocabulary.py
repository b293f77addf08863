"""URL filter: explicit host and path rules first, then a weighted vocabulary.

The vocabulary is one Aho-Corasick automaton of strict and soft terms. A term counts
where no ASCII letter or digit touches it. A URL is blocked by one strict term or by
``SOFT_LIMIT`` distinct soft terms; how often a soft term repeats does not matter.

A rule names a host, which covers its subdomains, and a path prefix; the rule with the
longest text (host and path together) decides, whatever the vocabulary says.

Defined results. A null URL has empty host and path and is allowed; a text without
``://`` has empty host and path, so no rule fits, but its terms count. Only A-Z are
lower-cased. Whole URLs are read, whatever their length. Rows are judged one by one:
repeated rows, ties and empty tables need no rule. Extra columns are kept; the columns
of the verdict replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: One hit rejects.
STRICT = ("porn", "xxx", "hentai", "camgirls", "escorts", "viagra", "cialis", "warez", "keygen", "bestiality")
#: ``SOFT_LIMIT`` different hits reject.
SOFT = (
    "adult", "bet", "bets", "bonus", "casino", "cheap", "coupon", "crack", "crypto", "dating", "drugs", "erotic",
    "farm", "free", "gambling", "jackpot", "loan", "loans", "lottery", "meds", "nude", "payday", "pharmacy", "pills",
    "poker", "replica", "sex", "slots", "spam", "steroids", "torrent", "webcam",
)
SOFT_LIMIT = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = frozenset(LOWER + "0123456789")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", True),
    Rule("example.org", "/es/", False),
    Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True),
    Rule("com", "/de/", False),
)


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term in soft:
        out.add_word(term, (term, False))
    for term in strict:  # a term of both lists is strict
        out.add_word(term, (term, True))
    out.make_automaton()
    return out


def term_hits(url: str, terms: ahocorasick.Automaton) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms that stand alone in a lower-cased URL."""
    found: tuple[set[str], set[str]] = (set(), set())
    if len(terms):
        for end, (term, strict) in terms.iter(url):
            start = end - len(term)
            if (start < 0 or url[start] not in _WORD) and (end + 1 >= len(url) or url[end + 1] not in _WORD):
                found[not strict].add(term)
    return found


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def judge(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, strict: tuple[str, ...] = STRICT,
          soft: tuple[str, ...] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """``pages`` with host, path, rule, n_strict, n_soft (distinct terms) and verdict."""

    @F.pandas_udf("n_strict int, n_soft int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        terms = automaton(strict, soft)
        for urls in batches:
            hits = [term_hits(u or "", terms) for u in urls]
            yield pd.DataFrame({"n_strict": [len(a) for a, _ in hits], "n_soft": [len(b) for _, b in hits]}, dtype="int32")

    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    lower = F.translate(text, UPPER, LOWER)
    split = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = F.regexp_extract(lower, split, 1), F.regexp_extract(text, split, 2)
    rule, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is tried first
        rule = F.when(_fits(r, F.col("__host"), F.col("__path")), F.lit(r.name)).otherwise(rule)
        allow = F.when(_fits(r, F.col("__host"), F.col("__path")), F.lit(r.allow)).otherwise(allow)
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "n_strict", "n_soft", "verdict")]
    # all of the URL's own columns are kept; the terms are counted after the rules
    found = pages.withColumns({"__host": host, "__path": path, "__lower": lower})
    found = found.withColumns({"__rule": rule, "__allow": allow, "__terms": count("__lower")})
    terms = (F.col("__terms.n_strict") < 1) & (F.col("__terms.n_soft") < soft_limit)
    verdict = F.when(F.coalesce("__allow", terms), F.lit("allow")).otherwise(F.lit("block"))
    return found.select(
        *[F.col(f"`{c}`") for c in own], F.col("__host").alias("host"), F.col("__path").alias("path"),
        F.col("__rule").alias("rule"), F.col("__terms.n_strict").alias("n_strict"), F.col("__terms.n_soft").alias("n_soft"),
        verdict.alias("verdict"))
