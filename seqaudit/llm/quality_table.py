"""Quality rules: a threshold table compiled into one projection.

Every measure is a column expression over the whole text, every rule is one line of
``THRESHOLDS``; ``judge`` turns the table into a single ``select``. There is no user
function and no shuffle: a row is judged where it is read.

Defined results. A null text has no words: all counts are 0 and the base rule rejects
it. The same text always gets the same verdict, whatever its row; repeated rows and
null ids stay as they are. An empty table gives an empty table. Columns of the input
are kept unless ``judge`` is asked for measures only; names that clash with a measure
are read before they are replaced, so an input column ``n_words`` never enters a rule.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Characters that separate words, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 8

#: Function words of the four languages of the corpus (fixed values). They are matched as
#: they stand in running text, so a text in capitals or with a symbol on every word has none.
STOP_WORDS = (
    "the be to of and that have with is it for on as was by are at from this in or an not which "
    "le la les de des du et en un une que qui dans pour pas sur est au avec par "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "el los las del y en que por con para una su al lo como más pero"
).split()


@dataclass(frozen=True)
class Threshold:
    """One rule: the measure must lie within [low, high]; ``None`` leaves a side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Production thresholds. A ratio without a denominator (no words, no lines) is 0.
THRESHOLDS = (
    Threshold("n_words", low=20),
    Threshold("mean_word_length", low=2.0, high=14.0),
    Threshold("symbol_ratio", high=0.10),
    Threshold("stop_word_ratio", low=0.02),
    Threshold("stutter_ratio", high=0.30),
    Threshold("duplicate_line_ratio", high=0.50),
    Threshold("short_line_ratio", high=0.90),
    Threshold("bullet_line_ratio", high=0.90),
    Threshold("ellipsis_line_ratio", high=0.30),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _count(values: Column, keep) -> Column:
    return F.size(F.filter(values, keep)).cast("bigint")


def _joined(hashes: Column, step: int) -> Column:
    return F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + step)))


def _repeated_words(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words inside windows of ``WINDOW`` words that occur twice or more.

    Windows become hashes; a text without equal hashes (nearly all) stops there. Else
    (hash, place) pairs are sorted, equal neighbours are kept, and the union of their
    word ranges is measured from the sorted places: n log n for any text.
    """
    # h[i] covers words i..i+7, built by doubling: one word, two, four, eight
    hashed = F.transform("__words", lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        df = df.withColumn("__h", hashed)
        hashed = _joined(F.col("__h"), step)
    df = df.withColumn("__h", hashed)
    full = F.slice(F.col("__h"), 1, F.size("__h") - (WINDOW - 1))
    empty = F.array().cast("array<bigint>")
    df = df.withColumn("__hashes", F.when(F.size("__h") >= WINDOW, full).otherwise(empty))
    pairs = F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    distinct = F.size(F.array_distinct("__hashes")) == F.size("__hashes")
    df = df.withColumn("__pairs", F.when(distinct, none).otherwise(F.sort_array(pairs)))
    pair = F.col("__pairs")
    twin = lambda p, k: F.coalesce(F.get(pair, k - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(
        F.get(pair, k + 1)["h"] == p["h"], F.lit(False))
    df = df.withColumn("__at", F.sort_array(F.transform(F.filter(pair, twin), lambda p: p["i"])))
    at = F.col("__at")
    reach = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))))
    return df.withColumn("n_repeat_words", F.aggregate(reach, F.lit(0).cast("bigint"), lambda a, x: a + x))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``__m`` of all counts and ratios of the whole text."""
    words = F.array_remove(F.split(F.col("__text"), SPACE + "+"), "")
    lines = F.filter(F.split(F.col("__text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumns({"__words": words, "__lines": lines})
    word, line, whole = F.col("__words"), F.col("__lines"), F.col("__text")
    counts = {
        "n_words": F.size(word).cast("bigint"),
        "word_chars": F.length(F.array_join(word, "")).cast("bigint"),
        "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("bigint"),
        "n_lines": F.size(line).cast("bigint"),
        "n_dup_lines": (F.size(line) - F.size(F.array_distinct(line))).cast("bigint"),
        "n_stop": _count(word, lambda w: w.isin(STOP_WORDS)),
        "n_stutter": _count(word, lambda w, i: F.coalesce(w == F.get(word, i - 1), F.lit(False))),
        "n_short_lines": _count(line, lambda x: F.length(x) < 12),
        "n_bullets": _count(line, lambda x: x.rlike(r"^[\x20\x09]*[-*•]")),
        "n_ellipses": _count(line, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")),
    }
    clash = [c for c in df.columns if c in counts]
    df = df.select(*[F.col(c) for c in df.columns if c not in clash],
                   F.struct(*[F.col(c) for c in clash], F.lit(0).alias("__none")).alias("__own"),
                   *[v.alias(n) for n, v in counts.items()])
    # n_repeat_words may also be a column of the input; it is set aside like the others
    if "n_repeat_words" in df.columns:
        clash.append("n_repeat_words")
        df = df.withColumn("__own", F.struct("__own.*", "n_repeat_words"))
    df = _repeated_words(df)
    ratios = {
        "mean_word_length": _ratio(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": _ratio(F.col("n_symbols"), F.col("n_words")),
        "stop_word_ratio": _ratio(F.col("n_stop"), F.col("n_words")),
        "stutter_ratio": _ratio(F.col("n_stutter"), F.col("n_words")),
        "duplicate_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "short_line_ratio": _ratio(F.col("n_short_lines"), F.col("n_lines")),
        "bullet_line_ratio": _ratio(F.col("n_bullets"), F.col("n_lines")),
        "ellipsis_line_ratio": _ratio(F.col("n_ellipses"), F.col("n_lines")),
    }
    inner = [*[F.col(n) for n in (*counts, "n_repeat_words")], *[v.alias(n) for n, v in ratios.items()]]
    back = [F.col(f"__own.{c}").alias(c) if c in clash else F.col(c) for c in docs.columns]
    return df.select(*back, F.struct(*inner).alias("__m"))


def _holds(rule: Threshold) -> Column:
    value, sides = F.col(f"__m.{rule.measure}"), []
    if rule.low is not None:
        sides.append(value >= F.lit(rule.low))
    if rule.high is not None:
        sides.append(value <= F.lit(rule.high))
    return reduce(lambda a, b: a & b, sides, F.lit(True))


def judge(docs: DataFrame, text: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """``docs`` plus ``quality``: a struct of the counts, ``base_failed``, ``failed`` (measures out of range), ``kept``."""
    m = measure(docs, text)
    base = (F.col("__m.n_words") < 20) | (100 * F.col("__m.n_repeat_words") > 30 * F.col("__m.n_words"))
    failed = F.array_compact(F.array(*[F.when(~_holds(t), F.lit(t.measure)) for t in thresholds])) if thresholds \
        else F.array().cast("array<string>")
    kept = ~base & reduce(lambda a, b: a & b, [_holds(t) for t in thresholds], F.lit(True))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    verdict = F.struct(*[F.col(f"__m.{n}").alias(n) for n in names], base.alias("base_failed"),
                       failed.alias("failed"), kept.alias("kept"))
    # explode() of one verdict: a filter on it must not be pushed down, where Catalyst would
    # repeat the whole computation inside its own lambdas
    return m.select(*[F.col(f"`{c}`") for c in docs.columns if c != "quality"],
                    F.explode(F.array(verdict)).alias("quality"))


def keep(docs: DataFrame, text: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` that every rule accepts, with their own columns."""
    kept = judge(docs.withColumn("__row", F.struct(*docs.columns)), text, thresholds).where("quality.kept")
    return kept.select("__row.*")
