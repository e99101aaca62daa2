"""Quality rules, line first, in Spark's own expressions: no Python runs on the executors.

Each line of a text is judged alone.  A line without a word is neither kept nor counted.
Rules that fail a line:

* punctuation: fewer than ``short_line`` words and no closing mark at its end,
* navigation: at least ``bars`` separators such as ``|``, or one for every three words,
* boilerplate: a fixed phrase of web page furniture,
* symbols: symbols make up more than ``symbol_share`` per cent of its word characters.

Failed lines are removed.  A document is rejected when the removed lines hold more than
``most_lost`` per cent of its words, or when a document rule fails.  Everything is a
function of one row, so nothing is shuffled.

Defined cases: a null or empty text has no words and is rejected; repeated rows are judged
alike; an empty table gives an empty table; other columns pass through whatever their names, and a
column named like the result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.llm.store import unused
from relweave.llm.words import SPACED

WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
SHORT_LINE, BARS, SYMBOL_SHARE, MOST_LOST = 4, 3, 10, 50
SYMBOLS = r"[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]"
# What marks a line as closed, as navigation, as page furniture.
CLOSED = r"[.!?:;\"'’”»…。)][\x20\x09-\x0D]*\z"
BAR = r"[|»›•>]"
FURNITURE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy",
    "sign in", "skip to content", "terms of service", "terms of use",
)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SPACED)).cast("bigint")


def repeated_words(text: Column) -> Column:
    """Words inside a ``WINDOW``-word window that the text holds twice or more, the first included.

    Windows are compared by a 64-bit hash of their words' hashes.
    """
    hashes = F.transform(F.regexp_extract_all(text, F.lit(SPACED), F.lit(0)), lambda w: F.xxhash64(w))
    return F.aggregate(F.array(hashes), F.lit(0).cast("bigint"), lambda n, h: n + _covered(h))


def _covered(h: Column) -> Column:
    last = F.size(h) - WINDOW
    at = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    windows = F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i"))))

    def twice(ws: Column) -> Column:
        return F.sort_array(F.transform(
            F.filter(ws, lambda w, k: (F.get(ws, k - 1)["h"] == w["h"]) | (F.get(ws, k + 1)["h"] == w["h"])), lambda w: w["i"]
        ))

    def union(starts: Column) -> Column:
        steps = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda n, s: n + s)

    # a one-element array binds a computed array to a name, so it is computed once
    starts = F.transform(F.array(windows), twice)
    return F.when(last < 1, F.lit(0)).otherwise(F.get(F.transform(starts, union), F.lit(0)))


def lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(SPACED)))


@dataclass(frozen=True)
class LineRules:
    """What fails a line; ``furniture`` are phrases of page furniture, ``bar`` and ``closed`` patterns."""

    short_line: int = SHORT_LINE
    bars: int = BARS
    symbol_share: int = SYMBOL_SHARE
    furniture: tuple[str, ...] = FURNITURE
    bar: str = BAR
    closed: str = CLOSED


def rule_tests(line: Column, rules: LineRules = LineRules()) -> dict[str, Column]:
    """Each rule's name and whether the line fails it."""
    words = F.regexp_count(line, F.lit(SPACED))
    bar = F.regexp_count(line, F.lit(rules.bar))
    marks = F.regexp_count(line, F.lit(SYMBOLS))
    chars = F.length(line) - F.regexp_count(line, F.lit(SPACE))
    phrases = "|".join(rules.furniture)
    return {
        "punctuation": (words < rules.short_line) & ~F.regexp_like(line, F.lit(rules.closed)),
        "navigation": (bar >= rules.bars) | ((bar > 0) & (3 * bar >= words)),
        "boilerplate": F.regexp_like(F.lower(line), F.lit(phrases)) if phrases else F.lit(False),
        "symbols": 100 * marks > rules.symbol_share * chars,
    }


def line_fails(line: Column, rules: LineRules = LineRules()) -> Column:
    return reduce(lambda a, b: a | b, rule_tests(line, rules).values())


def judge(
    docs: DataFrame, *, text: str = "text", quality: str = "quality", least_words: int = LEAST_WORDS,
    most_repeated: int = MOST_REPEATED, most_lost: int = MOST_LOST, rules: LineRules = LineRules(),
) -> DataFrame:
    """``docs`` with ``quality``: counts, ``base_failed``, ``kept``, the cleaned text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines_, good_, repeated_ = unused(docs, "lines", "good", "repeated")
    known = docs.withColumn(lines_, lines(whole))
    known = known.withColumn(good_, F.filter(lines_, lambda x: ~line_fails(x, rules)))
    known = known.withColumn(repeated_, repeated_words(whole))
    words = n_words(whole)
    left = F.aggregate(good_, F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit(SPACED)))
    bad = (words < least_words) | (100 * F.col(repeated_) > most_repeated * words)
    made = F.struct(
        words.alias("n_words"), (F.length(whole) - F.regexp_count(whole, F.lit(SPACE))).cast("bigint").alias("word_chars"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("bigint").alias("n_dup_lines"),
        F.col(repeated_).alias("n_repeat_words"), bad.alias("base_failed"),
        (~bad & (100 * (words - left) <= most_lost * words)).alias("kept"), (F.size(lines_) - F.size(good_)).cast("bigint").alias("n_failed_lines"),
        F.array_join(good_, "\n").alias("text"),
    )
    return known.withColumn(quality, made).drop(lines_, good_, repeated_)


def failed_lines(docs: DataFrame, *, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row for each line that fails: all columns of the document, ``line_number``, ``line`` and the names of the rules it fails."""
    every = docs.select("*", F.posexplode(lines(F.coalesce(F.col(text), F.lit("")))).alias("line_number", "line"))
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rule_tests(F.col("line"), rules).items()]))
    return every.withColumn("failed_rules", names).where(F.size("failed_rules") > 0)


def clean(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents kept, with their failed lines removed."""
    quality, = unused(docs, "quality")
    judged = judge(docs, text=text, quality=quality, **options)
    return judged.where(F.col(quality)["kept"]).withColumn(text, F.col(quality)["text"]).select(*docs.columns)
