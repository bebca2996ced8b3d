"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

``measures`` gives the counts of a text as column expressions, ``THRESHOLDS`` names ratios of them with
their bounds, and ``verdict`` turns the table into one boolean expression. All of it is one narrow
projection over the scan: no shuffle, no Python, one pass over each whole text.

A word is a run of bytes other than space and \\x09-\\x0D. Repeated words are those in five-word windows
that occur twice or more in the text, found by hashing each window (64 bits over the five words' 64-bit
hashes) and only for the texts with a repeated hash by sorting the windows.

Defined results. Null text: every count 0, fails the base rule. Empty text: the same. Very long texts: whole, in
the memory of their row. Repeated rows and ties: each row on its own; a ratio on its bound passes. Empty table:
no rows. Other columns, whatever their names, are carried along; one with the name of a column made here gives
way to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sylvan.llm.columns import named, without

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is was that it as with for by this from have are be not or at on an a "
    "der die das und in zu den von mit ist auf für im dem nicht ein eine als auch sich "
    "de la le et les des en un une que dans par pour sur au avec est il pas plus "
    "el y los se del las con para una su por lo como"
).split()
Rule = tuple[str, str, str, float, float, int]
#: (name, count, per, least, most, slack): a text is kept if count / per lies within the bounds, where the
#: count may be off by slack, so that one line or word more or less doesn't decide on a short text.
THRESHOLDS: tuple[Rule, ...] = (
    ("word_length", "word_chars", "n_words", 2.0, 12.0, 0),
    ("symbols", "n_symbols", "n_words", 0.0, 0.25, 1),
    ("stop_words", "n_stop_words", "n_words", 0.04, 1.0, 1),
    ("duplicate_lines", "n_dup_lines", "n_lines", 0.0, 0.3, 1),
    ("repeated_words", "n_repeat_words", "n_words", 0.0, 0.2, 0),
)
#: The base rule: fewer words than this, or a larger share of repeated words in percent, fails.
LEAST_WORDS, MOST_REPEATED = 10, 20


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value evaluated once, as the variable of a one-element transform."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """Words in five-word windows that occur at least twice."""
    n = F.size(words)

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spots(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda x, j: F.get(s, j)["h"].eqNullSafe(x["h"])
            hit = F.transform(s, lambda x, j: F.when(((j > 0) & same(x, j - 1)) | ((j < last) & same(x, j + 1)), x["i"]))
            return _let(F.sort_array(F.array_compact(hit)), lambda p: F.aggregate(F.transform(p, lambda x, j: F.when(j > 0, F.least(x - F.get(p, j - 1), F.lit(5))).otherwise(F.lit(5))), F.lit(0).cast("long"), lambda a, x: a + x))

        return _let(ordered, spots)

    def windows_of(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4)))

    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered(windows))

    return F.when(n < 6, F.lit(0).cast("long")).otherwise(_let(_let(F.transform(words, lambda w: F.xxhash64(w)), windows_of), count))


def measures(text: Column) -> Column:
    """A struct of the counts of one text."""
    text = F.coalesce(text, F.lit(""))
    stop = sorted({f(w) for w in STOP_WORDS for f in (str, str.capitalize, str.upper)})
    bare = F.translate(text, SPACES, "")

    def of_lines(lines: Column) -> list[Column]:
        return [F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines")]

    def of(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(bare).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            *of_lines(lines),
            _repeated(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        )

    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    return _let(words, lambda w: _let(lines, lambda x: of(w, x)))


def verdict(m: Column, table: tuple[Rule, ...] = THRESHOLDS) -> Column:
    """The threshold table as one boolean expression over a struct of measures."""
    ok = F.lit(True)
    for _, count, per, least, most, slack in table:
        ok = ok & (m[count] + slack >= F.lit(least) * m[per]) & (m[count] - slack <= F.lit(most) * m[per])
    return ok


def quality_rules(docs: DataFrame, table: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """The documents with their counts, ``base_failed`` and ``kept``."""
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept", "_m"]
    docs = without(docs, names)
    m = F.col("_m")
    failed = (m["n_words"] < LEAST_WORDS) | (F.lit(100) * m["n_repeat_words"] > F.lit(MOST_REPEATED) * m["n_words"])
    return docs.withColumn("_m", measures(F.col("text"))).select(*map(named, docs.columns), *[m[n].alias(n) for n in names[:7]], failed.alias("base_failed"), (~failed & verdict(m, table)).alias("kept"))
