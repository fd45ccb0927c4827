"""Quality rules with adaptive thresholds, in Spark expressions only.

Each text is reduced to counts, the counts to rates in parts per million, and the rates of
every language and source to quantile sketches: log-linear histograms (64 buckets for each
power of two, so a quantile is off by less than 1/64 of its value), which merge by adding
counts and do not depend on the order of the rows.  Sketches of the groups are merged to those
of the languages and of the corpus.  A group of n rows is held to the next wider level and then drawn towards
it with the weight of ``PRIOR_ROWS`` rows, so a verdict has no step in the size of the table: held means that
its spreads are at most the wider level's, and its median lies at most the slack of the rule beyond the wider median
(a language keeps its own median of word lengths), so a source that is full of junk does not widen its own
fence.  A text is rejected when a rate lies beyond the fence of its group:
median + REACH * (upper quartile - median), but at least the slack of the rule beyond the
median (likewise downwards for the least word length).  Fewer than 3 repeated lines or 30 repeated
words count as none.

Defined results: a null or empty text has no words and fails the base rule; null languages and
sources form groups of their own; equal rows get equal results and all rows stay in the report; an empty table
gives an empty report.  Columns that share a name with a result are replaced by it; all others are passed through.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftsplit.llm.arrays import let
from riftsplit.plans.durable import durable

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

MILLION = 1_000_000
PRIOR_ROWS = 50  # rows that the wider level counts for beside those of a group
REACH = 6
FINE = 64  # buckets for each power of two


@dataclass(frozen=True)
class Rule:
    """A rate in parts per million, the side on which it is judged, and the least distance of the fence from the median."""

    name: str
    top: str
    base: str
    slack: int
    upper: bool = True
    by_language: bool = False  # the median differs among languages, so the first level keeps its own

    def rate(self) -> Column:
        return F.expr(f"CASE WHEN {self.base} > 0 THEN {self.top} * {MILLION} div {self.base} ELSE 0L END")


def at_least(count: str, least: int) -> str:
    """A count that is taken as 0 below ``least``: one repeated sentence makes a high rate in a short clean text."""
    return f"(CASE WHEN {count} >= {least} THEN {count} ELSE 0 END)"


RULES = (
    Rule("symbol_rate", "n_symbols", "word_chars", 50_000),
    Rule("dup_line_rate", at_least("n_dup_lines", 3), "n_lines", 300_000),
    Rule("repeat_rate", at_least("n_repeat_words", 30), "n_words", 200_000),
    Rule("long_words", "word_chars", "n_words", 4 * MILLION, by_language=True),
    Rule("short_words", "word_chars", "n_words", 2 * MILLION + MILLION // 2, upper=False, by_language=True),
)


def repeated_words(words: Column, grams: Column) -> Column:
    """Words that lie in a window found twice or more; ``grams`` are the hashes of the windows by position.

    Sorting the hashes alone shows whether any repeats; only then positions are sorted along.
    """
    n = F.size(grams)

    placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(at: Column) -> Column:
        marked = F.transform(
            at, lambda x, j: F.when((F.get(at, j - 1)["h"] == x["h"]) | (F.get(at, j + 1)["h"] == x["h"]), x["i"])
        )
        twice = F.filter(marked, lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))

    return F.when(F.size(F.array_distinct(grams)) == n, 0).otherwise(let(placed, covered)).cast("bigint")


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by its counts: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    kept = [c for c in df.columns if c != text]
    body = F.coalesce(F.col(text), F.lit(""))
    split = df.select(*kept, body.alias("_body"), F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("_words"))
    lines = F.filter(F.split("_body", "\n", -1), lambda x: x.rlike(WORD))
    windows = F.when(
        F.size("_words") > 2,
        F.transform(
            F.sequence(F.lit(0), F.size("_words") - 3),
            lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    parts = split.select(
        *kept,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.length("_body") - F.length(F.regexp_replace("_body", SYMBOL, ""))).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"),
        F.col("_words"),
        windows.alias("_grams"),
    )
    return parts.select(
        *kept,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_words"), F.col("_grams")).alias("n_repeat_words"),
    )


def _null_safe(keys: dict[str, str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(b)) for a, b in keys.items()], F.lit(True))


def bucket(value: Column) -> Column:
    """Log-linear bucket of a non-negative whole number."""
    beyond = F.length(F.bin(value)) - 7
    high = F.call_function("shiftright", value, F.greatest(beyond, F.lit(0)))
    return F.when(value < FINE, value).otherwise(FINE * beyond + high).cast("int")


def least_value(b: Column) -> Column:
    """Lowest value of a bucket."""
    beyond = F.greatest(F.floor(b / FINE) - 1, F.lit(0)).cast("int")
    return F.when(b < FINE, b.cast("bigint")).otherwise(F.call_function("shiftleft", (FINE + b % FINE).cast("bigint"), beyond))


def rate_sketches(counts: DataFrame, by: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(by, rule, bucket, n): the sketches of the groups, one row per bucket in use."""
    rates = F.array(*[F.struct(F.lit(r.name).alias("rule"), bucket(r.rate()).alias("bucket")) for r in rules])
    long = counts.select(*by, F.explode(rates).alias("_r")).select(*by, "_r.rule", "_r.bucket")
    return long.groupBy(*by, "rule", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))


def _quartiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, rule, n, q25, q50, q75)."""
    group = Window.partitionBy(*by, "rule")
    seen = sketches.select(
        *by,
        "rule",
        "bucket",
        F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        F.sum("n").over(group).alias("_n"),
    )
    at = lambda q: least_value(F.min(F.when(100 * F.col("_upto") >= q * F.col("_n"), F.col("bucket")))).alias(f"q{q}")
    return seen.groupBy(*by, "rule").agg(F.max("_n").alias("n"), at(25), at(50), at(75))


def _shape(n: Column, q25: Column, q50: Column, q75: Column) -> Column:
    """Quartiles as a median and the spreads below and above it; all are whole and not negative."""
    return F.struct(n.alias("n"), q50.alias("mid"), (q50 - q25).alias("down"), (q75 - q50).alias("up"))


def _held(own: Column, wide: Column, rule: Rule, level: int) -> Column:
    """A group's shape held to that of the next wider level on the side that is judged.

    The spreads are at most the wider ones, and the median lies at most the slack beyond the wider median, so the fence lies
    at most the slack beyond the wider fence, whatever the group holds.
    """
    mid = own["mid"]
    if rule.by_language and level == 1:
        pass
    elif rule.upper:
        mid = F.least(mid, wide["mid"] + rule.slack)
    else:
        mid = F.greatest(mid, wide["mid"] - rule.slack)
    spread = lambda c: F.least(own[c], wide[c]).alias(c)
    return F.struct(own["n"].alias("n"), mid.alias("mid"), spread("down"), spread("up"))


def _drawn(own: Column, wide: Column, prior_rows: int) -> Column:
    """Mean of a group's shape and the wider one, weighed by the group's rows and ``prior_rows``."""
    n = own["n"].cast("decimal(19,0)")

    def mean(c: str) -> Column:
        top = n * own[c].cast("decimal(18,0)") + F.lit(prior_rows).cast("decimal(9,0)") * wide[c].cast("decimal(18,0)")
        return F.call_function("div", top, n + F.lit(prior_rows)).cast("bigint").alias(c)

    return F.struct(own["n"].alias("n"), mean("mid"), mean("down"), mean("up"))


def adaptive_fences(counts: DataFrame, by: list[str], rules: tuple[Rule, ...] = RULES, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """One row per group of ``by`` with the fence of each rule; wider levels drop columns of ``by`` from the right."""
    sketches = durable(rate_sketches(counts, by, rules))
    values = ["n", "q25", "q50", "q75"]
    found = _quartiles(sketches, by).withColumnsRenamed({c: f"{c}_{len(by)}" for c in values})
    for level in range(len(by)):
        keys = [*by[:level], "rule"]
        wide = _quartiles(merge_sketches(sketches, by[:level]), by[:level])
        wide = wide.select(*[F.col(c).alias(f"_{c}") for c in keys], *[F.col(c).alias(f"{c}_{level}") for c in values])
        found = found.join(wide, _null_safe({k: f"_{k}" for k in keys})).drop(*[f"_{c}" for c in keys])
    shape = lambda level: _shape(*[F.col(f"{c}_{level}") for c in values])
    chosen = found.withColumn("_level", shape(0))
    for level in range(1, len(by) + 1):
        chosen = chosen.withColumn("_own", shape(level))
        chosen = chosen.withColumn("_own", F.coalesce(*[F.when(F.col("rule") == r.name, _held(F.col("_own"), F.col("_level"), r, level)) for r in rules]))
        chosen = chosen.withColumn("_level", _drawn(F.col("_own"), F.col("_level"), prior_rows))
    mid = F.col("_level.mid")
    fences = []
    for r in rules:
        up = mid + F.greatest(REACH * F.col("_level.up"), F.lit(r.slack))
        down = mid - F.greatest(REACH * F.col("_level.down"), F.lit(r.slack))
        fences.append(F.max(F.when(F.col("rule") == r.name, up if r.upper else down)).alias(f"fence_{r.name}"))
    return chosen.groupBy(*by).agg(*fences)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def judge(
    df: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source"), rules: tuple[Rule, ...] = RULES, prior_rows: int = PRIOR_ROWS
) -> DataFrame:
    """The rows without the text, with counts, ``base_failed``, ``failed`` (names of the rules broken) and ``kept``."""
    named = lambda c: F.col(f"`{c.replace('`', '``')}`")
    fence_names = [f"fence_{r.name}" for r in rules]
    results = {*COUNTS, *fence_names, "base_failed", "failed", "kept"}
    extras = [c for c in df.columns if c != text and c.lower() not in results]
    # the caller's columns travel in one struct, so no name of theirs meets one of ours
    row = F.struct(F.lit(0).alias("_"), *[named(c).alias(f"c{i}") for i, c in enumerate(extras)]).alias("_row")
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(row, named(text).alias("_text"), *[named(c).alias(k) for k, c in zip(keys, by, strict=True)])
    counts = durable(text_counts(rows, "_text"))
    fences = adaptive_fences(counts, keys, rules, prior_rows)
    fences = fences.withColumnsRenamed({k: f"_by{k}" for k in keys})
    joined = counts.join(fences, _null_safe({k: f"_by{k}" for k in keys}), "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    beyond = [
        F.when(r.rate() > F.col(f"fence_{r.name}") if r.upper else r.rate() < F.col(f"fence_{r.name}"), F.lit(r.name)) for r in rules
    ]
    out = joined.withColumn("base_failed", base).withColumn("failed", F.array_compact(F.array(*beyond)))
    return out.select(
        *[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(extras)],
        *COUNTS,
        *fence_names,
        "base_failed",
        "failed",
        (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"),
    )
