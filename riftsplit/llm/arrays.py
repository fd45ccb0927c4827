"""Array and span expressions in plain Spark functions; positions count code points from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Arrays are summed and long strings cut in blocks of this many entries, so that
# the work stays near n * BLOCK instead of n * n.
BLOCK = 128


def let(value: Column, body) -> Column:
    """``body(x)`` with x bound to ``value``, which is then evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _blocks(n: Column) -> Column:
    """0, 1, ... one number per block of an array of ``n`` entries (none for an empty array)."""
    return F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)


def running_sum(values: Column) -> Column:
    """Inclusive prefix sums of an array<bigint>, block by block."""

    def inside(part: Column, before: Column) -> Column:
        start = F.struct(before.alias("sum"), F.array().cast("array<bigint>").alias("out"))
        step = F.aggregate(
            part,
            start,
            lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"] + x)).alias("out")),
        )
        return step["out"]

    def all_blocks(parts: Column) -> Column:
        sums = F.transform(parts, _total)
        return let(sums, lambda t: F.flatten(F.transform(parts, lambda part, k: inside(part, _total(F.slice(t, 1, k))))))

    def split(v: Column) -> Column:
        return let(F.transform(_blocks(F.size(v)), lambda k: F.slice(v, k * BLOCK + 1, BLOCK)), all_blocks)

    return let(values, split)


def cut(text: Column, spans: Column) -> Column:
    """The pieces of ``text`` under sorted spans (start, end).

    A block of spans is cut from the text once and its pieces from that part, because
    reaching a code point of a long string means walking up to it.
    """

    def piece(text: Column, low: Column, high: Column) -> Column:
        return F.substring(text, low.cast("int") + 1, (high - low).cast("int"))

    def block(own: Column) -> Column:
        low, high = F.element_at(own, 1)["start"], F.element_at(own, -1)["end"]
        return let(
            F.struct(low.alias("low"), piece(text, low, high).alias("text")),
            lambda part: F.transform(own, lambda s: piece(part["text"], s["start"] - part["low"], s["end"] - part["low"])),
        )

    def all_blocks(s: Column) -> Column:
        return F.flatten(F.transform(F.transform(_blocks(F.size(s)), lambda k: F.slice(s, k * BLOCK + 1, BLOCK)), block))

    return let(spans, all_blocks)


def gaps_and_hits(text: Column, pattern: str) -> Column:
    """(gap, len, hit) for each match, left to right; gap is the distance from the last match's end.

    The pattern must not match the empty string.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    return F.filter(zipped, lambda x: x["hit"].isNotNull())


def located(found: Column, kind: str, rank: int) -> Column:
    """(start, rank, end, kind, hit) from the result of ``gaps_and_hits``."""
    ends = running_sum(F.transform(found, lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("bigint")))
    return F.transform(
        F.arrays_zip(found.alias("m"), ends.alias("end")),
        lambda z: F.struct(
            (z["end"] - F.length(z["m"]["hit"])).alias("start"),
            F.lit(rank).alias("rank"),
            z["end"].alias("end"),
            F.lit(kind).alias("kind"),
            z["m"]["hit"].alias("hit"),
        ),
    )
