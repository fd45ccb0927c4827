"""Secret scan in Spark expressions only: known shapes, and high entropy in sliding windows.

Base spans are leftmost, non-overlapping matches of the three shapes in ``SHAPES``.
The entropy scan takes long unbroken strings of a character class, slides a window
over each, keeps the counts of the window's characters by adding the one that enters
and removing the one that leaves, and reports the stretches whose Shannon entropy stays
at or above the class's threshold.  Strings on the allow list are not reported by the
entropy scan; base spans always stay.

Defined results: a null or empty text has no spans; an empty table gives an empty result; equal rows get equal results; rows
are never dropped, and columns other than the text are passed through unread, so names
that clash with the results only matter for the result columns, which are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftsplit.llm.arrays import cut, gaps_and_hits, let, located

# Fixed values of the base shapes: kind, pattern, least length, group that the length is taken of.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SHAPES = [("assign", ASSIGN, 12, 2), ("access", r"AKIA[A-Z0-9]+", 18, 0), ("hex", r"[0-9a-f]+", 16, 0)]


@dataclass(frozen=True)
class EntropyClass:
    """Strings of one alphabet: window length, entropy threshold in bits, and what the string must contain."""

    kind: str
    alphabet: str
    window: int
    bits: float
    needs: tuple[str, ...]

    @property
    def pattern(self) -> str:
        chars = self.alphabet.replace("-", "") + ("-" if "-" in self.alphabet else "")
        return f"(?<![{chars}])[{chars}]{{{self.window},}}"


HEX_DIGITS = "0123456789abcdefABCDEF"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CLASSES = (
    EntropyClass("entropy_hex", HEX_DIGITS, 20, 3.0, ("[0-9].*[0-9].*[0-9]", "[A-F].*[A-F]")),
    EntropyClass("entropy_base64", BASE64, 20, 3.7, ("[0-9].*[0-9]", "[a-z].*[a-z]", "[A-Z].*[A-Z]")),
    # one case and digits: words with a number at an end also reach this entropy, so digits must lie among the letters
    EntropyClass("entropy_lower", "abcdefghijklmnopqrstuvwxyz0123456789", 20, 3.3, ("(?:[0-9]+[a-z]+){3}",)),
    EntropyClass("entropy_upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20, 3.3, ("(?:[0-9]+[A-Z]+){2}",)),
)

# Whole strings that look random but are not secrets: identifiers, alphabets, placeholders.  A placeholder that is a
# folder of a path says nothing of the string beside it.
PLACEHOLDER = "(?i:example|placeholder|dummy|changeme|your[-_]?key)"
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    rf".*[^/]{PLACEHOLDER}.*|.*{PLACEHOLDER}[^/].*|{PLACEHOLDER}",
    r".*(?i:abcdefghij|0123456789|1234567890|qwertyuiop).*",
    r"(.)\1*",
    r"(?:sha\d+|md5)[-=].*",
)


def window_stretches(text: Column, cls: EntropyClass) -> Column:
    """(start, end) stretches of a string whose windows all reach the threshold.

    The state is the array of counts, the sum of c * log2(c), and the stretches so far:
    entropy is log2(w) - sum / w, so a window passes while the sum is low.
    """
    w = cls.window
    log = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(w + 2)])
    most = w * (math.log2(w) - cls.bits) + 1e-9
    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(cls.alphabet), c))
    entering = lambda at: F.transform(
        at, lambda c, i: F.struct(c.alias("new"), F.when(i >= w, F.get(at, i - w)).alias("old"), i.alias("i"))
    )
    stretch = "array<struct<start:int,end:int>>"
    zero = F.struct(
        F.array_repeat(F.lit(0), len(cls.alphabet) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.array().cast(stretch).alias("found")
    )

    def step(s: Column, x: Column) -> Column:
        gone = F.coalesce(F.get(s["counts"], x["old"]), F.lit(0))
        left = s["sum"] - F.when(gone > 0, F.get(log, gone) - F.get(log, gone - 1)).otherwise(0.0)
        had = F.get(s["counts"], x["new"]) - F.when(x["old"] == x["new"], 1).otherwise(0)
        total = left + F.get(log, had + 1) - F.get(log, had)
        counts = F.transform(
            s["counts"], lambda c, j: c + F.when(j == x["new"], 1).otherwise(0) - F.when(j == x["old"], 1).otherwise(0)
        )
        last = F.try_element_at(s["found"], F.lit(-1))
        first, end = x["i"] - (w - 1), x["i"] + 1
        grown = F.when(
            last["end"] >= first,
            F.concat(F.slice(s["found"], 1, F.greatest(F.size(s["found"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), end.alias("end")))),
        ).otherwise(F.concat(s["found"], F.array(F.struct(first.alias("start"), end.alias("end")))))
        found = F.when((x["i"] >= w - 1) & (total <= most), grown).otherwise(s["found"])
        return F.struct(counts.alias("counts"), total.alias("sum"), found.alias("found"))

    return F.aggregate(let(codes, entering), zero, step)["found"]


def _entropy_spans(found: Column, cls: EntropyClass, rank: int, allow: tuple[str, ...]) -> Column:
    """Spans of the stretches in those located strings that are candidates and not on the allow list."""
    allowed = "^(?:" + "|".join(f"(?:{a})" for a in allow) + ")$"

    def candidate(m: Column) -> Column:
        ok = ~m["hit"].rlike(allowed) if allow else F.lit(True)
        for need in cls.needs:
            ok = ok & m["hit"].rlike(need)
        return ok

    def spans(m: Column) -> Column:
        return F.transform(
            window_stretches(m["hit"], cls),
            lambda s: F.struct(
                (m["start"] + s["start"]).alias("start"),
                F.lit(rank).alias("rank"),
                (m["start"] + s["end"]).alias("end"),
                F.lit(cls.kind).alias("kind"),
                F.substring(m["hit"], s["start"] + 1, s["end"] - s["start"]).alias("hit"),
            ),
        )

    return F.flatten(F.transform(F.filter(found, candidate), spans))


def scan_secrets(
    df: DataFrame, text: str = "text", classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW
) -> DataFrame:
    """Add ``secrets``: array of (start, rank, end, kind, hit), sorted by start, then kind as listed."""
    body = F.coalesce(F.col(text), F.lit(""))
    shapes = [*[(k, p) for k, p, _, _ in SHAPES], *[(c.kind, c.pattern) for c in classes]]
    found = df.withColumns({f"_found_{k}": gaps_and_hits(body, p) for k, p in shapes})
    placed = found.withColumns({f"_at_{k}": located(F.col(f"_found_{k}"), k, r) for r, (k, _) in enumerate(shapes)})

    def long_enough(kind: str, pattern: str, least: int, group: int) -> Column:
        if group == 0:
            return F.filter(F.col(f"_at_{kind}"), lambda m: F.length(m["hit"]) >= least)
        return F.filter(F.col(f"_at_{kind}"), lambda m: F.length(F.regexp_extract(m["hit"], pattern, group)) >= least)

    parts = [long_enough(*shape) for shape in SHAPES]
    for rank, cls in enumerate(classes, len(SHAPES)):
        parts.append(_entropy_spans(F.col(f"_at_{cls.kind}"), cls, rank, allow))
    out = placed.withColumn("secrets", F.sort_array(F.concat(*parts)))
    return out.drop(*[f"_{x}_{k}" for x in ("found", "at") for k, _ in shapes])


def spans_text(secrets: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end, comma-joined."""
    kept = secrets if kinds is None else F.filter(secrets, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact_secrets(df: DataFrame, text: str = "text", mark: str = "[secret]", **options) -> DataFrame:
    """Replace every secret by ``mark``; overlapping spans are replaced once.  A null text stays null."""
    columns = df.columns
    scanned = scan_secrets(df, text, **options)
    # the uncovered stretches: from the furthest end so far to the next start
    reach = F.aggregate(
        F.col("secrets"),
        F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("free")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            F.when(
                (s["start"] > a["end"]) | (F.size(a["free"]) == 0),
                F.concat(a["free"], F.array(F.struct(a["end"].alias("start"), s["start"].alias("end")))),
            ).otherwise(a["free"]).alias("free"),
        ),
    )
    reached = scanned.withColumn("_reach", F.when(F.size("secrets") > 0, reach))
    length = F.length(text).cast("bigint")
    free = F.concat(F.col("_reach.free"), F.array(F.struct(F.col("_reach.end").alias("start"), length.alias("end"))))
    freed = reached.withColumn("_free", free)
    clean = F.when(F.col("_reach").isNull(), F.col(text)).otherwise(F.array_join(cut(F.col(text), F.col("_free")), mark))
    return freed.withColumn(text, clean).select(*columns)
