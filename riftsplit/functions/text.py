"""String expressions for item keys, fragments and token-level properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "[ \\t\\r\\n\\f]+"


def canonical_text(item: Column) -> Column:
    """Default key of a text item: blanks collapsed, ends trimmed, lower case; blank is null."""
    key = F.lower(F.trim(F.regexp_replace(item, BLANKS, " ")))
    return F.when(key != "", key)


def largest_part(item: Column, separator: str, token: str) -> Column:
    """Part of a multi-part record with most tokens, then longest, then first."""
    parts = F.split(item, separator)
    scored = F.transform(
        parts, lambda p, i: F.struct(F.regexp_count(p, F.lit(token)), F.length(p), -i, p.alias("part"))
    )
    return F.array_max(scored)["part"]


def token_properties(item: Column) -> dict[str, Column]:
    """Size-like properties countable from the string itself."""
    return {
        "n_chars": F.length(item).cast("double"),
        "n_words": F.regexp_count(item, F.lit("[A-Za-z]+")).cast("double"),
        "n_digits": F.regexp_count(item, F.lit("[0-9]")).cast("double"),
        "n_lines": (F.regexp_count(item, F.lit("\\n")) + 1).cast("double"),
    }
