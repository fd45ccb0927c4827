"""Bit-set fingerprints as sorted integer arrays, and set similarity on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

# Widths used on purpose for two jobs: clustering and auditing.
CLUSTER_BITS = 1024
AUDIT_BITS = 2048
# Multiplier of the rolling q-gram hash.
HASH_BASE = 31
SLICE_ROWS = 128  # texts hashed at a time, at most
SLICE_CHARS = 1 << 18  # characters of a slice; a longer text is hashed piece by piece


def slice_pieces(texts: list[str], q: int, chars: int):
    """Lists of (row, piece) of at most ``SLICE_ROWS`` pieces and ``chars`` characters; pieces of one text overlap by q - 1, so no gram is lost."""
    batch, size = [], 0
    for row, text in enumerate(texts):
        for start in range(0, max(1, len(text) - q + 1), chars):
            piece = text[start : start + chars + q - 1]
            if batch and (len(batch) == SLICE_ROWS or size + len(piece) > chars + q - 1):
                yield batch
                batch, size = [], 0
            batch.append((row, piece))
            size += len(piece)
    if batch:
        yield batch


def fingerprints(items: pd.Series, q: int, n_bits: int) -> pd.Series:
    """Sorted bits of every text; the texts of a slice lie one after the other in one array of code points."""
    powers = [HASH_BASE ** (q - 1 - j) for j in range(q)]
    out = [None] * len(items)
    for batch in slice_pieces([t or "" for t in items], q, SLICE_CHARS):
        codes = np.frombuffer("".join(t for _, t in batch).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        row = np.repeat(np.arange(len(batch)), [len(t) for _, t in batch])
        n = max(0, len(codes) - q + 1)
        hashed = sum(w * codes[j : j + n] for j, w in enumerate(powers)) % n_bits
        inside = row[:n] == row[q - 1 : q - 1 + n]  # no gram spans two texts
        seen = np.zeros(len(batch) * n_bits, dtype=bool)
        seen[row[:n][inside] * n_bits + hashed[inside]] = True
        found = np.flatnonzero(seen)
        at = np.searchsorted(found, np.arange(len(batch) + 1) * n_bits)
        bits = (found % n_bits).astype(np.int32)
        for (i, _), lo, hi in zip(batch, at[:-1].tolist(), at[1:].tolist(), strict=True):
            # a copy, so that no result keeps its whole slice; a text in several pieces has the bits of all of them
            out[i] = bits[lo:hi].copy() if out[i] is None else np.union1d(out[i], bits[lo:hi])
    return pd.Series(out, dtype=object)


def shingle_fingerprint(item: Column, q: int = 4, n_bits: int = CLUSTER_BITS, on_invalid: str = "empty") -> Column:
    """Distinct character q-grams hashed to ``n_bits`` positions, sorted.

    The rolling hash runs as whole-array arithmetic on Arrow batches: measured, higher-order
    SQL functions over single characters are some fifty times slower.  A null item gives an
    empty set, or an error with ``on_invalid='raise'``.
    """
    if on_invalid not in ("empty", "raise"):
        raise ValueError("on_invalid must be 'empty' or 'raise'")

    @F.pandas_udf(ArrayType(IntegerType()))
    def fingerprint(items: pd.Series) -> pd.Series:
        return fingerprints(items, q, n_bits)

    if on_invalid == "raise":
        item = F.when(item.isNull(), F.raise_error("item without a fingerprint").cast("string")).otherwise(item)
    return fingerprint(item)


def sign_bits(vector: Column) -> Column:
    """Positions (0-based) of the positive entries of a dense vector."""
    indexed = F.transform(vector, lambda v, i: F.when(v > 0, i))
    return F.filter(indexed, lambda i: i.isNotNull())


def tanimoto(a: Column, b: Column) -> Column:
    """Shared bits over all bits of two sets; 0 when both are empty."""
    inter = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - inter
    return F.coalesce(inter / F.nullif(union, F.lit(0.0)), F.lit(0.0))


def packed(bits: Column, n_bits: int) -> Column:
    """Pack a bit set into 32-bit words held as bigint, for popcount similarity."""
    words = F.sequence(F.lit(0), F.lit((n_bits + 31) // 32 - 1))

    def word(w: Column) -> Column:
        mine = F.filter(bits, lambda b: F.floor(b / F.lit(32)) == w)
        return F.aggregate(
            mine,
            F.lit(0).cast("long"),
            lambda acc, b: acc.bitwiseOR(F.pow(F.lit(2.0), F.pmod(b, F.lit(32))).cast("long")),
        )

    return F.transform(words, word)


def tanimoto_packed(a: Column, b: Column) -> Column:
    """The same similarity on packed words."""
    both = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)))
    either = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y)))
    zero = F.lit(0)
    inter = F.aggregate(both, zero, lambda s, v: s + v).cast("double")
    union = F.aggregate(either, zero, lambda s, v: s + v).cast("double")
    return F.coalesce(inter / F.nullif(union, F.lit(0.0)), F.lit(0.0))
