"""Block grids for exact all-pairs work, and posting lists for threshold joins.

Rows are hashed into blocks of bounded size; a block pair is the shuffle key and
a NumPy kernel runs inside it.  No pair is built before the kernel has decided
that it belongs to the result (a threshold, a top-k, or the full matrix when
the matrix itself is what was asked for).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftsplit.plans.durable import join_bounded

ROWS_PER_BLOCK = 1024


# -- kernels: (A, B) -> matrix ------------------------------------------------


def _euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    twice = a @ b.T
    twice *= 2.0
    sq -= twice
    return np.sqrt(np.maximum(sq, 0.0, out=sq), out=sq)


def _cityblock(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += np.abs(a[:, j][:, None] - b[:, j][None, :])
    return out


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return 1.0 - np.divide(a @ b.T, norm, out=np.zeros(norm.shape), where=norm > 0)


def _jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    inter = (a @ b.T).astype(np.float64)
    union = a.sum(1, dtype=np.float64)[:, None] + b.sum(1, dtype=np.float64)[None, :]
    union -= inter
    np.maximum(union, 1.0, out=union)  # two empty sets share nothing
    inter /= union
    return np.subtract(1.0, inter, out=inter)


METRICS: dict[str, Callable] = {
    "euclidean": _euclidean,
    "cityblock": _cityblock,
    "cosine": _cosine,
    "jaccard": _jaccard,
}


def register_metric(name: str, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Add a distance: a function of two row matrices giving the distance matrix."""
    METRICS[name] = kernel


def dense_rows(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64) if len(values) else np.zeros((0, 0))


def bit_rows(values: pd.Series, n_bits: int) -> np.ndarray:
    """0/1 float32 matrix of a column of bit positions."""
    out = np.zeros((len(values), n_bits), dtype=np.float32)
    sizes = [len(v) for v in values]
    if sum(sizes):
        out[np.repeat(np.arange(len(values)), sizes), np.concatenate(list(values)).astype(np.int64)] = 1.0
    return out


# -- block assignment ---------------------------------------------------------


def _block(row_id: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(row_id)), blocks).cast("int")


def block_rows(rows_per_block: int, width: int | None) -> int:
    """Rows per block such that one 0/1 matrix of a block stays within 128 MB."""
    return rows_per_block if not width else max(64, min(rows_per_block, (1 << 25) // width))


def n_blocks(n: int, rows_per_block: int) -> int:
    return max(1, -(-n // rows_per_block))


def self_grid(df: DataFrame, row_id: str, rows_per_block: int, by: list[str] | None = None) -> DataFrame:
    """Rows repeated to every unordered block pair (bi <= bj) they take part in.

    With ``by`` the blocks are made per group, more of them for a larger group.
    """
    if by:
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_c"))
        sizes = sizes.select(*by, F.ceil(F.col("_c") / F.lit(rows_per_block)).cast("int").alias("_n"))
        df = join_bounded(df, sizes, by, "inner")
    else:
        df = df.withColumn("_n", F.lit(n_blocks(df.count(), rows_per_block)))
    own = df.withColumn("_b", _block(row_id, F.col("_n")))
    own = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return own.withColumns({"bi": F.least("_b", "_o"), "bj": F.greatest("_b", "_o")}).drop("_o", "_n")


# Most rows of a block of a whole matrix (a task sorts 300 MB of its pairs), and the blocks of a smaller matrix, unless they
# would fall below ``ROWS_PER_BLOCK``.
ROWS_PER_MATRIX_BLOCK = 6 * ROWS_PER_BLOCK
LEAST_BLOCKS = 8
# Left rows of a tile of a block pair, and pairs of a batch that leaves the task.
MATRIX_TILE = 256
PAIRS_PER_BATCH = 1 << 18


def _counts(d: np.ndarray, digits: int) -> np.ndarray:
    """Distances in units of the last decimal place, halves away from zero as in SQL."""
    return np.copysign(np.floor(np.abs(d) * 10.0**digits + 0.5), d) + 0.0


def rounded_in_task(d: np.ndarray, digits: int | None) -> np.ndarray:
    return d if digits is None else _counts(d, digits) / 10.0**digits


def _sorted_keys(x: np.ndarray, y: np.ndarray, kernel: Callable, keep: Callable, digits: int) -> np.ndarray | None:
    """The kept pairs of a block pair in rising distance: units, row and column packed into a number; None if they do not fit."""
    rows, columns = len(x).bit_length(), len(y).bit_length()
    keys, n = np.empty(len(x) * len(y), dtype=np.uint64), 0
    for start in range(0, len(x), MATRIX_TILE):
        units = _counts(kernel(x[start : start + MATRIX_TILE], y), digits)
        if not (units.min() >= 0 and units.max() < 2.0 ** (64 - rows - columns)):
            return None
        at = (np.arange(start, start + len(units), dtype=np.uint64)[:, None] << np.uint64(columns)) | np.arange(len(y), dtype=np.uint64)
        some = ((units.astype(np.uint64) << np.uint64(rows + columns)) | at)[keep(start, len(units))]
        keys[n : n + len(some)] = some
        n += len(some)
    keys[:n].sort()
    return keys[:n]


def all_pairs(
    df: DataFrame,
    row_id: str,
    vector: str,
    metric: str = "euclidean",
    n_bits: int | None = None,
    rows_per_block: int | None = None,
    digits: int | None = None,
) -> DataFrame:
    """(i, j, distance) for every i < j: the distance matrix, stored once.

    The output is quadratic because the matrix is what was asked for; it is computed by block pairs of bounded size, which leave
    the task in batches.  With ``digits`` distances are rounded there, and those of dense vectors leave a block pair in rising order:
    equal ones then follow each other, and a column format stores them in a fraction of the bytes.
    """
    kernel = METRICS[metric]
    if rows_per_block is None:
        rows_per_block = min(ROWS_PER_MATRIX_BLOCK, max(ROWS_PER_BLOCK, -(-df.count() // LEAST_BLOCKS)))
    rows_per_block = block_rows(rows_per_block, n_bits)
    in_order = digits is not None and metric != "jaccard"  # sets have few different distances, in any order
    placed = self_grid(df.select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).alias("vec")), "id", rows_per_block)

    def batch(i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        values = [np.minimum(i, j), np.maximum(i, j), distance]
        return pa.RecordBatch.from_arrays([pa.array(v, from_pandas=False) for v in values], names=["i", "j", "distance"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        bi, bj = (table.column(c)[0].as_py() for c in ("bi", "bj"))
        block = table.column("_b").to_numpy()
        left, right = (table.filter(pa.array(block == v)) for v in (bi, bj))
        a, b = left.column("id").to_numpy(), right.column("id").to_numpy()
        if not (len(a) and len(b)):
            return
        x, y = (vector_matrix(t.column("vec"), metric, n_bits) for t in (left, right))

        def keep(start: int, n: int) -> np.ndarray:
            return (a[start : start + n, None] < b[None, :]) if bi == bj else np.ones((n, len(b)), dtype=bool)

        keys = _sorted_keys(x, y, kernel, keep, digits) if in_order else None
        if keys is not None:
            rows, columns = len(x).bit_length(), len(y).bit_length()
            for start in range(0, len(keys), PAIRS_PER_BATCH):
                some = keys[start : start + PAIRS_PER_BATCH]
                r = (some >> np.uint64(columns)) & np.uint64((1 << rows) - 1)
                c = some & np.uint64((1 << columns) - 1)
                units = (some >> np.uint64(rows + columns)).astype(np.float64)
                yield batch(a[r.astype(np.int64)], b[c.astype(np.int64)], units / 10.0**digits)
            return
        for start in range(0, len(x), MATRIX_TILE):
            d = kernel(x[start : start + MATRIX_TILE], y)
            r, c = np.nonzero(keep(start, len(d)))
            yield batch(a[start + r], b[c], rounded_in_task(d[r, c].astype(np.float64), digits))

    return placed.groupBy("bi", "bj").applyInArrow(pairs, "i bigint, j bigint, distance double")


def cross_grid(
    left: DataFrame, right: DataFrame, by: list[str], lid: str, rid: str, rows_per_block: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides repeated over the other's blocks, within ``by`` groups.

    A hot group gets more blocks in proportion to its rows, so no task grows with it.
    """
    if not by:
        nl, nr = n_blocks(left.count(), rows_per_block), n_blocks(right.count(), rows_per_block)
        left = left.withColumns({"_nl": F.lit(nl), "_nr": F.lit(nr)})
        right = right.withColumns({"_nl": F.lit(nl), "_nr": F.lit(nr)})
    else:
        blocks = lambda c: F.ceil(F.col(c) / F.lit(rows_per_block)).cast("int")
        nl = left.groupBy(*by).agg(F.count(F.lit(1)).alias("_cl"))
        nr = right.groupBy(*by).agg(F.count(F.lit(1)).alias("_cr"))
        sizes = nl.join(nr, by).select(*by, blocks("_cl").alias("_nl"), blocks("_cr").alias("_nr"))
        left, right = join_bounded(left, sizes, by, "inner"), join_bounded(right, sizes, by, "inner")
    left = left.withColumns({"bl": _block(lid, F.col("_nl")), "br": F.explode(F.sequence(F.lit(0), F.col("_nr") - 1))})
    right = right.withColumns(
        {"br": _block(rid, F.col("_nr")), "bl": F.explode(F.sequence(F.lit(0), F.col("_nl") - 1))}
    )
    return left.drop("_nl", "_nr"), right.drop("_nl", "_nr")


# Left rows whose distances to a whole right block are held at a time.
ROWS_PER_TILE = 32


def vector_matrix(column: pa.ChunkedArray, metric: str, n_bits: int | None) -> np.ndarray:
    """Row matrix of an Arrow column: 0/1 of bit positions, or dense vectors of one length."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if metric == "jaccard":
        out = np.zeros((len(lists), n_bits), dtype=np.float32)
        out[np.repeat(np.arange(len(lists)), np.nan_to_num(sizes).astype(np.int64)), flat.astype(np.int64)] = 1.0
        return out
    if len(lists) and not (sizes == sizes[0]).all():
        raise ValueError("vectors must not be null and must have one length")
    return flat.astype(np.float64).reshape(len(lists), -1 if len(lists) else 0)


def nearest_columns(d: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k least entries of each row, the first columns among equals; all of them without k."""
    if k is None or k >= d.shape[1]:
        return np.repeat(np.arange(len(d)), d.shape[1]), np.tile(np.arange(d.shape[1]), len(d))
    if k == 1:
        return np.arange(len(d)), d.argmin(1)
    last = np.partition(d, k - 1, axis=1)[:, k - 1]
    r, c = np.nonzero(~(d > last[:, None]))  # more than k where equals stand at the end
    order = np.lexsort((c, d[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, np.arange(len(d)))
    keep = np.arange(len(r)) - first[r] < k
    return r[keep], c[keep]


def cross_blocks(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    metric: str,
    n_bits: int | None,
    k: int | None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Distances of ``left(by, id, vec)`` to ``right(by, id, vec)``.

    With ``k`` each block pair gives only the k nearest right rows of each left row
    (ties by id), to be merged by the caller; without it the whole matrix.
    """
    kernel = METRICS[metric]
    rows_per_block = block_rows(rows_per_block, n_bits)
    # fresh column identities, so that both sides may come from one table
    fresh = [F.col(c).alias(c) for c in [*by, "vec"]]
    left = left.select(*fresh, F.col("id").cast("bigint").alias("lid"))
    right = right.select(*fresh, F.col("id").cast("bigint").alias("rid"))
    left, right = cross_grid(left, right, by, "lid", "rid", rows_per_block)
    types = dict(left.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in by] + ["lid bigint", "rid bigint", "distance double"])

    def pairs(ltab: pa.Table, rtab: pa.Table) -> pa.Table:
        rtab = rtab.sort_by("rid")
        a, b = ltab.column("lid").to_numpy(), rtab.column("rid").to_numpy()
        found = []
        if len(a) and len(b):
            x, y = (vector_matrix(t.column("vec"), metric, n_bits) for t in (ltab, rtab))
            for start in range(0, len(a), ROWS_PER_TILE):
                d = kernel(x[start : start + ROWS_PER_TILE], y)
                r, c = nearest_columns(d, k)
                found.append((a[r + start], b[c], d[r, c].astype(np.float64)))
        lid, rid, distance = (np.concatenate(v) for v in zip(*found, strict=True)) if found else ([], [], [])
        here = ltab if len(a) else rtab
        keys = [here.column(c).take(pa.array(np.zeros(len(lid), dtype=np.int64))) for c in by]
        values = [pa.array(lid, pa.int64()), pa.array(rid, pa.int64()), pa.array(distance, pa.float64(), from_pandas=False)]
        return pa.Table.from_arrays([*keys, *values], names=[*by, "lid", "rid", "distance"])

    keys = [*by, "bl", "br"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pairs, schema)


def matrix_profile(
    df: DataFrame, row_id: str, vector: str, metric: str = "euclidean", n_bits: int | None = None, rows_per_block: int = 4 * ROWS_PER_BLOCK
) -> DataFrame:
    """(n_pairs, lo, hi) of each block pair of the distance matrix: the distances stay in the tasks."""
    kernel = METRICS[metric]
    rows_per_block = block_rows(rows_per_block, n_bits)
    placed = self_grid(df.select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).alias("vec")), "id", rows_per_block)
    schema = pa.schema([("n_pairs", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64())])

    def profile(table: pa.Table) -> pa.Table:
        bi, bj = (table.column(c)[0].as_py() for c in ("bi", "bj"))
        block = table.column("_b").to_numpy()
        left, right = (table.filter(pa.array(block == v)) for v in (bi, bj))
        a, b = left.column("id").to_numpy(), right.column("id").to_numpy()
        n, lo, hi = 0, None, None
        if len(a) and len(b):
            x, y = (vector_matrix(t.column("vec"), metric, n_bits) for t in (left, right))
            for start in range(0, len(a), ROWS_PER_TILE):
                d = kernel(x[start : start + ROWS_PER_TILE], y)
                if bi == bj:
                    d = d[a[start : start + ROWS_PER_TILE, None] < b[None, :]]
                if d.size:
                    n += d.size
                    lo, hi = (v if u is None else f(u, v) for f, u, v in ((min, lo, float(d.min())), (max, hi, float(d.max()))))
        return pa.Table.from_arrays([pa.array([n], pa.int64()), pa.array([lo], pa.float64()), pa.array([hi], pa.float64())], schema=schema)

    return placed.groupBy("bi", "bj").applyInArrow(profile, "n_pairs bigint, lo double, hi double")
