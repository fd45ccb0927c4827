"""Vector compression by product codebooks, with adaptive distance bounds (after Drake and Hamerly).

A vector becomes integers ``floor(256 * x)`` and is cut into equal parts; each part position has a
codebook, and a vector is the list of its parts' nearest entries.  Every round keeps, for each part,
the ``b`` entries that come next after the assigned one with ordered lower bounds of their distances, one outer bound
for all the rest, and an upper bound of the distance to the assigned entry.  When entries move, the
bounds move with them; a part whose upper bound stays below its first lower bound keeps its entry unseen.
Otherwise the upper bound is made tight, and only the entries before the first bound beyond it
are measured, in integers, ties to the lower index; only if the outer bound is reached, all
entries are.  ``b`` starts at a quarter of the entries and falls to the largest rank that a round needed, an
eighth at least.  The bounds are written as a table after each round, so a lost executor costs one round at most.

What passes through the driver is the codebooks (parts x entries x width numbers) alone.

Defined results: a vector that is null or holds null or non-finite components is dropped, and so is
one of another length than the vector of the lowest id; null ids are coded but start no codebook; equal ids are
ordered by their vectors, and repeated rows all stay.  With fewer vectors than entries the codebooks have as
many entries as there are vectors.  Components are held to +-16,384, so that all distances are exact.  An
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftsplit.plans.durable import broadcast_if_small, stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
LIMIT = 1 << 22  # of an integer component
SLACK = 1e-6  # relative widening of a bound, for the rounding of roots and single floats
STATE = "x binary, code binary, near binary, low binary, outer binary, upper binary, most int, tested bigint"
ROWS = 2048  # rows worked on at a time


@dataclass
class Books:
    """Codebooks as integers[part, entry, position]."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two integer matrices; doubles hold them exactly under LIMIT."""
    a, b = x.astype(np.float64), c.astype(np.float64)
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.rint(d).astype(np.int64)


def _down(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK) - SLACK


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK) + SLACK


class PartBounds:
    """Assigned entries and bounds of one part position for a block of rows."""

    def __init__(self, code, near, low, outer, upper):
        self.code, self.near, self.low, self.outer, self.upper = code, near, low, outer, upper

    @classmethod
    def measured(cls, x: np.ndarray, book: np.ndarray, b: int) -> PartBounds:
        """Everything from all distances."""
        k = len(book)
        key = squared(x, book) * k + np.arange(k)  # unique: ties go to the lower index
        last = min(k, b + 2)
        if last < k:
            key = np.partition(key, last - 1, axis=1)[:, :last]
        key = np.sort(key, axis=1)
        order, far = key % k, np.sqrt((key // k).astype(np.float64))
        outer = _down(far[:, b + 1]) if last > b + 1 else np.full(len(x), np.inf)
        return cls(order[:, 0], order[:, 1 : b + 1], _down(far[:, 1 : b + 1]), outer, _up(far[:, 0]))

    def narrowed(self, b: int) -> PartBounds:
        """The same with ``b`` entries; the outer bound takes over the rest."""
        if b >= self.near.shape[1]:
            return self
        outer = np.minimum(self.outer, self.low[:, b:].min(1))
        return PartBounds(self.code, self.near[:, :b], self.low[:, :b], outer, self.upper)

    def moved(self, drift: np.ndarray) -> None:
        """Entries have moved by ``drift``."""
        self.upper = self.upper + drift[self.code]
        self.low = self.low - drift[self.near]
        self.outer = self.outer - drift.max()
        held = np.column_stack([self.low, self.outer])
        self.low = np.minimum.accumulate(held[:, ::-1], axis=1)[:, ::-1][:, :-1]

    def _reach(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many near entries may be as near as the assigned one; whether the rest may."""
        return (self.low[rows] <= self.upper[rows, None]).sum(1), self.outer[rows] <= self.upper[rows]

    def settle(self, x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, int]:
        """Assign anew after a move; (near entries needed by each row, distances computed)."""
        n, k, b = len(x), len(book), self.near.shape[1]
        need = np.zeros(n, dtype=np.int64)
        reach, all_of = self._reach(np.arange(n))
        rows = np.flatnonzero((reach > 0) | all_of)
        if not len(rows):
            return need, 0
        self.upper[rows] = _up(np.sqrt(((x[rows] - book[self.code[rows]]) ** 2).sum(1).astype(np.float64)))
        tested = len(rows)
        reach, all_of = self._reach(rows)
        need[rows] = np.where(all_of, b, reach)
        full, some = rows[all_of], rows[~all_of & (reach > 0)]
        if len(full):
            fresh = PartBounds.measured(x[full], book, b)
            for name in ("code", "near", "low", "outer", "upper"):
                getattr(self, name)[full] = getattr(fresh, name)
            tested += len(full) * k
        for m in np.unique(need[some]).tolist():
            at = some[need[some] == m]
            those = np.column_stack([self.code[at], self.near[at, :m]])
            d = ((x[at][:, None, :] - book[those]) ** 2).sum(2)
            key = np.sort(d * k + those, axis=1)
            far = np.sqrt((key // k).astype(np.float64))
            self.code[at], self.upper[at] = key[:, 0] % k, _up(far[:, 0])
            self.near[at, :m], self.low[at, :m] = key[:, 1:] % k, _down(far[:, 1:])
            tested += len(at) * m
        return need, tested


# -- state rows -----------------------------------------------------------------------


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    rows = np.ascontiguousarray(rows).reshape(len(rows), -1)
    step = rows.shape[1] * rows.itemsize
    offsets = pa.py_buffer((np.arange(len(rows) + 1) * step).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows.tobytes())])


def _matrix(column: pa.Array, dtype, *shape: int) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)
    return data.reshape(len(column), *shape)


def _pack(batch: pa.RecordBatch, x, parts: list[PartBounds], most, tested) -> pa.RecordBatch:
    stack = lambda name, dtype: _binary(np.stack([getattr(p, name) for p in parts], axis=1).astype(dtype))
    columns = [batch.column("id"), batch.column("label"), _binary(x.astype("<i4")), stack("code", np.uint8), stack("near", np.uint8), stack("low", "<f4")]
    columns += [stack("outer", "<f4"), stack("upper", "<f4"), pa.array(most, pa.int32()), pa.array(tested, pa.int64())]
    names = ["id", "label", "x", "code", "near", "low", "outer", "upper", "most", "tested"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _slices(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _first_pass(books: np.ndarray, b: int):
    """(id, label, v) to state rows, from all distances."""
    parts, k, width = books.shape

    def work(batches):
        for batch in _slices(batches):
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, parts, width)
            found = [PartBounds.measured(x[:, p], books[p], b) for p in range(parts)]
            full = np.full(batch.num_rows, parts * k)
            yield _pack(batch, x, found, np.full(batch.num_rows, b), full)

    return work


def _next_pass(before: np.ndarray, books: np.ndarray, b_before: int, b: int):
    """State rows to state rows after the codebooks changed from ``before`` to ``books``."""
    parts, k, width = books.shape
    drift = _up(np.sqrt(((books - before) ** 2).sum(2).astype(np.float64)))
    drift[(books == before).all(2)] = 0.0

    def work(batches):
        for batch in _slices(batches):
            n = batch.num_rows
            x = _matrix(batch.column("x"), "<i4", parts, width).astype(np.int64)
            code, near = (_matrix(batch.column(c), np.uint8, parts, *s).astype(np.int64) for c, s in (("code", ()), ("near", (b_before,))))
            low = _matrix(batch.column("low"), "<f4", parts, b_before).astype(np.float64)
            outer, upper = (_matrix(batch.column(c), "<f4", parts).astype(np.float64) for c in ("outer", "upper"))
            most, tested, found = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), []
            for p in range(parts):
                part = PartBounds(code[:, p].copy(), near[:, p].copy(), _down(low[:, p]), _down(outer[:, p]), _up(upper[:, p])).narrowed(b)
                part.near = part.near.copy()
                part.moved(drift[p])
                need, measured = part.settle(x[:, p], books[p])
                most = np.maximum(most, need)
                tested[0] += measured  # of the whole block
                found.append(part)
            yield _pack(batch, x, found, most, tested)

    return work


def _summer(parts: int, k: int, width: int):
    """State rows to one row per part and used entry of a partition: how many parts, and their sums."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

    def work(batches):
        n, sums = np.zeros((parts, k), dtype=np.int64), np.zeros((parts, k, width), dtype=np.int64)
        for batch in _slices(batches):
            x = _matrix(batch.column("x"), "<i4", parts, width).astype(np.int64)
            code = _matrix(batch.column("code"), np.uint8, parts)
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=k)
                np.add.at(sums[p], code[:, p], x[:, p])
        part, entry = np.nonzero(n)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return work


def _updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks of the means of their parts, down to integers; unused entries stay."""
    parts, k, width = books.shape
    rows = state.select("x", "code").mapInArrow(_summer(parts, k, width), "part int, entry int, n bigint, s array<bigint>")
    sums = [F.sum(F.get("s", i)).alias(f"s{i}") for i in range(width)]
    out = books.copy()
    for r in rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():  # parts x entries rows at most
        out[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def _last_pass(books: np.ndarray):
    """State rows to (vec_id, label, code, error)."""
    parts, _, width = books.shape
    names = ["vec_id", "label", "code", "error"]

    def work(batches):
        for batch in _slices(batches):
            x = _matrix(batch.column("x"), "<i4", parts, width).astype(np.int64)
            code = _matrix(batch.column("code"), np.uint8, parts)
            error = sum(((x[:, p] - books[p][code[:, p]]) ** 2).sum(1) for p in range(parts))
            text = pa.array([c.hex() for c in batch.column("code").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), text, pa.array(error, pa.int64())], names=names)

    return work


@dataclass
class Compressed:
    """``rows``: (vec_id, label, code, error); ``measured``: distances computed in each pass over the state."""

    rows: DataFrame
    books: Books
    measured: list[int]
    widths: list[int]


def usable_vectors(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(id, label, v) with integer components, for the vectors that are whole."""
    good = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    top = F.lit(float(LIMIT))
    whole = lambda x: F.floor(F.greatest(-top, F.least(top, x.cast("double") * SCALE))).cast("bigint")
    return df.filter(good).select(F.col(vec_id).cast("bigint").alias("id"), F.col(label).alias("label"), F.transform(vector, whole).alias("v"))


def compress(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> Compressed:
    """Codes of all whole vectors and the codebooks they were made with."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    kept = usable_vectors(df, vec_id, vector, label)
    first = lambda rows: rows.filter("id IS NOT NULL").select("id", "v").orderBy("id", "v").limit(entries).collect()
    seeds = first(kept)
    length = len(seeds[0]["v"]) if seeds else 0
    kept = kept.filter(F.size("v") == length)
    if any(len(s["v"]) != length for s in seeds):
        seeds = first(kept)
    if length % parts or length // parts > 128:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts of at most 128")
    if not length:
        empty = kept.filter("false").select(F.col("id").alias("vec_id"), "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return Compressed(empty, Books(np.zeros((parts, 0, 0), dtype=np.int64)), [], [])
    books = np.array([s["v"] for s in seeds], dtype=np.int64).reshape(len(seeds), parts, length // parts).transpose(1, 0, 2)
    k = books.shape[1]
    b = min(max(1, k // 4), max(0, k - 1))
    kind = kept.schema["label"].dataType.simpleString()
    schema = f"id bigint, label {kind}, {STATE}"
    state = stored(kept.mapInArrow(_first_pass(books, b), schema))
    measured, widths = [], [b]
    for _ in range(rounds):
        before, books = books, _updated(state, books)
        state = stored(state.mapInArrow(_next_pass(before, books, widths[-1], b), schema))
        widths.append(b)
        told = state.agg(F.max("most").alias("most"), F.sum("tested").alias("tested")).first()
        measured.append(int(told["tested"] or 0))
        b = max(min(k // 8, b), min(b, int(told["most"] or 0)))
    coded = state.select("id", "label", "x", "code").mapInArrow(_last_pass(books), f"vec_id bigint, label {kind}, code string, error bigint")
    return Compressed(coded, Books(books), measured, widths)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``: the errors summed over equal labels, nulls together."""
    coded = stored(coded)
    sums = stored(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    return coded.join(broadcast_if_small(sums, 64), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
