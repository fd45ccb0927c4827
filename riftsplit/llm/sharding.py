"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual`` points on a ring of hashes.  A row goes to the shard of the first
point clockwise from the hash of its key; a shard takes no more rows than its bound, and rows
beyond it continue clockwise to the next point whose shard has room.

The rows between two points meet the same shards in the same order, so the walk is decided on
counts: one count per arc of the ring and cell of the arc (a number set by the parameters,
whatever the number of rows).  The result says which ranks of a cell go where, and rows take
their place by their rank in the cell.  The bounds are floor(n / shards), one more for the
first n mod shards of them in ring order, so that all shards are full at the end: counts are at
most one apart (law ``rows``).

Defined results: null keys share one hash; cells also depend on the text, so one key cannot
fill a cell unless the rows are equal as a whole; equal rows are interchangeable and take
consecutive ranks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIRTUAL = 64
CELLS = 8  # cells of an arc, by the hash of the whole row
HASH_BITS = 40


def ring(shards: int, virtual: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ring points (0 to 2^HASH_BITS) and the shard of each."""
    node = np.arange(shards * virtual, dtype=np.uint64) + np.uint64(1)
    x = node * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    point = (x ^ (x >> np.uint64(31))) >> np.uint64(64 - HASH_BITS)
    order = np.lexsort((node, point))
    return point[order].astype(np.int64), ((node[order] - 1) // np.uint64(virtual)).astype(np.int64)


def capacities(rows: int, shards: int, owners: np.ndarray) -> np.ndarray:
    """Rows that each shard takes: equal but for one, the larger ones first in ring order."""
    first = np.unique(owners, return_index=True)[1]
    cap = np.full(shards, rows // shards, dtype=np.int64)
    cap[np.argsort(first, kind="stable")[: rows % shards]] += 1
    return cap


def walk(counts: np.ndarray, owners: np.ndarray, cap: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(cell, first rank, shard, first slot) pieces of the clockwise walk.

    ``counts`` has a row per arc and a column per cell.  Each round lets the rows that wait at every
    point ask its shard, in ring order; what finds no room moves to the next point.  Points of full
    shards are skipped, so there are no more rounds than points.
    """
    arcs, cells = counts.shape
    room, slot = cap.copy(), np.zeros_like(cap)
    pieces: list[tuple[int, int, int, int]] = []
    # waiting pieces of each point: [cell number, first rank, rows]
    waiting = [[[a * cells + c, 0, int(counts[a, c])] for c in range(cells) if counts[a, c]] for a in range(arcs)]
    while True:
        moved: list[list[list[int]]] = [[] for _ in range(arcs)]
        for a in range(arcs):
            s = int(owners[a])
            for cell, rank, n in waiting[a]:
                taken = min(n, int(room[s]))
                if taken:
                    pieces.append((cell, rank, s, int(slot[s])))
                    room[s] -= taken
                    slot[s] += taken
                if n > taken:
                    moved[a].append([cell, rank + taken, n - taken])
        if not any(moved):
            return pieces
        # the next point clockwise whose shard has room
        ahead = np.full(arcs, -1)
        nearest = -1
        for a in range(2 * arcs - 1, -1, -1):
            if a < arcs:
                ahead[a] = nearest
            if room[owners[a % arcs]] > 0:
                nearest = a % arcs
        waiting = [[] for _ in range(arcs)]
        for a in range(arcs):
            if moved[a]:
                waiting[int(ahead[a])].extend(moved[a])


def _bucket(x: Column, points: np.ndarray) -> Column:
    """Number of the first ring point at or after ``x`` (0 beyond the last): a lookup by the top bits, then a short scan."""
    bits = max(1, int(np.ceil(np.log2(len(points)))))
    shift = HASH_BITS - bits
    low = np.searchsorted(points, np.arange(1 << bits, dtype=np.int64) << shift)
    starts = F.array(*[F.lit(int(v)) for v in low])
    places = F.array(*[F.lit(int(p)) for p in points])
    first = F.get(starts, F.shiftright(x, shift).cast("int"))
    last = F.coalesce(F.get(starts, F.shiftright(x, shift).cast("int") + 1), F.lit(len(points)))
    beyond = F.size(F.filter(F.slice(places, first + 1, last - first), lambda p: p < x))
    return (first + beyond) % len(points)


def assign_shards(
    df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, virtual: int = VIRTUAL, cells: int = CELLS
) -> DataFrame:
    """(key, size, text_crc32, shard, slot): the shard of every row and its place there, from 0."""
    points, owners = ring(shards, virtual)
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    whole = F.xxhash64(key, text)
    rows = df.select(
        F.col(key),
        (F.octet_length(body) + 16).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(key), 64 - HASH_BITS).alias("_at"),
        whole.alias("_row"),
    ).withColumn("_cell", _bucket(F.col("_at"), points) * cells + F.pmod("_row", F.lit(cells)).cast("int"))
    counted = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()  # at most points x cells rows
    counts = np.zeros((len(points), cells), dtype=np.int64)
    for r in counted:
        counts[r["_cell"] // cells, r["_cell"] % cells] = r["n"]
    pieces = walk(counts, owners, capacities(int(counts.sum()), shards, owners))
    spark = df.sparkSession
    schema = "_cell int, _first bigint, _shard int, _slot bigint"
    # as many rows as cells and shards together at most
    plan = spark.createDataFrame(pieces, schema).groupBy("_cell").agg(
        F.sort_array(F.collect_list(F.struct("_first", "_shard", "_slot"))).alias("_pieces")
    )
    ranked = rows.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_at", "_row", "size", "text_crc32")).cast("bigint") - 1
    )
    placed = ranked.join(F.broadcast(plan), "_cell")
    mine = placed.withColumn("_mine", F.element_at(F.filter("_pieces", lambda p: p["_first"] <= F.col("_rank")), -1))
    return mine.select(
        F.col(key),
        "size",
        "text_crc32",
        F.col("_mine._shard").alias("shard"),
        (F.col("_mine._slot") + F.col("_rank") - F.col("_mine._first")).alias("slot"),
    )
