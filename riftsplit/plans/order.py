"""Total orders without a one-partition window.

* ``seeded_key``      reproducible pseudo-random order (md5 of seed, split and id)
* ``take_by_hash``    the k smallest keys per group, without sorting the data
* ``kth_key``         the k-th row of a value order, sorting only a narrow bracket
* ``global_rank``     1-based rank over the whole table
* ``running_totals``  prefix sums per group, with hot groups spread over many tasks
* ``percentiles``     exact interpolated percentiles per group on top of it
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from riftsplit.plans.durable import durable, join_bounded

PREFIX_DIGITS = 3  # 16**3 = 4096 hash buckets


def seeded_key(seed: int, split: Column, *cols: Column) -> Column:
    """md5 hex of ``seed:split:col...``; equal in any engine that has md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), split.cast("string"), *[c.cast("string") for c in cols]))


def with_splits(df: DataFrame, n_splits: int) -> DataFrame:
    """One copy of each row per split index."""
    if n_splits < 1:
        raise ValueError("n_splits must be at least 1")
    return df.withColumn("split_index", F.explode(F.lit(list(range(n_splits)))))


def size_column(size: float | int, n: Column, up: bool) -> Column:
    """Fraction or absolute count to a row count: test sizes round up, train sizes down."""
    if isinstance(size, bool) or size < 0 or (isinstance(size, float) and size > 1):
        raise ValueError(f"invalid size {size!r}")
    if isinstance(size, int):
        return F.least(F.lit(size).cast("long"), n)
    part = F.lit(float(size)) * n
    return (F.ceil(part) if up else F.floor(part)).cast("long")


def test_train_quota(n: Column, test_size, train_size) -> tuple[Column, Column]:
    """(rows of test, rows of test + train); what is beyond both is left out."""
    if test_size is None and train_size is None:
        test_size = 0.2
    if test_size is None:
        train = size_column(train_size, n, up=False)
        return n - train, n
    test = size_column(test_size, n, up=True)
    if train_size is None:
        return test, n
    return test, F.least(n, test + size_column(train_size, n, up=False))


def hash_cuts(keyed: DataFrame, by: list[str], quotas: dict[str, Column] | DataFrame, bounded: bool) -> DataFrame:
    """Key of the k-th smallest ``_key`` per group, for each named quota k.

    A histogram over the first hash digits (4,096 rows per group, combined on the
    map side) tells in which bucket the k-th key lies; only that bucket, 1/4096 of
    the group, is then ranked.  ``quotas`` are columns over ``_n`` (rows of the
    group) or a table ``by + names``.  ``bounded`` says that the number of groups
    is fixed by a parameter, so the result may be broadcast unchecked.
    """
    prefix = F.substring("_key", 1, PREFIX_DIGITS)
    group = Window.partitionBy(*by)
    run = group.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = keyed.groupBy(*by, prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    hist = hist.select(*by, "_p", "_c", F.sum("_c").over(run).alias("_cum"), F.sum("_c").over(group).alias("_n"))
    if isinstance(quotas, DataFrame):
        names = [c for c in quotas.columns if c not in by]
        hist = hist.join(quotas, by)
    else:
        names = list(quotas)
        hist = hist.select("*", *[q.cast("long").alias(name) for name, q in quotas.items()])
    local = F.col("_cum") - F.col("_c")
    cuts = F.array(*[F.struct(F.lit(m).alias("cut"), (F.col(m) - local).alias("k")) for m in names])
    edge = (
        hist.select(*by, "_p", "_c", F.explode(cuts).alias("_q"))
        .filter("_q.k between 1 and _c")
        .select(*by, "_p", F.col("_q.cut").alias("_cut"), F.col("_q.k").alias("_k"))
    )
    slim = keyed.select(*by, "_key", prefix.alias("_p"))
    if bounded:
        inside = slim.join(F.broadcast(edge), [*by, "_p"])
    else:
        inside = join_bounded(slim, edge, [*by, "_p"], "inner")
    order = Window.partitionBy(*by, "_cut").orderBy("_key")
    at = inside.withColumn("_r", F.row_number().over(order)).filter("_r = _k")
    return at.groupBy(*by).agg(*[F.max(F.when(F.col("_cut") == m, F.col("_key"))).alias(m) for m in names])


def take_by_hash(
    keyed: DataFrame,
    by: list[str],
    quotas: dict[str, Column] | DataFrame,
    rest: str,
    cut_keys: DataFrame | None = None,
    bounded: bool = True,
) -> DataFrame:
    """Label rows by where their key falls between the cuts; rows are not shuffled.

    ``quotas`` are cumulative and in order: the first name gets the smallest keys.
    ``cut_keys`` is the table on which the cuts are computed when it is not the row
    table itself (distinct groups instead of rows).
    """
    cuts = hash_cuts(keyed if cut_keys is None else cut_keys, by, quotas, bounded)
    names = [c for c in cuts.columns if c not in by]
    if bounded:
        joined = keyed.join(F.broadcast(cuts), by, "left")
    else:
        joined = join_bounded(keyed, cuts, by)
    label = None
    for name in names:
        hit = F.col("_key") <= F.col(name)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return joined.withColumn("set", label.otherwise(rest)).drop(*names)


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def global_rank(df: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """1-based rank by ``keys`` (a total order) over the whole table.

    One range shuffle on the full composite key, so that ties on a hot value are
    spread by the tie-breaker; positions are frozen by a checkpoint, and one
    offset per partition is added.
    """
    placed = durable(
        df.repartitionByRange(_partitions(df), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_piece", F.shiftright("_at", 33))
    before = Window.partitionBy(F.lit(0)).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_piece").agg(F.count(F.lit(1)).alias("_c"))
    offsets = offsets.select("_piece", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # offsets has one row per partition, so it is safe to broadcast
    return (
        placed.join(F.broadcast(offsets), "_piece")
        .withColumn(name, F.col("_before") + inside + F.lit(1))
        .drop("_piece", "_at", "_before")
    )


def kth_key(df: DataFrame, value: Column, row_id: Column, k: int, n: int):
    """(value, id) of the k-th smallest row by (value, id), nulls first, or None when k is 0.

    For numbers a sketch of their doubles brackets the value, one count places the bracket, and only the rows
    inside it are sorted; casting keeps the order, and rows with one double are in the bracket together, so
    whole numbers and decimals are compared as they are.  Other types are ranked as a whole.
    """
    if k <= 0:
        return None
    rows = df.select(value.alias("_value"), row_id.alias("_id"))
    order = [F.asc_nulls_first("_value"), F.col("_id")]
    if not isinstance(rows.schema["_value"].dataType, NumericType):
        hit = global_rank(rows, order).filter(F.col("rank") == k).first()
        return hit["_value"], hit["_id"]
    rows = rows.withColumn("_v", F.coalesce(F.col("_value").cast("double"), F.lit(float("-inf"))))
    eps, p = 0.002, k / n
    grid = [max(0.0, p - eps), min(1.0, p + eps)]
    lo, hi = rows.agg(F.percentile_approx("_v", grid, 10_000).alias("q")).first()["q"]
    below, upto = rows.agg(F.count_if(F.col("_v") < lo), F.count_if(F.col("_v") <= hi)).first()
    if not below < k <= upto:  # the sketch missed: sort everything
        lo, hi, below = float("-inf"), float("inf"), 0
    bracket = rows.filter(F.col("_v").between(lo, hi) | F.isnan("_v"))
    hit = global_rank(bracket, order).filter(F.col("rank") == k - below).first()
    return hit["_value"], hit["_id"]


def at_or_before(value: Column, row_id: Column, key) -> Column:
    """True for rows not after ``key`` in the (value, id) order, nulls first."""
    if key is None:
        return F.lit(False)
    earlier = F.lit(False) if key[0] is None else value.isNull() | (value < F.lit(key[0]))
    same = value.isNull() if key[0] is None else value == F.lit(key[0])
    return F.coalesce(earlier | (same & (row_id <= F.lit(key[1]))), F.lit(False))


def running_totals(
    df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str], totals: dict[str, str] | None = None
) -> DataFrame:
    """Inclusive prefix sums ``{new: column}`` per group in a total order, and group totals.

    Rows are range-partitioned on group and order together, so a hot group spans
    many partitions; each piece is summed alone and the totals of the group's
    earlier pieces (one row per piece and group) are added.  The input is read once.
    """
    totals = totals or {}
    by = by or ["_all"]
    if by == ["_all"]:
        df = df.withColumn("_all", F.lit(0))
    keys = [F.col(c) for c in by] + order
    placed = durable(df.repartitionByRange(_partitions(df), *keys).withColumn("_piece", F.spark_partition_id()))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    needed = {**{f"_t_{n}": c for n, c in sums.items()}, **{f"_g_{n}": c for n, c in totals.items()}}
    pieces = placed.groupBy(*by, "_piece").agg(*[F.sum(c).alias(n) for n, c in needed.items()])
    pieces = pieces.select(
        *by,
        "_piece",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_g_{n}").over(group).alias(n) for n in totals],
    )
    inside = Window.partitionBy(*by, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select("*", *[F.sum(c).over(inside).alias(f"_l_{n}") for n, c in sums.items()])
    joined = local.join(pieces, [*by, "_piece"])
    extra = ["_piece", "_all"] + [f"_{t}_{n}" for n in sums for t in "lo"]
    return joined.withColumns({n: F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in sums}).drop(*extra)


def percentiles(df: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation per group, nulls left out.

    Works on counts per distinct value, so neither a hot value nor a hot group is
    held in one aggregation buffer.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    cum = running_totals(counts, by, [F.col(value)], {"_cum": "_c"}, {"_n": "_c"})
    picks = []
    for name, p in ps.items():
        h = F.lit(float(p)) * (F.col("_n") - 1)
        picks.append(F.min(F.when(F.col("_cum") > F.floor(h), F.col(value).cast("double"))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(F.col("_cum") > F.ceil(h), F.col(value).cast("double"))).alias(f"_hi_{name}"))
    grouped = cum.groupBy(*by).agg(F.max("_n").alias("_n"), *picks)
    out = []
    for name, p in ps.items():
        h = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return grouped.select(*by, *out)
