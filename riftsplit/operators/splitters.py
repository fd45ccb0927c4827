"""Splitters that need no similarity graph: random, stratified, grouped, sorted, packed.

Every splitter returns the assignment table ``(split_index, id, set)`` with all its
splits in one plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftsplit.operators.graph import pack_first_fit
from riftsplit.plans.durable import durable, join_bounded
from riftsplit.plans.order import (
    at_or_before,
    kth_key,
    seeded_key,
    size_column,
    take_by_hash,
    test_train_quota,
    with_splits,
)

BY_SPLIT = ["split_index"]


def _out(df: DataFrame) -> DataFrame:
    return df.select("split_index", "id", "set")


def _test_train_cuts(test_size, train_size) -> tuple[dict[str, Column], str]:
    """Cuts of the seeded order, and what lies beyond them: train, unless train has a size of its own."""
    test, upto = test_train_quota(F.col("_n"), test_size, train_size)
    if train_size is None or test_size is None:
        return {"test": test}, "train"
    return {"test": test, "train": upto}, "discard"


def _check_fractions(*fractions: float) -> None:
    if any(not 0 <= f <= 1 for f in fractions) or not math.isclose(sum(fractions), 1.0, abs_tol=1e-9):
        raise ValueError(f"fractions must lie in [0, 1] and sum to 1, got {fractions}")


def random_split(df, row_id="id", n_splits=5, test_size=None, train_size=None, seed=0) -> DataFrame:
    """Shuffle splits: the smallest seeded keys form the test set."""
    keyed = with_splits(df.select(F.col(row_id).alias("id")), n_splits)
    keyed = keyed.withColumn("_key", seeded_key(seed, F.col("split_index"), F.col("id")))
    return _out(take_by_hash(keyed, BY_SPLIT, *_test_train_cuts(test_size, train_size)))


def random_three_way(df, row_id="id", ratio=(0.8, 0.1, 0.1), seed=1234) -> DataFrame:
    """Train/val/test by two cuts; the second fraction is taken of the remainder as it stands."""
    _check_fractions(*ratio)
    keyed = with_splits(df.select(F.col(row_id).alias("id")), 1)
    keyed = keyed.withColumn("_key", seeded_key(seed, F.lit(0), F.col("id")))
    n = F.col("_n")
    test = size_column(float(ratio[2]), n, up=True)
    val = test + F.ceil(F.lit(float(ratio[1])) * (n - test)).cast("long")
    return _out(take_by_hash(keyed, BY_SPLIT, {"test": test, "val": val}, "train"))


def _class_shares(sizes: DataFrame, fraction: float) -> DataFrame:
    """Rows per class to draw: floors, then the largest remainders up to the rounded-up total.

    ``sizes`` is (label, n): one row per class.
    """
    everything = Window.partitionBy(F.lit(0))
    share = F.lit(float(fraction)) * F.col("n")
    based = sizes.withColumns({"_floor": F.floor(share), "_frac": F.round(share - F.floor(share), 9)})
    based = based.withColumn("_short", F.ceil(F.lit(float(fraction)) * F.sum("n").over(everything)) - F.sum("_floor").over(everything))
    order = everything.orderBy(F.desc("_frac"), "label")
    extra = F.when(F.row_number().over(order) <= F.col("_short"), 1).otherwise(0)
    return based.select("label", "n", (F.col("_floor") + extra).cast("bigint").alias("take"))


def stratified_three_way(df, row_id, label, fractions=(0.8, 0.1, 0.1), seed=0) -> DataFrame:
    """Train/val/test with the class shares kept; val is rescaled to the remainder."""
    _check_fractions(*fractions)
    train, val, test = (float(f) for f in fractions)
    if label not in df.columns:
        raise ValueError("a label column is required")
    sizes = durable(df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")))
    if sizes.count() < 2:
        raise ValueError("at least two classes are required")
    first = _class_shares(sizes, test).select("label", "n", F.col("take").alias("test"))
    left = first.select("label", (F.col("n") - F.col("test")).alias("n"))
    second = _class_shares(left, val / (train + val)).select("label", F.col("take").alias("_v"))
    quotas = first.join(second, "label").select("label", "test", (F.col("test") + F.col("_v")).alias("val"))
    keyed = df.select(F.col(row_id).alias("id"), F.col(label).alias("label"), F.lit(0).alias("split_index"))
    keyed = keyed.filter(F.col("label").isNotNull()).withColumn("_key", seeded_key(seed, F.lit(0), F.col("id")))
    return _out(take_by_hash(keyed, ["label"], quotas, "train", bounded=False))


def stratified_shuffle(df, row_id, label, n_splits=5, test_size=0.2, seed=0) -> DataFrame:
    """Repeated two-way stratified shuffle."""
    sizes = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    quotas = with_splits(_class_shares(sizes, test_size).select("label", F.col("take").alias("test")), n_splits)
    keyed = with_splits(df.select(F.col(row_id).alias("id"), F.col(label).alias("label")), n_splits)
    keyed = keyed.filter(F.col("label").isNotNull())
    keyed = keyed.withColumn("_key", seeded_key(seed, F.col("split_index"), F.col("id")))
    return _out(take_by_hash(keyed, ["split_index", "label"], quotas, "train", bounded=False))


def stratified_k_fold(df, row_id, label, k=5, seed=0) -> DataFrame:
    """k folds with equal class shares: fold j is the validation set of split j.

    Folds are k slices of the seeded order of each class, so a class is never sorted
    as a whole; slice sizes differ by at most one row.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    keyed = df.filter(F.col(label).isNotNull()).select(F.col(row_id).alias("id"), F.col(label).alias("label"))
    keyed = keyed.withColumn("_key", seeded_key(seed, F.lit(0), F.col("id")))
    n = F.col("_n")
    ends = {f"f{j}": F.floor(n * F.lit(j + 1) / F.lit(k)) for j in range(k - 1)}
    folded = take_by_hash(keyed, ["label"], ends, f"f{k - 1}", bounded=False)
    both = with_splits(folded.select("id", F.col("set").alias("fold")), k)
    val = F.col("fold") == F.concat(F.lit("f"), F.col("split_index").cast("string"))
    return _out(both.withColumn("set", F.when(val, "val").otherwise("train")))


def group_shuffle(df, row_id, group: str | Column, n_splits=5, test_size=None, train_size=None, seed=0) -> DataFrame:
    """Whole groups go to test: ``ceil(test * number of groups)`` groups in seeded order.

    Only distinct groups are shuffled; rows are labelled by comparing the hash of
    their group with the cut, so a hot group costs nothing extra.  Rows without a
    group travel together under the empty key.
    """
    key = F.col(group) if isinstance(group, str) else group
    rows = df.select(F.col(row_id).alias("id"), F.coalesce(key.cast("string"), F.lit("")).alias("_g"))
    hashed = lambda d: with_splits(d, n_splits).withColumn("_key", seeded_key(seed, F.col("split_index"), F.col("_g")))
    quota, rest = _test_train_cuts(test_size, train_size)
    return _out(take_by_hash(hashed(rows), BY_SPLIT, quota, rest, cut_keys=hashed(rows.select("_g").distinct())))


def scaffold_split(df, row_id, scaffold: str | Column, n_splits=5, test_size=None, train_size=None, seed=0) -> DataFrame:
    """Rows with one scaffold never cross."""
    return group_shuffle(df, row_id, scaffold, n_splits, test_size, train_size, seed)


def sorted_split(df, row_id, value: str | Column, larger=True, n_splits=1, test_size=None, train_size=None) -> DataFrame:
    """Order by a property; the largest (or smallest) values form the test set.

    The order is deterministic, so every repeat is the same split.
    """
    v = F.col(value) if isinstance(value, str) else value
    n = df.count()
    spare = df.sparkSession.range(1).select(F.lit(n).cast("long").alias("_n"))
    test, upto = spare.select(*test_train_quota(F.col("_n"), test_size, train_size)).first()
    first = "train" if larger else "test"
    k1 = (upto - test) if larger else test
    cut1 = kth_key(df, v, F.col(row_id), k1, n)
    # what is in neither set lies between them
    k2 = n - test if larger else n - (upto - test)
    cut2 = cut1 if k2 == k1 else kth_key(df, v, F.col(row_id), k2, n)
    label = (
        F.when(at_or_before(v, F.col(row_id), cut1), first)
        .when(at_or_before(v, F.col(row_id), cut2), "discard")
        .otherwise("test" if larger else "train")
    )
    out = df.select(F.col(row_id).alias("id"), label.alias("set"))
    return _out(with_splits(out, n_splits))


def grouped_first_fit(df, row_id, group: str | Column, fractions=(0.8, 0.1, 0.1)) -> DataFrame:
    """Large groups first to train, then val, then test, each while the ratio has room."""
    train, val, test = (float(f) for f in fractions)
    if any(not 0 < f < 1 for f in (train, val, test)):
        raise ValueError("split ratios must lie between 0 and 1")
    _check_fractions(train, val, test)
    key = F.col(group) if isinstance(group, str) else group
    rows = df.select(F.col(row_id).alias("id"), F.coalesce(key.cast("string"), F.lit("")).alias("component"))
    groups = durable(rows.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    n = groups.agg(F.sum("size")).first()[0]
    caps = [int(train * n), int((train + val) * n)]
    packed = pack_first_fit(groups, caps, ["train", "val"], "test").select("component", "set")
    out = join_bounded(rows, packed, ["component"], "inner")
    return _out(out.withColumn("split_index", F.lit(0)))


def nested_three_way(df, row_id, sampler, train_size=0.8, val_size=0.1, options: dict | None = None) -> DataFrame:
    """Train/val/test by applying one two-way splitter twice."""
    test = 1.0 - train_size - val_size
    if test <= 0:
        raise ValueError("train_size + val_size must be below 1")
    options = dict(options or {})
    outer = durable(sampler(df, row_id, n_splits=1, test_size=round(test, 9), **options))
    inside = outer.filter("set = 'train'").select(F.col("id").alias(row_id))
    inner = sampler(df.join(inside, row_id, "left_semi"), row_id, n_splits=1, test_size=round(val_size / (train_size + val_size), 9), **options)
    kept = inner.withColumn("set", F.when(F.col("set") == "test", "val").otherwise(F.col("set")))
    return _out(kept.unionByName(outer.filter("set <> 'train'")))


def accepted_candidates(
    df, row_id, label, splitter, n_wanted=10, tolerance=0.1, max_candidates=100, batch=20
) -> DataFrame:
    """First ``n_wanted`` candidate splits whose active shares differ by at most the tolerance.

    ``splitter(df, row_id, n_splits=m)`` gives candidates 0..m-1 with seeds per split
    index.  Candidates are judged in batches, one aggregation each, and the search
    stops once enough are accepted.  Accepted splits are renumbered from 0.
    """
    labels = df.select(F.col(row_id).alias("id"), F.col(label).cast("double").alias("label"))
    accepted: list[int] = []
    for start in range(0, max_candidates, batch):
        stop = min(start + batch, max_candidates)
        candidates = splitter(df, row_id, n_splits=stop).filter(F.col("split_index") >= start)
        share = lambda s: F.avg(F.when(F.col("set") == s, F.col("label")))
        gaps = candidates.join(labels, "id").groupBy("split_index").agg(F.abs(share("train") - share("test")).alias("gap"))
        good = gaps.filter(F.col("gap") <= tolerance).orderBy("split_index").collect()  # at most `batch` rows
        accepted += [r["split_index"] for r in good]
        if len(accepted) >= n_wanted:
            break
    accepted = accepted[:n_wanted]
    final = splitter(df, row_id, n_splits=(max(accepted) + 1) if accepted else 1).filter(F.col("split_index").isin(accepted))
    place = F.array_position(F.lit(accepted or [-1]), F.col("split_index")) - 1
    return _out(final.withColumn("split_index", place.cast("int")))


def partition_report(assignment: DataFrame, weight: Column | None = None) -> DataFrame:
    """Rows and weight of each part of each split, the discarded part included."""
    w = F.lit(1) if weight is None else weight
    return assignment.groupBy("split_index", "set").agg(F.count(F.lit(1)).alias("n"), F.sum(w).cast("bigint").alias("weight"))


