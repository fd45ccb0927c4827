"""Audit of splits: sizes, similarity to train, group overlap, property drift, reports.

All functions take the assignment table ``(splitter, split_index, id, set)`` of any
number of splitters and splits, and give one row per split in one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from riftsplit.functions.stats import kolmogorov_two_sided
from riftsplit.operators.similarity import best_in_other_set, nearest_sets, with_words
from riftsplit.plans.durable import durable, join_bounded, stored
from riftsplit.plans.order import percentiles, running_totals

SPLIT = ["splitter", "split_index"]
HISTOGRAM_BINS = 30
# Share of the train rows that serves as the in-distribution test set.
ID_TEST_SHARE = 0.2


def on_train() -> Column:
    return F.col("set") == "train"


def on_test() -> Column:
    return F.col("set") == "test"


def _two_sided(per_split: DataFrame, n_train: str, n_test: str) -> DataFrame:
    return per_split.filter((F.col(n_train) > 0) & (F.col(n_test) > 0))


def size_metrics(parts: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Sizes, ratios of train + test, positive ratio per side and its difference."""
    if labels is None:
        rows = parts.withColumn("label", F.lit(None).cast("double"))
    else:
        rows = parts.join(labels.select("id", F.col("label").cast("double").alias("label")), "id", "left")
    out = rows.groupBy(*SPLIT).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(on_train()).alias("train_size"),
        F.count_if(on_test()).alias("test_size"),
        F.avg(F.when(on_train(), F.col("label"))).alias("train_positive_ratio"),
        F.avg(F.when(on_test(), F.col("label"))).alias("test_positive_ratio"),
    )
    both = F.nullif(F.col("train_size") + F.col("test_size"), F.lit(0)).cast("double")
    return out.select(
        *SPLIT, "total_samples", "train_size", "test_size",
        F.coalesce(F.col("train_size") / both, F.lit(0.0)).alias("train_ratio"),
        F.coalesce(F.col("test_size") / both, F.lit(0.0)).alias("test_ratio"),
        "train_positive_ratio", "test_positive_ratio",
        F.abs(F.col("train_positive_ratio") - F.col("test_positive_ratio")).alias("label_balance_diff"),
    )


SIM_PERCENTILES = {"percentile_5": 0.05, "percentile_25": 0.25, "median_sim": 0.5, "percentile_75": 0.75, "percentile_95": 0.95}


def similarity_summary(best: DataFrame) -> DataFrame:
    """Distribution of the per-test highest similarity; ``best`` has the split keys and ``similarity``."""
    best = durable(best)  # the costly part, read twice below
    moments = best.groupBy(*SPLIT).agg(
        F.min("similarity").alias("min_sim"),
        F.max("similarity").alias("max_sim"),
        F.avg("similarity").alias("mean_sim"),
        F.stddev_pop("similarity").alias("std_sim"),
        F.count(F.lit(1)).alias("n_test_samples"),
    )
    return moments.join(percentiles(best, SPLIT, "similarity", SIM_PERCENTILES), SPLIT)


NEIGHBOURS = 8  # partners kept for each item


def neighbour_table(items: DataFrame, queries: DataFrame, n_bits: int, m: int = NEIGHBOURS) -> DataFrame:
    """(id, partner, similarity): the ``m`` most similar other items of each query item; inputs are (id, bits)."""
    words = lambda d: with_words(d.select("id", "bits"), n_bits)
    near = nearest_sets(words(queries), words(items), [], m + 1, n_bits).filter("lid <> rid")
    return near.select(F.col("lid").alias("id"), F.col("rid").alias("partner"), "similarity")


def best_similarities(parts: DataFrame, bits: DataFrame, n_bits: int, neighbours: DataFrame | None = None) -> DataFrame:
    """Highest similarity of each test item to the train side of its own split; ``bits`` is (id, bits).

    One neighbour table serves all splits: the first partner in the list that lies in train is the best of all.  Only
    items of which no listed partner lies in train are compared with their own train side.
    """
    sets = stored(bits.select("id", "bits"))
    parts = stored(parts.select(*SPLIT, "id", "set"))
    side = lambda s: parts.filter(F.col("set") == s).select(*SPLIT, "id")
    test, train = side("test").join(sets.select("id"), "id", "left_semi"), side("train").join(sets.select("id"), "id", "left_semi")
    if neighbours is None:
        tested = sets.join(test.select("id").distinct(), "id", "left_semi")
        neighbours = stored(neighbour_table(sets, tested, n_bits))
    met = test.join(neighbours, "id").join(train.withColumnRenamed("id", "partner"), [*SPLIT, "partner"], "left_semi")
    found = stored(met.groupBy(*SPLIT, "id").agg(F.max("similarity").alias("similarity")))
    rest = stored(test.join(found.select(*SPLIT, "id"), [*SPLIT, "id"], "left_anti").join(sets, "id"))
    if rest.isEmpty():
        return found
    of_splits = join_bounded(train, rest.select(*SPLIT).distinct(), SPLIT, "inner")
    completed = best_in_other_set(rest, of_splits.join(sets, "id"), SPLIT, n_bits).select(*SPLIT, "id", "similarity")
    return found.unionByName(completed)


def best_similarities_stored(parts: DataFrame, both_ways_pairs: DataFrame) -> DataFrame:
    """The same from a mirrored pair table (i, j, distance).

    Spark takes a pair table made by block pairs for as small as the rows it is made of, so it is kept from being built in
    memory; a pair looks up the splits of both ends and becomes a row for each split that it crosses.
    """
    of = lambda side, end, name: parts.filter(side).groupBy(F.col("id").alias(end)).agg(F.collect_set(F.struct(*SPLIT)).alias(name))
    hit = join_bounded(both_ways_pairs.hint("merge"), of(on_test(), "i", "_test"), ["i"], "inner")
    hit = join_bounded(hit.hint("merge"), of(on_train(), "j", "_train"), ["j"], "inner")
    crossed = hit.select(F.explode(F.array_intersect("_test", "_train")).alias("_s"), F.col("i").alias("id"), "distance")
    return crossed.select("_s.*", "id", "distance").groupBy(*SPLIT, "id").agg(F.max(1.0 - F.col("distance")).alias("similarity"))


def similarity_metrics(parts: DataFrame, bits: DataFrame, n_bits: int) -> DataFrame:
    return similarity_summary(best_similarities(parts, bits, n_bits))


def group_metrics(parts: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct groups per side, shared groups, overlap and coverage; ``groups`` is (id, group_key).

    Rows are first reduced to one row per (split, group) with counts per side, so a hot
    group is combined on the map side and the distinct counts need no second shuffle of rows.
    """
    joined = parts.filter(on_train() | on_test()).join(groups.select("id", "group_key"), "id", "left")
    per_group = joined.groupBy(*SPLIT, "group_key").agg(F.count_if(on_train()).alias("tr"), F.count_if(on_test()).alias("te"))
    known = F.col("group_key").isNotNull()
    out = per_group.groupBy(*SPLIT).agg(
        F.count_if(known & (F.col("tr") > 0)).alias("train_unique_scaffolds"),
        F.count_if(known & (F.col("te") > 0)).alias("test_unique_scaffolds"),
        F.count_if(known & (F.col("tr") > 0) & (F.col("te") > 0)).alias("shared_scaffolds"),
        F.sum("tr").alias("_tr"), F.sum("te").alias("_te"),
        F.sum(F.when(known, F.col("tr")).otherwise(0)).alias("_ktr"),
        F.sum(F.when(known, F.col("te")).otherwise(0)).alias("_kte"),
    )
    share = lambda a, b: F.coalesce(F.lit(100.0) * F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return _two_sided(out, "_tr", "_te").select(
        *SPLIT, "train_unique_scaffolds", "test_unique_scaffolds", "shared_scaffolds",
        share("shared_scaffolds", "test_unique_scaffolds").alias("scaffold_overlap_percentage"),
        share("_ktr", "_tr").alias("train_scaffold_coverage"),
        share("_kte", "_te").alias("test_scaffold_coverage"),
    )


def property_metrics(parts: DataFrame, properties: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Moments, medians and the two-sample KS test of each property, train against test.

    ``properties`` is long (id, property, value).  Everything that needs an order is read
    off counts per distinct value and their prefix sums.  Properties with fewer than two
    values on a side are left out.
    """
    rows = properties.filter(F.col("value").isNotNull())
    if names is not None:
        rows = rows.filter(F.col("property").isin(names))
    by = [*SPLIT, "property"]
    v = F.col("value")
    counts = (
        parts.filter(on_train() | on_test())
        .join(rows, "id")
        .groupBy(*by, "value")
        .agg(F.count_if(on_train()).alias("tr"), F.count_if(on_test()).alias("te"))
        .withColumns({"trv": F.col("tr") * v, "tev": F.col("te") * v})
    )
    running = {"ctr": "tr", "cte": "te"}
    whole = {"n_tr": "tr", "n_te": "te", "s_tr": "trv", "s_te": "tev"}
    cum = running_totals(counts, by, [v], running, whole).filter("n_tr >= 2 and n_te >= 2")
    joined = cum.withColumns({"m_tr": F.col("s_tr") / F.col("n_tr"), "m_te": F.col("s_te") / F.col("n_te")})

    def middle(c: str) -> Column:
        n, run = F.col(f"n_{c}"), F.col(f"c{c}")
        lo = F.min(F.when(run > F.floor((n - 1) / 2), v))
        hi = F.min(F.when(run > F.ceil((n - 1) / 2), v))
        return (lo + hi) / 2

    def spread(c: str) -> Column:
        off = v - F.col(f"m_{c}")
        return F.sqrt(F.sum(F.col(c) * off * off) / F.first(f"n_{c}"))

    gap = F.abs(F.col("ctr") / F.col("n_tr") - F.col("cte") / F.col("n_te"))
    carried = [F.first(c).alias(c) for c in ("n_tr", "n_te", "m_tr", "m_te")]
    out = joined.groupBy(*by).agg(
        F.max(gap).alias("ks_statistic"),
        middle("tr").alias("train_median"), spread("tr").alias("train_std"),
        middle("te").alias("test_median"), spread("te").alias("test_std"), *carried,
    )
    return out.select(
        *by,
        F.col("m_tr").alias("train_mean"), "train_std", "train_median",
        F.col("m_te").alias("test_mean"), "test_std", "test_median",
        "ks_statistic", kolmogorov_two_sided(F.col("ks_statistic"), F.col("n_tr"), F.col("n_te")).alias("ks_pvalue"),
        F.abs(F.col("m_tr") - F.col("m_te")).alias("mean_diff"),
        F.abs(F.col("train_median") - F.col("test_median")).alias("median_diff"),
    )


def report(
    parts: DataFrame,
    labels: DataFrame | None = None,
    bits: DataFrame | None = None,
    n_bits: int | None = None,
    groups: DataFrame | None = None,
    properties: DataFrame | None = None,
) -> DataFrame:
    """One nested row per split: size, and whichever other parts were asked for."""
    parts = durable(parts)  # every part reads the assignments; the splitters run once
    pack = lambda df, name: df.select(*SPLIT, F.struct(*[c for c in df.columns if c not in SPLIT]).alias(name))
    out = pack(size_metrics(parts, labels), "size_metrics")
    if bits is not None:
        out = out.join(pack(similarity_metrics(parts, bits, n_bits), "similarity_metrics"), SPLIT, "left")
    if groups is not None:
        out = out.join(pack(group_metrics(parts, groups), "scaffold_metrics"), SPLIT, "left")
    if properties is not None:
        props = property_metrics(parts, properties).withColumnRenamed("property", "property_name")
        cells = F.struct(*[c for c in props.columns if c not in SPLIT])
        nested = props.groupBy(*SPLIT).agg(F.array_sort(F.collect_list(cells)).alias("property_distributions"))
        out = out.join(nested, SPLIT, "left")
    return out


PREFIXES = {"size_metrics": "size_", "similarity_metrics": "sim_", "scaffold_metrics": "scaffold_"}


def flatten(reports: DataFrame, property_names: list[str] = ()) -> DataFrame:
    """Nested reports to one wide row per split with prefixed columns."""
    cols: list[Column] = [F.col("splitter").alias("splitter_name"), F.col("split_index")]
    for part, prefix in PREFIXES.items():
        if part in reports.columns:
            cols += [F.col(part)[c].alias(prefix + c) for c in reports.schema[part].dataType.names]
    if "property_distributions" in reports.columns:
        for name in property_names:
            one = F.get(F.filter("property_distributions", lambda p: p["property_name"] == name), F.lit(0))
            stem = "prop_" + name.lower().replace(" ", "_")
            cols += [
                one["ks_statistic"].alias(stem + "_ks_stat"),
                one["ks_pvalue"].alias(stem + "_ks_pvalue"),
                one["mean_diff"].alias(stem + "_mean_diff"),
            ]
    return reports.select(*cols)


def compare(flat: DataFrame, aggregate: bool = True) -> DataFrame:
    """Mean and sample deviation per splitter of every numeric column but the split index."""
    if not aggregate:
        return flat
    numeric = [
        f.name for f in flat.schema.fields if isinstance(f.dataType, NumericType) and f.name != "split_index"
    ]
    aggs = [a for c in numeric for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))]
    return flat.groupBy("splitter_name").agg(*aggs)


def summary_stats(flat: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Mean, population deviation, min and max of chosen report columns per splitter."""
    long = flat.unpivot("splitter_name", list(columns), "column", "value")
    name = F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), F.lit(v))])
    return (
        long.filter(F.col("value").isNotNull())
        .groupBy(F.col("splitter_name"), name[F.col("column")].alias("metric"))
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    )


def violations(parts: DataFrame, groups: DataFrame | None = None, value: DataFrame | None = None, items: DataFrame | None = None):
    """Rows (splitter, split_index, check, n) for rules that a stored split breaks.

    ``groups`` (id, group_key): a group on both sides; ``value`` (id, value): a test value
    below the largest train value; ``items`` (id, item): an item on both sides.
    """
    found = []

    def shared(keys: DataFrame, key: str, name: str) -> DataFrame:
        sides = parts.filter(on_train() | on_test()).join(keys.select("id", F.col(key).alias("_k")), "id")
        both = sides.groupBy(*SPLIT, "_k").agg(F.count_if(on_train()).alias("tr"), F.count_if(on_test()).alias("te"))
        return both.groupBy(*SPLIT).agg(F.count_if(F.expr("tr > 0 and te > 0")).alias("n")).withColumn("check", F.lit(name))

    if groups is not None:
        found.append(shared(groups, "group_key", "shared_group"))
    if items is not None:
        found.append(shared(items, "item", "shared_item"))
    if value is not None:
        rows = parts.filter(on_train() | on_test()).join(value.select("id", "value"), "id")
        top = rows.groupBy(*SPLIT).agg(F.max(F.when(on_train(), F.col("value"))).alias("top"))
        low = join_bounded(rows, top, SPLIT, "inner")
        n = F.count_if(on_test() & (F.col("value") < F.col("top"))).alias("n")
        found.append(low.groupBy(*SPLIT).agg(n).withColumn("check", F.lit("test_below_train")))
    cols = [*SPLIT, "check", "n"]
    return reduce(DataFrame.unionByName, [f.select(*cols) for f in found])


def density_histogram(parts: DataFrame, values: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Density per side on common equal-width bins over the range of both sides."""
    rows = parts.filter(on_train() | on_test()).join(values.select("id", "value").filter(F.col("value").isNotNull()), "id")
    span = rows.groupBy(*SPLIT).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    placed = join_bounded(rows, span, SPLIT, "inner")
    slot = F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))))
    counted = placed.groupBy(*SPLIT, "set", "lo", "hi", F.coalesce(slot, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # one row per bin and side from here on
    total = counted.groupBy(*SPLIT, "set").agg(F.sum("n").alias("_t"))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) / bins  # no density for a single value
    out = counted.join(total, [*SPLIT, "set"])
    return out.select(
        *SPLIT, "set", "bin", (F.col("lo") + F.col("bin") * F.coalesce(width, F.lit(0.0))).alias("bin_start"), "n",
        (F.col("n") / (F.col("_t") * width)).alias("density"),
    )


def min_max_scaled(comparison: DataFrame, metrics: list[str]) -> DataFrame:
    """Metrics of the splitters scaled to [0, 1]; 0.5 where all are equal."""
    spans = comparison.agg(F.struct(*[F.min(m).alias(f"lo_{m}") for m in metrics], *[F.max(m).alias(f"hi_{m}") for m in metrics]).alias("s"))
    out = comparison.withColumn("_s", spans.scalar())
    cells = []
    for m in metrics:
        lo, hi = F.col(f"_s.lo_{m}"), F.col(f"_s.hi_{m}")
        cells.append(F.coalesce((F.col(m) - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.5)).alias(m))
    return out.select("splitter_name", *cells)


def membership_matrix(parts: DataFrame, splitters: list[str], split_index: int = 0) -> DataFrame:
    """One row per item, one column per splitter with Train/Test."""
    rows = parts.filter((F.col("split_index") == split_index) & F.col("splitter").isin(splitters) & (on_train() | on_test()))
    return rows.groupBy("id").pivot("splitter", splitters).agg(F.first(F.initcap("set")))


def activity(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows, actives and active share in % per side of each split."""
    rows = parts.filter(on_train() | on_test()).join(labels.select("id", "label"), "id")
    return rows.groupBy(*SPLIT, "set").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum("label").cast("bigint").alias("actives"),
        (F.avg("label") * 100).alias("actives_percentage"),
    )


def group_diversity(items: DataFrame, dataset: str, group: str, approximate: bool = False) -> DataFrame:
    """Distinct groups over rows per dataset; exact counts go through (dataset, group) first."""
    if approximate:
        return items.groupBy(dataset).agg((F.approx_count_distinct(group) / F.count(F.lit(1))).alias("diversity"))
    per_group = items.groupBy(dataset, group).agg(F.count(F.lit(1)).alias("n"))
    groups = F.count(group).cast("double")
    return per_group.groupBy(dataset).agg((groups / F.sum("n")).alias("diversity"))


def test_size_shares(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Tidy shares in %: the OOD test set, and the ID test set as a fifth of train."""
    total = F.nullif(F.col("train_size") + F.col("test_size"), F.lit(0))
    wide = sizes.select(
        *keys,
        (F.col("test_size") / total * 100).alias("ood_test_size"),
        (F.lit(ID_TEST_SHARE) * F.col("train_size") / total * 100).alias("id_test_size"),
    )
    return wide.unpivot(keys, ["ood_test_size", "id_test_size"], "test_type", "size_ratio")


def activity_over_repeats(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean and deviation over the repeats of the active share per splitter and side."""
    per_split = activity(parts, labels)
    return per_split.groupBy("splitter", "set").agg(
        F.avg("actives_percentage").alias("mean"), F.stddev_samp("actives_percentage").alias("std")
    )
