"""Split audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftsplit.operators import audit
from riftsplit.operators.registry import run_splitter
from riftsplit.operators.similarity import distance_matrix, mirrored
from riftsplit.queries.base import (
    BITS,
    SIGNS,
    group_sql,
    query,
    r6,
    random_sql,
    rounded,
    sign_items,
    sorted_sql,
    table,
)

N_SPLITS = 3
PROPERTIES = ["p_retailprice", "p_size"]


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part")


def part_splits(spark, sf_dir) -> DataFrame:
    """Three splitters on part: random, by brand, by price."""
    part = _part(spark, sf_dir)
    return reduce(
        DataFrame.unionByName,
        [
            run_splitter("random", part, "p_partkey", n_splits=N_SPLITS, test_size=0.2),
            run_splitter("scaffold", part, "p_partkey", scaffold="p_brand", n_splits=N_SPLITS, test_size=0.2),
            run_splitter("molecular_weight", part, "p_partkey", value="p_retailprice", n_splits=N_SPLITS, test_size=0.2),
        ],
    )


PARTS = f"""parts AS (SELECT 'random' AS splitter, * FROM ({random_sql("part", "p_partkey", N_SPLITS)})
  UNION ALL SELECT 'scaffold' AS splitter, split_index, id, "set" FROM ({group_sql("part", "p_partkey", "p_brand", N_SPLITS)})
  UNION ALL SELECT 'molecular_weight' AS splitter, * FROM ({sorted_sql("part", "p_partkey", "p_retailprice", True, N_SPLITS)}))"""


def label_splits(spark, sf_dir) -> DataFrame:
    return run_splitter("random", table(spark, sf_dir, "labels"), "doc_id", n_splits=5, test_size=0.2)


LABEL_PARTS = f"parts AS (SELECT 'random' AS splitter, * FROM ({random_sql('labels', 'doc_id', 5)}))"


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))


def sign_splits(spark, sf_dir) -> DataFrame:
    return run_splitter("random", sign_items(spark, sf_dir), "id", n_splits=2, test_size=0.2)


SIGN_PARTS = f"parts AS (SELECT 'random' AS splitter, * FROM ({random_sql('bits', 'id', 2)}))"

_KEYS = "splitter, split_index"


@query(
    "f1_size_metrics",
    f"""WITH {LABEL_PARTS} SELECT {_KEYS}, count(*) AS total_samples, count_if("set" = 'train') AS train_size, count_if("set" = 'test') AS test_size,
        {r6("count_if(" + chr(34) + "set" + chr(34) + " = 'train') / count(*)")} AS train_ratio, {r6("count_if(" + chr(34) + "set" + chr(34) + " = 'test') / count(*)")} AS test_ratio,
        {r6('avg(toxic) FILTER (WHERE "set" = ' + "'train')")} AS train_positive_ratio, {r6('avg(toxic) FILTER (WHERE "set" = ' + "'test')")} AS test_positive_ratio,
        {r6('abs(avg(toxic) FILTER (WHERE "set" = ' + "'train') - avg(toxic) FILTER (WHERE " + '"set"' + " = 'test'))")} AS label_balance_diff
        FROM parts JOIN labels ON id = doc_id GROUP BY ALL""",
)
def sizes(spark, sf_dir):
    out = audit.size_metrics(label_splits(spark, sf_dir), _labels(spark, sf_dir))
    return rounded(out, "train_ratio", "test_ratio", "train_positive_ratio", "test_positive_ratio", "label_balance_diff")


_SIM = f"""WITH {SIGNS}, {SIGN_PARTS}, best AS (SELECT t.splitter, t.split_index, t.id,
   max(len(list_intersect(x.b, y.b)) / CAST(len(x.b) + len(y.b) - len(list_intersect(x.b, y.b)) AS DOUBLE)) AS s
   FROM parts t JOIN bits x ON x.id = t.id JOIN parts r ON r.split_index = t.split_index AND r."set" = 'train' JOIN bits y ON y.id = r.id
   WHERE t."set" = 'test' GROUP BY ALL)"""
_SIM_COLS = f"""{r6("min(s)")} AS min_sim, {r6("max(s)")} AS max_sim, {r6("avg(s)")} AS mean_sim, {r6("stddev_pop(s)")} AS std_sim, count(*) AS n_test_samples,
   {r6("quantile_cont(s, 0.05)")} AS percentile_5, {r6("quantile_cont(s, 0.25)")} AS percentile_25, {r6("median(s)")} AS median_sim,
   {r6("quantile_cont(s, 0.75)")} AS percentile_75, {r6("quantile_cont(s, 0.95)")} AS percentile_95"""
_SIM_NAMES = ["min_sim", "max_sim", "mean_sim", "std_sim", "percentile_5", "percentile_25", "median_sim", "percentile_75", "percentile_95"]


@query("f2_similarity_metrics", f"{_SIM} SELECT {_KEYS}, {_SIM_COLS} FROM best GROUP BY {_KEYS}")
def similarity(spark, sf_dir):
    items = sign_items(spark, sf_dir)
    return rounded(audit.similarity_metrics(sign_splits(spark, sf_dir), items, BITS), *_SIM_NAMES)


@query("f2_similarity_metrics_stored", f"{_SIM} SELECT {_KEYS}, {_SIM_COLS} FROM best GROUP BY {_KEYS}")
def similarity_stored(spark, sf_dir):
    pairs = mirrored(distance_matrix(sign_items(spark, sf_dir), "id", "bits", "jaccard", BITS))
    best = audit.best_similarities_stored(sign_splits(spark, sf_dir), pairs)
    return rounded(audit.similarity_summary(best), *_SIM_NAMES)


_GROUPS = f"""grp AS (SELECT splitter, split_index, p_brand AS k, count_if("set" = 'train') AS tr, count_if("set" = 'test') AS te
   FROM parts JOIN part ON p_partkey = id GROUP BY ALL),
   scaf AS (SELECT {_KEYS}, count_if(tr > 0) AS train_unique_scaffolds, count_if(te > 0) AS test_unique_scaffolds, count_if(tr > 0 AND te > 0) AS shared_scaffolds,
   {r6("100.0 * count_if(tr > 0 AND te > 0) / count_if(te > 0)")} AS scaffold_overlap_percentage,
   CAST(100 AS DOUBLE) AS train_scaffold_coverage, CAST(100 AS DOUBLE) AS test_scaffold_coverage FROM grp GROUP BY {_KEYS})"""


def _groups(spark, sf_dir):
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("group_key"))


@query("f3_group_metrics", f"WITH {PARTS}, {_GROUPS} SELECT * FROM scaf")
def groups(spark, sf_dir):
    out = audit.group_metrics(part_splits(spark, sf_dir), _groups(spark, sf_dir))
    return rounded(out, "scaffold_overlap_percentage", "train_scaffold_coverage", "test_scaffold_coverage")


_PROPS = """lng AS (SELECT splitter, split_index, "set", property, value FROM (SELECT parts.*, p_retailprice, CAST(p_size AS DOUBLE) AS p_size
   FROM parts JOIN part ON p_partkey = id) UNPIVOT (value FOR property IN (p_retailprice, p_size))),
 cnt AS (SELECT splitter, split_index, property, value, count_if("set" = 'train') AS tr, count_if("set" = 'test') AS te FROM lng GROUP BY ALL),
 cum AS (SELECT *, sum(tr) OVER w AS ctr, sum(te) OVER w AS cte, sum(tr) OVER g AS ntr, sum(te) OVER g AS nte FROM cnt
   WINDOW w AS (PARTITION BY splitter, split_index, property ORDER BY value), g AS (PARTITION BY splitter, split_index, property)),
 ks AS (SELECT splitter, split_index, property, max(abs(ctr / CAST(ntr AS DOUBLE) - cte / CAST(nte AS DOUBLE))) AS ks_statistic,
   sqrt(max(CAST(ntr AS DOUBLE) * nte / (ntr + nte))) AS en, max(ntr) AS ntr, max(nte) AS nte FROM cum GROUP BY ALL),
 cases AS (SELECT DISTINCT CAST(least(ntr, nte) AS BIGINT) AS a, CAST(greatest(ntr, nte) AS BIGINT) AS b, CAST(round(ks_statistic * ntr * nte) AS BIGINT) AS gap FROM ks WHERE greatest(ntr, nte) <= 10000),
 paths AS (SELECT a, b, gap, CAST(0 AS BIGINT) AS s, list_concat([CAST(1 AS DOUBLE)], list_transform(range(a), lambda x: CAST(0 AS DOUBLE))) AS p FROM cases
   UNION ALL SELECT a, b, gap, s + 1, list_transform(range(a + 1), lambda x: CASE WHEN x > s + 1 OR s + 1 - x > b OR abs(x * b - (s + 1 - x) * a) >= gap THEN CAST(0 AS DOUBLE)
     ELSE (coalesce(p[x], 0) * x + p[x + 1] * (s + 1 - x)) / CAST(s + 1 AS DOUBLE) END) FROM paths WHERE s < a + b),
 exact AS (SELECT a, b, gap, CASE WHEN gap <= 0 THEN CAST(1 AS DOUBLE) ELSE 1 - p[a + 1] END AS p FROM paths WHERE s = a + b),
 kp AS (SELECT ks.*, CASE WHEN exact.a IS NOT NULL THEN least(1, greatest(0, exact.p)) WHEN en * ks_statistic < 0.2 THEN CAST(1 AS DOUBLE) ELSE least(1, greatest(0, list_sum(list_transform(range(1, 21),
   lambda j: 2 * pow(-1, j - 1) * exp(-2.0 * j * j * pow(en * ks_statistic, 2)))))) END AS ks_pvalue
   FROM ks LEFT JOIN exact ON exact.a = least(ntr, nte) AND exact.b = greatest(ntr, nte) AND exact.gap = CAST(round(ks_statistic * ntr * nte) AS BIGINT)),
 mom AS (SELECT splitter, split_index, property, avg(value) FILTER (WHERE "set" = 'train') AS train_mean, stddev_pop(value) FILTER (WHERE "set" = 'train') AS train_std,
   median(value) FILTER (WHERE "set" = 'train') AS train_median, avg(value) FILTER (WHERE "set" = 'test') AS test_mean,
   stddev_pop(value) FILTER (WHERE "set" = 'test') AS test_std, median(value) FILTER (WHERE "set" = 'test') AS test_median FROM lng GROUP BY ALL)"""
_PROP_NAMES = ["train_mean", "train_std", "train_median", "test_mean", "test_std", "test_median", "ks_statistic", "ks_pvalue", "mean_diff", "median_diff"]


def _prop_col(c: str) -> str:
    inner = {"mean_diff": "abs(train_mean - test_mean)", "median_diff": "abs(train_median - test_median)"}.get(c, c)
    return f"round(CAST({inner} AS DOUBLE), 8) AS {c}"


def _properties(spark, sf_dir):
    wide = _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    return wide.unpivot("id", PROPERTIES, "property", "value")


@query(
    "f4_property_metrics",
    f"WITH RECURSIVE {PARTS}, {_PROPS} SELECT splitter, split_index, property, {', '.join(_prop_col(c) for c in _PROP_NAMES)} FROM mom JOIN kp USING (splitter, split_index, property)",
)
def properties(spark, sf_dir):
    out = audit.property_metrics(part_splits(spark, sf_dir), _properties(spark, sf_dir), PROPERTIES)
    return out.withColumns({c: F.round(F.col(c), 8) for c in _PROP_NAMES})


def _report(spark, sf_dir):
    return audit.report(part_splits(spark, sf_dir), groups=_groups(spark, sf_dir), properties=_properties(spark, sf_dir))


def _flat(spark, sf_dir):
    return audit.flatten(_report(spark, sf_dir), PROPERTIES)


_SIZES = """siz AS (SELECT splitter, split_index, count(*) AS total_samples, count_if("set" = 'train') AS train_size, count_if("set" = 'test') AS test_size,
  count_if("set" = 'train') / CAST(count(*) AS DOUBLE) AS train_ratio, count_if("set" = 'test') / CAST(count(*) AS DOUBLE) AS test_ratio FROM parts GROUP BY ALL)"""
_FLAT = f"""WITH RECURSIVE {PARTS}, {_GROUPS}, {_PROPS}, {_SIZES}, flat AS (SELECT splitter AS splitter_name, split_index, total_samples AS size_total_samples,
  train_size AS size_train_size, test_size AS size_test_size, train_ratio AS size_train_ratio, test_ratio AS size_test_ratio,
  train_unique_scaffolds AS scaffold_train_unique_scaffolds, test_unique_scaffolds AS scaffold_test_unique_scaffolds,
  shared_scaffolds AS scaffold_shared_scaffolds, scaffold_overlap_percentage AS scaffold_scaffold_overlap_percentage,
  train_scaffold_coverage AS scaffold_train_scaffold_coverage, test_scaffold_coverage AS scaffold_test_scaffold_coverage,
  a.ks_statistic AS prop_p_retailprice_ks_stat, a.ks_pvalue AS prop_p_retailprice_ks_pvalue, abs(ma.train_mean - ma.test_mean) AS prop_p_retailprice_mean_diff,
  b.ks_statistic AS prop_p_size_ks_stat, b.ks_pvalue AS prop_p_size_ks_pvalue, abs(mb.train_mean - mb.test_mean) AS prop_p_size_mean_diff
  FROM siz JOIN scaf USING (splitter, split_index)
  JOIN (SELECT * FROM kp WHERE property = 'p_retailprice') a USING (splitter, split_index) JOIN (SELECT * FROM mom WHERE property = 'p_retailprice') ma USING (splitter, split_index)
  JOIN (SELECT * FROM kp WHERE property = 'p_size') b USING (splitter, split_index) JOIN (SELECT * FROM mom WHERE property = 'p_size') mb USING (splitter, split_index))"""
_FLAT_INTS = ["size_total_samples", "size_train_size", "size_test_size", "scaffold_train_unique_scaffolds", "scaffold_test_unique_scaffolds", "scaffold_shared_scaffolds"]
_FLAT_DOUBLES = (
    ["size_train_ratio", "size_test_ratio", "scaffold_scaffold_overlap_percentage", "scaffold_train_scaffold_coverage", "scaffold_test_scaffold_coverage"]
    + [f"prop_{p}_{m}" for p in PROPERTIES for m in ("ks_stat", "ks_pvalue", "mean_diff")]
)
_NO_LABELS = ["size_train_positive_ratio", "size_test_positive_ratio", "size_label_balance_diff"]


@query(
    "f5_full_report",
    f"{_FLAT} SELECT splitter_name AS splitter, split_index, size_train_size AS train_size, scaffold_shared_scaffolds AS shared_scaffolds, CAST(2 AS INTEGER) AS n_properties, round(prop_p_size_ks_stat, 8) AS last_ks FROM flat",
)
def full_report(spark, sf_dir):
    rep = _report(spark, sf_dir)
    return rep.select(
        "splitter", "split_index", F.col("size_metrics.train_size").alias("train_size"),
        F.col("scaffold_metrics.shared_scaffolds").alias("shared_scaffolds"),
        F.size("property_distributions").alias("n_properties"),
        F.round(F.element_at("property_distributions", -1)["ks_statistic"], 8).alias("last_ks"),
    )


@query(
    "f6_flat_report",
    f"{_FLAT} SELECT splitter_name, split_index, {', '.join(_FLAT_INTS)}, {', '.join(f'round({c}, 8) AS {c}' for c in _FLAT_DOUBLES)} FROM flat",
)
def flat_report(spark, sf_dir):
    flat = _flat(spark, sf_dir).drop(*_NO_LABELS)
    return flat.withColumns({c: F.round(F.col(c), 8) for c in _FLAT_DOUBLES})


@query(
    "f7_splitter_reports",
    f"{_FLAT} SELECT splitter_name, split_index, size_test_size, scaffold_shared_scaffolds FROM flat WHERE splitter_name = 'scaffold'",
)
def splitter_reports(spark, sf_dir):
    parts = run_splitter("scaffold", _part(spark, sf_dir), "p_partkey", scaffold="p_brand", n_splits=N_SPLITS, test_size=0.2)
    flat = audit.flatten(audit.report(parts, groups=_groups(spark, sf_dir)))
    return flat.select("splitter_name", "split_index", "size_test_size", "scaffold_shared_scaffolds")


_ALL = _FLAT_INTS + _FLAT_DOUBLES


@query(
    "f8_compare_splitters",
    f"{_FLAT} SELECT splitter_name, "
    + ", ".join(f"round(avg({c}), 8) AS {c}_mean, round(stddev_samp({c}), 8) AS {c}_std" for c in _ALL)
    + " FROM flat GROUP BY splitter_name",
)
def compare(spark, sf_dir):
    out = audit.compare(_flat(spark, sf_dir).drop(*_NO_LABELS))
    return out.withColumns({c: F.round(F.col(c), 8) for c in out.columns if c != "splitter_name"})


@query(
    "f9_summary_stats",
    f"""{_FLAT} SELECT splitter_name, 'scaffold_overlap' AS metric, {r6("avg(scaffold_scaffold_overlap_percentage)")} AS mean, {r6("stddev_pop(scaffold_scaffold_overlap_percentage)")} AS std,
        {r6("min(scaffold_scaffold_overlap_percentage)")} AS min, {r6("max(scaffold_scaffold_overlap_percentage)")} AS max FROM flat GROUP BY splitter_name""",
)
def summary(spark, sf_dir):
    flat = audit.flatten(audit.report(part_splits(spark, sf_dir), groups=_groups(spark, sf_dir)))
    out = audit.summary_stats(flat, {"scaffold_scaffold_overlap_percentage": "scaffold_overlap"})
    return rounded(out, "mean", "std", "min", "max")


@query(
    "f9_similarity_summary",
    f"""{_SIM}, m AS (SELECT splitter, split_index, avg(s) AS mean_sim FROM best GROUP BY ALL)
        SELECT splitter AS splitter_name, 'similarity' AS metric, {r6("avg(mean_sim)")} AS mean, {r6("stddev_pop(mean_sim)")} AS std, {r6("min(mean_sim)")} AS min, {r6("max(mean_sim)")} AS max FROM m GROUP BY splitter""",
)
def similarity_summary(spark, sf_dir):
    flat = audit.flatten(audit.report(sign_splits(spark, sf_dir), bits=sign_items(spark, sf_dir), n_bits=BITS))
    return rounded(audit.summary_stats(flat, {"sim_mean_sim": "similarity"}), "mean", "std", "min", "max")


@query(
    "f10_split_violations",
    f"""WITH {PARTS}, j AS (SELECT parts.*, p_brand, p_name, p_retailprice FROM parts JOIN part ON p_partkey = id),
        g AS (SELECT {_KEYS}, p_brand AS k, count_if("set" = 'train') AS tr, count_if("set" = 'test') AS te FROM j GROUP BY ALL),
        i AS (SELECT {_KEYS}, p_name AS k, count_if("set" = 'train') AS tr, count_if("set" = 'test') AS te FROM j GROUP BY ALL),
        t AS (SELECT {_KEYS}, max(p_retailprice) FILTER (WHERE "set" = 'train') AS top FROM j GROUP BY ALL)
        SELECT {_KEYS}, 'shared_group' AS "check", count_if(tr > 0 AND te > 0) AS n FROM g GROUP BY {_KEYS}
        UNION ALL SELECT {_KEYS}, 'shared_item', count_if(tr > 0 AND te > 0) FROM i GROUP BY {_KEYS}
        UNION ALL SELECT {_KEYS}, 'test_below_train', count_if("set" = 'test' AND p_retailprice < top) FROM j JOIN t USING ({_KEYS}) GROUP BY {_KEYS}""",
)
def violations(spark, sf_dir):
    part = _part(spark, sf_dir)
    value = part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("value"))
    items = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("item"))
    return audit.violations(part_splits(spark, sf_dir), _groups(spark, sf_dir), value, items)


@query(
    "f11_density_histogram",
    f"""WITH {PARTS}, j AS (SELECT parts.*, CAST(p_size AS DOUBLE) AS v FROM parts JOIN part ON p_partkey = id),
        s AS (SELECT *, min(v) OVER (PARTITION BY {_KEYS}) AS lo, max(v) OVER (PARTITION BY {_KEYS}) AS hi FROM j),
        b AS (SELECT {_KEYS}, "set", lo, hi, CAST(least(29, floor((v - lo) * 30 / (hi - lo))) AS INTEGER) AS bin, count(*) AS n FROM s GROUP BY ALL)
        SELECT {_KEYS}, "set", bin, {r6("lo + bin * ((hi - lo) / 30)")} AS bin_start, n, {r6('n / (sum(n) OVER (PARTITION BY splitter, split_index, "set") * ((hi - lo) / 30))')} AS density FROM b""",
)
def histogram(spark, sf_dir):
    values = _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("value"))
    return rounded(audit.density_histogram(part_splits(spark, sf_dir), values), "bin_start", "density")


_RADAR = ["scaffold_scaffold_overlap_percentage_mean", "size_test_ratio_mean", "prop_p_size_ks_stat_mean"]


@query(
    "f12_min_max_scaled",
    f"""{_FLAT}, c AS (SELECT splitter_name, {', '.join(f'avg({m[:-5]}) AS {m}' for m in _RADAR)} FROM flat GROUP BY splitter_name)
        SELECT splitter_name, {', '.join(f'round(coalesce(({m} - min({m}) OVER ()) / nullif(max({m}) OVER () - min({m}) OVER (), 0), 0.5), 8) AS {m}' for m in _RADAR)} FROM c""",
)
def radar(spark, sf_dir):
    out = audit.min_max_scaled(audit.compare(_flat(spark, sf_dir)), _RADAR)
    return out.withColumns({c: F.round(F.col(c), 8) for c in _RADAR})


_NAMES = ["random", "scaffold", "molecular_weight"]


@query(
    "f13_membership_matrix",
    f"WITH {PARTS} SELECT id, "
    + ", ".join(f"max(CASE WHEN splitter = '{s}' THEN CASE \"set\" WHEN 'train' THEN 'Train' ELSE 'Test' END END) AS {s}" for s in _NAMES)
    + " FROM parts WHERE split_index = 0 GROUP BY id",
)
def membership(spark, sf_dir):
    return audit.membership_matrix(part_splits(spark, sf_dir), _NAMES)


@query(
    "f14_split_activity",
    f"""WITH {LABEL_PARTS} SELECT {_KEYS}, "set", count(*) AS size, CAST(sum(toxic) AS BIGINT) AS actives, {r6("avg(toxic) * 100")} AS actives_percentage
        FROM parts JOIN labels ON doc_id = id GROUP BY ALL""",
)
def activity(spark, sf_dir):
    return rounded(audit.activity(label_splits(spark, sf_dir), _labels(spark, sf_dir)), "actives_percentage")


@query(
    "f15_group_diversity",
    f"SELECT p_brand, {r6('count(DISTINCT p_name) / CAST(count(*) AS DOUBLE)')} AS diversity FROM part GROUP BY p_brand",
)
def diversity(spark, sf_dir):
    return rounded(audit.group_diversity(_part(spark, sf_dir), "p_brand", "p_name"), "diversity")


@query(
    "f16_test_size_shares",
    f"""WITH {PARTS}, {_SIZES}, w AS (SELECT splitter, split_index, test_size / CAST(train_size + test_size AS DOUBLE) * 100 AS ood_test_size,
        CAST(0.2 AS DOUBLE) * train_size / (train_size + test_size) * 100 AS id_test_size FROM siz)
        SELECT splitter, split_index, test_type, {r6("size_ratio")} AS size_ratio FROM w UNPIVOT (size_ratio FOR test_type IN (ood_test_size, id_test_size))""",
)
def size_shares(spark, sf_dir):
    return rounded(audit.test_size_shares(audit.size_metrics(part_splits(spark, sf_dir)), audit.SPLIT), "size_ratio")


@query(
    "f17_activity_over_repeats",
    f"""WITH {LABEL_PARTS}, a AS (SELECT {_KEYS}, "set", avg(toxic) * 100 AS p FROM parts JOIN labels ON doc_id = id GROUP BY ALL)
        SELECT splitter, "set", {r6("avg(p)")} AS mean, {r6("stddev_samp(p)")} AS std FROM a GROUP BY ALL""",
)
def activity_repeats(spark, sf_dir):
    return rounded(audit.activity_over_repeats(label_splits(spark, sf_dir), _labels(spark, sf_dir)), "mean", "std")
