"""Splitters.  Splits without SQL twin are checked by their invariants in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from riftsplit.operators import cluster_split as cs
from riftsplit.operators import cut_split as cut
from riftsplit.operators import graph
from riftsplit.operators import splitters as sp
from riftsplit.operators.packed_links import coarsen_sets
from riftsplit.operators.registry import run_all_splitters, run_splitter
from riftsplit.operators.similarity import similarity_between, similarity_edges, similarity_forest
from riftsplit.plans.durable import stored
from riftsplit.queries.base import (
    BITS,
    SIGN_PAIRS,
    SIGNS,
    group_sql,
    labelled_documents,
    query,
    random_sql,
    seeded_sql,
    sign_items,
    sorted_sql,
    table,
)


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query("e2_random_split", random_sql("part", "p_partkey", 5))
def random_split(spark, sf_dir):
    return sp.random_split(_part(spark, sf_dir), "p_partkey")


@query(
    "e3_random_three_way",
    f"""WITH r AS (SELECT doc_id AS id, row_number() OVER (ORDER BY {seeded_sql(1234, "'0'", "doc_id")}) AS rk, count(*) OVER () AS n FROM documents),
        q AS (SELECT *, ceil(CAST(0.1 AS DOUBLE) * n) AS t FROM r)
        SELECT 0 AS split_index, id, CASE WHEN rk <= t THEN 'test' WHEN rk <= t + ceil(CAST(0.1 AS DOUBLE) * (n - t)) THEN 'val' ELSE 'train' END AS "set" FROM q""",
)
def random_three_way(spark, sf_dir):
    return sp.random_three_way(table(spark, sf_dir, "documents"), "doc_id")


_STRATIFIED = f"""WITH c AS (SELECT toxic AS label, count(*) AS n FROM labels GROUP BY toxic),
  a AS (SELECT *, floor(CAST(0.1 AS DOUBLE) * n) AS f, round(CAST(0.1 AS DOUBLE) * n - floor(CAST(0.1 AS DOUBLE) * n), 9) AS fr FROM c),
  b AS (SELECT label, n, f + CASE WHEN row_number() OVER (ORDER BY fr DESC, label)
    <= ceil(CAST(0.1 AS DOUBLE) * sum(n) OVER ()) - sum(f) OVER () THEN 1 ELSE 0 END AS t FROM a),
  v AS (SELECT label, t, n - t AS m, CAST(0.1 AS DOUBLE) / (CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE)) AS q FROM b),
  w AS (SELECT *, floor(q * m) AS f, round(q * m - floor(q * m), 9) AS fr FROM v),
  k AS (SELECT label, t, f + CASE WHEN row_number() OVER (ORDER BY fr DESC, label) <= ceil(q * sum(m) OVER ()) - sum(f) OVER () THEN 1 ELSE 0 END AS x FROM w),
  r AS (SELECT doc_id AS id, toxic AS label, row_number() OVER (PARTITION BY toxic ORDER BY {seeded_sql(0, "'0'", "doc_id")}) AS rk FROM labels)
  SELECT 0 AS split_index, id, CASE WHEN rk <= t THEN 'test' WHEN rk <= t + x THEN 'val' ELSE 'train' END AS "set" FROM r JOIN k USING (label)"""


@query("e4_stratified_three_way", _STRATIFIED)
def stratified_three_way(spark, sf_dir):
    return sp.stratified_three_way(table(spark, sf_dir, "labels"), "doc_id", "toxic")


@query(
    "e5_stratified_k_fold",
    f"""WITH r AS (SELECT doc_id AS id, row_number() OVER (PARTITION BY toxic ORDER BY {seeded_sql(0, "'0'", "doc_id")}) AS rk,
        count(*) OVER (PARTITION BY toxic) AS n FROM labels),
        f AS (SELECT id, (CASE WHEN rk <= floor(n * 1 / 5.0) THEN 0 WHEN rk <= floor(n * 2 / 5.0) THEN 1 WHEN rk <= floor(n * 3 / 5.0) THEN 2
          WHEN rk <= floor(n * 4 / 5.0) THEN 3 ELSE 4 END) AS fold FROM r)
        SELECT CAST(s.s AS INTEGER) AS split_index, id, CASE WHEN fold = s.s THEN 'val' ELSE 'train' END AS "set" FROM f, range(5) s(s)""",
)
def stratified_k_fold(spark, sf_dir):
    return sp.stratified_k_fold(table(spark, sf_dir, "labels"), "doc_id", "toxic")


@query("e6_group_shuffle", group_sql("part", "p_partkey", "p_brand", 5))
def group_shuffle(spark, sf_dir):
    return sp.group_shuffle(_part(spark, sf_dir), "p_partkey", "p_brand")


@query("e7_scaffold_split", group_sql("part", "p_partkey", "p_brand", 5, 0.3, 7))
def scaffold_split(spark, sf_dir):
    return sp.scaffold_split(_part(spark, sf_dir), "p_partkey", "p_brand", test_size=0.3, seed=7)


@query("e8_generic_scaffold_split", group_sql("part", "p_partkey", "split_part(p_type, ' ', 1)", 5))
def generic_scaffold_split(spark, sf_dir):
    return sp.scaffold_split(_part(spark, sf_dir), "p_partkey", F.get(F.split("p_type", " "), F.lit(0)))


@query("e9_sorted_split_larger", sorted_sql("part", "p_partkey", "p_retailprice", True))
def sorted_larger(spark, sf_dir):
    return sp.sorted_split(_part(spark, sf_dir), "p_partkey", "p_retailprice")


@query("e10_sorted_split_smaller", sorted_sql("part", "p_partkey", "p_retailprice", False))
def sorted_smaller(spark, sf_dir):
    return sp.sorted_split(_part(spark, sf_dir), "p_partkey", "p_retailprice", larger=False)


@query("e11_property_split_repeats", sorted_sql("documents", "doc_id", "n_chars", True, 5))
def property_repeats(spark, sf_dir):
    return sp.sorted_split(table(spark, sf_dir, "documents"), "doc_id", "n_chars", n_splits=5)


@query("e12_target_property_split", sorted_sql("orders", "o_orderkey", "o_totalprice", True, 1, 0.1))
def target_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    parts = run_splitter("target_property", orders, "o_orderkey", value="o_totalprice", train_size=0.9, test_size=0.1)
    return parts.drop("splitter")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


@query("e13_kmeans_split")
def kmeans_split(spark, sf_dir):
    return cs.kmeans_split(_vectors(spark, sf_dir), "vec_id", "embedding", 10)


@query("e13_kmeans_split_kernel_map")
def kmeans_kernel_split(spark, sf_dir):
    return cs.kmeans_split(_vectors(spark, sf_dir), "vec_id", "embedding", 10, metric="cityblock", n_refs=16)


@query("e14_scaffold_kmeans_split")
def scaffold_kmeans(spark, sf_dir):
    return cs.scaffold_kmeans_split(_part(spark, sf_dir), "p_partkey", "p_name", 10)


@query("e15_butina_split")
def butina(spark, sf_dir):
    return cs.butina_split(sign_items(spark, sf_dir), "id", "bits", BITS, cutoff=0.5)


# Leader clustering by the sequential rule, as one recursive step per leader.
_LEADERS = """, near AS (SELECT i AS a, j AS b FROM pairs WHERE sim >= CAST(0.5 AS DOUBLE) UNION ALL SELECT j, i FROM pairs WHERE sim >= CAST(0.5 AS DOUBLE)),
  prio AS (SELECT id, row_number() OVER (ORDER BY {order}) AS p FROM (SELECT id, (SELECT count(*) FROM near WHERE a = id) AS n FROM bits)),
  lists AS (SELECT p.p, p.id, coalesce(list(n.b) FILTER (WHERE n.b IS NOT NULL), []) AS around FROM prio p LEFT JOIN near n ON n.a = p.id GROUP BY p.p, p.id),
  walk AS (SELECT CAST(0 AS BIGINT) AS p, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS leader, CAST([] AS BIGINT[]) AS won
    UNION ALL SELECT l.p,
      CASE WHEN list_contains(w.taken, l.id) THEN w.taken ELSE list_concat(list_concat(w.taken, [l.id]), list_filter(l.around, lambda x: NOT list_contains(w.taken, x))) END,
      CASE WHEN list_contains(w.taken, l.id) THEN NULL ELSE l.id END,
      CASE WHEN list_contains(w.taken, l.id) THEN [] ELSE list_concat([l.id], list_filter(l.around, lambda x: NOT list_contains(w.taken, x))) END
    FROM walk w JOIN lists l ON l.p = w.p + 1)
  SELECT unnest(won) AS id, leader AS cluster FROM walk WHERE leader IS NOT NULL"""


@query("e15_butina_clusters", f"WITH RECURSIVE {SIGN_PAIRS}" + _LEADERS.format(order="n DESC, id"))
def butina_clusters(spark, sf_dir):
    return cs.butina_clusters(sign_items(spark, sf_dir), "id", "bits", BITS, cutoff=0.5)


@query("e16_feature_fallback_split")
def fallback(spark, sf_dir):
    return cs.butina_fallback_split(_vectors(spark, sf_dir), "vec_id", "embedding", 10)


@query("e17_embed_cluster_split")
def embed_cluster(spark, sf_dir):
    return cs.embed_cluster_split(_vectors(spark, sf_dir), "vec_id", "embedding", 10)


@query("e18_max_dissimilarity_split")
def max_dissimilarity(spark, sf_dir):
    return cs.max_dissimilarity_split(_vectors(spark, sf_dir), "vec_id", "embedding", 25)


@query("e19_perimeter_split")
def perimeter(spark, sf_dir):
    return cs.perimeter_split(_vectors(spark, sf_dir), "vec_id", "embedding", 25)


HI_THRESHOLD = 0.55  # of the component queries
HI = {"threshold": 0.45, "train_min_frac": 0.4, "test_min_frac": 0.1}
FOLDS = {"threshold": 0.5, "k": 3, "fold_min_frac": 0.15}


def _hi_parts(spark, sf_dir):
    return cut.hi_split(sign_items(spark, sf_dir), "id", "bits", BITS, **HI)


def _fold_parts(spark, sf_dir):
    return cut.hi_k_fold(sign_items(spark, sf_dir), "id", "bits", BITS, **FOLDS)


def _edges_and_sides(items, parts, threshold):
    """Every edge above the threshold, and whether it joins two different sets that are kept."""
    sides = stored(parts.select("id", "set"))
    a, b = sides.select(F.col("id").alias("src"), F.col("set").alias("a")), sides.select(F.col("id").alias("dst"), F.col("set").alias("b"))
    joined = similarity_edges(items, "id", "bits", threshold, BITS).join(a, "src").join(b, "dst")
    crosses = (F.col("a") != F.col("b")) & (F.col("a") != "discard") & (F.col("b") != "discard")
    return joined.select("src", "dst", crosses.alias("crosses"))


@query("e20_hi_split")
def hi(spark, sf_dir):
    return _hi_parts(spark, sf_dir)


@query(
    "e20_hi_split_cross_edges",
    f"WITH {SIGN_PAIRS} SELECT i AS src, j AS dst, false AS crosses FROM pairs WHERE sim > {HI['threshold']}",
)
def hi_cross_edges(spark, sf_dir):
    """All edges above the threshold; none joins train and test."""
    return _edges_and_sides(sign_items(spark, sf_dir), _hi_parts(spark, sf_dir), HI["threshold"])


@query(
    "e20_hi_split_shares",
    f"WITH {SIGNS} SELECT 0 AS split_index, count(*) AS n, true AS train_reached, true AS test_reached, true AS discards FROM bits",
)
def hi_shares(spark, sf_dir):
    """Both minimum fractions are reached, by a cut that takes items out."""
    n = F.count(F.lit(1))
    share = lambda s: F.count_if(F.col("set") == s) / n
    return _hi_parts(spark, sf_dir).groupBy("split_index").agg(
        n.alias("n"),
        (share("train") >= HI["train_min_frac"]).alias("train_reached"),
        (share("test") >= HI["test_min_frac"]).alias("test_reached"),
        (share("discard") > 0).alias("discards"),
    )


@query("e21_hi_k_fold")
def hi_folds(spark, sf_dir):
    return cut.fold_sets(_fold_parts(spark, sf_dir), FOLDS["k"])


@query(
    "e21_hi_k_fold_cross_edges",
    f"WITH {SIGN_PAIRS} SELECT i AS src, j AS dst, false AS crosses FROM pairs WHERE sim > {FOLDS['threshold']}",
)
def hi_fold_cross_edges(spark, sf_dir):
    """All edges above the threshold; none joins two parts."""
    return _edges_and_sides(sign_items(spark, sf_dir), _fold_parts(spark, sf_dir), FOLDS["threshold"])


@query(
    "e21_hi_k_fold_decisions",
    f"WITH {SIGNS} SELECT id, CAST({FOLDS['k']} AS BIGINT) AS folds, true AS tested_once_or_discarded FROM bits",
)
def hi_fold_decisions(spark, sf_dir):
    """Every item has one set in every fold: test in one of them, or taken out of all."""
    sets = cut.fold_sets(_fold_parts(spark, sf_dir), FOLDS["k"])
    tests, gone = F.count_if(F.col("set") == "test"), F.count_if(F.col("set") == "discard")
    fair = ((tests == 1) & (gone == 0)) | ((tests == 0) & (gone == FOLDS["k"]))
    return sets.groupBy("id").agg(F.countDistinct("split_index").alias("folds"), fair.alias("tested_once_or_discarded"))


@query("e22_lo_split")
def lo(spark, sf_dir):
    return cut.lo_split(sign_items(spark, sf_dir), "id", "bits", BITS, "label", threshold=0.5)


@query("e22_lo_split_isolation", f"WITH {SIGN_PAIRS} SELECT i AS src, j AS dst, false AS leaks FROM pairs WHERE sim >= CAST(0.5 AS DOUBLE)")
def lo_isolation(spark, sf_dir):
    """All pairs as similar as the threshold: none joins two test clusters, and a test cluster meets one train item, its centre."""
    items = sign_items(spark, sf_dir)
    parts = stored(cut.lo_split(items, "id", "bits", BITS, "label", threshold=0.5))
    sides = lambda end: parts.select(F.col("id").alias(end), F.col("set").alias(f"set_{end}"), F.col("cluster").alias(f"cluster_{end}"))
    pairs = stored(similarity_edges(items, "id", "bits", 0.5, BITS, inclusive=True).join(sides("src"), "src").join(sides("dst"), "dst"))
    met = [F.when((F.col(f"set_{a}") == "test") & (F.col(f"set_{b}") == "train"), F.struct(F.col(f"cluster_{a}").alias("c"), F.col(b).alias("centre"))) for a, b in (("src", "dst"), ("dst", "src"))]
    centres = pairs.select(F.coalesce(*met).alias("m")).filter("m IS NOT NULL").distinct().groupBy("m.c").agg(F.count(F.lit(1)).alias("n"))
    crowded = centres.filter("n > 1").select(F.col("c").alias("crowded"))
    two = (F.col("set_src") == "test") & (F.col("set_dst") == "test") & (F.col("cluster_src") != F.col("cluster_dst"))
    joined = pairs.withColumn("crowded", F.coalesce(*[m["c"] for m in met])).join(crowded.withColumn("many", F.lit(True)), "crowded", "left")
    return joined.select("src", "dst", (two | F.coalesce("many", F.lit(False))).alias("leaks"))


@query("e23_identity_split", group_sql("documents", "doc_id", "md5(text)", 1))
def identity_split(spark, sf_dir):
    return cs.leakage_bounded_split(table(spark, sf_dir, "documents"), "doc_id", "I", item="text", test_size=0.2)


@query("e23_cluster_packing_split")
def cluster_packing(spark, sf_dir):
    return cs.leakage_bounded_split(sign_items(spark, sf_dir), "id", "C", bits="bits", n_bits=BITS, cutoff=0.5)


@query(
    "e23_leakage_search_bounds",
    f"WITH {SIGNS} SELECT count(*) AS n, count(*) AS known, true AS whole_clusters, true AS share_kept, true AS not_above_packing FROM bits",
)
def leakage_search_bounds(spark, sf_dir):
    """The search keeps clusters whole and the share inside 0.2 +- 0.1, and never ends above plain packing."""
    items = sign_items(spark, sf_dir)
    clusters = stored(cs.butina_clusters(items, "id", "bits", BITS, 0.5))
    links = stored(similarity_between(items, "id", "bits", clusters, 0.25, BITS))
    parts = stored(cs.leakage_bounded_split(items, "id", "C", bits="bits", n_bits=BITS, cutoff=0.5))
    plain = cs.packed_clusters(clusters)[0]
    sides = stored(parts.join(clusters, "id").groupBy(F.col("cluster").alias("component")).agg(F.countDistinct("set").alias("sides"), F.min("set").alias("set")))
    before, after = cs.similarity_across(plain, links), cs.similarity_across(sides, links)
    whole = sides.agg(F.bool_and(F.col("sides") == 1)).scalar()
    share = F.count_if(F.col("set") == "test") / F.count(F.lit(1))
    return parts.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("set").isin("train", "test")).alias("known"),
        F.bool_and(whole).alias("whole_clusters"),
        (F.abs(share - 0.2) <= 0.1).alias("share_kept"),
        F.bool_and(F.lit(after <= before + 1e-6)).alias("not_above_packing"),
    )


@query("e24_cluster_group_split", group_sql("part", "p_partkey", "p_brand", 5, 0.2, 3))
def cluster_group(spark, sf_dir):
    return cs.cluster_group_split(_part(spark, sf_dir), "p_partkey", groups="p_brand", seed=3)


@query("e24_cluster_group_split_kmeans")
def cluster_group_kmeans(spark, sf_dir):
    return cs.cluster_group_split(_vectors(spark, sf_dir), "vec_id", "embedding", n_clusters=10)


@query("e25_sphere_exclusion_clusters", f"WITH RECURSIVE {SIGN_PAIRS}" + _LEADERS.format(order="id"))
def sphere_exclusion(spark, sf_dir):
    return cs.sphere_exclusion_clusters(sign_items(spark, sf_dir), "id", "bits", BITS, cutoff=0.5)


@query(
    "e26_dbscan_clusters",
    f"""WITH RECURSIVE {SIGN_PAIRS}, near AS (SELECT i AS a, j AS b, sim FROM pairs WHERE sim >= CAST(0.48 AS DOUBLE) UNION ALL SELECT j, i, sim FROM pairs WHERE sim >= CAST(0.48 AS DOUBLE)),
        core AS (SELECT id FROM bits WHERE 1 + (SELECT count(*) FROM near WHERE a = id) >= 8),
        ce AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
        reach AS (SELECT id, id AS c FROM core UNION SELECT e.b, r.c FROM reach r JOIN ce e ON e.a = r.id),
        comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id),
        border AS (SELECT n.a AS id, arg_min(comp.c, struct_pack(s := -n.sim, o := n.b)) AS c FROM near n JOIN comp ON comp.id = n.b GROUP BY n.a)
        SELECT bits.id, coalesce(comp.c, border.c, bits.id) AS cluster FROM bits LEFT JOIN comp ON comp.id = bits.id LEFT JOIN border ON border.id = bits.id""",
)
def dbscan(spark, sf_dir):
    return cs.dbscan_clusters(sign_items(spark, sf_dir), "id", "bits", BITS, eps=0.52, min_points=8)


@query(
    "e27_nested_three_way",
    f"""WITH o AS ({random_sql("part", "p_partkey", 1, 0.1)}),
        i AS ({random_sql("(SELECT id FROM o WHERE " + chr(34) + "set" + chr(34) + " = 'train')", "id", 1, 0.111111111)})
        SELECT split_index, id, CASE WHEN "set" = 'test' THEN 'val' ELSE 'train' END AS "set" FROM i
        UNION ALL SELECT split_index, id, 'test' FROM o WHERE "set" = 'test'""",
)
def nested(spark, sf_dir):
    return sp.nested_three_way(_part(spark, sf_dir), "p_partkey", sp.random_split, 0.8, 0.1)


@query(
    "e28_group_first_fit",
    """WITH RECURSIVE g AS (SELECT p_brand AS k, count(*) AS n FROM part GROUP BY p_brand),
       o AS (SELECT k, n, row_number() OVER (ORDER BY n DESC, k) AS r, sum(n) OVER () AS total FROM g),
       w AS (SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS tr, CAST(0 AS BIGINT) AS va, CAST(NULL AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS s
         UNION ALL SELECT o.r,
           CASE WHEN w.tr + o.n <= floor(CAST(0.8 AS DOUBLE) * o.total) THEN w.tr + o.n ELSE w.tr END,
           CASE WHEN w.tr + o.n <= floor(CAST(0.8 AS DOUBLE) * o.total) THEN w.va
             WHEN w.tr + w.va + o.n <= floor((CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE)) * o.total) THEN w.va + o.n ELSE w.va END, o.k,
           CASE WHEN w.tr + o.n <= floor(CAST(0.8 AS DOUBLE) * o.total) THEN 'train'
             WHEN w.tr + w.va + o.n <= floor((CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE)) * o.total) THEN 'val' ELSE 'test' END
         FROM w JOIN o ON o.r = w.r + 1)
       SELECT 0 AS split_index, p_partkey AS id, s AS "set" FROM part JOIN w ON w.k = part.p_brand""",
)
def first_fit(spark, sf_dir):
    return sp.grouped_first_fit(_part(spark, sf_dir), "p_partkey", "p_brand")


_CANDIDATES = f"""WITH p AS ({random_sql("labels", "doc_id", 100)}), j AS (SELECT p.*, toxic FROM p JOIN labels ON doc_id = id),
  g AS (SELECT split_index, abs(avg(CASE WHEN "set" = 'train' THEN toxic END) - avg(CASE WHEN "set" = 'test' THEN toxic END)) AS gap FROM j GROUP BY split_index),
  ok AS (SELECT split_index, row_number() OVER (ORDER BY split_index) - 1 AS pos FROM g WHERE gap <= 0.02)
  SELECT CAST(pos AS INTEGER) AS split_index, id, "set" FROM p JOIN ok USING (split_index) WHERE pos < 10"""


@query("e29_accepted_candidates", _CANDIDATES)
def accepted(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    shuffle = lambda d, row_id, n_splits: sp.random_split(d, row_id, n_splits=n_splits)
    return sp.accepted_candidates(labels, "doc_id", "toxic", shuffle, n_wanted=10, tolerance=0.02, max_candidates=100)


@query("e30_run_all_splitters")
def all_splitters(spark, sf_dir):
    part = _part(spark, sf_dir)
    parts, status = run_all_splitters(
        part,
        "p_partkey",
        {
            "random": {"n_splits": 2},
            "scaffold": {"scaffold": "p_brand", "n_splits": 2},
            "scaffold_generic": {"scaffold": F.split("p_type", " ")[0], "n_splits": 1},
            "group_shuffle": {"group": "p_size", "n_splits": 1},
            "molecular_weight": {"value": "p_retailprice"},
            "molecular_weight_reverse": {"value": "p_retailprice"},
            "molecular_logp": {"value": "p_size"},
            "target_property": {"value": "p_name"},
            "stratified": {"label": "p_size", "n_splits": 1},
            "butina": {"bits": "no_such_column", "n_bits": 64},
        },
    )
    sizes = parts.groupBy("splitter", "split_index", "set").agg(F.count(F.lit(1)).alias("n"))
    return status.join(sizes, "splitter", "left")


_EVERY = {
    "random": {},
    "scaffold": {"scaffold": "label"},
    "scaffold_generic": {"scaffold": "half"},
    "molecular_weight": {"value": "first"},
    "molecular_weight_reverse": {"value": "first"},
    "molecular_logp": {"value": "first"},
    "target_property": {"value": "label"},
    "stratified": {"label": "label"},
    "group_shuffle": {"group": "label"},
    "kmeans": {"features": "embedding"},
    "scaffold_kmeans": {"scaffold": "text"},
    "butina": {"bits": "bits", "n_bits": BITS, "cutoff": 0.5},
    "sphere_exclusion": {"bits": "bits", "n_bits": BITS, "cutoff": 0.5},
    "dbscan": {"bits": "bits", "n_bits": BITS, "eps": 0.52, "min_points": 8},
    "embed_cluster": {"features": "embedding"},
    "max_dissimilarity": {"features": "embedding"},
    "perimeter": {"features": "embedding"},
    "leakage_bounded": {"technique": "I", "item": "text"},
    "cluster_group": {"features": "embedding"},
    "hi": {"bits": "bits", "n_bits": BITS, **HI},
    "lo": {"bits": "bits", "n_bits": BITS, "value": "label", "threshold": 0.5},
}


@query(
    "e30_every_splitter",
    f"""WITH names AS (SELECT unnest({list(_EVERY)}) AS splitter) SELECT splitter, true AS ok, count(DISTINCT vec_id) AS n, true AS both_sides FROM names, embeddings GROUP BY splitter
        UNION ALL SELECT 'no_such_splitter', false, NULL, NULL""",
)
def every_splitter(spark, sf_dir):
    """Every registered splitter, and one that does not exist: items with a set in the first split, and whether train and test have some."""
    half = F.when(F.col("label") % 2 == 0, "even").otherwise("odd")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.get("embedding", 0).alias("first"), half.alias("half"))
    items = vectors.join(sign_items(spark, sf_dir), "id").withColumn("text", F.array_join("bits", " "))
    parts, status = run_all_splitters(items, "id", {**_EVERY, "no_such_splitter": {}})
    has = lambda s: F.count_if(F.col("set") == s) > 0
    found = parts.filter("split_index = 0").groupBy("splitter").agg(F.countDistinct("id").alias("n"), (has("train") & has("test")).alias("both_sides"))
    return status.join(found, "splitter", "left").select("splitter", "ok", "n", "both_sides")


_EDGES = f"edges AS (SELECT i AS a, j AS b FROM pairs WHERE sim > CAST({HI_THRESHOLD} AS DOUBLE) UNION ALL SELECT j, i FROM pairs WHERE sim > CAST({HI_THRESHOLD} AS DOUBLE))"
_REACH = f"WITH RECURSIVE {SIGN_PAIRS}, {_EDGES}, reach AS (SELECT id, id AS c FROM bits UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.id), comp AS (SELECT id, min(c) AS component FROM reach GROUP BY id)"


def _components(spark, sf_dir):
    items = sign_items(spark, sf_dir)
    return graph.connected_components(items, similarity_forest(items, "id", "bits", HI_THRESHOLD, BITS))


@query("e32_connected_components", f"{_REACH} SELECT id, component FROM comp")
def components(spark, sf_dir):
    return _components(spark, sf_dir)


@query(
    "e32_giant_component",
    f"""{_REACH}, s AS (SELECT component, count(*) AS size FROM comp GROUP BY component)
        SELECT component, size, row_number() OVER (ORDER BY size DESC, component) = 1 AS is_giant FROM s""",
)
def giant(spark, sf_dir):
    parts = _components(spark, sf_dir)
    return graph.giant_first(parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")))


_STRONG = _LEADERS.replace(">= CAST(0.5 AS", "> CAST(0.5 AS").format(order="n DESC, id")


@query(
    "e33_coarsened_graph",
    f"""WITH RECURSIVE {SIGN_PAIRS}{_STRONG.replace("SELECT unnest(won) AS id, leader AS cluster", ", of AS (SELECT unnest(won) AS id, leader AS cluster")}),
        links AS (SELECT DISTINCT a.cluster AS a, b.cluster AS b FROM pairs JOIN of a ON a.id = pairs.i JOIN of b ON b.id = pairs.j WHERE sim > CAST(0.45 AS DOUBLE) AND a.cluster <> b.cluster),
        ends AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM links)
        SELECT cluster AS id, count(*) AS weight, (SELECT count(*) FROM ends WHERE ends.a = of.cluster OR ends.b = of.cluster) AS n_edges FROM of GROUP BY cluster""",
)
def coarsened(spark, sf_dir):
    _, vertices, condensed = coarsen_sets(sign_items(spark, sf_dir), "id", "bits", 0.45, 0.5, BITS)
    around = graph.both_ways(condensed).groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("n_edges"))
    return vertices.join(around, "id", "left").select("id", "weight", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


_IN_ORDER = f"""{_REACH}, s AS (SELECT component, count(*) AS size FROM comp GROUP BY component),
  o AS (SELECT size, row_number() OVER (ORDER BY size DESC, component) AS r FROM s)"""


@query(
    "e34_small_components_evenly",
    f"""{_IN_ORDER}, w AS (SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c
          UNION ALL SELECT o.r, CASE WHEN a <= b AND a <= c THEN a + size ELSE a END,
            CASE WHEN NOT (a <= b AND a <= c) AND b <= c THEN b + size ELSE b END,
            CASE WHEN NOT (a <= b AND a <= c) AND NOT (b <= c) THEN c + size ELSE c END
          FROM w JOIN o ON o.r = w.r + 1),
        f AS (SELECT * FROM w ORDER BY r DESC LIMIT 1)
        SELECT 'part_0' AS "set", a AS n FROM f UNION ALL SELECT 'part_1', b FROM f UNION ALL SELECT 'part_2', c FROM f""",
)
def packed_evenly(spark, sf_dir):
    sizes = _components(spark, sf_dir).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    packed, _ = graph.pack_evenly(sizes, [0, 0, 0])
    return packed.groupBy("set").agg(F.sum("size").alias("n"))


@query(
    "e34_small_components_by_ratio",
    f"""{_IN_ORDER}, w AS (SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS tr, CAST(0 AS BIGINT) AS te, CAST(NULL AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS s
          UNION ALL SELECT o.r, CASE WHEN tr > 7 * te THEN tr ELSE tr + o.size END, CASE WHEN tr > 7 * te THEN te + o.size ELSE te END, o.size,
            CASE WHEN tr > 7 * te THEN 'test' ELSE 'train' END
          FROM w JOIN o ON o.r = w.r + 1)
        SELECT s AS "set", size, count(*) AS n FROM w WHERE s IS NOT NULL GROUP BY s, size""",
)
def packed_by_ratio(spark, sf_dir):
    sizes = _components(spark, sf_dir).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    packed = graph.pack_by_ratio(sizes, 0, 0, 7.0)[0]
    return packed.groupBy("set", "size").agg(F.count(F.lit(1)).alias("n"))


@query("e35_cut_mapped_back", f"WITH {SIGNS} SELECT id, CAST(1 AS BIGINT) AS decisions, true AS known FROM bits")
def mapped_back(spark, sf_dir):
    """Every item, copies included, has exactly one decision after a cut."""
    known = F.bool_and(F.col("set").isin("train", "test", "discard"))
    return _hi_parts(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("decisions"), known.alias("known"))


@query(
    "e36_partition_report",
    f"WITH {SIGNS} SELECT 0 AS split_index, count(*) AS n, count(*) AS weight, 3 AS sets FROM bits",
)
def partition_report(spark, sf_dir):
    """The report of a cut accounts for every item, discards included."""
    report = sp.partition_report(_hi_parts(spark, sf_dir))
    return report.groupBy("split_index").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.count(F.lit(1)).cast("int").alias("sets"))


@query(
    "e36_partition_report_three_way",
    f"""SELECT split_index, "set", count(*) AS n, count(*) AS weight FROM ({_STRATIFIED}) GROUP BY 1, 2""",
)
def partition_report_three_way(spark, sf_dir):
    docs = labelled_documents(spark, sf_dir)
    return sp.partition_report(sp.stratified_three_way(docs, "doc_id", "toxic"))
