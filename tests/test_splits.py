"""Invariants, exact small cases and determinism of the splitters."""

import random

import pytest
from helpers import brute_edges, lo, random_sets
from pyspark.sql import functions as F

from riftsplit.operators import cluster_split as cs
from riftsplit.operators import cut_split as cut
from riftsplit.operators import splitters as sp
from riftsplit.operators.registry import SPLITTERS, register_splitter, run_all_splitters, run_splitter


def frame(spark, items):
    return spark.createDataFrame(items, "id bigint, bits array<int>")


def vectors(spark, n=120, d=6):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(3.0 * (i % 5), 1.0) for _ in range(d)]) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, x array<double>")


def check_complete(parts, n, sets=("train", "test")):
    """Each split covers every id once, with no empty side."""
    for (s,) in parts.select("split_index").distinct().collect():
        rows = parts.filter(F.col("split_index") == s).collect()
        assert len(rows) == len({r["id"] for r in rows}) == n
        assert {r["set"] for r in rows} == set(sets)


VECTOR_SPLITS = {
    "kmeans": lambda d: cs.kmeans_split(d, "id", "x", 6, n_splits=2),
    "fallback": lambda d: cs.butina_fallback_split(d, "id", "x", 6, n_splits=2),
    "kernel": lambda d: cs.kmeans_split(d, "id", "x", 6, n_splits=2, metric="cityblock", n_refs=5),
    "embed": lambda d: cs.embed_cluster_split(d, "id", "x", 6, n_splits=2),
    "max_dissimilarity": lambda d: cs.max_dissimilarity_split(d, "id", "x", 8, n_splits=2),
    "perimeter": lambda d: cs.perimeter_split(d, "id", "x", 8, n_splits=2),
    "cluster_group": lambda d: cs.cluster_group_split(d, "id", "x", n_clusters=6, n_splits=2),
}


@pytest.mark.parametrize("name", VECTOR_SPLITS)
def test_vector_splitters(spark, name):
    check_complete(VECTOR_SPLITS[name](vectors(spark)), 120)


@pytest.mark.parametrize("name", ["butina", "sphere", "dbscan", "packing"])
def test_bit_splitters(spark, name):
    df = frame(spark, random_sets(150, 40, 3, copies=20))
    run = {
        "butina": lambda: cs.butina_split(df, "id", "bits", 40, 0.5, n_splits=2),
        "sphere": lambda: cs.sphere_exclusion_split(df, "id", "bits", 40, 0.5, n_splits=2),
        "dbscan": lambda: cs.dbscan_split(df, "id", "bits", 40, 0.4, 3, n_splits=2),
        "packing": lambda: cs.leakage_bounded_split(df, "id", "C", bits="bits", n_bits=40, cutoff=0.5, n_splits=2),
    }[name]
    parts = run()
    check_complete(parts, 150)
    if name == "packing":
        assert all(abs(r["count"] / 150 - 0.2) <= 0.1 for r in parts.filter("set='test'").groupBy("split_index").count().collect())


def test_same_key_same_cluster(spark):
    rows = [(i, f"ring-{i % 7}") for i in range(70)]
    df = spark.createDataFrame(rows, "id bigint, key string")
    clusters = cs.scaffold_kmeans_clusters(df, "id", "key", 3)
    assert clusters.groupBy("key").agg(F.countDistinct("cluster").alias("n")).filter("n > 1").count() == 0
    assert clusters.count() == 70


def test_random_sizes_and_seeds(spark):
    df = spark.range(100)
    for test_size, n_test in ((0.2, 20), (15, 15), (None, 20)):
        parts = sp.random_split(df, "id", n_splits=3, test_size=test_size)
        assert {r["count"] for r in parts.filter("set='test'").groupBy("split_index").count().collect()} == {n_test}
    left_out = sp.random_split(df, "id", 1, test_size=0.2, train_size=0.5)
    assert {r["set"]: r["count"] for r in left_out.groupBy("set").count().collect()} == {"train": 50, "test": 20, "discard": 30}
    a, b = (sp.random_split(df, "id", 1, seed=s).filter("set='test'") for s in (1, 2))
    assert a.join(b, "id").count() < 20
    tests = sp.random_split(df, "id", 2).filter("set='test'")
    assert tests.select("id").distinct().count() > 20  # splits differ from each other
    with pytest.raises(ValueError):
        sp.random_split(df, "id", 1, test_size=1.5)


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_partitioning_does_not_matter(spark, parts):
    df = spark.range(200).withColumns({"g": (F.col("id") % 9).cast("string"), "v": (F.col("id") * 37 % 50).cast("double")})
    moved = df.repartition(parts)
    for run in (
        lambda d: sp.random_split(d, "id", 2),
        lambda d: sp.group_shuffle(d, "id", "g", 2),
        lambda d: sp.sorted_split(d, "id", "v"),
        lambda d: sp.stratified_k_fold(d, "id", "g", 3),
        lambda d: sp.grouped_first_fit(d, "id", "g"),
    ):
        assert sorted(run(moved).collect()) == sorted(run(df).collect())


def test_hot_group_and_ties(spark):
    """Half of the rows in one group and one value: sizes stay exact."""
    df = spark.range(300).withColumns(
        {"g": F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")), "v": F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.col("id").cast("double"))}
    )
    groups = sp.group_shuffle(df, "id", "g", 4)
    assert groups.join(df, "id").groupBy("split_index", "g").agg(F.countDistinct("set").alias("n")).filter("n > 1").count() == 0
    for larger in (True, False):
        parts = sp.sorted_split(df, "id", "v", larger=larger).join(df, "id")
        assert parts.filter("set='test'").count() == 60
        lo_, hi_ = ("train", "test") if larger else ("test", "train")
        key = F.struct("v", "id")
        top = parts.filter(F.col("set") == lo_).agg(F.max(key)).first()[0]
        low = parts.filter(F.col("set") == hi_).agg(F.min(key)).first()[0]
        assert tuple(top) < tuple(low)


def test_stratified(spark):
    df = spark.range(100).withColumn("y", F.when(F.col("id") < 25, 1).otherwise(0))
    parts = sp.stratified_three_way(df, "id", "y", (0.8, 0.1, 0.1)).join(df, "id")
    sizes = {r["set"]: (r["n"], r["p"]) for r in parts.groupBy("set").agg(F.count("id").alias("n"), F.sum("y").alias("p")).collect()}
    assert {k: v[0] for k, v in sizes.items()} == {"train": 80, "val": 10, "test": 10}
    assert all(2 <= sizes[s][1] <= 3 for s in ("val", "test"))
    shuffled = sp.stratified_shuffle(df, "id", "y", 3, 0.2).join(df, "id").filter("set='test'")
    assert {(r["n"], r["p"]) for r in shuffled.groupBy("split_index").agg(F.count("id").alias("n"), F.sum("y").alias("p")).collect()} == {(20, 5)}
    for bad in (lambda: sp.stratified_three_way(df, "id", "missing"), lambda: sp.stratified_three_way(df, "id", "y", (0.5, 0.1, 0.1)), lambda: sp.stratified_three_way(df.filter("y=1"), "id", "y"), lambda: sp.stratified_three_way(df.filter("id<0"), "id", "y")):
        with pytest.raises(ValueError):
            bad()
    folds = sp.stratified_k_fold(df, "id", "y", 5)
    assert folds.filter("set='val'").groupBy("id").count().filter("count <> 1").count() == 0


def test_null_groups_travel_together(spark):
    df = spark.createDataFrame([(i, None if i < 10 else str(i)) for i in range(40)], "id bigint, g string")
    parts = sp.group_shuffle(df, "id", "g", 5).filter("id < 10")
    assert parts.groupBy("split_index").agg(F.countDistinct("set").alias("n")).filter("n > 1").count() == 0
    assert parts.count() == 50


def cross_edges(items, threshold, sets):
    return [e for e in brute_edges(items, threshold) if sets[e[0]] != sets[e[1]] and "discard" not in (sets[e[0]], sets[e[1]])]


def band(n, width=6):
    """Items in a long band: similar only to those nearby, so one big component."""
    return [(i, list(range(i, i + width))) for i in range(n)]


def test_hi_packs_components(spark):
    items = random_sets(150, 60, 6)
    parts = cut.hi_split(frame(spark, items), "id", "bits", 60, 0.6, 0.7, 0.1)
    sets = {r["id"]: r["set"] for r in parts.collect()}
    assert len(sets) == 150 and "discard" not in sets.values()
    assert cross_edges(items, 0.6, sets) == []
    assert list(sets.values()).count("train") >= 105 and list(sets.values()).count("test") >= 15


@pytest.mark.parametrize("coarse", [None, 0.75])
def test_hi_cuts_one_component(spark, coarse):
    items = band(120)
    parts = cut.hi_split(frame(spark, items), "id", "bits", 130, 0.4, 0.6, 0.15, coarsening_threshold=coarse)
    sets = {r["id"]: r["set"] for r in parts.collect()}
    counts = {s: list(sets.values()).count(s) for s in ("train", "test", "discard")}
    assert len(sets) == 120 and cross_edges(items, 0.4, sets) == []
    assert counts["train"] >= 72 and counts["test"] >= 18 and 0 < counts["discard"] <= 12


def test_hi_without_a_cut_raises(spark):
    items = [(i, [0, 1, 2, 3, 4, 5, 6, 10 + i]) for i in range(30)]  # every pair is similar
    with pytest.raises(RuntimeError):
        cut.hi_split(frame(spark, items), "id", "bits", 64, 0.4)


def test_hi_k_fold(spark):
    items = band(120)
    parts = cut.hi_k_fold(frame(spark, items), "id", "bits", 130, 0.4, k=3, fold_min_frac=0.25)
    sets = {r["id"]: r["set"] for r in parts.collect()}
    assert cross_edges(items, 0.4, sets) == []
    assert all(list(sets.values()).count(f"part_{i}") >= 30 for i in range(3))
    folds = cut.fold_sets(parts, 3)
    assert folds.filter("set='test'").groupBy("id").count().filter("count > 1").count() == 0


def test_hi_k_fold_where_cutting_parts_off_fails(spark, monkeypatch):
    monkeypatch.setattr(cut, "_cut_off", lambda *_: None)
    items = band(120)
    sets = {r["id"]: r["set"] for r in cut.hi_k_fold(frame(spark, items), "id", "bits", 130, 0.4, k=3, fold_min_frac=0.25).collect()}
    assert len(sets) == 120 and cross_edges(items, 0.4, sets) == []
    assert all(list(sets.values()).count(f"part_{i}") >= 30 for i in range(3))


@pytest.mark.parametrize("seed,copies", [(0, 0), (1, 12), (2, 30)])
def test_lo_equals_the_loop(spark, seed, copies):
    items = random_sets(110, 14, seed, 2, 6, copies)
    rng = random.Random(seed)
    values = {i: float(rng.randint(0, 9)) for i, _ in items}
    rows = [(i, b, values[i]) for i, b in items]
    df = spark.createDataFrame(rows, "id bigint, bits array<int>, y double")
    wanted = lo(items, values, 0.5, 3, 6, 0.6)
    got = {r["id"]: (r["set"], r["cluster"]) for r in cut.lo_split(df, "id", "bits", 14, "y", 0.5, 3, 6, 0.6).collect()}
    assert got == wanted
    assert any(s == "test" for s, _ in got.values())


def test_lo_without_variation(spark):
    df = spark.createDataFrame([(i, [i, 50], 1.0) for i in range(3)], "id bigint, bits array<int>, y double")
    got = cut.lo_split(df, "id", "bits", 64, "y").collect()
    assert [r["set"] for r in got] == ["train"] * 3


def test_identity_and_technique(spark):
    df = spark.createDataFrame([(i, f"item {i % 11}") for i in range(66)], "id bigint, item string")
    parts = cs.leakage_bounded_split(df, "id", "I", item="item").join(df, "id")
    assert parts.groupBy("item").agg(F.countDistinct("set").alias("n")).filter("n > 1").count() == 0
    with pytest.raises(ValueError):
        cs.leakage_bounded_split(df, "id", "Z")


def test_registry(spark):
    df = spark.range(50).withColumn("v", F.col("id").cast("double"))
    register_splitter("even_odd", lambda d, row_id, **_: d.select(F.lit(0).alias("split_index"), F.col(row_id).alias("id"), F.when(F.col(row_id) % 2 == 0, "train").otherwise("test").alias("set")))
    try:
        parts, status = run_all_splitters(df, "id", {"even_odd": {}, "random": {"n_splits": 1}, "scaffold": {"scaffold": "nope"}, "no_such": {}})
        assert {r["splitter"]: r["ok"] for r in status.collect()} == {"even_odd": True, "random": True, "scaffold": False, "no_such": False}
        assert {r["splitter"] for r in parts.select("splitter").distinct().collect()} == {"even_odd", "random"}
    finally:
        SPLITTERS.pop("even_odd")
    with pytest.raises(ValueError):
        run_splitter("no_such", df, "id")


def test_accepted_candidates(spark):
    df = spark.range(60).withColumn("y", (F.col("id") % 2).cast("int"))
    shuffle = lambda d, r, n_splits: sp.random_split(d, r, n_splits=n_splits)
    parts = sp.accepted_candidates(df, "id", "y", shuffle, 4, 0.15, 40, 10)
    share = parts.join(df, "id").groupBy("split_index").agg(
        F.abs(F.avg(F.when(F.col("set") == "train", F.col("y"))) - F.avg(F.when(F.col("set") == "test", F.col("y")))).alias("gap")
    )
    rows = share.collect()
    assert {r["split_index"] for r in rows} == {0, 1, 2, 3} and all(r["gap"] <= 0.15 for r in rows)
    assert sp.accepted_candidates(df, "id", "y", shuffle, 4, -1.0, 10, 10).count() == 0


def test_similarity_search_parts_linked_clusters_together(spark):
    """Planted: ten chains of linked clusters; packing by size cuts them, moving puts each on one side."""
    rng = random.Random(8)
    sizes = {c: rng.randint(3, 9) for c in range(60)}
    links = [(c, c + 1, 5.0) for c in range(60) if c % 6 < 5] + [(a, b, 0.1) for a, b in ((1, 20), (7, 33), (14, 50))]
    packed = spark.createDataFrame([(c, n, "test" if c % 5 == 0 else "train") for c, n in sizes.items()], "component bigint, size bigint, `set` string")
    table = spark.createDataFrame(links, "src bigint, dst bigint, sim double")
    n = sum(sizes.values())
    low, high = int(0.1 * n), int(0.3 * n)

    def across(sets):
        return sum(w for a, b, w in links if sets[a] != sets[b])

    got = {r["component"]: (r["size"], r["set"]) for r in cs.lower_similarity_across(packed, table, low, high).collect()}
    sets = {c: s for c, (_, s) in got.items()}
    start = {r["component"]: r["set"] for r in packed.collect()}
    assert {c: k for c, (k, _) in got.items()} == sizes
    assert low <= sum(sizes[c] for c, s in sets.items() if s == "test") <= high
    assert across(sets) < across(start) and cs.similarity_across(packed, table) == pytest.approx(across(start))
    room = {"test": high - sum(sizes[c] for c in sets if sets[c] == "test"), "train": sum(sizes[c] for c in sets if sets[c] == "test") - low}
    for c in sizes:  # no single move is left
        other = "test" if sets[c] == "train" else "train"
        if sizes[c] <= room[other]:
            assert across({**sets, c: other}) >= across(sets) - 1e-9


def test_identity_split_keeps_the_share_of_rows(spark):
    """One item makes up a third of the rows: a share of items alone would miss the share of rows."""
    rows = [(i, "hot" if i % 3 == 0 else f"item{i // 2}") for i in range(300)] + [(1000, None), (1001, None)]
    df = spark.createDataFrame(rows, "id bigint, item string")
    parts = cs.leakage_bounded_split(df, "id", "I", item="item", n_splits=6, test_size=0.2, delta=0.05).join(df, "id")
    for s in range(6):
        got = parts.filter(F.col("split_index") == s).collect()
        assert len(got) == len(rows) and abs(sum(r["set"] == "test" for r in got) / len(got) - 0.2) <= 0.05
        assert all(len({r["set"] for r in got if r["item"] == k}) == 1 for k in {r["item"] for r in got})


def test_lo_decides_many_centres_a_round(spark, monkeypatch):
    """Far-apart neighbourhoods and touching ones: a batch gives what one centre a round gives, in fewer rounds."""
    rng = random.Random(12)
    items, values = [], {}
    for block in range(9):
        for _ in range(rng.randint(5, 12)):
            items.append((len(items), sorted(block * 8 + b for b in rng.sample(range(8), rng.randint(3, 6)))))
    items += [(len(items) + k, sorted({8 * k + 7, 8 * k + 8, 8 * k + 9})) for k in range(4)]
    values = {i: rng.choice([0.0, 1.0, 3.0]) for i, _ in items}
    df = spark.createDataFrame([(i, b, values[i]) for i, b in items], "id bigint, bits array<int>, y double")
    wanted = lo(items, values, 0.5, 3, 12, 0.4)
    rounds = []
    real = cut._next_centres
    monkeypatch.setattr(cut, "_next_centres", lambda *a: rounds.append(real(*a)) or rounds[-1])
    for batch in (1, 6):
        got = {r["id"]: (r["set"], r["cluster"]) for r in cut.lo_split(df, "id", "bits", 80, "y", 0.5, 3, 12, 0.4, batch=batch).collect()}
        assert got == wanted
    n = sum(len(set(r)) for r in rounds) // 2
    assert n > 3 and len(rounds) < 2 * n and max(len(r) for r in rounds) > 1


def test_lo_writes_no_edges_beside_their_directions(spark, monkeypatch):
    written = []
    monkeypatch.setattr(cut, "stored", lambda df: (written.append(df.columns), cut.durable(df))[1])
    items = frame(spark, [(i, [i, i + 1]) for i in range(6)]).withColumn("y", F.col("id") * 1.0)
    cut.lo_split(items, "id", "bits", 130, "y")
    assert written and not [c for c in written if "src" in c]
