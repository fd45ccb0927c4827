"""Cleaning, sources, sinks, features, similarity lookups: exact cases and errors."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riftsplit.functions import bits
from riftsplit.functions.bits import shingle_fingerprint
from riftsplit.operators import clean, features, train
from riftsplit.operators import similarity as sim
from riftsplit.operators.splitters import random_split
from riftsplit.plans.durable import spread
from riftsplit.queries import QUERIES
from riftsplit.sources import items, runs, sinks


def test_conflicting_duplicates(spark):
    keys = ["CC", "CC", "CC", "CCC", "CCC", "CCCC", "CCCCC", "CCCCC"]
    labels = [1, 1, 0, 1, 1, 1, 1, 0]
    df = spark.createDataFrame(list(zip(range(8), keys, labels)), "id bigint, smiles string, label int")
    out = clean.standardize(df, "smiles", "label", "id", F.col("smiles"))
    assert {(r["id"], r["item"], r["label"]) for r in out.collect()} == {(3, "CCC", 1), (5, "CCCC", 1)}
    steps = clean.first_per_key(clean.drop_conflicting(df, "smiles", "label"), "smiles", "id")
    assert {(r["smiles"], r["label"]) for r in steps.collect()} == {("CCC", 1), ("CCCC", 1)}
    with pytest.raises(ValueError):
        clean.standardize(df.drop("label"), "smiles", "label", "id")


def test_null_labels_and_keys(spark):
    rows = [(0, "a", None), (1, "a", 1), (2, "b", None), (3, " ", 1), (4, None, 0)]
    df = spark.createDataFrame(rows, "id bigint, item string, label int")
    out = {(r["id"], r["item"], r["label"]) for r in clean.standardize(df, "item", "label", "id").collect()}
    assert out == {(0, "a", None)}  # the first row of a key stays, with its null label


def test_downsample(spark):
    df = spark.createDataFrame([(i, int(i < 20)) for i in range(100)], "id bigint, label int")
    out = clean.downsample_majority(df, "id", "label", 1.5)
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 30, 1: 20}
    assert sorted(out.collect()) == sorted(clean.downsample_majority(df.repartition(7), "id", "label", 1.5).collect())
    with pytest.raises(ValueError):
        clean.downsample_majority(df.withColumn("label", 1 - F.col("label")), "id", "label")


def test_read_items(spark, tmp_path):
    for name, sep in (("a.csv", ","), ("b.tsv", "\t"), ("c.txt", "\t")):
        path = tmp_path / name
        path.write_text(f"smiles{sep}label\nCCO{sep}1\n{sep}0\nCC{sep}1\n")
        df = items.read_items(spark, str(path), ["smiles", "label"], "smiles string, label double")
        assert df.count() == 3
        kept, counts = items.drop_missing_items(df, "smiles")
        assert kept.count() == 2 and items.ensure_any(counts) == (3, 1)
        with pytest.raises(ValueError):
            items.read_items(spark, str(path), ["activity"])
    one = tmp_path / "one.csv"
    one.write_text("whatever\nCCO\nCCN\n")
    assert items.read_items(spark, str(one), ["smiles"]).columns == ["smiles"]
    blank = tmp_path / "blank.csv"
    blank.write_text('smiles,label\n"",1\n')
    _, counts = items.drop_missing_items(items.read_items(spark, str(blank), ["smiles"]), "smiles")
    with pytest.raises(ValueError):
        items.ensure_any(counts)


PAIRS = [(0, 1, 0.5), (0, 2, 0.2), (0, 3, 0.3), (1, 2, 0.4), (1, 3, 0.1), (2, 3, 0.6)]


@pytest.fixture()
def pairs(spark):
    return spark.createDataFrame(PAIRS, "i bigint, j bigint, distance double")


def test_stored_distances(spark, pairs):
    train = spark.createDataFrame([(0,), (2,)], "id bigint")
    test = spark.createDataFrame([(1,), (3,)], "id bigint")
    block = sim.block_of(pairs, train, test)
    assert {(r["train_id"], r["test_id"]): r["distance"] for r in block.collect()} == {(0, 1): 0.5, (0, 3): 0.3, (2, 1): 0.4, (2, 3): 0.6}
    near = {r["test_id"]: r["distance"] for r in sim.nearest_stored(block, 1).collect()}
    assert near == {1: 0.4, 3: 0.3}
    assert sim.nearest_stored(block, 9).count() == 4  # fewer train rows than k: all of them
    with pytest.raises(ValueError):
        sim.nearest_stored(block, 0)


def test_block_of_stored_distances_is_computed_without_the_rest(spark, monkeypatch):
    monkeypatch.setattr(sim, "ROWS_PER_BLOCK", 5)
    monkeypatch.setattr(sim, "ROWS_PER_REDUCED_BLOCK", 7)
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(40)], "id bigint, vec array<double>")
    train, test = df.filter("id % 4 <> 0"), df.filter("id % 4 = 0")
    want = sim.block_of(sim.distance_matrix(df, "id", "vec"), train, test)
    cells = lambda d: sorted((r["test_id"], r["train_id"], round(r["distance"], 9)) for r in d.collect())
    assert cells(sim.block_between(train, test)) == cells(want)
    near = sim.block_between(train, test, k=3)
    assert near.count() < want.count() and cells(sim.nearest_stored(near, 3)) == cells(sim.nearest_stored(want, 3))  # equal distances: lower id
    best = lambda d: {r["id"]: round(r["similarity"], 9) for r in sim.best_stored(d).collect()}
    assert best(sim.block_between(train, test, k=1)) == best(want)


@pytest.mark.parametrize("metric,block", [("euclidean", None), ("cityblock", 16), ("cosine", 7), ("jaccard", 16)])
def test_matrix_rounded_in_the_tasks(spark, metric, block):
    vec = lambda i: [i % 5, 5 + i % 3, 8 + i % 7] if metric == "jaccard" else [float(i % 5) + 1e-4 * i, float(i % 3) - 1.0, 1.0]
    df = spark.createDataFrame([(3 * i, vec(i)) for i in range(60)], f"id bigint, vec array<{'int' if metric == 'jaccard' else 'double'}>")
    got = [tuple(r) for r in sim.distance_matrix(df, "id", "vec", metric, 15, block, digits=3).collect()]
    whole = {(r["i"], r["j"]): r["distance"] for r in sim.distance_matrix(df, "id", "vec", metric, 15).collect()}
    assert len(got) == len(whole) == 60 * 59 // 2 and all(i < j for i, j, _ in got)
    assert all(abs(d - whole[i, j]) < 0.000501 and d == round(d, 3) for i, j, d in got)
    odd = spark.createDataFrame([(0, [0.0]), (1, [float("nan")]), (2, [1e15])], "id bigint, vec array<double>")  # no order to pack
    assert {(r["i"], r["j"]): r["distance"] for r in sim.distance_matrix(odd, "id", "vec", "cityblock", digits=3).collect()}[0, 2] == 1e15


def test_matrix_query_takes_few_bytes_a_pair(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 64))
    x = (0.45 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    QUERIES["d2_distance_matrix_euclidean"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    n = spark.read.parquet(str(tmp_path / "out")).count()
    assert n == 2000 * 1999 // 2 and sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 6.5 * n


def test_profile_of_a_matrix_without_its_rows(spark):
    df = spark.createDataFrame([(i, [float(i * i % 11), float(i)]) for i in range(30)], "id bigint, vec array<double>")
    rows = lambda d: [tuple(round(v, 9) for v in r) for r in d.collect()]
    for part in (df, df.filter("id < 2")):
        assert rows(items.matrix_distance_profile(part, "id", "vec")) == rows(items.distance_profile(sim.distance_matrix(part, "id", "vec")))
    alone = items.matrix_distance_profile(df.filter("id < 1"), "id", "vec").first()
    assert (alone["n_items"], alone["n_pairs"], alone["lo"], alone["is_complete"]) == (1, 0, None, True)


def test_distance_source_checks(spark, pairs):
    assert items.read_distances(spark, pairs, 4).filter("abs(similarity + distance - 1) > 1e-12").count() == 0
    with pytest.raises(ValueError):
        items.read_distances(spark, pairs, 5)
    with pytest.raises(ValueError):
        items.read_distances(spark, pairs.filter("j < 3 or i > 0"), 4)
    with pytest.raises(TypeError):
        items.read_distances(spark, [[0.0]], 4)
    with pytest.warns(UserWarning):
        items.read_distances(spark, pairs.withColumn("distance", F.col("distance") * 3), 4)


def test_alignment(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "pos bigint, item string")
    b = spark.createDataFrame([(1, "y"), (2, "x")], "pos bigint, item string")
    assert items.aligned_items(a, a)[1] is True
    kept, labels_apply = items.aligned_items(a, b)
    assert labels_apply is False and kept.filter("pos = 1").first()["item"] == "y"
    with pytest.raises(ValueError):
        items.aligned_items(a, b.filter("pos = 1"))


@pytest.mark.parametrize("subset,ids", [(["CCO", "CCC"], {0, 2}), (["CCB", "CCL"], set()), (["CCO", "CCL"], {0})])
def test_rows_of_items(spark, subset, ids):
    original = spark.createDataFrame(list(enumerate(["CCO", "CCN", "CCC", "CCF"])), "id bigint, smiles string")
    got = sim.rows_of_items(original, spark.createDataFrame([(s,) for s in subset], "smiles string"), "smiles")
    assert {r["id"] for r in got.collect()} == ids


def test_run_files(spark, tmp_path):
    for repeat in (1, 2):
        folder = tmp_path / "ds" / "random" / "rf" / str(repeat)
        folder.mkdir(parents=True)
        (folder / "eval.txt").write_text("Best score: 0.9\nTest accuracy: 0.8\nnote\n")
        (folder / "prediction.csv").write_text("smiles,label\nCC,0.3\nCO,0.7\n")
    m = runs.read_run_metrics(spark, str(tmp_path))
    assert {(r["repeat"], r["metric"], r["value"]) for r in m.filter("value is not null").collect()} == {
        (r, n, v) for r in (1, 2) for n, v in (("Best score", 0.9), ("Test accuracy", 0.8))
    }
    p = runs.read_run_predictions(spark, str(tmp_path), "smiles string, label double")
    assert p.filter("dataset='ds' and split='random' and model='rf'").groupBy("repeat").count().count() == 2
    for name, text in (("r1.csv", "a,b\n1,2\n"), ("r2.csv", "a\n3\n")):
        (tmp_path / name).write_text(text)
    both = runs.read_results(spark, [str(tmp_path / "r1.csv"), str(tmp_path / "r2.csv")])
    assert {(r["a"], r["b"]) for r in both.collect()} == {(1, 2), (3, None)}


def test_tasks_group_a_bounded_number_of_rows(spark):
    df = spark.range(3000, numPartitions=1).select((F.col("id") % 1000).alias("item"), "id", F.concat(F.lit("t"), (F.col("id") % 2).cast("string")).alias("task"))
    placed = spread(df, "item", rows_per_task=300)
    held = placed.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("id").alias("n"), F.countDistinct("item").alias("k")).collect()
    assert placed.rdd.getNumPartitions() == 10 and sum(r["n"] for r in held) == 3000 and sum(r["k"] for r in held) == 1000  # no item in two tasks
    assert max(r["n"] for r in held) < 600
    plan = sinks.prediction_table(placed.groupBy("item", "task").agg(F.max("id").alias("score")), "item", tasks=["t0", "t1"])
    assert plan.count() == 1000
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1  # that of the placement serves both groupings


def test_scores_are_decided_without_scoring_again(spark):
    df = spark.createDataFrame([(0.2,), (0.5,), (0.9,), (None,)], "soft double")
    assert [r["h"] for r in df.select(train.decided("soft").alias("h")).collect()] == [0.0, 1.0, 1.0, None]


def test_training_rows_lie_in_as_few_partitions_as_they_need(spark):
    df = spark.range(4000).repartition(13)
    one, four = train.placed_for_training(df, 64), train.placed_for_training(df, 64, bytes_per_partition=1000 * 64 * 8)
    assert one.rdd.getNumPartitions() == 1 and [r["id"] for r in one.collect()] == list(range(4000))
    assert four.rdd.getNumPartitions() == 4 and four.count() == 4000
    again = train.placed_for_training(spark.range(3999, -1, -1, numPartitions=3), 64, bytes_per_partition=1000 * 64 * 8)
    assert four.collect() == again.collect()  # whatever the layout of the input


def test_sinks(spark, tmp_path):
    parts = random_split(spark.range(40), "id", 2).withColumn("splitter", F.lit("random"))
    path = str(tmp_path / "parts")
    sinks.write_assignments(parts, path)
    back = spark.read.parquet(path)
    assert back.count() == 80 and os.path.isdir(f"{path}/splitter=random/split_index=1/set=test")
    with pytest.raises(Exception):
        sinks.write_assignments(parts, path)
    nested = spark.range(1).select(F.struct(F.lit(1).alias("a")).alias("size_metrics"))
    sinks.write_report(nested, str(tmp_path / "json"), "json")
    text = "".join(p.read_text() for p in (tmp_path / "json").glob("*.json"))
    assert json.loads(text) == {"size_metrics": {"a": 1}}
    sinks.write_report(spark.range(2), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_report(nested, path, "xml")
    chunks = sinks.chunked(spark.range(10).withColumnRenamed("id", "source"), "source", 4)
    assert {r["chunk"]: r["count"] for r in chunks.groupBy("chunk").count().collect()} == {0: 4, 1: 4, 2: 2}
    d = sim.cross_distances(spark.createDataFrame([(i, [float(i)]) for i in range(10)], "id bigint, v array<double>"), spark.createDataFrame([(0, [0.0])], "id bigint, v array<double>"), "id", "id", "v", "euclidean")
    sinks.write_distance_chunks(d, chunks, str(tmp_path / "dist"))
    assert spark.read.parquet(str(tmp_path / "dist")).filter("chunk = 1").count() == 4


@pytest.mark.parametrize("chunk,sources,targets", [(7, 21, 11), (30, 8, 64)])
def test_matrix_chunks_are_written_without_a_shuffle_of_pairs(spark, tmp_path, chunk, sources, targets):
    df = spark.createDataFrame([(3 * i, [float(i % 9), float(i)]) for i in range(50)], "id bigint, v array<double>")
    sinks.write_matrix_chunks(df, "id", "v", str(tmp_path / "m"), chunk, "euclidean", None, sources, targets)
    pairs = sim.mirrored(sim.distance_matrix(df, "id", "v")).select(F.col("i").alias("source"), F.col("j").alias("target"), "distance")
    sinks.write_distance_chunks(pairs, sinks.chunked(df.select(F.col("id").alias("source")), "source", chunk), str(tmp_path / "w"))
    got, want = ({(r["source"], r["target"], r["chunk"]): r["distance"] for r in spark.read.parquet(str(tmp_path / f)).collect()} for f in "mw")
    assert len(got) == 50 * 49 and got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-9) for p in got)


def test_fingerprint_of_long_texts_is_made_by_pieces(monkeypatch):
    texts = ["abcdefghij" * 7 + "xyz", "", "abc", "na" * 40, "q" * 9]
    for q in (1, 4):
        for chars in (1, 5, 16, 1000):
            pieces = [p for batch in bits.slice_pieces(texts, q, chars) for p in batch]
            assert max(len(t) for _, t in pieces) <= chars + q - 1
            assert all(sum(len(t) for _, t in batch) <= chars + q - 1 for batch in bits.slice_pieces(texts, q, chars))
            for row, text in enumerate(texts):
                grams = [p[i : i + q] for r, p in pieces if r == row for i in range(len(p) - q + 1)]
                assert sorted(grams) == sorted(text[i : i + q] for i in range(len(text) - q + 1))
    monkeypatch.setattr(bits, "SLICE_CHARS", 1 << 20)
    want = [b.tolist() for b in bits.fingerprints(pd.Series(texts), 4, 1024)]
    monkeypatch.setattr(bits, "SLICE_CHARS", 10)
    assert [b.tolist() for b in bits.fingerprints(pd.Series(texts), 4, 1024)] == want


def test_fingerprints(spark):
    df = spark.createDataFrame([(0, "abcdabcd"), (1, "abc"), (2, None), (3, "é☃𝄞x")], "id bigint, t string")
    got = {r["id"]: r["b"] for r in df.select("id", shingle_fingerprint(F.col("t"), 4, 1 << 15).alias("b")).collect()}
    assert len(got[0]) == 4 and got[1] == [] and got[2] == [] and len(got[3]) == 1
    assert got[0] == sorted(got[0])
    with pytest.raises(Exception):
        df.select(shingle_fingerprint(F.col("t"), on_invalid="raise")).collect()
    with pytest.raises(ValueError):
        shingle_fingerprint(F.col("t"), on_invalid="ignore")


def test_kernel_map_is_independent_of_partitions(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "id bigint, v array<double>")
    a, b = (features.kernel_map(d, "id", "v", 4) for d in (df, df.repartition(9)))
    assert sorted(a.collect()) == sorted(b.collect())
    assert all(len(r["features"]) == 4 for r in a.collect())
    with pytest.raises(ValueError):
        features.kernel_map(df, "id", "v", 0)


def test_small_blocks_give_the_same_neighbours(spark):
    df = spark.createDataFrame([(i, [float(i * 7 % 31), float(i % 5)]) for i in range(60)], "id bigint, vec array<double>")
    left, right = df.filter("id % 3 = 0"), df.filter("id % 3 <> 0")
    one, many = (sorted(sim.nearest(left, right, [], 3, rows_per_block=r).select("lid", "rid", "rank").collect()) for r in (1000, 7))
    assert one == many and len(one) == 60
    with pytest.raises(ValueError):
        sim.nearest(left, right, [], 0)


def test_split_config_and_status(spark, tmp_path):
    rows = [('a "q"', 0, i, "test" if i < 3 else "train") for i in range(10)] + [('a "q"', 1, i, "train") for i in range(10)] + [("b", 0, 1, "discard")]
    parts = spark.createDataFrame(rows, "splitter string, split_index int, id bigint, `set` string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "id bigint, label int")
    sinks.write_split_config(parts, str(tmp_path / "config"), labels)
    records = [json.loads(line) for f in (tmp_path / "config").glob("*.txt") for line in f.read_text().splitlines()]
    got = {r.pop("splitter_name"): r for r in records}
    a = got['a "q"']
    assert a["successful_splits"] == 2 and a["train_size_0"] == 7 and a["test_size_0"] == 3 and a["train_size_1"] == 10
    assert a["test_actives_0"] == 1 and a["train_actives_0"] == 3 and a["test_actives_percentage_0"] == pytest.approx(1 / 3)
    assert a["test_size_1"] == 0 and a["test_actives_percentage_1"] is None
    assert got["b"]["train_size_0"] == got["b"]["test_size_0"] == 0
    sinks.write_split_config(parts.filter("false"), str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none")).isEmpty()
    status = spark.createDataFrame([('a "q"', True, None), ("c", False, "ValueError: x")], "splitter string, ok boolean, error string")
    sinks.write_status(status, parts, str(tmp_path / "status"))
    read = {r["splitter"]: (r["ok"], r["n_splits"]) for r in spark.read.json(str(tmp_path / "status")).collect()}
    assert read == {'a "q"': (True, 2), "c": (False, 0)}
