"""Similarity join, graph operators and packing against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import brute_edges, components, leaders, random_sets, tanimoto
from pyspark.sql import functions as F

from riftsplit.operators import graph, similarity
from riftsplit.operators.cluster_split import butina_clusters, dbscan_clusters, sphere_exclusion_clusters
from riftsplit.operators.similarity import best_in_other_set, collapse_copies, compared_pairs, nearest_sets, similarity_edges, with_words


def frame(spark, items):
    return spark.createDataFrame(items, "id bigint, bits array<int>")


@pytest.mark.parametrize("n_bits, block", [(24, 16), (150, 1024)])
@pytest.mark.parametrize("threshold,inclusive", [(0.4, False), (0.5, True), (0.7, False), (0.0, False), (1.0, True)])
def test_similarity_edges(spark, n_bits, block, threshold, inclusive):
    items = random_sets(120, n_bits, 1, high=8 if n_bits == 24 else 60, copies=25) + [(900, [])]
    got = similarity_edges(frame(spark, items), "id", "bits", threshold, n_bits, inclusive=inclusive, rows_per_block=block)
    found = {(r["src"], r["dst"]): r["sim"] for r in got.collect()}
    wanted = brute_edges(items, threshold, inclusive)
    assert found.keys() == wanted.keys()
    assert all(abs(found[k] - wanted[k]) < 1e-12 for k in wanted)


def test_similarity_edges_self_loops(spark):
    items = random_sets(20, 16, 2)
    got = similarity_edges(frame(spark, items), "id", "bits", 0.5, 16, self_loops=True).filter("src = dst")
    assert got.count() == 20


def test_each_edge_once(spark):
    items = random_sets(150, 20, 5, copies=50)
    got = similarity_edges(frame(spark, items), "id", "bits", 0.3, 20, rows_per_block=8)
    assert got.count() == got.distinct().count() == len(brute_edges(items, 0.3))


def test_lengths_and_places_rule_pairs_out(spark):
    items = random_sets(300, 400, 4, low=2, high=60)
    compared = compared_pairs(frame(spark, items), "id", "bits", 0.6, 400)
    assert len(brute_edges(items, 0.6)) <= compared < 300 * 299 // 2 // 4


@pytest.mark.parametrize("plan", ["postings", "grid", None])
def test_best_in_other_set(spark, plan):
    items = random_sets(90, 40, 11, copies=20) + [(500, []), (501, [39])]
    left = [(i % 2, i, b) for i, b in items if i % 3 == 0 or i >= 500]
    right = [(g, i, b) for i, b in items if i % 3 and i < 500 for g in (0, 1)]
    schema = "g int, id bigint, bits array<int>"
    out = best_in_other_set(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["g"], 40, 16, plan)
    got = {(r["g"], r["id"]): (r["match"], r["similarity"]) for r in out.collect()}
    assert len(got) == len(left)
    for g, i, b in left:
        match, s = min(((j, tanimoto(b, c)) for h, j, c in right if h == g), key=lambda p: (-p[1], p[0]))
        assert got[(g, i)] == (match, pytest.approx(s))


def test_collapse_copies(spark):
    members, reps = collapse_copies(frame(spark, random_sets(60, 30, 3, copies=20)), "id", "bits")
    weights = {r["id"]: r["weight"] for r in reps.collect()}
    assert sum(weights.values()) == 60 and weights[0] >= 21
    assert members.count() == 60


def random_graph(n, m, seed):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


@pytest.mark.parametrize("n,m,seed", [(80, 60, 0), (200, 150, 1), (50, 0, 2)])
def test_components(spark, n, m, seed):
    edges = random_graph(n, m, seed)
    v = spark.range(n)
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = {r["id"]: r["component"] for r in graph.connected_components(v, e).collect()}
    assert got == components(range(n), edges)


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100)]
    hub = [(200, 201 + i) for i in range(100)]
    e = spark.createDataFrame(chain + hub, "src bigint, dst bigint")
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.range(302), e).collect()}
    assert set(got[i] for i in range(101)) == {0} and set(got[i] for i in range(200, 301)) == {200}
    assert got[301] == 301


@pytest.mark.parametrize("seed", [0, 1])
def test_leader_clusters(spark, seed):
    n, edges = 90, random_graph(90, 160, seed)
    degree = Counter(x for e in edges for x in e)
    v = spark.createDataFrame([(i, -degree[i]) for i in range(n)], "id bigint, neg bigint")
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = {r["id"]: r["leader"] for r in graph.leader_clusters(v, e, ["neg"]).collect()}
    assert got == leaders(range(n), edges, lambda i, _: -degree[i])


def test_butina_counts_copies(spark):
    items = random_sets(100, 24, 7, copies=30)
    edges = list(brute_edges(items, 0.5, inclusive=True))
    wanted = leaders([i for i, _ in items], edges, lambda i, around: -len(around[i]))
    got = {r["id"]: r["cluster"] for r in butina_clusters(frame(spark, items), "id", "bits", 24, cutoff=0.5).collect()}
    assert got == wanted


def test_sphere_exclusion(spark):
    items = random_sets(100, 24, 8, copies=10)
    wanted = leaders([i for i, _ in items], list(brute_edges(items, 0.5, True)), lambda i, _: 0)
    got = {r["id"]: r["cluster"] for r in sphere_exclusion_clusters(frame(spark, items), "id", "bits", 24, 0.5).collect()}
    assert got == wanted


def test_dbscan(spark):
    items = random_sets(110, 24, 9, copies=15)
    edges = brute_edges(items, 0.5, True)
    around = {i: {} for i, _ in items}
    for (a, b), s in edges.items():
        around[a][b] = around[b][a] = s
    core = {i for i in around if 1 + len(around[i]) >= 5}
    comp = components(core, [e for e in edges if e[0] in core and e[1] in core])
    got = {r["id"]: r["cluster"] for r in dbscan_clusters(frame(spark, items), "id", "bits", 24, 0.5, 5).collect()}
    for i, _ in items:
        if i in core:
            assert got[i] == comp[i]
        else:
            near = [j for j in around[i] if j in core]
            best = max((around[i][j] for j in near), default=None)
            assert got[i] in {comp[j] for j in near if around[i][j] == best} if near else got[i] == i


def test_coarsen(spark):
    items = random_sets(80, 20, 10)
    edges = brute_edges(items, 0.3)
    rows = [(a, b, s) for (a, b), s in edges.items()]
    e = spark.createDataFrame(rows, "src bigint, dst bigint, sim double")
    v = spark.range(80).withColumn("weight", F.lit(1))
    members, vertices, condensed = graph.coarsen(v, e, 0.5)
    strong = [k for k, s in edges.items() if s > 0.5]
    wanted = leaders(range(80), strong, lambda i, around: -len(around[i]))
    got = {r["id"]: r["leader"] for r in members.collect()}
    assert got == wanted
    assert {r["id"]: r["weight"] for r in vertices.collect()} == dict(Counter(wanted.values()))
    links = {tuple(sorted((wanted[a], wanted[b]))) for a, b in edges if wanted[a] != wanted[b]}
    assert {(r["src"], r["dst"]) for r in condensed.collect()} == links


def groups(spark, sizes):
    return spark.createDataFrame(list(enumerate(sizes)), "component bigint, size bigint")


@pytest.mark.parametrize("start", [(0, 0), (50, 0), (10, 30)])
def test_pack_by_ratio_equals_the_loop(spark, start):
    sizes = [9, 7, 7, 4, 4, 4, 2] + [1] * 37
    train, test = start
    for s in sorted(sizes, reverse=True):
        if train > 3.5 * test:
            test += s
        else:
            train += s
    packed, got_train, got_test = graph.pack_by_ratio(groups(spark, sizes), *start, 3.5)
    assert (got_train, got_test) == (train, test)
    per = {r["set"]: r["n"] for r in packed.groupBy("set").agg(F.sum("size").alias("n")).collect()}
    assert per.get("train", 0) == train - start[0] and per.get("test", 0) == test - start[1]


def test_pack_evenly_equals_the_loop(spark):
    sizes = [12, 5, 5, 5, 3, 3] + [1] * 20
    parts = [4, 0, 0]
    for s in sorted(sizes, reverse=True):
        parts[parts.index(min(parts))] += s
    packed, got = graph.pack_evenly(groups(spark, sizes), [4, 0, 0])
    assert got == parts
    per = {r["set"]: r["n"] for r in packed.groupBy("set").agg(F.sum("size").alias("n")).collect()}
    assert [per.get(f"part_{i}", 0) for i in range(3)] == [parts[0] - 4, parts[1], parts[2]]


def test_hop_layers(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 4)], "src bigint, dst bigint")
    got = {r["id"]: r["layer"] for r in graph.hop_layers(spark.range(6), e, 0).collect()}
    assert got == {0: 0, 1: 1, 4: 1, 2: 2, 3: 3}


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(400)], [(0, i) for i in range(1, 401)]], ids=["chain", "hub"])
def test_components_take_few_rounds(spark, monkeypatch, links):
    rounds, write = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: rounds.append(1) or write(df))
    edges = spark.createDataFrame(links, "src bigint, dst bigint")
    got = graph.connected_components(spark.range(401), edges)
    assert got.filter("component <> 0").isEmpty()
    assert len(rounds) <= 14


@pytest.mark.parametrize(("n_bits", "threshold", "inclusive", "plan"), [(16, 0.4, False, "lists"), (16, 0.5, True, "grid"), (70, 0.2, False, "grid"), (70, 0.2, True, "lists"), (200, 0.3, True, "grid")])
def test_plans_of_the_range_join_agree_with_brute_force(spark, n_bits, threshold, inclusive, plan):
    items = random_sets(90, n_bits, 5, low=0, high=n_bits // 2, copies=6)
    got = similarity_edges(frame(spark, items), "id", "bits", threshold, n_bits, inclusive=inclusive, rows_per_block=25, plan=plan).collect()
    assert {(r["src"], r["dst"]): r["sim"] for r in got} == brute_edges(items, threshold, inclusive)
    assert len(got) == len({(r["src"], r["dst"]) for r in got})


def test_common_bits_are_compared_by_blocks_and_rare_ones_by_lists(spark):
    words = lambda items, n_bits: similarity._ranked_words(frame(spark, items), "id", "bits", n_bits)
    assert similarity._grid_is_less(words(random_sets(200, 64, 1, low=20, high=40), 64), 0.45, 1)
    assert not similarity._grid_is_less(words(random_sets(200, 2048, 1, low=5, high=9), 2048), 0.6, 32)


def test_tiles_meet_each_pair_once(monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 7)
    items = random_sets(60, 70, 5, low=1, high=30, copies=3)
    words = similarity.packed_words(pa.array([b for _, b in items], pa.list_(pa.int32())), 70)
    lists = pa.ListArray.from_arrays(pa.array(range(0, 121, 2), pa.int32()), pa.array(words.ravel().view(np.int64)))
    whole = pa.table({"id": pa.array(range(60)), "words": lists})
    least, wanted = similarity.least_shared(70, 0.25, True), brute_edges(items, 0.25, True)
    for cut in (60, 23):
        a, b = similarity.GridBlock(whole.slice(0, cut)), similarity.GridBlock(whole.slice(0 if cut == 60 else cut))
        found = [tuple(sorted((int(x), int(y)))) for i, j, _ in similarity.grid_pairs(a, b, cut == 60, least) for x, y in zip(a.ids[i], b.ids[j], strict=True)]
        assert sorted(found) == sorted(p for p in wanted if cut == 60 or p[0] < cut <= p[1])


def test_forest_has_the_components_of_the_edges(spark):
    items = random_sets(120, 24, 3, low=0, high=9, copies=4)
    df = frame(spark, items)
    links = similarity.similarity_forest(df, "id", "bits", 0.55, 24, rows_per_block=25)
    got = {r["id"]: r["component"] for r in graph.connected_components(df, links).collect()}
    assert got == components([i for i, _ in items], brute_edges(items, 0.55))
    assert links.count() < 120 * 6


def test_similarity_between_clusters_sums_the_links(spark):
    items = random_sets(130, 64, 8, low=4, high=30, copies=9)
    of = {i: i % 11 for i, _ in items}
    wanted = Counter()
    for (i, j), sim in brute_edges(items, 0.25).items():
        if of[i] != of[j]:
            wanted[min(of[i], of[j]), max(of[i], of[j])] += sim
    clusters = spark.createDataFrame(list(of.items()), "id bigint, cluster bigint")
    got = similarity.similarity_between(frame(spark, items), "id", "bits", clusters, 0.25, 64, rows_per_block=16).collect()
    assert {(r["src"], r["dst"]): pytest.approx(r["sim"]) for r in got} == dict(wanted)


def test_minhash_edges_are_found_without_candidate_rows(spark):
    items = random_sets(150, 64, 6, low=10, high=40, copies=30)
    got = similarity.approx_similarity_edges(frame(spark, items), "id", "bits", 0.5, 64, rows_per_block=40)
    assert "SortMergeJoin" not in got._jdf.queryExecution().sparkPlan().toString().split("FlatMapGroups")[0]
    rows = got.collect()
    assert len(rows) == len({(r["src"], r["dst"]) for r in rows})
    wanted = brute_edges(items, 0.5)
    found = {(r["src"], r["dst"]): r["sim"] for r in rows}
    assert all(found[p] == pytest.approx(wanted[p]) for p in found) and len(found) >= 0.99 * len(wanted)


@pytest.mark.parametrize("n_bits,m", [(12, 1), (12, 4), (200, 3)])
def test_nearest_sets_equal_brute_force(spark, n_bits, m):
    """Ties go to the lower id, over block borders too; empty and null sets are similar to nothing."""
    rng = random.Random(n_bits + m)
    draw = lambda start, n: [(start + 3 * i, sorted(rng.sample(range(n_bits), rng.randint(1, 8)))) for i in range(n)]
    left, right = [*draw(0, 60), (900, []), (901, None)], [*draw(1, 90), (902, []), (1000, None)]
    rows = lambda d: with_words(spark.createDataFrame(d, "id bigint, bits array<int>"), n_bits)
    got = {}
    for r in nearest_sets(rows(left), rows(right), [], m, n_bits, 16).collect():
        got.setdefault(r["lid"], set()).add((r["rid"], r["similarity"]))
    for i, a in left:
        a = set(a or [])
        sims = [(-len(a & set(b or [])) / max(1, len(a | set(b or []))), j) for j, b in right]
        assert got[i] == {(j, -s) for s, j in sorted(sims)[:m]}
