import math

import numpy as np
import pytest

from riftsplit.llm import embedding_dups as ed
from riftsplit.llm.queries import QUERIES
from tests.helpers import components

SCHEMA = "vec_id bigint, embedding array<float>, label int, n_links int, ball string"


def brute(rows, cosine=0.9):
    """id -> (n_links, component_id) by all pairs, and the pairs' cosines."""
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos = x @ x.T
    a, b = np.nonzero(np.triu(cos >= cosine, 1))
    of = components(ids, [(ids[i], ids[j]) for i, j in zip(a, b, strict=True)])
    n = (cos >= cosine).sum(1) - 1
    return {i: (int(n[k]), of[i]) for k, i in enumerate(ids)}


def clustered(seed, groups, dims=32, singles=150):
    """Groups of (size, cosine between members), and vectors on their own."""
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dims) for _ in range(singles)]
    for size, cosine in groups:
        middle = rng.normal(size=dims)
        middle /= np.linalg.norm(middle)
        noise = rng.normal(size=(size, dims)) / math.sqrt(dims) * math.sqrt(1 / cosine - 1)
        rows += list(middle + noise)
    order = rng.permutation(len(rows))
    return [(int(i), [float(np.float32(y)) for y in rows[k]]) for i, k in enumerate(order)]


def found(spark, rows):
    df = spark.createDataFrame([(i, v, 0, -1, "x") for i, v in rows], SCHEMA)
    return ed.near_duplicate_vectors(df).collect()


@pytest.mark.parametrize("groups", [[(60, 0.99), (40, 0.96), (30, 0.93), (2, 0.95)], [(400, 0.97)], []])
def test_equals_all_pairs(spark, groups):
    rows = clustered(len(groups), groups)
    rows += [(1000 + k, rows[3][1]) for k in range(50)]  # copies
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found(spark, rows)}
    want = brute(rows)
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}
    links, truth = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and links >= 0.99 * truth


def test_pairs_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        a = rng.normal(size=48)
        a /= np.linalg.norm(a)
        b = rng.normal(size=48)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (0.9005 * a + math.sqrt(1 - 0.9005**2) * b).tolist())]
    got = sum(r["n_links"] for r in found(spark, rows)) / 2
    assert 0.95 * 300 <= got <= 300


def test_balls_hold_only_linked_vectors():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(4, 16)), 50, axis=0) + 0.12 * rng.normal(size=(200, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    half = math.acos(0.9) / 2 - ed.MARGIN
    balls = ed.gather(x, np.zeros(200), np.ones(200), half)
    assert sum(len(rows) for rows, _, _ in balls) > 150
    for rows, _, radius in balls:
        assert radius <= half and (x[rows] @ x[rows].T).min() >= 0.9


def test_broken_vectors_repeats_and_empty_table(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 0.0, 0.0]
    rows = [(1, one), (2, [1.0, 0.1, 0.0]), (2, [1.0, 0.1, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 0.0, 0.0])]
    rows += [(7, [1.0, None, 0.0]), (None, one), (8, [1.0, 0.0]), (9, []), (10, [0.0, 1.0, 0.0])]
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in found(spark, rows)]
    assert sorted(got, key=str) == sorted(
        [(1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (None, 0, None), (8, 0, 8), (9, 0, 9), (10, 0, 10)], key=str
    )
    assert found(spark, []) == []


def test_tables_follow_from_the_number_of_vectors():
    for n in (10, 10_000, 10_000_000):
        hashes, tables = ed.plan(n)
        missed = (1 - ed.collision(math.sqrt(0.2)) ** hashes) ** tables
        assert missed <= ed.MISSED and n * ed.collision(ed.STRANGER) ** hashes <= ed.PER_KEY


def test_query_equals_all_pairs(spark, sf_dir):
    got = QUERIES["op13_embedding_near_dedup"](spark, sf_dir)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()} == brute(rows)
