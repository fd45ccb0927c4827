import hashlib
import math
import random

import numpy as np
import pytest

from riftsplit.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error int"


def brute(rows, parts, entries, rounds):
    """(id, code, error) by comparing everything with everything, and the codebooks."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[w * p : w * p + w]
    books = [[cut(v, p) for i, v in kept[:entries] if i is not None] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, x: min((far(x, c), j) for j, c in enumerate(books[p]))
    for r in range(rounds + 1):
        at = [[nearest(p, cut(v, p)) for p in range(parts)] for _, v in kept]
        if r == rounds:
            break
        for p in range(parts):
            for j in range(len(books[p])):
                own = [cut(v, p) for (_, v), a in zip(kept, at, strict=True) if a[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, "".join(f"{j:02x}" for _, j in a), sum(d for d, _ in a)) for (i, _), a in zip(kept, at, strict=True)]
    return out, books


def vectors(n, dims, seed, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    x = middle[rng.integers(centres, size=n)] + 0.2 * rng.normal(size=(n, dims))
    return [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("n, dims, parts, entries, rounds", [(300, 16, 4, 16, 2), (90, 8, 2, 64, 4), (5, 8, 4, 64, 2), (1, 4, 4, 8, 2)])
def test_equals_brute_force(spark, n, dims, parts, entries, rounds):
    rows = vectors(n, dims, n)
    rows += rows[:2]  # repeated rows
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, v, i % 3, "x", -1) for i, v in rows], SCHEMA).repartition(3)
    made = vc.compress(df, parts=parts, entries=entries, rounds=rounds)
    want, books = brute(rows, parts, entries, rounds)
    assert sorted(map(tuple, made.rows.select("vec_id", "code", "error").collect())) == sorted(want)
    assert made.books.entries.tolist() == books
    assert made.books.sha256() == hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()


def test_bounds_save_distances(spark):
    rows = vectors(2000, 16, 7)
    df = spark.createDataFrame([(i, v, 0, "x", -1) for i, v in rows], SCHEMA)
    made = vc.compress(df, parts=4, entries=32, rounds=4)
    everything = 2000 * 4 * 32
    assert all(m < everything for m in made.measured) and made.measured[-1] < everything // 3
    assert made.widths == sorted(made.widths, reverse=True)


def test_broken_vectors_null_keys_and_label_sums(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0, 4.0], 1), (2, [1.0, 2.0, 3.0, 4.5], None), (None, [0.0, 0.0, 0.0, 1.0], None), (3, None, 1)]
    rows += [(4, [nan, 1.0, 1.0, 1.0], 1), (5, [1.0, None, 1.0, 1.0], 1), (6, [inf, 1.0, 1.0, 1.0], 1), (7, [1.0, 1.0], 1), (8, [], 2), (9, [1e30, 0.0, 0.0, 0.0], 2)]
    df = spark.createDataFrame([(*r, "x", -1) for r in rows], SCHEMA)
    made = vc.compress(df, parts=2, entries=2, rounds=1)
    got = {r["vec_id"]: r for r in vc.with_label_errors(made.rows).collect()}
    assert set(got) == {1, 2, 9, None}
    assert got[2]["label_error"] == got[None]["label_error"] == got[2]["error"] + got[None]["error"]
    assert vc.compress(df.filter("false")).rows.collect() == []
    with pytest.raises(ValueError):
        vc.compress(df, parts=3)
