"""Near-duplicate vectors by Euclidean p-stable hashing of normalised vectors, confirmed by exact cosines.

A hash is ``floor((a . x + b) / w)`` with normal ``a``; a key of a table joins several hashes, and vectors that share a key in
any table are compared.  The number of hashes a table follows from the number of vectors (about ``PER_KEY``
strangers share a key), the number of tables from the chance that a pair *at* the threshold shares no key in any of
them (``MISSED``); nearer pairs are found all the more.

Equal vectors are one vertex.  Tight groups become balls: in a few rounds the members of one bucket, in blocks of bounded
size, are gathered around means so that each is within half the threshold angle of its ball's centre; all members of
a ball are then linked by the triangle inequality, whatever their number, and are never paired.  Keys bring
balls together (a single vector is a ball of radius 0).  Strangers in a bucket are told apart by 128 signs of random
projections, which keep a pair at the threshold but for one in ten million; what is left is compared on its centres: balls
that are surely linked or surely apart are settled as a whole, the members of the others are compared in pairs of blocks, and
only counts leave a block pair.  Links between balls are the only pairs that become rows.

Defined results: a vector that is null, zero, or holds null or non-finite components links with nothing, and neither do rows
without an id; vectors of different lengths never link; equal ids with different vectors count by
their first vector in order; repeated rows get the same result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftsplit.operators.graph import connected_components
from riftsplit.plans.blocks import cross_grid
from riftsplit.plans.durable import broadcast_if_small, stored

COSINE = 0.9
WIDTH = 2.0  # of a hash cell
STRANGER = math.sqrt(2.0)  # distance of unrelated unit vectors
PER_KEY = 256  # strangers that may share a key of a table with a vector
MISSED = 0.02  # chance to miss a pair at the threshold
CONDENSE_ROUNDS, CONDENSE_HASHES = 2, 4
ROWS = 1024  # vectors of a block
LOT_ROWS = 32_768  # rows of block pairs that a task takes at a time
SIGNS = 128
MARGIN = 1e-6  # radians left to rounding where a bound decides


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that two vectors at a distance share one hash."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2.0))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(hashes in a key, tables) for n vectors."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(STRANGER)
    hashes = max(1, math.ceil(math.log(max(2.0, n / PER_KEY)) / -math.log(far)))
    return hashes, max(1, math.ceil(math.log(MISSED) / math.log1p(-(near**hashes))))


def sign_limit(angle):
    """Differing signs that two vectors at an angle exceed with a chance of about 1e-7."""
    p = np.minimum(np.asarray(angle) / math.pi, 1.0)
    return np.ceil(SIGNS * p + 5.2 * np.sqrt(SIGNS * p * (1 - p)))


def units(column: pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors in doubles."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1)[:, None]


def _keys(x: np.ndarray, tables: int, hashes: int, seed: int) -> np.ndarray:
    """One 64-bit key per row and table."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a, b = rng.standard_normal((x.shape[1], tables * hashes)), rng.random(tables * hashes) * WIDTH
    cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(x), tables, hashes).view(np.uint64)
    out = np.full((len(x), tables), x.shape[1], dtype=np.uint64)
    for h in range(hashes):
        out = (out ^ cells[:, :, h]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _signs(x: np.ndarray) -> np.ndarray:
    """Two 64-bit words of signs per row."""
    a = np.random.default_rng([7, x.shape[1]]).standard_normal((x.shape[1], SIGNS))
    return np.packbits(x @ a > 0, axis=1).view(np.int64)


def _by_length(batch: pa.RecordBatch, column: str):
    """Slices of rows whose vectors have one length (usually the whole batch)."""
    lengths = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        for start in range(0, len(at), 4096):
            yield batch.take(pa.array(at[start : start + 4096]))


def _hasher(tables: int, hashes: int, seed: int, signs: bool):
    """(id, vec, ...) with ``keys`` and, if asked for, the sign words ``s0`` and ``s1``."""

    def work(batches):
        for batch in batches:
            for part in _by_length(batch, "vec"):
                x = units(part.column("vec"))
                keys = _keys(x, tables, hashes, seed)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables)
                columns = [part.column("id"), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))]
                names = ["id", "keys"]
                if signs:
                    words = _signs(x)
                    columns += [pa.array(np.ascontiguousarray(words[:, i])) for i in (0, 1)]
                    names += ["s0", "s1"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return work


# -- balls --------------------------------------------------------------------------


def gather(x: np.ndarray, radius: np.ndarray, weight: np.ndarray, half: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Balls of two or more rows: (rows, centre, radius), each with all it covers within ``half`` of its centre."""
    close = x @ x.T >= math.cos(2 * half)
    np.fill_diagonal(close, False)
    alive = close.any(1)
    balls = []
    for seed in np.argsort(-(close @ weight), kind="stable").tolist():
        if not alive[seed]:
            continue
        near = np.flatnonzero(close[seed] & alive)
        near = np.append(near, seed)
        centre = (x[near] * weight[near, None]).sum(0)
        centre /= np.linalg.norm(centre)
        at = np.flatnonzero(alive)
        reach = np.arccos(np.clip(x[at] @ centre, -1, 1)) + radius[at] + MARGIN
        rows = at[reach <= half]
        if len(rows) > 1:
            balls.append((rows, centre, float(reach[reach <= half].max())))
            alive[rows] = False
        alive[seed] = False
    return balls


def _gatherer(half: float):
    """One block of a bucket: (id, ball, centre, radius) of the vertices that join a ball; a ball is named by its lowest id."""
    schema = pa.schema([("id", pa.int64()), ("ball", pa.int64()), ("centre", pa.list_(pa.float64())), ("ball_radius", pa.float64())])

    def work(table: pa.Table) -> pa.Table:
        ids, out = table.column("id").to_numpy(), []
        balls = gather(units(table.column("vec").combine_chunks()), table.column("radius").to_numpy(), table.column("weight").to_numpy().astype(float), half)
        for rows, centre, radius in balls:
            name = int(ids[rows].min())
            out += [{"id": int(i), "ball": name, "centre": centre.tolist(), "ball_radius": radius} for i in ids[rows]]
        return pa.Table.from_pylist(out, schema=schema)

    return work


def condense(vertices: DataFrame, half: float, rounds: int = CONDENSE_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(balls(id, vec, radius, weight), moved(id, ball)): tight groups of vertices (id, vec, radius, weight) as balls."""
    moved = None
    for turn in range(rounds):
        keys = vertices.select("id", "vec").mapInArrow(_hasher(1, CONDENSE_HASHES, 100 + turn, False), "id bigint, keys array<bigint>")
        keys = stored(keys.select("id", F.get("keys", 0).alias("key")))
        sizes = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
        placed = keys.join(broadcast_if_small(sizes, 32), "key").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / ROWS)))
        rows = vertices.join(placed.select("id", "key", "block"), "id")
        joined = stored(rows.groupBy("key", "block").applyInArrow(_gatherer(half), "id bigint, ball bigint, centre array<double>, ball_radius double"))
        if joined.isEmpty():
            continue
        summed = vertices.select("id", "weight").join(joined.select("id", "ball"), "id").groupBy("ball").agg(F.sum("weight").alias("weight"))
        made = joined.filter("id = ball").select("ball", F.col("centre").alias("vec"), F.col("ball_radius").alias("radius")).join(summed, "ball")
        rest = vertices.join(broadcast_if_small(joined.select("id"), 24), "id", "left_anti")
        vertices = stored(rest.select("id", "vec", "radius", "weight").unionByName(made.withColumnRenamed("ball", "id")))
        step = joined.select("id", "ball")
        if moved is not None:
            after = moved.join(step.select(F.col("id").alias("ball"), F.col("ball").alias("next")), "ball", "left")
            fresh = step.join(moved.select("ball").distinct().withColumnRenamed("ball", "id"), "id", "left_anti")
            step = after.select("id", F.coalesce("next", "ball").alias("ball")).unionByName(fresh)
        moved = stored(step)
    if moved is None:
        moved = vertices.filter("false").select("id", F.col("id").alias("ball"))
    return vertices, moved


# -- pairs ----------------------------------------------------------------------------


def _meeting(angle: float):
    """Block pairs of buckets, several of them: pairs (a, b) of balls whose signs allow a link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def one(ids, own, radius, words, i: int, j: int) -> np.ndarray:
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        differ = sum(np.bitwise_count(words[left, k][:, None] ^ words[right, k][None, :]).astype(np.int16) for k in (0, 1))
        wide = radius[left].max() + radius[right].max() > 0
        limit = sign_limit(angle + radius[left][:, None] + radius[right][None, :]) if wide else sign_limit(angle)
        other = ids[left][:, None] < ids[right][None, :] if i == j else ids[left][:, None] != ids[right][None, :]
        r, c = np.nonzero((differ <= limit) & other)
        return np.column_stack([ids[left[r]], ids[right[c]]])

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([(c, "ascending") for c in ("slot", "key", "bi", "bj")])
        slot, key, bi, bj, ids, own, radius = (table.column(c).to_numpy() for c in ("slot", "key", "bi", "bj", "ball", "_b", "radius"))
        words = np.column_stack([table.column("s0").to_numpy(), table.column("s1").to_numpy()]).view(np.uint64)
        new = np.flatnonzero((np.diff(slot) != 0) | (np.diff(key) != 0) | (np.diff(bi) != 0) | (np.diff(bj) != 0)) + 1
        found = [np.zeros((0, 2), dtype=np.int64)]
        for low, high in zip([0, *new.tolist()], [*new.tolist(), len(ids)], strict=True):
            i, j = bi[low], bj[low]
            if (own[low:high] == i).any() and (own[low:high] == j).any():
                found.append(one(ids[low:high], own[low:high], radius[low:high], words[low:high], i, j))
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return work


def _judge(cosine: float):
    """Pairs with both balls' centres to (a, b, verdict): 1 all members are linked, 0 some may be; pairs surely apart fall out."""
    angle = math.acos(cosine)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("verdict", pa.int32())])

    def work(batches):
        for batch in batches:
            same = np.flatnonzero(np.equal(*(batch.column(c).value_lengths().to_numpy(zero_copy_only=False) for c in ("va", "vb"))))
            for part in _by_length(batch.take(pa.array(same)), "va"):
                cos = (units(part.column("va")) * units(part.column("vb"))).sum(1)
                spread = part.column("ra").to_numpy() + part.column("rb").to_numpy()
                apart = np.arccos(np.clip(cos, -1, 1))
                points = spread == 0  # two vectors: the cosine decides
                sure = np.where(points, cos >= cosine, apart + spread + MARGIN <= angle)
                open_ = ~points & ~sure & (apart - spread - MARGIN <= angle)
                keep = np.flatnonzero(sure | open_)
                columns = [part.column(c).take(pa.array(keep)) for c in ("a", "b")] + [pa.array(sure[keep].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return work


def _counter(cosine: float):
    """Members of two balls, a block of each: (id, n) links of each member."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])

    def work(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        linked = units(left.column("vec").combine_chunks()) @ units(right.column("vec").combine_chunks()).T >= cosine
        n = np.concatenate([linked @ right.column("weight").to_numpy(), left.column("weight").to_numpy() @ linked])
        ids = np.concatenate([left.column("lid").to_numpy(), right.column("rid").to_numpy()])
        some = n > 0
        pair = [pa.array(np.full(some.sum(), k.as_py()), pa.int64()) for k in key[:2]]
        return pa.Table.from_arrays([*pair, pa.array(ids[some]), pa.array(n[some], pa.int64())], schema=schema)

    return work


def near_duplicate_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id) for every row."""
    if not 0 < cosine < 1:
        raise ValueError("the cosine must be between 0 and 1")
    half = math.acos(cosine) / 2 - MARGIN
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = F.coalesce(F.forall("vec", finite) & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(vec_id).cast("bigint").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("vec"))
    usable = rows.filter(F.col("id").isNotNull() & good).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit("vector"), "vec")})
    # one vector for each id, one vertex for each different vector
    named = stored(usable.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("_h")).select("id", "_h.h1", "_h.h2"))
    copies = named.groupBy("h1", "h2").agg(F.min("id").alias("vertex"), F.count(F.lit(1)).alias("weight"))
    members = stored(named.join(copies, ["h1", "h2"]).select("id", "vertex", "weight", "h1", "h2"))
    first = members.filter("id = vertex").select("id", "h1", "h2", "weight")
    vectors = usable.join(first, ["id", "h1", "h2"]).dropDuplicates(["id"]).select("id", "vec", F.lit(0.0).alias("radius"), "weight")
    vectors = stored(vectors)
    n = vectors.count()
    if not n:
        return df.select(F.col(vec_id).cast("bigint").alias(vec_id), F.lit(0).cast("bigint").alias("n_links"), F.col(vec_id).cast("bigint").alias("component_id"))
    balls, moved = condense(vectors, half)
    in_ball = vectors.select("id", "vec", "weight").join(broadcast_if_small(moved, 32), "id", "left").select("id", "vec", "weight", F.coalesce("ball", "id").alias("ball"))

    hashes, tables = plan(n, cosine)
    hash_of = lambda d, t: d.select("id", "vec").mapInArrow(_hasher(t, hashes, 0, True), "id bigint, keys array<bigint>, s0 bigint, s1 bigint")
    # members of a ball bring its keys, the centre brings the signs
    centres = balls.join(moved.select(F.col("ball").alias("id")).distinct(), "id", "left_semi")
    signs = hash_of(centres, 1).join(centres.select("id", "radius"), "id").select(F.col("id").alias("ball"), F.col("s0").alias("c0"), F.col("s1").alias("c1"), "radius")
    of_ball = stored(moved.join(signs, "ball"))
    hashed = hash_of(vectors, tables).join(broadcast_if_small(of_ball, 64), "id", "left")
    entries = hashed.select(
        F.coalesce("ball", "id").alias("ball"), F.coalesce("c0", "s0").alias("s0"), F.coalesce("c1", "s1").alias("s1"),
        F.coalesce("radius", F.lit(0.0)).alias("radius"), F.posexplode("keys").alias("slot", "key"),
    )
    told = stored(entries.groupBy("slot", "key", "ball").agg(*[F.min(c).alias(c) for c in ("s0", "s1", "radius")]))
    shared = told.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    shared = stored(shared.select("slot", "key", "_c", F.ceil(F.col("_c") / ROWS).cast("int").alias("_n")))
    load = shared.agg(F.sum(F.col("_c") * F.col("_n"))).first()[0] or 0
    placed = told.join(broadcast_if_small(shared.drop("_c"), 48), ["slot", "key"])
    placed = placed.withColumn("_b", F.pmod(F.xxhash64("ball"), F.col("_n")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    placed = placed.withColumns({"bi": F.least("_b", "_o"), "bj": F.greatest("_b", "_o")}).drop("_o", "_n")
    lots = F.pmod(F.xxhash64("slot", "key", "bi", "bj"), F.lit(max(1, load // LOT_ROWS)))
    pairs = placed.withColumn("lot", lots).groupBy("lot").applyInArrow(_meeting(math.acos(cosine)), "a bigint, b bigint").distinct()
    side = lambda s: balls.select(F.col("id").alias(s), F.col("vec").alias(f"v{s}"), F.col("radius").alias(f"r{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb", "ra", "rb")
    judged = stored(met.mapInArrow(_judge(cosine), "a bigint, b bigint, verdict int"))

    # balls that are linked as a whole
    sure = judged.filter("verdict = 1").select("a", "b")
    both = sure.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("_p"))
    weights = balls.select(F.col("id").alias("y"), "weight")
    whole = both.select("_p.x", "_p.y").join(weights, "y").groupBy(F.col("x").alias("ball")).agg(F.sum("weight").alias("n_whole"))
    # balls of which some members may be linked
    mixed = judged.filter("verdict = 0").select("a", "b")
    left = mixed.join(in_ball.withColumnRenamed("ball", "a"), "a").select("a", "b", F.col("id").alias("lid"), "vec", "weight")
    right = mixed.join(in_ball.withColumnRenamed("ball", "b"), "b").select("a", "b", F.col("id").alias("rid"), "vec", "weight")
    left, right = cross_grid(stored(left), stored(right), ["a", "b"], "lid", "rid", ROWS)
    cells = ["a", "b", "bl", "br"]
    counted = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(_counter(cosine), "a bigint, b bigint, id bigint, n bigint")
    counted = stored(counted)
    part = counted.groupBy("id").agg(F.sum("n").alias("n_part"))
    links = sure.unionByName(counted.select("a", "b").distinct()).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    components = connected_components(balls.select("id"), stored(links)).withColumnRenamed("id", "ball")

    # back to vertices, then to all rows
    ball_rows = balls.select(F.col("id").alias("ball"), F.col("weight").alias("ball_weight")).join(components, "ball").join(whole, "ball", "left")
    settled = in_ball.select("id", "ball").join(ball_rows, "ball").join(part, "id", "left")
    total = F.col("ball_weight") - 1 + F.coalesce("n_whole", F.lit(0)) + F.coalesce("n_part", F.lit(0))
    settled = settled.select(F.col("id").alias("vertex"), total.alias("n_links"), "component")
    by_id = members.select("id", "vertex").join(settled, "vertex").select("id", "n_links", "component", F.lit(True).alias("usable"))
    out = rows.select("id", good.alias("good")).join(stored(by_id), "id", "left")
    hit = F.col("good") & F.col("usable")
    return out.select(
        F.col("id").alias(vec_id),
        F.when(hit, F.col("n_links")).otherwise(0).cast("bigint").alias("n_links"),
        F.when(hit, F.col("component")).otherwise(F.col("id")).alias("component_id"),
    )
