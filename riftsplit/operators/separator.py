"""Balanced vertex separators, multilevel: which vertices to take out so that nothing joins two sides of given weights.

A large graph is condensed level by level: every vertex picks its heaviest edge, mutual picks become one vertex, and the
vertices left over are paired with others that picked the same neighbour, so hubs do not stop the halving.  The
coarsest graph has at most ``COARSEST`` vertices, a parameter whatever the data; a region is grown on it from many
starts in parallel tasks and mended by moves of cut vertices.  The cut is then projected back level by level, and
each level moves all cut vertices that gain weight in one round: taking a set of cut vertices to one side pulls only
their neighbours on the other side into the cut, so such moves never conflict, and their gains add up at least.

Where condensing would blur a dense graph, several parts are searched for together on the graph itself, up to ``SEARCHED`` vertices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftsplit.operators.graph import both_ways
from riftsplit.plans.durable import stored

COARSEST = 2048
STARTS = 96
ROUNDS = 6  # of refinement at each level


# -- the coarsest graph ------------------------------------------------------------------


def grow(near: np.ndarray, w: np.ndarray, start: int, low: float, far: float) -> tuple[float, np.ndarray] | None:
    """(cut weight, sides) of the best region grown from ``start`` that weighs ``low`` and leaves ``far``; 0 region, 1 cut, 2 rest."""
    side, total = np.full(len(w), 2, dtype=np.int8), w.sum()
    fresh = near @ w  # weight of the neighbours still on the far side
    inside, cut, best = 0.0, 0.0, None
    v = start
    while True:
        if side[v] == 2:
            fresh -= near[:, v] * w[v]
        else:
            cut -= w[v]
        side[v] = 0
        inside += w[v]
        pulled = np.flatnonzero((near[v] > 0) & (side == 2))
        if len(pulled):
            side[pulled] = 1
            cut += w[pulled].sum()
            fresh -= near[:, pulled] @ w[pulled]
        if total - inside - cut < far:
            return best
        if inside >= low and (best is None or cut < best[0]):
            best = (cut, side.copy())
        cost = np.where(side == 1, fresh - w, fresh)
        cost[side == 0] = np.inf
        v = int(cost.argmin())
        if not np.isfinite(cost[v]):
            return best


def mend(near: np.ndarray, w: np.ndarray, side: np.ndarray, low: float, far: float) -> np.ndarray:
    """Move cut vertices to a side, one at a time, as long as the cut gets lighter within the bounds."""
    side = side.copy()
    while True:
        gains = []
        for to, other in ((0, 2), (2, 0)):
            pull = near @ (w * (side == other))
            gain = np.where(side == 1, w - pull, -np.inf)
            least = far if other == 2 else low
            gain = np.where(w[side == other].sum() - pull >= least, gain, -np.inf)
            v = int(gain.argmax())
            gains.append((gain[v], to, other, v))
        best = max(gains)
        if not best[0] > 0:
            return side
        _, to, other, v = best
        side[(near[v] > 0) & (side == other)] = 1
        side[v] = to


def _solve(vertices: DataFrame, edges: DataFrame, low: float, far: float) -> DataFrame | None:
    """(id, side) on a graph of bounded size, or None."""
    spark = vertices.sparkSession
    v = vertices.select("id", "weight").orderBy("id").toPandas()
    e = edges.select("src", "dst").toPandas()
    ids, w = v.id.to_numpy(), v.weight.to_numpy().astype(np.float32)
    src, dst = np.searchsorted(ids, e.src.to_numpy()), np.searchsorted(ids, e.dst.to_numpy())
    n = len(ids)

    def work(frames):
        near = np.zeros((n, n), dtype=np.float32)
        near[src, dst] = near[dst, src] = 1.0
        for frame in frames:
            for start in frame.start:
                found = grow(near, w, int(start), low, far)
                if found is not None:
                    side = mend(near, w, found[1], low, far)
                    yield pd.DataFrame({"start": [start], "cut": [w[side == 1].sum()], "sides": [side.tobytes()]})

    degree = np.bincount(np.concatenate([src, dst]), minlength=n) if n else np.zeros(0)
    order = np.argsort(degree, kind="stable")
    starts = np.unique(np.concatenate([order[: STARTS // 2], order[:: max(1, n // (STARTS // 2))]])).tolist()
    tasks = max(1, min(len(starts), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = spark.createDataFrame([(s,) for s in starts], "start bigint").repartition(tasks)
    found = rows.mapInPandas(work, "start bigint, cut double, sides binary").orderBy("cut", "start").first()
    if found is None:
        return None
    sides = np.frombuffer(found["sides"], dtype=np.int8)
    return spark.createDataFrame([(int(i), int(s)) for i, s in zip(ids, sides, strict=True)], "id bigint, side int")


# -- levels --------------------------------------------------------------------------


def contract(vertices: DataFrame, edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One level: (members(id, leader), vertices(id, weight), edges(src, dst, w))."""
    ways = both_ways(edges, "w").join(vertices.select(F.col("id").alias("other"), F.col("weight").alias("ow")), "other")
    order = F.struct((F.col("w") / F.col("ow")).alias("r"), F.xxhash64(F.least("node", "other"), F.greatest("node", "other"), F.lit(turn)).alias("h"), F.col("other").alias("o"))
    pick = stored(ways.groupBy(F.col("node").alias("id")).agg(F.max(order).alias("_p")).select("id", F.col("_p.o").alias("pick")))
    back = pick.select(F.col("id").alias("pick"), F.col("pick").alias("back"))
    chosen = pick.join(back, "pick")
    pairs = chosen.filter("back = id").select("id", F.least("id", "pick").alias("leader"))
    alone = chosen.filter("back <> id")
    crowd = alone.groupBy("pick").agg(F.count(F.lit(1)).alias("c"))
    spot = F.pmod(F.xxhash64("id", F.lit(turn)), F.greatest(F.lit(1), F.floor(F.col("c") / 2)))
    alone = stored(alone.join(crowd, "pick").select("id", "pick", spot.alias("spot")))
    named = alone.groupBy("pick", "spot").agg(F.min("id").alias("leader"))
    joined = pairs.unionByName(alone.join(named, ["pick", "spot"]).select("id", "leader"))
    members = stored(vertices.select("id").join(joined, "id", "left").select("id", F.coalesce("leader", "id").alias("leader")))
    condensed = vertices.join(members, "id").groupBy(F.col("leader").alias("id")).agg(F.sum("weight").alias("weight"))
    a = members.select(F.col("id").alias("src"), F.col("leader").alias("a"))
    b = members.select(F.col("id").alias("dst"), F.col("leader").alias("b"))
    links = edges.join(a, "src").join(b, "dst").filter("a <> b")
    links = links.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("w").alias("w"))
    return members, stored(condensed), stored(links)


def refine(vertices: DataFrame, edges: DataFrame, sides: DataFrame, low: float, far: float) -> DataFrame:
    """(id, side) with a lighter cut, by rounds of moves of all gaining cut vertices to one side."""
    state = stored(vertices.join(sides, "id").select("id", "weight", "side"))
    ends = stored(both_ways(edges))
    idle, turn = 0, 0
    while idle < 2 and turn < 2 * ROUNDS:
        to, other = ((0, 2), (2, 0))[turn % 2]
        turn += 1
        cut = state.filter("side = 1").select(F.col("id").alias("node"), "weight")
        far = state.filter(F.col("side") == other).select(F.col("id").alias("other"), F.col("weight").alias("ow"))
        touch = stored(ends.join(cut.select("node"), "node").join(far, "other"))
        pull = touch.groupBy("node").agg(F.sum("ow").alias("pull"))
        movers = stored(cut.join(pull, "node", "left").filter(F.col("weight") > F.coalesce("pull", F.lit(0))).select("node", "weight"))
        pulled = stored(touch.join(movers.select("node"), "node", "left_semi").select("other", "ow").distinct())
        gone, come = movers.agg(F.sum("weight")).first()[0], pulled.agg(F.sum("ow")).first()[0] or 0
        if not gone:
            idle += 1
            continue
        if come and state.filter(F.col("side") == other).agg(F.sum("weight")).first()[0] - come < (far if other == 2 else low):
            idle += 1
            continue
        idle = 0
        new = movers.select(F.col("node").alias("id"), F.lit(to).alias("new")).unionByName(pulled.select(F.col("other").alias("id"), F.lit(1).alias("new")))
        state = stored(state.join(new, "id", "left").select("id", "weight", F.coalesce("new", "side").alias("side")))
    return state.select("id", "side")


def vertex_separator(vertices: DataFrame, edges: DataFrame, low: float, far: float, coarsest: int = COARSEST) -> DataFrame | None:
    """(id, side): side 0 weighs ``low`` at least, side 2 ``far`` at least, side 1 is taken out; no edge joins 0 and 2.

    ``vertices`` are (id, weight), ``edges`` (src, dst).  None if no start leads to such sides.
    """
    v, e = vertices.select("id", "weight"), edges.select("src", "dst", F.lit(1).cast("bigint").alias("w"))
    levels, n, turn = [], v.count(), 0
    while n > coarsest:
        members, cv, ce = contract(v, e, turn)
        levels.append((v, e, members))
        v, e, n, turn = cv, ce, cv.count(), turn + 1
    sides = _solve(v, e, low, far)
    if sides is None:
        return None
    for v, e, members in reversed(levels):
        sides = members.join(sides.withColumnRenamed("id", "leader"), "leader").select("id", "side")
        sides = refine(v, e, sides, low, far)
    return stored(sides)


# -- all parts at once ------------------------------------------------------------------

# Most vertices of a graph that one task searches: their neighbours are 32 MB of bits, a parameter whatever the data.
SEARCHED = 16384
SEARCHES = 8
STALL = 25_000  # moves without a better cut after which a search ends
# Annealing: steps at first and after that, vertices drawn in a step, first and last temperature (in weights of a row), multiple of the
# goal by which parts are priced, and most places of neighbours that are kept as lists (256 MB).
SWEEPS = (30_000, 220_000)
DRAWN = 1024
HOT, COLD = 0.5, 0.12
BEYOND = 1.5
LISTED = 1 << 26


def _row(near: np.ndarray, v, n: int) -> np.ndarray:
    return np.unpackbits(near[v], axis=-1, count=n)


def _weigh(near: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weight of the neighbours of each vertex."""
    return np.concatenate([_row(near, slice(k, k + 1024), len(w)) @ w for k in range(0, len(w), 1024)])


def _first_parts(near: np.ndarray, w: np.ndarray, start: int, goals: np.ndarray) -> np.ndarray:
    """Parts grown one after another, each by the vertices that pull least weight into the cut; the last one is what is left."""
    n, last = len(w), len(goals) - 1
    side = np.full(n, last, dtype=np.int8)
    fresh = _weigh(near, w)
    v = int(np.argsort(fresh, kind="stable")[start % n])
    for part in range(last):
        inside, out = 0.0, np.zeros(n, dtype=bool)  # cut vertices of this part; those of earlier ones never come back
        while v >= 0 and inside < goals[part]:
            own = _row(near, v, n)
            if side[v] == last:
                fresh -= own * w[v]
            side[v], out[v] = part, False
            inside += w[v]
            pulled = np.flatnonzero(own & (side == last))
            if len(pulled):
                side[pulled], out[pulled] = last + 1, True
                for k in range(0, len(pulled), 1024):
                    some = pulled[k : k + 1024]
                    fresh -= w[some] @ _row(near, some, n)
            cost = np.where(out, fresh - w, np.where(side == last, fresh, np.inf))
            v = int(cost.argmin())
            v = v if np.isfinite(cost[v]) else -1
        left = np.where(side == last, fresh, np.inf)
        v = int(left.argmin()) if np.isfinite(left).any() else -1
    return side


def search_parts(near: np.ndarray, w: np.ndarray, goals: np.ndarray, start: int, stall: int = STALL) -> tuple[float, np.ndarray]:
    """(least share of a goal reached, at most 1; sides) of a tabu search for parts without links that weigh ``goals``; the last side is cut.

    ``near`` holds the neighbours as packed bits.  A move takes the cut vertex that gains most to a part and its neighbours out of
    the others, where weight counts more in a part that is further from its goal; what was taken out stays out for a while.
    """
    n, k = len(w), len(goals)
    w, rng = w.astype(np.float32), np.random.default_rng(start)
    side = _first_parts(near, w, start * max(1, n // 40), goals)
    weight = np.array([w[side == p].sum() for p in range(k)], dtype=np.float64)
    around = np.stack([_weigh(near, w * (side == p)) for p in range(k)])
    held = np.zeros(n, dtype=np.int64)
    tenure, steep = (200, 100, 50, 400)[start % 4], (20.0, 60.0)[start // 4 % 2]
    best, found, last, step = -1.0, side.copy(), 0, 0
    while step - last < stall:
        reached = float((weight / goals).min())
        if reached > best:
            best, found, last = reached, side.copy(), step
        if reached >= 1:
            break
        step += 1
        price = np.exp(-steep * (weight / goals - reached)) * goals.min() / goals
        priced = (around * price[:, None]).astype(np.float32)
        every, free = priced.sum(0), np.flatnonzero((side == k) & (held <= step))
        if not len(free):
            continue
        noise = rng.random(len(free), dtype=np.float32) * np.float32(0.4)
        gain = np.stack([np.float32(price[p]) * w[free] - (every[free] - priced[p, free]) for p in range(k)]) + noise
        p, at = divmod(int(gain.argmax()), len(free))
        v = int(free[at])
        own = _row(near, v, n)
        side[v] = p
        weight[p] += w[v]
        around[p] += own * w[v]
        out = np.flatnonzero(own & (side < k) & (side != p))
        for q in np.unique(side[out]):
            some = out[side[out] == q]
            side[some] = k
            weight[q] -= w[some].sum()
            around[q] -= w[some] @ _row(near, some, n)
            held[some] = step + rng.integers(tenure, 2 * tenure, len(some))
    return min(best, 1.0), found


def _neighbours(near: np.ndarray, n: int):
    """Function from a vertex to the places of its neighbours; all lists are kept if they have at most ``LISTED`` places."""
    if int(np.bitwise_count(near).sum(dtype=np.int64)) > LISTED:
        return lambda v: np.flatnonzero(_row(near, v, n))
    lists = []
    for k in range(0, n, 1024):
        row, at = np.nonzero(_row(near, slice(k, k + 1024), n))
        lists += np.split(at.astype(np.int32), np.searchsorted(row, np.arange(1, min(1024, n - k))))
    return lists.__getitem__


def anneal_parts(near: np.ndarray, w: np.ndarray, goals: np.ndarray, start: int, sweeps: int = SWEEPS[0]) -> tuple[float, np.ndarray]:
    """The same as ``search_parts`` by simulated annealing.

    Each step draws cut vertices and a part for each. What a part gains is priced by its distance from a weight beyond its goal, so parts
    fill evenly, and a loss is taken with a chance that falls with the temperature. Moves that a move before them spoils are weighed again.
    """
    n, k = len(w), len(goals)
    w, rng, mates_of = w.astype(np.float32), np.random.default_rng(start), _neighbours(near, n)
    side, weight = np.full(n, k, dtype=np.int8), np.zeros(k)
    around = np.zeros((n, k), dtype=np.float32)  # weight of the neighbours in each part
    best, found, order, at = -1.0, side.copy(), rng.permutation(n), 0
    for sweep in range(sweeps):
        heat = np.float32(HOT * (COLD / HOT) ** (sweep / sweeps))
        if at >= n:
            order, at = rng.permutation(n), 0
        drawn = order[at : at + DRAWN]
        at += DRAWN
        drawn = drawn[side[drawn] == k]
        part = rng.integers(0, k, len(drawn))
        price = ((goals * BEYOND - weight) / (goals * (BEYOND - 1))).astype(np.float32)
        own = around[drawn]
        gain = price[part] * (w[drawn] + own[np.arange(len(drawn)), part]) - own @ price
        bar = heat * np.log(1 - rng.random(len(drawn), dtype=np.float32))
        for i in np.flatnonzero(gain > bar):
            v, p = drawn[i], part[i]
            if not price[p] * (w[v] + around[v, p]) - around[v] @ price > bar[i]:
                continue
            mates = mates_of(v)
            there = side[mates]
            side[v] = p
            weight[p] += w[v]
            around[mates, p] += w[v]
            for x in mates[(there < k) & (there != p)]:
                q, side[x] = side[x], k
                weight[q] -= w[x]
                around[mates_of(x), q] -= w[x]
        reached = float((weight / goals).min())
        if reached > best:
            best, found = reached, side.copy()
            if reached >= 1:
                break
    return min(best, 1.0), found


def _packed_neighbours(edges: DataFrame, ids: np.ndarray) -> DataFrame:
    """(id, near): the neighbours of each vertex that has some as packed bits, by their places in ``ids``."""
    rows = 256
    width = -(-len(ids) // 8)

    def work(table: pa.Table) -> pa.Table:
        names, row = np.unique(table.column("node").to_numpy(), return_inverse=True)
        bits = np.zeros((len(names), 8 * width), dtype=bool)
        bits[row, np.searchsorted(ids, table.column("other").to_numpy())] = True
        return pa.table({"id": names, "near": pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())})

    block = F.pmod(F.xxhash64("node"), F.lit(-(-len(ids) // rows))).alias("block")
    return stored(both_ways(edges).select("node", "other", block).groupBy("block").applyInArrow(work, "id bigint, near binary"))


def joint_parts(
    vertices: DataFrame, edges: DataFrame, goals: list[float], searched: int = SEARCHED, searches: int = SEARCHES
) -> tuple[float, DataFrame]:
    """(least share of a goal reached, (id, side)): parts without links of the given weights, searched for together; the last side is cut.

    A graph of more than ``searched`` vertices is condensed first.  Each search is a task of its own and holds the packed graph.  All
    searches anneal for a short time; if none reaches the goals, every other one anneals longer and the rest is tabu search.
    """
    spark = vertices.sparkSession
    v, e = vertices.select("id", "weight"), edges.select("src", "dst", F.lit(1).cast("bigint").alias("w"))
    levels, n, turn = [], v.count(), 0
    while n > searched:
        members, v, e = contract(v, e, turn)
        levels.append(members)
        n, turn = v.count(), turn + 1
    told = v.orderBy("id").toPandas()
    ids, weight, want = told.id.to_numpy(), told.weight.to_numpy(), np.array(goals, dtype=np.float64)

    def worker(turn: int):
        def work(table: pa.Table) -> pa.Table:
            near = np.zeros((len(ids), -(-len(ids) // 8)), dtype=np.uint8)
            for name, bits in zip(table.column("id").to_pylist(), table.column("near"), strict=True):
                near[np.searchsorted(ids, name)] = np.frombuffer(bits.as_buffer(), dtype=np.uint8)
            start = table.column("start")[0].as_py()
            if turn and start % 2:
                reached, side = search_parts(near, weight, want, start)
            else:
                reached, side = anneal_parts(near, weight, want, start, SWEEPS[turn])
            return pa.table({"start": pa.array([start], pa.int64()), "reached": [reached], "sides": pa.array([side.tobytes()], pa.binary())})

        return work

    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(searches - 1).cast("bigint"))).alias("start")
    spread = _packed_neighbours(e, ids).select(starts, "id", "near").repartitionByRange(searches, "start")
    found = None
    for turn in range(len(SWEEPS)):
        tried = spread.groupBy("start").applyInArrow(worker(turn), "start bigint, reached double, sides binary").orderBy(F.desc("reached"), "start").first()
        if tried is None:  # no edges
            raise ValueError("a graph without edges needs no cut")
        found = tried if found is None or tried["reached"] > found["reached"] else found
        if found["reached"] >= 1:
            break
    side = np.frombuffer(found["sides"], dtype=np.int8)
    sides = spark.createDataFrame([(int(i), int(s)) for i, s in zip(ids, side, strict=True)], "id bigint, side int")
    for members in reversed(levels):
        sides = members.join(sides.withColumnRenamed("id", "leader"), "leader").select("id", "side")
    return found["reached"], stored(sides)
