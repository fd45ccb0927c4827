"""Iterative graph operators on vertex and edge tables.

Every round writes its small state table durably, so lineage stays one round deep
and a lost executor costs one round at most.  ``edges`` are (src, dst) with src < dst.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftsplit.plans.durable import durable, stored
from riftsplit.plans.order import hash_cuts, running_totals, seeded_key

def both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    """(node, other) in both directions from one scan."""
    ends = F.explode(
        F.array(
            F.struct(F.col("src").alias("node"), F.col("dst").alias("other")),
            F.struct(F.col("dst").alias("node"), F.col("src").alias("other")),
        )
    )
    return edges.select(ends.alias("_e"), *extra).select("_e.node", "_e.other", *extra)


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) with the lowest id of the component as its name.

    Alternates the published large-star and small-star steps: each node points its
    larger (then smaller) neighbours at the smallest node it knows.  Minima are
    partial aggregations, so a hub is reduced before it is shuffled.
    """
    links = durable(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct())
    mark = None
    while True:
        # large star: neighbours above a node are linked to the node's minimum
        sym = links.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(
            links.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
        )
        low = sym.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = sym.join(low, "node").filter("other > node").select(F.col("other").alias("hi"), F.col("m").alias("lo"))
        large = large.filter("hi <> lo")
        # small star: a node and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi")
            .select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo"))
            .filter("hi <> lo")
            .distinct()
        )
        links = durable(small)
        seen = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return _name_components(vertices, links)


def _name_components(vertices: DataFrame, stars: DataFrame) -> DataFrame:
    named = stars.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return vertices.select("id").join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def leader_clusters(vertices: DataFrame, edges: DataFrame, priority: list[str]) -> DataFrame:
    """(id, leader): greedy leaders in a stated order, in parallel rounds.

    ``vertices`` has ``id`` and the ``priority`` columns (lower struct goes first, ``id``
    breaks ties).  A vertex leads when no undecided neighbour goes before it; its
    neighbours follow.  Each follower joins its first leader neighbour.  The result
    equals the one-at-a-time loop.  Every round decides all vertices that come before their undecided
    neighbours; only a path in falling priority takes a round for every second vertex.
    """
    order = F.struct(*priority, "id")
    edges = edges.filter("src <> dst")
    pending = durable(vertices.select("id", order.alias("p")))
    links = stored(both_ways(edges))
    found: list[DataFrame] = []
    while True:
        # only links between undecided vertices matter in this round
        rival = links.join(pending.select(F.col("id").alias("other"), F.col("p").alias("op")), "other")
        first = rival.groupBy(F.col("node").alias("id")).agg(F.min("op").alias("op"))
        new = pending.join(first, "id", "left")
        new = durable(new.filter(F.col("op").isNull() | (F.col("p") < F.col("op"))).select("id", "p"))
        found.append(new)
        covered = links.join(new.select(F.col("id").alias("other")), "other", "left_semi").select(F.col("node").alias("id"))
        pending = durable(pending.join(covered.union(new.select("id")).distinct(), "id", "left_anti"))
        if pending.isEmpty():
            break
        alive = pending.select(F.col("id").alias("node"))
        links = links.join(alive, "node", "left_semi").join(alive.withColumnRenamed("node", "other"), "other", "left_semi")
        links = stored(links)
    leaders = durable(reduce(DataFrame.union, found))
    choice = (
        both_ways(edges)
        .join(leaders.select(F.col("id").alias("other"), "p"), "other")
        .groupBy(F.col("node").alias("id"))
        .agg(F.min("p").alias("best"))
    )
    own = leaders.select("id", F.lit(True).alias("leads"))
    return (
        vertices.select("id")
        .join(own, "id", "left")
        .join(choice, "id", "left")
        .select("id", F.when(F.col("leads"), F.col("id")).otherwise(F.col("best")["id"]).alias("leader"))
    )


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, weight, degree): weighted neighbour count, the vertex's own weight included."""
    w = vertices.select(F.col("id").alias("other"), F.col("weight").alias("_w"))
    around = both_ways(edges).join(w, "other").groupBy(F.col("node").alias("id")).agg(F.sum("_w").alias("_n"))
    return vertices.join(around, "id", "left").select(
        *vertices.columns, (F.col("weight") + F.coalesce("_n", F.lit(0))).alias("degree")
    )


def coarsen(vertices: DataFrame, edges: DataFrame, threshold: float):
    """Condense: most-connected vertices absorb neighbours above a second threshold.

    Returns ``(members(id, leader), vertices(id, weight), edges(src, dst))``.
    """
    strong = edges.filter(F.col("sim") > threshold)
    ranked = degrees(vertices, strong).withColumn("neg_degree", -F.col("degree"))
    members = durable(leader_clusters(ranked, strong, ["neg_degree"]))
    sizes = vertices.join(members, "id").groupBy(F.col("leader").alias("id")).agg(F.sum("weight").alias("weight"))
    a = members.select(F.col("id").alias("src"), F.col("leader").alias("a"))
    b = members.select(F.col("id").alias("dst"), F.col("leader").alias("b"))
    joined = edges.select("src", "dst").join(a, "src").join(b, "dst").filter("a <> b")
    condensed = joined.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    return members, sizes, condensed


# Layers after which the fronts found so far are written as one table.
FRONTS_PER_TABLE = 32


def hop_layers(vertices: DataFrame, edges: DataFrame, root: int) -> DataFrame:
    """(id, layer): breadth-first hops from ``root`` inside its component.

    One round per hop.  Neighbours of a front lie in it, in the front before or in the
    next one, so a round looks at two fronts only and not at everything seen.
    """
    links = both_ways(edges)
    front = durable(vertices.filter(F.col("id") == root).select("id", F.lit(0).alias("layer")))
    links = stored(links)
    done, fronts, before, depth = [], [front], None, 0
    while True:
        depth += 1
        step = links.join(front.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("other").alias("id"))
        new = step.distinct().join(front, "id", "left_anti")
        if before is not None:
            new = new.join(before, "id", "left_anti")
        before, front = front, durable(new.withColumn("layer", F.lit(depth)))
        if front.isEmpty():
            return durable(reduce(DataFrame.union, done + fronts))
        fronts.append(front)
        if len(fronts) == FRONTS_PER_TABLE:
            done.append(durable(reduce(DataFrame.union, fronts)))
            fronts = []


def component_sizes(components: DataFrame, weights: DataFrame) -> DataFrame:
    """(component, size) with size = sum of vertex weights."""
    return components.join(weights, "id").groupBy("component").agg(F.sum("weight").cast("bigint").alias("size"))


# -- packing of whole groups --------------------------------------------------
# The plan is made on (size, number of groups of that size): distinct sizes that add up
# to n rows number at most sqrt(2n), so this table is small whatever n is.


def size_table(groups: DataFrame) -> list[tuple[int, int]]:
    rows = groups.groupBy("size").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("size")).collect()
    return [(int(r["size"]), int(r["c"])) for r in rows]


def _spread(groups: DataFrame, quotas: list[tuple], names: list[str], rest: str, seed: int) -> DataFrame:
    """Give each part its number of groups of each size, in seeded order of the group."""
    spark = groups.sparkSession
    cols = ", ".join(["size bigint"] + [f"`{n}` bigint" for n in names])
    table = spark.createDataFrame(quotas, cols)
    keyed = groups.withColumn("_key", seeded_key(seed, F.lit(0), F.col("component")))
    cuts = hash_cuts(keyed, ["size"], table, bounded=False)
    joined = keyed.join(cuts, "size", "left")
    label = None
    for n in names:
        hit = F.col("_key") <= F.col(n)
        label = F.when(hit, n) if label is None else label.when(hit, n)
    out = F.lit(rest) if label is None else label.otherwise(rest)
    return joined.select("component", "size", out.alias("set"))


def ratio_plan(sizes: list[tuple[int, int]], train: int, test: int, goal: float):
    """How many groups of each size go to test when each goes there while train/test is above ``goal``.

    Within one size the greedy loop has a closed form: the number x of test groups is
    the one that leaves the balance ``train - goal * test`` in the band of one step.
    Returns ([(size, x)], train, test).
    """
    quotas = []
    for size, count in sizes:
        balance = train - goal * test
        x = min(count, max(0, math.ceil((balance + count * size - size) / (size * (1.0 + goal)))))
        quotas.append((size, x))
        test += x * size
        train += (count - x) * size
    return quotas, train, test


def pack_by_ratio(groups: DataFrame, train: int, test: int, goal: float, seed: int = 0) -> tuple[DataFrame, int, int]:
    """Large groups first by ``ratio_plan``; the assignment and the final (train, test) sizes."""
    quotas, train, test = ratio_plan(size_table(groups), train, test, goal)
    return _spread(groups, quotas, ["test"], "train", seed), train, test


def pack_evenly(groups: DataFrame, sizes: list[int], seed: int = 0) -> tuple[DataFrame, list[int]]:
    """Large groups first, each to the part that is smallest so far."""
    sizes = list(sizes)
    k = len(sizes)
    names = [f"part_{i}" for i in range(k)]
    quotas = []
    for size, count in size_table(groups):
        take = [0] * k
        left = count
        # raise the lowest parts level by level; each pass ends at the next higher part
        while left > 0:
            low = min(sizes)
            at = [i for i in range(k) if sizes[i] == low]
            above = [s for s in sizes if s > low]
            steps = max(1, (min(above) - low) // size) if above else -(-left // len(at))
            share = max(1, min(steps, left // len(at)))
            for i in at:
                add = min(left, share)
                take[i] += add
                sizes[i] += add * size
                left -= add
        run, row = 0, [size]
        for i in range(k - 1):
            run += take[i]
            row.append(run)
        quotas.append(tuple(row))
    return _spread(groups, quotas, names[:-1], names[-1], seed), sizes


def pack_first_fit(
    groups: DataFrame, caps: list[int], names: list[str], rest: str, order: Column | None = None
) -> DataFrame:
    """Groups by (size desc, key), each to the first part that still has room.

    ``caps`` are cumulative row limits as in "train up to 80 %, train + val up to 90 %".
    Equal sizes fill in key order (or in ``order``); ranks inside a size come from prefix sums.
    """
    used = [0] * len(caps)
    quotas = []
    for size, count in size_table(groups):
        left, row, run = count, [size], 0
        for i, cap in enumerate(caps):
            room = cap - sum(used[: i + 1])
            fit = max(0, min(left, room // size))
            used[i] += fit * size
            left -= fit
            run += fit
            row.append(run)
        quotas.append(tuple(row))
    spark = groups.sparkSession
    table = spark.createDataFrame(quotas, ", ".join(["size bigint"] + [f"`{n}` bigint" for n in names]))
    keyed = groups.withColumns({"_one": F.lit(1), "_k": F.col("component") if order is None else order})
    ranked = running_totals(keyed, ["size"], [F.col("_k"), F.col("component")], {"_r": "_one"})
    joined = ranked.join(table, "size")
    label = None
    for n in names:
        hit = F.col("_r") <= F.col(n)
        label = F.when(hit, n) if label is None else label.when(hit, n)
    return joined.select("component", "size", label.otherwise(rest).alias("set"))


def giant_first(sizes: DataFrame) -> DataFrame:
    """Components with a flag on the biggest one (lowest name on ties)."""
    top = sizes.agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("c"))
    return sizes.withColumn("is_giant", F.col("component") == top.scalar())

