"""Hi and Lo splits: similarity-bounded cuts and lead-optimisation clusters."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftsplit.operators.graph import (
    both_ways,
    coarsen,
    component_sizes,
    connected_components,
    giant_first,
    pack_by_ratio,
    pack_evenly,
    ratio_plan,
    size_table,
)
from riftsplit.operators.separator import COARSEST, joint_parts, vertex_separator
from riftsplit.operators.similarity import collapse_copies, similarity_edges
from riftsplit.plans.durable import durable, stored

# How often the bounds of a cut are tightened when packing the small components misses a minimum.
TRIES = 4


def _graph(df, row_id, bits, n_bits, threshold):
    members, reps = collapse_copies(df, row_id, bits)
    edges = stored(similarity_edges(reps, "id", "bits", threshold, n_bits))
    return members, reps.select("id", "weight"), edges


def _finish(members, of_rep: DataFrame, split_index: int = 0) -> DataFrame:
    """Map decisions on representatives back to item ids; undecided items are discarded."""
    named = members.join(of_rep.select(F.col("id").alias("rep"), "set"), "rep", "left")
    return named.select(F.lit(split_index).alias("split_index"), "id", F.coalesce("set", F.lit("discard")).alias("set"))


def hi_split(
    df, row_id, bits, n_bits, threshold=0.4, train_min_frac=0.7, test_min_frac=0.1, coarsening_threshold=None, seed=0
) -> DataFrame:
    """No test item is more similar than the threshold to a train item; items may be discarded.

    Whole components are packed first: if that meets the fractions, nothing is lost.
    Otherwise a balanced vertex separator of least weight is taken out of the biggest component, and the small components
    fill up the sides.  With ``coarsening_threshold`` items above it stay together.
    """
    if train_min_frac + test_min_frac > 1 or min(train_min_frac, test_min_frac) <= 0:
        raise ValueError("minimum fractions must be positive and sum to at most 1")
    members, reps, edges = _graph(df, row_id, bits, n_bits, threshold)
    components = durable(connected_components(reps, edges.select("src", "dst")))
    sizes = durable(giant_first(component_sizes(components, reps)))
    total = reps.agg(F.sum("weight")).first()[0]
    goal = train_min_frac / test_min_frac
    giant_id, giant = sizes.filter("is_giant").select("component", "size").first()
    small = sizes.filter("not is_giant").select("component", "size")
    packed, train, test = pack_by_ratio(small, giant, 0, goal, seed)
    if train >= train_min_frac * total and test >= test_min_frac * total:
        whole = packed.select("component", "set").unionByName(
            sizes.filter("is_giant").select("component", F.lit("train").alias("set"))
        )
        return _finish(members, components.join(whole, "component").select("id", "set"))

    inside, links = _component(components, reps, edges, giant_id)
    small_sizes = size_table(small)
    loose = total - giant
    # side 0 is the set with the smaller minimum
    names = ("test", "train") if test_min_frac <= train_min_frac else ("train", "test")
    least = {"train": math.ceil(train_min_frac * total), "test": math.ceil(test_min_frac * total)}
    reached = (0.0, 0.0)
    graphs = [(inside, links, None)]
    if coarsening_threshold is not None:
        into, cv, ce = coarsen(inside, links, coarsening_threshold)
        graphs.insert(0, (durable(cv), durable(ce), into))
    for vertices, joins, into in graphs:
        low = max(1, least[names[0]] - loose)
        for _ in range(TRIES):
            sides = vertex_separator(vertices, joins, low, max(1, least[names[1]] - loose))
            if sides is None:
                break
            weights = {r["side"]: int(r["w"]) for r in vertices.join(sides, "id").groupBy("side").agg(F.sum("weight").alias("w")).collect()}
            part = {names[0]: weights.get(0, 0), names[1]: weights.get(2, 0)}
            _, train, test = ratio_plan(small_sizes, part["train"], part["test"], goal)
            reached = max(reached, (min(train / least["train"], 1.0), min(test / least["test"], 1.0)))
            if train >= least["train"] and test >= least["test"]:
                label = F.when(F.col("side") == 0, names[0]).when(F.col("side") == 2, names[1]).otherwise("discard")
                cut = sides.select("id", label.alias("set"))
                if into is not None:  # back from condensed vertices to representatives
                    cut = into.join(cut.withColumnRenamed("id", "leader"), "leader").select("id", "set")
                packed, _, _ = pack_by_ratio(small, part["train"], part["test"], goal, seed)
                rest = components.join(packed.select("component", "set"), "component").select("id", "set")
                return _finish(members, cut.unionByName(rest))
            low += max(1, least[names[0]] - {"train": train, "test": test}[names[0]])
    raise RuntimeError(f"no vertex separator found that meets the minimum fractions; best shares of the goals {reached}")


def _component(components, reps, edges, name):
    """Vertices and edges of one component."""
    inside = durable(reps.join(components.filter(F.col("component") == name).select("id"), "id", "left_semi"))
    return inside, stored(edges.join(inside.select(F.col("id").alias("src")), "src", "left_semi"))


def hi_k_fold(df, row_id, bits, n_bits, threshold=0.4, k=3, fold_min_frac=None, seed=0) -> DataFrame:
    """k parts without links above the threshold, each of at least ``fold_min_frac`` of the rows.

    Sets are named ``part_0`` ... ``part_{k-1}``; part j is the test side of fold j.  Whole components are packed first; if
    that is not enough, parts are cut off the biggest component one by one, each by a vertex separator of least weight, or searched for
    together (first, where the component has more than ``COARSEST`` vertices).
    """
    fold_min_frac = 0.9 / k if fold_min_frac is None else fold_min_frac
    members, reps, edges = _graph(df, row_id, bits, n_bits, threshold)
    components = durable(connected_components(reps, edges.select("src", "dst")))
    sizes = durable(giant_first(component_sizes(components, reps)))
    total = reps.agg(F.sum("weight")).first()[0]
    need = int(total * fold_min_frac)
    packed, parts = pack_evenly(sizes.select("component", "size"), [0] * k, seed)
    if min(parts) >= need:
        return _finish(members, components.join(packed.select("component", "set"), "component").select("id", "set"))
    giant_id, giant = sizes.filter("is_giant").select("component", "size").first()
    small = sizes.filter("not is_giant").select("component", "size")
    inside, links = _component(components, reps, edges, giant_id)
    ways, reached = [_cut_off, _cut_together], 0
    if inside.count() > COARSEST:  # condensing blurs the graph that is cut in two
        ways.reverse()
    for way in ways:
        low = max(1, need - int(total - giant) // k)
        for _ in range(TRIES):
            found = way(inside, links, k, low)
            if found is None:
                break
            cut, weights = found
            packed, parts = pack_evenly(small, weights, seed)
            reached = max(reached, min(parts))
            if min(parts) >= need:
                rest = components.join(packed.select("component", "set"), "component").select("id", "set")
                return _finish(members, cut.unionByName(rest))
            low += max(1, need - min(parts))
    raise RuntimeError(f"no {k - 1} vertex separators found that leave {need} rows in each part; best minimum {reached}")


def _cut_off(vertices: DataFrame, edges: DataFrame, k: int, low: int):
    """((id, set), weights): ``k`` parts of at least ``low`` each, one after the other, or None."""
    done, weights = [], []
    for i in range(k - 1):
        sides = vertex_separator(vertices, edges, low, (k - 1 - i) * low)
        if sides is None:
            return None
        told = durable(vertices.join(sides, "id"))
        weights.append(int(told.filter("side = 0").agg(F.sum("weight")).first()[0] or 0))
        done.append(told.filter("side < 2").select("id", F.when(F.col("side") == 0, f"part_{i}").otherwise("discard").alias("set")))
        vertices = told.filter("side = 2").drop("side")
        keep = vertices.select(F.col("id").alias("src"))
        edges = edges.join(keep, "src", "left_semi").join(keep.withColumnRenamed("src", "dst"), "dst", "left_semi")
    weights.append(int(vertices.agg(F.sum("weight")).first()[0] or 0))
    done.append(vertices.select("id", F.lit(f"part_{k - 1}").alias("set")))
    return reduce(DataFrame.unionByName, done), weights


def _cut_together(vertices: DataFrame, edges: DataFrame, k: int, low: int):
    """((id, set), weights): ``k`` parts of at least ``low`` each by one search, or None."""
    reached, sides = joint_parts(vertices, edges, [low] * k)
    if reached < 1:
        return None
    told = vertices.join(sides, "id")
    sums = {r["side"]: int(r["w"]) for r in told.groupBy("side").agg(F.sum("weight").alias("w")).collect()}
    name = F.when(F.col("side") < k, F.concat(F.lit("part_"), F.col("side").cast("string"))).otherwise("discard")
    return told.select("id", name.alias("set")), [sums.get(i, 0) for i in range(k)]


def fold_sets(parts: DataFrame, k: int) -> DataFrame:
    """Train/test assignment of every fold from a part table."""
    test = F.col("set") == F.concat(F.lit("part_"), F.col("fold").cast("string"))
    side = F.when(F.col("set") == "discard", "discard").when(test, "test").otherwise("train")
    spread = parts.withColumn("fold", F.explode(F.lit(list(range(k)))))
    return spread.select(F.col("fold").alias("split_index"), "id", side.alias("set"))


def _next_centres(first, state: DataFrame, gone: DataFrame, lost: DataFrame, wanted, sums: list[str]) -> list:
    """The leading centres of ``first`` that the one-at-a-time loop takes next, whatever the ones before them change.

    What reaches the driver is at most one row per pair of centres, and one per centre.
    """
    regions = gone.select("owner", "id").union(lost.select("owner", "id"))
    shared = regions.groupBy("id").agg(F.sort_array(F.collect_set("owner")).alias("o")).filter(F.size("o") > 1)
    pairs = F.flatten(F.transform("o", lambda x, i: F.transform(F.slice("o", i + 2, F.size("o")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    touch = shared.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()
    left = [(F.col(c) - F.col(f"d_{c}")).alias(c) for c in sums]
    key = F.struct("weight", "id")
    upcoming = lost.join(state, "id").select("owner", "id", *left).filter(wanted).groupBy("owner").agg(F.min(key).alias("key"))
    inside = gone.join(F.broadcast(gone.select(F.col("owner").alias("id")).distinct()), "id").filter("owner <> id")
    still = state.join(regions.select("id").distinct(), "id", "left_anti").agg(F.max("weight").alias("weight"))
    nothing = F.lit(None)
    of = state.schema
    cast = lambda c, name, like: c.cast(of[like].dataType).alias(name)
    facts = (
        touch.select(F.lit("touch").alias("kind"), "a", "b", cast(nothing, "weight", "weight"))
        .union(inside.select(F.lit("inside"), "owner", "id", nothing))
        .union(upcoming.select(F.lit("upcoming"), "owner", "key.id", "key.weight"))
        .union(still.select(F.lit("still"), nothing, nothing, "weight"))
        .collect()
    )
    touching = {(r["a"], r["b"]) for r in facts if r["kind"] == "touch"}
    taken = {(r["a"], r["b"]) for r in facts if r["kind"] == "inside"}
    coming = {r["a"]: (r["weight"], r["b"]) for r in facts if r["kind"] == "upcoming"}
    top = next(r["weight"] for r in facts if r["kind"] == "still")
    chosen: list = []
    for r in first:
        c, mine = r["id"], (r["weight"], r["id"])
        if any((o, c) in taken for o in chosen):
            continue
        if chosen:
            if any((o, c) in touching or (c, o) in touching for o in chosen):
                break
            if any(coming[o] < mine for o in chosen if o in coming) or top is None or not r["weight"] < top:
                break
        chosen.append(c)
    return chosen


def lo_split(
    df, row_id, bits, n_bits, value, threshold=0.4, min_cluster_size=5, max_clusters=50, std_threshold=0.6, batch=16
) -> DataFrame:
    """(split_index, id, set, cluster): lead-optimisation test clusters.

    One after another the centre with the fewest neighbours (itself counted; more than
    ``min_cluster_size``, below the current maximum, label spread of at least
    ``std_threshold``; lowest id on ties) gives its neighbours to test and stays in
    train; everything as similar as the threshold to either is taken out.  Neighbour
    statistics are kept as sums and only reduced by what a round removes.

    A round works out what each of the next ``batch`` centres would take out and change, and decides as many of them as
    come next anyway: those whose regions do not touch, before any vertex changed by an earlier one comes up, and
    below the largest number of neighbours that no region changes.  The result is that of one centre a round.
    """
    mean = df.agg(F.avg(value)).scalar()
    y = F.col("_y")
    centred = df.withColumn("_y", F.col(value).cast("double") - mean)
    members, reps = collapse_copies(centred, row_id, bits, {"s1": y, "s2": y * y})
    edges = similarity_edges(reps, "id", "bits", threshold, n_bits, inclusive=True)
    near = stored(both_ways(edges.withColumn("strict", F.col("sim") > threshold), "strict"))
    sums = ["weight", "s1", "s2"]
    own = reps.select("id", *sums)

    def around(nodes: DataFrame) -> DataFrame:
        """Sums of the given nodes over each strict neighbour."""
        hit = near.filter("strict").join(nodes.withColumnRenamed("id", "other"), "other")
        return hit.groupBy(F.col("node").alias("id")).agg(*[F.sum(c).alias(f"d_{c}") for c in sums])

    def shifted(base: DataFrame, change: DataFrame, sign: int) -> DataFrame:
        moved = [(F.col(c) + F.lit(sign) * F.coalesce(f"d_{c}", F.lit(0))).alias(c) for c in sums]
        return base.join(change, "id", "left").select("id", *moved)

    state = durable(shifted(own, around(own), 1))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("weight") - F.pow(F.col("s1") / F.col("weight"), 2.0)))
    decided, n_clusters = None, 0
    id_type = state.schema["id"].dataType.simpleString()
    spark = df.sparkSession
    while n_clusters < max_clusters:
        top = state.agg(F.max("weight")).scalar()
        wanted = (F.col("weight") > min_cluster_size) & (spread >= std_threshold)
        able = state.filter(wanted & (F.col("weight") < top))
        first = able.orderBy("weight", "id").limit(batch).select("weight", "id").collect()
        if not first:
            break
        picks = spark.createDataFrame([(r["id"],) for r in first], f"owner {id_type}")
        alive = state.select("id")
        around_pick = near.filter("strict").join(F.broadcast(picks.withColumnRenamed("owner", "node")), "node")
        core = around_pick.select(F.col("node").alias("owner"), F.col("other").alias("id")).join(alive, "id", "left_semi")
        core = core.select("owner", "id").union(picks.select("owner", F.col("owner").alias("id")))
        touched = near.join(core.withColumnRenamed("id", "node"), "node").select("owner", F.col("other").alias("id"), F.lit(False).alias("in_core"))
        taken = touched.join(alive, "id", "left_semi").select("owner", "id", "in_core").union(core.select("owner", "id", F.lit(True)))
        gone = stored(taken.groupBy("owner", "id").agg(F.max("in_core").alias("in_core")))
        weighed = near.filter("strict").join(gone.select("owner", F.col("id").alias("other")), "other").join(own.withColumnRenamed("id", "other"), "other")
        lost = weighed.groupBy("owner", F.col("node").alias("id")).agg(*[F.sum(c).alias(f"d_{c}") for c in sums])
        lost = stored(lost.join(alive, "id", "left_semi").join(gone, ["owner", "id"], "left_anti"))
        chosen = _next_centres(first, state, gone, lost, wanted, sums)[: max_clusters - n_clusters]
        order = F.broadcast(spark.createDataFrame([(c, n_clusters + k) for k, c in enumerate(chosen)], f"owner {id_type}, _k int"))
        out = stored(gone.join(order, "owner").select("id", F.when(F.col("in_core"), F.col("_k")).alias("cluster"), F.col("owner").alias("centre")))
        decided = out if decided is None else decided.union(out)
        state = stored(shifted(state.join(out, "id", "left_anti"), lost.join(order, "owner", "left_semi").drop("owner"), -1))
        n_clusters += len(chosen)
    if decided is None:
        return members.select(F.lit(0).alias("split_index"), "id", F.lit("train").alias("set"), F.lit(None).cast("int").alias("cluster"))
    named = members.join(decided.withColumnRenamed("id", "rep"), "rep", "left")
    label = (
        F.when(F.col("centre").isNull() | (F.col("id") == F.col("centre")), "train")
        .when(F.col("cluster").isNotNull(), "test")
        .otherwise("discard")
    )
    test_cluster = F.when(label == "test", F.col("cluster")).alias("cluster")
    return named.select(F.lit(0).alias("split_index"), "id", label.alias("set"), test_cluster)
