"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A text is the set of its runs of ``width`` words.  Its signature has four symbols of 16 bits (the
low bits of minima) in each of ``chunks`` 64-bit numbers.  If two signatures differ in at most
``2 * chunks - 1`` symbols, at least one chunk differs in at most one (pigeonhole), so
each chunk is indexed four times, each time with another symbol left out: every pair within the
distance meets in a bucket.  At a similarity of 0.85 one of 40 symbols differs with probability
0.15, and more than 19 differ in 2 pairs of 10 million.

Exact copies (equal sets) become one vertex.  Inside a bucket no pairs are listed: members are
compared with one member, links are confirmed on the full sets, and buckets whose members are
connected leave.  Of the buckets that are still open after ``STAR_ROUNDS`` such rounds, the vertices outside the
largest component are compared on their full sets with all that their buckets tie to them, in pairs of
blocks from which only links leave, so that no link between different components is lost.  Components are
merged by distributed star contraction.

Defined results: a null or empty text has no shingles and is linked with nothing; rows with one
id are one vertex; repeated rows all stay and get the same component; an empty table gives no rows;
other columns are ignored.  Null ids are vertices of their own only by their text: they take no
part in links (their component is null).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftsplit.llm.words import as_lists, distinct_per_row, least_per_row, mix, numbers, shingle_hashes, small_batches, word_hashes
from riftsplit.operators.graph import connected_components
from riftsplit.plans.durable import broadcast_if_small, stored

CHUNKS = 10
SYMBOLS = 4  # of 16 bits in a chunk
LANE = 0xFFFF
STAR_ROUNDS = 2
BLOCK = 1 << 17  # shingles of a block when open clusters are compared; more only if one set has more
COLUMNS = 1 << 14  # different shingles of a matrix at a time


def _digests(shingles: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two digests of every set, whatever the order of its members."""
    out = []
    for salt in (0, 0x5851F42D4C957F2D):
        sums = np.zeros(len(shingles) + 1, dtype=np.uint64)
        np.cumsum(mix(shingles ^ np.uint64(salt)), out=sums[1:])
        out.append(sums[at[1:]] - sums[at[:-1]])
    return out


def _sketcher(width: int, chunks: int):
    """Arrow batches of (id, text) to (id, n_shingles, two digests of the set, chunks of the signature)."""
    factors, offsets_xor = numbers(chunks * SYMBOLS, 1) | np.uint64(1), numbers(chunks * SYMBOLS, 2)
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64())] + [(c, pa.int64()) for c in ["d1", "d2", *_names(chunks)]])

    def sketch(batches):
        for batch in small_batches(batches, "text"):
            shingles, at = shingle_hashes(*word_hashes(batch.column("text")), width)
            shingles, at = distinct_per_row(shingles, at)
            parts = _digests(shingles, at)
            for c in range(chunks):
                part = np.zeros(batch.num_rows, dtype=np.uint64)
                for p in range(SYMBOLS):
                    i = c * SYMBOLS + p
                    least = least_per_row((shingles ^ offsets_xor[i]) * factors[i], at, 0)
                    part |= (mix(least) & np.uint64(LANE)) << np.uint64(16 * p)
                parts.append(part)
            columns = [batch.column("id"), pa.array(np.diff(at))] + [pa.array(x.view(np.int64)) for x in parts]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return sketch


def _names(chunks: int) -> list[str]:
    return [f"c{i}" for i in range(chunks)]


def _set_maker(width: int):
    """Arrow batches of (id, text, d1, d2) to (id, shingles), for the rows whose set has those digests."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def sets(batches):
        for batch in small_batches(batches, "text"):
            found = distinct_per_row(*shingle_hashes(*word_hashes(batch.column("text")), width))
            d1, d2 = (d.view(np.int64) for d in _digests(*found))
            same = (d1 == batch.column("d1").to_numpy()) & (d2 == batch.column("d2").to_numpy())
            made = pa.RecordBatch.from_arrays([batch.column("id"), as_lists(*found)], schema=schema)
            yield made.filter(pa.array(same))

    return sets


def sketches(df: DataFrame, width: int, chunks: int) -> DataFrame:
    """(id, n_shingles, d1, d2, c0, c1, ...) of a table (id, text)."""
    fields = ", ".join(f"{c} bigint" for c in ["id", "n_shingles", "d1", "d2", *_names(chunks)])
    return df.mapInArrow(_sketcher(width, chunks), fields)


def distance(chunks: int, a: str, b: str) -> Column:
    """Differing symbols of two signatures whose chunks are columns prefixed ``a`` and ``b``."""
    lanes = []
    for c in _names(chunks):
        x = F.col(a + c).bitwiseXOR(F.col(b + c))
        lanes += [F.when(x.bitwiseAND(F.lit(_lane(p))) != 0, 1).otherwise(0) for p in range(SYMBOLS)]
    return reduce(Column.__add__, lanes)


def _lane(p: int) -> int:
    mask = LANE << (16 * p)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def bucket_keys(vertices: DataFrame, chunks: int) -> DataFrame:
    """(tag, key, id): each chunk with each of its symbols left out."""
    keys = [
        F.struct(F.lit(i * SYMBOLS + p).alias("tag"), F.col(c).bitwiseAND(F.lit(~_lane(p))).alias("key"))
        for i, c in enumerate(_names(chunks))
        for p in range(SYMBOLS)
    ]
    return vertices.select("id", F.explode(F.array(*keys)).alias("_k")).select("_k.tag", "_k.key", "id")


def _close(vertices: DataFrame, pairs: DataFrame, chunks: int, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and signatures allow to be links."""
    side = lambda s: vertices.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ["n_shingles", *_names(chunks)]])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    small, large = F.least("a_n_shingles", "b_n_shingles"), F.greatest("a_n_shingles", "b_n_shingles")
    return both.filter(100 * small >= percent * large).filter(distance(chunks, "a_", "b_") <= 2 * chunks - 1).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) as links (src, dst) if the full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("_sb")), "b").join(
        sets.select(F.col("id").alias("a"), F.col("shingles").alias("_sa")), "a"
    )
    shared = F.size(F.array_intersect("_sa", "_sb"))
    counted = both.select("a", "b", shared.alias("_shared"), (F.size("_sa") + F.size("_sb")).alias("_sum"))
    good = counted.filter(100 * F.col("_shared") >= percent * (F.col("_sum") - F.col("_shared")))
    return good.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def near_duplicate_classes(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, chunks: int = CHUNKS
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    texts = df.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    sketched = stored(sketches(texts, width, chunks))
    usable = sketched.filter("n_shingles > 0 AND id IS NOT NULL")
    # copies: one vertex for each different set
    measures = ["n_shingles", *_names(chunks)]
    named = stored(usable.groupBy("d1", "d2").agg(F.min("id").alias("id"), *[F.min(c).alias(c) for c in measures]))
    vertices = named
    if _repeats(named):  # one id, several texts: the first set speaks for the id
        vertices = stored(named.groupBy("id").agg(F.min(F.struct("d1", "d2", *measures)).alias("_v")).select("id", "_v.*"))
    keys = bucket_keys(vertices, chunks)
    shared = keys.groupBy("tag", "key").agg(F.min("id").alias("_low"), F.max("id").alias("_high")).filter("_low < _high")
    members = stored(keys.join(shared.select("tag", "key"), ["tag", "key"]))
    involved = stored(vertices.join(members.select("id").distinct(), "id", "left_semi").select("id", "d1", "d2"))
    wanted = texts.join(broadcast_if_small(involved, 40), "id")
    sets = stored(wanted.mapInArrow(_set_maker(width), "id bigint, shingles array<bigint>"))
    if _repeats(sets):  # repeated rows
        sets = stored(sets.dropDuplicates(["id"]))
    links, labels = None, involved.select("id", F.col("id").alias("component"))
    for turn in range(STAR_ROUNDS + 1):
        labelled = members.join(labels, "id")
        if turn:
            open_buckets = labelled.groupBy("tag", "key").agg(F.min("component").alias("_l"), F.max("component").alias("_h")).filter("_l < _h")
            labelled = stored(labelled.join(open_buckets.select("tag", "key"), ["tag", "key"]))
            if labelled.isEmpty():
                break
        if turn < STAR_ROUNDS:
            # the first member, later another one for each bucket
            order = F.struct(F.lit(0).cast("bigint") if turn == 0 else F.xxhash64("id", "tag", F.lit(turn)), "id", "component")
            middle = labelled.groupBy("tag", "key").agg(F.min(order).alias("_m"))
            pairs = labelled.join(middle, ["tag", "key"]).filter(F.col("component") != F.col("_m.component"))
            pairs = pairs.select(F.col("id").alias("a"), F.col("_m.id").alias("b"))
            near = _close(vertices, pairs.distinct(), chunks, percent)
            new = stored(confirmed(near, sets, percent))
        else:
            new = stored(_cross_links(labelled, sets, percent))
        links = new if links is None else links.unionByName(new)
        labels = connected_components(involved, links)
    joined = named.select("d1", "d2", "id").join(labels, "id", "left")
    classes = joined.select("d1", "d2", F.coalesce("component", "id").alias("_component"))
    out = sketched.join(classes, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(doc_id), "n_shingles", component.alias("component_id"))


def _repeats(table: DataFrame) -> bool:
    return not table.groupBy("id").count().filter("count > 1").isEmpty()


def _open_clusters(labelled: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, component, cluster, main, n_main, n_rest): vertices of open buckets, with the cluster of components that buckets tie together.

    ``main`` says that the vertex is in the largest component of its cluster; the counts are of shingles.
    """
    sizes = sets.select("id", F.size("shingles").alias("n_shingles"))
    members = stored(labelled.select("id", "component").distinct().join(sizes, "id"))
    lowest = labelled.groupBy("tag", "key").agg(F.min("component").alias("_low"))
    ties = labelled.join(lowest, ["tag", "key"]).filter("component <> _low").select(F.col("_low").alias("src"), F.col("component").alias("dst"))
    clusters = connected_components(members.select(F.col("component").alias("id")).distinct(), stored(ties.distinct()))
    clusters = clusters.withColumnsRenamed({"component": "cluster", "id": "component"})
    sized = members.groupBy("component").agg(F.sum("n_shingles").alias("n")).join(clusters, "component")
    top = sized.groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n_all"))
    told = clusters.join(top, "cluster").select(
        "component",
        "cluster",
        (F.col("component") == F.col("top.component")).alias("main"),
        F.col("top.n").alias("n_main"),
        (F.col("n_all") - F.col("top.n")).alias("n_rest"),
    )
    return members.drop("n_shingles").join(told, "component")


def _cross_links(labelled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (src, dst) between different components of one open cluster.

    The vertices outside the largest component are compared with all others of the cluster, in pairs of blocks of about
    BLOCK shingles; a block pair is one task's work, and only links leave it.
    """
    rows = _open_clusters(labelled, sets)
    count = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    upto = lambda n: F.sequence(F.lit(0), count(n) - 1)
    own = F.pmod(F.xxhash64("id"), F.when(F.col("main"), count("n_main")).otherwise(count("n_rest"))).cast("int")
    pair = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    with_rest = F.transform(upto("n_rest"), lambda r: pair("rest", F.least(r, F.col("_own")), F.greatest(r, F.col("_own"))))
    with_main = F.transform(upto("n_main"), lambda m: pair("main", F.col("_own"), m))
    pairs = F.when(F.col("main"), F.transform(upto("n_rest"), lambda r: pair("main", r, F.col("_own")))).otherwise(F.concat(with_rest, with_main))
    dealt = rows.withColumn("_own", own).select("id", "component", "cluster", "main", "_own", F.explode(pairs).alias("_p"))
    dealt = dealt.select("id", "component", "cluster", "main", "_own", "_p.*").join(sets, "id")
    return dealt.groupBy("cluster", "kind", "x", "y").applyInArrow(_comparer(percent), "src bigint, dst bigint")


def _comparer(percent: int):
    """The links between the two blocks of a group (or inside it, if both are the same)."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, component = table.column("id").to_numpy(), table.column("component").to_numpy()
        lists = table.column("shingles").combine_chunks()
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        kind, x, y = (table.column(c)[0].as_py() for c in ("kind", "x", "y"))
        first = ~table.column("main").to_numpy(zero_copy_only=False) if kind == "main" else table.column("_own").to_numpy() == x
        left, right = np.flatnonzero(first), np.flatnonzero(~first if kind == "main" or x != y else first)
        shared = shared_counts(lists.flatten().to_numpy(), sizes, left, right)
        total = sizes[left][:, None] + sizes[right][None, :] - shared
        good = (100 * shared >= percent * total) & (component[left][:, None] != component[right][None, :])
        i, j = np.nonzero(good)
        a, b = ids[left[i]], ids[right[j]]
        return pa.table({"src": np.minimum(a, b), "dst": np.maximum(a, b)})

    return compare


def shared_counts(values: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``left`` with the sets ``right``, by products of 0/1 matrices."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    known, code, often = np.unique(values, return_inverse=True, return_counts=True)
    # shingles of one set alone are in no intersection
    column = np.cumsum(often > 1) - 1
    keep = often[code] > 1
    row, code, width = row[keep], column[code[keep]], int((often > 1).sum())
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    place = np.full((2, len(sizes)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for low in range(0, width, COLUMNS):
        part = slice(*np.searchsorted(code, [low, low + COLUMNS]))
        sides = []
        for side, n in ((0, len(left)), (1, len(right))):
            at = place[side, row[part]]
            matrix = np.zeros((n, min(COLUMNS, width - low)), dtype=np.float32)
            matrix[at[at >= 0], code[part][at >= 0] - low] = 1.0
            sides.append(matrix)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return out


def keep_one_of_each_class(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows whose id names their class; rows without an id stay."""
    found = near_duplicate_classes(df, doc_id, text, **options)
    gone = stored(found.filter(F.col("component_id") != F.col(doc_id)).select(doc_id).distinct())
    return df.join(broadcast_if_small(gone, 16), doc_id, "left_anti")
