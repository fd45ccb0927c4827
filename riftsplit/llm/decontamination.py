"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Short items (the queries) are looked for inside long documents.  Jaccard similarity to a long document
is tiny whatever the containment, so documents are partitioned by size: a partition holds the
documents of up to 2^p shingles and uses one-permutation MinHash with 2^(p+1) bins.  Each bin keeps the
least hash of the shingles that fall into it.  With at most half a shingle per bin, a shingle of
an item that the document has is its bin's minimum with probability 0.78 or more in the fullest documents
of a partition; an item shares its bins with the document of every partition in which it looks.
An item and a document meet in a bin when both have the same minimum there: one shared
shingle that is a minimum on both sides makes a candidate.  An item with 8 shared shingles is
missed with probability below 10^-4, one with 20 below 10^-12.

Items with fewer than ``SHORT`` different shingles do without bins: all their shingles are looked up among all
shingles of the documents, so none is missed.  An item with k < ``width`` words is one shingle of k words and
is looked up among the runs of k words of every document, whatever the document's length.

Candidates are verified on the full shingle sets of item and document: containment is the
number of the item's different shingles that the document has, over their number.

Words are runs of letters and digits in any case (A-Z folded), so spacing and punctuation do not matter.
Defined results: null and empty texts have no shingles and meet nothing; a text with fewer than
``width`` words is one shingle, its whole sequence (an item of that kind is also found inside longer texts); rows with one id are one document (or item);
null ids take no part; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftsplit.llm.words import PUNCTUATION, as_lists, distinct_per_row, mix, shingle_hashes, small_batches, word_hashes
from riftsplit.plans.durable import broadcast_if_small, stored

LEAST_PARTITION = 6  # documents of up to 64 shingles are one partition
SPARE = 1  # bins are 2^SPARE for each shingle of the largest document of the partition
SHORT = 8  # items with fewer different shingles are looked up by all of them
FILTER_KEYS = 1_000_000  # up to so many shingles of short items are sent to the tasks that read documents
BIN_SALT = np.uint64(0x2545F4914F6CDD1D)


def partition_of(sizes: np.ndarray) -> np.ndarray:
    """p such that a size is in (2^(p-1), 2^p], at least LEAST_PARTITION."""
    return np.maximum(LEAST_PARTITION, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))


def one_permutation(shingles: np.ndarray, at: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(minima, offsets): the least hash in each bin in use, for rows with 2^bits bins.

    The bin is the top bits of a mixed hash and the order is that of the rest, so sorting a row by the mixed
    hash puts the minimum of each bin first.
    """
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    mixed = mix(shingles ^ BIN_SALT)
    order = np.lexsort((mixed, row))
    mixed = mixed[order]
    bins = mixed >> (np.uint64(64) - bits.astype(np.uint64)[row])
    first = np.ones(len(mixed), dtype=bool)
    first[1:] = (bins[1:] != bins[:-1]) | (row[1:] != row[:-1])
    out = np.zeros(len(at), dtype=np.int64)
    np.cumsum(np.bincount(row[first], minlength=len(at) - 1), out=out[1:])
    return mixed[first], out


def _sets(width: int):
    def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return distinct_per_row(*shingle_hashes(*word_hashes(texts, PUNCTUATION), width))

    return sets


def _document_sketcher(width: int):
    """(id, text) to (id, partition, minima)."""
    schema = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("minima", pa.list_(pa.int64()))])
    sets = _sets(width)

    def sketch(batches):
        for batch in small_batches(batches, "text"):
            shingles, at = sets(batch.column("text"))
            part = partition_of(np.diff(at))
            minima = as_lists(*one_permutation(shingles, at, part + SPARE))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(part.astype(np.int32)), minima], schema=schema)

    return sketch


def _item_sketcher(width: int, parts: list[int]):
    """(id, text) to (id, partition, minima), one row for each partition in use."""
    schema = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("minima", pa.list_(pa.int64()))])
    sets = _sets(width)

    def sketch(batches):
        for batch in small_batches(batches, "text"):
            shingles, at = sets(batch.column("text"))
            for p in parts:
                n = batch.num_rows
                minima = as_lists(*one_permutation(shingles, at, np.full(n, p + SPARE)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.full(n, p, np.int32)), minima], schema=schema)

    return sketch


def _set_maker(width: int):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    sets = _sets(width)

    def make(batches):
        for batch in small_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), as_lists(*sets(batch.column("text")))], schema=schema)

    return make


def _short_items(width: int):
    """(id, text) to (id, length, hash): the shingles of items with fewer than SHORT, and the words in each."""
    schema = pa.schema([("id", pa.int64()), ("length", pa.int32()), ("hash", pa.int64())])

    def short(batches):
        for batch in small_batches(batches, "text"):
            words, offsets = word_hashes(batch.column("text"), PUNCTUATION)
            shingles, at = distinct_per_row(*shingle_hashes(words, offsets, width))
            sizes = np.diff(at)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            few = np.flatnonzero(sizes[rows] < SHORT)
            length = np.minimum(np.diff(offsets), width).astype(np.int32)[rows[few]]
            columns = [batch.column("id").take(pa.array(rows[few])), pa.array(length), pa.array(shingles[few].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return short


def _short_finder(lengths: list[int], keys):
    """(id, text) to (id, length, hash): the different runs of so many words, only those among the keys (a broadcast sorted array) if given."""
    schema = pa.schema([("id", pa.int64()), ("length", pa.int32()), ("hash", pa.int64())])

    def find(batches):
        for batch in small_batches(batches, "text"):
            words, offsets = word_hashes(batch.column("text"), PUNCTUATION)
            for k in lengths:
                shingles, at = shingle_hashes(words, offsets, k)
                hashes, rows = shingles.view(np.int64), np.repeat(np.arange(len(at) - 1), np.diff(at))
                if keys is not None:
                    known = keys.value
                    hit = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
                    hashes, rows = hashes[hit], rows[hit]
                order = np.lexsort((hashes, rows))
                hashes, rows = hashes[order], rows[order]
                new = np.ones(len(rows), dtype=bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
                hashes, rows = hashes[new], rows[new]
                columns = [batch.column("id").take(pa.array(rows)), pa.array(np.full(len(rows), k, np.int32)), pa.array(hashes)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return find


def _meet_short(docs: DataFrame, tests: DataFrame, width: int) -> DataFrame | None:
    """(id, item, length): documents and short items that share a shingle; None without short items."""
    keys = stored(tests.mapInArrow(_short_items(width), SHORT_KEYS).distinct())
    lengths = sorted(r["length"] for r in keys.select("length").distinct().collect())
    if not lengths:
        return None
    hashes = keys.select("hash").distinct()
    known = None
    if hashes.count() <= FILTER_KEYS:
        known = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r["hash"] for r in hashes.collect()], dtype=np.int64)))
    runs = docs.mapInArrow(_short_finder(lengths, known), SHORT_KEYS)
    items = broadcast_if_small(stored(keys.groupBy("length", "hash").agg(F.collect_set("id").alias("items"))), 64)
    return runs.join(items, ["length", "hash"]).select("id", F.explode("items").alias("item"), "length").distinct()


def _texts(df: DataFrame, row_id: str, text: str) -> DataFrame:
    return df.select(F.col(row_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).filter("id IS NOT NULL")


SKETCH = "id bigint, part int, minima array<bigint>"
SETS = "id bigint, shingles array<bigint>"
SHORT_KEYS = "id bigint, length int, hash bigint"


def contaminated(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): items of which a document has ``percent`` of the shingles or more."""
    docs, tests = _texts(documents, doc_id, text), _texts(items, item_id, text)
    sketched = docs.mapInArrow(_document_sketcher(width), SKETCH)
    # the largest possible partition: a shingle takes two bytes of text at least
    longest = docs.agg(F.max(F.octet_length("text")).alias("n")).first()["n"] or 1
    parts = list(range(LEAST_PARTITION, max(LEAST_PARTITION, int(longest // 2).bit_length()) + 1))
    keys = tests.mapInArrow(_item_sketcher(width, parts), SKETCH).select("part", F.explode("minima").alias("least"), F.col("id").alias("item"))
    keys = broadcast_if_small(stored(keys.groupBy("part", "least").agg(F.collect_set("item").alias("items"))), 64)
    met = sketched.select("id", "part", F.explode("minima").alias("least")).join(keys, ["part", "least"])
    pairs = met.select("id", F.explode("items").alias("item"))
    short = _meet_short(docs, tests, width)
    if short is not None:
        short = stored(short)
        pairs = pairs.unionByName(short.filter(F.col("length") == width).select("id", "item"))
    candidates = stored(pairs.distinct())
    # full sets of the candidates on both sides
    wanted = candidates.select("id").distinct()
    found = docs.join(broadcast_if_small(stored(wanted), 16), "id", "left_semi")
    doc_sets = found.mapInArrow(_set_maker(width), SETS).select("id", F.col("shingles").alias("_d"))
    item_sets = tests.join(candidates.select(F.col("item").alias("id")).distinct(), "id", "left_semi")
    item_sets = item_sets.mapInArrow(_set_maker(width), SETS).select(F.col("id").alias("item"), F.col("shingles").alias("_i"))
    both = candidates.join(doc_sets, "id").join(item_sets, "item")
    counted = both.select("id", "item", F.size(F.array_intersect("_d", "_i")).alias("n_shared"), F.size("_i").alias("n_item"))
    leaks = counted.filter(100 * F.col("n_shared") >= percent * F.col("n_item"))
    if short is not None:  # an item of fewer words is one shingle, so to meet it is to contain it
        one = F.lit(1).cast("int")
        whole = short.filter(F.col("length") < width).select("id", "item", one.alias("n_shared"), one.alias("n_item"))
        leaks = leaks.unionByName(whole)
    # rows with one id: the row with the largest share speaks for the id
    return leaks.groupBy(F.col("id").alias(doc_id), F.col("item").alias(item_id)).agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))


def drop_contaminated(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that have no item."""
    leaks = stored(contaminated(documents, items, doc_id, **options).select(doc_id).distinct())
    return documents.join(broadcast_if_small(leaks, 16), doc_id, "left_anti")
