"""Sequence packing: first-fit decreasing on a tournament tree, in randomised groups of documents.

Texts become token ids (the ids of a text and an end id); documents longer than a sequence are
cut into full pieces and a rest.  Pieces are dealt at random into groups of about ``group_size``, and each
group is packed alone: longest piece first, each into the first sequence that has room.  The tree
holds the room of every sequence, the larger of two at each inner node, so the first fit is found by
walking down.  The pieces are written before they are dealt, so a repeated task deals alike.

Texts are tokenized word by word between white space and before closing marks (no token spans these),
each different word once.

Defined results: a null or empty text is the end id alone; every row is packed, repeated rows
and null ids included; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftsplit.llm.words import small_batches
from riftsplit.plans.durable import stored

LENGTH = 2048
END_ID = 1
GROUP_SIZE = 4096
CACHED_WORDS = 800_000
TOKEN_BYTES = 8 << 20  # text tokenized at a time: each different word of it is looked up once
# the tokenizer cuts between a letter or digit and the marks that end a word, so they can be words of their own
WORD_END = r"([\pL\pN])([.,!?;|%&$*#]+)([ \n]|$)"


class WordTokens:
    """Token ids of words, kept for words seen before (the memory is cleared when it is full)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1 << 16, dtype=np.int64)

    def _add(self, words: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        first, used = len(self.slot), int(self.ends[len(self.slot) - 1]) if self.slot else 0
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter((i for ids in found for i in ids), dtype=np.uint32, count=int(lengths.sum()))
        while used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(words) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[used : used + len(flat)] = flat
        self.ends[first : first + len(words)] = used + np.cumsum(lengths)
        self.slot.update(zip(words, range(first, first + len(words)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts, nulls as empty."""
        texts = texts.fill_null("")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are written in lower case
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, WORD_END, r"\1 \2 "))
        bounds = np.asarray(split.offsets).astype(np.int64)
        coded = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.slot) > CACHED_WORDS:
            self.clear()
        missing = [w for w in words if w not in self.slot]
        if missing:
            self._add(missing)
        slots = np.fromiter(map(self.slot.__getitem__, words), dtype=np.int64, count=len(words))
        per_word = slots[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.int64)
        ends = self.ends[per_word]
        starts = np.where(per_word > 0, self.ends[per_word - 1], 0)
        upto = np.zeros(len(per_word) + 1, dtype=np.int64)
        np.cumsum(ends - starts, out=upto[1:])
        ids = self.ids[np.repeat(starts - upto[:-1], ends - starts) + np.arange(upto[-1])]
        return ids, upto[bounds - bounds[0]]


def _cutter(path: str, length: int, end_id: int):
    """(id, text) to the pieces of every text."""
    schema = pa.schema([("id", pa.int64())] + [(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens")])

    def cut(batches):
        tokens = None
        for batch in small_batches(batches, "text", TOKEN_BYTES):
            tokens = tokens or WordTokens(path)
            ids, at = tokens.encode(batch.column("text"))
            # the end id after every text
            ids = np.insert(ids, at[1:], end_id).astype("<u4")
            at = at + np.arange(len(at))
            sizes = np.diff(at)
            pieces = (sizes + length - 1) // length
            row = np.repeat(np.arange(len(sizes)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
            size = np.minimum(length, sizes[row] - start)
            low = at[:-1][row] + start
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(low.tolist(), (low + size).tolist(), strict=True)]
            columns = [batch.column("id").take(pa.array(row))] + [pa.array(x, pa.int64()) for x in (start, size, crc, sizes[row])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return cut


def first_fit_decreasing(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece; no piece is longer than ``length``.  Ties keep their order."""
    n = len(sizes)
    width = 1 << max(0, (n - 1).bit_length())
    room = [length] * (2 * width)  # node k has the children 2k and 2k + 1; leaves are the sequences
    sequence, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, k = int(sizes[i]), 1
        while k < width:
            k *= 2
            if room[k] < size:
                k += 1
        sequence[i], offset[i] = k - width, length - room[k]
        room[k] -= size
        while k > 1:
            k //= 2
            room[k] = max(room[2 * k], room[2 * k + 1])
    return sequence, offset


def _packer(length: int):
    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("_n", "ascending")])
        sequence, offset = first_fit_decreasing(group.column("length").to_numpy(), length)
        group_id = group.column("_group").to_numpy()
        out = group.append_column("sequence_id", pa.array((group_id << 32) + sequence)).append_column("offset", pa.array(offset))
        return out.drop_columns(["_group", "_n"])

    return pack


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    group_size: int = GROUP_SIZE,
) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``tokenizer`` is the path of a vocabulary file, present on every machine.
    """
    texts = df.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    fields = ["start", "length", "ids_crc32", "doc_tokens"]
    schema = ", ".join(["id bigint", *[f"{c} bigint" for c in fields]])
    pieces = stored(texts.mapInArrow(_cutter(tokenizer, length, end_id), schema))
    groups = max(1, round(pieces.count() / group_size))
    # the place in the stored table numbers the pieces, so copies are dealt apart
    dealt = pieces.withColumn("_n", F.monotonically_increasing_id())
    dealt = dealt.withColumn("_group", F.pmod(F.xxhash64("_n"), F.lit(groups)))
    packed = dealt.groupBy("_group").applyInArrow(_packer(length), f"{schema}, sequence_id bigint, offset bigint")
    return packed.withColumnRenamed("id", doc_id)
