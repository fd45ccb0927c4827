"""Word and shingle hashes of Arrow text batches, computed on whole batches with NumPy.

Words are hashed by a polynomial over their bytes (prefix sums, so no loop over words), then
mixed; shingles are hashed from the hashes of their words.  Hashes have 64 bits and stand for
the words and shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 17  # bytes hashed at a time; longer only if one word is longer
BATCH_BYTES = 2 << 20  # text handled at a time; longer only if one text is longer
BASE = 0x9E3779B97F4A7C15 | 1

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
# words of letters and digits; every byte beyond ASCII belongs to a word
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
LOWER[0x41:0x5B] += np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(count: int, seed: int) -> np.ndarray:
    """Fixed 64-bit numbers drawn from a seed."""
    return mix((np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(BASE))


class _Powers:
    """Powers of BASE and of its inverse, as far as they were needed."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = max(n, SLICE * 2) + 1
            steps = np.full(size, BASE, dtype=np.uint64)
            steps[0] = 1
            cls.up = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = pow(BASE, -1, 1 << 64)
            cls.down = np.cumprod(steps, dtype=np.uint64)
        return cls.up, cls.down


def small_batches(batches: Iterator[pa.RecordBatch], text: str, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes of text."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            done = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, done + size, side="right")))
            yield batch.slice(start, end - start)
            start = end
    pa.default_memory_pool().release_unused()  # Spark keeps its Python workers for later stages


def word_hashes(texts: pa.Array, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets): the words of text i are hashes[offsets[i]:offsets[i + 1]].  Null texts have none."""
    texts = texts.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(bounds[0]), int(bounds[-1])
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    rows = bounds - low
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    gap = separators[data]
    head = ~gap
    head[1:] &= gap[:-1]
    inner = rows[:-1][rows[:-1] < len(data)]
    head[inner] = ~gap[inner]  # a text starts a word of its own
    tail = ~gap
    tail[:-1] &= gap[1:]
    last = rows[1:][rows[1:] > 0] - 1
    tail[last] = ~gap[last]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    hashes = np.empty(len(starts), dtype=np.uint64)
    done = 0
    while done < len(starts):
        upto = max(done + 1, int(np.searchsorted(ends, starts[done] + SLICE, side="right")))
        s, e = starts[done:upto], ends[done:upto]
        first, size = s[0], int(e[-1] - s[0])
        up, down = _Powers.upto(size)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(LOWER[data[first : first + size]] * up[:size], out=sums[1:])
        hashes[done:upto] = (sums[e - first] - sums[s - first]) * down[s - first] + (e - s).astype(np.uint64)
        done = upto
    return mix(hashes), np.searchsorted(starts, rows)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the runs of ``width`` words; a text with fewer words has its whole sequence as its one shingle."""
    factors = numbers(width, 7) | np.uint64(1)
    counts = np.diff(offsets)
    per_row = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out = np.zeros(len(per_row) + 1, dtype=np.int64)
    np.cumsum(per_row, out=out[1:])
    # first word of every shingle
    at = np.arange(out[-1]) - np.repeat(out[:-1], per_row) + np.repeat(offsets[:-1], per_row)
    length = np.repeat(np.minimum(counts, width), per_row)
    total = length.astype(np.uint64) * np.uint64(BASE)
    for j in range(width):
        if len(words):
            there = words[np.minimum(at + j, len(words) - 1)] * factors[j]
            total += np.where(j < length, mix(there), np.uint64(0)) if (length < width).any() else mix(there)
    return mix(total), out


def least_per_row(values: np.ndarray, offsets: np.ndarray, empty: int) -> np.ndarray:
    """Smallest value of each row; ``empty`` for rows without one."""
    out = np.full(len(offsets) - 1, empty, dtype=values.dtype)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.minimum.reduceat(values, offsets[full])
    return out


def distinct_per_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each row."""
    parts = [np.unique(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    out = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return (np.concatenate(parts) if parts else values[:0]), out


def as_lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One list<int64> per row."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
