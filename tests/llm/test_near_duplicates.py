import random

import numpy as np
import pyarrow as pa
import pytest

from riftsplit.llm import near_duplicates as nd
from riftsplit.llm.words import PUNCTUATION, SPACES, shingle_hashes, word_hashes


def shingles(text, width):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t, width))
    ids = sorted(sets)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice([1, 2, 8, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, " ".join(words)))
            n += 1
    return rows


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_classes_equal_brute_force(docs, width, percent):
    rows = corpus(width) + [(900, None), (901, ""), (902, "  \t "), (903, "One two"), (904, "one\ntwo"), (905, "long text " * 20_000)]
    want = brute(rows, width, percent)
    got = nd.near_duplicate_classes(docs(rows), width=width, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert want[904][1] == 903


def test_repeats_null_ids_and_shared_ids(docs):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text), (7, text), (8, text), (None, text), (9, "other words here now"), (9, text + " end")]
    got = [(r["doc_id"], r["component_id"]) for r in nd.near_duplicate_classes(docs(rows)).collect()]
    assert len(got) == 6
    assert got.count((7, 7)) == 2 and (8, 7) in got and got.count((None, 7)) == 1
    kept = nd.keep_one_of_each_class(docs(rows))
    assert {r["doc_id"] for r in kept.collect()} >= {7, None} and kept.columns == docs(rows).columns


def test_empty_table(docs):
    assert nd.near_duplicate_classes(docs([])).count() == 0


def test_every_pair_within_the_distance_meets(spark):
    """Pigeonhole: 2 * chunks - 1 differing symbols leave a chunk with at most one."""
    rng = np.random.default_rng(0)
    chunks, rows = 3, []
    for i in range(200):
        a = rng.integers(0, 1 << 16, chunks * 4)
        b = a.copy()
        b[rng.choice(chunks * 4, 2 * chunks - 1, replace=False)] ^= 1
        for k, symbols in enumerate((a, b)):
            packed = [int(sum(int(s) << (16 * p) for p, s in enumerate(symbols[c * 4 : c * 4 + 4]))) for c in range(chunks)]
            rows.append((2 * i + k, *[x - (1 << 64) if x >= 1 << 63 else x for x in packed]))
    vertices = spark.createDataFrame(rows, "id bigint, c0 bigint, c1 bigint, c2 bigint")
    keys = nd.bucket_keys(vertices, chunks)
    met = keys.alias("x").join(keys.alias("y"), ["tag", "key"]).selectExpr("x.id AS a", "y.id AS b").filter("a + 1 = b AND a % 2 = 0")
    assert met.distinct().count() == 200


@pytest.mark.parametrize("gaps", [SPACES, PUNCTUATION])
def test_word_hashes_split_like_the_texts(gaps):
    texts = ["ab cd", "", None, "ab", " cd  Ab\n", "é,é x", "a" * 300_000 + " b", "b"]
    hashes, at = word_hashes(pa.array(texts).slice(0), gaps)
    words = [hashes[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert words[0] == [words[3][0], words[4][0]] and words[4] == [words[0][1], words[0][0]]
    assert words[1] == words[2] == [] and len(words[5]) == (3 if gaps is PUNCTUATION else 2)
    assert len(words[6]) == 2 and words[6][1] == words[7][0]
    sliced, cut = word_hashes(pa.array(texts).slice(4, 2), gaps)
    assert sliced[cut[0] : cut[1]].tolist() == words[4]
    whole, rows = shingle_hashes(hashes, at, 3)
    assert np.diff(rows).tolist() == [1, 0, 0, 1, 1, 1, 1, 1]
