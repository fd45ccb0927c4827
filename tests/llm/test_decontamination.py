import random
import re

from riftsplit.llm import decontamination as dc

WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def shingles(text, width=5):
    words = WORD.findall((text or "").lower())
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_leaks_equal_brute_force(spark, docs):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    item_rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 60)))) for i in range(30)]
    item_rows += [(100, None), (101, ""), (102, "tiny item"), (103, item_rows[0][1])]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 400, 3000]))]
        if i % 3 == 0:
            item = rng.choice(item_rows[:30])[1].split()
            if i % 2:
                item[rng.randrange(len(item))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + ("," if k % 4 else "") for k, w in enumerate(item)]
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, "Tiny, item!"), (503, item_rows[3][1]), (503, item_rows[3][1]), (None, item_rows[3][1])]
    # halves of an item far apart in one long document
    a, b = item_rows[4][1].split()[:20], item_rows[4][1].split()[20:]
    rows.append((504, " ".join(a + [rng.choice(vocabulary) for _ in range(5000)] + b)))
    items = spark.createDataFrame(item_rows, "item_id bigint, text string")
    want = {}
    for d, t in rows:
        for i, q in item_rows:
            s = shingles(q)
            k = len(s & shingles(t))
            if d is not None and s and 100 * k >= 80 * len(s):
                want[d, i] = (k, len(s))
    got = dc.contaminated(docs(rows), items).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in got} == want and len(got) == len(want)
    kept = dc.drop_contaminated(docs(rows), items)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_short_items_are_never_missed(spark, docs):
    rng = random.Random(6)
    item_rows = [(i, " ".join(f"q{i}x{j}" for j in range(1 + i % 11))) for i in range(110)]
    rows, want = [], {}
    for i, q in item_rows:
        # 64 shingles in all: the document fills its size class
        words = [f"d{i}x{j}" for j in range(68 - len(q.split()))]
        at = rng.randrange(len(words))
        rows.append((i, " ".join([*words[:at], q, *words[at:]])))
        rows.append((1000 + i, " ".join(words)))
        size = max(1, len(q.split()) - 4)
        want[i, i] = (size, size)
    rows.append((2000, "a q1x0 Q1x1!"))  # an item of two words in a document of three
    want[2000, 1] = (1, 1)
    items = spark.createDataFrame(item_rows, "item_id bigint, text string")
    got = dc.contaminated(docs(rows), items).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in got} == want and len(got) == len(want)
    kept = dc.drop_contaminated(docs(rows), items)
    assert {r["doc_id"] for r in kept.collect()} == {1000 + i for i in range(110)}


def test_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert dc.contaminated(docs([]), items).count() == 0
    assert dc.contaminated(docs([(1, "a b c d e f")]), items.limit(0)).count() == 0
    assert dc.drop_contaminated(docs([(1, "x")]), items.limit(0)).count() == 1
