import random

import pytest

from riftsplit.llm import toxicity as tx


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("lo", "mi", "ta", "re") for b in ("na", "ver", "sol", "im") for c in ("", "s", "den", "to")]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(10, 80))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["gobbler", "fuzzlewit", "snarkrot" + rng.choice(["en", "us", "ia"])])
        rows.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def learned(spark, docs):
    rows, labels = corpus(600, 1)
    labels += [(3, None), (None, 1)]
    frame = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    return tx.learn_grammar(docs(rows), frame)


def test_patterns_are_the_insults(learned):
    assert {"gobbler$", "fuzzlewit$", "snarkrot"} <= set(learned.patterns)
    assert all(p.startswith(("gobb", "fuzz", "snar")) for p in learned.patterns)


def test_held_out_accuracy_and_edge_rows(docs, learned):
    rows, labels = corpus(300, 2)
    truth = dict(labels)
    extra = [(1000, None), (1001, ""), (1002, "snarkrotix " * 30_000), (1003, "Snarkrotix."), (1003, "Snarkrotix.")]
    got = {r["doc_id"]: r["score"] for r in tx.score_toxicity(docs(rows + extra), learned).collect()}
    assert sum((got[i] >= 0.7) == bool(t) for i, t in truth.items()) >= 297
    assert got[1000] == got[1001] < 0.5 and got[1002] >= 0.7 and got[1003] >= 0.7
    kept = tx.drop_toxic(docs(rows + extra), learned)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < 0.7}
    assert kept.columns == docs(rows).columns


def test_clause_states(learned):
    read = lambda t: [(s, q) for s, _, q in learned.clauses(t)]
    assert read("gobbler") == [(tx.INSULT, 0)]
    assert read("not gobbler gobbler") == [(tx.INSULT, 1), (tx.INSULT, 0)]
    assert read("he said gobbler. gobbler") == [(tx.INSULT, 2), (tx.INSULT, 0)]
    assert read("you gobbler") == [(tx.INSULT, 4)] == read("gobbler you")
    assert read("kill you") == [(tx.THREAT, 4)] and read("kill time") == []


def test_no_labels_and_empty_table(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    grammar = tx.learn_grammar(docs([(1, "text")]), none)
    assert tx.score_toxicity(docs([(1, "text")]), grammar).first()["score"] < 1e-6
    assert tx.score_toxicity(docs([]), grammar).count() == 0
