"""Toxicity by a weighted finite-state pattern grammar.

Words pass through five transducers.  The insult transducer is a weighted prefix automaton whose
patterns (whole words, and beginnings of words) and weights are learned from labelled texts; threat,
target, negation and reported-speech words are fixed small lists.  Their output symbols drive the
composed clause machine: its state is the product of a negation, a report and a target
automaton, it starts anew at every clause, and each insult or threat that it accepts carries the
state as its reading.  A text is scored by a logistic function of its matched clauses: their weight together,
and how many were matched, negated, reported, aimed at someone, or threats.  The fit draws the weights
of the readings towards ``PRIOR``, so they act where the labels do not speak of them.

Patterns are taken if the share of toxic texts among those that have them is beyond chance for as
many patterns as were tried; near copies count once.  If few labels let none pass, the list of patterns
with the most evidence is taken as far as at most half of it is expected to be chance.  The fit uses at most ``max_rows`` labelled
rows (those with the lowest hash of their id); the rest of the work covers all rows.

Defined results: a null or empty text has no clauses and the score of the intercept; rows with
one id and different labels count as toxic if one of them does; null labels are no labels; without a
positive label every score is 0; every row is scored, repeated rows alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftsplit.llm.words import least_per_row, shingle_hashes, small_batches, word_hashes
from riftsplit.plans.durable import stored

MAX_ROWS = 12_000
MAX_PATTERNS = 4_000
PREFIXES = range(4, 10)
FALSE_SHARE = 0.5  # of the patterns taken when none is beyond chance by itself
# weights without evidence: strength, insults, and of these negated, reported, aimed; threats at someone
PRIOR = (0.0, 0.0, -1.0, -1.0, 0.5, 1.0)
MEMORY = 60_000  # words whose tags a task keeps at a time

# Words that the other transducers accept.
THREATS = "kill hurt destroy murder beat burn shoot stab töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours u ur du dich dir ihr euch tu te toi vous tú ti usted ustedes vosotros".split()
NEGATIONS = "not no never nor neither nicht kein keine nie ne pas jamais nunca tampoco".split()
REPORTS = "said says say told quoted quote reported claims according sagte sagt laut dit disait selon dijo dice según".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, BOUNDARY = range(1, 7)
PLAIN = [(s, 1.0) for s in range(7)]  # one object for each tag without a weight of its own
FIXED = {w: s for s, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,\n]")
ENDS = frozenset(".!?;:,\n")


# -- transducers --------------------------------------------------------------------


class Automaton:
    """A small machine: ``moves[state][symbol]`` is the next state; a symbol that is not listed leaves it as it is."""

    def __init__(self, moves: list[dict[int, int]]):
        self.moves = moves

    def next(self, state: int, symbol: int) -> int:
        return self.moves[state].get(symbol, state)


# on after a negation until an insult or threat took it up; on after a report word; on after a target
NEGATED = Automaton([{NEGATION: 1}, {INSULT: 0, THREAT: 0}])
REPORTED = Automaton([{REPORT: 1}, {}])
AIMED = Automaton([{TARGET: 1}, {}])


def compose(*machines: Automaton) -> tuple[dict[tuple[int, int], int], int]:
    """Product machine: ((state, symbol) -> state, number of states); a state packs one bit per machine."""
    table = {}
    for state in range(1 << len(machines)):
        for symbol in range(1, BOUNDARY):
            parts = [m.next((state >> i) & 1, symbol) for i, m in enumerate(machines)]
            table[state, symbol] = sum(p << i for i, p in enumerate(parts))
    return table, 1 << len(machines)


CLAUSE, _ = compose(NEGATED, REPORTED, AIMED)


@dataclass
class Grammar:
    """Weights of insult patterns (``word$`` or ``prefix``) and of the clause features."""

    patterns: dict[str, float] = field(default_factory=dict)
    intercept: float = -20.0
    weights: tuple[float, ...] = (0.0,) * 6
    tags: dict[str, tuple[int, float]] = field(default_factory=dict)

    def tag(self, word: str) -> tuple[int, float]:
        """Symbol and weight of a word (0: none), by the longest way through the prefix automaton that weighs most."""
        weight = self.patterns.get(word + "$", 0.0)
        for k in PREFIXES:
            if k <= len(word):
                weight = max(weight, self.patterns.get(word[:k], 0.0))
        return (INSULT, weight) if weight > 0 else PLAIN[FIXED.get(word, BOUNDARY if word in ENDS else 0)]

    def clauses(self, text: str) -> list[tuple[int, float, int]]:
        """(symbol, weight, state) of every insult and threat that the composed machine accepts."""
        tokens = TOKEN.findall(text.lower())
        known = self.tags
        if len(known) > MEMORY:
            known.clear()
        tagged = []
        for i, t in enumerate(tokens):
            found = known.get(t)
            if found is None:
                found = known[t] = self.tag(t)
            if found[0]:
                tagged.append((i, found))
        if not any(s in (INSULT, THREAT) for _, (s, _) in tagged):
            return []
        out, state = [], 0
        start = 0  # of the clause in ``out``
        for _, (symbol, weight) in [*tagged, (0, (BOUNDARY, 0.0))]:
            if symbol == BOUNDARY:
                # a target named after the insult aims it as well
                aimed = state & 4
                out[start:] = [(s, w, q | aimed) for s, w, q in out[start:] if s == INSULT or aimed]
                state, start = 0, len(out)
                continue
            if symbol in (INSULT, THREAT):
                out.append((symbol, weight, state))
            state = CLAUSE[state, symbol]
        return out

    def features(self, text: str | None) -> list[float]:
        found = self.clauses(text or "")
        insults = [f for f in found if f[0] == INSULT]
        count = lambda rows: math.log1p(len(rows))
        return [
            math.log1p(sum(w for _, w, _ in insults)),
            count(insults),
            count([f for f in insults if f[2] & 1]),
            count([f for f in insults if f[2] & 2]),
            count([f for f in insults if f[2] & 4]),
            count([f for f in found if f[0] == THREAT]),
        ]

    def score(self, text: str | None) -> float:
        z = self.intercept + sum(w * x for w, x in zip(self.weights, self.features(text), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


# -- learning -----------------------------------------------------------------------


def word_patterns(text: str) -> set[str]:
    words = {w for w in TOKEN.findall(text.lower()) if len(w) > 2}
    found = {w + "$" for w in words}
    for k in PREFIXES:
        found.update(w[:k] for w in words if len(w) >= k)
    return found


def _pattern_rows():
    """(text, toxic) to (pattern, toxic, copy, n): texts with the pattern; of toxic ones, for each group of near copies."""
    schema = pa.schema([("pattern", pa.string()), ("toxic", pa.int32()), ("copy", pa.int64()), ("n", pa.int64())])

    def rows(batches):
        for batch in small_batches(batches, "text"):
            least = least_per_row(*shingle_hashes(*word_hashes(batch.column("text")), 5), 0).view(np.int64)
            counts: Counter = Counter()
            for text, toxic, copy in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), least.tolist(), strict=True):
                counts.update((p, toxic, copy if toxic else 0) for p in word_patterns(text or ""))
            if counts:
                pattern, toxic, copy = zip(*counts, strict=True)
                columns = [pa.array(pattern), pa.array(toxic, pa.int32()), pa.array(copy, pa.int64()), pa.array(list(counts.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows


def learn_patterns(train: DataFrame, max_patterns: int = MAX_PATTERNS) -> dict[str, float]:
    """Log-odds of the patterns whose toxic share is beyond chance; ``train`` is (text, toxic) of bounded size."""
    totals = train.agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    pos, n = int(totals["pos"] or 0), int(totals["n"])
    if not 0 < pos < n:
        return {}
    base = pos / n
    rows = train.mapInArrow(_pattern_rows(), "pattern string, toxic int, copy bigint, n bigint")
    once = rows.groupBy("pattern", "toxic", "copy").agg(F.sum("n").alias("n"))
    counts = stored(
        once.groupBy("pattern").agg(F.count_if(F.col("toxic") == 1).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q"))
    )
    tried = counts.count()
    share = F.col("p") / (F.col("p") + F.col("q"))
    rest = F.when(F.col("q") > 0, F.col("q") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    evidence = F.col("p") * F.log(share / base) + rest
    odds = F.log((F.col("p") + 0.5) / (pos + 1.0)) - F.log((F.col("q") + 0.5) / (n - pos + 1.0))
    often = counts.filter("p >= 3").filter(share > 0.5).select("pattern", odds.alias("odds"), evidence.alias("evidence"))
    best = often.filter(F.col("evidence") > math.log(tried) + 3.0).orderBy(F.desc("odds"), "pattern").limit(max_patterns).collect()
    if not best:
        repeated = counts.filter("p + q >= 3").count()
        top = often.orderBy(F.desc("evidence"), "pattern").limit(max_patterns).collect()
        chance = [repeated * math.exp(-r["evidence"]) <= FALSE_SHARE * sum(o["evidence"] >= r["evidence"] for o in top) for r in top]
        best = top[: max((i + 1 for i, fine in enumerate(chance) if fine), default=0)]
    return {r["pattern"]: float(r["odds"]) for r in best}


def logistic_fit(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...] | None = None, penalty: float = 0.1, rounds: int = 50) -> tuple[float, np.ndarray]:
    """Intercept and weights by Newton steps, the weights drawn towards ``prior`` (0)."""
    z = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([1e-6] + [penalty] * x.shape[1])
    before = np.array([0.0, *(prior or [0.0] * x.shape[1])])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge
        step = np.linalg.solve(h, z.T @ (y - p) - ridge @ (w - before))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), w[1:]


def learn_grammar(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", max_rows: int = MAX_ROWS) -> Grammar:
    """Fit on the labelled rows, at most ``max_rows`` of them."""
    known = labels.filter(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    sample = known.orderBy(F.xxhash64(F.col("_id")), "_id").limit(max_rows)
    # at most max_rows rows of two numbers
    texts = documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    joined = texts.join(F.broadcast(sample), "_id")
    train = stored(joined.groupBy("_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))
    grammar = Grammar(learn_patterns(train))
    if not grammar.patterns:
        return Grammar()
    collected = train.mapInArrow(_feature_rows(grammar), "x array<double>, y int").collect()  # max_rows rows of six numbers
    x, y = np.array([r["x"] for r in collected]), np.array([r["y"] for r in collected], dtype=float)
    intercept, weights = logistic_fit(x, y, PRIOR)
    return Grammar(grammar.patterns, intercept, tuple(weights.tolist()))


def _feature_rows(grammar: Grammar):
    schema = pa.schema([("x", pa.list_(pa.float64())), ("y", pa.int32())])

    def rows(batches):
        for batch in small_batches(batches, "text"):
            x = [grammar.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], schema=schema)

    return rows


# -- scoring ------------------------------------------------------------------------


def score_toxicity(documents: DataFrame, grammar: Grammar, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def score(batches):
        for batch in small_batches(batches, "text"):
            scores = [grammar.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], schema=schema)

    rows = documents.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(score, "id bigint, score double").withColumnRenamed("id", doc_id)


def drop_toxic(documents: DataFrame, grammar: Grammar, doc_id: str = "doc_id", text: str = "text", limit: float = 0.7) -> DataFrame:
    """The rows that score below ``limit``, with all their columns."""
    schema = documents.schema

    def keep(batches):
        for batch in small_batches(batches, text):
            good = [grammar.score(t) < limit for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return documents.mapInArrow(keep, schema)
