import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from riftsplit.llm import conversation_repair as cr
from riftsplit.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost int, conv string, ord int"
SPACE = " \t\n\x0b\x0c\r"


def brute_repair(turns):
    """Counts, cost, audit and repaired lines of [(turn, role, text)], by search over (row, state)."""
    numbers = [t for t, _, _ in turns if t is not None]
    out = {"gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0}
    faults, seen = [], set()
    for _, role, text in turns:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    for f in ("blank", "duplicate", "truncated"):
        out[f] = faults.count(f)
    out["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    states = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(maxsize=None)
    def best(i, state, added):
        """Least (cost, audit, lines) from row i; ``added`` bounds insertions in a row."""
        ways = []
        if i == len(turns):
            if state in ("", "a"):
                ways.append((0, "", ()))
        else:
            _, role, text = turns[i]
            c, a, rest = best(i + 1, state, 0)
            ways.append((c + 3, "D" + a, rest))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if role[:1] in states[state]:
                    c, a, rest = best(i + 1, role[:1], 0)
                    ways.append((c + more, "K" + a, (f"{role}:{text}", *rest)))
                for new in ("user", "assistant"):
                    if new[0] in states[state]:
                        c, a, rest = best(i + 1, new[0], 0)
                        ways.append((c + 2 + more, "R" + a, (f"{new}:{text}", *rest)))
        for new in ("user", "assistant"):
            if added < 3 and new[0] in states[state]:
                c, a, rest = best(i, new[0], added + 1)
                ways.append((c + 2, "I" + a, (f"{new}:", *rest)))
        return min(ways, default=(10**9, "~", ()))

    out["cost"], out["audit"], lines = best(0, "", 0)
    return out | {"sha": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def brute_damage(rows):
    """conv -> [(turn, role, text)] in order."""
    out = {}
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        k, role, text = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20, said(role), said(text)
        mine = out.setdefault(conv, [])
        if k:
            row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            mine.extend([row] * (2 if k == 3 else 1))
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], md5(r[2]))) for c, v in out.items()}


def check(found, want):
    got = {r["conv"]: r for r in found.collect()}
    assert set(got) == set(want) and found.count() == len(want)
    for conv, turns in want.items():
        expected = brute_repair(turns)
        row = got[conv]
        assert {c: row[c] for c in (*cr.REPORT, "audit")} | {"sha": row["repaired_sha256"]} == expected, (conv, turns)


def talk(n_conv, seed, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(n_conv):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "u", ""])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn // 2]), role, rng.choice(["Hi.", "Hi.", "No?", "yes", " ", "", "ok!\n", "a. b"])))
    return rows


@pytest.mark.parametrize("chunk_rows", [1, 3, 4096])
def test_equals_brute_force(spark, chunk_rows):
    rows = talk(60, chunk_rows, 9) + [(None, 1, "user", "Hm."), (None, 2, None, None), (77, None, None, None)]
    rows += rows[:20]  # repeated rows
    df = spark.createDataFrame([(*r, -1, "x", -1) for r in rows], SCHEMA)
    want = {}
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else x
        want.setdefault(conv, []).append((turn, said(role), said(text)))
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    want = {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], md5(r[2]))) for c, v in want.items()}
    check(cr.digests(cr.repair(df, chunk_rows=chunk_rows)), want)


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), f"{t}{rng.choice('.!?x')}") for t in range(220)]
    rows += [(2, 0, "user", "Why?"), (2, 1, "assistant", "So.")]
    df = spark.createDataFrame([(*r, -1, "x", -1) for r in rows], SCHEMA)
    pieces = cr.repair(df, chunk_rows=16)
    assert pieces.filter("conv = 1").count() >= 14
    want = {1: [r[1:] for r in rows if r[0] == 1], 2: [(0, "user", "Why?"), (1, "assistant", "So.")]}
    check(cr.digests(pieces), want)
    kept = [t for r in pieces.filter("conv = 1").orderBy("ord").collect() for t in r["turns"]]
    assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in kept))


def test_fix_up_passes_stop_where_vectors_agree():
    kinds = bytes([2, 3] * 50)
    chunk = cr.Chunk(kinds, [1] * 100)
    assert chunk.run(cr.END) == 100
    assert chunk.run(cr.step(2, cr.END)[0]) < 100  # another end is forgotten on the way
    fresh = cr.Chunk(kinds, [1] * 100)
    fresh.run(cr.step(2, cr.END)[0])
    assert fresh.vectors == chunk.vectors


def test_query_equals_damage_and_brute_repair(spark, sf_dir):
    got = QUERIES["op12_conversation_repair"](spark, sf_dir)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(got.withColumnRenamed("conv_id", "conv"), brute_damage(rows))


def test_empty_table_and_all_rows_dropped(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cr.digests(cr.repair(none)).collect() == []
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, turn, "user", "Hi.", 0, "x", 0)], SCHEMA)
    row = cr.digests(cr.repair(cr.damaged(df), times=cr.F.col("times"))).first()
    assert [row[c] for c in cr.REPORT] == [0] * 6 and row["audit"] == "" and row["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
