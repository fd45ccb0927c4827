"""Repair of conversations by a Viterbi search that runs in parallel chunks (rank convergence).

A repaired conversation is an optional system turn and then pairs of a user and an assistant turn.  Edits of
a turn are Keep (0), Rerole to user or assistant (2), Delete (3, required for blank turns and repeats) and, anywhere,
Insert of an empty user or assistant turn (2); a truncated turn that is not deleted costs 1 more.  The edits of
least cost are searched; among equals the audit (initials in order) that is first in ASCII is taken.

Turns are range-partitioned by (conversation, turn, role, digest), so a conversation of any size spans many
tasks.  Each task cuts its stretch into chunks and runs backward costs over every chunk, from a guess: the cost vector of the
conversation's end.  Then passes compare each chunk's end with the vector that the next chunk found at its
start: where they differ by more than a constant, the chunk runs again from its end until its vectors
differ from the old ones by a constant only, from where on nothing changes.  Passes repeat until no chunk runs.
The constants add up to the cost.  The audit is traced forward with the stitched costs; states at chunk borders come
from folding what each chunk makes of each of the four states.  Conversations that lie within one task's stretch and one chunk
are finished there and never shuffled again.

Equal rows are counted before anything is shuffled by order, and repeats of one text are found on digests
with sums on the map side, so neither a hot conversation nor a hot turn is gathered.  The digest of a repaired text is
one value over the conversation in order; its pieces stream through one task, a piece at a time.

Defined results: null roles and texts are one space; null conversations are one conversation; null turns
come first, ties are ordered by (role, md5 of the text); an empty text is blank; a conversation of which
only rows counted 0 times exist gets zeros, no audit and no turns; an empty table gives no rows.  A role counts by its
initial.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftsplit.plans.durable import durable, join_bounded, stored

CHUNK_ROWS = 4096
CHUNK_CHARS = 1 << 20

# states: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FORCED = (2, 2, 3, 2)  # state after a user or assistant turn that fits
ROLE = {2: "user", 3: "assistant"}
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
CODES = {"s": 1, "u": 2, "a": 3}
INITIALS = {v: k for k, v in CODES.items()}
CUT, GONE = 4, 8  # flags of a row's class: truncated; must be deleted
SPACE = " \t\n\x0b\x0c\r"
REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


# -- the search, on vectors of four costs whose least is 0 ------------------------------


def _closed(w: list[int]) -> list[int]:
    """Costs when turns may be inserted first."""
    user, assistant = min(w[2], INSERT + w[3]), min(w[3], INSERT + w[2])
    return [min(w[0], INSERT + user), min(w[1], INSERT + user), user, assistant]


END = tuple(_closed([0, 1 << 20, 1 << 20, 0]))


@lru_cache(maxsize=1 << 16)
def step(kind: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """(vector before a row, constant) from the vector after it."""
    if kind & GONE:
        return after, DELETE
    more = TRUNCATED if kind & CUT else 0
    keep = KEEP.get(INITIALS.get(kind & 3), {})
    w = []
    for q in range(4):
        ways = [DELETE + after[q], REROLE + more + after[FORCED[q]]]
        if q in keep:
            ways.append(more + after[keep[q]])
        w.append(min(ways))
    w = _closed(w)
    least = min(w)
    return tuple(x - least for x in w), least


@lru_cache(maxsize=1 << 16)
def move(kind: int, after: tuple[int, ...], q: int) -> tuple[str, int]:
    """(edits, state after the row): the edits first in ASCII among the cheapest from state ``q``."""
    before, constant = step(kind, after)
    more = TRUNCATED if kind & CUT else 0
    keep = KEEP.get(INITIALS.get(kind & 3), {})
    edits = ""
    while True:
        cost = before[q] + constant
        if DELETE + after[q] == cost:
            return edits + "D", q
        if INSERT + before[FORCED[q]] + constant == cost:
            edits, q = edits + "I", FORCED[q]
        elif q in keep and more + after[keep[q]] == cost:
            return edits + "K", keep[q]
        else:
            return edits + "R", FORCED[q]


class Chunk:
    """Turns of one conversation in order: classes, counts of equal rows, and backward vectors."""

    def __init__(self, kinds: bytes, times: list[int], vectors: list[tuple[int, ...]] | None = None):
        self.kinds, self.times, self.vectors = kinds, times, vectors or []

    def run(self, end: tuple[int, ...]) -> int:
        """Backward costs from ``end``; stops where they are as before.  Returns how many rows were run."""
        known, old = bool(self.vectors), self.vectors
        if not known:
            self.vectors = old = [END] * (len(self.kinds) + 1)
        old[-1] = end
        for i in range(len(self.kinds) - 1, -1, -1):
            before, _ = step(self.kinds[i], old[i + 1])
            if known and before == old[i]:
                return len(self.kinds) - i
            old[i] = before
        return len(self.kinds)

    def constant(self) -> int:
        """What the costs at the start have beyond their vector."""
        once = sum(step(k, v)[1] for k, v in zip(self.kinds, self.vectors[1:], strict=True))
        return once + DELETE * sum(max(0, n - 1) for n in self.times)

    def exits(self) -> bytes:
        """State after the chunk for each state before it."""
        out = []
        for q in range(4):
            for kind, after in zip(self.kinds, self.vectors[1:], strict=True):
                q = move(kind, after, q)[1]
            out.append(q)
        return bytes(out)

    def trace(self, q: int, roles: list[str], texts: list[str], last: bool) -> tuple[str, list[dict]]:
        """(audit, repaired turns) from state ``q``; ``last`` ends the conversation."""
        audit, turns = [], []
        for kind, n, after, role, text in zip(self.kinds, self.times, self.vectors[1:], roles, texts, strict=True):
            edits, ends = move(kind, after, q)
            for edit in edits:
                if edit == "I":
                    q = FORCED[q]
                    turns.append({"role": ROLE[q], "text": ""})
                elif edit != "D":
                    turns.append({"role": role if edit == "K" else ROLE[ends], "text": text})
            q = ends
            audit.append(edits + "D" * (n - 1))
        while last and q in (1, 2):
            q = FORCED[q]
            audit.append("I")
            turns.append({"role": ROLE[q], "text": ""})
        return "".join(audit), turns

    def packed(self) -> bytes:
        return bytes(x for v in self.vectors for x in v)

    @staticmethod
    def unpacked(data: bytes) -> list[tuple[int, ...]]:
        return [tuple(data[i : i + 4]) for i in range(0, len(data), 4)]


# -- stretches of sorted rows ----------------------------------------------------------

TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
SUMS = [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
CHUNK_SCHEMA = pa.schema(
    [("conv", pa.int64()), ("ord", pa.int64()), ("whole", pa.bool_()), *SUMS, ("audit", pa.string()), ("turns", TURNS)]
    + [("kinds", pa.binary()), ("times", pa.list_(pa.int64())), ("vectors", pa.binary()), ("end", pa.binary())]
    + [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("first", pa.string()), ("final", pa.string())]
    + [(c, pa.int64()) for c in ("low_turn", "high_turn", "n_turns")]
)
CHUNK_DDL = (
    "conv bigint, ord bigint, whole boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, turns array<struct<role:string,text:string>>, kinds binary, times array<bigint>, vectors binary, end binary, "
    "roles array<string>, texts array<string>, first string, final string, low_turn bigint, high_turn bigint, n_turns bigint"
)


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _chunk_row(conv, number: int, rows: list[tuple]) -> dict:
    """A chunk's row from (turn, role, text, n, repeat)."""
    kinds, out = bytearray(), {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    before, turns = None, [r[0] for r in rows if r[0] is not None]
    for _, role, text, n, repeat in rows:
        bare = text.rstrip(SPACE)
        kind = CODES.get(role[:1], 0)
        if not bare:
            kind |= GONE
            out["blank"] += n
        else:
            out["duplicate"] += n if repeat else n - 1
            if repeat:
                kind |= GONE
            elif bare[-1] not in ".!?":
                kind |= CUT
                out["truncated"] += 1
        kinds.append(kind)
        out["illegal"] += n - 1 + (before is not None and not _legal(before, role[:1]))
        before = role[:1]
    chunk = Chunk(bytes(kinds), [r[3] for r in rows])
    chunk.run(END)
    out |= {"conv": conv, "ord": number, "kinds": chunk.kinds, "times": chunk.times, "vectors": chunk.packed(), "end": bytes(END)}
    out |= {"roles": [r[1] for r in rows], "texts": [r[2] for r in rows], "first": rows[0][1][:1] if rows else None, "final": before}
    return out | {"low_turn": min(turns, default=None), "high_turn": max(turns, default=None), "n_turns": len(set(turns))}


def _finish(row: dict) -> dict:
    """A conversation that is one chunk: all results, none of the parts."""
    chunk = Chunk(row["kinds"], row["times"], Chunk.unpacked(row["vectors"]))
    audit, turns = chunk.trace(0, row["roles"], row["texts"], True)
    gaps = row["high_turn"] - row["low_turn"] + 1 - row["n_turns"] if row["n_turns"] else 0
    done = {c: row[c] for c in ("conv", "ord", "blank", "duplicate", "truncated", "illegal")}
    return done | {"whole": True, "gaps": gaps, "cost": chunk.vectors[0][0] + chunk.constant(), "audit": audit, "turns": turns}


def _cutter(chunk_rows: int):
    """Sorted rows (piece, conv, turn, role, text, n, repeat) to chunks; conversations inside the stretch are finished."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[dict] = []
        conv, rows, chars = None, [], 0  # the conversation that is read
        parts, number, seen = 0, 0, 0  # its chunks so far; all chunks; conversations

        def close(inside: bool) -> None:
            nonlocal rows, chars, parts, number
            if rows or not parts:
                made = _chunk_row(conv, number, rows)
                ready.append(_finish(made) if inside and not parts else made | {"whole": False})
                parts, number = parts + 1, number + 1
            rows, chars = [], 0

        size = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("piece", "conv", "turn", "role", "text", "n", "repeat")]
            for piece, name, *row in zip(*columns, strict=True):
                if not seen:
                    conv, seen, number = name, 1, piece << 32
                elif name != conv:
                    close(seen > 1)
                    conv, seen, parts = name, seen + 1, 0
                if row[3]:
                    rows.append(tuple(row))
                    chars += len(row[2])
                    size += len(row[2])
                if len(rows) >= chunk_rows or chars >= CHUNK_CHARS:
                    close(False)
                if size >= CHUNK_CHARS:
                    yield pa.RecordBatch.from_pylist(ready, schema=CHUNK_SCHEMA)
                    ready, size = [], 0
        if seen:
            close(False)
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=CHUNK_SCHEMA)

    return work


# -- stitching chunks of long conversations ------------------------------------------------


def _rerun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the vector ``wish`` found by their neighbour: run again from it, as far as something changes."""
    for batch in batches:
        rows = batch.to_pylist()
        out = []
        for r in rows:
            chunk = Chunk(r["kinds"], [], Chunk.unpacked(r["vectors"]))
            chunk.run(tuple(r["wish"]))
            out.append({"conv": r["conv"], "ord": r["ord"], "vectors": chunk.packed(), "end": r["wish"]})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([CHUNK_SCHEMA.field(c) for c in ("conv", "ord", "vectors", "end")]))


def stitched(chunks: DataFrame) -> tuple[DataFrame, int]:
    """((conv, ord, vectors, end), passes): fix-up passes until each chunk ends with the vector its successor starts with."""
    state, passes = stored(chunks.select("conv", "ord", "vectors", "end")), 0
    kinds = chunks.select("ord", "kinds")
    while True:
        after = F.lead(F.substring("vectors", 1, 4)).over(Window.partitionBy("conv").orderBy("ord"))
        wish = state.select("conv", "ord", F.substring("vectors", 1, 4).alias("vectors"), "end").withColumn("wish", F.coalesce(after, F.lit(bytes(END))))
        wrong = stored(wish.filter("wish <> end").select("ord", "wish"))
        if wrong.isEmpty():
            return state, passes
        passes += 1
        again = state.drop("end").join(wrong, "ord").join(kinds, "ord")
        mended = again.select("conv", "ord", "vectors", "kinds", "wish").mapInArrow(_rerun, "conv bigint, ord bigint, vectors binary, end binary")
        state = stored(state.join(wrong.select("ord"), "ord", "left_anti").select("conv", "ord", "vectors", "end").unionByName(mended))


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: exit states, constant, and the cost vector at its start."""
    schema = pa.schema([("ord", pa.int64()), ("exits", pa.binary()), ("constant", pa.int64()), ("start", pa.int64())])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            chunk = Chunk(r["kinds"], r["times"], Chunk.unpacked(r["vectors"]))
            out.append({"ord": r["ord"], "exits": chunk.exits(), "constant": chunk.constant(), "start": chunk.vectors[0][0]})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries sorted by (conv, ord): the state before each chunk, and the sums of a conversation on its last chunk."""
    schema = pa.schema([("ord", pa.int64()), ("state", pa.int32()), ("last", pa.bool_()), *SUMS])
    counts = ("blank", "duplicate", "truncated", "illegal")
    before, q, total, role, low, high, n_turns = None, 0, {}, None, None, None, 0

    def ended(row: dict) -> dict:
        gaps = high - low + 1 - n_turns if n_turns else 0
        return row | total | {"last": True, "gaps": gaps}

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if before is not None and before["conv"] == r["conv"]:
                out.append({"ord": before["ord"], "state": before["state"], "last": False})
            else:
                if before is not None:
                    out.append(ended({"ord": before["ord"], "state": before["state"]}))
                q, role, low, high, n_turns = 0, None, None, None, 0
                total = dict.fromkeys(counts, 0) | {"cost": r["start"]}
            for c in counts:
                total[c] += r[c]
            total["cost"] += r["constant"]
            if r["first"] is not None:
                total["illegal"] += role is not None and not _legal(role, r["first"])
                role = r["final"]
            if r["n_turns"]:
                n_turns += r["n_turns"] - (high == r["low_turn"])  # turns rise along the chunks
                low, high = r["low_turn"] if low is None else low, r["high_turn"]
            before = {"conv": r["conv"], "ord": r["ord"], "state": q}
            q = r["exits"][q]
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if before is not None:
        yield pa.RecordBatch.from_pylist([ended({"ord": before["ord"], "state": before["state"]})], schema=schema)


def _tracer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their state to audits and repaired turns."""
    for batch in batches:
        for r in batch.to_pylist():
            chunk = Chunk(r["kinds"], r["times"], Chunk.unpacked(r["vectors"]))
            audit, turns = chunk.trace(r["state"], r["roles"], r["texts"], r["last"])
            row = {c: r[c] for c in ("conv", "ord", *REPORT)} | {"whole": False, "audit": audit, "turns": turns}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([CHUNK_SCHEMA.field(c) for c in PIECE]))


PIECE = ["conv", "ord", "whole", *REPORT, "audit", "turns"]
PIECE_DDL = CHUNK_DDL.split(", kinds")[0]


# -- the operator ----------------------------------------------------------------------


def repair(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    times: Column | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Pieces of repaired conversations: (conv, ord, whole, gaps, blank, ..., cost, audit, turns).

    A ``whole`` piece is a conversation.  The pieces of the others follow each other by ``ord``; their last one carries the
    counts.  ``times`` says how often a row stands there (once; 0 names its conversation only).
    """
    spark = df.sparkSession
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"), text_of(role).alias("role"), text_of(text).alias("text"),
        (F.lit(1) if times is None else times).cast("bigint").alias("n"),
    )
    none = F.col("n") == 0
    for name, blank in (("turn", F.lit(None).cast("bigint")), ("role", F.lit("")), ("text", F.lit(""))):
        rows = rows.withColumn(name, F.when(none, blank).otherwise(F.col(name)))
    known = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit("-")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text")
    distinct = stored(rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("known", F.md5(known)))
    groups = distinct.filter("n > 0").groupBy("known").agg(
        F.count(F.lit(1)).alias("c"), F.min("turn").alias("first_turn"), F.bool_or(F.col("turn").isNull()).alias("first_null")
    )
    marked = join_bounded(distinct, groups.filter("c > 1").drop("c"), ["known"])
    later = F.col("turn").isNotNull() & (F.col("first_null") | (F.col("turn") > F.col("first_turn")))
    marked = marked.select("conv", "turn", "role", "text", "n", F.coalesce(later, F.lit(False)).alias("repeat"), F.md5("text").alias("digest"))
    order = ["conv", "turn", "role", "digest"]
    pieces = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = durable(stored(marked).repartitionByRange(pieces, *order).sortWithinPartitions(*order))
    stretch = sorted_rows.select(F.spark_partition_id().cast("bigint").alias("piece"), "conv", "turn", "role", "text", "n", "repeat")
    cut = stored(stretch.mapInArrow(_cutter(chunk_rows), CHUNK_DDL))
    done, chunks = cut.filter("whole").select(*PIECE), cut.filter("NOT whole")
    state, _ = stitched(chunks)
    vectors = state.select("ord", "vectors")
    told = chunks.select("ord", "kinds", "times").join(vectors, "ord").mapInArrow(_summary, "ord bigint, exits binary, constant bigint, start bigint")
    slim = chunks.select("conv", "ord", "blank", "duplicate", "truncated", "illegal", "first", "final", "low_turn", "high_turn", "n_turns")
    folded = slim.join(told, "ord").repartition("conv").sortWithinPartitions("conv", "ord")
    sums = ", ".join(f"{c} bigint" for c in REPORT)
    states = stored(folded.mapInArrow(_fold, f"ord bigint, state int, last boolean, {sums}"))
    parts = chunks.select("conv", "ord", "kinds", "times", "roles", "texts").join(vectors, "ord").join(states, "ord")
    return done.unionByName(parts.mapInArrow(_tracer, PIECE_DDL))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (conv, ord) to one row per conversation; texts are hashed as they pass."""
    schema = pa.schema([("conv", pa.int64()), *SUMS, ("audit", pa.string()), ("repaired_sha256", pa.string())])
    before, sums, audit, hasher, any_turn = None, {}, [], None, False

    def made() -> pa.RecordBatch:
        row = {"conv": before[0], "audit": "".join(audit), "repaired_sha256": hasher.hexdigest()} | sums
        return pa.RecordBatch.from_pylist([row], schema=schema)

    for batch in batches:
        for r in batch.to_pylist():
            if before is None or before[0] != r["conv"]:
                if before is not None:
                    yield made()
                before, audit, hasher, any_turn = (r["conv"],), [], hashlib.sha256(), False
            audit.append(r["audit"])
            for t in r["turns"]:
                hasher.update((("\n" if any_turn else "") + t["role"] + ":" + t["text"]).encode())
                any_turn = True
            sums = {c: r[c] for c in REPORT}
    if before is not None:
        yield made()


def digests(pieces: DataFrame) -> DataFrame:
    """(conv, gaps, blank, ..., cost, audit, repaired_sha256): one row per conversation; only pieces are brought together."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = pieces.filter("whole").select("conv", *REPORT, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    parts = pieces.filter("NOT whole").select("conv", "ord", *REPORT, "audit", "turns")
    schema = ", ".join(["conv bigint", *[f"{c} bigint" for c in REPORT], "audit string", "repaired_sha256 string"])
    return whole.unionByName(parts.repartition("conv").sortWithinPartitions("conv", "ord").mapInArrow(_digest, schema))


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, times): faults set by crc32(conv:turn) % 20, for measuring the repair."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said(conv), F.lit(":"), said(turn))) % 20
    mended = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(said(text), "[.!?]", "")).otherwise(said(text))
    return df.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.when(fault == 4, "user").otherwise(said(role)).alias("role"), mended.alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"),
    )
