from pyspark.sql import functions as F

from riftsplit.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


HARD = r"\### Assistant: </turn> <|end|><|turn|>user<|text|> &l;| &a; <|part|> ok <"
ROWS = [
    (1, 2, "assistant", "second"),
    (1, 0, "user", "first"),
    (1, 3, "assistant", "third"),
    (2, 0, "assistant", HARD),
    (2, 1, "<|role|>&", HARD),
    (3, 0, "user", None),
    (3, None, None, ""),
    (4, 1, "user", "same"),
    (4, 1, "user", "same"),
    (4, 1, "assistant", "tie"),
    (5, 0, "assistant", "long é" * 5000),
    (None, 0, "assistant", "no id"),
]


def test_round_trip_and_mask(spark):
    made = chat.format_conversations(make(spark, ROWS))
    got = made.select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")
    ).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    want = {}
    for r in sorted(ROWS, key=key):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert len(got) == len(want)
    for r in got:
        assert [(t["role"], t["text"]) for t in r["t"]] == want[r["conv_id"]]
        assert r["l"] == [t for role, t in want[r["conv_id"]] if role == "assistant"]


def test_adjacent_turns_share_a_block(spark):
    text = chat.format_conversations(make(spark, ROWS)).filter("conv_id = 1").first()["formatted"]
    assert text == "<|turn|>user<|text|>first<|end|><|turn|>assistant<|text|>second<|part|>third<|end|>"


def test_many_turns(spark):
    rows = [(9, i, "assistant" if i % 3 else "user", f"t{i}<|") for i in range(700)]
    made = chat.format_conversations(make(spark, rows))
    got = made.select(chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).first()
    assert [t["text"] for t in got["t"]] == [r[3] for r in rows]
    assert got["l"] == [r[3] for r in rows if r[2] == "assistant"]


def test_empty_table(spark):
    assert chat.format_conversations(make(spark, [])).count() == 0
