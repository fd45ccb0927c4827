"""Chat formatting in Spark expressions only: turns in, one marked-up text and its loss mask out.

Template of a block (adjacent turns of one role):
``<|turn|>role<|text|>text<|part|>text ...<|end|>``.  Inside roles and texts ``&`` becomes
``&a;`` and ``<|`` becomes ``&l;|``, so no marker can occur there and the text can be
restored exactly.  The loss mask covers the texts of one role, never a marker.

Defined results: null texts and roles are empty; turns are ordered by (turn, role, text) with
null turns first, so ties and repeated rows have one order and all stay; an empty table gives
no rows.  One conversation is one output value, so its turns meet in one row by contract; rows
are reduced to the needed columns before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftsplit.llm.arrays import cut, let, running_sum

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&a;")), F.lit("<|"), F.lit("&l;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&l;"), F.lit("<")), F.lit("&a;"), F.lit("&"))


def _literal(marker: str) -> str:
    return marker.replace("|", r"\|")


def format_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant"
) -> DataFrame:
    """(conv, formatted, loss_spans): the template text and the spans (start, end) of the texts said by ``learn``."""
    said = F.struct(
        F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    turns = df.select(F.col(conv), said.alias("said")).groupBy(conv).agg(F.sort_array(F.collect_list("said")).alias("turns"))
    # first turn of each run of one role
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    runs = turns.withColumn("starts", starts)
    merged = F.transform(
        F.col("starts"),
        lambda s, k: F.struct(
            F.get("turns", s)["role"].alias("role"),
            F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s).alias("turns"),
        ),
    )

    def piece(value: Column, loss) -> Column:
        return F.struct(value.alias("text"), (loss if isinstance(loss, Column) else F.lit(loss)).alias("loss"))

    def block(b: Column) -> Column:
        said = F.transform(
            b["turns"],
            lambda t, i: F.array(
                piece(F.when(i > 0, F.lit(PART)).otherwise(F.lit("")), False), piece(escape(t["text"]), b["role"] == learn)
            ),
        )
        head = F.array(piece(F.concat(F.lit(TURN), escape(b["role"]), F.lit(TEXT)), False))
        return F.concat(head, F.flatten(said), F.array(piece(F.lit(END), False)))

    pieces = runs.select(conv, F.flatten(F.transform(merged, block)).alias("pieces"))
    ends = pieces.withColumn("ends", running_sum(F.transform("pieces", lambda p: F.length(p["text"]).cast("bigint"))))
    spans = F.transform(
        F.filter(F.arrays_zip("pieces", "ends"), lambda z: z["pieces"]["loss"]),
        lambda z: F.struct((z["ends"] - F.length(z["pieces"]["text"])).alias("start"), z["ends"].alias("end")),
    )
    return ends.select(conv, F.array_join(F.col("pieces.text"), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array of (role, text): the turns of a formatted conversation, each as it came in."""
    blocks = F.filter(F.split(formatted, _literal(END), -1), lambda b: b.startswith(TURN))

    def turns(head: Column) -> Column:
        texts = F.split(F.get(head, 1), _literal(PART), -1)
        return F.transform(texts, lambda t: F.struct(unescape(F.get(head, 0)).alias("role"), unescape(t).alias("text")))

    heads = F.transform(blocks, lambda b: F.split(F.substring(b, len(TURN) + 1, F.length(b)), _literal(TEXT), 2))
    return F.flatten(F.transform(heads, turns))


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, restored."""
    return F.transform(cut(formatted, loss_spans), unescape)
