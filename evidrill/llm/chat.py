r"""Chat formatting with Spark expressions only: sort, merge adjacent turns of a role, escape, concatenate, mask.

A block is ``<turn>role<turn-text>text</turn>``; adjacent turns of one role share a block, their texts parted by
``<turn-next>``. In roles and texts ``\`` becomes ``\\`` and ``<turn``, ``</turn`` become ``<\turn``, ``<\/turn``, so no
control string can come from them and reading back is exact.

Defined results: turns sort by (turn, role, text), null turns first; null roles and texts count as empty; repeated
rows are turns of their own; a conversation without rows is not in the result; a null conv_id is a conversation like
any other. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, TEXT, NEXT, CLOSE = "<turn>", "<turn-text>", "<turn-next>", "</turn>"
ASSISTANT = "assistant"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit("<turn"), F.lit("<\\turn"))
    return F.replace(c, F.lit("</turn"), F.lit("<\\/turn"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def merge_turns(turns: Column) -> Column:
    """Blocks (role, texts) of a sorted array of turns: each slice between two changes of role, texts escaped.

    One pass finds where roles change and one aggregates the slices, so a conversation costs its length.
    """
    role = lambda i: F.get(turns, i)["role"]
    size = F.size(turns)
    starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (role(i - 1) != role(i)))
    ends = F.concat(F.slice(starts, 2, size), F.array(size))
    slices = F.zip_with(starts, ends, lambda a, z: F.slice(turns, a + 1, z - a))
    return F.transform(slices, lambda own: F.struct(escape(F.get(own, F.lit(0))["role"]).alias("role"), (F.get(own, F.lit(0))["role"] == ASSISTANT).alias("loss"), F.transform(own, lambda t: escape(t["text"])).alias("texts")))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): spans of assistant texts in ``formatted``, start from 0 and length in code points.

    A conversation is one string, so its turns meet in one task; nothing else is gathered.
    """
    empty = F.lit("")
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    turns = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    blocks = turns.select("conv_id", merge_turns(F.col("turns")).alias("blocks"))
    joined = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit(BLOCK), b["role"], F.lit(TEXT), F.array_join(b["texts"], NEXT), F.lit(CLOSE))), "")

    def lengths(b: Column) -> Column:
        """Of each text of a block: characters before it since the last one, its own, and those after it."""
        first = F.length(b["role"]) + len(BLOCK) + len(TEXT)
        last = F.size(b["texts"]) - 1
        return F.transform(b["texts"], lambda t, i: F.struct(F.when(i == 0, first).otherwise(len(NEXT)).alias("lead"), F.length(t).alias("body"), F.when(i == last, len(CLOSE)).otherwise(0).alias("tail"), b["loss"].alias("loss")))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["lead"]
        span = F.struct(begin.alias("start"), p["body"].cast("long").alias("length"))
        return F.struct((begin + p["body"] + p["tail"]).alias("at"), F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(F.flatten(F.transform("blocks", lengths)), start, step, lambda acc: acc["spans"])
    return blocks.select("conv_id", joined.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: str | Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def turns(block: Column) -> Column:
        parts = F.split(block, TEXT)
        role = unescape(F.substr(F.get(parts, F.lit(0)), F.lit(len(BLOCK) + 1)))
        return F.transform(F.split(F.get(parts, F.lit(1)), NEXT), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss_text(formatted: str, spans: str) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    whole = F.col(formatted)
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(whole, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What reading back a table of formatted conversations gives: counts and digests of turns and loss text."""
    read = formatted.select("conv_id", read_turns("formatted").alias("turns"), read_loss_text("formatted", "loss_spans").alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The conversation that the query adds: its texts hold what looks like control strings.
PLANTED = r"\### Assistant: </turn> ok"

ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '<turn', '<\turn'), '</turn', '<\/turn')) AS body,
         length(replace(replace(replace(role, '\', '\\'), '<turn', '<\turn'), '</turn', '<\/turn')) AS role_chars,
         coalesce(lag(role) OVER w = role, false) AS same_before
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(body + CASE WHEN same_before THEN 11 ELSE 6 + role_chars + 11 + 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
