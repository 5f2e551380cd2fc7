"""Chat formatting with Spark expressions alone.

A conversation's turns are collected and sorted, adjacent turns of one role are merged by
an array aggregation, and the runs are concatenated:

    ### role: text</turn>\\n
    ### role: text<next/>text</turn>\\n

``<next/>`` parts the turns that were merged, so reading back gives the turns as they were.
Inside texts and roles the control strings, and the backslash itself, are written as a
backslash and a letter; no other backslash occurs, so unescaping is exact. The loss mask
is a list of spans, in code points of the formatted text, one for each turn of a role
that is learned; marks and separators are outside.

Turns of equal number are ordered by role, then text, as they were before escaping; a null turn comes
first, and rows that repeat a turn stay. Null text and null role are empty. A conversation is one
row, so its text must fit a row; the cost grows with its length, not with the square of its turns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

OPEN, NAMED, CLOSE, NEXT = "### ", ": ", "</turn>\n", "<next/>"
#: The backslash comes first when escaping and last when unescaping.
ESCAPES = (("\\", "\\b"), (OPEN, "\\h"), ("</turn>", "\\e"), (NEXT, "\\n"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
LEARNED = "assistant"
#: Pieces of text whose spans are told at once.
BLOCK = 512


def escape(text: Column, escapes=ESCAPES) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), escapes, F.coalesce(text, F.lit("")))


def unescape(text: Column, escapes=ESCAPES) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), reversed(escapes), text)


def _concat(parts: Column) -> Column:
    return F.array_join(parts, "")


def format_conversations(turns: DataFrame, *, learned: str = LEARNED) -> DataFrame:
    """conv_id, formatted, loss_spans (array of struct start, end) of each conversation."""
    turn = F.struct("turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    collected = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # a run goes from a turn whose role isn't that of the turn before to the next such turn
    n = F.size("turns")
    opens = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    starts = collected.withColumn("opens", opens)

    def run(i: Column, k: Column) -> Column:
        end = F.when(k + 1 < F.size("opens"), F.get("opens", k + 1)).otherwise(n + 1)
        role = escape(F.element_at("turns", i)["role"], ROLE_ESCAPES)
        return F.struct(role.alias("role"), F.transform(F.slice("turns", i, end - i), lambda t: escape(t["text"])).alias("texts"))

    runs = starts.select("conv_id", F.transform("opens", run).alias("runs"))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(run: Column) -> Column:
        mine = run["role"] == F.lit(learned)
        texts = F.transform(run["texts"], lambda t, i: F.array(piece(F.when(i > 0, F.lit(NEXT)).otherwise(""), F.lit(False)), piece(t, mine)))
        header = F.concat(F.lit(OPEN), run["role"], F.lit(NAMED))
        return F.concat(F.array(piece(header, F.lit(False))), F.flatten(texts), F.array(piece(F.lit(CLOSE), F.lit(False))))

    laid = runs.withColumn("pieces", F.flatten(F.transform("runs", pieces)))

    def span(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["text"])
        with_it = F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(x["loss"], with_it).otherwise(acc["spans"]).alias("spans"))

    start = F.expr("named_struct('at', 0, 'spans', CAST(array() AS array<struct<start: int, end: int>>))")
    # an array that grows is copied at each step, so it grows to BLOCK pieces only, then block by block
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("pieces") - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice("pieces", b * BLOCK + 1, F.lit(BLOCK)), start, span))
    laid = laid.withColumn("blocks", blocks)
    at = F.aggregate(
        "blocks", F.expr("named_struct('at', 0, 'starts', CAST(array() AS array<int>))"),
        lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"],
    )
    spans = F.flatten(F.zip_with("blocks", at, lambda x, s: F.transform(x["spans"], lambda y: F.struct((y["start"] + s).alias("start"), (y["end"] + s).alias("end")))))
    return laid.select("conv_id", _concat(F.transform("pieces", lambda x: x["text"])).alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted conversation: array of struct (role, text), unescaped."""
    parts = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def turns(part: Column) -> Column:
        named = F.substring(part, F.lit(len(OPEN) + 1), F.length(part))
        role = F.substring_index(named, NAMED, 1)
        body = F.substring(named, F.length(role) + len(NAMED) + 1, F.length(named))
        return F.transform(F.split(body, NEXT), lambda t: F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(parts, turns))


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """The text under the mask, unescaped span by span."""
    return _concat(F.transform(loss_spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))))


def op5_chat(spark, sf_dir: str) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    read = format_conversations(turns.unionByName(more)).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = _concat(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
escaped AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\b'), '### ', '\h'), '</turn>', '\e'), '<next/>', '\n') AS e,
    replace(replace(replace(replace(replace(role, '\', '\b'), '### ', '\h'), '</turn>', '\e'), '<next/>', '\n'), ':', '\c') AS re,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS merged
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length(e) + CASE WHEN merged THEN 7 ELSE length(re) + 14 END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
