"""Chat formatting with typed content parts, in DataFrame functions only.

A turn holds parts of kind text, image, audio or document. A visitor (`VISITORS`: one function for
each kind) turns every part into its place in the turn's content: text stays text, every other kind
becomes one placeholder, in order, and leaves an attachment record (turn, part, kind, uri, number
of tokens that the placeholder expands to). Turns become

    <|turn|>role<|body|>content<|end|>

Control strings inside texts are escaped reversibly: a backslash goes between a control string's
opening bracket and its rest, behind any backslashes that stand there already, so n backslashes
become n + 1 and no control string survives in a text. Neighbouring text parts are joined before
they are escaped, so none can form across their seam either. Spans of code points mark the
assistant's contents for the loss; where a turn begins is a running sum over the conversation.

Edge cases: a null text or role is empty; turns of one number are ordered by role, then text; a
null conversation id is a conversation of its own; a conversation without assistant has no spans;
very long texts are whole; repeated rows are repeated turns; extra columns are ignored, whatever
their names; an empty table gives an empty result. A conversation is one record of the result and
so is put together in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.llm.common import pick

#: The template's marks, and how control strings begin (bracket, rest).
TURN, BODY, END, PLACE = "<|turn|>", "<|body|>", "<|end|>", "<|{}|>"
REST = r"\||/?s>|/?INST\]|/?SYS>>"
ESCAPE, UNESCAPE = rf"([<\[])(\\*)(?={REST})", rf"([<\[])\\(\\*)(?={REST})"

#: Tokens that a placeholder expands to, for each of its units (image tiles, audio seconds, pages).
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2")


def _text(part: Column) -> Column:
    return F.coalesce(part["text"], F.lit(""))


def _attached(kind: str) -> Callable[[Column], Column]:
    return lambda part: F.lit(PLACE.format(kind))


#: What a part of each kind becomes: the text as it is, or the kind's placeholder.
VISITORS: dict[str, Callable[[Column], Column]] = {"text": _text} | {k: _attached(k) for k in TOKENS_PER_UNIT}


def visit(part: Column, visitors: dict[str, Callable[[Column], Column]] = VISITORS) -> Column:
    """struct<is_text, said> of a part; a part of unknown kind counts as text."""
    is_text, said = F.lit(True), visitors["text"](part)
    for kind, visitor in visitors.items():
        if kind != "text":
            is_text = F.when(part["kind"] == kind, False).otherwise(is_text)
            said = F.when(part["kind"] == kind, visitor(part)).otherwise(said)
    return F.struct(is_text.alias("is_text"), said.alias("said"))


def with_runs(rows: DataFrame) -> DataFrame:
    """rows with `runs`, array<struct<text, place>>: each placeholder with the raw text before it, and the text after the last.

    Each step is a column of its own, so that no step is worked out again inside the next one's lambda.
    """
    places = F.filter(F.transform("_seen", lambda v, i: F.struct((i + 1).alias("at"), v["is_text"].alias("is_text"))), lambda v: ~v["is_text"])
    seen = rows.withColumn("_seen", F.transform(F.coalesce("parts", F.array()), lambda p: visit(p)))
    cut = seen.withColumn("_ends", F.concat(F.transform(places, lambda v: v["at"]), F.array(F.size("_seen") + 1)))

    def run(end: Column, k: Column) -> Column:
        after = F.when(k > 0, F.get("_ends", k - 1)).otherwise(0)
        text = F.concat_ws("", F.transform(F.slice("_seen", after + 1, end - after - 1), lambda v: v["said"]))
        return F.struct(text.alias("text"), F.coalesce(F.get("_seen", end - 1)["said"], F.lit("")).alias("place"))

    return cut.withColumn("runs", F.transform("_ends", run)).drop("_seen", "_ends")


def content(runs_: Column) -> Column:
    return F.concat_ws("", F.transform(runs_, lambda r: F.concat(escape(r["text"]), r["place"])))


def expanded(part: Column) -> Column:
    """Tokens that a placeholder expands to: units times the kind's rate, one unit at least."""
    rate = F.lit(None).cast("long")
    for kind, per in TOKENS_PER_UNIT.items():
        rate = F.when(part["kind"] == kind, F.lit(per).cast("long")).otherwise(rate)
    return rate * F.greatest(F.coalesce(part["units"], F.lit(1).cast("long")), F.lit(1).cast("long"))


def text_part(text: Column) -> Column:
    """A turn of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("long").alias("units")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation of `turns` (conv_id, turn, role, parts).

    parts: array<struct<kind: string, text: string, uri: string, units: long>>. Result: conv_id,
    n_turns, formatted, loss_spans array<struct<start, length>> in code points from 0, attachments
    array<struct<turn_at, part_at, kind, uri, tokens>>, attached_tokens.
    """
    parts = F.coalesce("parts", F.array())
    attached = F.filter(
        F.transform(parts, lambda p, i: F.struct(i.alias("part_at"), p["kind"].alias("kind"), p["uri"].alias("uri"), expanded(p).alias("tokens"))),
        lambda a: a["tokens"].isNotNull(),
    )
    rows = with_runs(pick(turns, "conv_id", "turn", "role", "parts")).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "runs", attached.alias("attached"))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))).withColumn("content", content(F.col("runs")))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "runs", "attached").rowsBetween(Window.unboundedPreceding, -1)
    long = (F.length("head") + F.length("content") + len(END)).cast("long")
    rows = rows.withColumn("at", F.coalesce(F.sum(long).over(before), F.lit(0)))
    # No turn is empty, so `at` alone gives the order.
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "role", "head", "content", "attached"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct((t["at"] + F.length(t["head"])).cast("int").alias("start"), F.length(t["content"]).alias("length")))
    attachments = F.flatten(F.transform("turns", lambda t, i: F.transform(t["attached"], lambda a: F.struct(i.alias("turn_at"), a["part_at"].alias("part_at"), a["kind"].alias("kind"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))))
    return talks.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["content"], F.lit(END)))).alias("formatted"),
        spans.alias("loss_spans"),
        attachments.alias("attachments"),
    ).withColumn("attached_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation, unescaped."""
    quoted = TURN.replace("|", r"\|")
    pieces = F.filter(F.split(formatted, quoted), lambda p, i: i > 0)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(p, BODY, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(p, BODY, -1), END, 1)).alias("text"),
        ),
    )


def read_loss_texts(formatted: Column, spans: Column) -> Column:
    """array<string>: the unescaped text of each span of the loss mask."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))


def digests(talks: DataFrame) -> DataFrame:
    """The contract's columns, all read back from the formatted strings and spans."""
    back = talks.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("said"), F.concat_ws("", read_loss_texts(F.col("formatted"), F.col("loss_spans"))).alias("loss"))
    return back.select(
        "conv_id",
        F.size("said").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same in DuckDB's SQL; the template's marks add 8 + 8 + 7 code points a turn.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>>)', '\1\2\\\3', 'g'))
          + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>>)', '\1\2\\\3', 'g')) + 23 AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
