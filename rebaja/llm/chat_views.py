"""Conversations seen from every participant: that speaker as assistant, all others as named users. DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebaja.session import materialise

#: Roles that set the scene and take no part.
SCENE = ("system",)
OPEN, CLOSE = "<|", "<|end|>\n"
#: Equal messages that go together until the last step.
RUN = 1024


def escaped(text: str | Column) -> Column:
    """``text`` without the opening of a mark: ``<|`` becomes ``<\\|``, and ``<\\`` becomes ``<\\\\``, so that it can be read back."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def blocked(messages: DataFrame) -> DataFrame:
    """Different messages (conv_id, turn, speaker, text) in runs of ``n`` equal ones from number ``first`` on, and the ``block`` of each run.

    Blocks are ranges of the order of messages, cut by Spark's range
    partitions and written, so that they are the same for every reader.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                           F.coalesce(F.nullif(F.trim(F.col("role")), F.lit("")), F.lit("unknown")).alias("speaker"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "speaker", "text"]
    counted = rows.groupBy(*order).agg(F.count("*").alias("n")).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    dealt = counted.withColumn("n", F.least(F.col("n") - F.col("first"), F.lit(RUN))).repartitionByRange(*order, "first")
    return materialise(dealt.withColumn("block", F.spark_partition_id()), "chat-blocks")


def perspectives(messages: DataFrame) -> DataFrame:
    """One row per message and participant: how the message reads in the dialogue seen from that participant.

    ``messages``: conv_id, turn, role (the speaker), text. Columns of the
    result: conv_id, perspective, position, turn, role (assistant, user or
    system), name (of other speakers), segment, start and stop (its place in
    the rendered dialogue, in code points), mask_start and mask_stop (what is
    learned: content and end mark of the assistant's segments, else empty).

    The dialogue of a perspective is its segments joined by position. Messages
    are ordered by turn (null first), then speaker, then text; repeated rows
    keep their number. A null text is empty, a null role is the speaker
    "unknown"; blanks around a role are dropped. A conversation of scene
    messages alone has no participant and no rows, as has an empty table. Other
    columns are left behind, so names cannot clash. Marks inside a text or a
    name are escaped, and line ends of a name are blanks in its segment, so no
    message can pose as a turn of another speaker; ``name`` is as given. Every group ordered by one
    task is a block or the blocks of a conversation, never all its messages,
    whatever their turns: repeated rows are counted first and numbered last, and
    the others are cut by their order.
    """
    rows = blocked(messages)
    parts = rows.where(~F.col("speaker").isin(*SCENE)).groupBy("conv_id", "speaker").agg(F.lit(1).alias("one"))
    seen = rows.alias("m").join(parts.alias("p"), F.col("m.conv_id").eqNullSafe(F.col("p.conv_id")))
    seen = seen.select("m.conv_id", "m.turn", "m.block", "m.speaker", "m.text", "m.n", "m.first", F.col("p.speaker").alias("perspective"))
    role = F.when(F.col("speaker").isin(*SCENE), "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    seen = seen.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    head = F.concat(F.lit(OPEN), F.col("role"), F.lit("|>"), F.coalesce(F.concat(F.lit(" "), F.translate(escaped(F.col("name")), "\r\n", "  ")), F.lit("")), F.lit("\n"))
    seen = seen.withColumn("segment", F.concat(head, escaped(F.col("text")), F.lit(CLOSE))).withColumn("size", F.length("segment").cast("long"))

    key = ["conv_id", "perspective"]
    blocks = seen.groupBy(*key, "block").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n"))
    before = Window.partitionBy(*key).orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select(*key, "block", zero(F.sum("size").over(before)).alias("size_before"), zero(F.sum("n").over(before)).alias("n_before"))
    inside = Window.partitionBy(*key, "block").orderBy(F.asc_nulls_first("turn"), "speaker", "text", "first")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.withColumn("at", zero(F.sum("n").over(earlier))).withColumn("sum", zero(F.sum(F.col("size") * F.col("n")).over(earlier)))
    same: Column = F.lit(True)
    for c in (*key, "block"):
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = placed.alias("s").join(blocks.alias("b"), same).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s.n") - 1)))
    start = F.col("size_before") + F.col("sum") + F.col("copy") * F.col("s.size")
    learned = F.col("s.role") == "assistant"
    return both.select("s.conv_id", "s.perspective", (F.col("n_before") + F.col("at") + F.col("copy")).alias("position"), "s.turn", "s.role", "s.name", "s.segment",
                       start.alias("start"), (start + F.col("s.size")).alias("stop"),
                       F.when(learned, start + F.length(F.lit(f"{OPEN}assistant|>\n"))).otherwise(start).alias("mask_start"),
                       F.when(learned, start + F.col("s.size")).otherwise(start).alias("mask_stop"))


SQL = """WITH m AS (SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM m WHERE speaker <> 'system'),
s AS (SELECT conv_id, perspective, turn, speaker, text, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
      FROM m JOIN p ON conv_id IS NOT DISTINCT FROM c),
g AS (SELECT *, CASE WHEN role = 'user' THEN speaker END AS name, '<|' || role || '|>' || (CASE WHEN role = 'user' THEN ' ' || translate(replace(replace(speaker, '<\\', '<\\\\'), '<|', '<\\|'), chr(13) || chr(10), '  ') ELSE '' END) || chr(10)
      || replace(replace(text, '<\\', '<\\\\'), '<|', '<\\|') || '<|end|>' || chr(10) AS segment FROM s),
o AS (SELECT *, row_number() OVER w - 1 AS position, coalesce(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM g WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, perspective, position, turn, role, name, segment, start, start + length(segment) AS stop,
       CASE WHEN role = 'assistant' THEN start + 14 ELSE start END AS mask_start, CASE WHEN role = 'assistant' THEN start + length(segment) ELSE start END AS mask_stop FROM o"""
