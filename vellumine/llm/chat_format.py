"""Chat formatting by perspective rotation.

Each conversation is rendered once for every participant: that one speaks as the
assistant and bears the loss, the others are users with their names, system
turns stay system turns. All of it is one plan of windows over one partitioning
by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM, NOBODY = "system", "unknown"


def _safe(c: Column) -> Column:
    """Text that can't open or close a turn: a space breaks each marker."""
    return F.replace(F.replace(c, F.lit(START), F.lit("<| im_start|>")), F.lit(END), F.lit("<| im_end|>"))


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """One row for each conversation and participant: conv_id, participant, n_turns, rendered, loss_spans, loss_chars.

    Participants are the speakers (``role``) but for system, and for turns
    without a role, which are rendered as a user named unknown. ``loss_spans`` is
    an array of (start, end) in characters of ``rendered``: the texts of the
    participant with the marker that ends them. A turn is
    ``<|im_start|>assistant\\n…<|im_end|>\\n``, with ``user name=…`` or ``system``
    instead for others; such markers inside a text are broken up by a space, and
    line ends in a name are shown as spaces.

    Turns follow by number (null first), then role, then text. Repeated rows
    count once, a null text is empty, rows with a null conv_id are left out. A
    conversation of system turns only has no participant and no row. Other
    columns are ignored; an empty table gives no rows.
    """
    by_conv = Window.partitionBy("conv_id")
    name = F.when(F.trim(F.coalesce("role", F.lit(""))) == "", F.lit(NOBODY)).otherwise(F.col("role"))
    base = (
        turns.select("conv_id", "turn", name.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"), (F.trim(F.coalesce("role", F.lit(""))) != "").alias("named"))
        .where("conv_id IS NOT NULL")
        .repartition("conv_id")
        .distinct()
        .withColumn("at", F.row_number().over(by_conv.orderBy(F.col("turn").asc_nulls_first(), "speaker", "text", "named")))
        .withColumn("participants", F.array_sort(F.collect_set(F.when(F.col("named") & (F.col("speaker") != SYSTEM), F.col("speaker"))).over(by_conv)))
        .select("conv_id", "at", "speaker", "named", _safe(F.col("text")).alias("text"), F.translate(_safe(F.col("speaker")), "\n\r", "  ").alias("shown"), F.explode("participants").alias("participant"))
    )
    own = F.col("named") & (F.col("speaker") == F.col("participant"))
    head = F.concat(F.lit(START), F.when(own, F.lit("assistant")).when(F.col("named") & (F.col("speaker") == SYSTEM), F.lit("system")).otherwise(F.concat(F.lit("user name="), "shown")), F.lit("\n"))
    run = Window.partitionBy("conv_id", "participant").orderBy("at")
    size = F.char_length("head") + F.char_length("text") + F.lit(len(END) + 1)
    placed = base.withColumn("own", own).withColumn("head", head).withColumn("size", size).withColumn("start", F.sum("size").over(run) - F.col("size") + F.char_length("head"))
    return (
        placed.select(
            "conv_id", "participant", "at",
            F.concat("head", "text", F.lit(END + "\n")).alias("part"),
            F.when(F.col("own"), F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.char_length("text") + len(END)).cast("long").alias("end"))).alias("span"),
        )
        .groupBy("conv_id", "participant")
        .agg(F.array_sort(F.collect_list(F.struct("at", "part", "span"))).alias("parts"))
        .select(
            "conv_id", "participant", F.size("parts").cast("long").alias("n_turns"),
            F.concat_ws("", F.col("parts.part")).alias("rendered"),
            F.filter(F.col("parts.span"), lambda x: x.isNotNull()).alias("loss_spans"),
        )
        .withColumn("loss_chars", F.aggregate("loss_spans", F.lit(0).cast("long"), lambda a, x: a + x.end - x.start))
    )


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``rotate_perspectives`` with the spans written as start-end, separated by commas."""
    out = rotate_perspectives(table(spark, sf_dir, "conversations"))
    return out.withColumn("loss_spans", F.concat_ws(",", F.transform("loss_spans", lambda x: F.concat_ws("-", x.start.cast("string"), x.end.cast("string")))))


_SAFE = "replace(replace({0}, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>')"
ORACLE_SQL = rf"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE role END AS speaker, trim(coalesce(role, '')) <> '' AS named, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE named AND speaker <> 'system'
), r AS (
  SELECT conv_id, participant, row_number() OVER (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, text, named) AS seq,
    named AND speaker = participant AS own, {_SAFE.format("text")} AS body,
    '<|im_start|>' || CASE WHEN named AND speaker = participant THEN 'assistant' WHEN named AND speaker = 'system' THEN 'system' ELSE 'user name=' || translate({_SAFE.format("speaker")}, chr(10) || chr(13), '  ') END || chr(10) AS head
  FROM t JOIN p USING (conv_id)
), s AS (
  SELECT *, sum(length(head) + length(body) + 11) OVER (PARTITION BY conv_id, participant ORDER BY seq) - length(body) - 11 AS start FROM r
)
SELECT conv_id, participant, count(*) AS n_turns, string_agg(head || body || '<|im_end|>' || chr(10), '' ORDER BY seq) AS rendered,
  coalesce(string_agg(CASE WHEN own THEN CAST(start AS BIGINT) || '-' || CAST(start + length(body) + 10 AS BIGINT) END, ',' ORDER BY seq), '') AS loss_spans,
  CAST(coalesce(sum(CASE WHEN own THEN length(body) + 10 END), 0) AS BIGINT) AS loss_chars
FROM s GROUP BY conv_id, participant
"""
