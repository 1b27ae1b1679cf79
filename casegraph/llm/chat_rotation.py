"""Multi-party dialogues rendered from the perspective of every participant.

For each participant the whole dialogue is rendered with that speaker as the assistant and all
others as named users; only the speaker's own turns, with their end marks, are trained on. System
turns are context for everyone and no perspective. DataFrame functions only.

The result has one row per turn and perspective: the rendered segment, its place in the dialogue,
and the span to train on, in characters of the rendered dialogue, which is the concatenation of
its segments. So a dialogue of any length is never one row. Offsets are summed in spans of
``SPAN`` turns first and then over the spans of a dialogue.

Defined cases: a null text is empty; a null or empty role is called ``unknown``; a null
conversation id is one dialogue; null turns come first; equal turns go by role and text, and
repeated rows are repeated turns; a dialogue of system turns only has no perspective. Marks inside
texts are broken up with a space, and other than word characters in names become ``_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from casegraph.llm.common import salted_join

CONTEXT_ROLES = ("system",)
END = "<|end|>\n"
SPAN = 64


def name_of(role: Column) -> Column:
    cleaned = F.regexp_replace(F.coalesce(role, F.lit("")), r"[^\p{L}\p{N}_-]", "_")
    return F.when(cleaned == "", "unknown").otherwise(cleaned)


def rotate(
    turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    context_roles: tuple[str, ...] = CONTEXT_ROLES,
) -> DataFrame:
    """(conv_id, perspective, turn, position, segment, start, end, mask_start, mask_end).

    The masks are null for turns that are not trained on.
    """
    rows = turns.select(
        F.col(conversation).alias("conv_id"), F.col(conversation).isNull().alias("absent"),
        F.coalesce(F.col(conversation).cast("string"), F.lit("")).alias("key"), F.col(turn).alias("turn"),
        name_of(F.col(role)).alias("speaker"), F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"))
    context = F.col("speaker").isin(*context_roles)
    speakers = rows.where(~context).select("absent", "key", F.col("speaker").alias("perspective")).distinct()
    views = salted_join(rows, speakers, ["absent", "key"])

    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>\n")).when(context, F.concat(F.lit("<|"), "speaker", F.lit("|>\n"))).otherwise(
        F.concat(F.lit("<|user name="), "speaker", F.lit("|>\n")))
    rendered = views.select(
        "conv_id", "absent", "key", "perspective", "turn", "speaker", "body", own.alias("own"), F.char_length(head).alias("head"),
        F.concat(head, "body", F.lit(END)).alias("segment")
    ).withColumn("size", F.char_length("segment").cast("bigint")).withColumn(
        "span", F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(2**62))))

    dialogue = ["absent", "key", "perspective"]
    sums = rendered.groupBy(*dialogue, "span").agg(F.sum("size").alias("chars"), F.count(F.lit(1)).alias("turns"))
    before = Window.partitionBy(*dialogue).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*dialogue, "span", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars"),
                         F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns"))
    within = Window.partitionBy(*dialogue, "span").orderBy("turn", "speaker", "body").rowsBetween(Window.unboundedPreceding, 0)
    placed = rendered.withColumn("until", F.sum("size").over(within)).withColumn("number", F.count(F.lit(1)).over(within)).join(
        starts, [*dialogue, "span"])
    end = F.col("chars") + F.col("until")
    start = end - F.col("size")
    return placed.select(
        "conv_id", "perspective", "turn", (F.col("turns") + F.col("number") - 1).alias("position"), "segment",
        start.alias("start"), end.alias("end"), F.when(F.col("own"), start + F.col("head")).alias("mask_start"),
        F.when(F.col("own"), end - 1).alias("mask_end"))
