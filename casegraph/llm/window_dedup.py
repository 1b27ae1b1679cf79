"""Line dedup by overlapping windows of three lines.

Every run of three consecutive lines is hashed. A window whose hash occurs more than once in the
corpus keeps its first occurrence, by doc_id and then place; the lines that later occurrences
cover are merged and removed. A text of one or two lines is one window. A line is removed only if
an equal line stands earlier, so the first occurrence of every line stays.

Defined cases: ids count from null, the lowest, upwards; rows alike in id and text are one
document and get the same result; a null text stays null and has no lines; an empty text is one
empty line; lines end at a line feed. Blank lines are lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from casegraph.llm.common import place_of, salted_join, unnamed

LINES = 3


def windows(docs: DataFrame, id_col: str, text_col: str, lines: int) -> DataFrame:
    """(absent, id, hash, place, h1, h2): the key of each document and two hashes of each of its windows."""
    split = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).isNotNull().cast("int").alias("given"), F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("hash"), F.split(text_col, "\n").alias("lines"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("lines") - lines, F.lit(0)))
    hashed = F.transform(starts, lambda i: F.struct(
        i.alias("place"), F.xxhash64(F.slice("lines", i + 1, lines)).alias("h1"), F.hash(F.slice("lines", i + 1, lines)).alias("h2")))
    return split.select("given", "id", "hash", F.explode(hashed).alias("w")).select("given", "id", "hash", "w.place", "w.h1", "w.h2")


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """(given, id, hash, starts): the places of the windows of each document that repeat an earlier one."""
    found = windows(docs, id_col, text_col, lines)
    at = F.struct("given", "id", "hash", "place")
    repeated = (
        found.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last")
        .select("h1", "h2", "first")
    )
    later = salted_join(found, repeated, ["h1", "h2"]).where(at > F.col("first"))
    return later.groupBy("given", "id", "hash").agg(F.collect_set("place").alias("starts"))


def without(texts: pd.Series, starts: pd.Series, lines: int) -> pd.Series:
    """The texts without the lines that the windows cover."""

    def cut(text, places):
        if places is None or text is None:
            return text
        rows = text.split("\n")
        keep, until = [], 0
        for place in sorted(places):
            keep.extend(rows[until:place])
            until = max(until, place + lines)
        return "\n".join([*keep, *rows[until:]]) if keep or until < len(rows) else None

    return pd.Series([cut(t, s) for t, s in zip(texts, starts, strict=True)], dtype=object)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """``docs`` with the remaining text, n_lines and n_removed; a text that lost all its lines is empty.

    Columns n_lines and n_removed of the input, in any case, are replaced; others stay, whatever their names.
    """
    plain, text = unnamed(docs), f"c{place_of(docs, text_col)}"
    id_at = f"c{place_of(docs, id_col)}"
    removed = removals(plain, id_col=id_at, text_col=text, lines=lines).select(
        "given", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "hash", "starts")

    @F.pandas_udf("string")
    def rest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, starts in batches:
            yield without(texts, starts, lines)

    keyed = plain.select(
        "*", F.col(id_at).isNotNull().cast("int").alias("given"), F.coalesce(F.col(id_at).cast("string"), F.lit("")).alias("id"),
        F.xxhash64(text).alias("hash"))
    joined = keyed.join(removed, ["given", "id", "hash"], "left").withColumn("rest", rest(text, "starts"))

    def size(column):
        return F.when(F.col(column).isNull(), F.lit(0)).otherwise(F.size(F.split(column, "\n"))).cast("bigint")

    left = F.when(F.col("rest").isNull() & F.col(text).isNotNull(), "").otherwise(F.col("rest"))
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    places = [f"c{place_of(docs, c)}" for c in kept]
    return joined.select(
        *[left.alias(c) if c == text else F.col(c) for c in places], size(text).alias("n_lines"),
        (size(text) - size("rest")).alias("n_removed")).toDF(*kept, "n_lines", "n_removed")
