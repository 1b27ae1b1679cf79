"""Reading line dumps and cutting them into documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from casegraph.functions.text import suffix_number, trim_unicode
from casegraph.operators.ranking import top_k_per_group

# Last number of each dataset; larger numbers belong to the next one.
DATASET_BOUNDS = ((3158, 1), (3857, 2), (5586, 3), (8320, 4))
LAST_DATASET = 5


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, block_start, pos, value): lines of a text dump in a splittable scan.

    ``pos`` grows within a block of a file and ``block_start`` orders the blocks of a file.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
    )


def running_marker(lines: DataFrame, is_marker) -> DataFrame:
    """Lines with ``chunk``: the number of markers at or before them in the whole dump.

    The files of a dump follow each other in the order of their paths. Lines are numbered inside
    their block; a second, tiny window over per-block marker counts gives each block its offset,
    so no window spans the lines of a file.
    """
    block = ["file_path", "block_start"]
    marked = lines.withColumn("is_marker", is_marker)
    counts = marked.groupBy(*block).agg(F.sum(F.col("is_marker").cast("bigint")).alias("_markers"))
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*block, F.coalesce(F.sum("_markers").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*block).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("_local", F.sum(F.col("is_marker").cast("bigint")).over(within))
    return local.join(offsets, block).withColumn("chunk", F.col("_offset") + F.col("_local")).drop(
        "_offset", "_local"
    )


def segment_documents(lines: DataFrame, marker_regex: str) -> DataFrame:
    """(file_path, chunk, doc_id, full_text): one row per marker that has a body.

    A trimmed line matching the marker opens a document, which may run on in the next file. Lines before the first marker and blank
    lines are dropped; other lines are kept as written and joined with newlines.
    """
    value = trim_unicode(F.col("value"))
    kept = running_marker(lines.where(value != ""), value.rlike(marker_regex)).where("chunk > 0")
    body = F.when(~F.col("is_marker"), F.struct("pos", "value"))
    # First within a block, where the rows already are, then across blocks.
    parts = kept.groupBy("file_path", "block_start", "chunk").agg(
        F.max(F.when(F.col("is_marker"), value)).alias("doc_id"),
        F.array_sort(F.collect_list(body)).alias("body"),
    ).withColumn("body", F.array_join(F.transform("body", lambda b: b["value"]), "\n"))
    whole = parts.groupBy("chunk").agg(
        F.min("file_path").alias("file_path"), F.max("doc_id").alias("doc_id"),
        F.array_sort(F.collect_list(F.when(F.col("body") != "", F.struct("file_path", "block_start", "body")))).alias("parts"),
    )
    return whole.where(F.size("parts") > 0).select(
        "file_path", "chunk", "doc_id",
        F.array_join(F.transform("parts", lambda p: p["body"]), "\n").alias("full_text"),
    )


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of every key; later repeats are left out."""
    return top_k_per_group(df, [key], [F.asc(c) for c in order], 1)


def assign_dataset(
    df: DataFrame, key: str = "doc_id", bounds: tuple[tuple[int, int], ...] = DATASET_BOUNDS,
    last: int = LAST_DATASET,
) -> DataFrame:
    """Rows with ``dataset_id``: the first bound that is not below the number ending the key."""
    number = suffix_number(F.col(key))
    choice = F
    for upper, dataset in bounds:
        choice = choice.when(number <= upper, F.lit(dataset))
    return df.withColumn("dataset_id", choice.otherwise(F.lit(last)))


def extract_documents(spark: SparkSession, path: str, marker_regex: str, **datasets) -> DataFrame:
    """Documents of a dump, first chunk per id, with their dataset."""
    chunks = segment_documents(read_lines(spark, path), marker_regex)
    first = first_per_key(chunks, "doc_id", ["chunk"])
    return assign_dataset(first, **datasets).select(
        "doc_id", "dataset_id", F.col("file_path"), "full_text", F.lit(1).alias("page_count")
    )
