"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, folder), works on all that the stage before it kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's documents. All but the last
return the columns of documents; the last returns one row per packed piece.

1. quality: documents that neighbour voting scores below 0.7 go.
2. lines: three-line windows that repeat an earlier one go; n_chars follows the text, and a
   document that loses its last line goes.
3. near_duplicates: of documents linked at a shingle similarity of 0.8 one stays, the smallest doc_id.
4. benchmark: documents with a verbatim benchmark passage of ten words, or a whole shorter item, go.
5. packing: what is left is tokenized and packed into windows of 2,048 tokens.

Null, empty and very long texts, ties, repeated rows, empty tables and extra columns are treated as
each operator's docstring says. No stage drops a document for its size or its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casegraph.llm import best_fit_packing, minmax_dedup, neighbour_quality, suffix_decontam, window_dedup
from casegraph.llm.common import place_of, stored, table, unnamed


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return neighbour_quality.keep_good(docs, table(spark, folder, "labels"))


def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    plain = unnamed(docs)
    text, chars = f"c{place_of(docs, 'text')}", f"c{place_of(docs, 'n_chars')}"
    cut = window_dedup.dedup_lines(plain, id_col=f"c{place_of(docs, 'doc_id')}", text_col=text)
    left = cut.where("n_removed = 0 or n_removed < n_lines")
    shorter = F.when(F.col("n_removed") > 0, F.char_length(text).cast("bigint")).otherwise(F.col(chars))
    return left.withColumn(chars, shorter).select(*plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return minmax_dedup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return suffix_decontam.decontaminate(docs, table(spark, folder, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return best_fit_packing.pack_documents(docs)


STAGES = [
    ("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", packing),
]

# Learnt scores and subword tokens are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, name)
    return docs
