"""Helpers that several operators share: storage by rounds, keys, ranks, components, word arrays.

Rows are told apart by their id *and* a hash of their text, so that null and repeated ids work:
rows alike in both are one document to every operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from casegraph.workspace import scratch_dir, stored

__all__ = ["Rounds", "components", "fields", "fresh", "numbered", "place_of", "salted_join", "scratch_dir", "stored", "table", "unnamed"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def place_of(df: DataFrame, name: str) -> int:
    """The place of a column: the name itself, or else the first that differs in case only."""
    if name in df.columns:
        return df.columns.index(name)
    return [c.lower() for c in df.columns].index(name.lower())


def unnamed(df: DataFrame) -> DataFrame:
    """``df`` with its columns called c0, c1 and so on by place.

    Names that clash with helper columns, differ in case only or hold dots then cannot disturb;
    ``toDF`` gives them back at the end.
    """
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def fields(df: DataFrame) -> list[str]:
    """The columns of ``df`` as parts of a schema string."""
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]


class Rounds:
    """Durable rounds of an iteration in two folders by turns; a round removes the last but one."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.number = spark, scratch_dir(spark, label), 0

    def put(self, df: DataFrame) -> DataFrame:
        self.number += 1
        path = f"{self.folder}/{self.number % 2}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def key_columns(id_col: str, hash_col: str) -> list[Column]:
    """A document's key without nulls: whether it has no id, the id as text, the hash of its text."""
    return [F.col(id_col).isNull().alias("absent"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
            F.col(hash_col).alias("hash")]


def salted_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join ``rows`` with a lookup of one row per key; rows of a hot key are dealt to ``salts`` tasks.

    Null keys match nothing. A lookup that Spark will broadcast needs no copies: its size estimate leaves
    them out, so they would all pass through the driver.
    """
    limit = rows.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = lookup._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()  # a number of Python or of Scala
    if int(str(size)) <= limit:
        return rows.join(lookup, keys, how)
    salt = fresh(rows, "__salt")
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    copies = lookup.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, salt], how).drop(salt)


def numbered(
    df: DataFrame, name: str, order: list[Column], group: list[str] | None = None, buckets: int = 256,
    spread: Column | None = None,
) -> DataFrame:
    """``df`` with ``name``: a rank from 0 without gaps within ``group``, dealt out over buckets.

    Rows go by bucket, then by ``order``. Buckets come from the hash of the order columns, after
    ``spread`` if it is given. Only counts of buckets are ranked together.
    """
    group = group or []
    part, base = fresh(df, "__part"), fresh(df, "__base")
    place = F.pmod(F.xxhash64(*order), F.lit(buckets))
    rows = df.withColumn(part, place if spread is None else spread.cast("bigint") * buckets + place)
    counts = rows.groupBy(*group, part).agg(F.count(F.lit(1)).alias(base))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, part, F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(*group, part).orderBy(*order)
    return (
        rows.withColumn(name, F.row_number().over(inside).cast("bigint") - 1)
        .join(starts, [*group, part])
        .withColumn(name, F.col(name) + F.col(base))
        .drop(part, base)
    )


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every linked node with the smallest node that it reaches.

    Alternating large and small stars on edges that shrink to stars; aggregates are combined
    before they are shuffled, a hub's edges are dealt to several tasks, and every round is written
    to the shared folder.
    """
    spark = links.sparkSession
    rounds = Rounds(spark, "components")
    u, v = F.col(a), F.col(b)
    edges = rounds.put(
        links.where(u != v).select(F.greatest(u, v).alias("node"), F.least(u, v).alias("root")).distinct())

    def lowest(sides: DataFrame) -> DataFrame:
        return sides.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("low"))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "root")), F.sum(F.hash("node", "root"))).first())

    seen = state(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        large = (
            salted_join(both.where(F.col("root") > F.col("node")), lowest(both), ["node"], salts=8)
            .select(F.col("root").alias("node"), F.col("low").alias("root")).where("node != root").distinct()
        )
        large = rounds.put(large)
        small = salted_join(large, lowest(large), ["node"], salts=8)
        edges = rounds.put(
            small.select("node", F.col("low").alias("root"))
            .unionByName(small.select(F.col("root").alias("node"), F.col("low").alias("root")))
            .where("node != root").distinct())
        now = state(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select("root").distinct().select(F.col("root").alias("node"), "root")
    return edges.unionByName(roots)


# --- words of a batch of texts as numpy arrays -------------------------------------------------

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: letters, digits and everything beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True
#: Bytes of words that end at ASCII white space only.
VISIBLE = np.ones(256, dtype=bool)
VISIBLE[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> _S30)) * _MIX1
    x = (x ^ (x >> _S27)) * _MIX2
    return x ^ (x >> _S31)


_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers), 1024), _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def segment_hash(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte segments of ``data`` (gaps allowed, order kept)."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum()), dtype=np.int32)
    within -= np.repeat(first.astype(np.int32), lengths)
    terms = powers(int(lengths.max()))[within]
    within += np.repeat(starts.astype(np.int32), lengths)
    terms *= data[within] + np.uint64(1)
    filled = lengths > 0
    sums = np.zeros(len(starts), dtype=np.uint64)
    sums[filled] = np.add.reduceat(terms, first[filled])
    return mix(sums + lengths.astype(np.uint64))


class Words:
    """Words of several texts: byte ``start`` and ``end`` of each, and ``bounds`` of each text's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        """``data``: UTF-8 bytes of all texts; text i is data[offsets[i]:offsets[i+1]]."""
        self.low = LOWER[data]
        inside = kind[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            begins = offsets[:-1][offsets[:-1] < offsets[1:]]
            first[begins] = inside[begins]
            ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            last[ends] = inside[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        return segment_hash(self.low, self.start, self.end - self.start)

    def word(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()


def chunks(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about ``most_bytes``."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, place, content = texts.buffers()
    offsets = np.frombuffer(place, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(content, dtype=np.uint8) if content is not None else np.zeros(0, dtype=np.uint8)
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(offsets, offsets[begin] + most_bytes, side="right")) - 1
        end = min(max(end, begin + 1), len(texts))
        yield begin, end, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def map_batches(df: DataFrame, schema: str, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` of a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from each(batch)

    return df.mapInArrow(run, schema)
