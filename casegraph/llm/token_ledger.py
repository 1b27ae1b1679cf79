"""Token counts as rollups that signed deltas maintain.

A ledger is a folder. A batch of changes (insert, revise, delete of documents) becomes signed
entries: what a document counted before is taken back with a minus sign, what it counts now is
added. Entries are summed by source, language and tokenizer version before they are written, and
totals are sums over all batches.

    batches/<attempt>/entries/bucket=b   signed counts of each changed document, by a hash of its id
    batches/<attempt>/rollup             signed sums by source, language and tokenizer version
    base/<attempt>/bucket=b              entries of several batches summed by ``compact``
    commits/batch=k                      names the attempt; written last, in one file
    bases/upto=k                         names the base that stands for all batches up to k

A batch evaluates its changes once and reads earlier entries in the buckets of its own ids only.
Every try writes to a folder of its own and becomes visible by its mark alone, so a try that is
lost anywhere leaves the ledger as it was. A committed number is final: committing it again does
nothing, whatever the changes. Numbers increase; a lower one than the last is refused.

Defined cases: a null text counts no tokens but one document; null source or language is a group of
its own; a null doc_id cannot be revised and is added each time; of several changes of one id in a
batch the one with the highest ``sequence`` holds, then the greatest hash of all its fields; deleting
an unknown document and revising it to the same counts change nothing; an empty batch commits zero
rows. Ids are of the type that the ledger is opened with. Columns of ``counted`` that are called
tokens, bytes or tokenizer are replaced, in any case.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casegraph.llm.best_fit_packing import token_ids
from casegraph.llm.common import fields, place_of, stored, unnamed

GROUPS = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens", "bytes"]
FIELDS = "source string, lang string, tokenizer string, docs bigint, tokens bigint, bytes bigint"
VOCABULARY = "byte_bpe_50k.json"
BUCKETS = 64
FILTER_BITS = 1 << 23
_PAGE = 32768  # bits of one of Spark's bitmaps


class IdFilter:
    """A bitmap of hashed ids, ``FILTER_BITS`` long whatever their number: it may let others pass, but holds none back."""

    def __init__(self, ids: DataFrame, id_col: str):
        place = IdFilter.place(id_col)
        pages = ids.where(F.col(id_col).isNotNull()).select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("page")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        self.bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for page, bits in pages.collect():  # at most FILTER_BITS / 32768 rows of 4 KB
            at = (page - 1) * (_PAGE // 8)
            self.bits[at : at + _PAGE // 8] = np.frombuffer(bits, dtype=np.uint8)

    @staticmethod
    def place(id_col: str) -> Column:
        return F.pmod(F.xxhash64(F.col(id_col)), F.lit(FILTER_BITS)) + 1  # bitmaps count from 1

    def holds(self, places: np.ndarray) -> np.ndarray:
        at = places - 1
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def counted(
    docs: DataFrame, tokenizer: str, vocabulary: str = VOCABULARY, text_col: str = "text", only: tuple[DataFrame, str] | None = None,
) -> DataFrame:
    """``docs`` with tokens, bytes and the tokenizer's version instead of the text, in one scan.

    With ``only`` (ids, their column) documents of other ids are left out: most of them by a bitmap
    before they are counted, the rest by a join of the counts. No text is shuffled.
    """
    names = [c for c in docs.columns if c.lower() not in (text_col.lower(), "tokens", "bytes", "tokenizer")]
    plain = unnamed(docs)
    kept = [f"c{place_of(docs, c)}" for c in names]
    text, sought = f"c{place_of(docs, text_col)}", None
    rows = plain.select(*kept, F.col(text).alias("text"))
    if only is not None:
        ids, id_col = only
        sought = rows.sparkSession.sparkContext.broadcast(IdFilter(ids, id_col))
        rows = rows.withColumn("place", IdFilter.place(f"c{place_of(docs, id_col)}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if sought is not None:
                whole = whole.filter(pa.array(sought.value.holds(whole.column("place").to_numpy())))
            for batch in (whole.slice(i, 512) for i in range(0, len(whole), 512)):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                out = batch.select(kept)
                out = out.append_column("tokens", pa.array([len(x) for x in token_ids(texts, vocabulary)], pa.int64()))
                yield out.append_column("bytes", pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()))

    schema = ", ".join([*fields(plain.select(*kept)), "tokens bigint, bytes bigint"])
    found = rows.mapInArrow(run, schema)
    if only is not None:
        wanted = ids.select(F.col(id_col).alias("wanted")).distinct()
        found = found.join(wanted, F.col(f"c{place_of(docs, id_col)}") == F.col("wanted"), "left_semi")
    return found.toDF(*names, "tokens", "bytes").withColumn("tokenizer", F.lit(tokenizer))


class Ledger:
    """Token totals in ``folder``, changed by numbered batches."""

    def __init__(self, spark: SparkSession, folder: str, *, id_type: str = "bigint", buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.entry = f"doc_id {id_type}, {FIELDS}"

    def _marks(self, kind: str) -> dict[int, str]:
        """Number and attempt of every mark; ``kind`` is commits or bases."""
        marks = self.spark.read.schema("number bigint, attempt string").option("recursiveFileLookup", "true")
        try:
            return {r["number"]: r["attempt"] for r in marks.parquet(f"{self.folder}/{kind}").collect()}
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}  # nothing has been committed yet

    def _mark(self, kind: str, name: str, number: int, attempt: str) -> None:
        row = self.spark.range(1).select(F.lit(number).cast("bigint").alias("number"), F.lit(attempt).alias("attempt"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{kind}/{name}={number}")

    def batches(self) -> list[int]:
        """Numbers of the committed batches."""
        return sorted(self._marks("commits"))

    def _bucket(self) -> Column:
        return F.pmod(F.hash("doc_id"), F.lit(self.buckets)).alias("bucket")

    def _entries(self, buckets: list[int] | None = None) -> DataFrame:
        """Signed entries of all committed batches, of the given buckets only."""
        bases, commits = self._marks("bases"), self._marks("commits")
        upto = max(bases, default=None)
        paths = [f"{self.folder}/base/{bases[upto]}"] if bases else []
        paths += [f"{self.folder}/batches/{a}/entries" for k, a in sorted(commits.items()) if upto is None or k > upto]
        found = self.spark.createDataFrame([], f"{self.entry}, bucket int")
        for path in paths:
            rows = self.spark.read.schema(f"{self.entry}, bucket int").parquet(path)
            found = found.unionByName(rows if buckets is None else rows.where(F.col("bucket").isin(buckets)))
        return found

    def _summed(self, entries: DataFrame, keys: list[str]) -> DataFrame:
        sums = entries.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.where("docs <> 0 or tokens <> 0 or bytes <> 0")

    def _write(self, entries: DataFrame, path: str) -> None:
        """``entries`` by bucket, with the bucket's rows in a file."""
        entries.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(path)

    def current(self) -> DataFrame:
        """What each document counts now: the sum of its signed entries, where it is not zero."""
        return self._summed(self._entries(), ["doc_id", *GROUPS])

    def commit(self, number: int, changes: DataFrame) -> None:
        """``changes``: change ('insert', 'revise' or 'delete'), sequence, doc_id, source, lang, tokenizer, tokens, bytes.

        Inserting a known id revises it. Deletes need the id and the tokenizer only.
        """
        self.publish(number, self.prepare(number, changes))

    def prepare(self, number: int, changes: DataFrame) -> str | None:
        """Write the entries and the rollup of a batch to a folder of this try; nothing can be seen of it yet."""
        done = self.batches()
        if number in done:
            return None
        if done and number < done[-1]:
            raise ValueError(f"batch {number} comes after batch {done[-1]}")
        attempt = f"{number}-{uuid.uuid4().hex}"
        fields_ = ["change", "source", "lang", F.col("tokens").cast("bigint").alias("tokens"), F.col("bytes").cast("bigint").alias("bytes")]
        once = stored(changes.select("doc_id", "tokenizer", "sequence", *fields_), "changes")
        values = F.struct("change", "source", "lang", "tokens", "bytes")
        rank = F.struct("sequence", F.xxhash64("change", "source", "lang", "tokens", "bytes"))
        named = once.where("doc_id is not null").groupBy("doc_id", "tokenizer").agg(F.max_by(values, rank).alias("f"))
        last = stored(named.select("doc_id", "tokenizer", "f.*").unionByName(once.where("doc_id is null").drop("sequence")), "last")
        plus = last.where("change <> 'delete'").select(
            "doc_id", *GROUPS, F.lit(1).cast("bigint").alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("bytes", F.lit(0)).alias("bytes"))
        touched = [r[0] for r in last.select(self._bucket()).distinct().collect()]  # at most ``buckets`` numbers
        known = self._entries(touched).join(last.select("doc_id", "tokenizer").distinct(), ["doc_id", "tokenizer"], "left_semi")
        minus = known.select("doc_id", *GROUPS, *[(-F.col(c)).alias(c) for c in SUMS])
        self._write(self._summed(plus.unionByName(minus), ["doc_id", *GROUPS]), f"{self.folder}/batches/{attempt}/entries")
        entries = self.spark.read.schema(f"{self.entry}, bucket int").parquet(f"{self.folder}/batches/{attempt}/entries")
        entries.groupBy(*GROUPS).agg(*[F.sum(c).alias(c) for c in SUMS]).write.parquet(f"{self.folder}/batches/{attempt}/rollup")
        return attempt

    def publish(self, number: int, attempt: str | None) -> None:
        """Make a prepared batch visible."""
        if attempt is not None:
            self._mark("commits", "batch", number, attempt)

    def compact(self) -> None:
        """Sum the entries of all committed batches, so that later ones read one folder for them."""
        numbers = self.batches()
        if numbers and numbers[-1] not in self._marks("bases"):
            attempt = f"{numbers[-1]}-{uuid.uuid4().hex}"
            self._write(self.current(), f"{self.folder}/base/{attempt}")
            self._mark("bases", "upto", numbers[-1], attempt)

    def totals(self) -> DataFrame:
        """docs, tokens and bytes by source, language and tokenizer version, over all committed batches."""
        paths = [f"{self.folder}/batches/{a}/rollup" for a in self._marks("commits").values()]
        rows = self.spark.read.schema(FIELDS).parquet(*paths) if paths else self.spark.createDataFrame([], FIELDS)
        return self._summed(rows, GROUPS)
