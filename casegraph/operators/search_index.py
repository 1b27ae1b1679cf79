"""A stored positional search index, with score bounds that let most blocks unread.

Documents are dealt to blocks of similar length, by octaves of their word counts and then by a hash.
A row of the index holds a term's documents of one block with their positions, their number and the
greatest count of the term in any of them; rows lie in folders by term bucket and octave. A query
first reads only the counts. From them follows the best rank that a document of a block can have.
Blocks are then read best first, twice as many each time, until no block left can reach the k-th
best rank found so far; folders without a block to be read are not opened again. The result is that
of ranking every document.

Texts are shuffled once to build the index, with their block; the words of a block are numbered, stemmed
and sorted by term and document where it lies, a block at a time, and are never shuffled. A search leaves
out terms that nobody asks for before anything else, gathers the asked words of a document once for all
queries, and each query meets the documents of its rarest term of a block there, so postings are never
multiplied by the queries that ask for them.

Bound for several terms: a document has at most two words at any distance from a word, so n
occurrences of a term meet the m occurrences of the others at the distances 1, 1, 2, 2, ... at best,
m of them from each; every pair is counted from both its ends, so half the sum is the bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casegraph.functions.stemming import stem
from casegraph.functions.text import words
from casegraph.operators.ranking import top_k_per_group
from casegraph.operators.search import NORMALIZER, REACH, STOP_WORDS, WEIGHT, query_terms, rank, rank_order
from casegraph.workspace import stored

BLOCK_DOCUMENTS = 512
BUCKETS = 64
BLOCK_WORDS = 1 << 22  # words of a block, if its texts are long
FOLDER_WORDS = 1 << 22  # words of the blocks that one task writes for all buckets, if a block is not larger
BATCH_WORDS = 1 << 19  # words that leave a task together
KNOWN_STEMS = 1 << 20  # stems that a task keeps
FIRST_BLOCKS = 4  # read in the first round of a query
SLACK = 1e-9  # more than rounding can add to a rank


def _near(distance: int) -> float:
    """What one pair at a distance adds to -log(1 - rank)."""
    return -math.log(1 - WEIGHT / math.sqrt(1.005 + 0.05 * math.exp(distance / 1.5 - 2)))


def _running(values: list[float]) -> Column:
    total, sums = 0.0, [0.0]
    for x in values:
        total += x
        sums.append(total)
    return F.array(*[F.lit(x) for x in sums])


def bound(most: Column) -> Column:
    """The best rank of a document whose terms occur at most ``most`` (an array) times."""
    single = _running([WEIGHT / (j * j) / NORMALIZER for j in range(1, 65)])
    one = F.when(most[0] <= 64, F.get(single, most[0])).otherwise(F.lit(WEIGHT))
    reached = _running([_near(1 + i // 2) for i in range(2 * REACH)])
    total = F.aggregate(most, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def pairs(totals: Column) -> Column:
        met = lambda n: n * F.get(reached, F.least(totals - n, F.lit(2 * REACH)).cast("int")) / 2
        return F.aggregate(F.transform(most, lambda n: met(n.cast("bigint"))), F.lit(0.0), lambda a, x: a + x)

    several = 1.0 - F.exp(-F.element_at(F.transform(F.array(total), pairs), 1))
    return F.when(F.size(most) == 1, one).otherwise(several)


def _block_rows(config: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (block, id, text), ordered by block, to the rows of the index: (term, block, n_docs, most, docs)."""
    stop = None if config == "simple" else frozenset(STOP_WORDS)
    stemmed = stem if config == "english" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}

        def terms_of(found: pa.Array) -> pa.Array:
            """The term of each distinct word, null for one without weight."""
            if stop is None:
                return found
            listed = found.to_pylist()
            if stemmed is not None:
                if len(known) > KNOWN_STEMS:
                    known.clear()
                known.update({w: stemmed(w) for w in listed if w not in known})
            return pa.array([None if w in stop else known[w] if stemmed is not None else w for w in listed], pa.string())

        held, block = [], None
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                if held and blocks[begin] != block:
                    yield from _rows_of_block(block, pa.Table.from_batches(held), terms_of)
                    held = []
                block = int(blocks[begin])
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from _rows_of_block(block, pa.Table.from_batches(held), terms_of)

    return run


def _rows_of_block(block: int, texts: pa.Table, terms_of: Callable[[pa.Array], pa.Array]) -> Iterator[pa.RecordBatch]:
    """The index rows of one block of texts; rows of one id are one document."""
    split = pc.split_pattern(texts.column(2).combine_chunks(), " ")
    ids = texts.column(1).combine_chunks().dictionary_encode(null_encoding="encode")
    lengths = np.diff(split.offsets.to_numpy())
    doc = np.repeat(ids.indices.to_numpy(), lengths).astype("int64")
    at = np.arange(len(doc), dtype="int64") - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
    found = split.flatten().dictionary_encode()
    named = terms_of(found.dictionary).dictionary_encode()
    term = named.indices.fill_null(-1).to_numpy()[found.indices.to_numpy()].astype("int64")
    kept = term >= 0
    key, at = term[kept] * len(ids.dictionary) + doc[kept], at[kept]
    if not len(key):
        return
    order = np.argsort(key, kind="stable") if len(ids.dictionary) == len(ids) else np.lexsort((at, key))
    key, at = key[order], at[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
    key, at = key[fresh], at[fresh]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    term, doc = key[starts] // len(ids.dictionary), key[starts] % len(ids.dictionary)
    heads = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    bounds = np.append(heads, len(term))
    most = np.maximum.reduceat(sizes, heads)
    places = np.append(starts, len(key))  # of the words of the documents of a term
    turns = places[heads] // BATCH_WORDS
    cuts = [0, *(np.flatnonzero(np.diff(turns)) + 1).tolist(), len(heads)]
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        first, last = bounds[begin], bounds[end]
        positions = pa.ListArray.from_arrays(
            pa.array((places[first:last + 1] - places[first]).astype("int32")), pa.array(at[places[first]:places[last]].astype("int32")))
        docs = pa.StructArray.from_arrays([ids.dictionary.take(pa.array(doc[first:last])), positions], ["id", "positions"])
        yield pa.RecordBatch.from_arrays(
            [named.dictionary.take(pa.array(term[heads[begin:end]])), pa.array(np.full(end - begin, block)),
             pa.array(np.diff(bounds[begin:end + 1])), pa.array(most[begin:end].astype("int32")),
             pa.ListArray.from_arrays(pa.array((bounds[begin:end + 1] - first).astype("int32")), docs)],
            ["term", "block", "n_docs", "most", "docs"])


class SearchIndex:
    """An index below ``folder``; ``build`` writes it, any number of searches read it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        about = spark.read.parquet(f"{self.folder}/about").first()
        self.config, self.buckets = about["config"], about["buckets"]
        self.blocks_met = self.blocks_read = 0

    @classmethod
    def build(
        cls, documents: DataFrame, folder: str, config: str = "english", id_col: str = "id", text_col: str = "full_text",
        block_documents: int = BLOCK_DOCUMENTS, buckets: int = BUCKETS,
    ) -> SearchIndex:
        if config not in ("simple", "stop", "english"):
            raise ValueError(f"unknown text search configuration {config!r}")
        spark, folder = documents.sparkSession, folder.rstrip("/")
        level = F.floor(F.log2(F.size(words(F.col(text_col))) + F.lit(1.0))).cast("int")
        held = documents.where(F.col(text_col).isNotNull())
        counts = held.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()  # some 30 rows at most
        # a word list is one string, parted by spaces, which no word holds
        sized = held.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).select(
            "id", F.array_join("w", " ").alias("text"), F.floor(F.log2(F.size("w") + F.lit(1.0))).cast("int").alias("level"))
        in_block = {r["level"]: max(1, min(block_documents, BLOCK_WORDS >> (r["level"] + 1))) for r in counts}
        parts, beside = F.lit(1), F.lit(1)  # blocks of a level, and those that one task writes
        for r in counts:
            at, most = F.col("level") == r["level"], in_block[r["level"]]
            parts = F.when(at, F.lit(-(-r["n"] // most))).otherwise(parts)
            beside = F.when(at, F.lit(max(1, FOLDER_WORDS // (most << (r["level"] + 1))))).otherwise(beside)
        number = F.pmod(F.xxhash64("id"), parts)
        placed = sized.where(F.col("text") != "").select(
            "id", "text", "level", F.floor(number / beside).alias("share"), (F.col("level").cast("bigint") * (1 << 32) + number).alias("block"))
        together = placed.repartition("level", "share").sortWithinPartitions("block").select("block", "id", "text")
        kind = f"array<struct<id:{dict(together.dtypes)['id']},positions:array<int>>>"
        rows = together.mapInArrow(_block_rows(config), f"term string, block bigint, n_docs bigint, most int, docs {kind}")
        rows = rows.withColumns({
            "bucket": F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"), "level": F.shiftright("block", 32).cast("int")})
        rows.sortWithinPartitions("bucket", "level", "term", "block").write.partitionBy("bucket", "level").parquet(f"{folder}/blocks")
        spark.createDataFrame([(config, buckets)], "config string, buckets int").coalesce(1).write.parquet(f"{folder}/about")
        return cls(spark, folder)

    def _blocks(self, terms: DataFrame) -> DataFrame:
        """The rows of the index in the buckets of ``terms``; other folders are not opened."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in terms.select(bucket).distinct().collect()]
        return self.spark.read.parquet(f"{self.folder}/blocks").where(F.col("bucket").isin(touched))

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """(query_id, id, rank, place): best ``k`` documents of every (query_id, q), those with all its terms.

        ``blocks_met`` and ``blocks_read`` then tell how many blocks hold all terms of a query, and
        how many of these were read.
        """
        terms = stored(query_terms(queries, self.config), "terms")
        index = self._blocks(terms)
        heads = index.select("term", "block", "most").join(terms, "term").groupBy("query_id", "block", "n_terms").agg(
            F.collect_list("most").alias("most")).where(F.size("most") == F.col("n_terms"))
        left = stored(top_k_per_group(
            heads.select("query_id", "block", bound(F.col("most")).alias("bound")), ["query_id"], [F.desc("bound"), F.asc("block")], (1 << 31) - 1, "turn"),
            "blocks")
        self.blocks_met, self.blocks_read = left.count(), 0
        best, until, size = None, 0, FIRST_BLOCKS
        while True:
            chosen = left.where(F.col("turn") <= until + size)
            if best is not None:
                least = best.groupBy("query_id").agg(F.min("rank").alias("least"), F.count(F.lit(1)).alias("n"))
                chosen = left.join(least, "query_id", "left").where(
                    (F.coalesce("n", F.lit(0)) < k) | (F.col("bound") + SLACK >= F.round("least", 9)))
                left = stored(chosen.where(F.col("turn") > until).select(*left.columns), "blocks")
                if left.isEmpty():
                    return best
                chosen = left.where(F.col("turn") <= until + size)
            chosen = stored(chosen.select("query_id", "block"), "chosen")
            self.blocks_read += chosen.count()
            levels = [r[0] for r in chosen.select(F.shiftright("block", 32)).distinct().collect()]
            hits = self._hits(index.where(F.col("level").isin(levels)), chosen, terms)
            found = hits.select("query_id", "id", rank(F.col("hits")).alias("rank"))
            if best is not None:
                found = found.unionByName(best.drop("place"))
            best = stored(top_k_per_group(found, ["query_id"], rank_order(), k, "place"), "best")
            until, size = until + size, 2 * size

    def _hits(self, index: DataFrame, chosen: DataFrame, terms: DataFrame) -> DataFrame:
        """(query_id, id, hits): documents of the ``chosen`` (query_id, block) with all terms of the query."""
        asked = chosen.join(terms.select("query_id", "term"), "query_id")
        index = index.join(terms.select("term"), "term", "left_semi")
        wanted = terms.groupBy("query_id").agg(F.collect_set("term").alias("wanted"))
        rarest = stored(
            index.select("term", "block", "n_docs").join(asked, ["term", "block"]).groupBy("query_id", "block").agg(
                F.min(F.struct("n_docs", "term"))["term"].alias("term")), "rarest")
        candidates = index.select("term", "block", F.col("docs.id").alias("ids")).join(rarest, ["term", "block"]).select(
            "query_id", F.col("block").alias("_block"), F.explode("ids").alias("_id"))
        held = (
            index.select("term", "block", "docs").join(asked.select("term", "block").distinct(), ["term", "block"], "left_semi")
            .select("block", "term", F.explode("docs").alias("d"))
            .groupBy("block", F.col("d.id").alias("id"))
            .agg(F.collect_list(F.struct("term", F.col("d.positions").alias("positions"))).alias("held"))
        )
        there = (F.col("block") == F.col("_block")) & F.col("id").eqNullSafe(F.col("_id"))
        met = candidates.join(held, there).join(wanted, "query_id")
        complete = met.where(F.size(F.array_except("wanted", "held.term")) == 0)
        return complete.select(
            "query_id", "id",
            F.array_sort(F.filter("held", lambda h: F.array_contains(F.col("wanted"), h["term"]))).alias("hits"))
