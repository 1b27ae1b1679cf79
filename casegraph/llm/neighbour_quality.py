"""Quality scores by nearest-neighbour voting in a latent semantic space.

Words and word shapes are hashed to a fixed number of features; their document frequencies come
from *all* documents. A truncated singular value decomposition of a bounded sample of labelled
documents gives the latent space. The labelled vectors are broadcast (at most ``most_labelled``
rows of ``rank`` numbers); every document takes exact cosine products with all of them, a block of
documents at a time, and its nearest ``neighbours`` vote with their similarities as weights.

Labels are learnt only from rows whose crc32 of the doc_id as text, modulo 4, is not 2. Labels,
language, source and id are no input of a score.

Defined cases: a null or empty text has no words, so its vector is zero and its score is the share
of label 1 among the labelled sample; unlabelled corpora score 0.5; null labels are left out and
an id labelled twice takes its lower label; of several texts of a labelled id the one with the least
hash is learnt; repeated documents score alike; extra columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from casegraph.llm.common import VISIBLE, Words, chunks, fields, place_of, segment_hash, unnamed

FEATURES = 4096
SHAPES = 1024  # of the features, those for word shapes; the last one counts words that repeat the one before
RANK = 64
MOST_LABELLED = 6000
NEIGHBOURS = 25
THRESHOLD = 0.7
SHARD_BYTES = 1 << 20
BLOCK = 256

# Classes of bytes in word shapes: lower case, upper case, digits, beyond ASCII; others are themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def shapes(data: np.ndarray, words: Words) -> np.ndarray:
    """Hashes of the words' shapes: runs of one class count once."""
    lengths = words.end - words.start
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    kind = _SHAPE[data[within + np.repeat(words.start, lengths)]]
    change = np.ones(len(kind), dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change[first] = True
    runs = np.add.reduceat(change.astype(np.int64), first) if len(first) else first
    return segment_hash(kind[change], np.cumsum(runs) - runs, runs)


def counts(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Feature counts of the texts, a block of texts by all features at a time."""
    words = Words(data, offsets, VISIBLE)
    hashes = words.hashes()
    own = (hashes % np.uint64(FEATURES - SHAPES)).astype(np.int64)
    form = (shapes(data, words) % np.uint64(SHAPES - 1)).astype(np.int64) + FEATURES - SHAPES
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[words.bounds[:-1][words.bounds[:-1] < len(again)]] = False
    form[again] = own[again] = FEATURES - 1
    for begin in range(0, len(offsets) - 1, BLOCK):
        end = min(begin + BLOCK, len(offsets) - 1)
        low, high = words.bounds[begin], words.bounds[end]
        row = np.repeat(np.arange(end - begin), np.diff(words.bounds[begin : end + 1])) * FEATURES
        both = np.concatenate([row + own[low:high], row + form[low:high]])
        yield np.bincount(both, minlength=(end - begin) * FEATURES).reshape(end - begin, FEATURES)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Number of documents with each feature, over all documents, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, dtype=np.int64)
        for batch in batches:
            for begin, end, data, offsets in chunks(batch.column(0), SHARD_BYTES):
                total[FEATURES] += end - begin
                for block in counts(data, offsets):
                    total[:FEATURES] += (block > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(total)], names=["feature", "n"])

    rows = docs.select(text_col).mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    found = np.zeros(FEATURES + 1, dtype=np.int64)
    for feature, n in rows.collect():
        found[feature] = n
    return found[:FEATURES], int(found[FEATURES])


def weighted(block: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.sqrt(block.astype(np.float32)) * idf
    size = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.maximum(size, 1e-12)[:, None]


def latent(rows: np.ndarray, axes: np.ndarray) -> np.ndarray:
    found = rows @ axes
    size = np.sqrt(np.einsum("ij,ij->i", found, found))
    return found / np.maximum(size, 1e-12)[:, None]


def truncated_svd(rows: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors, by a randomized range finder with power iterations."""
    rank = min(rank, *rows.shape)
    basis = np.random.default_rng(5).standard_normal((rows.shape[1], min(rank + 16, rows.shape[1]))).astype(np.float32)
    for _ in range(5):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    values, vectors = np.linalg.eigh((rows @ basis).T @ (rows @ basis))
    return basis @ vectors[:, ::-1][:, :rank] / np.sqrt(np.sqrt(np.maximum(values[::-1][:rank], 1e-6)))


class Model:
    """Feature weights, latent axes, and the labelled vectors with their labels."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, neighbours: int):
        self.idf, self.axes, self.vectors, self.labels = idf, axes, vectors, labels
        self.neighbours, self.prior = min(neighbours, len(labels)), float(labels.mean()) if len(labels) else 0.5

    def score(self, block: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled vectors; ties in similarity go to the earlier one."""
        if not self.neighbours:
            return np.full(len(block), self.prior)
        near = latent(weighted(block, self.idf), self.axes) @ self.vectors.T
        best = np.argpartition(-near, self.neighbours - 1, axis=1)[:, : self.neighbours]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** 2
        total = weight.sum(axis=1)
        vote = (weight * self.labels[best]).sum(axis=1)
        return np.where(total > 0, vote / np.maximum(total, 1e-12), self.prior)


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    rank: int = RANK, most_labelled: int = MOST_LABELLED, neighbours: int = NEIGHBOURS,
) -> Model:
    """The model of ``labels`` over ``docs``; the sample is the ``most_labelled`` lowest hashes of ids."""
    seen, total = document_frequencies(docs, text_col)
    idf = np.log((1 + total) / (1 + seen)).astype(np.float32) + 0.1
    sample = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(most_labelled)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash")).join(F.broadcast(sample), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in chunks(batch.column("text"), SHARD_BYTES):
                features, amounts = [], []
                for block in counts(data, offsets):
                    for row in block:
                        at = np.flatnonzero(row)
                        features.append(at.astype(np.int32))
                        amounts.append(row[at].astype(np.int32))
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), part.column("hash"), pa.array(features, pa.list_(pa.int32())), pa.array(amounts, pa.list_(pa.int32()))],
                    names=["id", "label", "hash", "features", "amounts"])

    kind = dict(texts.dtypes)["id"]
    rows = texts.mapInArrow(run, f"id {kind}, label int, hash bigint, features array<int>, amounts array<int>")
    least = rows.groupBy("id").agg(F.min(F.struct("hash", "label", "features", "amounts")).alias("r"))
    found = least.select("id", "r.*").orderBy("id").toArrow()
    labelled = np.array(found["label"].to_pylist(), dtype=np.float64)
    matrix = np.zeros((len(labelled), FEATURES), dtype=np.float32)
    for i, (at, amount) in enumerate(zip(found["features"], found["amounts"], strict=True)):
        matrix[i, at.values.to_numpy()] = amount.values.to_numpy()
    for begin in range(0, len(matrix), BLOCK):
        matrix[begin : begin + BLOCK] = weighted(matrix[begin : begin + BLOCK], idf)
    if not len(labelled):
        return Model(idf, np.zeros((FEATURES, 1), dtype=np.float32), np.zeros((0, 1), dtype=np.float32), labelled, neighbours)
    axes = truncated_svd(matrix, rank).astype(np.float32)
    return Model(idf, axes, latent(matrix, axes), labelled, neighbours)


def scored(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the model's score of each text in a last column ``name``, which replaces one of that name in any case."""
    sent, text = docs.sparkSession.sparkContext.broadcast(model), f"c{place_of(docs, text_col)}"
    names = [c for c in docs.columns if c.lower() != name.lower()]
    kept, plain = [f"c{place_of(docs, c)}" for c in names], unnamed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for begin, end, data, offsets in chunks(rows[text], SHARD_BYTES):
                found = np.concatenate([sent.value.score(block) for block in counts(data, offsets)])
                out = rows.slice(begin, end - begin).select(kept).append_column("score", pa.array(np.clip(found, 0, 1)))
                yield from out.combine_chunks().to_batches()

    sought = kept if text in kept else [*kept, text]
    return plain.select(*sought).mapInArrow(run, ", ".join([*fields(plain.select(*kept)), "score double"])).toDF(*names, name)


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that score at least ``threshold``, with the columns of ``docs``, whatever their names."""
    plain, text = unnamed(docs), f"c{place_of(docs, text_col)}"
    known = plain.select(F.col(f"c{place_of(docs, id_col)}").alias(id_col), F.col(text).alias("text"))
    model = fit(known, labels, id_col=id_col, **options)
    return scored(plain, model, text_col=text).where(F.col("score") >= threshold).drop("score").toDF(*docs.columns)
