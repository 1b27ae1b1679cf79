"""Packing token sequences by best-fit decreasing.

Documents are tokenized once and cut: full windows first, then one remainder. Full windows are
sequences already. Remainders are dealt evenly to groups of a fixed size; a group is packed in
decreasing order of length, each piece into the tightest open window that still holds it, found by
a segment tree over remaining capacities. A group has few partly filled windows, so their share
falls with the group's size and not with the corpus.

Defined cases: a null or empty text is the end token alone; repeated documents are packed each;
special tokens' spellings are ordinary text; extra columns are left out of the pieces.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casegraph.llm.common import stored

WINDOW = 2048
END_TOKEN = 1
GROUP = 8192


@lru_cache(maxsize=4)
def tokenizer(name: str):
    """The public byte-level vocabulary ``name``.json, read through its equal table of ranks, which is faster."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(texts: list[str], name: str) -> list[np.ndarray]:
    """Ids of each text; texts that repeat within the batch are encoded once."""
    encode = tokenizer(name).encode_ordinary
    known: dict[str, np.ndarray] = {}
    for text in texts:
        if text not in known:
            known[text] = np.array(encode(text), dtype="<u4")
    return [known[t] for t in texts]


PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json",
    window: int = WINDOW, with_ids: bool = False,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's tokens in pieces of at most ``window``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, len(whole), 512)):
                encoded = token_ids([t or "" for t in batch.column("text").to_pylist()], vocabulary)
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, found in enumerate(encoded):
                    tokens = np.append(found, np.uint32(END_TOKEN)).astype("<u4")
                    for at in range(0, len(tokens), window):
                        piece = tokens[at : at + window]
                        row.append(i)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(tokens))
                        if with_ids:
                            ids.append(piece.astype(np.int32))
                columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, {PIECE}" + ", ids array<int>" * with_ids)


class Capacities:
    """A segment tree over remaining capacities: how many open windows have each."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, change: int) -> None:
        node = capacity + self.size
        while node:
            self.open[node] += change
            node >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least ``least`` with an open window, or -1."""
        node = least + self.size
        if self.open[node]:
            return least
        while node > 1:
            if not node & 1 and self.open[node + 1]:  # a left child: look to its right
                node += 1
                while node < self.size:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, the longest placed first."""
    tree, waiting = Capacities(window), [[] for _ in range(window + 1)]
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        room = tree.tightest(length)
        if room < 0:
            room, at = window, used
            used += 1
        else:
            at = waiting[room].pop()
            tree.add(room, -1)
        sequence[i], offset[i] = at, window - room
        if room > length:
            waiting[room - length].append(at)
            tree.add(room - length, 1)
    return sequence, offset


def pack(cut: DataFrame, *, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``cut`` (any table with a ``length`` of at most ``window``) with sequence_id and offset."""
    count = cut.where(F.col("length") < window).count()
    columns = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    schema = ", ".join(f"`{c}` {t}" for c, t in cut.select(*columns).dtypes) + ", sequence_id bigint, offset bigint"

    def numbered_from(batches: Iterator[pa.RecordBatch], first: int, packed: bool) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = (TaskContext.get().partitionId() << 33) + first
        for batch in batches:
            if packed:
                sequence, offset = best_fit(batch.column("length").to_numpy(), window)
            else:
                sequence, offset = np.arange(len(batch)), np.zeros(len(batch), dtype=np.int64)
            out = batch.append_column("sequence_id", pa.array(sequence + number)).append_column("offset", pa.array(offset))
            number += int(sequence.max(initial=-1)) + 1
            yield out

    whole = cut.select(*columns).where(F.col("length") >= window).mapInArrow(lambda b: numbered_from(b, 0, False), schema)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's pieces in groups of the given size."""
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= 2 * group:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    rest = (
        cut.select(*columns).where(F.col("length") < window).repartition(max(1, -(-count // group)))
        .mapInArrow(lambda b: numbered_from(gathered(b), 1 << 32, True), schema)
    )
    return whole.unionByName(rest)


def pack_documents(docs: DataFrame, *, window: int = WINDOW, group: int = GROUP, **options) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; each piece is tokenized once."""
    return pack(stored(pieces(docs, window=window, **options), "pieces"), window=window, group=group)


def sequences(packed: DataFrame, *, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, lengths): the packed token ids, from pieces with ids.

    A sequence is padded to ``window``, unless its length is a power of two.
    """
    by = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    ids = F.flatten(F.col("p.ids"))
    size = F.size(ids)
    lacking = F.when(size.bitwiseAND(size - 1) == 0, 0).otherwise(window - size)
    return by.select(
        "sequence_id", F.concat(ids, F.array_repeat(F.lit(pad), lacking)).alias("ids"),
        F.col("p.length").alias("lengths"))
