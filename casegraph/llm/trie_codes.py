"""Product codes of vectors, assigned by walking a trie over their distinct parts.

Vectors become integers, floor(4096 x), and are cut into equal consecutive parts. For each part
position a codebook of ``ENTRIES`` entries is refined in rounds: every part goes to its nearest
entry, then an entry becomes the componentwise floor of its parts' mean. The work of a round is a
depth-first walk of a lexicographic trie: a node holds the squared distances between the entries
and the dimensions read so far, so parts with a common prefix share them; a leaf adds what is left
of its parts, takes the least of each, and adds their counts and weighted sums to those entries.

Equal parts are one leaf with a weight, over all vectors: copies are counted before the rounds, in
one shuffle, and each task holds its parts in lexicographic order. Only 16 entries a position and
their sums reach the driver. The last assignment walks the trie of each batch of vectors, so that
no part is joined back to its vectors.

Defined cases: vectors that are null or hold null or non-finite components are left out. Vectors of
different widths have codebooks of their own; a width that is no multiple of eight is cut at
floor(p * width / 8), which may leave parts empty (entry 0, no error). Entries start as parts of the
smallest vec_ids, nulls after all others and ties in the order of the vectors; fewer than 16 vectors
give fewer entries. Integers beyond 2**62 in size count as 2**62; sums of any size are exact, but an
error or a label's error that does not fit 64 bits is null. Repeated ids are rows of their own, null
labels are one group, an empty table gives an empty result, other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from casegraph.llm.common import place_of, salted_join, stored, unnamed

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LEAF = 32  # parts below a trie node that are a leaf together
CHUNK = 8192
LARGEST = 1 << 62
SAFE = 1 << 26  # sizes up to this keep the distances of 64-bit arithmetic exact

Books = dict[tuple[int, int], np.ndarray]  # (width, part position): entries by dimensions


def exact(values: np.ndarray) -> np.ndarray:
    """``values`` as 64-bit integers if their squared distances fit, else as Python integers."""
    return values if not values.size or np.abs(values).max() <= SAFE else values.astype(object)


def _leaves(parts: np.ndarray, entries: np.ndarray, begun: np.ndarray, depth: int) -> np.ndarray:
    """Distances of whole parts from all entries, given those of their first ``depth`` dimensions."""
    rest = parts[:, depth:, None] - entries.T[None, depth:, :]
    return begun + (rest * rest).sum(axis=1)


def walk(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of distinct ``parts`` in lexicographic order; ties to the lower entry.

    Depth first: a node stands for the rows begin..end that agree in the first ``depth`` dimensions.
    A child with at most ``LEAF`` rows is a leaf, and the leaves of a node are closed together: their
    rows start from the distances of the prefix that they share and add their other dimensions.
    """
    n, width = parts.shape
    nearest, least = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=parts.dtype)
    if not n or not width:
        return nearest, least

    def close(rows: np.ndarray, distances: np.ndarray) -> None:
        nearest[rows] = np.argmin(distances, axis=1)
        least[rows] = distances[np.arange(len(rows)), nearest[rows]]

    stack = [(0, n, 0, np.zeros(len(entries), dtype=parts.dtype))]
    while stack:
        begin, end, depth, begun = stack.pop()
        column = parts[begin:end, depth]
        starts = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1])
        sizes = np.diff(np.append(starts, end - begin))
        step = column[starts][:, None] - entries[:, depth][None, :]
        child = begun + step * step
        small = sizes <= LEAF
        if small.any():
            rows = begin + np.flatnonzero(np.repeat(small, sizes))
            shared = np.repeat(np.flatnonzero(small), sizes[small])
            for k in range(0, len(rows), CHUNK):
                some = rows[k : k + CHUNK]
                close(some, _leaves(parts[some], entries, child[shared[k : k + CHUNK]], depth + 1))
        for i in np.flatnonzero(~small)[::-1]:
            stack.append((begin + starts[i], begin + starts[i] + sizes[i], depth + 1, child[i]))
    return nearest, least


def distinct_rows(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows in lexicographic order, for each row its place among them)."""
    order = np.lexsort(parts.T[::-1]) if parts.shape[1] else np.arange(len(parts))
    rows = parts[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    place = np.empty(len(rows), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return rows[new], place


def lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def bounds(width: int) -> list[tuple[int, int]]:
    return [(p * width // PARTS, (p + 1) * width // PARTS) for p in range(PARTS)]


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, width and v of the vectors without null or non-finite components."""
    row, label, vector = (F.col(f"c{place_of(vectors, c)}") for c in (id_col, label_col, vector_col))

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    def whole(x: Column) -> Column:
        return F.greatest(F.least(F.floor(x.cast("double") * F.lit(float(SCALE))).cast("bigint"), F.lit(LARGEST)), F.lit(-LARGEST))

    return unnamed(vectors).where(vector.isNotNull() & F.forall(vector, finite)).select(
        row.alias("id"), label.alias("label"), F.size(vector).alias("width"), F.transform(vector, whole).alias("v"))


def first_entries(kept: DataFrame, entries: int) -> Books:
    """The codebooks' first entries: parts of the ``entries`` smallest ids of each width."""
    order = Window.partitionBy("width").orderBy(F.col("id").asc_nulls_last(), "v")
    rows = kept.select("id", "width", "v").withColumn("place", F.row_number().over(order)).where(F.col("place") <= entries)
    found: dict[int, list[list[int]]] = {}
    for row in sorted(rows.collect(), key=lambda r: (r["width"], r["place"])):
        found.setdefault(row["width"], []).append(row["v"])
    return {(width, p): np.array(v, dtype=np.int64).reshape(len(v), width)[:, a:b]
            for width, v in found.items() for p, (a, b) in enumerate(bounds(width))}


def distinct_parts(kept: DataFrame) -> DataFrame:
    """width, position, part and the number of vectors with it, in lexicographic order inside a task."""

    def part(p: Column) -> Column:
        start = F.floor(p * F.col("width") / PARTS).cast("int")
        return F.slice("v", start + 1, F.floor((p + 1) * F.col("width") / PARTS).cast("int") - start)

    cut = kept.select("width", F.posexplode(F.transform(F.array(*[F.lit(p) for p in range(PARTS)]), part)).alias("position", "part"))
    return cut.groupBy("width", "position", "part").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("width", "position", "part")


def refined(parts: DataFrame, books: Books) -> Books:
    """The codebooks after one round over all distinct parts."""
    sent = parts.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("width", "position")], axis=1)
            turns = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            for begin, end in zip(turns[:-1], turns[1:], strict=True):
                if begin == end:
                    continue
                key = (int(keys[begin, 0]), int(keys[begin, 1]))
                entries = sent.value[key]
                rows = exact(lists(batch.column("part").slice(begin, end - begin), entries.shape[1]))
                rows, place = distinct_rows(rows)
                number = np.zeros(len(rows), dtype=np.int64)
                np.add.at(number, place, batch.column("n").to_numpy()[begin:end])
                nearest, _ = walk(rows, entries.astype(rows.dtype) if exact(entries).dtype == rows.dtype else entries.astype(object))
                if key not in totals:
                    totals[key] = np.zeros(len(entries), dtype=np.int64), np.zeros(entries.shape, dtype=object)
                np.add.at(totals[key][0], nearest, number)
                weights = number[:, None] if rows.dtype == object or number.max() < 1 << 20 else number[:, None].astype(object)
                for e in np.unique(nearest):
                    totals[key][1][e] += (rows[nearest == e] * weights[nearest == e]).sum(axis=0)
        out = [(*key, e, int(n[e]), [str(x) for x in sums[e]]) for key, (n, sums) in totals.items() for e in range(len(n)) if n[e]]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                                         names=["width", "position", "entry", "n", "sums"])

    key = ["width", "position", "entry"]
    partial = parts.mapInArrow(run, "width int, position int, entry int, n bigint, sums array<string>")
    sums = (
        partial.select(*key, "n", F.posexplode_outer("sums").alias("dimension", "s"))
        .groupBy(*key, "dimension").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    )
    after = {k: v.copy() for k, v in books.items()}
    for row in sums.where("dimension is not null").collect():
        after[row["width"], row["position"]][row["entry"], row["dimension"]] = int(row["s"]) // row["n"]
    return after


def assigned(kept: DataFrame, books: Books) -> DataFrame:
    """id, label, width, code and error of every row of ``kept`` under final codebooks."""
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            codes, errors = np.zeros((len(batch), PARTS), dtype=np.int64), np.zeros(len(batch), dtype=object)
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                v = lists(batch.column("v").take(pa.array(at)), int(width))
                for p, (a, b) in enumerate(bounds(int(width))):
                    entries = sent.value[int(width), p]
                    rows, place = distinct_rows(exact(v[:, a:b]))
                    nearest, least = walk(rows, entries.astype(rows.dtype) if exact(entries).dtype == rows.dtype else entries.astype(object))
                    codes[at, p] = nearest[place]
                    errors[at] += least[place].astype(object)
            code = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            yield batch.select(["id", "label", "width"]).append_column("code", pa.array(code, pa.string())).append_column(
                "error", pa.array([e if e < 1 << 63 else None for e in errors.tolist()], pa.int64()))

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, width int, code string, error bigint")


def digest(books: Books, width: int) -> str:
    """sha256 of all components of a width's entries by part, entry and position."""
    listed = [str(int(x)) for p in range(PARTS) for entry in books[width, p] for x in entry]
    return hashlib.sha256(",".join(listed).encode()).hexdigest()


def fit(kept: DataFrame, *, rounds: int = ROUNDS, entries: int = ENTRIES) -> Books:
    """The codebooks of a result of ``integers`` after all rounds."""
    books = first_entries(kept, entries)
    if books:
        parts = stored(distinct_parts(kept), "parts")
        for _ in range(rounds):
            books = refined(parts, books)
    return books


def compressed(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS,
    entries: int = ENTRIES,
) -> DataFrame:
    """vec_id (the id's own name), code, error, label_error and codebooks_sha256 of every vector that is kept."""
    kept = integers(vectors, id_col, vector_col, label_col)
    books = fit(kept, rounds=rounds, entries=entries)
    rows = stored(assigned(kept, books), "codes")
    known = F.col("label").isNotNull()
    keyed = rows.withColumn("none", ~known).withColumn("key", F.coalesce(F.col("label").cast("string"), F.lit("")))
    sums = keyed.groupBy("none", "key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("whole")).select(
        "none", "key", F.expr("try_cast(whole AS bigint)").alias("label_error"))
    hashes = {width: digest(books, width) for width in sorted({w for w, _ in books})}
    book = F.lit(None).cast("string")
    if hashes:
        book = F.element_at(F.create_map(*[F.lit(x) for pair in hashes.items() for x in pair]), F.col("width"))
    return salted_join(keyed, sums, ["none", "key"]).select(F.col("id").alias(id_col), "code", "error", "label_error", book.alias("codebooks_sha256"))
