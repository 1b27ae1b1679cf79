"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are turned to unit length and rotated to principal axes, the widest first. They are ordered
by their first coordinate and cut into tiles of a fixed size. A pair of tiles is compared in one
task: products of the leading dimensions are accumulated step by step, and a pair of vectors is
given up as soon as its partial product plus the product of the two suffix norms stays below the
threshold. What is left is decided by the full cosine of the original components in double
precision. Pairs of tiles whose centres are too far apart for any link are never dealt out.

A task returns, for each linked vector, its number of links and one edge of a spanning forest, so
the output of a tile pair is at most one row per vector, however dense a group is.

The comparison is exact, so its work grows with the square of the vectors that the bounds cannot
part; the shuffle is one copy of a tile per partner tile.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; so do vectors of different length; repeated rows are vectors of their own; the component
id is the smallest non-null vec_id reachable, or the vector's own id if it links with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casegraph.llm.common import components, numbered, salted_join, stored

THRESHOLD = 0.95
TILE = 2048
STEPS = (8, 16, 24, 32, 48)
SLACK = 1e-9


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square leaves the range of doubles."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def principal_axes(rows: DataFrame, width: int) -> np.ndarray:
    """Orthonormal axes by falling variance, from second moments that are summed by Spark.

    ``rows`` has a list column ``vector`` of ``width`` numbers; width times width sums reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            found = unit(matrix(batch.column(0)))
            total += found.T @ found
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    sums = (
        rows.select("vector").mapInArrow(run, "i bigint, row array<double>")
        .select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    )
    moments = np.zeros((width, width))
    for i, j, x in sums.collect():
        moments[i, j] = x
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1]


def first_coordinate(rows: DataFrame, axis: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("first", pa.array(unit(matrix(batch.column("vector"))) @ axis))

    kind = dict(rows.dtypes)["vec_id"]
    return rows.mapInArrow(run, f"vec_id {kind}, vector array<double>, first double")


def tile_summary(rows: pa.Table) -> pa.Table:
    found = unit(matrix(rows["vector"]))
    centre = found.mean(axis=0)
    radius = float(np.sqrt(((found - centre) ** 2).sum(axis=1).max()))
    return pa.table({"tile": rows["tile"].slice(0, 1), "centre": pa.array([centre], pa.list_(pa.float64())), "radius": pa.array([radius])})


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (in a, in b) of all pairs with a cosine of at least ``threshold``."""
    ua, ub = unit(a), unit(b)
    ra, rb = ua @ axes, ub @ axes
    width = ra.shape[1]
    left, right = np.arange(len(ra)), np.arange(len(rb))
    product, done = np.zeros((len(ra), len(rb))), 0
    pairs = None
    for step in [s for s in STEPS if s < width] + [width]:
        if pairs is None:
            product += ra[left, done:step] @ rb[right, done:step].T
            bound = np.sqrt((ra[left, step:] ** 2).sum(1))[:, None] * np.sqrt((rb[right, step:] ** 2).sum(1))[None, :]
            alive = product + bound >= threshold - SLACK
            rows, columns = alive.any(axis=1), alive.any(axis=0)
            if alive.sum() * 50 < alive.size:  # few are left: go on pair by pair
                i, j = np.nonzero(alive)
                pairs, sums = (left[i], right[j]), product[i, j]
            else:
                left, right, product = left[rows], right[columns], product[np.ix_(rows, columns)]
        else:
            i, j = pairs
            sums = sums + np.einsum("ij,ij->i", ra[i, done:step], rb[j, done:step])
            bound = np.sqrt((ra[i, step:] ** 2).sum(1) * (rb[j, step:] ** 2).sum(1))
            alive = sums + bound >= threshold - SLACK
            pairs, sums = (i[alive], j[alive]), sums[alive]
        done = step
    if pairs is None:
        i, j = np.nonzero(alive[np.ix_(rows, columns)])
        pairs = left[i], right[j]
    i, j = pairs
    if same:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        keep[part] = np.einsum("ij,ij->i", ua[i[part]], ub[j[part]]) >= threshold
    return i[keep], j[keep]


def forest(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of ``count`` nodes over the edges (i, j)."""
    low = np.arange(count)
    while len(i):
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if (low == before).all():
            return low
    return low


def compare(rows: pa.Table, axes: np.ndarray, threshold: float) -> pa.Table:
    """(node, links, root) of the linked vectors of one pair of tiles."""
    low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
    tile, node = rows["tile"].to_numpy(), rows["node"].to_numpy()
    vectors = matrix(rows["vector"])
    order = np.argsort(node)
    tile, node, vectors = tile[order], node[order], vectors[order]
    at_a, at_b = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
    i, j = linked_pairs(vectors[at_a], vectors[at_b], axes, threshold, low == high)
    i, j = at_a[i], at_b[j]
    links = np.bincount(i, minlength=len(node)) + np.bincount(j, minlength=len(node))
    root = node[forest(len(node), i, j)]
    found = links > 0
    return pa.table({"node": node[found], "links": links[found], "root": root[found]})


def near_duplicates(
    embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector."""
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = (
        (F.size("vector") > 0)
        & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    )
    usable = F.coalesce(usable, F.lit(False))
    alone = rows.where(~usable).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    kinds = rows.where(usable).groupBy(F.size("vector").alias("width")).count().orderBy("width").collect()
    results = [alone]
    for width, count in kinds:
        results.append(of_width(rows.where(usable & (F.size("vector") == width)), width, count, threshold, tile))
    whole = results[0]
    for part in results[1:]:
        whole = whole.unionByName(part)
    return whole.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def of_width(rows: DataFrame, width: int, count: int, threshold: float, tile: int) -> DataFrame:
    axes = principal_axes(rows, width)
    placed = first_coordinate(rows, np.ascontiguousarray(axes[:, 0]))
    ordered = numbered(placed, "node", [F.col("first"), F.col("vec_id"), F.xxhash64("vector")], buckets=64, spread=F.floor(F.col("first") * 8))
    tiled = stored(ordered.select("vec_id", "vector", "node", F.floor(F.col("node") / tile).cast("bigint").alias("tile")), "tiles")
    last = -(-count // tile) - 1

    near = tiled.groupBy("tile").applyInArrow(tile_summary, "tile bigint, centre array<double>, radius double")
    pairs = near.select(F.col("tile").alias("low"), F.explode(F.sequence("tile", F.lit(last))).alias("high"),
                        F.col("centre").alias("c1"), F.col("radius").alias("r1")).join(
        near.select(F.col("tile").alias("high"), F.col("centre").alias("c2"), F.col("radius").alias("r2")), "high")
    square = F.aggregate(F.zip_with("c1", "c2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    pairs = stored(pairs.where(F.sqrt(square) - F.col("r1") - F.col("r2") <= reach + SLACK).select("low", "high"), "pairs")

    sides = pairs.select("low", "high", F.col("low").alias("tile")).unionByName(
        pairs.where("low <> high").select("low", "high", F.col("high").alias("tile")))
    found = stored(
        tiled.select("tile", "node", "vector").join(sides, "tile").groupBy("low", "high").applyInArrow(
            lambda t: compare(t, axes, threshold), "node bigint, links bigint, root bigint"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    rooted = components(found, "node", "root")
    named = tiled.select("vec_id", "node").join(links, "node").join(rooted, "node")
    least = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    linked = salted_join(named, least, ["root"]).select("node", "n_links", "component_id")
    return tiled.select("vec_id", "node").join(linked, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
