"""Near-duplicate documents by min-max hashing.

Every hash function gives two signature values, the least and the greatest hash of a document's
shingles, so 60 functions make 120 values. Values of different functions are banded; documents
that share a band are candidates, and a link stands only if the *full* shingle sets confirm it.

Candidates stay linear in a bucket: its most central member is compared with the others. Where
members of two different components are left beside that star, the remaining pairs across
components are compared in tiles, once for all buckets that overlap. Documents with equal sets are one candidate, whatever their
number, and blocks have a fixed size, so no task holds a group of copies.

With 24 bands of 5 values a pair of similarity 0.85 is missed with a chance of 8e-7 and one of 0.8
with 6e-5.

Defined cases: a null, empty or wordless text has an empty set and links with nothing; a text of
fewer words than a shingle is one shingle; rows alike in id and text are one document; the
component id is the smallest non-null doc_id of the component (null if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from casegraph.llm.common import VISIBLE, Words, chunks, components, key_columns, mix, place_of, salted_join, stored, unnamed

SHINGLE = 5
PERCENT = 80
FUNCTIONS = 60
BAND_ROWS = 5
SHARD_BYTES = 1 << 20
BLOCK = 64  # members of a star per task
TILE = 512  # members of a tile; two tiles meet in a task


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle of every text, bounds of each text's shingles)."""
    single = words.hashes()
    count = np.diff(words.bounds)
    shingles = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    begin = np.repeat(words.bounds[:-1] - bounds[:-1], shingles) + np.arange(int(bounds[-1]))
    end = np.repeat(words.bounds[1:], shingles)
    total = np.zeros(len(begin), dtype=np.uint64)
    for k in range(size):
        at = begin + k
        inside = at < end
        step = single[np.minimum(at, max(len(single) - 1, 0))] * np.uint64(pow(0xD1342543DE82EF95, k + 1, 2**64))
        total += np.where(inside, step, np.uint64(k + 1))
    return mix(total), bounds


def sketch(data: np.ndarray, offsets: np.ndarray, size: int, functions: int, band_rows: int) -> list:
    """Columns n_shingles, shingle_set (16 bytes) and bands of each text."""
    hashes, bounds = shingle_hashes(Words(data, offsets, VISIBLE), size)
    docs = len(bounds) - 1
    filled = np.flatnonzero(np.diff(bounds))
    count, name = np.zeros(docs, dtype=np.int64), [None] * docs
    for i in filled:
        distinct = np.unique(hashes[bounds[i] : bounds[i + 1]])
        count[i], name[i] = len(distinct), xxhash.xxh3_128_digest(distinct.tobytes())
    values = np.zeros((2 * functions, len(filled)), dtype=np.uint64)
    scale = np.random.default_rng(20_11).integers(0, 2**63, size=(functions, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    begin = bounds[:-1][filled]
    for f in range(functions) if len(filled) else ():
        turned = hashes * scale[f, 0] + scale[f, 1]
        values[f] = np.minimum.reduceat(turned, begin)
        values[functions + f] = np.maximum.reduceat(turned, begin)
    bands = 2 * functions // band_rows
    keys = np.zeros((bands, len(filled)), dtype=np.uint64)
    for r in range(band_rows):
        keys = mix(keys + values[r::band_rows][:bands])
    lists = np.empty(docs, dtype=object)
    for column, i in enumerate(filled):
        lists[i] = keys[:, column].view(np.int64).tolist()
    return [pa.array(count), pa.array(name, type=pa.binary()), pa.array(list(lists), type=pa.list_(pa.int64()))]


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, functions: int, band_rows: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, shingle_set, bands), one row per row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in chunks(batch.column("text"), SHARD_BYTES):
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *sketch(data, offsets, size, functions, band_rows)],
                    names=["doc_id", "text_hash", "n_shingles", "shingle_set", "bands"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash bigint, n_shingles bigint, shingle_set binary, bands array<bigint>")


def shingles_of(text: str, size: int) -> set[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def alike(a: set, b: set, percent: int) -> bool:
    """100 * intersection >= percent * union, without building the union."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    shared = len(small & large)
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def confirm_star(rows: pa.Table, size: int, percent: int) -> pa.Table:
    """Links of one block of a star: members that are like the centre."""
    centre = [r for r in zip(rows["side"].to_pylist(), rows["node"].to_pylist(), strict=True) if r[0] == 0][0][1]
    texts = dict(zip(rows["node"].to_pylist(), rows["text"].to_pylist(), strict=True))
    own = shingles_of(texts.pop(centre), size)
    linked = [n for n, t in texts.items() if alike(own, shingles_of(t, size), percent)]
    return pa.table({"a": pa.array([centre] * len(linked), pa.binary()), "b": pa.array(linked, pa.binary())})


def confirm_block(rows: pa.Table, size: int, percent: int) -> pa.Table:
    """Links across components within one pair of tiles, as a forest.

    Shared shingles are counted through postings of the higher tile, one member of the lower tile
    at a time; a pair that passes by hashes is confirmed on the shingles themselves.
    """
    rows = rows.sort_by("node")
    node, text = rows["node"].to_pylist(), rows["text"].to_pylist()
    _, group = np.unique(np.array([c.hex() for c in rows["component"].to_pylist()]), return_inverse=True)
    tile, low, high = rows["tile"].to_numpy(), rows["low"][0].as_py(), rows["high"][0].as_py()
    sets = []
    for _, _, data, offsets in chunks(rows["text"], SHARD_BYTES):
        hashes, bounds = shingle_hashes(Words(data, offsets, VISIBLE), size)
        sets += [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    count = np.array([len(s) for s in sets])
    right = np.flatnonzero(tile == high)
    posted, owner = np.concatenate([sets[y] for y in right]), np.repeat(right, count[right])
    by = np.argsort(posted, kind="stable")
    posted, owner = posted[by], owner[by]
    links = []
    for x in np.flatnonzero(tile == low):
        other = group[right] != group[x]
        if not other.any():
            continue
        begin, end = np.searchsorted(posted, sets[x], "left"), np.searchsorted(posted, sets[x], "right")
        at = np.repeat(begin - np.cumsum(end - begin) + (end - begin), end - begin) + np.arange(int((end - begin).sum()))
        shared = np.bincount(owner[at], minlength=len(node))[right]
        for y in right[other & (100 * shared >= percent * (count[x] + count[right] - shared))].tolist():
            if group[x] != group[y] and alike(shingles_of(text[x], size), shingles_of(text[y], size), percent):
                links.append((node[x], node[y]))
                group[group == group[y]] = group[x]
    return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT,
    functions: int = FUNCTIONS, band_rows: int = BAND_ROWS, block: int = BLOCK, tile: int = TILE,
) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept), one row per row of ``docs``."""
    sketched = stored(sketches(docs, id_col, text_col, size, functions, band_rows), "sketches")
    full = sketched.where("n_shingles > 0")
    banded = full.select("shingle_set", F.posexplode("bands").alias("band", "key"))
    shared = (
        banded.groupBy("band", "key").agg(F.min("shingle_set").alias("least"), F.max("shingle_set").alias("most"))
        .where("least <> most").select("band", "key")
    )
    members = stored(
        salted_join(banded, shared, ["band", "key"])
        .groupBy("band", "key", F.col("shingle_set").alias("node")).agg(F.lit(1).alias("one")).drop("one"), "members")

    # the centre of a bucket: the member that meets most others over all its buckets
    sizes = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"))
    central = salted_join(members, sizes, ["band", "key"]).groupBy("node").agg(F.sum("size").alias("met"))
    ranked = members.join(central, "node")
    centres = ranked.groupBy("band", "key").agg(F.max(F.struct("met", "node")).alias("top")).select(
        "band", "key", F.col("top.node").alias("centre"))
    starred = stored(salted_join(members, centres, ["band", "key"]), "stars")
    pairs = starred.where("node <> centre").select("centre", "node").distinct()

    texts = candidate_texts(docs, id_col, text_col, full, members)
    dealt = pairs.join(
        pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")), "centre"
    ).select("centre", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
    sides = dealt.select("centre", "block", "node", F.lit(1).alias("side")).unionByName(
        dealt.select("centre", "block", F.col("centre").alias("node"), F.lit(0).alias("side")).distinct())
    links = stored(
        with_text(sides, texts).groupBy("centre", "block").applyInArrow(
            lambda rows: confirm_star(rows, size, percent), "a binary, b binary"), "links")
    rooted = components(links, "a", "b")

    # buckets whose members beside the centre are still apart
    placed = starred.where("node <> centre").join(rooted, "node", "left").select(
        "band", "key", "node", F.coalesce("root", "node").alias("component"))
    apart = placed.groupBy("band", "key").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.min("node").alias("head"), F.count(F.lit(1)).alias("size"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("node")).alias("xor"),
    ).where("least <> most")
    # equal buckets of several bands are compared once
    apart = apart.groupBy("size", "sum", "xor", "head").agg(F.min(F.struct("band", "key")).alias("at")).select(
        "at.band", "at.key", "head", "size")
    rest = stored(salted_join(placed, apart, ["band", "key"]), "rest")
    # a bucket that fits one tile is compared by itself; larger ones that overlap are compared as one cluster
    own = rest.where(F.col("size") <= tile).select(
        F.struct("band", "key").alias("cluster"), "node", "component", F.lit(0).alias("tile"), F.lit(1).alias("tiles"))
    large = rest.where(F.col("size") > tile).select("node", "head", "component").distinct()
    joined = large.select("node", "component").distinct().join(components(large, "node", "head"), "node")
    tiles = joined.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    wide = salted_join(joined, tiles, ["root"]).select(
        F.struct(F.lit(-1).alias("band"), F.xxhash64("root").alias("key")).alias("cluster"), "node", "component",
        F.pmod(F.xxhash64("node"), "tiles").cast("int").alias("tile"), "tiles")
    paired = own.unionByName(wide).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "cluster", "node", "component", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    more = with_text(paired, texts).groupBy("cluster", "low", "high").applyInArrow(
        lambda rows: confirm_block(rows, size, percent), "a binary, b binary")
    more = stored(more, "links")
    if not more.isEmpty():
        rooted = components(links.unionByName(more), "a", "b")
    return labelled(sketched, rooted)


def with_text(rows: DataFrame, texts: DataFrame) -> DataFrame:
    return salted_join(rows, texts, ["node"], salts=8)


def candidate_texts(docs: DataFrame, id_col: str, text_col: str, full: DataFrame, members: DataFrame) -> DataFrame:
    """(node, text): one text of every set that is in a shared bucket."""
    wanted = members.select("node").distinct()
    chosen = full.groupBy(F.col("shingle_set").alias("node")).agg(
        F.min(F.struct(*key_columns("doc_id", "text_hash"))).alias("at")).join(wanted, "node", "left_semi").select(
        "node", "at.*")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    found = rows.select(*key_columns("doc_id", "text_hash"), "text").join(chosen, ["absent", "id", "hash"])
    return stored(found.select("node", "text").dropDuplicates(["node"]), "texts")


def labelled(sketched: DataFrame, rooted: DataFrame) -> DataFrame:
    """Each document with the smallest doc_id of its component."""
    full = sketched.where("n_shingles > 0").select("doc_id", "text_hash", "n_shingles", F.col("shingle_set").alias("node"))
    least = full.groupBy("node").agg(F.min("doc_id").alias("own")).join(rooted, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    of_root = least.groupBy("root").agg(F.min("own").alias("component_id"))
    by_set = stored(least.select("node", "root").join(of_root, "root").select("node", "component_id"), "sets")
    linked = salted_join(full, by_set, ["node"]).select("doc_id", "text_hash", "n_shingles", "component_id")
    alone = sketched.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, and every document without words.

    The document with the smallest id stays; of rows without any id in their component, all stay,
    and rows alike in id and text stay as one. Columns of any name are kept as they are.
    """
    plain, id_at, text = unnamed(docs), f"c{place_of(docs, id_col)}", f"c{place_of(docs, text_col)}"
    decided = near_duplicates(plain, id_col=id_at, text_col=text, **options)
    kept = decided.where("kept or component_id is null").select(*key_columns("doc_id", "text_hash")).distinct()
    keyed = plain.withColumn("text_hash", F.xxhash64(text))
    names = ["absent", "id", "hash"]
    joined = keyed.select("*", *key_columns(id_at, "text_hash")).join(kept, names, "left_semi")
    return joined.dropDuplicates(names).select(*plain.columns).toDF(*docs.columns)
