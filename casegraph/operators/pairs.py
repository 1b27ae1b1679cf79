"""Pairs of items that share groups: the core of co-occurrence, exact under skew.

A membership table holds one row per (group, item). A group such as a hub document may hold a
large share of all rows, so three things keep its cost down without dropping a result:

* Groups above ``hub_size`` are cut into blocks and every block pair is its own join key, so no
  task handles a whole hub.
* When only pairs sharing at least c groups are wanted, each item leaves its c-1 largest hubs out
  of pair generation. Two items that share c groups still meet in one of the others (the prefix
  rule of set-similarity joins), and the left-out groups are added to the count afterwards.
* Neighbour counts treat items with the same set of hubs as one.

Pairs that are only counted never travel one by one: every group hands each of its items the list
of the others, these lists are dealt by item, and pairs are counted where the lists arrive. Items
in more than ``HOT_ITEM`` groups are the exception, their pairs are dealt singly over all tasks.

Whether hubs and hot items exist is decided by one cheap count each.

Where almost all items meet, even the lists of others are too many to travel. ``pairs_in_blocks``
deals the items into blocks and counts every pair of blocks in a task of its own, so that only
memberships travel, once for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from casegraph.operators.ranking import top_k_per_group
from casegraph.workspace import stored

HUB_SIZE = 2_000
HOT_ITEM = 200_000
BLOCK_ROWS = 4_000_000  # memberships of a block; a task holds those of two
LEAST_BLOCKS = 8
BATCH_ROWS = 200_000  # pairs that leave a task together


def hub_groups(membership: DataFrame, group: str, hub_size: int = HUB_SIZE) -> DataFrame:
    """Groups with more than ``hub_size`` rows, and their sizes."""
    return (
        membership.groupBy(group)
        .agg(F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") > hub_size)
    )


def emit_pairs(
    membership: DataFrame, group: str, item: str, hubs: DataFrame | None = None, block: int = HUB_SIZE
) -> DataFrame:
    """(group, item1, item2) with item1 < item2, each pair of a group once."""
    rows = membership.select(F.col(group).alias("_g"), F.col(item).alias("_x"))
    if hubs is None:
        left = rows.select(F.col("_g"), F.col("_x").alias("item1"))
        right = rows.select(F.col("_g"), F.col("_x").alias("item2"))
        pairs = left.join(right, "_g").where(F.col("item1") < F.col("item2"))
        return pairs.select(F.col("_g").alias(group), "item1", "item2")
    sizes = hubs.select(F.col(group).alias("_g"), "group_size")
    cells = (
        rows.join(sizes, "_g", "left")
        .withColumn("_n", F.ceil(F.coalesce("group_size", F.lit(1)) / F.lit(block)).cast("int"))
        .withColumn("_b", F.pmod(F.xxhash64("_x"), F.col("_n")).cast("int"))
    )
    left = cells.select(
        "_g", F.col("_b").alias("_i"), F.explode(F.sequence("_b", F.col("_n") - 1)).alias("_j"),
        F.col("_x").alias("_x1"),
    )
    right = cells.select(
        "_g", F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"), F.col("_b").alias("_j"),
        F.col("_x").alias("_x2"),
    )
    met = left.join(right, ["_g", "_i", "_j"]).where(
        (F.col("_i") < F.col("_j")) | (F.col("_x1") < F.col("_x2"))
    )
    return met.select(
        F.col("_g").alias(group),
        F.least("_x1", "_x2").alias("item1"),
        F.greatest("_x1", "_x2").alias("item2"),
    )


def _meetings(rows: DataFrame, hubs: DataFrame | None, block: int) -> DataFrame:
    """(item1, others): the items above each item of a group, in each group.

    ``rows`` is (_g, _x). Hubs are cut into blocks, and every pair of blocks makes its own lists.
    """
    rows = rows.where(F.col("_g").isNotNull() & F.col("_x").isNotNull())

    def within(items: Column) -> Column:
        return F.transform(items, lambda x, i: F.struct(x.alias("item1"), F.slice(items, i + 2, F.size(items)).alias("others")))

    def across(items: Column, pool: Column) -> Column:
        return F.transform(items, lambda x: F.struct(x.alias("item1"), F.filter(pool, lambda y: y > x).alias("others")))

    if hubs is None:
        lists = rows.groupBy("_g").agg(F.sort_array(F.collect_list("_x")).alias("_l")).where(F.size("_l") > 1)
        found = lists.select(F.inline(within(F.col("_l"))))
    else:
        own, other = F.col("_b"), F.col("_o")
        dealt = (
            rows.join(hubs.select("_g", "group_size"), "_g", "left")
            .withColumn("_n", F.ceil(F.coalesce("group_size", F.lit(1)) / F.lit(block)).cast("int"))
            .withColumn("_b", F.pmod(F.xxhash64("_x"), F.col("_n")).cast("int"))
            .select("_g", "_x", "_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_o"))
        )
        cells = dealt.groupBy("_g", F.least(own, other).alias("_i"), F.greatest(own, other).alias("_j")).agg(
            F.sort_array(F.collect_list(F.when(own <= other, F.col("_x")))).alias("_l"),
            F.sort_array(F.collect_list(F.when(own > other, F.col("_x")))).alias("_r"))
        left, right = F.col("_l"), F.col("_r")
        found = cells.select(F.inline(
            F.when(F.col("_i") == F.col("_j"), within(left)).otherwise(F.concat(across(left, right), across(right, left)))))
    return found.where(F.size("others") > 0)


def _at_home(rows: DataFrame, hubs: DataFrame | None, block: int) -> tuple[DataFrame, DataFrame | None]:
    """(item1, item2) of all groups: pairs that lie with the others of item1, and those of hot items, if there are any."""
    at_home, of_hot = gathered(_meetings(rows, hubs, block), rows.select(F.col("_x").alias("item1")))
    return at_home.where("item1 <> item2"), None if of_hot is None else of_hot.where("item1 <> item2")


def gathered(met: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(item1, item2) of the lists (item1, others): dealt by item1, and apart from these the pairs of hot items, if there are any.

    ``rows`` has item1 once for each group that it is in.
    """
    hot = stored(rows.groupBy("item1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ITEM).select("item1"), "hot-items")
    pair = ["item1", F.explode("others").alias("item2")]
    if hot.isEmpty():
        return met.repartition("item1").select(*pair), None
    at_home = met.join(hot, "item1", "left_anti").repartition("item1").select(*pair)
    return at_home, met.join(hot, "item1", "left_semi").select(*pair)


def pair_counts(
    membership: DataFrame, group: str, item: str, min_shared: int = 1, hub_size: int = HUB_SIZE
) -> DataFrame:
    """(item1, item2, shared): number of groups two items share, at least ``min_shared``."""
    rows = membership.select(F.col(group).alias("_g"), F.col(item).alias("_x"))
    hubs = hub_groups(rows, "_g", hub_size)
    if hubs.isEmpty():
        return _count(rows, None, hub_size, min_shared)
    if min_shared == 1:
        return _count(rows, hubs, hub_size, 1)
    in_hubs = rows.join(hubs, "_g")
    left_out = stored(
        top_k_per_group(in_hubs, ["_x"], [F.desc("group_size"), F.desc("_g")], min_shared - 1).select("_g", "_x"), "left-out")
    kept = rows.join(left_out, ["_g", "_x"], "left_anti")
    met = stored(_count(kept, hubs, hub_size, 1), "met")
    in_hubs = in_hubs.select("_g", "_x")
    added = _shared_left_out(met, "item1", "item2", left_out, in_hubs).unionByName(
        _shared_left_out(met, "item2", "item1", left_out, in_hubs)
    )
    added = added.distinct().select("item1", "item2", F.lit(1).cast("bigint").alias("shared"))
    total = met.unionByName(added).groupBy("item1", "item2").agg(F.sum("shared").alias("shared"))
    return total.where(F.col("shared") >= min_shared)


def _count(rows: DataFrame, hubs: DataFrame | None, block: int, min_shared: int) -> DataFrame:
    at_home, of_hot = _at_home(rows, hubs, block)
    counts = at_home.groupBy("item1", "item2").agg(F.count(F.lit(1)).alias("shared"))
    if of_hot is not None:
        counts = counts.unionByName(of_hot.groupBy("item1", "item2").agg(F.count(F.lit(1)).alias("shared")))
    return counts.where(F.col("shared") >= min_shared) if min_shared > 1 else counts


def distinct_pairs(membership: DataFrame, group: str, item: str, hub_size: int = HUB_SIZE) -> DataFrame:
    """(item1, item2) with item1 < item2, each pair of items that share a group once."""
    rows = membership.select(F.col(group).alias("_g"), F.col(item).alias("_x"))
    hubs = hub_groups(rows, "_g", hub_size)
    return _pairs_once(rows, None if hubs.isEmpty() else hubs, hub_size)


def pairs_in_blocks(
    membership: DataFrame, group: str, item: str, min_shared: int = 2, apart: bool = False, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(item1, item2, shared, groups1, groups2): number of groups two items share, at least ``min_shared``, and those each is in.

    Groups and items are numbers. With ``apart`` groups are items too, and pairs of which one is a
    group of the other are left out. Only memberships are shuffled, once for each block of items; an
    item lies in one block with all its groups, and a task counts the pairs of two blocks item by item.
    """
    rows = membership.select(F.col(group).cast("bigint").alias("g"), F.col(item).cast("bigint").alias("x")).where("x IS NOT NULL")
    blocks = max(LEAST_BLOCKS, -(-rows.count() // block_rows))
    lists = rows.groupBy("g", F.pmod(F.xxhash64("x"), F.lit(blocks)).cast("int").alias("own")).agg(F.collect_list("x").alias("xs"))
    met = lists.select("g", "own", "xs", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    cells = met.select(
        (high * (high + 1) / 2 + low).cast("int").alias("cell"), (F.col("own") == F.col("other")).alias("alone"),
        (F.col("own") < F.col("other")).alias("is_low"), "g", "xs")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count_cell(batches, min_shared, apart)

    dealt = cells.repartitionById(blocks * (blocks + 1) // 2, F.col("cell")).drop("cell")
    found = dealt.mapInArrow(count, "item1 bigint, item2 bigint, shared bigint, groups1 bigint, groups2 bigint")
    kind = dict(membership.dtypes)[item]
    return found.withColumns({c: F.col(c).cast(kind) for c in ("item1", "item2")})


def _count_cell(batches: Iterator[pa.RecordBatch], min_shared: int, apart: bool) -> Iterator[pa.RecordBatch]:
    """The pairs between two blocks, or inside one that is alone; rows are (alone, is_low, g, xs)."""
    sides, alone = {True: [], False: []}, False
    for batch in batches:
        own, is_low, g, xs = (batch.column(i) for i in range(4))
        alone = alone or bool(batch.num_rows and own[0].as_py())
        at, items = np.diff(xs.offsets.to_numpy()), xs.flatten().to_numpy()
        known, lows = (np.repeat(c.to_numpy(zero_copy_only=False), at) for c in (g.is_valid(), is_low))
        groups = np.repeat(g.fill_null(0).to_numpy(), at)
        for side, rows in sides.items():
            rows.append((groups[lows == side], items[lows == side], known[lows == side]))
    if not sides[False]:
        return
    gx, x, known_x = (np.concatenate(c) for c in zip(*sides[False if alone else True], strict=True))
    gy, y, known_y = (np.concatenate(c) for c in zip(*sides[False], strict=True))
    if not len(x) or not len(y):
        return
    (xs, x), (ys, y) = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
    sizes_x, sizes_y = np.bincount(x), np.bincount(y)
    order = np.argsort(gy[known_y], kind="stable")
    y, (groups, first) = y[known_y][order], np.unique(gy[known_y][order], return_index=True)
    bounds = np.append(first, len(y))
    order = np.argsort(x[known_x], kind="stable")
    x, gx = x[known_x][order], gx[known_x][order]
    begins = np.searchsorted(x, np.arange(len(xs) + 1))
    beside = np.minimum(np.searchsorted(ys, gx), len(ys) - 1)  # the place among the others of an item that is a group
    beside = np.where(ys[beside] == gx, beside, -1)
    at = np.searchsorted(groups, gx)
    met = (at < len(groups)) & (np.append(groups, 0)[at] == gx)
    turn = np.searchsorted(ys, xs)  # the others from here on are above the item
    out, held = _columns(len(ys)), 0
    for i in range(len(xs)):
        mine = slice(begins[i], begins[i + 1])
        own = at[mine][met[mine]]
        lists = [y[a:b] for a, b in zip(bounds[own].tolist(), bounds[own + 1].tolist(), strict=True)]
        if not lists:
            continue
        shared = np.bincount(np.concatenate(lists), minlength=len(ys))
        if apart:
            left_out = beside[mine]
            shared[left_out[left_out >= 0]] = 0
        if alone:
            shared[:i + 1] = 0
        j = np.flatnonzero(shared >= min_shared)
        below, until = held + int(np.searchsorted(j, turn[i])), held + len(j)
        out[2][held:until] = shared[j]
        for low, high, of_low, of_high, part in ((1, 0, 4, 3, slice(held, below)), (0, 1, 3, 4, slice(below, until))):
            others = j[part.start - held:part.stop - held]
            out[low][part], out[of_low][part] = xs[i], sizes_x[i]
            out[high][part], out[of_high][part] = ys[others], sizes_y[others]
        held = until
        if held >= BATCH_ROWS:
            yield _pair_batch(out, held)
            out, held = _columns(len(ys)), 0
    if held:
        yield _pair_batch(out, held)


def _columns(most: int) -> list[np.ndarray]:
    """Space for a batch: less than ``BATCH_ROWS`` rows and the ``most`` of one more item."""
    return [np.empty(BATCH_ROWS + most, dtype="int64") for _ in range(5)]


def _pair_batch(columns: list[np.ndarray], rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c[:rows]) for c in columns], ["item1", "item2", "shared", "groups1", "groups2"])


def _shared_left_out(
    met: DataFrame, owner: str, other: str, left_out: DataFrame, in_hubs: DataFrame
) -> DataFrame:
    owned = met.join(left_out.withColumnRenamed("_x", owner), owner)
    return owned.join(in_hubs.withColumnRenamed("_x", other), ["_g", other], "left_semi").select(
        "item1", "item2", "_g"
    )


def mirrored(pairs: DataFrame, a: str = "item1", b: str = "item2") -> DataFrame:
    """Both directions of an undirected pair table."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    return pairs.unionByName(pairs.select(F.col(b).alias(a), F.col(a).alias(b), *rest))


def neighbour_counts(
    membership: DataFrame, group: str, item: str, hub_size: int = HUB_SIZE
) -> DataFrame:
    """(item, neighbours): number of other items that share at least one group with it."""
    rows = membership.select(F.col(group).alias("_g"), F.col(item).alias("_x"))
    hubs = hub_groups(rows, "_g", hub_size)
    if hubs.isEmpty():
        return _degree(rows, None, hub_size).withColumnRenamed("item1", item)
    in_hubs = rows.join(hubs.select("_g"), "_g", "left_semi")
    # Items with the same hubs carry the same signature: a count and two hash sums of hub ids. The
    # least of them stands for it.
    signed = in_hubs.groupBy("_x").agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("_g")).alias("h1"),
            F.bit_xor(F.xxhash64("_g", F.lit("b"))).alias("h2"),
        ).alias("_full")
    )
    owner = stored(signed.select("_x", F.min("_x").over(Window.partitionBy("_full")).alias("_sig")), "signatures")
    sizes = owner.groupBy("_sig").agg(F.count(F.lit(1)).alias("_members"))
    sig_hubs = in_hubs.join(owner, "_x").select("_g", F.col("_sig").alias("_x")).distinct()
    touching = stored(_pairs_once(sig_hubs, hubs, hub_size), "touching")
    members = [sizes.select(F.col("_sig").alias(c), F.col("_members").alias(m)) for c, m in (("item1", "_m1"), ("item2", "_m2"))]
    ends = touching.join(members[0], "item1").join(members[1], "item2").select(F.explode(F.array(
        F.struct(F.col("item1").alias("_sig"), F.col("_m2").alias("_members")), F.struct(F.col("item2").alias("_sig"), F.col("_m1").alias("_members")))).alias("e"))
    through_hubs = ends.select("e.*").unionByName(sizes).groupBy("_sig").agg(F.sum("_members").alias("_reach"))
    hub_part = owner.join(through_hubs, "_sig").select(
        F.col("_x").alias(item), (F.col("_reach") - 1).alias("neighbours")
    )
    light = rows.join(hubs.select("_g"), "_g", "left_anti")
    signed = _pairs_once(light, None, hub_size).join(
        owner.select(F.col("_x").alias("item1"), F.col("_sig").alias("_s1")), "item1", "left"
    ).join(owner.select(F.col("_x").alias("item2"), F.col("_sig").alias("_s2")), "item2", "left")
    both = F.col("_s1").isNotNull() & F.col("_s2").isNotNull()  # else no hub can hold the pair
    signed = signed.where(~both | (F.col("_s1") != F.col("_s2"))).select(
        "item1", "item2", F.when(both, F.least("_s1", "_s2")).alias("_s1"), F.when(both, F.greatest("_s1", "_s2")).alias("_s2"))
    known = touching.select(F.col("item1").alias("_s1"), F.col("item2").alias("_s2"))
    light_only = signed.join(known, ["_s1", "_s2"], "left_anti").select(F.explode(F.array("item1", "item2")).alias(item))
    of_light = light_only.groupBy(item).agg(F.count(F.lit(1)).alias("neighbours"))
    return (
        hub_part.unionByName(of_light)
        .groupBy(item)
        .agg(F.sum("neighbours").alias("neighbours"))
        .where(F.col("neighbours") > 0)
    )


def _pairs_once(rows: DataFrame, hubs: DataFrame | None, block: int) -> DataFrame:
    """(item1, item2) with item1 < item2, each pair of items that share a group once."""
    at_home, of_hot = _at_home(rows, hubs, block)
    pairs = at_home.distinct()
    return pairs if of_hot is None else pairs.unionByName(of_hot.distinct())


def _degree(rows: DataFrame, hubs: DataFrame | None, block: int) -> DataFrame:
    """(item1, neighbours): each pair travels once, and its two ends are counted before they are shuffled."""
    pairs = _pairs_once(rows, hubs, block)
    return pairs.select(F.explode(F.array("item1", "item2")).alias("item1")).groupBy("item1").agg(F.count(F.lit(1)).alias("neighbours"))


def meet_in_groups(
    left: DataFrame, right: DataFrame, group: str, hub_size: int = HUB_SIZE
) -> DataFrame:
    """Equi-join on ``group`` where the right rows of a hub are dealt over several keys."""
    hubs = hub_groups(right, group, hub_size)
    if hubs.isEmpty():
        return left.join(right, group)
    parts = hubs.select(group, F.ceil(F.col("group_size") / F.lit(hub_size)).cast("int").alias("_n"))
    n = F.coalesce("_n", F.lit(1))
    dealt = right.join(parts, group, "left").withColumn(
        "_part", F.pmod(F.xxhash64(*right.columns), n).cast("int")
    )
    copied = left.join(parts, group, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), n - 1))
    )
    return copied.drop("_n").join(dealt.drop("_n"), [group, "_part"]).drop("_part")
