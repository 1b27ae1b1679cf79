"""Shards by balanced label propagation.

Documents are linked through hubs: a hub is anything that several documents share, here an equal
text. Linked documents start evenly spread and move in rounds. In a round every hub counts the
shards of its documents and every document asks for the shard with the most votes of its hubs. Two
shards exchange as many documents as want to go either way; beyond that a shard takes what it has
room for. So no shard ever exceeds its size. Documents without links fill the shards last: counts
of any two shards differ by one at most.

Every other round asks for shards with room only. A hub then deals its documents from its smallest
parts to its largest ones, as far as each has room, so one larger than a shard fills several at once.
Rounds go on until two in a row bring no more linked documents together. That number is a bounded
integer, so the rounds end.

Defined cases: null and empty texts have 0 bytes and link with nothing; null ids are ids; rows
alike in id and text are separate rows of the same hub; fewer documents than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from casegraph.llm.common import Rounds, numbered, salted_join, stored

SHARDS = 40
HASH_BUCKETS = 1024
OVERHEAD = 16


def capacities(count: int, shards: int) -> list[int]:
    """Documents of each shard: equal, or one more for the first ones."""
    return [count // shards + (k < count % shards) for k in range(shards)]


def memberships(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, hub) of the nodes with one hub, and of those with several."""
    each = stored(members.select("node", "hub").distinct(), "memberships")
    several = each.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    return each.join(several, "node", "left_anti"), each.join(several, "node", "left_semi")


def votes_of(one: DataFrame, several: DataFrame, labels: DataFrame) -> DataFrame:
    """(hub, at, n): how many documents of each hub are in each shard."""
    return one.unionByName(several).join(labels, "node").groupBy("hub", F.col("shard").alias("at")).agg(F.count(F.lit(1)).alias("n"))


def dealt_parts(counted: DataFrame, room: list[int]) -> DataFrame:
    """(hub, shard, target, gain): the parts of each hub, the smallest first, into the room of its largest ones.

    A part asks for the first shard whose room the parts before it leave over; a shard that is asked
    for asks for none itself. A hub has one row per shard at most.
    """
    down = Window.partitionBy("hub").orderBy(F.desc("n"), F.xxhash64("hub", "at").desc(), F.desc("at"))
    free = F.element_at(F.array(*[F.lit(r).cast("bigint") for r in room]), F.col("at") + 1)
    placed = (
        counted.withColumn("rank", F.row_number().over(down))
        .withColumn("until", F.sum(free).over(down.rowsBetween(Window.unboundedPreceding, 0)))
        # what the smaller parts hold
        .withColumn("before", F.sum("n").over(Window.partitionBy("hub")) - F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    )
    parts = placed.groupBy("hub").agg(F.array_sort(F.collect_list(F.struct("rank", "until", "at", "n", "before"))).alias("parts"))
    part = parts.select("hub", "parts", F.explode("parts").alias("p"))
    asked = part.select("hub", "p", F.filter("parts", lambda x: x["until"] > F.col("p.before")).alias("fit")).where("size(fit) > 0")
    return asked.select("hub", "p", F.col("fit")[0].alias("to")).where("to.rank < p.rank").select(
        "hub", F.col("p.at").alias("shard"), F.col("to.at").alias("target"), (F.col("to.n") - F.col("p.n")).alias("gain"))


def wishes(one: DataFrame, several: DataFrame, labels: DataFrame, counted: DataFrame, room: list[int] | None) -> DataFrame:
    """(node, shard, target, gain): documents that another shard attracts more than their own.

    Any shard may attract them, or only those with ``room`` if it is given. Documents of one hub in
    one shard wish alike, so they are decided together, one row per hub and shard; only documents
    with several hubs sum their votes. Equal votes go by a hash of hub and shard, so that a hub's
    documents agree and shards fill evenly.
    """
    ranked = F.struct("n", F.xxhash64("hub", "at").alias("order"), "at")
    if room is None:
        best = counted.groupBy("hub").agg(F.max(ranked).alias("best"))
        shared = counted.join(best, "hub").where(F.col("best") > ranked).select(
            "hub", F.col("at").alias("shard"), F.col("best.at").alias("target"), (F.col("best.n") - F.col("n")).alias("gain"))
    else:
        shared = dealt_parts(counted, room)
    is_open = F.lit(True) if room is None else F.col("at").isin([k for k, free in enumerate(room) if free > 0])
    alike = salted_join(one.join(labels, "node"), shared, ["hub", "shard"]).select("node", "shard", "target", "gain")

    votes = counted.groupBy("hub").agg(F.collect_list(F.struct("n", "at")).alias("votes"))
    summed = (
        salted_join(several, votes, ["hub"]).select("node", "hub", F.explode("votes").alias("v"))
        .groupBy("node", F.col("v.at").alias("at")).agg(F.sum("v.n").alias("n"), F.min("hub").alias("hub"))
    )
    own = summed.join(labels, "node").groupBy("node", "shard").agg(
        F.max(F.when(is_open, ranked)).alias("best"), F.max(F.when(F.col("at") == F.col("shard"), ranked)).alias("own"))
    mixed = own.where("best > own").select(
        "node", "shard", F.col("best.at").alias("target"), (F.col("best.n") - F.col("own.n")).alias("gain"))
    return alike.unionByName(mixed)


def quotas(wanted: dict[tuple[int, int], int], room: list[int]) -> list[tuple[int, int, int]]:
    """(shard, target, moves): exchanges between two shards, and what a target has room for beyond."""
    allowed = {(i, j): min(n, wanted.get((j, i), 0)) for (i, j), n in wanted.items()}
    left = list(room)
    for (i, j), n in sorted(wanted.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - allowed[i, j], left[j])
        allowed[i, j] += more
        left[j] -= more
    return [(i, j, n) for (i, j), n in allowed.items() if n]


def accepted(wanted: DataFrame, room: list[int], number: int) -> DataFrame:
    """(node, target) of the movers within the quotas, the higher gains first.

    Movers are counted by gain and hash bucket. Whole buckets are taken while they fit and only the
    next bucket is ranked, so a quota is met exactly and no task holds all movers of a shard.
    """
    spark = wanted.sparkSession
    counted = {(r["shard"], r["target"]): r["count"] for r in wanted.groupBy("shard", "target").count().collect()}
    allowed = spark.createDataFrame(quotas(counted, room), "shard int, target int, quota bigint")
    # gains by their order of magnitude, then by hash
    place = (64 - F.ceil(F.log2(F.col("gain") + 1))) * HASH_BUCKETS + F.pmod(F.xxhash64("node", F.lit(number)), F.lit(HASH_BUCKETS))
    dealt = wanted.select("node", "shard", "target", place.cast("int").alias("place"))
    running = Window.partitionBy("shard", "target").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    totals = (
        dealt.groupBy("shard", "target", "place").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("total", F.sum("n").over(running)).join(allowed, ["shard", "target"])
    )
    fits = F.col("total") <= F.col("quota")
    limits = totals.groupBy("shard", "target").agg(
        F.coalesce(F.max(F.when(fits, F.col("place"))), F.lit(-1)).alias("whole"), F.min(F.when(~fits, F.col("place"))).alias("next"),
        (F.max("quota") - F.coalesce(F.max(F.when(fits, F.col("total"))), F.lit(0))).alias("rest"))
    judged = salted_join(dealt, limits, ["shard", "target"])
    order = Window.partitionBy("shard", "target").orderBy("node")
    some = judged.where("place = next and rest > 0").withColumn("rank", F.row_number().over(order)).where("rank <= rest")
    return judged.where("place <= whole").select("node", "target").unionByName(some.select("node", "target"))


def propagate(members: DataFrame, start: DataFrame, room_of: list[int]) -> DataFrame:
    """(node, shard): ``start`` after moving nodes towards the shards of the nodes they share hubs with.

    ``members`` holds (node, hub). Stops when two rounds in a row bring no more linked nodes together;
    where every node has one hub, each move does, so nothing moves any more then.
    """
    kept = Rounds(start.sparkSession, "labels")
    labels = kept.put(start.select("node", F.col("shard").cast("int").alias("shard")))
    one, several = memberships(members)
    votes = Rounds(start.sparkSession, "votes")
    squares = F.coalesce(F.sum(F.col("n").cast("decimal(19,0)") * F.col("n")), F.lit(0))
    number = still = 0
    together = -1
    while True:
        counted = votes.put(votes_of(one, several, labels))
        now = int(counted.agg(squares).first()[0])
        still, together = (0, now) if now > together else (still + 1, together)
        if still == 2:
            return labels
        taken = {r["shard"]: r["count"] for r in labels.groupBy("shard").count().collect()}
        room = [size - taken.get(k, 0) for k, size in enumerate(room_of)]
        # by turns any shard, where exchanges count, and only those with room, past a full favourite
        asked = wishes(one, several, labels, counted, room if number % 2 else None)
        moves = stored(accepted(stored(asked, "wishes"), room, number), "moves")
        if not moves.isEmpty():
            labels = kept.put(labels.join(moves, "node", "left").select("node", F.coalesce("target", "shard").alias("shard")))
        number += 1


def shard_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, n_alike), one row per row of ``docs``."""
    bytes_of = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (bytes_of + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text_col).alias("h1"), F.hash(text_col).alias("h2"), (bytes_of > 0).alias("filled"))
    known = stored(numbered(rows, "node", [F.col("doc_id"), F.col("h1"), F.col("h2")], buckets=1024), "rows")
    total = known.count()
    room = capacities(total, shards)

    text = ["h1", "h2", "text_crc32", "size"]
    shared = known.where("filled").groupBy(*text).agg(F.count(F.lit(1)).alias("n_alike")).where("n_alike > 1")
    hubs = stored(numbered(shared, "hub", [F.col(c) for c in text], buckets=64), "hubs")
    members = stored(salted_join(known.where("filled"), hubs, text).select("node", "hub", "n_alike"), "members")
    begun = numbered(members.select("node"), "turn", [F.col("node")], buckets=256).select(
        "node", F.pmod("turn", F.lit(shards)).cast("int").alias("shard"))
    placed = propagate(members, begun, room)

    # the rest fills the shards up, in the order of their numbers
    taken = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    lacking = [size - taken.get(k, 0) for k, size in enumerate(room)]
    until = [sum(lacking[: k + 1]) for k in range(shards)]
    free = numbered(known.select("node").join(placed, "node", "left_anti"), "turn", [F.col("node")], buckets=1024)
    passed = F.size(F.filter(F.array(*[F.lit(u) for u in until]), lambda u: u <= F.col("turn")))
    filled = free.select("node", passed.cast("int").alias("shard"))

    every = stored(placed.unionByName(filled), "shards")
    slots = numbered(every, "slot", [F.col("node")], group=["shard"], buckets=1024)
    alike = members.select("node", "n_alike")
    return known.join(slots, "node").join(alike, "node", "left").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        F.coalesce("n_alike", F.lit(1)).cast("bigint").alias("n_alike"))


def cut_links(sharded: DataFrame, hub: list[str]) -> DataFrame:
    """(n_hubs, n_cut, n_parts): how many hubs of several rows there are and are cut, and their parts."""
    by = sharded.groupBy(*hub).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shard").alias("parts")).where("n > 1")
    return by.agg(F.count(F.lit(1)).alias("n_hubs"), F.count_if(F.col("parts") > 1).alias("n_cut"), F.sum("parts").alias("n_parts"))
