"""Breadth-first work on graphs: layers, hop distances, neighbourhoods, components, walks.

Every round is a join of a frontier with the edges and an anti join with what was seen; rounds
are cut by stored tables, and only a row count reaches the driver. Spark knows the size of a stored
frontier, so the edges are shuffled only for frontiers that are too large to broadcast.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

from casegraph.operators.pairs import HUB_SIZE, hub_groups, mirrored
from casegraph.workspace import checkpointed, stored


def _neighbours(mentions: DataFrame, frontier: DataFrame) -> DataFrame:
    """Entities that share a document with the frontier, through the bipartite mention table."""
    documents = mentions.join(frontier, "entity_id", "left_semi").select("document_id").distinct()
    return mentions.join(documents, "document_id", "left_semi").select("entity_id").distinct()


def classify_layers(
    entities: DataFrame, mentions: DataFrame, root: int, max_hops: int = 2, incremental: bool = False
) -> DataFrame:
    """(id, layer): 0 for the root, then hops to it through shared documents.

    Entities beyond ``max_hops`` hops, unreachable ones included, get ``max_hops + 1``; without
    the root everything does. ``incremental`` keeps layers that are already set and expands from
    them, so a layer is never changed.
    """
    pairs = mentions.select("document_id", "entity_id")
    known = entities.where(F.col("id") == root).select(F.col("id").alias("entity_id"), F.lit(0).alias("layer"))
    if incremental:
        settled = entities.where(F.col("layer").isNotNull() | (F.col("id") == root))
        known = settled.select(F.col("id").alias("entity_id"), F.coalesce("layer", F.lit(0)).alias("layer"))
    frontier = entities.where(F.col("id") == root).select(F.col("id").alias("entity_id"))
    for hop in range(1, max_hops + 1):
        reached = _neighbours(pairs, frontier).join(known, "entity_id", "left_anti")
        known = known.unionByName(reached.select("entity_id", F.lit(hop).alias("layer")))
        if hop < max_hops:
            known = checkpointed(known)
            frontier = known.where(F.col("layer") == hop).select("entity_id")
    layers = known.withColumnRenamed("entity_id", "id")
    return (
        entities.select("id")
        .join(layers, "id", "left")
        .select("id", F.coalesce("layer", F.lit(max_hops + 1)).alias("layer"))
    )


def with_layers(entities: DataFrame, mentions: DataFrame, root: int, **options) -> DataFrame:
    layers = classify_layers(entities, mentions, root, **options)
    return entities.drop("layer").join(layers, "id")


def _both_ways(edges: DataFrame) -> DataFrame:
    """Edges in both directions, written once because every round reads them."""
    return stored(mirrored(edges.select("source", "target"), "source", "target"), "both-ways")


def khop(edges: DataFrame, seeds: DataFrame, n: int = 3) -> DataFrame:
    """(seed, id, hops): entities within 1..n hops of each seed, with the fewest hops.

    ``edges`` has (source, target), undirected; ``seeds`` has (id).
    """
    # stored one way round, and read for either end
    once = stored(edges.select("source", "target"), "one-way")
    visited = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hops"))
    frontier = visited
    for hop in range(1, n + 1):
        ends = [frontier.join(once, frontier["id"] == once[a]).select("seed", F.col(b).alias("id")) for a, b in (("source", "target"), ("target", "source"))]
        step = (
            ends[0].unionByName(ends[1])
            .distinct()
            .join(visited, ["seed", "id"], "left_anti")
        )
        frontier = stored(step.withColumn("hops", F.lit(hop)), "frontier")
        visited = visited.unionByName(frontier)
    return visited.where(F.col("hops") > 0)


def hop_distance(nodes: DataFrame, edges: DataFrame, root: int) -> DataFrame:
    """(id, hops): length of the shortest path to the root; null when there is none."""
    both = _both_ways(edges)
    frontier = stored(nodes.where(F.col("id") == root).select("id", F.lit(0).alias("hops")), "frontier")
    visited = frontier
    for hop in count(1):
        step = (
            frontier.join(both, frontier["id"] == both["source"])
            .select(F.col("target").alias("id"))
            .distinct()
            .join(visited, "id", "left_anti")
        )
        frontier = stored(step.select("id", F.lit(hop).alias("hops")), "frontier")
        if frontier.isEmpty():
            return nodes.select("id").join(visited, "id", "left")
        visited = visited.unionByName(frontier)


def shared_connections(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, id): entities connected to both entities of each given pair.

    The pair table decides the work: neighbours of ``a`` are kept where the edge to ``b`` exists,
    so nothing but true results leaves the second join.
    """
    both = mirrored(edges.select("source", "target"), "source", "target")
    first = pairs.join(both.select(F.col("source").alias("a"), F.col("target").alias("id")), "a")
    return first.join(
        both.select(F.col("source").alias("b"), F.col("target").alias("id")), ["b", "id"], "left_semi"
    ).select("a", "b", "id")


def joint_documents(mentions: DataFrame, pairs: DataFrame, hub_size: int = HUB_SIZE) -> DataFrame:
    """(a, b, document_id): documents that mention both entities of each given pair.

    Entities meet inside their documents, so a pair costs what its entities share and not the documents
    of its busy end. Only in hubs, where most that meet are not asked for, the pairs decide: the end in
    fewer hubs is looked up. A document that mentions ``a`` in several rows has as many for the pair.
    """
    pairs = pairs.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("entity_id")).distinct()
    kept = mentions.select("document_id", "entity_id").where("document_id IS NOT NULL").join(ends, "entity_id", "left_semi")
    alone = pairs.where("a = b").join(kept.withColumnRenamed("entity_id", "a"), "a").select("a", "b", "document_id")
    pairs = pairs.where("a <> b").withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})
    hubs = hub_groups(kept, "document_id", hub_size)
    if hubs.isEmpty():
        return _met_in(kept, pairs).unionByName(alone)
    hubs = stored(hubs, "hubs")
    rows = kept.groupBy("document_id", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    in_hubs = stored(rows.join(hubs, "document_id", "left_semi"), "in-hubs")
    found_in = in_hubs.groupBy("entity_id").agg(F.count(F.lit(1)).alias("hubs"))
    sized = pairs.join(found_in.selectExpr("entity_id AS a", "hubs AS h1"), "a").join(found_in.selectExpr("entity_id AS b", "hubs AS h2"), "b")
    rarer = F.when(F.col("h1") <= F.col("h2"), F.col("a")).otherwise(F.col("b"))
    asked = sized.select("a", "b", rarer.alias("entity_id"), F.when(rarer == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"))
    met = asked.join(in_hubs.withColumnRenamed("n", "n1"), "entity_id").join(
        in_hubs.selectExpr("entity_id AS other", "document_id", "n AS n2"), ["other", "document_id"])
    of_hubs = _repeated(met, F.when(F.col("entity_id") == F.col("a"), F.col("n1")).otherwise(F.col("n2")))
    return _met_in(kept.join(hubs, "document_id", "left_anti"), pairs).unionByName(of_hubs).unionByName(alone)


def _met_in(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, document_id) of the pairs (a, b, low, high) that meet in a document of ``rows``."""
    once = rows.repartition("document_id").groupBy("document_id", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    met = once.selectExpr("document_id", "entity_id AS low", "n AS n1").join(
        once.selectExpr("document_id", "entity_id AS high", "n AS n2"), "document_id").where("low < high")
    return _repeated(pairs.join(met, ["low", "high"]), F.when(F.col("a") == F.col("low"), F.col("n1")).otherwise(F.col("n2")))


def _repeated(met: DataFrame, n: Column) -> DataFrame:
    return met.select("a", "b", F.explode(F.array_repeat("document_id", n.cast("int"))).alias("document_id"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable from every node that has an edge.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): the number of rounds grows
    with the logarithm of the longest chain, and only minima are aggregated per node.
    """
    links = checkpointed(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v")
        .distinct()
    )
    before = None
    while True:
        links = checkpointed(_small_star(_large_star(links)))
        state = links.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")
        ).first()
        if state == before:
            roots = links.select(F.col("v").alias("id")).distinct()
            members = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return members.unionByName(roots.select("id", F.col("id").alias("component")))
        before = state


def _large_star(links: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest neighbour or itself."""
    both = mirrored(links, "u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def random_walks(edges: DataFrame, seeds: DataFrame, steps: int = 4, seed: int = 0) -> DataFrame:
    """(walk, step, id): one repeatable walk per seed, each step to a hashed choice of neighbour.

    Neighbours are numbered once, in hash buckets so that a hub's neighbours are numbered by
    several tasks; each step is then an equi-join that moves every walk by one row.
    """
    both = mirrored(edges.select("source", "target"), "source", "target")
    numbered = _numbered_neighbours(both)
    degrees = numbered.groupBy("source").agg(F.count(F.lit(1)).alias("degree"))
    position = seeds.select(F.col("id").alias("walk"), F.lit(0).alias("step"), "id")
    path = position
    for step in range(1, steps + 1):
        pick = F.pmod(F.xxhash64("walk", F.lit(step), F.lit(seed)), F.col("degree"))
        chosen = position.join(degrees.withColumnRenamed("source", "id"), "id").select(
            "walk", F.col("id").alias("source"), pick.alias("number")
        )
        position = checkpointed(
            chosen.join(numbered, ["source", "number"]).select(
                "walk", F.lit(step).alias("step"), F.col("target").alias("id")
            )
        )
        path = path.unionByName(position)
    return path


def _numbered_neighbours(both: DataFrame, bucket_size: int = 100_000) -> DataFrame:
    """(source, number, target) with numbers 0..degree-1 per source."""
    degree = both.groupBy("source").agg(F.count(F.lit(1)).alias("_d"))
    parts = F.ceil(F.col("_d") / F.lit(bucket_size)).cast("int")
    dealt = both.join(degree, "source").withColumn("_b", F.pmod(F.xxhash64("target"), parts))
    sizes = dealt.groupBy("source", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("source", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("source", "_b").orderBy("target")
    local = dealt.select("source", "_b", "target", (F.row_number().over(within) - 1).alias("_i"))
    return checkpointed(
        local.join(starts, ["source", "_b"]).select(
            "source", (F.col("_start") + F.col("_i")).alias("number"), "target"
        )
    )
