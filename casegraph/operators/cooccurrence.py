"""Entity co-occurrence in documents: edges, connections, statistics, networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from casegraph.operators.filters import of_types
from casegraph.operators.pairs import (
    HUB_SIZE,
    emit_pairs,
    gathered,
    hub_groups,
    mirrored,
    neighbour_counts,
    pair_counts,
)
from casegraph.operators.ranking import PEOPLE_AND_ORGS, network_nodes, top_k_per_group
from casegraph.workspace import stored

# Mentions hold one row per (document_id, entity_id); sources.loading.link_mentions ensures it.


def cooccurrence(mentions: DataFrame, min_weight: int = 1, hub_size: int = HUB_SIZE) -> DataFrame:
    """(source, target, weight) with source < target; weight is the number of shared documents."""
    counts = pair_counts(mentions, "document_id", "entity_id", min_weight, hub_size)
    return counts.select(
        F.col("item1").alias("source"), F.col("item2").alias("target"), F.col("shared").alias("weight")
    )


def edges(
    mentions: DataFrame, entities: DataFrame, min_conn: int = 2, min_weight: int = 2,
    hub_size: int = HUB_SIZE,
) -> DataFrame:
    """Weighted edges between people and organizations that have enough connections."""
    eligible = of_types(entities, PEOPLE_AND_ORGS).where(F.col("connection_count") >= min_conn)
    kept = mentions.join(eligible.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return cooccurrence(kept, min_weight, hub_size)


def subgraph(edge_table: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both endpoints among the nodes."""
    ids = nodes.select("id")
    return edge_table.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi"
    ).select(*edge_table.columns)


def network_edges(
    mentions: DataFrame, entities: DataFrame, nodes: DataFrame, min_conn: int = 2, k: int = 3000,
    restrict_first: bool = False,
) -> DataFrame:
    """Heaviest edges among the nodes.

    The limit comes before the restriction to the nodes, so fewer edges than exist may remain;
    ``restrict_first`` restricts before limiting.
    """
    heavy = edges(mentions, entities, min_conn)
    order = [F.desc("weight"), F.asc("source"), F.asc("target")]
    if restrict_first:
        return subgraph(heavy, nodes).orderBy(*order).limit(k)
    return subgraph(heavy.orderBy(*order).limit(k), nodes)


def network(
    entities: DataFrame, mentions: DataFrame, limit: int = 1000, min_conn: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of the best-connected part of the graph."""
    nodes = network_nodes(entities, min_conn, limit)
    return nodes, network_edges(mentions, entities, nodes, min_conn, 3 * limit)


def pair_documents(mentions: DataFrame, documents: DataFrame, hub_size: int = HUB_SIZE) -> DataFrame:
    """(source, target, doc_id): every document two entities share, in long form."""
    hubs = hub_groups(mentions, "document_id", hub_size)
    pairs = emit_pairs(
        mentions, "document_id", "entity_id", None if hubs.isEmpty() else hubs, hub_size
    )
    keys = documents.select(F.col("id").alias("document_id"), "doc_id")
    return pairs.join(keys, "document_id").select(
        F.col("item1").alias("source"), F.col("item2").alias("target"), "doc_id"
    )


def entity_connections(
    mentions: DataFrame, entities: DataFrame, min_weight: int = 1,
    hub_size: int = HUB_SIZE,
) -> DataFrame:
    """Connected entity pairs with names and types; attributes join after the aggregation.

    The documents of the pairs are in ``pair_documents``, one row each, so that no array holds an
    unbounded group.
    """
    pairs = cooccurrence(mentions, min_weight, hub_size)
    return with_attributes(pairs, entities).withColumnRenamed("weight", "shared_documents")


def with_attributes(edge_table: DataFrame, entities: DataFrame) -> DataFrame:
    """Edge endpoints with their names and types."""
    for end, key in (("entity1", "source"), ("entity2", "target")):
        names = entities.select(
            F.col("id").alias(f"{end}_id"),
            F.col("canonical_name").alias(f"{end}_name"),
            F.col("entity_type").alias(f"{end}_type"),
        )
        edge_table = edge_table.withColumnRenamed(key, f"{end}_id").join(names, f"{end}_id")
    return edge_table


def connections(
    mentions: DataFrame, entities: DataFrame, k: int = 50, hub_size: int = HUB_SIZE
) -> DataFrame:
    """The ``k`` strongest connections of every entity, with the other entity's attributes."""
    both = mirrored(cooccurrence(mentions, 1, hub_size), "source", "target")
    best = top_k_per_group(
        both, ["source"], [F.desc("weight"), F.asc("target")], k, "rank"
    ).select(F.col("source").alias("entity_id"), F.col("target").alias("id"),
             F.col("weight").alias("shared_docs"), "rank")
    attributes = entities.select("id", "canonical_name", "entity_type", "layer")
    return best.join(attributes, "id")


def connections_by_name(
    mentions: DataFrame, entities: DataFrame, seeds: DataFrame | None = None, k: int = 100,
    hub_size: int = HUB_SIZE,
) -> DataFrame:
    """Strongest connections of the seeds (all entities by default), other entities merged by name."""
    names = entities.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("entity2"))
    # numbers in the order of the names stand for them until the strongest are known
    numbers = stored(names.select("entity2").distinct().orderBy("entity2").withColumn("no", F.monotonically_increasing_id()), "name-numbers")
    numbered = names.join(numbers.withColumnRenamed("entity2", "_name"), F.col("entity2").eqNullSafe(F.col("_name"))).select("entity_id", "no")
    own = mentions.select("document_id", "entity_id")
    others = own.join(numbered, "entity_id")
    if seeds is not None:
        own = own.join(seeds.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
        others = others.join(own.select("document_id").distinct(), "document_id", "left_semi")
    met = lists_in_groups(own, others, hub_size)
    at_home, of_hot = gathered(met, own.withColumnRenamed("entity_id", "item1"))
    counts = at_home.groupBy("item1", "item2").agg(F.count(F.lit(1)).alias("shared_docs"))
    if of_hot is not None:
        counts = counts.unionByName(of_hot.groupBy("item1", "item2").agg(F.count(F.lit(1)).alias("shared_docs")))
    best = top_k_per_group(counts, ["item1"], [F.desc("shared_docs"), F.asc("item2")], k, "rank")
    best = best.withColumnRenamed("item1", "entity_id").withColumnRenamed("item2", "no").join(numbers, "no")
    return best.select("entity_id", "entity2", "shared_docs", "rank").join(names.withColumnRenamed("entity2", "entity1"), "entity_id")


def lists_in_groups(own: DataFrame, others: DataFrame, hub_size: int = HUB_SIZE) -> DataFrame:
    """(item1, others): for each own row the numbers of the other names in its document.

    ``others`` is (document_id, entity_id, no). A hub's names are dealt over several lists of about ``hub_size``.
    """
    hubs = hub_groups(others, "document_id", hub_size)
    key = ["document_id"]
    if not hubs.isEmpty():
        parts = stored(hubs.select("document_id", F.ceil(F.col("group_size") / F.lit(hub_size)).cast("int").alias("_n")), "hub-parts")
        n = F.coalesce("_n", F.lit(1))
        others = others.join(parts, "document_id", "left").withColumn("_part", F.pmod(F.xxhash64("no"), n).cast("int")).drop("_n")
        own = own.join(parts, "document_id", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1))).drop("_n")
        key = ["document_id", "_part"]
    lists = (
        others.repartition(*key).groupBy(*key, "no")
        .agg(F.min("entity_id").alias("low"), F.max("entity_id").alias("high"))
        .groupBy(*key).agg(F.collect_list(F.struct("no", "low", "high")).alias("_l"))
    )
    apart = F.filter("_l", lambda x: (x["low"] != F.col("entity_id")) | (x["high"] != F.col("entity_id")))
    met = own.join(lists, key).select(F.col("entity_id").alias("item1"), F.transform(apart, lambda x: x["no"]).alias("others"))
    return met.where(F.size("others") > 0)


def entity_documents(mentions: DataFrame, documents: DataFrame, k: int = 50) -> DataFrame:
    """Newest ``k`` documents of every entity; undated ones last."""
    attributes = documents.select(
        F.col("id").alias("document_id"), "doc_id", "document_type", "summary", "date_earliest", "date_latest"
    )
    joined = mentions.select("document_id", "entity_id").join(attributes, "document_id")
    order = [F.desc_nulls_last("date_earliest"), F.asc("document_id")]
    return top_k_per_group(joined, ["entity_id"], order, k, "rank")


def document_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities of every document with their place: most mentioned first, unknown counts before all."""
    attributes = entities.select(F.col("id").alias("entity_id"), "canonical_name", "entity_type", "layer")
    return (
        mentions.select("document_id", "entity_id", "mention_count")
        .join(attributes, "entity_id")
        .withColumn("place", F.row_number().over(
            Window.partitionBy("document_id").orderBy(F.desc_nulls_first("mention_count"), "entity_id")))
    )


def entity_stats(mentions: DataFrame, hub_size: int = HUB_SIZE) -> DataFrame:
    """(id, document_count, connection_count) of every mentioned entity."""
    documents = mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("document_count"))
    degrees = neighbour_counts(mentions, "document_id", "entity_id", hub_size)
    return documents.join(degrees, "entity_id", "left").select(
        F.col("entity_id").alias("id"),
        "document_count",
        F.coalesce("neighbours", F.lit(0)).alias("connection_count"),
    )


def with_stats(entities: DataFrame, mentions: DataFrame, hub_size: int = HUB_SIZE) -> DataFrame:
    """Entities with freshly counted documents and connections."""
    bare = entities.drop("document_count", "connection_count")
    joined = bare.join(entity_stats(mentions, hub_size), "id", "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("document_count", "connection_count")}
    )


def comention_by_type(
    mentions: DataFrame, documents: DataFrame, document_type: str, hub_size: int = HUB_SIZE
) -> DataFrame:
    """Pairs, both ways round, and the number of documents of one type they share."""
    kept = documents.where(F.col("document_type") == document_type).select(F.col("id").alias("document_id"))
    pairs = cooccurrence(mentions.join(kept, "document_id", "left_semi"), 1, hub_size)
    return mirrored(pairs, "source", "target").withColumnRenamed("weight", "shared_documents")
