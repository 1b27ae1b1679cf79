"""Top-k per group and the ordered, limited lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from casegraph.functions.text import trigram_similarity
from casegraph.operators.filters import ilike_any, of_types, opt_filter, trigram_match

PEOPLE_AND_ORGS = ["person", "organization"]


def _limit(k: int) -> int:
    if not isinstance(k, int) or k < 0:
        raise ValueError(f"limit must be a non-negative integer, got {k!r}")
    return k


def top_k_per_group(
    df: DataFrame, group: list[str], order: list[Column], k: int, rank: str | None = None
) -> DataFrame:
    """First ``k`` rows of every group; Spark prunes each task's share before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= k)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")


def list_documents(
    documents: DataFrame, document_type: str | None = None, dataset: int | None = None,
    k: int = 50, offset: int = 0, after: str | None = None,
) -> DataFrame:
    """Page of documents by doc_id; ``after`` starts behind a known key without skipping rows."""
    page = opt_filter(documents, document_type=document_type, dataset_id=dataset)
    if after is not None:
        page = page.where(F.col("doc_id") > after)
    return page.orderBy("doc_id").offset(offset).limit(_limit(k))


def search_entities(
    entities: DataFrame, query: str = "", entity_type: str | None = None,
    layer: int | None = None, k: int = 20,
) -> DataFrame:
    """Entities whose name contains or resembles the query, most similar first."""
    found = opt_filter(entities, entity_type=entity_type, layer=layer)
    name = F.col("canonical_name")
    if query:
        found = found.where(ilike_any(name, query) | trigram_match(name, query))
    score = trigram_similarity(name, query) if query else F.lit(0.0)
    return (
        found.withColumn("score", score)
        .orderBy(F.desc("score"), F.desc_nulls_first("document_count"), "id")
        .limit(_limit(k))
    )


def search_registry(
    registry: DataFrame, name_col: str, amount_col: str, query: str = "",
    filter_col: str | None = None, filter_query: str = "", k: int = 50,
) -> DataFrame:
    """Registry rows whose name contains or resembles the query, then by amount."""
    name, found = F.col(name_col), registry
    if query:
        found = found.where(trigram_match(name, query) | ilike_any(name, query))
    if filter_col and filter_query:
        found = found.where(ilike_any(F.col(filter_col), filter_query))
    rank = trigram_similarity(name, query) if query else F.lit(0.0)
    return (
        found.withColumn("score", rank)
        .orderBy(F.desc("score"), F.desc_nulls_last(amount_col), "id")
        .limit(_limit(k))
    )


def network_nodes(entities: DataFrame, min_conn: int = 2, k: int = 1000) -> DataFrame:
    """Best-connected people and organizations."""
    return (
        of_types(entities, PEOPLE_AND_ORGS)
        .where(F.col("connection_count") >= min_conn)
        .orderBy(F.desc("connection_count"), "id")
        .limit(_limit(k))
    )


def entities_by_layer(entities: DataFrame, k: int = 100, layers: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """Best-connected people and organizations of every layer, in one pass."""
    pool = of_types(entities, PEOPLE_AND_ORGS).where(F.col("layer").isin(*layers))
    return top_k_per_group(pool, ["layer"], [F.desc_nulls_first("connection_count"), F.asc("id")], k, "rank")


def list_findings(
    findings: DataFrame, status: str | None = None, pattern_type: str | None = None, k: int = 100
) -> DataFrame:
    """Newest findings first."""
    return (
        opt_filter(findings, status=status, pattern_type=pattern_type)
        .orderBy(F.desc_nulls_first("discovered_at"), "id")
        .limit(_limit(k))
    )
