"""Merging batches into tables, resolving triples to entities, and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from casegraph.functions.text import name_key, parse_date
from casegraph.operators.filters import concat_aliases
from casegraph.sources.analyses import listed_entities, listed_triples
from casegraph.sources.bucketed import BucketedTable
from casegraph.workspace import stored

ENTITY_ROWS = "id BIGINT, canonical_name STRING, entity_type STRING, aliases ARRAY<STRING>, description STRING"
MENTION_ROWS = "document_id BIGINT, entity_id BIGINT, mention_count INT, context_snippet STRING"


def upsert_documents(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Target with new documents; a known document only takes a new text that is not null.

    ``batch`` has one row per doc_id and may lack columns of the target.
    """
    known = target.withColumn("_known", F.lit(True)).alias("t")
    joined = known.join(batch.alias("b"), F.col("t.doc_id") == F.col("b.doc_id"), "full_outer")
    columns = []
    for c, kind in target.dtypes:
        new = F.col(f"b.{c}") if c in batch.columns else F.lit(None).cast(kind)
        if c in ("doc_id", "full_text"):
            first, second = (F.col("t.doc_id"), new) if c == "doc_id" else (new, F.col("t.full_text"))
            columns.append(F.coalesce(first, second).alias(c))
        else:
            columns.append(F.when(F.col("t._known"), F.col(f"t.{c}")).otherwise(new).alias(c))
    return joined.select(*columns)


def apply_analysis(documents: DataFrame, parsed: DataFrame, analysed: DataFrame) -> DataFrame:
    """Documents with the status of their analysis and, where complete, its fields."""
    status = parsed.select("doc_id", "analysis_status", "error_message")
    fields = [c for c in analysed.columns if c in documents.columns and c not in ("doc_id", "analysis_status", "id")]
    news = status.join(analysed.select("doc_id", *fields), "doc_id", "left").select(
        "doc_id", F.struct("analysis_status", "error_message", *fields).alias("_n")
    )
    joined = documents.join(news, "doc_id", "left")
    changes = {c: F.when(F.col("_n.analysis_status") == "complete", F.col(f"_n.{c}")).otherwise(F.col(c)) for c in fields}
    for c in ("analysis_status", "error_message"):
        changes[c] = F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c))
    return joined.withColumns(changes).select(*documents.columns)


def entity_id(name: Column, entity_type: Column) -> Column:
    """Stable 64-bit id of an entity key; ``id_collisions`` finds the rare clash."""
    return F.xxhash64(name, entity_type)


def id_collisions(entities: DataFrame) -> DataFrame:
    """Ids that two different (name, type) keys share; empty in a sound table."""
    keys = F.count_distinct("canonical_name", "entity_type")
    return entities.groupBy("id").agg(keys.alias("keys")).where("keys > 1")


def upsert_entities(
    target: DataFrame | None, batch: DataFrame, dedup: bool = False, order: str | None = None
) -> DataFrame:
    """(id, canonical_name, entity_type, aliases, description) keyed by exact name and type.

    Alias lists are joined, existing ones first and those of the batch by ``order`` (a column of the
    batch); the first description stays. Equal lists of a key at one place of the order join once.
    """
    place = [order] if order else []
    lists = F.when(F.size("aliases") > 0, F.struct(*place, "aliases"))
    said = F.when(F.col("description").isNotNull(), F.struct(*place, "description"))
    merged = batch.groupBy("canonical_name", "entity_type").agg(
        F.flatten(F.transform(F.array_sort(F.collect_set(lists)), lambda x: x["aliases"])).alias("aliases"),
        F.min(said)["description"].alias("description"),
    )
    merged = merged.withColumn("id", entity_id(F.col("canonical_name"), F.col("entity_type")))
    if target is None:
        aliases = F.array_distinct("aliases") if dedup else F.col("aliases")
        return merged.select("id", "canonical_name", "entity_type", aliases.alias("aliases"), "description")
    keys = ["canonical_name", "entity_type"]
    new = merged.select(*keys, F.struct("id", "aliases", "description").alias("_b"))
    rest = [c for c in target.columns if c not in (*keys, "id", "aliases", "description")]
    joined = target.withColumn("_known", F.lit(True)).join(new, keys, "full_outer")
    return joined.select(
        F.coalesce("id", "_b.id").alias("id"),
        *keys,
        concat_aliases(F.col("aliases"), F.col("_b.aliases"), dedup).alias("aliases"),
        F.when(F.col("_known"), F.col("description")).otherwise(F.col("_b.description")).alias("description"),
        *rest,
    )


def entity_batch(parsed: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Entity rows to upsert: everything listed, and what only triples named."""
    names = listed_entities(parsed).select("name", "entity_type")
    if resolved is not None:
        names = names.unionByName(resolved.select("name", "entity_type"))
    return names.distinct().select(
        F.col("name").alias("canonical_name"), "entity_type",
        F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("description"),
    )


def link_mentions(listed: DataFrame) -> DataFrame:
    """(document_id, entity_id, mention_count, context_snippet) from an entity list.

    Every occurrence in a document's list counts one; the first occurrence gives the snippet.
    """
    return (
        listed.withColumn("entity_id", entity_id(F.col("name"), F.col("entity_type")))
        .groupBy("document_id", "entity_id")
        .agg(
            F.count(F.lit(1)).cast("int").alias("mention_count"),
            F.min_by(F.struct("context"), "pos")["context"].alias("context_snippet"),
        )
    )


def merge_counts(mentions: DataFrame, order: str | None = None) -> DataFrame:
    """Mention rows of several loads, one per document and entity; counts add up.

    The snippet is the first one in ``order`` (a batch number), the smallest among equals.
    """
    snippet = F.struct(*([order] if order else []), "context_snippet")
    return mentions.groupBy("document_id", "entity_id").agg(
        F.sum("mention_count").cast("int").alias("mention_count"),
        F.min(F.when(F.col("context_snippet").isNotNull(), snippet))["context_snippet"].alias("context_snippet"),
    )


def resolve_endpoints(parsed: DataFrame) -> DataFrame:
    """(document_id, sequence_order, role, name, entity_type) for every triple endpoint.

    Inside a document names are matched without case: the last listed entity of that name wins,
    whatever its type. A name that is not listed becomes an entity with the spelling and type of
    its first use, which later uses share. A document lies in one row, so nothing is shuffled for
    that; only rows whose document id repeats meet in a window per document and name.
    """
    complete = parsed.where("analysis_status = 'complete'").select("document_id", "analysis")
    twice = stored(complete.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("document_id"), "repeated")
    if twice.isEmpty():
        return _resolved_in_rows(complete)
    again = twice.withColumnRenamed("document_id", "_id")
    same = F.col("document_id").eqNullSafe(F.col("_id"))
    rest = complete.join(again, same, "left_semi").withColumn("analysis_status", F.lit("complete"))
    return _resolved_in_rows(complete.join(again, same, "left_anti")).unionByName(_resolved_by_window(rest))


def _uses(t: Column, order: Column) -> Column:
    """The endpoints of a triple, in the order in which they are used."""
    at = order * 3
    return F.array(
        F.struct(F.lit("subject").alias("role"), at.alias("at"), t["subject"].alias("name"), t["subjectType"].alias("entity_type")),
        F.struct(F.lit("object").alias("role"), (at + 1).alias("at"), t["object"].alias("name"), t["objectType"].alias("entity_type")),
        F.struct(F.lit("location").alias("role"), (at + 2).alias("at"), t["location"].alias("name"), F.lit("location").alias("entity_type")),
    )


def _resolved_in_rows(complete: DataFrame) -> DataFrame:
    """``resolve_endpoints`` where every row is a document of its own."""

    def keyed(name: Column) -> Column:
        return F.coalesce(F.concat(F.lit("="), name_key(name)), F.lit(""))

    used = F.filter(
        F.flatten(F.transform("analysis.triples", _uses)), lambda u: (u["role"] != "location") | (u["name"] != ""))
    listed = F.reverse(F.transform("analysis.entities", lambda e: F.struct(e["name"].alias("name"), e["type"].alias("entity_type"))))
    rows = complete.select("document_id", used.alias("_u"), listed.alias("_l"))
    rows = rows.select(
        "document_id", "_u", "_l", F.transform("_l", lambda x: keyed(x["name"])).alias("_lk"), F.transform("_u", lambda u: keyed(u["name"])).alias("_uk"))
    # the place of the key among the listed names from the last on, and among the names used
    use = rows.select("document_id", "_u", "_l", "_lk", "_uk", F.posexplode("_u").alias("_i", "u"))
    own = F.get("_uk", F.col("_i"))
    last, first = F.coalesce(F.array_position("_lk", own), F.lit(0)), F.array_position("_uk", own)
    met = F.get("_u", (first - 1).cast("int"))
    entity = F.when(last > 0, F.get("_l", (last - 1).cast("int"))).otherwise(
        F.struct(met["name"].alias("name"), met["entity_type"].alias("entity_type")))
    return use.select("document_id", F.floor(F.col("u.at") / 3).cast("int").alias("sequence_order"), "u.role", entity.alias("_e")).select(
        "document_id", "sequence_order", "role", F.col("_e.name").alias("name"), F.col("_e.entity_type").alias("entity_type"))


def _resolved_by_window(parsed: DataFrame) -> DataFrame:
    """``resolve_endpoints`` where rows may share a document: listed names and uses of a name meet in one window."""
    uses = listed_triples(parsed).select(
        "document_id", "sequence_order", F.explode(_uses(F.col("t"), F.col("sequence_order"))).alias("u")).select("document_id", "sequence_order", "u.*")
    uses = uses.where((F.col("role") != "location") | (F.col("name") != ""))
    listed = listed_entities(parsed).select(
        "document_id", F.lit(None).cast("int").alias("sequence_order"), F.lit("listed").alias("role"),
        F.col("pos").alias("at"), "name", "entity_type",
    )
    both = listed.unionByName(uses).withColumn("_key", name_key(F.col("name")))
    same = Window.partitionBy("document_id", "_key")
    entity = F.struct("name", "entity_type")
    is_listed = F.col("role") == "listed"
    chosen = F.coalesce(
        F.max_by(F.when(is_listed, entity), F.when(is_listed, F.col("at"))).over(same),
        F.min_by(entity, F.col("at")).over(same),
    )
    return both.withColumn("_e", chosen).where(~is_listed).select(
        "document_id", "sequence_order", "role",
        F.col("_e.name").alias("name"), F.col("_e.entity_type").alias("entity_type"),
    )


def load_triples(parsed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Triple table: endpoints as entity ids, array position as order."""
    ids = resolved.withColumn("_id", entity_id(F.col("name"), F.col("entity_type")))
    roles = {r: F.max(F.when(F.col("role") == r, F.col("_id"))) for r in ("subject", "object", "location")}
    ends = ids.groupBy("document_id", "sequence_order").agg(*[c.alias(f"{r}_id") for r, c in roles.items()])
    details = listed_triples(parsed).select(
        "document_id", "sequence_order", F.col("t.predicate").alias("predicate"),
        parse_date(F.when(F.col("t.timestamp") != "", F.col("t.timestamp"))).alias("timestamp"),
        F.col("t.explicitTopic").alias("explicit_topic"), F.col("t.implicitTopic").alias("implicit_topic"),
        F.coalesce("t.tags", F.array().cast("array<string>")).alias("tags"),
    )
    return details.join(ends, ["document_id", "sequence_order"]).select(
        "document_id", "subject_id", "predicate", "object_id", "location_id", "timestamp",
        "explicit_topic", "implicit_topic", "tags", F.lit(1.0).alias("confidence"), "sequence_order",
    )


def document_store(spark: SparkSession, folder: str, schema: str, buckets: int = 64) -> BucketedTable:
    """A stored document table that ``upsert_documents`` changes by batches, keyed by doc_id."""
    return BucketedTable(spark, folder, schema, ["doc_id"], buckets)


def merge_documents(store: BucketedTable, batch: DataFrame, name: str) -> list[int]:
    """Upsert a batch of documents into a store; only the buckets of its doc_ids are rewritten."""
    return store.merge(batch, upsert_documents, name)


def entity_store(spark: SparkSession, folder: str, buckets: int = 64) -> BucketedTable:
    """A stored entity table, keyed by exact name and type."""
    return BucketedTable(spark, folder, ENTITY_ROWS, ["canonical_name", "entity_type"], buckets)


def merge_entities_into(store: BucketedTable, batch: DataFrame, name: str, dedup: bool = False) -> list[int]:
    """Upsert a batch of entities into a store; only the buckets of its keys are rewritten."""
    return store.merge(batch, lambda held, new: upsert_entities(held, new, dedup), name)


def mention_store(spark: SparkSession, folder: str, buckets: int = 64) -> BucketedTable:
    """A stored mention table, kept by document."""
    return BucketedTable(spark, folder, MENTION_ROWS, ["document_id"], buckets)


def merge_mentions(store: BucketedTable, batch: DataFrame, name: str) -> list[int]:
    """Add a batch of mention counts to a store; the snippet that was there first stays."""

    def combine(held: DataFrame, new: DataFrame) -> DataFrame:
        return merge_counts(held.withColumn("load", F.lit(0)).unionByName(new.withColumn("load", F.lit(1))), "load")

    return store.merge(batch, combine, name)


def save_findings(hypotheses: DataFrame, entities: DataFrame, key: str = "id") -> DataFrame:
    """Findings with entity ids by exact name: every type of a name, nothing for unknown names."""
    names = hypotheses.select(key, F.explode(F.array_distinct("entity_names")).alias("canonical_name"))
    ids = (
        names.join(entities.select(F.col("id").alias("_id"), "canonical_name"), "canonical_name")
        .groupBy(key)
        .agg(F.array_sort(F.collect_set("_id")).alias("entity_ids"))
    )
    return hypotheses.join(ids, key, "left").select(
        key, "title", "description", "pattern_type",
        F.coalesce("entity_ids", F.array().cast("array<bigint>")).alias("entity_ids"),
        F.struct(F.col("entity_names").alias("entityNames"), F.col("evidence").alias("evidencePoints")).alias("evidence"),
        "confidence", F.lit("hypothesis").alias("status"),
    )


def node(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def props(**columns: Column) -> Column:
    return F.map_from_arrays(
        F.array(*map(F.lit, columns)), F.array(*[c.cast("string") for c in columns.values()])
    )


def entity_nodes(entities: DataFrame) -> DataFrame:
    """Entities as (id, label, props) nodes of the graph."""
    return entities.select(
        node("e", "id").alias("id"), F.initcap("entity_type").alias("label"),
        props(name=F.col("canonical_name"), layer=F.col("layer")).alias("props"),
    )


def graph_tables(
    entities: DataFrame, documents: DataFrame, mentions: DataFrame, edges: DataFrame,
    triples: DataFrame, matches: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """The graph as (id, label, props) nodes and (src, dst, rel, weight, props) edges."""

    nodes = entity_nodes(entities).unionByName(
        documents.select(
            node("d", "id").alias("id"), F.lit("Document").alias("label"),
            props(name=F.col("doc_id"), type=F.col("document_type")).alias("props"),
        )
    )

    def relation(df: DataFrame, src: Column, dst: Column, rel: str, weight: Column, detail: Column) -> DataFrame:
        return df.select(
            src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"),
            weight.cast("double").alias("weight"), detail.alias("props"),
        )

    none = F.lit(None).cast("map<string,string>")
    relations = [
        relation(mentions, node("e", "entity_id"), node("d", "document_id"), "MENTIONED_IN", F.col("mention_count"), none),
        relation(edges, node("e", "source"), node("e", "target"), "CONNECTED_TO", F.col("weight"), none),
        relation(
            triples, node("e", "subject_id"), node("e", "object_id"), "HAS_RELATIONSHIP", F.lit(1.0),
            props(action=F.col("predicate"), document=F.col("document_id")),
        ),
        relation(
            matches, node("e", "entity_id"), F.concat("source", F.lit(":"), F.col("source_id").cast("string")),
            "CROSSREF_MATCH", F.col("match_score"), none,
        ),
    ]
    return nodes, reduce(DataFrame.unionByName, relations)


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None, mode: str = "overwrite") -> None:
    """Export a table; graph edges are usually partitioned by ``rel``."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
