"""Pattern mining over the entity graph: samples, evidence, bursts, gaps, outliers, validation.

The samples, the evidence tables and the finding queries follow existing behaviour. Indirect
pairs, bursts, gaps, timelines, co-location, amounts, density, walks and validation are only named
as goals in the source material; their exact meaning is defined here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from casegraph.operators.cooccurrence import connections_by_name
from casegraph.operators.filters import (
    any_nonempty,
    match_flags,
    of_types,
    union_by_id,
    valid_matches,
    with_defaults,
)
from casegraph.operators.pairs import BLOCK_ROWS, emit_pairs, hub_groups, mirrored, pair_counts, pairs_in_blocks
from casegraph.operators.ranking import PEOPLE_AND_ORGS
from casegraph.workspace import checkpointed, stored

MATCH_LISTS = ["ppp_matches", "fec_matches", "grants_matches"]
COUNTS = ["layer", "document_count", "connection_count"]


def _sample(entities: DataFrame, k: int) -> DataFrame:
    best = entities.orderBy(F.desc_nulls_first("connection_count"), "id").limit(k)
    lists = [c for c in MATCH_LISTS if c in entities.columns]
    counts = [c for c in COUNTS if c in entities.columns]
    return with_defaults(best, counts, lists).select(
        "id", "canonical_name", "entity_type", *counts, *lists
    )


def high_degree_sample(entities: DataFrame, k: int = 50) -> DataFrame:
    """Best-connected people and organizations."""
    return _sample(of_types(entities, PEOPLE_AND_ORGS), k)


def cross_referenced_sample(entities: DataFrame, k: int = 100) -> DataFrame:
    """Best-connected entities with a match in any registry."""
    return _sample(any_nonempty(entities, MATCH_LISTS), k)


def hub_connections(
    mentions: DataFrame, entities: DataFrame, hubs: int = 10, k: int = 50
) -> DataFrame:
    """Connections of the best-connected entities, ordered by hub and strength, in one join."""
    sample = high_degree_sample(entities, 50)
    # The sample holds at most 50 rows, so an unpartitioned rank over it is small.
    ranked = sample.withColumn(
        "hub_rank", F.row_number().over(Window.orderBy(F.desc("connection_count"), F.asc("id")))
    ).where(F.col("hub_rank") <= hubs)
    found = connections_by_name(mentions, entities, ranked.select("id"), k)
    return found.join(ranked.select(F.col("id").alias("entity_id"), "hub_rank"), "entity_id")


def entity_features(high_degree: DataFrame, cross_referenced: DataFrame) -> DataFrame:
    """One evidence row per sampled entity with its registry flags."""
    return match_flags(union_by_id(high_degree, cross_referenced)).select(
        F.col("canonical_name").alias("name"), F.col("entity_type").alias("type"), "layer",
        F.col("document_count").alias("docs"), F.col("connection_count").alias("connections"),
        "has_ppp", "has_fec", "has_grants",
    )


def pair_features(hub_pairs: DataFrame, n: int = 50) -> DataFrame:
    """First ``n`` hub connections; only the first hub's when it has that many."""
    return hub_pairs.orderBy("hub_rank", "rank").limit(n).select("entity1", "entity2", "shared_docs")


def pattern_features(
    entities: DataFrame, mentions: DataFrame, n: int = 50
) -> tuple[DataFrame, DataFrame]:
    """Entity and pair evidence for pattern finding."""
    rows = entity_features(high_degree_sample(entities), cross_referenced_sample(entities))
    return rows, pair_features(hub_connections(mentions, entities), n)


def finding_entities(findings: DataFrame, entities: DataFrame) -> DataFrame:
    """(finding_id, entity attributes) for the entities of every finding."""
    ids = findings.select(F.col("id").alias("finding_id"), F.explode(F.array_distinct("entity_ids")).alias("entity_id"))
    attributes = entities.select(F.col("id").alias("entity_id"), "canonical_name", "entity_type", "layer")
    return ids.join(attributes, "entity_id")


def finding_detail(findings: DataFrame, entities: DataFrame) -> DataFrame:
    """Findings with the list of their entities' attributes."""
    grouped = (
        finding_entities(findings, entities)
        .groupBy("finding_id")
        .agg(F.array_sort(F.collect_list(F.struct("entity_id", "canonical_name", "entity_type", "layer"))).alias("entities"))
    )
    return findings.join(grouped, findings["id"] == grouped["finding_id"], "left").drop("finding_id")


def indirect_pairs(edges: DataFrame, min_shared: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(source, target, shared, jaccard): entities with common neighbours and no edge of their own.

    Neighbour lists play the role of documents. Almost all pairs of entities can have common
    neighbours, so they are counted in blocks, and pairs with an edge are left out there.
    """
    both = mirrored(edges.select("source", "target"), "source", "target")
    pairs = pairs_in_blocks(both, "source", "target", min_shared, apart=True, block_rows=block_rows)
    union = F.col("groups1") + F.col("groups2") - F.col("shared")
    return pairs.select(
        F.col("item1").alias("source"), F.col("item2").alias("target"), "shared", (F.col("shared") / union).alias("jaccard"))


def daily_activity(events: DataFrame) -> DataFrame:
    """(entity_id, day, n) from (entity_id, ts); days are numbered from 1970."""
    day = F.unix_date(F.to_date("ts"))
    return events.groupBy("entity_id", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


def activity_bursts(
    events: DataFrame, window_days: int = 7, factor: float = 3.0, min_count: int = 3
) -> DataFrame:
    """Days with at least ``factor`` times the mean of the ``window_days`` days before.

    Days without events count as zero. The first active day has nothing to compare with and is
    never a burst.
    """
    own = Window.partitionBy("entity_id").orderBy("day")
    earlier = own.rangeBetween(-window_days, -1)
    scored = (
        daily_activity(events)
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("first_day", F.min("day").over(Window.partitionBy("entity_id")))
    )
    return scored.where(
        (F.col("day") > F.col("first_day"))
        & (F.col("n") >= min_count)
        & (F.col("n") * window_days >= F.col("before") * factor)
    ).select(
        "entity_id", F.date_from_unix_date("day").alias("day"), "n",
        (F.col("before") / window_days).alias("trailing_mean"),
    )


def activity_gaps(events: DataFrame, min_days: int = 7) -> DataFrame:
    """Stretches of at least ``min_days`` days between two active days of an entity."""
    days = daily_activity(events)
    previous = F.lag("day").over(Window.partitionBy("entity_id").orderBy("day"))
    return days.withColumn("last", previous).where(F.col("day") - F.col("last") >= min_days).select(
        "entity_id", F.date_from_unix_date("last").alias("gap_from"),
        F.date_from_unix_date("day").alias("gap_to"), (F.col("day") - F.col("last")).alias("days"),
    )


def timeline_correlation(activity: DataFrame, pairs: DataFrame, periods: int) -> DataFrame:
    """(source, target, r): correlation of two entities' activity over ``periods`` periods.

    ``activity`` has (entity_id, period, n), one row per entity and period; a missing period counts
    as zero. Each entity is one vector of at most ``periods`` entries, and a pair is one row with
    two of them, so pairs are never multiplied by periods. Periods are numbered, so that the entries of
    one vector are looked up in the other by their place.
    """
    kept = activity.where("period is not null")
    place = (F.row_number().over(Window.orderBy("period")) - 1).alias("place")  # of distinct periods, as many as a vector is long
    numbers = stored(kept.select("period").distinct().select("period", place), "periods")
    ends = pairs.select(F.explode(F.array("source", "target")).alias("entity_id")).distinct()
    vectors = stored(
        kept.join(numbers, "period").join(ends, "entity_id", "left_semi").groupBy("entity_id").agg(
            F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"),
            F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("v")),
        "vectors",
    )
    places = F.sequence(F.lit(0), F.lit(numbers.count() - 1))
    whole = F.transform(places, lambda i: F.coalesce(F.try_element_at("v", i), F.lit(0)))
    joined = (
        pairs.select("source", "target")
        .join(vectors.selectExpr("entity_id AS source", "s AS s1", "q AS q1", "v AS v1"), "source")
        .join(vectors.select(F.col("entity_id").alias("target"), F.col("s").alias("s2"), F.col("q").alias("q2"), whole.alias("v2")), "target")
    )
    product = F.aggregate(
        F.map_entries("v1"), F.lit(0).cast("bigint"), lambda total, x: total + x["value"] * F.get("v2", x["key"]))
    n = F.lit(periods)
    covariance = n * product - F.col("s1") * F.col("s2")
    spread = (n * F.col("q1") - F.col("s1") * F.col("s1")).cast("double") * (
        n * F.col("q2") - F.col("s2") * F.col("s2")
    )
    return joined.where(spread > 0).select("source", "target", (covariance / F.sqrt(spread)).alias("r"))


def colocated(triples: DataFrame, min_events: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(source, target, events): entities at the same place on the same date.

    Places and dates grow less than triples do, so an event holds ever more entities: they are counted in blocks.
    """
    event = ["location_id", "timestamp"]
    present = triples.where(F.col("location_id").isNotNull() & F.col("timestamp").isNotNull()).select(
        *event, F.explode(F.array("subject_id", "object_id")).alias("entity_id"))
    present = stored(present.distinct(), "present")
    events = stored(present.select(*event).distinct().withColumn("event", F.monotonically_increasing_id()), "events")
    found = pairs_in_blocks(present.join(events, event), "event", "entity_id", min_events, block_rows=block_rows)
    return found.select(
        F.col("item1").alias("source"), F.col("item2").alias("target"), F.col("shared").alias("events")
    )


def amount_clusters(
    matches: DataFrame, registry: DataFrame, amount_col: str, date_col: str, period: str = "month",
    min_records: int = 3,
) -> DataFrame:
    """Entities with several matched registry amounts in one period."""
    amounts = registry.select(
        F.col("id").alias("source_id"), F.col(amount_col).alias("amount"),
        F.trunc(date_col, period).alias("period"),
    )
    return (
        valid_matches(matches).select("entity_id", "source_id").join(amounts, "source_id")
        .groupBy("entity_id", "period")
        .agg(F.count(F.lit(1)).alias("records"), F.sum("amount").alias("total"), F.max("amount").alias("largest"))
        .where(F.col("records") >= min_records)
    )


def money_flows(payments: DataFrame, window: int = 7, least_share: float = 0.5, steps: int = 4) -> DataFrame:
    """(source, target, steps, path, amount, first_day, last_day, returns): money passed on, in 2 to ``steps`` payments.

    ``payments`` is (payment, payer, payee, day, amount) with distinct payment ids. Who receives a
    payment passes it on by one of at least ``least_share`` of its amount and not more than it, on a
    later day within ``window`` days. ``amount`` is the least on the path, ``returns`` tells whether
    it comes back to its source. Payments meet by entity and stretch of days, so a busy entity is
    spread over time; days only go forward, so no payment is used twice.
    """
    stretch = F.floor(F.unix_date("day") / F.lit(window))
    out = payments.where("payer IS NOT NULL AND payee IS NOT NULL AND amount IS NOT NULL AND day IS NOT NULL").select(
        "payment", "payer", "payee", "day", "amount", stretch.alias("stretch"))
    passed = out.select(
        F.col("payer").alias("q"), "stretch", F.col("payment").alias("next"), F.col("payee").alias("to"), F.col("day").alias("on"), F.col("amount").alias("sum"))
    paths = out.select(
        F.col("payer").alias("source"), F.col("payee").alias("target"), F.lit(1).alias("steps"), F.array("payment").alias("path"), "amount",
        F.col("amount").alias("last_amount"), F.col("day").alias("first_day"), F.col("day").alias("last_day"))
    found = []
    for _ in range(steps - 1):
        # the next payment lies in the stretch of the last one or in the one after it
        begin = F.floor(F.unix_date("last_day") / F.lit(window))
        waiting = paths.withColumn("stretch", F.explode(F.array(begin, begin + 1)))
        met = waiting.join(passed, (F.col("target") == F.col("q")) & (waiting["stretch"] == passed["stretch"])).where(
            (F.col("on") > F.col("last_day")) & (F.datediff("on", "last_day") <= window)
            & (F.col("sum") <= F.col("last_amount")) & (F.col("sum") >= F.col("last_amount") * least_share))
        paths = checkpointed(met.select(
            "source", F.col("to").alias("target"), (F.col("steps") + 1).alias("steps"), F.concat("path", F.array("next")).alias("path"),
            F.least("amount", "sum").alias("amount"), F.col("sum").alias("last_amount"), "first_day", F.col("on").alias("last_day")))
        found.append(paths)
    every = found[0]
    for longer in found[1:]:
        every = every.unionByName(longer)
    return every.drop("last_amount").withColumn("returns", F.col("source") == F.col("target"))


def core_numbers(edges: DataFrame) -> DataFrame:
    """(id, degree, core): the largest k for which an entity lies in a group whose members have k neighbours in it.

    Starting with the degree, every round takes the largest h of which h neighbours have h or more,
    until nothing changes; that is the core number. Neighbours are counted by value, and no value
    above one's own matters, so a hub holds at most as many counts as its own value.
    """
    plain = edges.where("source <> target").select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
    both = checkpointed(mirrored(plain, "source", "target"))
    degree = both.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    state = checkpointed(degree.withColumn("core", F.col("degree")))
    below = Window.partitionBy("id").orderBy(F.desc("value"))
    total = state.agg(F.sum("core")).first()[0]
    while total is not None:
        value = state.select(F.col("id").alias("target"), F.col("core").alias("theirs"))
        counts = (
            both.join(value, "target").select(F.col("source").alias("id"), "theirs")
            .join(state.select("id", F.col("core").alias("own")), "id")
            .groupBy("id", F.least("theirs", "own").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        )
        best = counts.withColumn("reached", F.sum("n").over(below)).groupBy("id").agg(F.max(F.least("value", "reached")).alias("core"))
        state = checkpointed(degree.join(best, "id"))
        now = state.agg(F.sum("core")).first()[0]
        if now == total:
            break
        total = now
    return state.select("id", "degree", "core")


def clustering(edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, density): share of an entity's neighbour pairs that are connected.

    Every edge points to its better-connected end, so no node has more than sqrt(2 * edges)
    outgoing edges and hubs are never expanded.
    """
    plain = edges.select("source", "target")
    degree = mirrored(plain, "source", "target").groupBy("source").agg(F.count(F.lit(1)).alias("degree"))
    ranked = plain.join(degree.withColumnRenamed("degree", "d1"), "source").join(
        degree.select(F.col("source").alias("target"), F.col("degree").alias("d2")), "target"
    )
    forward = (F.col("d1") < F.col("d2")) | ((F.col("d1") == F.col("d2")) & (F.col("source") < F.col("target")))
    one_end = F.struct(F.col("d1").alias("d"), F.col("source").alias("id"))
    other_end = F.struct(F.col("d2").alias("d"), F.col("target").alias("id"))
    directed = ranked.select(
        F.when(forward, one_end).otherwise(other_end).alias("u"),
        F.when(forward, other_end).otherwise(one_end).alias("v"),
    ).select(F.col("u.id").alias("u"), F.col("v.id").alias("v"), F.col("v.d").alias("dv"))
    one = directed.select("u", F.col("v").alias("a"), F.col("dv").alias("da"))
    two = directed.select("u", F.col("v").alias("b"), F.col("dv").alias("db"))
    wedges = one.join(two, "u").where(
        (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    )
    closed = wedges.join(
        directed.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_semi"
    )
    triangles = (
        closed.select(F.explode(F.array("u", "a", "b")).alias("source"))
        .groupBy("source").agg(F.count(F.lit(1)).alias("triangles"))
    )
    possible = F.col("degree") * (F.col("degree") - 1) / 2
    return (
        degree.where("degree >= 2").join(triangles, "source", "left")
        .withColumn("triangles", F.coalesce("triangles", F.lit(0)))
        .select(F.col("source").alias("id"), "degree", "triangles", (F.col("triangles") / possible).alias("density"))
    )


def density_outliers(edges: DataFrame, z: float = 2.0) -> DataFrame:
    """Entities whose neighbourhood is unusually dense or sparse, by standard score."""
    scored = checkpointed(clustering(edges))
    mean = scored.agg(F.avg("density")).scalar()
    deviation = scored.agg(F.stddev_pop("density")).scalar()
    return (
        scored.withColumn("z", F.try_divide(F.col("density") - mean, deviation))
        .where(F.abs("z") >= z)
    )


def focus_mentions(
    mentions: DataFrame, documents: DataFrame, date_from: str | None = None, date_to: str | None = None,
    document_type: str | None = None,
) -> DataFrame:
    """Mentions in documents whose dates overlap a range and which have a type."""
    kept = documents
    if date_from:
        kept = kept.where(F.coalesce("date_latest", "date_earliest") >= F.lit(date_from).cast("date"))
    if date_to:
        kept = kept.where(F.coalesce("date_earliest", "date_latest") <= F.lit(date_to).cast("date"))
    if document_type:
        kept = kept.where(F.col("document_type") == document_type)
    return mentions.join(kept.select(F.col("id").alias("document_id")), "document_id", "left_semi")


def focus_subgraph(edges: DataFrame, entity: int) -> DataFrame:
    """Edges among one entity and its neighbours."""
    around = edges.where((F.col("source") == entity) | (F.col("target") == entity))
    members = around.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return edges.join(members.withColumnRenamed("id", "source"), "source", "left_semi").join(
        members.withColumnRenamed("id", "target"), "target", "left_semi"
    ).select(*edges.columns)


def validate_findings(findings: DataFrame, mentions: DataFrame, min_share: float = 0.5) -> DataFrame:
    """(id, pairs, supported, documents, confidence, status) from the documents behind a finding.

    A pair of a finding's entities is supported when some document mentions both. A finding is
    validated when at least ``min_share`` of its pairs are, and rejected otherwise.
    """
    named = stored(findings.select("id", F.explode(F.array_distinct("entity_ids")).alias("entity_id")), "named")
    pairs = emit_pairs(named, "id", "entity_id", hub_groups(named, "id")).select(
        "id", F.col("item1").alias("a"), F.col("item2").alias("b"))
    # paired inside each document, among the entities that findings name
    kept = mentions.join(named.select("entity_id").distinct(), "entity_id", "left_semi")
    support = pair_counts(kept, "document_id", "entity_id").select(
        F.col("item1").alias("a"), F.col("item2").alias("b"), F.col("shared").alias("n"))
    per_finding = (
        pairs.join(support, ["a", "b"], "left")
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("pairs"), F.count("n").alias("supported"), F.coalesce(F.sum("n"), F.lit(0)).alias("documents"))
    )
    share = F.coalesce(F.try_divide(F.col("supported").cast("double"), F.col("pairs")), F.lit(0.0))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("pairs", "supported", "documents")}
    return (
        findings.select("id").join(per_finding, "id", "left").withColumns(zero)
        .withColumn("confidence", share)
        .withColumn("status", F.when(F.col("confidence") >= min_share, "validated").otherwise("rejected"))
    )
