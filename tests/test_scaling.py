"""Pair counting by lists, similarity signatures, rarest-term search and typing errors, held against brute force."""

import random
import re
from collections import Counter
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from casegraph.operators import cooccurrence, pairs, patterns, search, similarity, traversal, typos
from casegraph.operators.search_index import SearchIndex
from casegraph.sources import analyses
from casegraph.workspace import stored


def _membership(spark):
    rng = random.Random(3)
    groups = {g: rng.sample(range(40), rng.choice([0, 1, 2, 3, 5, 12])) for g in range(60)}
    rows = [(g, x) for g, items in groups.items() for x in items]
    return groups, spark.createDataFrame([*rows, (None, 1), (None, 2), (7, None)], "g bigint, x bigint")


@pytest.mark.parametrize("hub_size", [2_000, 4])
@pytest.mark.parametrize("hot", [200_000, 8])
def test_pairs_are_counted_exactly(spark, monkeypatch, hub_size, hot):
    monkeypatch.setattr(pairs, "HOT_ITEM", hot)
    groups, rows = _membership(spark)
    shared = Counter(p for items in groups.values() for p in combinations(sorted(items), 2))
    for least in (1, 2, 3):
        got = {(r.item1, r.item2): r.shared for r in pairs.pair_counts(rows, "g", "x", least, hub_size).collect()}
        assert got == {p: n for p, n in shared.items() if n >= least}
    degree = Counter(x for p in shared for x in p)
    assert {r.x: r.neighbours for r in pairs.neighbour_counts(rows, "g", "x", hub_size).collect()} == dict(degree)
    assert {tuple(r) for r in pairs.distinct_pairs(rows, "g", "x", hub_size).collect()} == set(shared)


@pytest.mark.parametrize("block_rows", [4_000_000, 10])
def test_pairs_in_blocks_are_counted_exactly(spark, block_rows):
    groups, rows = _membership(spark)
    shared = Counter(p for items in groups.values() for p in combinations(sorted(items), 2))
    size = Counter(x for items in groups.values() for x in items) + Counter([1, 2])  # rows without a group count as one each
    for least in (1, 2, 3):
        got = [tuple(r) for r in pairs.pairs_in_blocks(rows, "g", "x", least, block_rows=block_rows).collect()]
        assert sorted(got) == sorted((a, b, n, size[a], size[b]) for (a, b), n in shared.items() if n >= least)
    edges = sorted({tuple(sorted(p)) for items in groups.values() for p in combinations(items[:3], 2)})
    near = {x: {a + b - x for a, b in edges if x in (a, b)} for x in range(40)}
    want = {(a, b): (len(near[a] & near[b]), len(near[a] & near[b]) / len(near[a] | near[b])) for a, b in combinations(range(40), 2)
            if b not in near[a] and len(near[a] & near[b]) >= 2}
    found = patterns.indirect_pairs(spark.createDataFrame([(b, a) if a % 2 else (a, b) for a, b in edges], "source bigint, target bigint"), 2, block_rows)
    assert {(r.source, r.target): (r.shared, r.jaccard) for r in found.collect()} == want


def test_colocated_and_indirect_pairs_shuffle_no_pairs(spark):
    triples = spark.range(40).selectExpr("id % 2 AS location_id", "date'2024-01-01' AS timestamp", "id AS subject_id", "id + 100 AS object_id")
    edges = spark.range(40).selectExpr("id AS source", "(id * 7 + 1) % 40 AS target").where("source < target")
    for found in (patterns.colocated(triples, 1), patterns.indirect_pairs(edges)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange" not in plan[:plan.index("MapInArrow")]
    assert patterns.colocated(triples, 1).count() == 2 * (40 * 39 // 2)


def test_connection_documents_lists_every_pair_and_document(spark, tmp_path):
    orders = spark.createDataFrame(
        [(1, 5, "F", 10.0, "1-URGENT"), (2, 5, "O", 20.0, "5-LOW")],
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string").withColumn("o_orderdate", F.lit("1996-01-01").cast("timestamp"))
    lines = spark.createDataFrame([(1, 7, 3), (1, 8, 3), (2, 7, 3)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in __spark_entry__.queries()["connection_documents"](spark, str(tmp_path)).select("source", "target", "doc_id").collect()}
    held = {"DOC00000001": [51, 32, 73, 83], "DOC00000002": [51, 32, 73]}
    assert got == {(a, b, doc) for doc, items in held.items() for a, b in combinations(sorted(items), 2)}


def test_postings_of_one_table_are_shuffled_once(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names = spark.createDataFrame([(i, f"trading {i * 7919 % 97:x}{i:04x}{i * 31:x} inc") for i in range(60)], "id bigint, name string")
        found = similarity.similar_pairs(names, "id", "name", hot_token=1)
        found.collect()
        assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_similar_keys_once_gives_each_pair_once(spark):
    rng = random.Random(5)
    codes = ["".join(rng.choices("abcdef", k=12)) for _ in range(40)]
    names = sorted({f"trading {c[:n]} inc" for c in codes for n in (6, 10, 12)})
    keys = spark.createDataFrame([(n, n, True, True) for n in names], "key string, words string, is_left boolean, is_right boolean")

    def grams(text):
        return {f"  {w} "[i:i + 3] for w in text.split() for i in range(len(w) + 1)}

    alike = {(a, b) for a, b in combinations(names, 2) if 10 * len(grams(a) & grams(b)) >= 7 * len(grams(a) | grams(b))}
    for hot in (0, 3, 5_000):
        got = [tuple(sorted((r.lkey, r.rkey))) for r in similarity.similar_keys(keys, 7, 10, hot, once=True).collect()]
        assert len(got) == len(set(got)) and set(got) == alike


def test_unlike_names_with_a_common_token_are_not_shuffled(spark):
    """Four hundred names share every trigram but those of their codes."""
    rng = random.Random(9)
    names = [f"trading {''.join(rng.choices('0123456789abcdef', k=12))}" for _ in range(400)]
    table = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id bigint, name string")
    assert similarity.similar_pairs(table, "id", "name").count() == 0
    keyed = table.select(F.col("name").alias("key"), F.col("name").alias("words"), F.lit(True).alias("is_left"), F.lit(True).alias("is_right"))
    assert similarity.HOT_TOKEN <= 100 and similarity.similar_keys(keyed, 7, 10, once=True).count() == 0


def test_rarest_terms_find_what_all_terms_find(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    texts = {i: [rng.choice(words) for _ in range(rng.randrange(0, 14))] for i in range(80)}
    asked = {q: rng.sample(words, rng.choice([1, 2, 3])) for q in range(20)} | {20: ["w1", "missing"]}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id bigint, full_text string")
    queries = spark.createDataFrame([(q, " ".join(t)) for q, t in asked.items()], "query_id bigint, q string")
    terms = search.query_terms(queries, "simple")
    found = search.match_all_terms(search.build_postings(docs, config="simple", only=terms), terms).collect()
    got = {(r.query_id, r.id): {h.term: h.positions for h in r.hits} for r in found}
    assert got == {(q, i): {w: [p for p, x in enumerate(t, 1) if x == w] for w in a}
                   for q, a in asked.items() for i, t in texts.items() if set(a) <= set(t)}


def test_typing_errors_meet_once_in_hubs_too(spark):
    rng = random.Random(4)
    names = sorted({"".join(rng.choices("ab", k=rng.randrange(1, 6))) for _ in range(40)})
    table = spark.createDataFrame([(n,) for n in names], "name string")
    from casegraph.functions.edits import edits

    want = {(a, b, edits(a, b)) for a, b in combinations(names, 2) if edits(a, b) <= 2}
    for hub_size in (2_000, 3):
        got = [tuple(r) for r in typos.typo_pairs(table, "name", 2, hub_size=hub_size).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_hops_broadcast_a_small_frontier(spark):
    """The edges of a chain are read by every round; a stored frontier has a known, small size."""
    edges = spark.range(6).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    nodes = spark.range(8)
    got = {r.id: r.hops for r in traversal.hop_distance(nodes, edges, 0).collect()}
    assert got == {**{i: i for i in range(7)}, 7: None}
    frontier = stored(nodes.where("id = 0"), "frontier")
    joined = frontier.join(edges, frontier["id"] == edges["source"])
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_index_gathers_asked_words_once_for_all_queries(spark, tmp_path):
    """Queries that ask for the same words share the postings; a document may lack its id or have two rows."""
    texts = [(i, f"alpha beta w{i % 3} alpha") for i in range(30)] + [(None, "alpha beta beta"), (0, "beta alpha beta")]
    documents = spark.createDataFrame(texts, "id bigint, full_text string")
    index = SearchIndex.build(documents, f"{tmp_path}/index", "simple", block_documents=8, buckets=2)
    queries = spark.createDataFrame([(q, "alpha beta") for q in range(6)] + [(6, "w1 beta"), (7, "missing beta")], "query_id bigint, q string")
    terms = stored(search.query_terms(queries, "simple"), "terms")
    rows = index._blocks(terms)
    chosen = rows.select("block").distinct().crossJoin(terms.select("query_id").distinct())
    got = [(r.query_id, r.id) for r in index._hits(rows, chosen, terms).collect()]
    ids = [None, *range(30)]
    assert sorted(got, key=str) == sorted([(q, i) for q in range(6) for i in ids] + [(6, i) for i in range(30) if i % 3 == 1], key=str)
    best = {(r.query_id, r.place): r.id for r in index.search(queries, 40).collect()}
    assert len(best) == 6 * 31 + 10


@pytest.mark.parametrize("hub_size", [2_000, 3])
@pytest.mark.parametrize("hot", [200_000, 5])
def test_connections_by_name_equal_brute_force(spark, monkeypatch, hub_size, hot):
    monkeypatch.setattr(pairs, "HOT_ITEM", hot)
    groups, rows = _membership(spark)
    name = {x: None if x % 7 == 0 else f"n{x % 9}" for x in range(40)}
    entities = spark.createDataFrame(list(name.items()), "id bigint, canonical_name string")
    mentions = rows.select(F.col("g").alias("document_id"), F.col("x").alias("entity_id"))
    shared = Counter((x, n) for items in groups.values() for x in items for n in {name[y] for y in items if y != x})
    want = set()
    for x in name:
        best = sorted(((-c, n or "", n) for (y, n), c in shared.items() if y == x), key=lambda t: t[:2])[:4]
        want |= {(x, name[x], n, -c, place) for place, (c, _, n) in enumerate(best, 1)}
    for seeds in (None, spark.createDataFrame([(3,), (14,)], "id bigint")):
        found = cooccurrence.connections_by_name(mentions, entities, seeds, 4, hub_size)
        got = [(r.entity_id, r.entity1, r.entity2, r.shared_docs, r["rank"]) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == {w for w in want if seeds is None or w[0] in (3, 14)}
    # names are not shuffled with every pair
    assert "hashpartitioning(entity_id, entity2" not in re.sub(r"#\d+L?", "", found._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("hub_size", [2_000, 4])
def test_joint_documents_meet_inside_documents(spark, hub_size):
    groups, rows = _membership(spark)
    mentions = rows.select(F.col("g").alias("document_id"), F.col("x").alias("entity_id"))
    mentions = mentions.unionByName(mentions.where("entity_id = 5 AND document_id < 30"))  # 5 stands twice in some
    asked = [(a, b) for a in range(0, 40, 3) for b in range(0, 40, 4)] + [(1, 5), (5, 1), (5, 1), (None, 3)]
    table = spark.createDataFrame(asked, "a bigint, b bigint")
    want = Counter((a, b, g) for a, b in asked for g, items in groups.items() if a in items and b in items
                   for _ in range(2 if a == 5 and g < 30 else 1))
    got = Counter(tuple(r) for r in traversal.joint_documents(mentions, table, hub_size).collect())
    assert got == want


def test_a_busy_entity_is_not_looked_up_for_each_of_its_pairs(spark):
    """An entity of 2,000 documents and 100 pairs: what is joined follows the documents and not their product."""
    mentions = spark.range(2_000).select(F.col("id").alias("document_id"), F.explode(F.array(F.lit(0), F.col("id") % 100 + 1)).alias("entity_id"))
    asked = spark.range(1, 101).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
    found = traversal.joint_documents(mentions, asked)
    assert found.count() == 2_000
    assert "LeftSemi, ((b" not in re.sub(r"#\d+L?", "", found._jdf.queryExecution().optimizedPlan().toString())


def test_neighbours_are_counted_from_pairs_that_travel_once(spark, monkeypatch):
    groups, rows = _membership(spark)
    lists, gathered = [], pairs.gathered
    monkeypatch.setattr(pairs, "gathered", lambda met, of: lists.append(met) or gathered(met, of))
    degree = Counter(x for p in {p for items in groups.values() for p in combinations(sorted(items), 2)} for x in p)
    assert {r.x: r.neighbours for r in pairs.neighbour_counts(rows, "g", "x").collect()} == dict(degree)
    met = sum(len(items) * (len(items) - 1) // 2 for items in groups.values())
    assert lists[0].agg(F.sum(F.size("others"))).first()[0] == met


def test_khop_stores_edges_one_way(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(traversal, "stored", lambda df, label="table": sizes.append(df.count()) or stored(df, label))
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (5, 4), (6, 6), (None, 1), (2, 7)], "source bigint, target bigint")
    seeds = spark.createDataFrame([(1,), (4,), (6,)], "id bigint")
    got = sorted(tuple(r) for r in traversal.khop(edges, seeds, 3).where("id IS NOT NULL").collect())
    assert got == [(1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 7, 2), (4, 1, 3), (4, 2, 2), (4, 3, 1), (4, 5, 1), (4, 7, 3)]
    assert max(sizes) == 7


def test_timelines_are_looked_up_by_place(spark):
    counts = {1: {"a": 2, "b": 1, "d": 4}, 2: {"b": 3, "d": 1}, 3: {"c": 5}, 4: {"a": 1}}
    rows = [(e, p, n) for e, own in counts.items() for p, n in own.items()] + [(1, None, 9), (5, "a", 7)]
    activity = spark.createDataFrame(rows, "entity_id long, period string, n long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (1, 9)], "source long, target long")
    found = patterns.timeline_correlation(activity, pairs, 5)
    r = {(x.source, x.target): x.r for x in found.collect()}
    dense = {e: [own.get(p, 0) for p in "abcde"] for e, own in counts.items()}
    assert r == {p: pytest.approx(float(np.corrcoef(dense[p[0]], dense[p[1]])[0, 1])) for p in [(1, 2), (2, 3), (1, 4)]}
    assert not re.search(r"element_at\(v2", found._jdf.queryExecution().optimizedPlan().toString())


def test_answers_are_taken_apart_once(spark):
    body = ('{"summary": "s", "detailedSummary": "d", "documentType": "t", "dateEarliest": null, "dateLatest": "", "contentTags": [], '
            '"entities": [{"name": "A", "type": "person"%s}], "triples": [%s]}')
    triple = '{"subject": "a", "subjectType": "person", "predicate": "p", "object": "o", "objectType": "date"%s}'
    texts = [
        "Ü} " + body % ("", triple % ', "tags": ["x"]') + " end {", body % ("", triple % ', "tags": null'), body % (', "context": 1', ""),
        body % ("", "null"), body % ("", triple % ', "location": null'), "}{", None,
    ]
    parsed = analyses.parse_analyses(spark.createDataFrame(list(enumerate(texts)), "document_id long, response string"))
    assert [x.error_message for x in parsed.orderBy("document_id").collect()] == [
        None, "invalid field triples", "invalid field entities", "invalid field triples", "invalid field triples", "no JSON found", "no JSON found"]
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and "$.name" not in plan and "$.subject" not in plan


def test_loaded_answers_are_read_by_column(spark):
    from casegraph.plans.catalogue import _loaded

    answers = spark.createDataFrame([(1, "DOC1", "{}")], "document_id long, doc_id string, response string")
    parsed, _ = _loaded(SimpleNamespace(spark=spark, answers=answers))
    assert "parquet" in parsed.select("document_id")._jdf.queryExecution().executedPlan().toString().lower()
