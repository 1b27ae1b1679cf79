import datetime
import random
from collections import defaultdict
from decimal import Decimal
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from casegraph.operators import cooccurrence as co, patterns, traversal
from casegraph.operators.pairs import emit_pairs, hub_groups, meet_in_groups, neighbour_counts, pair_counts
from casegraph.operators.ranking import top_k_per_group


def hub_membership(seed=1):
    """Two hubs with half of all rows, and small groups."""
    rng = random.Random(seed)
    rows = {(1, x) for x in range(60)} | {(2, x) for x in range(30, 90)} | {(3, x) for x in range(0, 90, 2)}
    for g in range(10, 60):
        rows |= {(g, x) for x in rng.sample(range(120), 4)}
    return sorted(rows)


def brute_pairs(rows):
    groups, counts = defaultdict(list), defaultdict(int)
    for g, x in rows:
        groups[g].append(x)
    for members in groups.values():
        for pair in combinations(sorted(members), 2):
            counts[pair] += 1
    return counts


@pytest.fixture(scope="module")
def rows():
    return hub_membership()


@pytest.mark.parametrize("hub_size", [5, 20, 50, 1000])
@pytest.mark.parametrize("min_shared", [1, 2, 3])
def test_pair_counts_match_brute_force(spark, rows, hub_size, min_shared):
    df = spark.createDataFrame(rows, "g long, x long")
    got = {(r.item1, r.item2): r.shared for r in pair_counts(df, "g", "x", min_shared, hub_size).collect()}
    assert got == {p: n for p, n in brute_pairs(rows).items() if n >= min_shared}


def test_hub_pairs_are_spread_over_keys(spark, rows):
    df = spark.createDataFrame(rows, "g long, x long")
    pairs = emit_pairs(df, "g", "x", hub_groups(df, "g", 20), 20)
    assert pairs.count() == sum(brute_pairs(rows).values())
    assert pairs.distinct().count() == pairs.count()


@pytest.mark.parametrize("hub_size", [5, 40, 1000])
def test_neighbour_counts(spark, rows, hub_size):
    near = defaultdict(set)
    for a, b in brute_pairs(rows):
        near[a].add(b)
        near[b].add(a)
    got = {r.x: r.neighbours for r in neighbour_counts(spark.createDataFrame(rows, "g long, x long"), "g", "x", hub_size).collect()}
    assert got == {x: len(n) for x, n in near.items()}


@pytest.mark.parametrize("hub_size", [10, 1000])
def test_meet_in_groups(spark, rows, hub_size):
    right = spark.createDataFrame(rows, "g long, x long")
    left = right.where("x < 10").withColumnRenamed("x", "y")
    got = meet_in_groups(left, right, "g", hub_size).select("g", "y", "x")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "g").select("g", "y", "x").collect()))


def mentions(spark, pairs):
    return spark.createDataFrame([(d, e, 1) for d, e in pairs], "document_id long, entity_id long, mention_count int")


def names(spark, ids, kind="person"):
    return spark.createDataFrame([(i, f"n{i}", kind) for i in ids], "id long, canonical_name string, entity_type string")


CHAIN = [(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 4), (4, 5), (4, 6)]


def test_layers(spark):
    m, e = mentions(spark, CHAIN), names(spark, range(1, 8))
    layers = lambda df: {r.id: r.layer for r in df.collect()}
    assert layers(traversal.classify_layers(e, m, 1)) == {1: 0, 2: 1, 3: 2, 4: 3, 5: 3, 6: 3, 7: 3}
    assert layers(traversal.classify_layers(e, m, 1, max_hops=3))[4] == 3
    assert set(layers(traversal.classify_layers(e, m, 99)).values()) == {3}
    stored = spark.createDataFrame([(1, 0), (2, 3), (3, None), (5, 1), (6, None)], "id long, layer int")
    # Set layers stay, and expansion starts from stored layer-1 entities as well.
    assert layers(traversal.classify_layers(stored, m, 1, incremental=True)) == {1: 0, 2: 3, 3: 3, 5: 1, 6: 2}


def test_hops_and_walks(spark):
    m, e = mentions(spark, CHAIN), names(spark, range(1, 8))
    edges = co.cooccurrence(m)
    hops = {r.id: r.hops for r in traversal.hop_distance(e, edges, 1).collect()}
    assert hops == {1: 0, 2: 1, 3: 2, 4: 3, 5: None, 6: None, 7: None}
    near = {(r.seed, r.id): r.hops for r in traversal.khop(edges, e.where("id in (1, 3)"), 2).collect()}
    assert near == {(1, 2): 1, (1, 3): 2, (3, 2): 1, (3, 4): 1, (3, 1): 2}
    walk = lambda: sorted(map(tuple, traversal.random_walks(edges, e.where("id = 1"), 5, 3).collect()))
    path = walk()
    assert path == walk() and len(path) == 6
    linked = {tuple(sorted(p)) for p in ((r.source, r.target) for r in edges.collect())}
    assert all(tuple(sorted((a[2], b[2]))) in linked for a, b in zip(path, path[1:]))


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)]
    got = {r.id: r.component for r in traversal.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and {got[i] for i in range(100, 160)} == {100}


def test_pair_lookups(spark):
    edges = spark.createDataFrame([(1, 3), (2, 3), (1, 4), (2, 5)], "source long, target long")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert [tuple(r) for r in traversal.shared_connections(edges, pairs).collect()] == [(1, 2, 3)]
    m = mentions(spark, [(1, 1), (1, 2), (2, 1), (3, 2)])
    assert [tuple(r) for r in traversal.joint_documents(m, pairs).collect()] == [(1, 2, 1)]


def test_network_limit_comes_before_restriction(spark):
    docs = [(d, e) for d in range(5) for e in (1, 2)] + [(d, e) for d in range(10, 13) for e in (3, 4)]
    m = mentions(spark, docs)
    e = co.with_stats(names(spark, range(1, 5)), m)
    nodes = e.where("id in (3, 4)")
    assert co.network_edges(m, e, nodes, 1, 1).count() == 0
    assert [tuple(r) for r in co.network_edges(m, e, nodes, 1, 1, restrict_first=True).collect()] == [(3, 4, 3)]
    assert co.edges(m, e, min_conn=2).count() == 0


def test_pairs_with_their_documents(spark):
    m = mentions(spark, [(d, e) for d in range(30) for e in (1, 2)])
    docs = spark.createDataFrame([(d, f"D{d:02}") for d in range(30)], "id long, doc_id string")
    rows = co.entity_connections(m, names(spark, (1, 2))).collect()
    assert [(r.entity1_id, r.entity2_id, r.shared_documents) for r in rows] == [(1, 2, 30)]
    assert sorted(r.doc_id for r in co.pair_documents(m, docs).collect()) == [f"D{d:02}" for d in range(30)]


def test_unknown_counts_come_first(spark):
    rows = spark.createDataFrame([(1, 1, 2), (1, 2, None), (1, 3, 5)], "document_id long, entity_id long, mention_count int")
    placed = co.document_entities(rows, names(spark, (1, 2, 3)).withColumn("layer", F.lit(0))).collect()
    assert {r.entity_id: r.place for r in placed} == {2: 1, 3: 2, 1: 3}


def test_a_long_path_is_followed_to_its_end(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(12)], "source long, target long")
    nodes = spark.createDataFrame([(i,) for i in range(14)], "id long")
    got = {r.id: r.hops for r in traversal.hop_distance(nodes, path, 0).collect()}
    assert got == {**{i: i for i in range(13)}, 13: None}


def test_top_k_breaks_ties_by_given_order(spark):
    df = spark.createDataFrame([(1, 5, i) for i in range(9)], "g int, s int, id int")
    got = top_k_per_group(df, ["g"], [df.s.desc(), df.id.asc()], 3, "rank").collect()
    assert sorted((r.id, r["rank"]) for r in got) == [(0, 1), (1, 2), (2, 3)]


def test_patterns(spark):
    triangle = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4), (4, 5)], "source long, target long")
    density = {r.id: (r.degree, r.triangles, r.density) for r in patterns.clustering(triangle).collect()}
    assert density == {1: (2, 1, 1.0), 2: (2, 1, 1.0), 3: (3, 1, pytest.approx(1 / 3)), 4: (2, 0, 0.0)}
    square = spark.createDataFrame([(1, 3), (1, 4), (2, 3), (2, 4)], "source long, target long")
    found = {(r.source, r.target): (r.shared, r.jaccard) for r in patterns.indirect_pairs(square).collect()}
    assert found == {(1, 2): (2, 1.0), (3, 4): (2, 1.0)}
    events = spark.createDataFrame([(1, f"2024-01-{d:02} 05:00:00") for d in [1, 2] + [20] * 9], "entity_id long, ts string")
    events = events.selectExpr("entity_id", "cast(ts as timestamp) as ts")
    assert [(str(r.gap_from), str(r.gap_to), r.days) for r in patterns.activity_gaps(events, 7).collect()] == [("2024-01-02", "2024-01-20", 18)]
    assert [(str(r.day), r.n) for r in patterns.activity_bursts(events, 7, 3.0, 3).collect()] == [("2024-01-20", 9)]
    activity = spark.createDataFrame([(1, 1, 2), (1, 2, 4), (2, 1, 1), (2, 2, 2), (3, 3, 5)], "entity_id long, period int, n long")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "source long, target long")
    r = {(x.source, x.target): x.r for x in patterns.timeline_correlation(activity, pairs, 3).collect()}
    assert r[(1, 2)] == pytest.approx(1.0) and r[(1, 3)] < 0
    findings = spark.createDataFrame([(1, [1, 2]), (2, [1, 9]), (3, [])], "id long, entity_ids array<long>")
    checked = {x.id: (x.pairs, x.supported, x.documents, x.status) for x in patterns.validate_findings(findings, mentions(spark, CHAIN)).collect()}
    assert checked == {1: (1, 1, 1, "validated"), 2: (1, 0, 0, "rejected"), 3: (0, 0, 0, "rejected")}


def test_core_numbers_equal_peeling(spark):
    chance = random.Random(6)
    pairs = {tuple(sorted(chance.sample(range(40), 2))) for _ in range(150)} | {(a, b) for a in range(50, 57) for b in range(50, a)} | {(60, x) for x in range(30)}
    around = {}
    for a, b in pairs:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    left, core, k = {v: set(n) for v, n in around.items()}, {}, 0
    while left:
        v = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[v]))
        core[v] = k
        for u in left.pop(v):
            left[u].discard(v)
    rows = [(a, b, 1) for a, b in pairs] + [(b, a, 1) for a, b in list(pairs)[:20]] + [(5, 5, 1)]
    got = {r.id: (r.degree, r.core) for r in patterns.core_numbers(spark.createDataFrame(rows, "source long, target long, weight long")).collect()}
    assert got == {v: (len(around[v]), core[v]) for v in around} and max(core.values()) >= 6
    assert patterns.core_numbers(spark.createDataFrame([], "source long, target long")).count() == 0


def test_money_flows_equal_brute_force(spark):
    chance = random.Random(9)
    day = datetime.date(2000, 1, 1)
    rows = [(f"p{i}", chance.randint(0, 6), chance.randint(0, 6), day + datetime.timedelta(chance.randint(0, 60)), Decimal(chance.randint(50, 100))) for i in range(120)]
    want, paths = set(), [[r] for r in rows]
    for _ in range(3):
        paths = [[*p, r] for p in paths for r in rows if r[1] == p[-1][2] and 0 < (r[3] - p[-1][3]).days <= 7 and p[-1][4] * Decimal("0.5") <= r[4] <= p[-1][4]]
        want |= {(p[0][1], p[-1][2], len(p), tuple(r[0] for r in p), min(r[4] for r in p), p[0][3], p[-1][3], p[0][1] == p[-1][2]) for p in paths}
    schema = "payment string, payer long, payee long, day date, amount decimal(15,2)"
    nulls = [("n1", None, 1, day, Decimal(1)), ("n2", 1, None, day, Decimal(1)), ("n3", 1, 2, None, Decimal(1)), ("n4", 1, 2, day, None)]
    got = patterns.money_flows(spark.createDataFrame(rows + nulls, schema)).collect()
    assert {(r.source, r.target, r.steps, tuple(r.path), r.amount, r.first_day, r.last_day, r.returns) for r in got} == want
    assert len(got) == len(want) and {w[2] for w in want} == {2, 3, 4}
