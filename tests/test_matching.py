import random

import pytest
from pyspark.sql import functions as F

from casegraph.functions.edits import edits
from casegraph.functions.text import trigram_list
from casegraph.operators import aliases, crossref
from casegraph.operators.similarity import similarity_join
from casegraph.operators.typos import typo_pairs


def names(n, seed):
    rng = random.Random(seed)
    first, last = ["john", "jon", "johnny", "mary", "marie", "a", "b"], ["smith", "smyth", "smithe", "doe", "b", "c"]
    out = [f"{rng.choice(first)} {rng.choice(last)} {rng.choice(['', 'jr', 'inc'])}".strip() for _ in range(n)]
    return list(enumerate(out + ["Same Copy"] * (n // 2)))  # a third of the rows are copies


@pytest.mark.parametrize("hot", [1, 4, 10_000])
@pytest.mark.parametrize("num,den", [(7, 10), (3, 10), (1, 1)])
def test_join_equals_brute_force(spark, hot, num, den):
    left, right = names(30, 1), names(40, 2)
    got = similarity_join(
        spark.createDataFrame(left, "l long, a string"), spark.createDataFrame(right, "r long, b string"),
        "l", "a", "r", "b", num, den, 5, hot_token=hot)
    want = {}
    for i, a in left:
        scored = []
        for j, b in right:
            x, y = set(trigram_list(a)), set(trigram_list(b))
            if x and y and len(x & y) * den >= len(x | y) * num:
                scored.append((-len(x & y) / len(x | y), j))
        for score, j in sorted(scored)[:5]:
            want[(i, j)] = pytest.approx(-score)
    assert {(r.l, r.r): r.score for r in got.collect()} == want


def entities(spark):
    return spark.createDataFrame(
        [(1, "Acme Trading", "organization"), (2, "John Smith", "person"), (3, "Nobody Here", "person"), (4, "Acme Trading", "location")],
        "id long, canonical_name string, entity_type string")


def registries(spark):
    ppp = spark.createDataFrame([(i, "ACME Trading", None if i == 3 else i) for i in range(1, 8)], "id long, borrower_name string, loan_amount int")
    fec = spark.createDataFrame([(1, "Smith, John", "X", 5), (2, "Acme Trading", "Y", 6)], "id long, contributor_name string, candidate_name string, amount int")
    return {"ppp": ppp.withColumn("loan_amount", F.col("loan_amount").cast("decimal(15,2)")), "fec": fec}


def test_matches_and_summary_states(spark):
    e, r = entities(spark), registries(spark)
    matches = crossref.match_all(e, r)
    got = sorted((m.entity_id, m.source, m.source_id, m.match_score) for m in matches.collect())
    assert got == [(1, "ppp", i, 1.0) for i in range(1, 6)] + [(2, "fec", 1, 1.0)]
    single = crossref.match_registry(e, r["ppp"], "ppp")
    assert single.count() == 5
    saved = crossref.save_matches(matches, matches)
    assert saved.count() == 6
    judged = matches.withColumn("false_positive", F.col("source") == "fec")
    summary = {x.id: x.fec_matches for x in crossref.crossref_summary(e, judged, r["fec"], "fec").collect()}
    assert summary == {1: [], 2: None, 3: [], 4: []}
    ppp = {x.id: x.ppp_matches for x in crossref.crossref_summary(e, judged, r["ppp"], "ppp").collect()}
    assert [x.id for x in ppp[1]] == [1, 2, 3, 4, 5] and ppp[1][2].amount is None and ppp[2] == []
    from casegraph.operators.filters import has_match

    assert [x.id for x in has_match(e, judged, "fec").collect()] == [2]  # false positives count


def test_alias_clusters(spark):
    rows = [(1, "John Smith", 9), (2, "J. Smith", 1), (3, "John Q. Smith", 2), (4, "Acme LLC", 3), (5, "ACME, Inc.", 5),
            (6, "Mary Doe", 1), (7, "Mark Doe", 1), (8, "M. Doe", 1), (9, "Bob Stone", 4), (10, "Robert Stone", 1)]
    df = spark.createDataFrame(rows, "id long, name string, mentions int")
    got = aliases.cluster_aliases(df, nicknames={"bob": "robert"})
    canonical = {r.name: r.canonical_name for r in got.collect()}
    assert canonical["J. Smith"] == canonical["John Q. Smith"] == "John Smith"
    assert canonical["Acme LLC"] == "ACME, Inc." and canonical["Robert Stone"] == "Bob Stone"
    assert canonical["M. Doe"] == "M. Doe"  # two full names compete, so it stays alone
    assert {r.original_name for r in aliases.alias_table(got).collect()} == {"J. Smith", "John Q. Smith", "Acme LLC", "Robert Stone"}


@pytest.mark.parametrize("most", [1, 2])
def test_typo_pairs_equal_brute_force(spark, most):
    chance = random.Random(most)
    names = {"".join(chance.choice("abcé ") for _ in range(chance.randint(0, 7))) for _ in range(160)} | {"ca", "abc", "Jon Smith", "Jno Smith", "Jon Smiht"}
    rows = spark.createDataFrame([(n,) for n in names] + [(None,), ("ca",)], "name string").repartition(4)
    want = {(a, b, d) for a in names for b in names if a < b and (d := edits(a, b)) <= most}
    for hub in (2_000, 3):
        got = {tuple(r) for r in typo_pairs(rows, "name", most, hub_size=hub).collect()}
        assert got == want
    with pytest.raises(ValueError):
        typo_pairs(rows, "name", 3)


def test_edits_and_reading_errors(spark):
    assert [edits(a, b) for a, b in (("ca", "abc"), ("", "ab"), ("abc", "abc"), ("abcd", "badc"), ("kitten", "sitting"))] == [2, 2, 0, 2, 3]
    rows = spark.createDataFrame([("C0rn 81ll",), ("com bill",), ("other",)], "name string")
    assert [tuple(r) for r in typo_pairs(rows, "name", 1, confusable=True).collect()] == [("C0rn 81ll", "com bill", 0)]
