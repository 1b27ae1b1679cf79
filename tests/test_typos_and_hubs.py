"""Typing errors by the cheaper end of names, neighbours of hubs from pairs that travel one way, released shuffle files."""

import os
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from casegraph.functions.edits import edits, edits_of_pairs
from casegraph.operators import pairs, typos
from casegraph.workspace import stored


def test_pairs_of_one_size_are_measured_together():
    rng = random.Random(3)
    texts = [["".join(rng.choices(letters, k=rng.randrange(8))) for _ in range(600)] for letters in ("ab", "aé漢𝄞") for _ in range(2)]
    a, b = texts[0] + texts[2], texts[1] + texts[3]
    assert edits_of_pairs(a, b).tolist() == [edits(x, y) for x, y in zip(a, b, strict=True)]
    assert edits_of_pairs([], []).tolist() == [] and edits_of_pairs([""] * 9, ["ba"] * 9).tolist() == [2] * 9


@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize("most", [1, 2])
def test_only_the_rarer_end_is_shortened(spark, turned, most):
    """Names that begin alike, or end alike if turned; short ones are whole keys."""
    rng = random.Random(5)
    codes = ["".join(rng.choices("01ab", k=rng.randrange(1, 9))) for _ in range(50)]
    names = sorted({("a long beginning " + c)[::-1 if turned else 1] for c in codes} | set(codes))
    table = spark.createDataFrame([(n,) for n in names], "name string")
    assert typos.cheapest_end(table.withColumnRenamed("name", "text").limit(0), most) is None
    want = {(a, b, edits(a, b)) for a, b in combinations(names, 2) if edits(a, b) <= most}
    got = [tuple(r) for r in typos.typo_pairs(table, "name", most).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_every_end_finds_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    names = sorted({"".join(rng.choices("ab", k=rng.randrange(1, 10))) for _ in range(60)})
    table = spark.createDataFrame([(n,) for n in names], "name string")
    want = {(a, b, edits(a, b)) for a, b in combinations(names, 2) if edits(a, b) <= 2}
    for end in (("left", 4), ("right", 4), ("right", 6), None):
        monkeypatch.setattr(typos, "cheapest_end", lambda texts, most, end=end: end)
        assert {tuple(r) for r in typos.typo_pairs(table, "name", 2).collect()} == want


def test_codes_at_the_end_are_shortened_alone(spark):
    rng = random.Random(9)
    names = [f"a common beginning {rng.randrange(16 ** 12):012x}" for _ in range(300)]
    table = spark.createDataFrame([(n,) for n in names], "text string")
    assert typos.cheapest_end(table, 2)[0] == "right"
    assert typos.cheapest_end(table.select(F.reverse("text").alias("text")), 2)[0] == "left"


def test_hub_neighbours_travel_one_way(spark, monkeypatch):
    rng = random.Random(3)
    groups = {g: rng.sample(range(40), rng.choice([0, 1, 2, 3, 5, 12])) for g in range(60)}
    rows = spark.createDataFrame([(g, x) for g, items in groups.items() for x in items] + [(None, 1), (7, None)], "g bigint, x bigint")
    shared = {p for items in groups.values() for p in combinations(sorted(items), 2)}
    degree = Counter(x for p in shared for x in p)
    once, seen = pairs._pairs_once, []
    monkeypatch.setattr(pairs, "_pairs_once", lambda *a: seen.append(once(*a)) or seen[-1])
    for hub_size in (2_000, 4, 1):
        assert {r.x: r.neighbours for r in pairs.neighbour_counts(rows, "g", "x", hub_size).collect()} == dict(degree)
    assert seen and all(found.where("item1 >= item2").isEmpty() for found in seen)


def test_a_stored_table_lets_go_of_its_shuffle_files(spark):
    top = spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString()[0]

    def held() -> set[str]:
        return {f for _, _, files in os.walk(top) for f in files if f.startswith("shuffle_")}

    before = held()
    kept = stored(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count())
    assert held() <= before and kept.count() == 7
