import math

import pytest
from pyspark.sql import functions as F

from casegraph.functions import text as tx
from casegraph.functions.stemming import stem
from casegraph.operators import filters


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("a,b,want", [
    ("word", "two words", 4 / 11), ("Jörg Müller", "jorg muller", 1 / 3), ("", "x", 0.0), ("Same Name", "name same", 1.0),
])
def test_trigram_similarity(spark, a, b, want):
    assert one(spark, tx.trigram_similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)
    assert one(spark, tx.trigram_similarity(F.col("a"), b), a=a) == pytest.approx(want)


def test_threshold_is_inclusive_in_integers(spark):
    # 7 shared of 10: the float threshold would miss it.
    pair = ("abcdefgh", "abcdefgx")
    shared = one(spark, tx.trigram_similarity(F.col("a"), F.col("b")), a=pair[0], b=pair[1])
    num, den = 7, 11
    assert shared == pytest.approx(num / den)
    assert one(spark, filters.similarity_at_least(F.col("a"), F.col("b"), num, den), a=pair[0], b=pair[1])


@pytest.mark.parametrize("raw,want", [
    ("Jörg  O'Neil-Smith", "jorg oneilsmith"), (" Straße Æon ", " strasse aeon "), ("a\tb", "ab"), ("Łódź Øre", "lodz ore"),
])
def test_normalize_name(spark, raw, want):
    assert one(spark, tx.normalize_name(F.col("a")), a=raw) == want
    tx.register_sql_functions(spark)
    assert one(spark, F.expr("normalize_name(a)"), a=raw) == want


def test_small_functions(spark):
    assert one(spark, tx.trim_unicode(F.col("a")), a=" ﻿ x \t") == "x"
    assert one(spark, tx.suffix_number(F.col("a")), a="DOC00000042") == 42
    assert one(spark, tx.suffix_number(F.col("a")), a="none") is None
    assert one(spark, tx.parse_date(F.col("a")), a="sometime") is None
    assert str(one(spark, tx.parse_date(F.col("a")), a="2001-02-03")) == "2001-02-03"
    assert one(spark, tx.extract_json(F.col("a")), a="x {\"a\": {1}\n} y") == "{\"a\": {1}\n}"
    assert one(spark, tx.extract_json(F.col("a"), "array"), a="none") is None
    assert one(spark, tx.truncate_text(F.col("a"), 3), a="abcd") == "abc" + tx.TRUNCATION_NOTE
    assert one(spark, tx.truncate_text(F.col("a"), 4), a="abcd") == "abcd"


@pytest.mark.parametrize("word,want", [
    ("consignment", "consign"), ("knightly", "knight"), ("generously", "generous"), ("ties", "tie"), ("cries", "cri"),
    ("hopping", "hop"), ("hoping", "hope"), ("dying", "die"), ("relational", "relat"), ("by", "by"), ("skies", "sky"),
])
def test_stem(word, want):
    assert stem(word) == want


def test_filters(spark):
    df = spark.createDataFrame([(1, "50% off", "a"), (2, "none", "b"), (3, None, "a")], "id int, name string, t string")
    assert [r.id for r in filters.opt_filter(df, t="a", name="").orderBy("id").collect()] == [1, 3]
    assert [r.id for r in df.where(filters.ilike_any(F.col("name"), "OFF")).collect()] == [1]
    arrays = spark.createDataFrame([(1, [], None), (2, [1], None), (3, None, [])], "id int, a array<int>, b array<int>")
    assert [r.id for r in filters.any_nonempty(arrays, ["a", "b"]).collect()] == [2]
    filled = filters.with_defaults(arrays, [], ["a", "b"])
    assert filled.where("a is null or b is null").count() == 0
    new = filters.insert_new(df.select("id", "t"), spark.createDataFrame([(3, "z"), (4, "y"), (4, "y")], "id int, t string"), "id")
    assert sorted((r.id, r.t) for r in new.collect()) == [(1, "a"), (2, "b"), (3, "a"), (4, "y")]
    counts = filters.with_counts(df.limit(2), df).first()
    assert (counts.returned, counts.total) == (2, 3)
    assert one(spark, filters.concat_aliases(F.col("a"), F.lit(None)), a=["x", "x"]) == ["x", "x"]
    assert math.isclose(one(spark, tx.jaccard(F.col("a"), F.col("b")), a=["x"], b=["x", "y"]), 0.5)
