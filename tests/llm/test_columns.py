"""Extra columns of any name, and very long texts, in every operator and stage that keeps its input's columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casegraph.llm import disclosure, frame_fim, minmax_dedup, neighbour_quality, rule_forest, suffix_decontam, token_ledger, window_dedup
from casegraph.llm.common import table

FOLDER = "/root/testdata/sf0.001"
NAMES = ["Score", "N_Words", "a.b", "__id", "__given", "__hash", "__starts", "__rest", "__keep_id", "__keep_hash_", "__pii_id", "id", "hash", "given",
         "absent", "text_hash", "c0", "N_Lines", "n_removed", "place", "term", "shard", "node", "kept", "rest"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = table(spark, FOLDER, "documents").limit(120)
    long = spark.createDataFrame([(100001, "long text of many words\n" * 40000, "en", "src0", 1), (100002, "w" * 900000, "en", "src0", 2), (None, None, None, None, None)],
                                 rows.schema)
    both = rows.unionByName(long).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)])
    return both.repartition(2).persist()


def plain_rows(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def bare(docs):
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, FOLDER)
    if name == "packing":
        assert got.count() == stage(spark, bare(docs), FOLDER).count()
        return
    assert got.columns == docs.columns
    assert plain_rows(got) == plain_rows(stage(spark, bare(docs), FOLDER))
    assert all(tuple(r)[5:] == tuple(range(len(NAMES))) for r in got.collect())
    assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_operators_keep_columns(spark, docs):
    labels = table(spark, FOLDER, "labels")
    model = rule_forest.fit(rule_forest.rule_statistics(docs), labels)
    for each in (disclosure.sanitise, minmax_dedup.keep_one, lambda d: neighbour_quality.keep_good(d, labels), lambda d: rule_forest.keep_normal(d, model)):
        got = each(docs)
        assert got.columns == docs.columns and plain_rows(got) == plain_rows(each(bare(docs)))
    found = suffix_decontam.find_matches(docs, table(spark, FOLDER, "benchmark"))
    assert found.columns == [c for c in docs.columns if c != "N_Words"] + list(suffix_decontam.FOUND) and found.count() == docs.count()
    cut = window_dedup.dedup_lines(docs)
    assert cut.columns == [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    formed = frame_fim.fill_in_middle(frame_fim.framed(docs))
    assert formed.columns == [c for c in docs.columns if c != "text"] + ["fim"] and formed.count() == docs.count()
    assert token_ledger.counted(docs, "v").columns == [c for c in docs.columns if c != "text"] + ["tokens", "bytes", "tokenizer"]
