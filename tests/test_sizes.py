"""What keeps large tables cheap: endpoints resolved inside rows, index rows made block by block."""

import random
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from casegraph.functions.stemming import stem
from casegraph.operators import search, search_index
from casegraph.sources import loading

ANALYSIS = ("analysis struct<entities: array<struct<name: string, type: string, context: string>>, triples: array<struct<subject: string, "
            "subjectType: string, object: string, objectType: string, location: string>>>")


def _parsed(spark, ids):
    rng = random.Random(8)
    names = ["Ann", "ANN", "ann ", "Bo", "bo", "Rome", "ROME", "Zed", ""]

    def triple():
        return rng.choice(names), "person", rng.choice(names), rng.choice(["person", "date"]), rng.choice([None, "", "Rome", "Oslo", "oslo"])

    rows = [(i, (None if rng.random() < 0.1 else [(rng.choice([*names, None]), rng.choice(["person", "location"]), None) for _ in range(rng.randrange(4))],
                 [triple() for _ in range(rng.randrange(5))]), "failed" if rng.random() < 0.1 else "complete") for i in ids]
    return spark.createDataFrame(rows, f"document_id bigint, {ANALYSIS}, analysis_status string")


def test_endpoints_are_resolved_inside_their_row(spark):
    parsed = _parsed(spark, range(60))
    found = loading.resolve_endpoints(parsed)
    want = sorted(map(str, loading._resolved_by_window(parsed).collect()))
    assert len(want) > 100 and sorted(map(str, found.collect())) == want
    assert found.schema == loading._resolved_by_window(parsed).schema
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_document_are_resolved_together(spark):
    parsed = _parsed(spark, [*range(30), *range(10), None, None])
    got = sorted(map(str, loading.resolve_endpoints(parsed).collect()))
    assert got == sorted(map(str, loading._resolved_by_window(parsed).collect()))


def test_index_rows_are_made_block_by_block(spark, monkeypatch):
    """Blocks that go on in the next batch, ids that are null or repeat, rows that leave in several batches."""
    monkeypatch.setattr(search_index, "BATCH_WORDS", 7)
    rng = random.Random(6)
    words = ["running", "runs", "the", "bänk", "banks", "x1", "of"]
    texts = [(b, i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for b in (3, 5 << 32) for i in [1, 2, 2, None, None, 7]] + [(9, 4, "the of")]
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*texts, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["block", "id", "text"])
    for config in ("simple", "stop", "english"):
        want = defaultdict(lambda: defaultdict(set))
        for b, i, text in texts:
            for place, w in enumerate(text.split(" "), 1):
                if config == "simple" or w not in search.STOP_WORDS:
                    want[stem(w) if config == "english" else w, b][i].add(place)
        batches = list(search_index._block_rows(config)(iter(table.to_batches(max_chunksize=4))))
        rows = [r for batch in batches for r in batch.to_pylist()]
        assert len(batches) > 4 and len(rows) == len(want)
        for r in rows:
            held = want[r["term"], r["block"]]
            assert {d["id"]: d["positions"] for d in r["docs"]} == {i: sorted(p) for i, p in held.items()}
            assert (r["n_docs"], r["most"]) == (len(held), max(map(len, held.values())))


def test_terms_that_nobody_asks_for_are_left_out_first(spark, tmp_path):
    documents = spark.createDataFrame([(i, f"alpha beta w{i}") for i in range(20)], "id bigint, full_text string")
    index = search_index.SearchIndex.build(documents, f"{tmp_path}/index", "simple", block_documents=8, buckets=2)
    terms = spark.createDataFrame([(1, "alpha", 1)], "query_id bigint, term string, n_terms bigint")
    rows = index._blocks(terms)
    chosen = rows.select("block").distinct().withColumn("query_id", F.lit(1).cast("bigint"))
    found = index._hits(rows, chosen, terms)
    assert found.count() == 20
    plan = re.sub(r"#\d+L?", "", found._jdf.queryExecution().optimizedPlan().toString())
    assert "LeftSemi, (term = term)" in plan
