"""Tables that batches change: buckets, versions, lost tries, and the streams that keep their state in them."""

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from casegraph.operators.cooccurrence import entity_stats
from casegraph.sources import loading
from casegraph.sources.bucketed import BucketedTable
from casegraph.sources.exports import ChangeExport
from casegraph.sources.registry import load_registry
from casegraph.sources.schemas import REGISTRIES as SCHEMAS
from casegraph.streaming import ingest, stats
from casegraph.workspace import scratch_dir

SCHEMA = "k bigint, v string"


def latest(held, new):
    """New values replace old ones."""
    return held.join(new, "k", "left_anti").unionByName(new)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def test_only_touched_buckets_are_rewritten(spark):
    table = BucketedTable(spark, scratch_dir(spark, "table"), SCHEMA, ["k"], 16)
    assert table.read().count() == 0 and table.version() == 0
    table.merge(spark.range(1000).selectExpr("id as k", "'old' as v"), latest, "all")
    before = table._current()
    assert len(before) == 16
    assert table.merge(rows(spark, (7, "new")), latest, "one") == table.touched(rows(spark, (7, "x")))
    after = table._current()
    changed = [b for b in after if after[b] != before[b]]
    assert changed == table.touched(rows(spark, (7, "x"))) and table.version() == 2
    assert {r.k: r.v for r in table.read().collect()} == {k: "new" if k == 7 else "old" for k in range(1000)}
    files = table.near(rows(spark, (7, "x"))).inputFiles()
    assert files and all(f"bucket={changed[0]}/" in f for f in files)


def test_repeats_and_lost_tries_change_nothing(spark):
    table = BucketedTable(spark, scratch_dir(spark, "table"), SCHEMA, ["k"], 4)
    table.merge(rows(spark, (1, "a"), (2, "b"), (None, "n")), latest, "first")
    assert table.merge(rows(spark, (1, "z")), latest, "first") == []

    def lost(held, new):
        return latest(held, new).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        table.merge(rows(spark, (1, "c")), lost, "second")
    # data that was written without a manifest is never read
    rows(spark, (1, "stray")).withColumn("bucket", table.bucket()).write.partitionBy("bucket").parquet(f"{table.folder}/data/stray")
    assert {(r.k, r.v) for r in table.read().collect()} == {(1, "a"), (2, "b"), (None, "n")} and not table.merged("second")
    table.merge(rows(spark, (1, "c")), latest, "second")
    table.merge(rows(spark), latest, "nothing")
    assert {(r.k, r.v) for r in table.read().collect()} == {(1, "c"), (2, "b"), (None, "n")} and table.version() == 3
    table.merge(rows(spark, (1, "x"), (2, "x"), (None, "x")), lambda held, new: held.limit(0), "drop")
    assert table.read().count() == 0 and table.merged("drop")


def test_stored_merges_equal_whole_tables(spark):
    chance = random.Random(1)
    schema = "doc_id string, full_text string, summary string"
    store, whole = loading.document_store(spark, scratch_dir(spark, "docs"), schema, 8), spark.createDataFrame([], schema)
    for n in range(3):
        batch = spark.createDataFrame([(f"D{i}", chance.choice([None, f"t{n}"]), f"s{n}") for i in chance.sample(range(30), 12)], schema)
        loading.merge_documents(store, batch, str(n))
        whole = loading.upsert_documents(whole, batch)
    assert sorted(map(tuple, store.read().collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    held = loading.mention_store(spark, scratch_dir(spark, "mentions"), 8)
    counts, loads = Counter(), []
    for n in range(3):
        pairs = {(chance.randint(0, 9), chance.randint(0, 3)) for _ in range(10)}
        loads.append(spark.createDataFrame([(d, e, n + 1, f"load {n}") for d, e in pairs], loading.MENTION_ROWS))
        loading.merge_mentions(held, loads[-1], str(n))
        counts.update({p: n + 1 for p in pairs})
    assert {(r.document_id, r.entity_id): r.mention_count for r in held.read().collect()} == counts


def test_statistics_by_deltas(spark):
    """Batches with repeats and old documents, a restart between the tables, against statistics of everything."""
    chance, out, seen = random.Random(5), scratch_dir(spark, "stats"), set()
    for n in range(5):
        pairs = [(chance.randint(0, 25), chance.randint(0, 40)) for _ in range(60)] + [(3, e) for e in range(n * 5, n * 5 + 9)] + list(seen)[:10] + [(None, 1), (1, None)]
        batch = spark.createDataFrame(pairs, stats.MENTION_KEYS)
        if n == 2:  # lost after the deltas and one table
            tables = stats.StatsTables(spark, out, 8)
            delta = tables.deltas(batch, n)
            tables.mentions.merge(delta["mentions"], lambda held, new: held.unionByName(new), str(n))
        stats.refresh_stats(batch, out, n, 8)
        stats.refresh_stats(batch, out, n, 8)
        seen.update(p for p in pairs if None not in p)
        whole = entity_stats(spark.createDataFrame(sorted(seen), stats.MENTION_KEYS))
        want = {tuple(r) for r in whole.select("id", "document_count", "connection_count").collect()}
        assert {tuple(r) for r in stats.StatsTables(spark, out, 8).stats.read().collect()} == want


def test_a_batch_reads_its_own_buckets(spark):
    """What a batch of one document reads does not grow with the batches before it."""
    out, read = scratch_dir(spark, "stats"), []
    one = spark.createDataFrame([(100_000, 1), (100_000, 2)], stats.MENTION_KEYS)
    for n in range(3):
        batch = spark.range(n * 400, n * 400 + 400).selectExpr("id as document_id", "explode(array(id * 3, id * 3 + 1)) as entity_id")
        stats.refresh_stats(batch, out, n, 64)
        tables = stats.StatsTables(spark, out, 64)
        read.append(tables.mentions.near(one).count() / tables.mentions.read().count())
    assert max(read) < 0.06


def test_settled_documents_are_found_by_bucket(spark):
    out = scratch_dir(spark, "ingest")
    answers = spark.createDataFrame([(i, f"D{i}", "bad") for i in range(50)], ingest.RESPONSES)
    ingest.load_batch(answers.where("document_id < 30"), out, 0)
    ingest.load_batch(answers, out, 1)
    ingest.load_batch(answers, out, 1)
    status = spark.read.parquet(f"{out}/status")
    assert status.count() == 50 and status.where("batch_id = 1").count() == 20
    assert ingest.settled(spark, out).read().count() == 50


def test_registry_rows_with_faults_are_kept_apart(spark, tmp_path):
    header = ",".join(T.StructType.fromDDL(SCHEMAS["fec"]).fieldNames())

    def row(**fields):
        return ",".join(fields.get(c, "") for c in header.split(","))

    lines = [
        row(id="1", contributor_name='"Doe, ""J"""', amount="12.50", contribution_date="2000-02-29"), row(id="2", contributor_name="Ann", amount="x"),
        row(id="3", contributor_name="Ann", amount="1.555", contribution_date="2001-02-29"), row(id="4"), row(contributor_name="Ann"), "5,short",
        row(id="6", contributor_name="Ann") + ",more", row(id="9999999999999999999", contributor_name="Ann"), row(id="8", contributor_name=" Zoë ", amount="12345678901.00"),
        row(id="9", contributor_name="Bo"),
    ]
    (tmp_path / "a.csv").write_text("\n".join([header, *lines[:5]]))
    (tmp_path / "b.csv").write_text("\n".join([header, *lines[5:]]))
    good, rejected = load_registry(spark, str(tmp_path), "fec")
    assert {(r.id, r.contributor_name, r.amount, str(r.contribution_date), r.normalized_name) for r in good.collect()} == {
        (1, 'Doe, "J"', Decimal("12.50"), "2000-02-29", "doe j"), (9, "Bo", None, "None", "bo")}
    assert good.select("id").count() == 2 and rejected.count() == 8
    assert sorted(tuple(r.reasons) for r in rejected.collect()) == sorted([
        ("invalid amount",), ("invalid amount", "invalid contribution_date"), ("no contributor_name",), ("no id",), ("wrong number of fields",),
        ("wrong number of fields",), ("invalid id",), ("invalid amount",)])
    assert "5,short" in {r.line for r in rejected.collect()}


def test_exports_write_differences_only(spark):
    export = ChangeExport(spark, scratch_dir(spark, "export"), {"id": "STRING"}, 4)
    rows = lambda *r: spark.createDataFrame(list(r), "id string, label string, props map<string,string>")
    first = rows(("a", "X", {"p": "1", "q": None}), ("b", "X", None), ("c", None, {}))
    second = rows(("a", "X", {"q": None, "p": "1"}), ("b", "Y", None), ("d", "Z", {"p": "2"}))
    assert {(r.id, r.change) for r in export.export(first, 1).collect()} == {("a", "added"), ("b", "added"), ("c", "added")}
    for _ in range(2):  # a repeat writes the same
        assert {(r.id, r.change) for r in export.export(second, 2).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    assert export.export(second, 3).count() == 0
    assert {(r.id, r.label) for r in export.replay([1, 2, 3]).collect()} == {("a", "X"), ("b", "Y"), ("d", "Z")}
    assert {r.id: r.props for r in export.replay([1, 2]).collect()}["a"] == {"p": "1", "q": None}
