import itertools
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from casegraph.functions.stemming import stem_terms
from casegraph.operators import aliases, extraction, search, search_index
from casegraph.sources import analyses, lines, loading
from casegraph.streaming import ingest, stats
from casegraph.workspace import scratch_dir


def by_the_line_rule(text, marker="DOC"):
    docs, current = [], None
    for line in text.split("\n"):
        trimmed = line.strip().strip(" ﻿").strip()
        if trimmed.startswith(marker) and len(trimmed) == 11 and trimmed[3:].isdigit():
            current = (trimmed, [])
            docs.append(current)
        elif current and trimmed:
            current[1].append(line)
    first = {}
    for key, body in docs:
        if body:
            first.setdefault(key, "\n".join(body))
    return first


@pytest.mark.parametrize("split", ["64", "200", "128m"])
def test_segmentation_for_any_split(spark, tmp_path, split):
    rng = random.Random(3)
    text = "lost line\n\n  DOC00000001 \n  kept as is  \n \nDOC00000002\nDOC00000002\nbody\nDOC00000001\nrepeat\n"
    for i in range(3, 60):
        text += f"DOC{i:08}\n" + "".join(f"line {rng.random()}\n" for _ in range(rng.randrange(0, 6)))
    (tmp_path / "dump.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = lines.extract_documents(spark, str(tmp_path / "dump.txt"), r"^DOC\d{8}$")
        assert {r.doc_id: r.full_text for r in got.collect()} == by_the_line_rule(text)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_datasets(spark):
    df = spark.createDataFrame([(f"DOC{n:08}",) for n in (1, 3158, 3159, 3858, 5600, 8321)], "doc_id string")
    assert [r.dataset_id for r in lines.assign_dataset(df).orderBy("doc_id").collect()] == [1, 1, 2, 3, 4, 5]


def answer(**changes):
    body = {
        "summary": "s", "detailedSummary": "d", "documentType": "t", "dateEarliest": None, "dateLatest": "2001-01-01",
        "contentTags": [], "entities": [
            {"name": "Ann", "type": "organization"}, {"name": "ann", "type": "person", "context": "c"}, {"name": "Ann", "type": "organization", "context": "late"}],
        "triples": [
            {"subject": "ANN", "subjectType": "location", "predicate": "p", "object": "New One", "objectType": "person", "location": "Rome"},
            {"subject": "new one", "subjectType": "organization", "predicate": "q", "object": "rome", "objectType": "reference", "timestamp": "2001-02-03", "location": ""}],
    }
    body.update(changes)
    return {k: v for k, v in body.items() if v != "DROP"}


FAULTS = {
    "invalid field summary": answer(summary="DROP"), "invalid field dateEarliest": answer(dateEarliest="DROP"),
    "invalid field documentType": answer(documentType=7), "invalid field contentTags": answer(contentTags=[1]),
    "invalid field entities": answer(entities=[{"name": "x", "type": "unknown"}]),
    "invalid field triples": answer(triples=[{"subject": "x"}]), "unparsable date": answer(dateLatest="soon"),
}


def parsed_answers(spark):
    rows = [(1, "D1", "```json\n" + json.dumps(answer()) + "\n```"), (2, "D2", "sorry"), (3, "D3", "{broken}")]
    rows += [(10 + i, why, json.dumps(body)) for i, (why, body) in enumerate(FAULTS.items())]
    return analyses.parse_analyses(spark.createDataFrame(rows, "document_id long, doc_id string, response string"))


def test_analysis_validation(spark):
    got = {r.doc_id: (r.analysis_status, r.error_message) for r in parsed_answers(spark).collect()}
    assert got["D1"] == ("complete", None)
    assert got["D2"] == ("failed", "no JSON found") and got["D3"] == ("failed", "JSON parse error")
    assert {k: v[1] for k, v in got.items() if k in FAULTS} == {k: k for k in FAULTS}
    typed = analyses.document_analysis(parsed_answers(spark)).first()
    assert typed.date_earliest is None and str(typed.date_latest) == "2001-01-01"


def test_entities_mentions_and_triples(spark):
    parsed = parsed_answers(spark)
    resolved = loading.resolve_endpoints(parsed)
    found = loading.upsert_entities(None, loading.entity_batch(parsed, resolved))
    ids = {r.id: (r.canonical_name, r.entity_type) for r in found.collect()}
    assert sorted(ids.values()) == [("Ann", "organization"), ("New One", "person"), ("Rome", "location"), ("ann", "person")]
    assert loading.id_collisions(found).count() == 0
    counts = {ids[r.entity_id]: (r.mention_count, r.context_snippet) for r in loading.link_mentions(analyses.listed_entities(parsed)).collect()}
    assert counts == {("Ann", "organization"): (2, None), ("ann", "person"): (1, "c")}
    triples = loading.load_triples(parsed, resolved).orderBy("sequence_order").collect()
    got = [(ids[t.subject_id], ids[t.object_id], ids.get(t.location_id), t.tags) for t in triples]
    # The last listed spelling wins inside a document; a missing name keeps its first use.
    assert got == [(("Ann", "organization"), ("New One", "person"), ("Rome", "location"), []),
                   (("New One", "person"), ("Rome", "location"), None, [])]
    again = loading.upsert_entities(
        found, spark.createDataFrame([("Ann", "organization", ["A"], "x"), ("Zed", "person", ["Z"], "y")], "canonical_name string, entity_type string, aliases array<string>, description string"))
    assert {r.canonical_name: (r.aliases, r.description) for r in again.where("size(aliases) > 0").collect()} == {"Ann": (["A"], None), "Zed": (["Z"], "y")}


def test_document_upsert_and_findings(spark):
    schema = "doc_id string, full_text string, summary string"
    target = spark.createDataFrame([("a", "old", None), ("b", "old", "s")], schema)
    batch = spark.createDataFrame([("a", None, "n"), ("b", "new", "n"), ("c", "new", "n")], schema)
    got = sorted(map(tuple, loading.upsert_documents(target, batch).collect()))
    assert got == [("a", "old", None), ("b", "new", "s"), ("c", "new", "n")]
    answers = spark.createDataFrame([(1, 'x [{"title": "t", "entityNames": ["Ann", "Who"], "evidence": ["e"], "confidence": 0.5}]'), (2, "nothing")], "id long, response string")
    hypotheses = analyses.parse_hypotheses(answers)
    entities = spark.createDataFrame([(5, "Ann"), (6, "Ann")], "id long, canonical_name string")
    assert [(r.id, r.entity_ids, r.status) for r in loading.save_findings(hypotheses, entities).collect()] == [(1, [5, 6], "hypothesis")]


def test_search_ranks_and_snippets(spark):
    docs = spark.createDataFrame(
        [(1, "the apache license"), (2, "apache and nothing"), (3, "license " + "x " * 200 + "apache"), (4, "Licenses of Apache")],
        "id long, full_text string")
    queries = spark.createDataFrame([(1, "apache"), (2, "Apache the license"), (3, "the of"), (4, "absent")], "query_id long, q string")
    got = {(r.query_id, r.id): r["rank"] for r in search.full_text_search(search.build_postings(docs), queries).collect()}
    assert {k[0] for k in got} == {1, 2} and len(got) == 7
    assert got[(1, 1)] == pytest.approx(0.0607927, abs=1e-6) and got[(2, 1)] == pytest.approx(0.0991032, abs=1e-6)
    assert got[(2, 3)] < got[(2, 4)] < got[(2, 1)]
    top = search.search_text(docs, "apache license", 1).first()
    assert top.id == 1 and top.snippet == "the <mark>apache</mark> <mark>license</mark>"
    stemmed = {r.id: r.snippet for r in search.search_text(docs, "license", 9).collect()}
    assert stemmed[4] == "<mark>Licenses</mark> of Apache"
    with pytest.raises(ValueError):
        search.search_text(docs, "")


def test_extraction(spark):
    docs = spark.createDataFrame([(1, "Pay $1,200.50 to Acme Trade on 2001-02-03. ACME trade again, acme other."), (3, "12001-02-03, then 2001-02-03"), (2, "nothing")], "id long, full_text string")
    known = spark.createDataFrame([("Acme Trade", "organization"), ("Unseen Name", "person")], "name string, entity_type string")
    rows = extraction.extract_mentions(docs, None, known).collect()
    got = {(r.document_id, r.name): (r.entity_type, r.mention_count, r.first_mention) for r in rows}
    assert got == {(1, "$1,200.50"): ("financial", 1, 4), (1, "2001-02-03"): ("date", 1, 31), (1, "Acme Trade"): ("organization", 2, 17),
                   (3, "2001-02-03"): ("date", 1, 18)}
    context = {(r.document_id, r.name): r.context_snippet for r in rows}
    assert context[1, "Acme Trade"] == "Pay $1,200.50 to Acme Trade on 2001-02-03. ACME trade again, acme o"
    assert context[3, "2001-02-03"] == "12001-02-03, then 2001-02-03"
    many = spark.createDataFrame([(" ".join(f"w{i}" for i in range(40)), "phrase")], "name string, entity_type string")
    long = spark.createDataFrame([(1, "x " + " ".join(f"W{i}" for i in range(41)))], "id long, full_text string")
    assert [(r.mention_count, r.first_mention) for r in extraction.gazetteer_mentions(long, many).collect()] == [(1, 2)]


def test_typed_names_without_a_list(spark):
    text = "Mr. John Q. Doe met Judge Ann and Mary B. Poe at 12 Main Street, Springfield, IL 62704 for Acme Trade Corp."
    rows = extraction.extract_mentions(spark.createDataFrame([(1, text)], "id long, full_text string")).collect()
    found = {(r.entity_type, r.name) for r in rows if r.entity_type in ("person", "organization", "location")}
    assert found == {("person", "Mr. John Q. Doe"), ("person", "Judge Ann"), ("person", "Mary B. Poe"), ("location", "12 Main Street"),
                     ("location", "Springfield, IL 62704"), ("organization", "Acme Trade Corp")}


def test_gazetteer_equals_brute_force(spark):
    chance = random.Random(2)
    vocabulary = ["a", "B", "cc", "Ünï", "x9", "the"]
    text = lambda n: "".join(chance.choice(vocabulary) + chance.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    docs = [(i, text(chance.randint(0, 700))) for i in range(12)] + [(50, ""), (51, None), (52, "!?")]
    names = [(text(n), kind) for n in (1, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8, 9) for kind in ("person", "organization")] + [("the", "person"), ("...", "person")]
    split = lambda t: [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t or "")]
    want = {}
    runs = {}
    for name, kind in names:
        key = (tuple(w for w, _, _ in split(name)), kind)
        runs[key] = min(runs.get(key, name), name)
    for doc, body in docs:
        found = split(body)
        for (run, kind), name in runs.items():
            at = [i for i in range(len(found) - len(run) + 1) if run and tuple(w for w, _, _ in found[i : i + len(run)]) == run]
            if at:
                begin, end = found[at[0]][1], found[at[0] + len(run) - 1][2]
                want[doc, name, kind] = (len(at), begin, body[max(begin - 40, 0) : end + 40])
    rows = extraction.gazetteer_mentions(spark.createDataFrame(docs, "id long, full_text string"), spark.createDataFrame(names, "name string, entity_type string")).collect()
    assert {(r.document_id, r.name, r.entity_type): (r.mention_count, r.first_mention, r.context_snippet) for r in rows} == want and len(want) > 50
    none = extraction.gazetteer_mentions(spark.createDataFrame(docs, "id long, full_text string"), spark.createDataFrame([], "name string, entity_type string"))
    assert none.count() == 0


def brute_rank(text, asked, stem):
    """Rank of one text by the published formulas, or None if a term is missing."""
    found = {}
    for i, w in enumerate(re.findall(r"[^\W_]+", text.lower())):
        if w not in search.STOP_WORDS and stem[w] in asked:
            found.setdefault(stem[w], []).append(i)
    if not asked or set(found) != asked:
        return None
    if len(found) == 1:
        (at,) = found.values()
        return sum(0.1 / j**2 for j in range(1, len(at) + 1)) / 1.64493406685
    log = sum(math.log(1 - 0.1 / math.sqrt(1.005 + 0.05 * math.exp(abs(p - q) / 1.5 - 2)))
              for a, b in itertools.combinations(found, 2) for p in found[a] for q in found[b] if abs(p - q) <= 100)
    return 1 - math.exp(log)


@pytest.mark.parametrize("k", [3, 1000])
def test_stored_index_equals_full_ranking(spark, k):
    """Stemmed queries of one to three words, block by block, against brute force; fewer blocks are read for a small k."""
    chance = random.Random(k)
    vocabulary = ["running", "runs", "licenses", "license", "connected", "connection", "apache", "the", "of", "banks", "quick", "ties"] + [f"word{i}" for i in range(60)]
    texts = [" ".join(chance.choices(vocabulary, k=chance.choice([5, 20, 60, 300]))) for _ in range(400)] + ["quick ties"] * 7 + ["", "the of"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9999, None)], "id long, full_text string")
    asked = ["run", "licenses", "connecting banks", "quick ties", "the", "absent", "license runs quick", "Quick, quick ties!"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, q string")
    index = search_index.SearchIndex.build(docs, scratch_dir(spark, "index"), block_documents=20, buckets=3)
    again = search_index.SearchIndex(spark, index.folder)
    got = {}
    for r in again.search(queries, k).collect():
        got.setdefault(r.query_id, []).append((r.place, r.id, r["rank"]))
    forms = sorted({w for t in [*texts, *asked] for w in re.findall(r"[^\W_]+", t.lower())})
    stems = {r.term: r.stem for r in stem_terms(spark.createDataFrame([(w,) for w in forms], "term string")).collect()}
    for number, q in enumerate(asked):
        terms = {stems[w] for w in re.findall(r"[^\W_]+", q.lower()) if w not in search.STOP_WORDS}
        ranks = [(i, brute_rank(t, terms, stems)) for i, t in enumerate(texts)]
        want = sorted(((-round(r, 9), i) for i, r in ranks if r is not None))[:k]
        mine = sorted(got.get(number, []))
        assert [i for _, i, _ in mine] == [i for _, i in want], q
        assert all(abs(x[2] + y[0]) < 2e-9 for x, y in zip(mine, want, strict=True))
    assert again.blocks_read <= again.blocks_met and (k == 1000 or again.blocks_read < 0.8 * again.blocks_met)
    postings = search.build_postings(docs)
    plain = {(r.query_id, r.place, r.id) for r in search.full_text_search(postings, queries, k).collect()}
    assert plain == {(n, p, i) for n, rows in got.items() for p, i, _ in rows}


def test_best_fragment(spark):
    far = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"alpha {far} beta alpha x x x beta {far} alpha y beta {far}"), (2, "beta alpha"), (3, f"{far} alpha {far} beta")], "id long, full_text string")
    queries = spark.createDataFrame([(1, "alpha beta")], "query_id long, q string")
    results = spark.createDataFrame([(1, 1, 0.5, 1), (1, 2, 0.4, 2), (1, 3, 0.3, 3)], "query_id long, id long, rank double, place int")
    got = {r.id: r.snippet.split(" ") for r in search.snippets(results, docs, queries, config="simple").collect()}
    assert got[2] == ["<mark>beta</mark>", "<mark>alpha</mark>"]
    assert len(got[1]) == len(got[3]) == 20 and got[1][9:13] == ["<mark>beta</mark>", "<mark>alpha</mark>", "x", "x"] and got[3][9] == "<mark>alpha</mark>"
    wide = spark.createDataFrame([(1, "alpha " + " ".join(["z"] * 30) + " beta " + "tail " * 30)], "id long, full_text string")
    snippet = search.snippets(results.where("id = 1"), wide, queries, config="simple").first().snippet.split(" ")
    assert len(snippet) == 32 and snippet[0] == "<mark>alpha</mark>" and snippet[-1] == "<mark>beta</mark>"
    tie = spark.createDataFrame([(8, "alpha beta"), (5, "alpha beta"), (7, "alpha beta")], "id long, full_text string")
    best = search.full_text_search(search.build_postings(tie, config="simple"), queries, 2, "simple").collect()
    assert sorted((r.place, r.id) for r in best) == [(1, 5), (2, 7)]


def test_a_document_runs_on_in_the_next_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("lost\nDOC1\none\n")
    (tmp_path / "b.txt").write_text("two\nDOC2\nx\n")
    (tmp_path / "c.txt").write_text("y\n")
    rows = lines.segment_documents(lines.read_lines(spark, str(tmp_path)), r"^DOC\d+$").collect()
    assert sorted((r.doc_id, r.full_text) for r in rows) == [("DOC1", "one\ntwo"), ("DOC2", "x\ny")]


def test_merging_follows_the_batches(spark):
    rows = [(1, 1, 2, None, 1), (1, 1, 3, "late", 3), (1, 1, 1, "early", 2)]
    df = spark.createDataFrame(rows, "document_id long, entity_id long, mention_count int, context_snippet string, batch_id long")
    assert [tuple(r) for r in loading.merge_counts(df, "batch_id").collect()] == [(1, 1, 6, "early")]
    batch = spark.createDataFrame(
        [("A", "person", ["x", "y"], None, 2), ("A", "person", ["z"], "second", 2), ("A", "person", ["b"], "third", 3), ("A", "person", ["c"], None, 1)],
        "canonical_name string, entity_type string, aliases array<string>, description string, batch_id long")
    first = loading.upsert_entities(None, batch, order="batch_id").first()
    assert (first.aliases, first.description) == (["c", "x", "y", "z", "b"], "second")
    target = spark.createDataFrame([(7, "A", "person", ["y", "old"], "kept")], "id long, canonical_name string, entity_type string, aliases array<string>, description string")
    both = loading.upsert_entities(target, batch, dedup=True, order="batch_id").first()
    assert (both.id, both.aliases, both.description) == (7, ["y", "old", "c", "x", "z", "b"], "kept")


def test_merged_entities(spark):
    entities = spark.createDataFrame(
        [(1, "J. Smith", "person", []), (2, "John Smith", "person", ["JS"]), (3, "John Smith", "organization", []), (4, "Ann", "person", [])],
        "id long, canonical_name string, entity_type string, aliases array<string>")
    names = entities.selectExpr("id", "canonical_name as name", "if(id = 2, 9, 1) as mentions")
    clusters = aliases.cluster_aliases(names)
    assert {r.original_name: r.entity_id for r in aliases.alias_table(clusters).collect()} == {"J. Smith": 2}
    merges = aliases.same_type_merges(clusters, entities)
    assert {r.id: r.entity_id for r in merges.collect()} == {1: 2, 2: 2, 3: 3, 4: 4}
    merged = {r.id: r.aliases for r in aliases.merge_entities(entities, merges).collect()}
    assert merged == {2: ["JS", "J. Smith"], 3: [], 4: []}
    triples = spark.createDataFrame([(1, 3, None), (4, 1, 2)], "subject_id long, object_id long, location_id long")
    renamed = aliases.renamed_ids(triples, merges, triples.columns).collect()
    assert sorted(map(tuple, renamed)) == [(2, 3, None), (4, 2, 2)]


def test_streams_in_many_batches_equal_one(spark):
    rows = [(i, f"D{i}", json.dumps(answer(entities=[{"name": f"N{i % 3}", "type": "person"}], triples=[]))) for i in range(12)] + [(99, "D99", "bad")]
    results = []
    for parts in (1, 4):
        source, out, marks = (scratch_dir(spark, x) for x in ("src", "out", "mark"))
        df = spark.createDataFrame(rows, "document_id long, doc_id string, response string")
        df.repartition(parts, "document_id").write.parquet(source)
        ingest.ingest_stream(spark, source, out, marks, files_per_batch=1)
        ingest.load_batch(df.limit(5), out, 1000)  # a repeat of settled documents adds nothing
        tables = ingest.read_ingested(spark, out)
        results.append((sorted(map(tuple, tables["mentions"].collect())), tables["status"].groupBy("analysis_status").count().orderBy("count").collect()))
    assert results[0] == results[1] and len(results[0][0]) == 12

    pairs = [(d, e) for d in range(20) for e in (d % 5, d % 7 + 10, 50)]
    frames = []
    for parts in (1, 3):
        source, out, marks = (scratch_dir(spark, x) for x in ("src", "out", "mark"))
        spark.createDataFrame(pairs, "document_id long, entity_id long").repartition(parts).write.parquet(source)
        stats.stats_stream(spark, source, out, marks, files_per_batch=1)
        frames.append(sorted(map(tuple, stats.current_stats(spark, out).collect())))
    assert frames[0] == frames[1] and (50, 20, 12) in frames[0]
