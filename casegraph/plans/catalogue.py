"""Every registered query, with the SQL that must give the same rows.

The SQL states the meaning directly over the sample tables and never follows the way the Spark
side computes it. Queries without SQL are marked; tests check those against small fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from casegraph.functions.text import normalize_name, parse_date, trigram_similarity, truncate_text, words as filter_words
from casegraph.operators import aliases, cooccurrence as co, crossref, extraction, filters, patterns, ranking, search, traversal
from casegraph.operators.evidence import evidence_chains, locate_quotes
from casegraph.operators.search_index import SearchIndex
from casegraph.operators.typos import typo_pairs
from casegraph.plans.sample_model import (
    CUSTOMER, MARKER, ROOT, SampleModel, spelled, sql_customer, sql_part, sql_similarity, sql_supplier, sql_trigrams, sql_words, with_sql,
)
from casegraph.sources import analyses, lines, loading
from casegraph.sources.exports import ChangeExport
from casegraph.sources.lines import extract_documents
from casegraph.sources.registry import load_registry
from casegraph.sources.schemas import REGISTRIES as SCHEMAS
from casegraph.streaming import ingest, stats
from casegraph.workspace import checkpointed, scratch_dir, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, uses: tuple[str, ...] = ()):
    def register(build: Callable[[SampleModel], DataFrame]):
        name = build.__name__.removeprefix("q_")
        QUERIES[name] = lambda spark, folder: build(SampleModel(spark, folder))
        if sql is not None:
            ORACLES[name] = (with_sql(*uses) if uses else "") + sql
        return build

    return register


def _r(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


def _day(column: str):
    return F.col(column).cast("string").alias(column)


# --- statistics and plain lists -------------------------------------------------------------


@query(
    """SELECT 'documents' AS table_name, count(*) AS n FROM doc UNION ALL SELECT 'entities', count(*) FROM ent
    UNION ALL SELECT 'triples', count(*) FROM trip UNION ALL SELECT 'ppp_loans', count(*) FROM ppp
    UNION ALL SELECT 'fec_contributions', count(*) FROM fec UNION ALL SELECT 'federal_grants', count(*) FROM grants
    UNION ALL SELECT 'pattern_findings', count(*) FROM hyp""",
    ("doc", "ent", "trip", "ppp", "fec", "grants", "hyp"),
)
def q_corpus_stats(m):
    r = m.registries
    return filters.corpus_stats(
        {
            "documents": m.documents, "entities": m.names, "triples": m.triples, "ppp_loans": r["ppp"],
            "fec_contributions": r["fec"], "federal_grants": r["grants"], "pattern_findings": m.findings,
        }
    )


@query("SELECT analysis_status AS status, count(*) AS n FROM doc GROUP BY 1", ("doc",))
def q_status_counts(m):
    return filters.status_counts(m.documents, "analysis_status")


@query("SELECT id, lang FROM texts WHERE analysis_status = 'pending' AND full_text IS NOT NULL", ("texts",))
def q_pending_documents(m):
    return filters.pending(m.texts).select("id", "lang")


@query(
    """SELECT id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id AS id, CASE WHEN length(text) > 5000
    THEN substring(text, 1, 5000) || chr(10) || chr(10) || '[TRUNCATED - document continues...]' ELSE text END AS t
    FROM documents)"""
)
def q_truncate_text(m):
    cut = m.texts.select("id", truncate_text(F.col("full_text"), 5000).alias("t"))
    return cut.select("id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


@query(
    """SELECT id, canonical_name, entity_type FROM ent WHERE id IN (SELECT entity_id FROM fent)""", ("ent", "fent")
)
def q_lookup_entities(m):
    ids = m.findings.select(F.explode("entity_ids").alias("id"))
    return filters.lookup(m.names, ids)


@query(
    """SELECT finding_id, e.id AS entity_id, canonical_name FROM fent JOIN ent e ON e.id = entity_id""", ("fent", "ent")
)
def q_expand_ids(m):
    found = m.findings.select(F.col("id").alias("finding_id"), "entity_ids")
    dim = m.names.select("id", "canonical_name")
    return filters.expand_ids(found, "entity_ids", dim).select("finding_id", F.col("id").alias("entity_id"), "canonical_name")


@query(
    """SELECT id, doc_id, dataset_id, document_type, summary, date_earliest::VARCHAR AS date_earliest,
    date_latest::VARCHAR AS date_latest FROM doc WHERE document_type = '2-HIGH' AND dataset_id = 2
    ORDER BY doc_id LIMIT 50 OFFSET 20""", ("doc",),
)
def q_list_documents(m):
    page = ranking.list_documents(m.documents, document_type="2-HIGH", dataset=2, k=50, offset=20)
    return filters.document_summary(page)


@query("SELECT dataset_id, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM doc GROUP BY 1", ("doc",))
def q_dataset_buckets(m):
    return m.documents.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


# --- co-occurrence --------------------------------------------------------------------------


@query("SELECT source, target, weight FROM net", ("net",))
def q_cooccurrence_edges(m):
    return m.network


@query("SELECT source, target, weight FROM net", ("net",))
def q_cooccurrence_hubs(m):
    """Documents of more than four people and organizations are cut into blocks."""
    return co.edges(m.mentions, m.entities, hub_size=4)


@query("SELECT id, document_count, connection_count FROM stats WHERE document_count > 0", ("stats",))
def q_stats_hubs(m):
    return co.entity_stats(m.mentions, hub_size=8)


@query(
    """SELECT a.entity_id AS entity1_id, e1.canonical_name AS entity1_name, e1.entity_type AS entity1_type,
    b.entity_id AS entity2_id, e2.canonical_name AS entity2_name, e2.entity_type AS entity2_type,
    count(DISTINCT a.document_id) AS shared_documents
    FROM men a JOIN men b ON a.document_id = b.document_id AND a.entity_id < b.entity_id
    JOIN ent e1 ON e1.id = a.entity_id JOIN ent e2 ON e2.id = b.entity_id
    GROUP BY ALL""", ("men", "ent"),
)
def q_entity_connections(m):
    return co.entity_connections(m.mentions, m.names)


_SHARED_DOCUMENTS = """SELECT a.entity_id AS source, b.entity_id AS target, doc_id FROM men a
    JOIN men b ON a.document_id = b.document_id AND a.entity_id < b.entity_id JOIN doc d ON d.id = a.document_id"""


@query(_SHARED_DOCUMENTS, ("men", "doc"))
def q_connection_documents(m):
    """Every document that two entities share."""
    return co.pair_documents(m.mentions, m.documents)


@query("SELECT id, document_count, connection_count FROM stats WHERE document_count > 0", ("stats",))
def q_entity_stats(m):
    return co.entity_stats(m.mentions)


@query(
    """SELECT entity_id, id, canonical_name, entity_type, shared_docs, rank FROM (
    SELECT b.source AS entity_id, e.id, canonical_name, entity_type, weight AS shared_docs,
    row_number() OVER (PARTITION BY b.source ORDER BY weight DESC, b.target) AS rank
    FROM sym b JOIN ent e ON e.id = b.target) WHERE rank <= 50""", ("sym", "ent"),
)
def q_top_connections(m):
    with_layer = m.names.withColumn("layer", F.lit(None).cast("int"))
    return co.connections(m.mentions, with_layer, 50).drop("layer")


@query(
    """SELECT entity_id, id, canonical_name, entity_type, shared_docs, rank FROM (
    SELECT b.source AS entity_id, e.id, canonical_name, entity_type, weight AS shared_docs,
    row_number() OVER (PARTITION BY b.source ORDER BY weight DESC, b.target) AS rank
    FROM sym b JOIN ent e ON e.id = b.target) WHERE rank <= 5""", ("sym", "ent"),
)
def q_connections_hubs(m):
    return co.connections(m.mentions, m.names.withColumn("layer", F.lit(None).cast("int")), 5, hub_size=8).drop("layer")


# Names of parts without their number are shared by many parts, so merging by name shows.
_NAMED = "SELECT id, CASE WHEN entity_type = 'reference' THEN regexp_replace(canonical_name, ' [0-9]+$', '') ELSE canonical_name END AS name FROM ent"


def _shared_names(m):
    short = F.regexp_replace("canonical_name", " [0-9]+$", "")
    is_part = F.col("entity_type") == "reference"
    return m.names.withColumn("canonical_name", F.when(is_part, short).otherwise(F.col("canonical_name")))


@query(
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY shared_docs DESC, entity2) AS rank
    FROM (SELECT a.entity_id, e1.name AS entity1, e2.name AS entity2, count(DISTINCT a.document_id) AS shared_docs
    FROM men a JOIN men b ON a.document_id = b.document_id AND a.entity_id <> b.entity_id
    JOIN ({_NAMED}) e1 ON e1.id = a.entity_id JOIN ({_NAMED}) e2 ON e2.id = b.entity_id GROUP BY ALL))
    WHERE rank <= 100""", ("men", "ent"),
)
def q_connections_by_name(m):
    return co.connections_by_name(m.mentions, _shared_names(m), None, 100)


@query(
    """SELECT entity_id, document_id, doc_id, document_type, date_earliest::VARCHAR AS date_earliest, rank FROM (
    SELECT entity_id, d.*, d.id AS document_id, row_number() OVER (PARTITION BY entity_id
    ORDER BY date_earliest DESC NULLS LAST, d.id) AS rank FROM men JOIN doc d ON d.id = document_id) WHERE rank <= 50""",
    ("men", "doc"),
)
def q_entity_documents(m):
    rows = co.entity_documents(m.mentions, m.documents, 50)
    return rows.select("entity_id", "document_id", "doc_id", "document_type", _day("date_earliest"), "rank")


@query(
    """SELECT document_id, entity_id, mention_count, canonical_name, entity_type,
    row_number() OVER (PARTITION BY document_id ORDER BY mention_count DESC NULLS FIRST, entity_id)::INT AS place
    FROM (SELECT document_id, entity_id, CASE WHEN entity_id % 7 <> 0 THEN mention_count END AS mention_count FROM men)
    JOIN ent ON ent.id = entity_id""", ("men", "ent"),
)
def q_document_entities(m):
    """Every seventh entity's counts are unknown here, so that their place shows."""
    partly = m.mentions.withColumn("mention_count", F.when(F.col("entity_id") % 7 != 0, F.col("mention_count")))
    return co.document_entities(partly, m.names.withColumn("layer", F.lit(None).cast("int"))).drop("layer")


@query(
    """SELECT source, target, weight AS shared_documents FROM (
    SELECT a.entity_id AS source, b.entity_id AS target, count(DISTINCT a.document_id) AS weight
    FROM men a JOIN men b ON a.document_id = b.document_id AND a.entity_id <> b.entity_id
    WHERE a.document_id IN (SELECT id FROM doc WHERE document_type = '1-URGENT') GROUP BY ALL)""", ("men", "doc"),
)
def q_comention_by_type(m):
    return co.comention_by_type(m.mentions, m.documents, "1-URGENT")


# --- layers and network ---------------------------------------------------------------------


@query("SELECT id, layer FROM layers", ("layers",))
def q_layers(m):
    return traversal.classify_layers(m.names, m.mentions, ROOT)


@query(
    """SELECT layer, id, canonical_name, entity_type, document_count, connection_count, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY layer ORDER BY connection_count DESC, id) AS rank FROM layered
    WHERE entity_type IN ('person', 'organization')) WHERE rank <= 100""", ("layered",),
)
def q_entities_by_layer(m):
    return ranking.entities_by_layer(m.layered, 100)


_NODES = """SELECT id, canonical_name, entity_type, document_count, connection_count FROM stats
    WHERE entity_type IN ('person', 'organization') AND connection_count >= 2
    ORDER BY connection_count DESC, id LIMIT 1000"""


@query(_NODES, ("stats",))
def q_network_nodes(m):
    return ranking.network_nodes(m.entities, 2, 1000)


@query(
    f"""SELECT source, target, weight FROM (SELECT * FROM net ORDER BY weight DESC, source, target LIMIT 3000)
    WHERE source IN (SELECT id FROM ({_NODES})) AND target IN (SELECT id FROM ({_NODES}))""", ("net", "stats"),
)
def q_network_edges(m):
    return co.network(m.entities, m.mentions, 1000, 2)[1]


@query(
    f"""SELECT count(*) AS returned, (SELECT count(*) FROM eligible) AS total FROM ({_NODES})""", ("stats", "eligible")
)
def q_network_counts(m):
    people = filters.min_degree(filters.of_types(m.entities, ranking.PEOPLE_AND_ORGS), 2)
    return filters.with_counts(ranking.network_nodes(m.entities, 2, 1000), people)


# --- names, similarity, registries ----------------------------------------------------------


@query(
    r"""SELECT doc_id AS id, md5(lower(regexp_replace(regexp_replace(strip_accents(replace(replace(replace(
    text, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')), '[^a-zA-Z0-9 ]', '', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents"""
)
def q_normalize_name(m):
    return m.texts.select("id", F.md5(normalize_name(F.col("full_text"))).alias("digest"))


@query(
    f"""SELECT a.item_id, d.doc_id, round({sql_similarity('a.g', 'd.g')}, 6) AS score
    FROM (SELECT item_id, {sql_trigrams('text')} AS g FROM benchmark) a
    JOIN (SELECT doc_id, {sql_trigrams('text')} AS g FROM documents) d ON a.item_id = d.doc_id % (SELECT count(*) FROM benchmark)"""
)
def q_trigram_similarity(m):
    """Every document with one of the benchmark items."""
    items = m.table("benchmark")
    docs = m.table("documents").select("doc_id", F.col("text").alias("t"), (F.col("doc_id") % items.count()).alias("item_id"))
    joined = items.join(docs, "item_id")
    return joined.select("item_id", "doc_id", F.round(trigram_similarity(F.col("text"), F.col("t")), 6).alias("score"))


_ASKED = "household trading small brand"


@query(
    f"""SELECT id, canonical_name, entity_type, n_chars, round(score, 6) AS score FROM (
    SELECT named.*, {sql_similarity('g', sql_trigrams(f"'{_ASKED}'"))} AS score FROM named JOIN grams USING (canonical_name))
    WHERE (canonical_name ILIKE '%{_ASKED}%' OR score >= 0.3) AND entity_type = 'person'
    ORDER BY score DESC, n_chars DESC NULLS FIRST, id LIMIT 100""", ("named", "grams"),
)
def q_search_entities(m):
    named = m.named.withColumn("document_count", F.col("n_chars"))
    found = ranking.search_entities(named, _ASKED, entity_type="person", k=100)
    return found.select("id", "canonical_name", "entity_type", "n_chars", _r("score"))


def _registry_search_sql(table: str, name: str, amount: str, extra: str = "TRUE") -> str:
    return f"""SELECT '{table}' AS registry, id, {name} AS name, {amount}::DOUBLE AS amount, round(score, 6) AS score FROM (
    SELECT t.*, {sql_similarity('g', sql_trigrams(f"'{_ASKED}'"))} AS score FROM {table} t JOIN grams ON canonical_name = {name})
    WHERE ({name} ILIKE '%{_ASKED}%' OR score >= 0.3) AND {extra} ORDER BY score DESC, {amount} DESC NULLS LAST, id LIMIT 50"""


@query(
    "SELECT * FROM (" + _registry_search_sql("ppp", "borrower_name", "loan_amount") + ") UNION ALL SELECT * FROM ("
    + _registry_search_sql("fec", "contributor_name", "amount", "candidate_name ILIKE '%urgent%'") + ") UNION ALL SELECT * FROM ("
    + _registry_search_sql("grants", "recipient_name", "award_amount", "awarding_agency ILIKE '%urgent%'") + ")",
    ("ppp", "fec", "grants", "grams"),
)
def q_search_registry(m):
    asked = {"ppp": None, "fec": "candidate_name", "grants": "awarding_agency"}
    parts = []
    for source, label in asked.items():
        spec = crossref.REGISTRIES[source]
        found = ranking.search_registry(m.registries[source], spec.name_col, spec.amount_col, _ASKED, label, "urgent")
        parts.append(found.select(
            F.lit(source).alias("registry"), "id", F.col(spec.name_col).alias("name"),
            F.col(spec.amount_col).cast("double").alias("amount"), _r("score")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _match_sql(source: str, name: str, types: str) -> str:
    return f"""SELECT e.id AS entity_id, '{source}' AS source, r.id AS source_id, score AS match_score,
    row_number() OVER (PARTITION BY e.id ORDER BY score DESC, r.id) AS place
    FROM named e JOIN alike s ON s.name1 = lower(e.canonical_name) JOIN {source} r ON lower(r.{name}) = s.name2
    WHERE e.entity_type IN ({types})"""


_MATCHES = (
    "SELECT entity_id, source, source_id, match_score FROM ("
    + _match_sql("ppp", "borrower_name", "'person', 'organization'") + " UNION ALL "
    + _match_sql("fec", "contributor_name", "'person'") + " UNION ALL "
    + _match_sql("grants", "recipient_name", "'person', 'organization'") + ") WHERE place <= 5"
)
_MATCH_TABLES = ("named", "alike", "ppp", "fec", "grants")


@query(f"SELECT entity_id, source, source_id, round(match_score, 6) AS match_score FROM ({_MATCHES})", _MATCH_TABLES)
def q_fuzzy_match(m):
    return crossref.match_all(m.named, m.registries).select("entity_id", "source", "source_id", _r("match_score"))


def _reviewed(m):
    """The matches of q_fuzzy_match; a reviewer marked entities whose name is longer than 22 as wrong."""
    long_names = m.named.where(F.length("canonical_name") > 22).select(F.col("id").alias("entity_id"), F.lit(True).alias("wrong"))
    found = crossref.match_all(m.named, m.registries).join(long_names, "entity_id", "left")
    return checkpointed(found.withColumn("false_positive", F.coalesce("wrong", F.lit(False))).drop("wrong"))


@query(
    f"""SELECT e.id, CASE WHEN x.n IS NULL THEN 'none' WHEN length(e.canonical_name) > 22 THEN 'rejected' ELSE 'matched' END AS state,
    CASE WHEN x.n IS NULL OR length(e.canonical_name) > 22 THEN '' ELSE x.ids END AS ids
    FROM named e LEFT JOIN (SELECT entity_id, count(*) AS n, string_agg(source_id, ',' ORDER BY match_score DESC, source_id) AS ids
    FROM ({_MATCHES}) WHERE source = 'ppp' GROUP BY 1) x ON x.entity_id = e.id""", _MATCH_TABLES,
)
def q_crossref_summary(m):
    rows = crossref.crossref_summary(m.named, _reviewed(m), m.registries["ppp"], "ppp")
    found = F.col("ppp_matches")
    return rows.select(
        "id",
        F.when(found.isNull(), "rejected").when(F.size(found) == 0, "none").otherwise("matched").alias("state"),
        F.coalesce(F.array_join(F.transform(found, lambda x: x["id"].cast("string")), ","), F.lit("")).alias("ids"))


@query(
    f"""SELECT source, count(*) AS n FROM ({_MATCHES}) GROUP BY 1""", _MATCH_TABLES
)
def q_match_counts(m):
    found = checkpointed(crossref.save_matches(None, crossref.match_all(m.named, m.registries)))
    again = crossref.save_matches(found, found)
    return again.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT e.id, canonical_name FROM named e
    WHERE e.id IN (SELECT entity_id FROM ({_MATCHES}) WHERE source = 'fec')""", _MATCH_TABLES,
)
def q_has_match(m):
    return filters.has_match(m.named, _reviewed(m), "fec").select("id", "canonical_name")


@query(
    f"""SELECT id, canonical_name, n_chars AS connection_count FROM named WHERE length(canonical_name) <= 22
    AND id IN (SELECT entity_id FROM ({_MATCHES})) ORDER BY n_chars DESC, id LIMIT 100""", _MATCH_TABLES,
)
def q_cross_referenced_sample(m):
    counted = m.named.select(
        "id", "canonical_name", "entity_type", F.lit(0).alias("layer"), F.lit(1).alias("document_count"),
        F.col("n_chars").alias("connection_count"))
    matched = crossref.with_crossrefs(counted, _reviewed(m), m.registries)
    return patterns.cross_referenced_sample(matched).select("id", "canonical_name", "connection_count")


_CLUSTER_NAMES = f"""names AS MATERIALIZED (SELECT id, name, n_chars,
    array_to_string(list_filter(string_split(trim(lower(regexp_replace(regexp_replace(strip_accents(replace(
    regexp_replace(name, '[\\s\\-]+', ' ', 'g'), 'ß', 'ss')), '[^a-zA-Z0-9 ]', '', 'g'), '\\s+', ' ', 'g'))), ' '),
    lambda t: t NOT IN ({', '.join(f"'{s}'" for s in aliases.COMPANY_SUFFIXES)})), ' ') AS plain FROM spelling),
parts AS (SELECT id, string_split(plain, ' ') AS t FROM names),
people AS MATERIALIZED (SELECT id, t[1] AS first, t[-1] AS last, array_to_string(t[2:-2], ' ') AS middle FROM parts
    WHERE len(t) >= 2 AND length(t[-1]) > 1 AND length(array_to_string(t[2:-2], ' ')) <= 1),
links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM names a JOIN names b ON a.plain = b.plain AND a.plain <> ''
    UNION SELECT a.id, b.id FROM short_alike s JOIN names a ON lower(a.name) = s.name1 JOIN names b ON lower(b.name) = s.name2
    UNION SELECT f.id, p.id FROM people p JOIN people f ON p.last = f.last AND p.first = substring(f.first, 1, 1)
        WHERE length(p.first) = 1 AND length(f.first) > 1 AND (SELECT count(DISTINCT q.first) FROM people q
        WHERE q.last = p.last AND substring(q.first, 1, 1) = p.first AND length(q.first) > 1) = 1
    UNION SELECT f.id, p.id FROM people p JOIN people f ON p.last = f.last AND p.first = f.first
        WHERE length(p.first) > 1 AND p.middle = '' AND f.middle <> '' AND (SELECT count(DISTINCT q.middle) FROM people q
        WHERE q.last = p.last AND q.first = p.first AND q.middle <> '') = 1),
heads AS MATERIALIZED (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM links WHERE a <> b),
reach AS (SELECT id, id AS root FROM names UNION SELECT CASE WHEN h.a = r.id THEN h.b ELSE h.a END, r.root
    FROM reach r JOIN heads h ON r.id IN (h.a, h.b)),
placed AS MATERIALIZED (SELECT id, min(root) AS cluster FROM reach GROUP BY 1)
"""


_CANONICAL = """canonical AS MATERIALIZED (SELECT cluster, id AS canonical_id, name AS canonical_name FROM (
    SELECT p.cluster, n.id, n.name, row_number() OVER (PARTITION BY p.cluster
    ORDER BY n_chars DESC, length(n.name) DESC, n.name, n.id) AS rn FROM placed p JOIN names n USING (id)) WHERE rn = 1)
"""


def _clusters(m):
    return aliases.cluster_aliases(m.spellings)


@query(
    ", " + _CLUSTER_NAMES + ", " + _CANONICAL
    + "SELECT p.id, p.cluster, canonical_id, canonical_name FROM placed p JOIN canonical USING (cluster)", ("short_alike", "spelling"),
)
def q_alias_clusters(m):
    return _clusters(m).select("id", "cluster", "canonical_id", "canonical_name")


@query(
    ", " + _CLUSTER_NAMES + ", " + _CANONICAL + """SELECT name AS original_name, canonical_id AS entity_id, 1.0::DOUBLE AS confidence
    FROM placed p JOIN names n USING (id) JOIN canonical USING (cluster) WHERE name <> canonical_name""", ("short_alike", "spelling"),
)
def q_alias_table(m):
    return aliases.alias_table(_clusters(m)).select("original_name", "entity_id", "confidence")


# --- text -----------------------------------------------------------------------------------


@query(
    """SELECT 'DOC' || lpad(doc_id::VARCHAR, 8, '0') AS doc_id, CASE WHEN doc_id <= 3158 THEN 1 WHEN doc_id <= 3857 THEN 2
    WHEN doc_id <= 5586 THEN 3 WHEN doc_id <= 8320 THEN 4 ELSE 5 END AS dataset_id,
    md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10))) AS digest
    FROM documents"""
)
def q_segment_documents(m):
    found = extract_documents(m.spark, m.dump, MARKER)
    return found.select("doc_id", "dataset_id", F.md5("full_text").alias("digest"))


_TOKENS = f"""tokens AS MATERIALIZED (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) AS position
    FROM (SELECT doc_id AS id, {sql_words('text')} AS w FROM documents)),
asked AS MATERIALIZED (SELECT DISTINCT query_id, unnest(w) AS term FROM (SELECT item_id AS query_id, {sql_words('text')} AS w FROM benchmark)),
wanted AS MATERIALIZED (SELECT query_id, count(*) AS n FROM asked GROUP BY 1),
hits AS MATERIALIZED (SELECT query_id, id, term, position FROM tokens JOIN asked USING (term)),
matched AS MATERIALIZED (SELECT query_id, id FROM (SELECT query_id, id, count(DISTINCT term) AS k FROM hits GROUP BY ALL) JOIN wanted USING (query_id) WHERE k = n),
near AS (SELECT query_id, id, 1 - exp(sum(ln(1 - sqrt(0.01 * 1 / (1.005 + 0.05 * exp(abs(a.position - b.position) / 1.5 - 2)))))) AS score
    FROM hits a JOIN hits b USING (query_id, id) JOIN matched USING (query_id, id)
    WHERE a.term < b.term AND a.position <> b.position AND abs(a.position - b.position) <= 100 GROUP BY ALL)
"""


@query(
    "WITH " + _TOKENS + """SELECT query_id, id, round(rank, 6) AS rank, place::INT AS place FROM (
    SELECT query_id, id, coalesce(score, 0) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(score, 0), 9) DESC, id) AS place
    FROM matched LEFT JOIN near USING (query_id, id)) WHERE place <= 100"""
)
def q_full_text_search(m):
    queries = m.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    postings = search.build_postings(m.texts, config="simple", only=search.query_terms(queries, "simple"))
    return search.full_text_search(postings, queries, 100, "simple").select("query_id", "id", _r("rank"), "place")


@query(
    "WITH " + _TOKENS + r""", best AS MATERIALIZED (SELECT query_id, id, rank, place FROM (
    SELECT query_id, id, coalesce(score, 0) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(score, 0), 9) DESC, id) AS place
    FROM matched LEFT JOIN near USING (query_id, id)) WHERE place <= 20),
    cut AS MATERIALIZED (SELECT best.*, string_split_regex(text, '\s+') AS t FROM best JOIN documents ON doc_id = id),
    held AS MATERIALIZED (SELECT DISTINCT query_id, id, p, term FROM (SELECT query_id, id, p, unnest(list_distinct(list_transform(regexp_extract_all(t[p], '[\p{L}\p{N}]+'), lambda y: lower(y)))) AS term
        FROM cut, LATERAL (SELECT unnest(range(1, len(t) + 1)) AS p)) JOIN asked USING (query_id, term)),
    firsts AS (SELECT a.query_id, a.id, a.p, b.term, min(b.p) AS f FROM (SELECT DISTINCT query_id, id, p FROM held) a
        JOIN held b ON a.query_id = b.query_id AND a.id = b.id AND b.p BETWEEN a.p AND a.p + 49 GROUP BY ALL),
    covers AS (SELECT query_id, id, p, count(*) AS n, max(f) - p + 1 AS size FROM firsts GROUP BY query_id, id, p),
    cover AS MATERIALIZED (SELECT query_id, id, p, size FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY n DESC, size, p) AS rn FROM covers) WHERE rn = 1),
    part AS (SELECT cut.*, greatest(size, 20) AS len, greatest(1, least(p - (greatest(size, 20) - size) // 2, len(t) - greatest(size, 20) + 1)) AS s FROM cut JOIN cover USING (query_id, id)),
    shown AS (SELECT query_id, id, rank, place, unnest(t[s : s + len - 1]) AS w, unnest(range(s, s + len(t[s : s + len - 1]))) AS p FROM part),
    marked AS (SELECT DISTINCT query_id, id, p, true AS hit FROM held)
    SELECT query_id, id, round(any_value(rank), 6) AS rank, any_value(place)::INT AS place,
        string_agg(CASE WHEN hit THEN regexp_replace(w, '([\p{L}\p{N}]+)', '<mark>\1</mark>', 'g') ELSE w END, ' ' ORDER BY p) AS snippet
    FROM shown LEFT JOIN marked USING (query_id, id, p) GROUP BY query_id, id"""
)
def q_snippets(m):
    queries = m.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    postings = search.build_postings(m.texts, config="simple", only=search.query_terms(queries, "simple"))
    best = stored(search.full_text_search(postings, queries, 20, "simple"), "best")
    found = search.snippets(best, m.texts, queries, config="simple")
    return found.select("query_id", "id", _r("rank"), "place", "snippet")


#: Index folders by session, sample folder and configuration; an index is written once and read by its queries.
_INDEXES: dict[tuple[str, str, str], str] = {}


def _index(m, config):
    key = (m.spark.sparkContext.applicationId, m.folder, config)
    if key not in _INDEXES:
        folder = scratch_dir(m.spark, "index")
        SearchIndex.build(m.texts, folder, config, buckets=8)
        _INDEXES[key] = folder
    return SearchIndex(m.spark, _INDEXES[key])


def _short_queries(m):
    """Two words of every benchmark passage: its longest and its first."""
    w = filter_words(F.col("text"))
    longest = F.array_max(F.transform(w, lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    return m.table("benchmark").where(F.size(w) > 0).select(F.col("item_id").alias("query_id"), F.concat_ws(" ", w[0], longest).alias("q"))


@query(
    f"""WITH tokens AS MATERIALIZED (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) AS position
    FROM (SELECT doc_id AS id, {sql_words('text')} AS w FROM documents)),
    asked AS MATERIALIZED (SELECT DISTINCT query_id, unnest([w[1], list_sort(list_transform(w, lambda x: [lpad(length(x)::VARCHAR, 9, '0'), x]))[-1][2]]) AS term
        FROM (SELECT item_id AS query_id, {sql_words('text')} AS w FROM benchmark) WHERE len(w) > 0),
    wanted AS MATERIALIZED (SELECT query_id, count(*) AS n FROM asked GROUP BY 1),
    hits AS MATERIALIZED (SELECT query_id, id, term, position FROM tokens JOIN asked USING (term)),
    counted AS (SELECT query_id, id, count(DISTINCT term) AS k, count(*) AS c FROM hits GROUP BY ALL),
    matched AS MATERIALIZED (SELECT query_id, id, k, c FROM counted JOIN wanted USING (query_id) WHERE k = n),
    near AS (SELECT query_id, id, 1 - exp(sum(ln(1 - sqrt(0.01 * 1 / (1.005 + 0.05 * exp(abs(a.position - b.position) / 1.5 - 2)))))) AS score
        FROM hits a JOIN hits b USING (query_id, id) JOIN matched USING (query_id, id)
        WHERE a.term < b.term AND abs(a.position - b.position) <= 100 GROUP BY ALL),
    ranked AS (SELECT query_id, id, CASE WHEN k = 1 THEN list_sum(list_transform(range(1, c + 1), lambda j: 0.1 / (j * j)::DOUBLE)) / 1.64493406685
        ELSE coalesce(score, 0) END AS rank FROM matched LEFT JOIN near USING (query_id, id))
    SELECT query_id, id, round(rank, 6) AS rank, place::INT AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9) DESC, id) AS place FROM ranked) WHERE place <= 20"""
)
def q_index_search(m):
    """Short queries of the stored index without stems, block by block."""
    return _index(m, "simple").search(_short_queries(m), 20).select("query_id", "id", _r("rank"), "place")


@query()  # Stems are beyond SQL; tests hold the index against the ranking of every document.
def q_stemmed_search(m):
    queries = m.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    return _index(m, "english").search(queries, 100).select("query_id", "id", _r("rank"), "place")


@query()
def q_stemmed_short_search(m):
    return _index(m, "english").search(_short_queries(m), 20).select("query_id", "id", _r("rank"), "place")


@query()
def q_stemmed_snippets(m):
    queries = _short_queries(m)
    best = _index(m, "english").search(queries, 5)
    return search.snippets(best, m.texts, queries).select("query_id", "id", "place", "snippet")


def _mention_sql(kind: str, pattern: str) -> str:
    """Matches in order, each behind all matches and gaps before it."""
    return f"""SELECT document_id, name, '{kind}' AS entity_type, count(*)::INT AS mention_count, min(pos)::INT AS first_mention,
    arg_min(around, pos) AS context_snippet FROM (
    SELECT document_id, m[i] AS name, length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS pos,
    right(g[i], 40) || m[i] || left(g[i + 1], 40) AS around
    FROM (SELECT doc_id AS document_id, regexp_extract_all(text, '{pattern}', 0) AS m, string_split_regex(text, '{pattern}') AS g FROM documents),
    LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i)) GROUP BY document_id, name"""


_RUN = r"[\p{L}\p{N}]+"


@query(
    " UNION ALL ".join(_mention_sql(k, p) for k, p in extraction.PATTERNS.items())
    + f""" UNION ALL SELECT doc_id, name, 'reference', count(*)::INT, min(pos)::INT, arg_min(around, pos) FROM (
    SELECT doc_id, name, pos, substring(text, greatest(pos - 40, 0) + 1, least(pos, 40) + size + 40) AS around FROM (
    SELECT doc_id, text, g.name, length(array_to_string(d.gap[1 : s.i + 1], '')) + length(array_to_string(d.t[1 : s.i], '')) AS pos,
    length(array_to_string(d.t[s.i + 1 : s.i + g.n], '')) + length(array_to_string(d.gap[s.i + 2 : s.i + g.n], '')) AS size
    FROM (SELECT *, array_to_string(w, ' ') AS line FROM (SELECT doc_id, text, regexp_extract_all(text, '{_RUN}') AS t,
        string_split_regex(text, '{_RUN}') AS gap, list_transform(regexp_extract_all(text, '{_RUN}'), lambda x: lower(x)) AS w FROM documents)) d,
    (SELECT array_to_string(w, ' ') AS run, any_value(len(w)) AS n, min(name) AS name FROM (
        SELECT name, {sql_words('name')} AS w FROM (SELECT DISTINCT trim(unnest(string_split(text, '.'))) AS name FROM benchmark))
        WHERE len(w) > 0 GROUP BY 1) g,
    LATERAL (SELECT unnest(range(0, len(d.w) - g.n + 1)) AS i) s
    WHERE contains(d.line, g.run) AND array_to_string(d.w[s.i + 1 : s.i + g.n], ' ') = g.run)) GROUP BY doc_id, name"""
)
def q_extract_mentions(m):
    sentences = m.table("benchmark").select(F.explode(F.split("text", r"\.")).alias("name"))
    known = sentences.select(F.trim("name").alias("name"), F.lit("reference").alias("entity_type"))
    return extraction.extract_mentions(m.texts, None, known)


# --- loading --------------------------------------------------------------------------------


@query(
    """SELECT 'DOC' || o_orderkey AS doc_id, CASE WHEN s.k IS NOT NULL THEN 'stored' ELSE 'new' END AS document_type,
    coalesce(n.t, s.t) AS full_text
    FROM orders LEFT JOIN (SELECT o_orderkey AS k, 'old ' || o_orderstatus AS t FROM orders WHERE o_orderpriority <> '1-URGENT') s ON s.k = o_orderkey
    LEFT JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'new ' || o_orderpriority END AS t FROM orders
    WHERE o_orderpriority <> '5-LOW') n ON n.k = o_orderkey"""
)
def q_upsert_documents(m):
    orders = m.table("orders")
    key = F.concat(F.lit("DOC"), F.col("o_orderkey").cast("string")).alias("doc_id")
    stored = orders.where("o_orderpriority <> '1-URGENT'").select(
        key, F.lit("stored").alias("document_type"), F.concat(F.lit("old "), "o_orderstatus").alias("full_text"))
    batch = orders.where("o_orderpriority <> '5-LOW'").select(
        key, F.lit("new").alias("document_type"),
        F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("new "), "o_orderpriority")).alias("full_text"))
    return loading.upsert_documents(stored, batch)


@query(
    """SELECT document_id, CASE WHEN error_message IS NULL THEN 'complete' ELSE 'failed' END AS analysis_status,
    coalesce(error_message, '') AS error_message,
    CASE WHEN error_message IS NULL THEN o_orderdate::DATE::VARCHAR ELSE '' END AS date_earliest,
    CASE WHEN error_message IS NULL THEN 1 + 2 * (SELECT count(*) FROM lineitem WHERE l_orderkey = document_id) ELSE 0 END AS n_entities
    FROM good""", ("good",),
)
def q_parse_analyses(m):
    parsed = analyses.parse_analyses(m.answers)
    return parsed.select(
        "document_id", "analysis_status", F.coalesce("error_message", F.lit("")).alias("error_message"),
        F.coalesce(parse_date(F.col("analysis.dateEarliest")).cast("string"), F.lit("")).alias("date_earliest"),
        F.coalesce(F.size("analysis.entities"), F.lit(0)).cast("bigint").alias("n_entities"))


def _loaded(m):
    parsed = stored(analyses.parse_analyses(m.answers), "parsed")
    return parsed, loading.resolve_endpoints(parsed)


_LISTED = """listed AS (SELECT document_id, c_name AS name, 'person' AS entity_type FROM good JOIN customer ON c_custkey = o_custkey WHERE error_message IS NULL
    UNION ALL SELECT document_id, s_name, 'organization' FROM good JOIN lineitem ON l_orderkey = document_id JOIN supplier ON s_suppkey = l_suppkey WHERE error_message IS NULL
    UNION ALL SELECT document_id, p_name || ' ' || p_partkey, 'reference' FROM good JOIN lineitem ON l_orderkey = document_id JOIN part ON p_partkey = l_partkey WHERE error_message IS NULL),
places AS (SELECT DISTINCT n_name AS name, 'location' AS entity_type FROM good JOIN lineitem ON l_orderkey = document_id
    JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE error_message IS NULL)
"""


@query(", " + _LISTED + """SELECT DISTINCT name AS canonical_name, entity_type, 0::INT AS n_aliases FROM listed
    UNION SELECT name, entity_type, 0 FROM places""", ("good",))
def q_upsert_entities(m):
    parsed, resolved = _loaded(m)
    rows = loading.upsert_entities(None, loading.entity_batch(parsed, resolved))
    return rows.select("canonical_name", "entity_type", F.size("aliases").alias("n_aliases"))


@query(", " + _LISTED + "SELECT document_id, name, entity_type, count(*)::INT AS mention_count FROM listed GROUP BY ALL", ("good",))
def q_link_mentions(m):
    parsed, _ = _loaded(m)
    listed = analyses.listed_entities(parsed)
    keys = listed.select("name", "entity_type").distinct().withColumn("entity_id", loading.entity_id(F.col("name"), F.col("entity_type")))
    return loading.link_mentions(listed).join(keys, "entity_id").select("document_id", "name", "entity_type", "mention_count")


@query(
    """SELECT document_id, c_name AS subject, l_returnflag AS predicate, s_name AS object, n_name AS location,
    l_shipdate::DATE::VARCHAR AS timestamp FROM good JOIN customer ON c_custkey = o_custkey
    JOIN lineitem ON l_orderkey = document_id JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
    WHERE error_message IS NULL""", ("good",),
)
def q_load_triples(m):
    parsed, resolved = _loaded(m)
    rows = loading.load_triples(parsed, resolved)
    names = resolved.select("name", "entity_type").distinct().select(
        loading.entity_id(F.col("name"), F.col("entity_type")).alias("k"), "name")
    for role in ("subject", "object", "location"):
        rows = rows.join(names.withColumnRenamed("k", f"{role}_id").withColumnRenamed("name", role), f"{role}_id")
    return rows.select("document_id", "subject", "predicate", "object", "location", _day("timestamp"))


@query(
    """SELECT 'DOC' || o_orderkey AS doc_id, CASE WHEN o_orderpriority <> '1-URGENT' THEN 'stored' ELSE 'new' END AS document_type,
    coalesce(CASE WHEN o_orderpriority <> '5-LOW' AND o_orderstatus <> 'F' THEN 'new ' || o_orderpriority END,
        CASE WHEN o_orderpriority <> '1-URGENT' THEN 'old ' || o_orderstatus END) AS full_text
    FROM orders"""
)
def q_merge_documents(m):
    """The upsert of ``upsert_documents`` into a stored table, in two loads and batches, one of them repeated."""
    orders = m.table("orders")
    key = F.concat(F.lit("DOC"), F.col("o_orderkey").cast("string")).alias("doc_id")
    first = orders.where("o_orderpriority <> '1-URGENT'").select(
        key, F.lit("stored").alias("document_type"), F.concat(F.lit("old "), "o_orderstatus").alias("full_text"))
    second = orders.where("o_orderpriority <> '5-LOW'").select(
        key, F.lit("new").alias("document_type"),
        F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("new "), "o_orderpriority")).alias("full_text"))
    store = loading.document_store(m.spark, scratch_dir(m.spark, "documents"), "doc_id string, document_type string, full_text string", 16)
    for name, batch in (("load", first), ("urgent", second.where("full_text LIKE '%1-URGENT'")), ("update", second), ("update", second)):
        loading.merge_documents(store, batch, name)
    return store.read()


@query(", " + _LISTED + """, held AS (SELECT DISTINCT name, entity_type FROM listed UNION SELECT name, entity_type FROM places)
    SELECT name AS canonical_name, entity_type, CASE entity_type WHEN 'person' THEN 'also ' || name END AS alias,
        NULL::VARCHAR AS description,
        coalesce(n, 0)::BIGINT AS mention_count, coalesce(documents, 0)::BIGINT AS documents
    FROM held LEFT JOIN (SELECT name, entity_type, 2 * count(*) AS n, count(DISTINCT document_id) AS documents FROM listed GROUP BY ALL)
    USING (name, entity_type)""", ("good",))
def q_merge_entities(m):
    """Stored entities and mentions after two loads each; the second mentions everything again.

    A description that comes later does not replace the one, even if there is none, of a known entity.
    """
    parsed, resolved = _loaded(m)
    batch, mentions = loading.entity_batch(parsed, resolved), loading.link_mentions(analyses.listed_entities(parsed))
    store = loading.entity_store(m.spark, scratch_dir(m.spark, "entities"), 16)
    loading.merge_entities_into(store, batch, "answers")
    people = batch.where("entity_type = 'person'").withColumns(
        {"aliases": F.array(F.concat(F.lit("also "), "canonical_name")), "description": F.lit("known")})
    loading.merge_entities_into(store, people, "people")
    held = loading.mention_store(m.spark, scratch_dir(m.spark, "mentions"), 16)
    for name in ("one", "two", "two"):
        loading.merge_mentions(held, mentions, name)
    counts = held.read().groupBy(F.col("entity_id").alias("id")).agg(
        F.sum("mention_count").alias("mention_count"), F.count(F.lit(1)).alias("documents"))
    return store.read().join(counts, "id", "left").select(
        "canonical_name", "entity_type", F.try_element_at("aliases", F.lit(1)).alias("alias"), "description",
        F.coalesce("mention_count", F.lit(0)).alias("mention_count"), F.coalesce("documents", F.lit(0)).alias("documents"))


@query(
    """SELECT finding_id AS id, string_agg(entity_id, ',' ORDER BY entity_id) AS entity_ids FROM fent GROUP BY 1""", ("fent",)
)
def q_save_findings(m):
    rows = loading.save_findings(m.hypotheses, m.names)
    return rows.select("id", F.array_join(F.col("entity_ids").cast("array<string>"), ",").alias("entity_ids"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'old' ELSE 'new' END AS v FROM orders")
def q_insert_new(m):
    orders = m.table("orders")
    stored = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit("old").alias("v"))
    batch = orders.select(F.col("o_orderkey").alias("k"), F.lit("new").alias("v"))
    return filters.insert_new(stored, batch, "k")


_GRAPH = ("ent", "doc", "men", "net", "trip")


@query(
    """SELECT 'e' || id AS id, upper(entity_type[1]) || entity_type[2:] AS label, canonical_name AS name FROM ent
    UNION ALL SELECT 'd' || id, 'Document', doc_id FROM doc""", ("ent", "doc"),
)
def q_graph_nodes(m):
    nodes, _ = _graph(m)
    return nodes.select("id", "label", F.col("props")["name"].alias("name"))


def _graph(m):
    scored = m.findings.select(
        (F.col("id") * 10 + 1).alias("entity_id"), F.lit("ppp").alias("source"), F.col("id").alias("source_id"),
        F.col("confidence").alias("match_score"))
    return loading.graph_tables(
        m.names.withColumn("layer", F.lit(None).cast("int")), m.documents, m.mentions, m.network, m.triples, scored)


@query(
    """SELECT src, dst, rel, weight::DOUBLE AS weight FROM (
    SELECT 'e' || entity_id AS src, 'd' || document_id AS dst, 'MENTIONED_IN' AS rel, mention_count AS weight FROM men
    UNION ALL SELECT 'e' || source, 'e' || target, 'CONNECTED_TO', weight FROM net
    UNION ALL SELECT 'e' || subject_id, 'e' || object_id, 'HAS_RELATIONSHIP', 1 FROM trip
    UNION ALL SELECT 'e' || (id * 10 + 1), 'ppp:' || id, 'CROSSREF_MATCH', 0.5 FROM hyp)""", _GRAPH + ("hyp",),
)
def q_graph_tables(m):
    _, relations = _graph(m)
    return relations.select("src", "dst", "rel", "weight")


@query(
    """SELECT 'e' || e.id AS id, CASE WHEN e.entity_type = 'location' THEN 'removed' WHEN e.entity_type = 'organization' THEN 'added' ELSE 'changed' END AS change,
    CASE WHEN e.entity_type <> 'location' THEN '1' END AS layer FROM named e WHERE e.entity_type IN ('location', 'organization') OR e.n_chars % 5 = 0""",
    ("named",),
)
def q_export_changes(m):
    """The graph's nodes exported twice: organizations come, locations go, some persons get a layer."""
    people = m.named.select("id", "canonical_name", "entity_type", "n_chars")
    first = people.where("entity_type <> 'organization'").withColumn("layer", F.lit(0))
    moved = (F.col("n_chars") % 5 == 0) | (F.col("entity_type") == "organization")
    second = people.where("entity_type <> 'location'").withColumn("layer", F.when(moved, F.lit(1)).otherwise(F.lit(0)))

    export = ChangeExport(m.spark, scratch_dir(m.spark, "export"), {"id": "STRING"}, 16)
    export.export(loading.entity_nodes(first), 1)
    return export.export(loading.entity_nodes(second), 2).select("id", "change", F.col("props")["layer"].alias("layer"))


@query(
    """SELECT 'good' AS kind, o_orderkey % 7 AS fault, count(*) AS n, sum(o_totalprice::DECIMAL(15,2))::DOUBLE AS amount FROM orders WHERE o_orderkey % 7 > 4 OR o_orderkey % 7 = 0 GROUP BY ALL
    UNION ALL SELECT CASE o_orderkey % 7 WHEN 1 THEN 'invalid loan_amount' WHEN 2 THEN 'wrong number of fields' WHEN 3 THEN 'no borrower_name'
        ELSE 'invalid loan_amount; invalid date_approved' END, NULL, count(*), NULL FROM orders WHERE o_orderkey % 7 IN (1, 2, 3, 4) GROUP BY ALL"""
)
def q_load_registry(m):
    """A loan registry written as CSV, a row for each order; four in seven rows have a fault."""
    key = F.col("o_orderkey")
    fault = key % 7
    columns = T.StructType.fromDDL(SCHEMAS["ppp"]).fieldNames()
    value = {
        "id": key.cast("string"), "borrower_name": F.when(fault == 3, "").otherwise(F.concat(F.lit('Loan, "to" '), key.cast("string"))),
        "loan_amount": F.when(fault == 1, "12.3x").when(fault == 4, "1.234").otherwise(F.col("o_totalprice").cast("decimal(15,2)").cast("string")),
        "loan_number": fault.cast("string"), "date_approved": F.when(fault == 4, "1999-13-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")),
    }
    quoted = [F.concat(F.lit('"'), F.replace(value.get(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    line = F.when(fault == 2, F.concat(key.cast("string"), F.lit(",short"))).otherwise(F.concat_ws(",", *quoted))
    folder = scratch_dir(m.spark, "registry")
    header = m.spark.range(1).select(F.lit(",".join(columns)).alias("value"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("part"), F.lit(0).alias("n"))
    rows = m.table("orders").select(line.alias("value"), (key % 8).cast("int").alias("part"), F.lit(1).alias("n")).unionByName(header)
    # every file begins with the header line
    rows.repartition(8, "part").sortWithinPartitions("part", "n").select("value", "part").write.partitionBy("part").text(f"{folder}/csv")
    good, rejected = load_registry(m.spark, f"{folder}/csv", "ppp")
    counted = good.groupBy(F.lit("good").alias("kind"), F.col("loan_number").cast("bigint").alias("fault")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("loan_amount").cast("double").alias("amount"))
    return counted.unionByName(rejected.groupBy(F.array_join("reasons", "; ").alias("kind")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("fault", F.lit(None).cast("bigint")).withColumn("amount", F.lit(None).cast("double")))


# --- traversal ------------------------------------------------------------------------------

@query(
    """SELECT p.source AS a, p.target AS b, x.target AS id FROM net p JOIN netboth x ON x.source = p.source
    JOIN netboth y ON y.source = p.target AND y.target = x.target""", ("net", "netboth"),
)
def q_shared_connections(m):
    """For every edge of the network."""
    return traversal.shared_connections(m.network, m.network.select(F.col("source").alias("a"), F.col("target").alias("b")))


@query(
    """SELECT p.source AS a, p.target AS b, x.document_id FROM net p JOIN men x ON x.entity_id = p.source
    JOIN men y ON y.entity_id = p.target AND y.document_id = x.document_id""", ("net", "men"),
)
def q_joint_documents(m):
    """For every edge of the network."""
    return traversal.joint_documents(m.mentions, m.network.select(F.col("source").alias("a"), F.col("target").alias("b")))


_SEEDS = "SELECT id FROM stats WHERE entity_type = 'person' ORDER BY connection_count DESC, id LIMIT 3"


@query(
    f""", h1 AS (SELECT DISTINCT s.id AS seed, target AS id, 1 AS hops FROM ({_SEEDS}) s JOIN sym ON source = s.id),
    h2 AS (SELECT DISTINCT seed, target AS id, 2 AS hops FROM h1 JOIN sym ON source = h1.id),
    h3 AS (SELECT DISTINCT seed, target AS id, 3 AS hops FROM h2 JOIN sym ON source = h2.id)
    SELECT seed, id, min(hops) AS hops FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)
    WHERE id <> seed GROUP BY ALL""", ("sym", "stats"),
)
def q_khop(m):
    people = filters.of_types(m.entities, ["person"])
    seeds = people.orderBy(F.desc("connection_count"), "id").limit(3).select("id")
    return traversal.khop(m.every_edge, seeds, 3)


@query(
    f""", walk(id, hops) AS (SELECT {ROOT}::BIGINT, 0 UNION SELECT target, hops + 1 FROM walk JOIN sym ON source = walk.id WHERE hops < 8)
    SELECT ent.id, coalesce(min(hops), -1) AS hops FROM ent LEFT JOIN walk ON walk.id = ent.id GROUP BY ent.id""", ("sym", "ent"),
)
def q_hop_distance(m):
    rows = traversal.hop_distance(m.names, m.every_edge, ROOT)
    return rows.select("id", F.coalesce("hops", F.lit(-1)).alias("hops"))


@query()  # The walk picks by a hash that SQL engines do not share.
def q_random_walks(m):
    seeds = ranking.network_nodes(m.entities, 2, 50).select("id")
    return traversal.random_walks(m.network, seeds, 4, 7)


# --- patterns -------------------------------------------------------------------------------


@query("SELECT finding_id, entity_id, canonical_name, entity_type FROM fent JOIN ent ON ent.id = entity_id", ("fent", "ent"))
def q_finding_entities(m):
    return patterns.finding_entities(m.findings, m.names.withColumn("layer", F.lit(None).cast("int"))).drop("layer")


@query(
    """SELECT h.id, h.status, count(e.id) AS n_entities, string_agg(e.canonical_name, ',' ORDER BY entity_id) AS names
    FROM hyp h JOIN fent f ON f.finding_id = h.id JOIN ent e ON e.id = f.entity_id GROUP BY ALL""", ("hyp", "fent", "ent"),
)
def q_finding_detail(m):
    rows = patterns.finding_detail(m.findings, m.names.withColumn("layer", F.lit(None).cast("int")))
    return rows.select(
        "id", "status", F.size("entities").cast("bigint").alias("n_entities"),
        F.array_join(F.transform("entities", lambda e: e["canonical_name"]), ",").alias("names"))


@query(
    """SELECT id, status, discovered_at::VARCHAR AS discovered_at FROM hyp WHERE status = 'hypothesis' AND pattern_type = '2-HIGH'
    ORDER BY hyp.discovered_at DESC NULLS FIRST, id LIMIT 100""", ("hyp",),
)
def q_list_findings(m):
    rows = ranking.list_findings(m.findings, "hypothesis", "2-HIGH")
    return rows.select("id", "status", _day("discovered_at"))


_SAMPLE = """SELECT id, canonical_name, entity_type, coalesce(layer, 0) AS layer, document_count, connection_count FROM layered
    WHERE entity_type IN ('person', 'organization') ORDER BY connection_count DESC NULLS FIRST, id LIMIT 50"""


@query(_SAMPLE, ("layered",))
def q_high_degree_sample(m):
    return patterns.high_degree_sample(m.layered)


_HUBS = f"""hubs AS MATERIALIZED (SELECT id, hub_rank FROM (SELECT id, row_number() OVER (ORDER BY connection_count DESC, id) AS hub_rank
    FROM stats WHERE entity_type IN ('person', 'organization')) WHERE hub_rank <= 10),
links AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY shared_docs DESC, entity2) AS rank FROM (
    SELECT a.entity_id, h.hub_rank, e1.canonical_name AS entity1, e2.canonical_name AS entity2, count(DISTINCT a.document_id) AS shared_docs
    FROM men a JOIN hubs h ON h.id = a.entity_id JOIN men b ON a.document_id = b.document_id AND a.entity_id <> b.entity_id
    JOIN ent e1 ON e1.id = a.entity_id JOIN ent e2 ON e2.id = b.entity_id GROUP BY ALL)) WHERE rank <= 50)
"""


@query(", " + _HUBS + "SELECT entity_id, hub_rank, entity1, entity2, shared_docs, rank FROM links", ("stats", "men", "ent"))
def q_hub_connections(m):
    return patterns.hub_connections(m.mentions, m.entities)


@query(", " + _HUBS + "SELECT entity1, entity2, shared_docs FROM links ORDER BY hub_rank, rank LIMIT 50", ("stats", "men", "ent"))
def q_pair_features(m):
    return patterns.pair_features(patterns.hub_connections(m.mentions, m.entities))


@query(
    f"""SELECT canonical_name AS name, entity_type AS type, n_chars AS connections,
    length(canonical_name) <= 22 AND id IN (SELECT entity_id FROM ({_MATCHES}) WHERE source = 'ppp') AS has_ppp,
    length(canonical_name) <= 22 AND id IN (SELECT entity_id FROM ({_MATCHES}) WHERE source = 'fec') AS has_fec,
    length(canonical_name) <= 22 AND id IN (SELECT entity_id FROM ({_MATCHES}) WHERE source = 'grants') AS has_grants
    FROM named WHERE id IN (SELECT id FROM named WHERE entity_type IN ('person', 'organization') ORDER BY n_chars DESC, id LIMIT 50)
    OR id IN (SELECT id FROM named WHERE length(canonical_name) <= 22 AND id IN (SELECT entity_id FROM ({_MATCHES})) ORDER BY n_chars DESC, id LIMIT 100)""",
    _MATCH_TABLES,
)
def q_pattern_features(m):
    counted = m.named.select(
        "id", "canonical_name", "entity_type", F.lit(0).alias("layer"), F.lit(1).alias("document_count"),
        F.col("n_chars").alias("connection_count"))
    matched = crossref.with_crossrefs(counted, _reviewed(m), m.registries)
    rows = patterns.entity_features(patterns.high_degree_sample(matched), patterns.cross_referenced_sample(matched))
    return rows.select("name", "type", "connections", "has_ppp", "has_fec", "has_grants")


@query(
    """, degree AS (SELECT source, count(*) AS d FROM sym GROUP BY 1),
    met AS MATERIALIZED (SELECT a.target AS source, b.target AS target, count(*) AS shared FROM sym a JOIN sym b ON a.source = b.source
        AND a.target < b.target GROUP BY ALL HAVING count(*) >= 2),
    apart AS (SELECT met.*, shared / (x.d + y.d - shared) AS jaccard FROM met ANTI JOIN pairs USING (source, target)
        JOIN degree x ON x.source = met.source JOIN degree y ON y.source = met.target)
    SELECT source, count(*) AS n, sum(shared)::BIGINT AS shared, sum(target)::BIGINT AS targets, max(shared) AS most, round(max(jaccard), 6) AS closest
    FROM apart GROUP BY 1""", ("sym",),
)
def q_indirect_pairs(m):
    """All pairs over every edge of all types, in one row for each lower end: they are almost as many as pairs of entities."""
    rows = patterns.indirect_pairs(m.every_edge)
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("shared").alias("shared"), F.sum("target").alias("targets"), F.max("shared").alias("most"),
        F.round(F.max("jaccard"), 6).alias("closest"))


_DAILY = "daily AS MATERIALIZED (SELECT user_id AS entity_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL)"


@query(
    f"""WITH {_DAILY} SELECT entity_id, day::VARCHAR AS day, n, round(b / 7, 6) AS trailing_mean FROM (
    SELECT *, coalesce((SELECT sum(n) FROM daily x WHERE x.entity_id = d.entity_id AND x.day BETWEEN d.day - 7 AND d.day - 1), 0)::BIGINT AS b,
    (SELECT min(day) FROM daily x WHERE x.entity_id = d.entity_id) AS first_day FROM daily d)
    WHERE day > first_day AND n >= 3 AND n * 7 >= b * 2"""
)
def q_activity_bursts(m):
    rows = patterns.activity_bursts(m.activity, 7, 2.0, 3)
    return rows.select("entity_id", _day("day"), "n", _r("trailing_mean"))


@query(
    f"""WITH {_DAILY} SELECT entity_id, last::VARCHAR AS gap_from, day::VARCHAR AS gap_to, (day - last)::INT AS days FROM (
    SELECT d.entity_id, d.day, (SELECT max(day) FROM daily x WHERE x.entity_id = d.entity_id AND x.day < d.day) AS last FROM daily d)
    WHERE day - last >= 3"""
)
def q_activity_gaps(m):
    rows = patterns.activity_gaps(m.activity, 3)
    return rows.select("entity_id", _day("gap_from"), _day("gap_to"), "days")


@query(
    """, monthly AS MATERIALIZED (SELECT entity_id, date_trunc('month', date_earliest)::DATE AS period, count(*) AS n
    FROM men JOIN doc ON doc.id = document_id GROUP BY ALL),
    sums AS MATERIALIZED (SELECT entity_id, sum(n)::DOUBLE AS s, sum(n * n)::DOUBLE AS q FROM monthly GROUP BY 1),
    prod AS MATERIALIZED (SELECT source, target, sum(x.n * y.n)::DOUBLE AS p FROM net JOIN monthly x ON x.entity_id = source
    JOIN monthly y ON y.entity_id = target AND y.period = x.period GROUP BY ALL)
    SELECT source, target, round((80 * coalesce(p, 0) - a.s * b.s) / sqrt((80 * a.q - a.s * a.s) * (80 * b.q - b.s * b.s)), 6) AS r
    FROM net JOIN sums a ON a.entity_id = source JOIN sums b ON b.entity_id = target LEFT JOIN prod USING (source, target)
    WHERE (80 * a.q - a.s * a.s) * (80 * b.q - b.s * b.s) > 0""", ("net", "men", "doc"),
)
def q_timeline_correlation(m):
    dates = m.documents.select(F.col("id").alias("document_id"), F.trunc("date_earliest", "month").alias("period"))
    monthly = m.mentions.join(dates, "document_id").groupBy("entity_id", "period").agg(F.count(F.lit(1)).alias("n"))
    return patterns.timeline_correlation(monthly, m.network, 80).select("source", "target", _r("r"))


@query(
    """, present AS MATERIALIZED (SELECT DISTINCT location_id, timestamp, unnest([subject_id, object_id]) AS entity_id FROM trip)
    SELECT a.entity_id AS source, b.entity_id AS target, count(*) AS events FROM present a JOIN present b
    ON a.location_id = b.location_id AND a.timestamp = b.timestamp AND a.entity_id < b.entity_id GROUP BY ALL HAVING count(*) >= 2""",
    ("trip",),
)
def q_colocated(m):
    return patterns.colocated(m.triples, 2)


@query(
    """SELECT o_custkey * 10 + 1 AS entity_id, date_trunc('quarter', o_orderdate)::DATE::VARCHAR AS period, count(*) AS records,
    sum(o_totalprice::DECIMAL(15,2))::DOUBLE AS total, max(o_totalprice::DECIMAL(15,2))::DOUBLE AS largest
    FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL HAVING count(*) >= 3"""
)
def q_amount_clusters(m):
    orders = m.table("orders")
    matches = orders.select(
        (F.col("o_custkey") * 10 + 1).alias("entity_id"), F.col("o_orderkey").alias("source_id"),
        (F.col("o_orderstatus") == "P").alias("false_positive"))
    registry = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(15,2)").alias("amount"),
        F.to_date("o_orderdate").alias("contribution_date"))
    rows = patterns.amount_clusters(matches, registry, "amount", "contribution_date", "quarter", 3)
    return rows.select("entity_id", _day("period"), "records", F.col("total").cast("double").alias("total"), F.col("largest").cast("double").alias("largest"))


@query(
    """, degree AS MATERIALIZED (SELECT source AS id, count(*) AS d FROM netboth GROUP BY 1 HAVING count(*) >= 2),
    tri AS MATERIALIZED (SELECT a.source AS x, a.target AS y, b.target AS z FROM net a JOIN net b ON a.target = b.source
        JOIN net c ON c.source = a.source AND c.target = b.target),
    per AS (SELECT id, count(*) AS t FROM (SELECT x AS id FROM tri UNION ALL SELECT y FROM tri UNION ALL SELECT z FROM tri) GROUP BY 1),
    scored AS MATERIALIZED (SELECT degree.id, d AS degree, coalesce(t, 0) AS triangles, coalesce(t, 0) * 2.0::DOUBLE / (d * (d - 1)) AS density
        FROM degree LEFT JOIN per ON per.id = degree.id)
    SELECT id, degree, triangles, round(density, 6) AS density, round(z, 5) AS z FROM (
        SELECT *, (density - (SELECT avg(density) FROM scored)) / (SELECT stddev_pop(density) FROM scored) AS z FROM scored) WHERE abs(z) >= 2""",
    ("net", "netboth"),
)
def q_density_outliers(m):
    return patterns.density_outliers(m.network).select("id", "degree", "triangles", _r("density"), _r("z", 5))


@query(
    """, flow AS (SELECT payer AS source, payee AS target, 1 AS steps, payment AS path, amount, amount AS last_amount, day AS first_day, day AS last_day FROM pay
    UNION ALL SELECT f.source, p.payee, f.steps + 1, f.path || ' ' || p.payment, least(f.amount, p.amount), p.amount, f.first_day, p.day
    FROM flow f JOIN pay p ON p.payer = f.target AND p.day > f.last_day AND p.day <= f.last_day + 7
        AND p.amount <= f.last_amount AND p.amount * 2 >= f.last_amount WHERE f.steps < 4)
    SELECT source, target, steps, path, amount::DOUBLE AS amount, first_day::VARCHAR AS first_day, last_day::VARCHAR AS last_day, source = target AS returns
    FROM flow WHERE steps >= 2""", ("pay",),
)
def q_money_flows(m):
    return patterns.money_flows(m.payments, 7, 0.5, 4).select(
        "source", "target", "steps", F.array_join("path", " ").alias("path"), F.col("amount").cast("double").alias("amount"), _day("first_day"), _day("last_day"), "returns")


def _core_sql(rounds: int) -> str:
    """Rounds of the h-index of neighbours, from the degree on; the last one must change nothing."""
    steps = [", d AS MATERIALIZED (SELECT source AS id, count(*) AS degree FROM netboth GROUP BY 1), c0 AS MATERIALIZED (SELECT id, degree AS core FROM d)"]
    for i in range(rounds):
        steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT id, max(least(core, place)) AS core FROM (
    SELECT n.source AS id, c.core, row_number() OVER (PARTITION BY n.source ORDER BY c.core DESC) AS place FROM netboth n JOIN c{i} c ON c.id = n.target) GROUP BY 1)""")
    last = f"c{rounds}"
    return ",\n".join(steps) + (
        f" SELECT d.id, degree, CASE WHEN {last}.core = c{rounds - 1}.core THEN {last}.core END AS core FROM d JOIN {last} USING (id) JOIN c{rounds - 1} USING (id)")


@query(_core_sql(24), ("netboth",))
def q_core_numbers(m):
    return patterns.core_numbers(m.network)


@query(
    """, n AS MATERIALIZED (SELECT DISTINCT lower(name) AS name FROM spelling)
    SELECT a.name AS name1, b.name AS name2, damerau_levenshtein(a.name, b.name)::INT AS edits FROM n a JOIN n b
    ON a.name < b.name AND abs(length(a.name) - length(b.name)) <= 2 WHERE damerau_levenshtein(a.name, b.name) <= 2""", ("spelling",),
)
def q_typo_pairs(m):
    return typo_pairs(m.spellings.select(F.lower("name").alias("name")), "name", 2)


@query(
    f""", fdoc AS (SELECT id FROM doc WHERE date_latest >= DATE '1996-01-01' AND date_earliest <= DATE '1998-12-31' AND document_type = '1-URGENT'),
    fmen AS MATERIALIZED (SELECT * FROM men WHERE document_id IN (SELECT id FROM fdoc)),
    fpairs AS MATERIALIZED (SELECT a.entity_id AS source, b.entity_id AS target, count(*) AS weight FROM fmen a JOIN fmen b
        ON a.document_id = b.document_id AND a.entity_id < b.entity_id GROUP BY ALL),
    best AS (SELECT entity_id FROM fmen GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    members AS (SELECT unnest([source, target]) AS id FROM fpairs, best WHERE source = entity_id OR target = entity_id)
    SELECT source, target, weight FROM fpairs WHERE source IN (SELECT id FROM members) AND target IN (SELECT id FROM members)""",
    ("doc", "men"),
)
def q_focus_subgraph(m):
    kept = patterns.focus_mentions(m.mentions, m.documents, "1996-01-01", "1998-12-31", "1-URGENT")
    best = kept.groupBy("entity_id").count().orderBy(F.desc("count"), "entity_id").first()
    return patterns.focus_subgraph(co.cooccurrence(kept), best["entity_id"] if best else 0)


@query(
    """, want AS (SELECT x.finding_id AS id, x.entity_id AS a, y.entity_id AS b FROM fent x JOIN fent y
        ON x.finding_id = y.finding_id AND x.entity_id < y.entity_id),
    support AS (SELECT id, a, b, (SELECT count(*) FROM men p JOIN men q ON p.document_id = q.document_id
        WHERE p.entity_id = a AND q.entity_id = b) AS n FROM want)
    SELECT hyp.id, count(a) AS pairs, count(*) FILTER (n > 0) AS supported, coalesce(sum(n), 0)::BIGINT AS documents,
    round(coalesce(count(*) FILTER (n > 0) / nullif(count(a), 0), 0), 6) AS confidence,
    CASE WHEN coalesce(count(*) FILTER (n > 0) / nullif(count(a), 0), 0) >= 0.5 THEN 'validated' ELSE 'rejected' END AS status
    FROM hyp LEFT JOIN support USING (id) GROUP BY hyp.id""", ("fent", "men", "hyp"),
)
def q_validate_findings(m):
    return patterns.validate_findings(m.findings, m.mentions).withColumn("confidence", F.round("confidence", 6))


def _quotes(m):
    """Each sentence of the benchmark, once as it is, once without its middle word, once with its words turned round."""
    sentences = m.table("benchmark").select(F.col("item_id").alias("finding_id"), F.posexplode(F.split("text", r"[.\n]")).alias("s", "text"))
    w = filter_words(F.col("text"))
    half = F.floor(F.size(w) / 2).cast("int")
    told = [w, F.concat(F.slice(w, 1, half), F.slice(w, half + 2, F.size(w))), F.reverse(w)]
    forms = F.array(*[F.struct(F.lit(f).alias("f"), F.array_join(t, " ").alias("quote")) for f, t in enumerate(told)])
    rows = sentences.where(F.size(w) > 0).select("finding_id", "s", F.explode(forms).alias("form"))
    return rows.select("finding_id", (F.col("s") * 3 + F.col("form.f")).alias("quote_no"), "form.quote")


_LOCATED = rf"""WITH RECURSIVE sentences AS MATERIALIZED (SELECT item_id, s - 1 AS s, {sql_words('parts[s]')} AS w
        FROM (SELECT item_id, parts, unnest(range(1, len(parts) + 1)) AS s FROM (SELECT item_id, regexp_split_to_array(text, '[.\n]') AS parts FROM benchmark))),
    told AS (SELECT item_id, s * 3 AS no, w FROM sentences WHERE len(w) > 0
        UNION ALL SELECT item_id, s * 3 + 1, list_concat(w[1:len(w) // 2], w[len(w) // 2 + 2:]) FROM sentences WHERE len(w) > 0
        UNION ALL SELECT item_id, s * 3 + 2, list_reverse(w) FROM sentences WHERE len(w) > 0),
    quotes AS MATERIALIZED (SELECT item_id * 1000 + no AS q, w, len(w) AS n FROM told WHERE len(w) > 0),
    texts AS MATERIALIZED (SELECT doc_id AS id, {sql_words('text')} AS t, text FROM documents),
    tokens AS MATERIALIZED (SELECT id, unnest(t) AS term, generate_subscripts(t, 1) AS p FROM texts),
    exact AS MATERIALIZED (SELECT q, id, p, p + n - 1 AS last, n FROM quotes JOIN tokens ON term = w[1] JOIN texts USING (id) WHERE t[p:p + n - 1] = w),
    chains AS (SELECT q, id, 1 AS k, p, p AS last FROM quotes ANTI JOIN exact USING (q) JOIN tokens ON term = w[1]
        UNION SELECT c.q, c.id, c.k + 1, c.p, tokens.p FROM chains c JOIN quotes ON quotes.q = c.q
        JOIN tokens ON tokens.id = c.id AND term = w[k + 1] AND tokens.p > c.last AND tokens.p <= c.last + 4 WHERE k < n),
    every AS (SELECT q, id, p, last, n FROM exact UNION ALL SELECT q, id, p, last, n FROM chains JOIN quotes USING (q) WHERE k = n),
    best AS (SELECT q, id, min([last - p + 1 - n, p]) AS b, any_value(n) AS n FROM every GROUP BY ALL),
    cut AS (SELECT q, id, n, b[1] AS skipped, list_sum(list_transform(string_split_regex(text, '[\p{{L}}\p{{N}}]+')[1:b[2]], lambda x: length(x)))
        + coalesce(list_sum(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')[1:b[2] - 1], lambda x: length(x))), 0) AS start,
        list_sum(list_transform(string_split_regex(text, '[\p{{L}}\p{{N}}]+')[1:b[2] + n + b[1] - 1], lambda x: length(x)))
        + list_sum(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')[1:b[2] + n + b[1] - 1], lambda x: length(x))) AS "end", text
        FROM best JOIN texts USING (id)),
    located AS MATERIALIZED (SELECT q, id, n, skipped::INT AS skipped, start::INT AS start, "end"::INT AS "end", text[start + 1:"end"] AS passage FROM cut)"""


@query(_LOCATED + """SELECT q AS quote_id, id AS document_id, skipped, start, "end", passage FROM located""")
def q_quoted_evidence(m):
    quotes = _quotes(m).select((F.col("finding_id") * 1000 + F.col("quote_no")).alias("quote_id"), "quote")
    return locate_quotes(quotes, m.texts)


@query(
    _LOCATED + """, cited AS (SELECT q, any_value(n) AS n, min([skipped, id, start, "end"]) AS c FROM located GROUP BY q)
    SELECT item_id AS finding_id, count(*) AS quotes, count(c) AS located, count(*) FILTER (c[1] = 0) AS exact,
    round(avg(coalesce(n / (n + c[1]), 0)), 6) AS confidence, CASE WHEN avg(coalesce(n / (n + c[1]), 0)) >= 0.5 THEN 'validated' ELSE 'rejected' END AS status,
    coalesce(string_agg(no || ':' || c[2] || ':' || c[3] || ':' || c[4], ',' ORDER BY no) FILTER (c IS NOT NULL), '') AS citations
    FROM told LEFT JOIN cited ON q = item_id * 1000 + no GROUP BY 1"""
)
def q_evidence_chains(m):
    links = F.transform("chain", lambda c: F.concat_ws(":", c["quote_no"], c["document_id"], c["start"], c["end"]))
    return evidence_chains(_quotes(m), m.texts).select(
        "finding_id", "quotes", "located", "exact", _r("confidence"), "status", F.array_join(links, ",").alias("citations"))


# --- streams and the pipeline ---------------------------------------------------------------


@query(", " + _LISTED + """SELECT entity_type, count(*) AS mentions, sum(n)::BIGINT AS mention_count FROM (
    SELECT document_id, name, entity_type, count(*) AS n FROM listed GROUP BY ALL) GROUP BY 1""", ("good",))
def q_ingest_stream(m):
    source, out, marks = (scratch_dir(m.spark, x) for x in ("answers", "ingested", "progress"))
    m.answers.repartition(6).write.parquet(source)
    ingest.ingest_stream(m.spark, source, out, marks, files_per_batch=2)
    tables = ingest.read_ingested(m.spark, out)
    kinds = tables["entities"].select(F.col("id").alias("entity_id"), "entity_type")
    return tables["mentions"].join(kinds, "entity_id").groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("mentions"), F.sum("mention_count").alias("mention_count"))


@query("SELECT id, document_count, connection_count FROM stats WHERE document_count > 0", ("stats",))
def q_stats_stream(m):
    source, out, marks = (scratch_dir(m.spark, x) for x in ("mentions", "stats", "progress"))
    m.mentions.select("document_id", "entity_id").repartition(3).write.parquet(source)
    stats.stats_stream(m.spark, source, out, marks, files_per_batch=1)
    return stats.current_stats(m.spark, out)


_SPELLED = f"""shown AS MATERIALIZED (SELECT document_id, c_custkey, {sql_customer('(document_id % 3)')} AS name FROM good JOIN customer ON c_custkey = o_custkey WHERE error_message IS NULL),
heads AS (SELECT c_custkey, name FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY n DESC, length(name) DESC, name) AS rn
    FROM (SELECT c_custkey, name, count(*) AS n FROM shown GROUP BY ALL)) WHERE rn = 1),
lined AS (SELECT * FROM good JOIN lineitem ON l_orderkey = document_id WHERE error_message IS NULL),
listed AS (SELECT document_id, heads.name, 'person' AS entity_type FROM shown JOIN heads USING (c_custkey)
    UNION ALL SELECT document_id, {sql_supplier('0')}, 'organization' FROM lined JOIN supplier ON s_suppkey = l_suppkey
    UNION ALL SELECT document_id, {sql_part('0')}, 'reference' FROM lined JOIN part ON p_partkey = l_partkey),
places AS (SELECT DISTINCT 'Port ' || substr(md5('n' || n_nationkey), 1, 12) AS name, 'location' AS entity_type FROM lined
    JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
root AS (SELECT name FROM heads WHERE c_custkey = 0)
"""


@query(", " + _SPELLED + """, ids AS MATERIALIZED (SELECT name, entity_type, row_number() OVER (ORDER BY name, entity_type) AS id
        FROM (SELECT name, entity_type FROM listed UNION SELECT name, entity_type FROM places)),
    pm AS MATERIALIZED (SELECT DISTINCT document_id, id FROM listed JOIN ids USING (name, entity_type)),
    pp AS MATERIALIZED (SELECT a.id AS source, b.id AS target, count(*) AS weight FROM pm a JOIN pm b ON a.document_id = b.document_id AND a.id <> b.id GROUP BY ALL),
    pn AS (SELECT target AS id FROM pp JOIN ids ON ids.id = source WHERE name = (SELECT name FROM root)),
    pl AS MATERIALIZED (SELECT id, CASE WHEN name = (SELECT name FROM root) THEN 0 WHEN id IN (SELECT id FROM pn) THEN 1
        WHEN id IN (SELECT target FROM pp WHERE source IN (SELECT id FROM pn)) THEN 2 ELSE 3 END AS layer FROM ids),
    pd AS (SELECT id, count(*) AS n FROM pm GROUP BY 1), pc AS (SELECT source AS id, count(*) AS n FROM pp GROUP BY 1)
    SELECT name, entity_type, layer, coalesce(pd.n, 0) AS documents, coalesce(pc.n, 0) AS connections,
        coalesce((SELECT sum(weight) FROM pp JOIN ids o ON o.id = target WHERE source = ids.id AND weight >= 2
            AND entity_type IN ('person', 'organization') AND ids.entity_type IN ('person', 'organization')
            AND (SELECT n FROM pc WHERE pc.id = target) >= 2 AND pc.n >= 2), 0)::BIGINT AS edge_weight
    FROM ids JOIN pl USING (id) LEFT JOIN pd USING (id) LEFT JOIN pc USING (id)""", ("good",))
def q_run_pipeline(m):
    """Entities with layers, counts and the weight of their edges; spellings of a customer become one by all rules."""
    from casegraph.plans.pipeline import run_pipeline

    answers = m.spelled_answers.select("doc_id", "response")
    own = m.table("orders").where("o_custkey = 0 AND o_orderstatus <> 'P'").join(m.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    first = own.orderBy("o_orderkey").select(spelled(*CUSTOMER, F.pmod(F.col("o_orderkey"), F.lit(3)))).first()
    root = (first[0] if first else "", "person")  # in any spelling
    tables = run_pipeline(m.spark, m.order_dump, answers, MARKER, root, scratch_dir(m.spark, "pipeline"))
    both = tables["edges"].select(F.explode(F.array("source", "target")).alias("id"), "weight")
    weights = both.groupBy("id").agg(F.sum("weight").alias("edge_weight"))
    return tables["entities"].join(weights, "id", "left").select(
        F.col("canonical_name").alias("name"), "entity_type", "layer", F.col("document_count").alias("documents"),
        F.col("connection_count").alias("connections"), F.coalesce("edge_weight", F.lit(0)).alias("edge_weight"))
