"""The registered query of each operator, with its SQL where SQL can express it.

Each query applies its operator to the whole table and derives the columns of its contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casegraph.llm import (
    best_fit_packing,
    chat_rotation,
    disclosure,
    frame_fim,
    label_sharding,
    minmax_dedup,
    neighbour_quality,
    pca_dedup,
    rule_forest,
    suffix_decontam,
    token_ledger,
    trie_codes,
    window_dedup,
)
from casegraph.llm.common import scratch_dir, stored, table

QUERIES = {}
ORACLES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@query
def op1_chat_rotation(spark: SparkSession, folder: str) -> DataFrame:
    return chat_rotation.rotate(table(spark, folder, "conversations"))


ORACLES["op1_chat_rotation"] = r"""
WITH r AS (SELECT conv_id, turn, replace(coalesce(text, ''), '<|', '< |') AS body,
  CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE regexp_replace(role, '[^\p{L}\p{N}_-]', '_', 'g') END AS speaker
  FROM conversations),
v AS (SELECT r.*, p.perspective, r.speaker = p.perspective AS own,
  CASE WHEN r.speaker = p.perspective THEN '<|assistant|>' || chr(10) WHEN r.speaker = 'system' THEN '<|system|>' || chr(10)
       ELSE '<|user name=' || r.speaker || '|>' || chr(10) END AS head
  FROM r JOIN (SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker <> 'system') p
  ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, head || body || '<|end|>' || chr(10) AS segment FROM v),
t AS (SELECT *, sum(length(segment)) OVER w AS e, count(*) OVER w AS n FROM s
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, turn, n - 1 AS position, segment, (e - length(segment))::BIGINT AS start, e::BIGINT AS end,
  CASE WHEN own THEN (e - length(segment) + length(head))::BIGINT END AS mask_start, CASE WHEN own THEN (e - 1)::BIGINT END AS mask_end
FROM t"""


@query
def op2_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    found = disclosure.find(table(spark, folder, "documents"))
    kinds = F.array(*[F.lit(k) for k in disclosure.KINDS])

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(disclosure.KINDS[:4])],
        sha256(listed(F.col("base"))).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"))


@query
def op3_suffix_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_decontam.find_matches(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        sha256(F.array_join("item_ids", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.col("matches.n_words")), F.lit(0)).alias("longest_match"))


@query
def op4_neighbour_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = neighbour_quality.fit(docs, table(spark, folder, "labels"))
    return neighbour_quality.scored(docs, model).select(
        "doc_id", neighbour_quality.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= neighbour_quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit_packing.pack_documents(table(spark, folder, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op6_window_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = window_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("bigint").alias("n_chars_left"),
                      F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLES["op6_window_dedup"] = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, array_to_string(l[i + 1 : i + 3], chr(10)) || '#' || least(len(l), 3) AS x
      FROM d, LATERAL (SELECT unnest(range(0, greatest(len(l) - 2, 1))) AS i)),
f AS (SELECT x, min((doc_id, i)) AS first FROM w GROUP BY x HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM w JOIN f USING (x), (SELECT unnest([1, 2, 3]) AS k) WHERE (doc_id, i) <> first),
r AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY 1),
k AS (SELECT d.doc_id, len(l) AS n, CASE WHEN gone IS NULL THEN l
      ELSE list_filter(l, lambda y, j: NOT list_contains(gone, j)) END AS left_over FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, n AS n_lines, n - len(left_over) AS n_removed,
       length(array_to_string(left_over, chr(10))) AS n_chars_left, md5(array_to_string(left_over, chr(10))) AS text_md5
FROM k"""


@query
def op7_pca_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return pca_dedup.near_duplicates(table(spark, folder, "embeddings"))


@query
def op8_label_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return label_sharding.shard_documents(table(spark, folder, "documents"))


@query
def op9_token_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after inserting all documents, taking the toxic ones out, recounting the poor ones in
    lower case, and committing the second batch once more."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    ledger = token_ledger.Ledger(spark, scratch_dir(spark, "ledger"))
    version = "byte_bpe_50k-1"
    rows = docs.select("doc_id", "source", "lang", "text")
    ledger.commit(1, token_ledger.counted(rows, version).select(F.lit("insert").alias("change"), F.lit(0).alias("sequence"), "*"))
    none = F.lit(None)
    toxic = labels.where("toxic = 1").select(
        F.lit("delete").alias("change"), F.lit(0).alias("sequence"), "doc_id", none.cast("string").alias("source"),
        none.cast("string").alias("lang"), none.cast("bigint").alias("tokens"), none.cast("bigint").alias("bytes"),
        F.lit(version).alias("tokenizer"))
    ledger.commit(2, toxic)
    poor = labels.where("quality = 0 and toxic = 0").select("doc_id")
    recounted = token_ledger.counted(rows.withColumn("text", F.lower("text")), version, only=(poor, "doc_id"))
    ledger.commit(3, recounted.select(F.lit("revise").alias("change"), F.lit(0).alias("sequence"), "*"))
    ledger.commit(2, toxic)
    return ledger.totals()


@query
def op10_minmax_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = minmax_dedup.near_duplicates(table(spark, folder, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op11_rule_forest(spark: SparkSession, folder: str) -> DataFrame:
    stats = stored(rule_forest.rule_statistics(table(spark, folder, "documents")), "rules")
    model = rule_forest.fit(stats, table(spark, folder, "labels"))
    return rule_forest.judged(stats, model).select(
        F.col("id").alias("doc_id"), *rule_forest.COUNTS, "base_failed", "kept", "score")


@query
def op12_frame_fim(spark: SparkSession, folder: str) -> DataFrame:
    frames = stored(frame_fim.framed(table(spark, folder, "documents").select("doc_id", "text")), "frames")
    return frame_fim.digested(frame_fim.fill_in_middle(frames)).select(
        "doc_id", F.col("fim.units").alias("n"), "fim.form", "fim.prefix_chars", "fim.middle_chars", "digest.output_sha256",
        "digest.restored_sha256")


ORACLES["op12_frame_fim"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
u AS (SELECT *, string_split(t, chr(10)) AS l, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(s, i, 8))::BIGINT) AS h FROM d),
n AS (SELECT *, len(l) - (l[-1] = '')::INT AS n,
  t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 AS plain FROM u),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM n),
p AS (SELECT *, CASE WHEN a = n THEN length(t) ELSE length(array_to_string(l[1 : a], chr(10))) + (a > 0)::INT END AS x,
  CASE WHEN b = n THEN length(t) ELSE length(array_to_string(l[1 : b], chr(10))) + (b > 0)::INT END AS y FROM c),
o AS (SELECT *, CASE WHEN plain THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  t[1 : x] AS pre, t[x + 1 : y] AS mid, t[y + 1 :] AS suf FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN NOT plain THEN x::BIGINT END AS prefix_chars,
  CASE WHEN NOT plain THEN (y - x)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
         ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM o"""


@query
def op13_trie_codes(spark: SparkSession, folder: str) -> DataFrame:
    return trie_codes.compressed(table(spark, folder, "embeddings"))


def _rounds(rounds: int) -> str:
    """SQL of the vector codes: every round assigns distinct parts and replaces the entries that were used."""
    steps = [r"""WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
f AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS e, v FROM k ORDER BY vec_id LIMIT 16),
p AS MATERIALIZED (SELECT q, v[q * len(v) // 8 + 1 : (q + 1) * len(v) // 8] AS x, count(*) AS c FROM k, range(8) r(q) GROUP BY ALL),
b0 AS MATERIALIZED (SELECT q, e, v[q * len(v) // 8 + 1 : (q + 1) * len(v) // 8] AS y FROM f, range(8) r(q))"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT q, x, any_value(c) AS c, min({{'d': list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) ** 2))::BIGINT, 'e': e}}) AS m
  FROM p JOIN b{i} USING (q) GROUP BY q, x)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT q, e, list(floor(t / n)::BIGINT ORDER BY j) AS y FROM (
  SELECT q, m.e AS e, j, sum(x[j] * c) AS t, sum(c) AS n FROM a{i}, range(1, 65) r(j) WHERE j <= len(x) GROUP BY ALL) GROUP BY q, e)""")
            steps.append(f"""b{i + 1} AS MATERIALIZED (SELECT q, e, coalesce(s{i}.y, b{i}.y) AS y FROM b{i} LEFT JOIN s{i} USING (q, e))""")
    steps.append(f"""g AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY q) AS code, sum(m.d)::BIGINT AS error
  FROM (SELECT vec_id, label, q, v[q * len(v) // 8 + 1 : (q + 1) * len(v) // 8] AS x FROM k, range(8) r(q)) JOIN a{rounds} USING (q, x) GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY q, e)) FROM b{rounds}) AS codebooks_sha256 FROM g""")
    return ",\n".join(steps)


ORACLES["op13_trie_codes"] = _rounds(trie_codes.ROUNDS)
