"""Ranked full-text search over a postings table, in the style of PostgreSQL's text search.

Many queries are answered at once. Every position of every term enters the score, however long a
text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casegraph.functions.covers import best_cover
from casegraph.functions.stemming import stem_terms
from casegraph.functions.text import words
from casegraph.operators.ranking import top_k_per_group
from casegraph.workspace import stored

# English words that carry no weight in a search.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she "
    "her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now"
).split()
WEIGHT = 0.1
REACH = 100
NORMALIZER = 1.64493406685


def _terms(df: DataFrame, id_col: str, text_col: str, config: str, only: DataFrame | None = None) -> DataFrame:
    """(id, term, position) of every word that carries weight; positions start at 1.

    With ``only``, stems that it lacks are left out before words are joined with their stems.
    """
    exploded = df.select(
        F.col(id_col).alias("id"), F.posexplode(words(F.col(text_col))).alias("position", "term")
    ).withColumn("position", F.col("position") + 1)
    if config == "simple":
        return exploded
    if config not in ("stop", "english"):
        raise ValueError(f"unknown text search configuration {config!r}")
    weighty = exploded.where(~F.col("term").isin(*STOP_WORDS))
    if config == "stop":
        return weighty
    stems = _stems_of(weighty.select("term"))
    if only is not None:
        stems = stems.join(only.select(F.col("term").alias("stem")).distinct(), "stem", "left_semi")
    return weighty.join(stems, "term").select("id", F.col("stem").alias("term"), "position")


def _stems_of(terms: DataFrame) -> DataFrame:
    """(term, stem) of every distinct term, written so that no term is stemmed twice."""
    return stored(stem_terms(terms.distinct()), "stems")


def build_postings(
    documents: DataFrame, id_col: str = "id", text_col: str = "full_text", config: str = "english",
    only: DataFrame | None = None,
) -> DataFrame:
    """(term, id, positions): one row per term and document, the reusable search table.

    ``only`` (term) restricts it to the terms that are asked for, before anything is shuffled.
    """
    if only is not None:
        only = stored(only.select("term").distinct(), "only")
    terms = _terms(documents, id_col, text_col, config, only)
    if only is not None:
        terms = terms.join(only, "term", "left_semi")
    return terms.groupBy("term", "id").agg(F.array_sort(F.collect_set("position")).alias("positions"))


def query_terms(queries: DataFrame, config: str = "english") -> DataFrame:
    """(query_id, term, n_terms): distinct terms that a document must all contain."""
    terms = _terms(queries, "query_id", "q", config).select(F.col("id").alias("query_id"), "term").distinct()
    counts = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    return terms.join(counts, "query_id")


def match_all_terms(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, id, hits): documents with every term of a query; a query without terms has none.

    Only documents with the rarest term of a query are looked at, each with all terms it holds, so
    postings are never multiplied by the queries that ask for them.
    """
    postings = stored(postings, "postings")
    terms = stored(terms.select("query_id", "term"), "terms")
    found_in = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    asked = stored(
        terms.join(found_in, "term", "left").groupBy("query_id").agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))["term"].alias("rarest"),
            F.collect_set("term").alias("wanted")), "asked")
    lead = asked.select("query_id", F.col("rarest").alias("term"))
    candidates = postings.select("term", F.col("id").alias("_id")).join(lead, "term").select("query_id", "_id")
    held = postings.groupBy("id").agg(F.collect_list(F.struct("term", "positions")).alias("held"))
    met = held.join(candidates, F.col("id").eqNullSafe(F.col("_id"))).join(asked.select("query_id", "wanted"), "query_id")
    complete = met.where(F.size(F.array_except("wanted", "held.term")) == 0)
    return complete.select(
        "query_id", "id",
        F.array_sort(F.filter("held", lambda h: F.array_contains(F.col("wanted"), h["term"]))).alias("hits"))


def rank(hits: Column) -> Column:
    """Relevance from term positions: occurrence decay for one term, closeness for several."""
    return F.when(F.size(hits) == 1, _rank_one(hits)).otherwise(_rank_near(hits))


def _rank_one(hits: Column) -> Column:
    n = F.size(hits[0]["positions"])
    terms = F.transform(F.sequence(F.lit(1), n), lambda j: F.lit(WEIGHT) / (j * j).cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / F.lit(NORMALIZER)


def _rank_near(hits: Column) -> Column:
    """Closeness of different terms, from each position and those up to ``REACH`` places behind it.

    A text has one word at a place, so these are among the next ``REACH`` positions in order; pairs
    further apart would change the score by less than 1e-15 each.
    """
    placed = F.array_sort(F.flatten(F.transform(
        hits, lambda h, t: F.transform(h["positions"], lambda p: F.struct(p.alias("p"), t.alias("t"))))))

    def apart(a: Column, b: Column) -> Column:
        distance = (b["p"] - a["p"]).cast("double")
        closeness = 1.0 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2))
        near = (a["t"] != b["t"]) & (distance <= REACH)
        return F.when(near, F.log(1.0 - F.sqrt(F.lit(WEIGHT * WEIGHT) * closeness))).otherwise(F.lit(0.0))

    def after(places: Column) -> Column:
        return F.aggregate(
            F.transform(places, lambda a, i: F.aggregate(
                F.slice(places, i + 2, F.lit(REACH)), F.lit(0.0), lambda total, b: total + apart(a, b))),
            F.lit(0.0), lambda total, x: total + x)

    # the sorted places are bound once, as the only element of an array
    return 1.0 - F.exp(F.element_at(F.transform(F.array(placed), after), 1))


def rank_order() -> list[Column]:
    """Best rank first. Ranks that agree to nine decimals are equal, and the lower id comes first."""
    return [F.desc(F.round("rank", 9)), F.asc("id")]


def full_text_search(postings: DataFrame, queries: DataFrame, k: int = 20, config: str = "english") -> DataFrame:
    """(query_id, id, rank, place): best ``k`` documents of every query.

    ``config`` must be the one the postings were built with.
    """
    found = match_all_terms(postings, query_terms(queries, config)).withColumn("rank", rank(F.col("hits")))
    return top_k_per_group(found.select("query_id", "id", "rank"), ["query_id"], rank_order(), k, "place")


def search_text(documents: DataFrame, query: str, k: int = 20, config: str = "english") -> DataFrame:
    """Ranked search for one text over (id, full_text), with snippets."""
    if not query:
        raise ValueError("query required")
    queries = documents.sparkSession.createDataFrame([(0, query)], "query_id bigint, q string")
    postings = build_postings(documents, config=config, only=query_terms(queries, config))
    best = full_text_search(postings, queries, k, config)
    return snippets(best, documents, queries, config=config)


def _asked_words(results: DataFrame, documents: DataFrame, queries: DataFrame, config: str) -> DataFrame:
    """(query_id, id, _asked): for each result the words that its query asks for, with their terms."""
    terms = query_terms(queries, config).select("query_id", "term")
    if config != "english":
        asked = terms.groupBy("query_id").agg(F.map_from_entries(F.collect_set(F.struct("term", F.col("term").alias("t")))).alias("_asked"))
        return results.select("query_id", "id").join(asked, "query_id")
    held = results.select("query_id", "id").join(documents.select("id", "full_text"), "id").select(
        "query_id", "id", F.explode(F.array_distinct(words(F.col("full_text")))).alias("term"))
    stems = _stems_of(held.select("term"))
    wanted = terms.withColumnRenamed("term", "stem")
    return held.join(stems, "term").join(wanted, ["query_id", "stem"]).groupBy("query_id", "id").agg(
        F.map_from_entries(F.collect_set(F.struct("term", "stem"))).alias("_asked"))


def snippets(
    results: DataFrame, documents: DataFrame, queries: DataFrame, longest: int = 50, shortest: int = 20, config: str = "english",
) -> DataFrame:
    """Results with the best fragment of their text, words that the query asks for marked.

    Tokens are parted by white space. Among the windows of ``longest`` tokens the one with most of
    the query's terms counts, of these the one that covers them in fewest tokens, then the first.
    The fragment is that cover; a shorter one grows to ``shortest`` tokens on both sides, the extra
    one behind, as far as the text goes. With ``english`` every word of an asked stem counts. Only
    result rows are processed.
    """
    asked = _asked_words(results, documents, queries, config)
    rows = results.join(documents.select("id", "full_text"), "id").join(asked, ["query_id", "id"])
    rows = rows.withColumn("_tokens", F.split("full_text", r"\s+"))
    held = F.transform("_tokens", lambda t, i: F.struct(
        i.alias("at"), F.array_distinct(F.filter(F.transform(words(t), lambda w: F.try_element_at(F.col("_asked"), w)), lambda x: x.isNotNull())).alias("terms")))
    rows = rows.withColumn("_hits", F.filter(held, lambda h: F.size(h["terms"]) > 0))
    rows = rows.withColumn("_cover", best_cover("_hits.at", "_hits.terms", F.lit(longest)))
    n, size = F.size("_tokens"), F.greatest(F.col("_cover.length"), F.lit(shortest))
    before = F.floor((size - F.col("_cover.length")) / 2).cast("int")
    start = F.greatest(F.lit(0), F.least(F.col("_cover.start") - before, n - size))
    marked = F.transform(
        F.slice("_tokens", start + 1, size),
        lambda t: F.when(
            F.arrays_overlap(words(t), F.map_keys("_asked")),
            F.regexp_replace(t, r"([\p{L}\p{N}]+)", "<mark>$1</mark>"),
        ).otherwise(t),
    )
    return rows.withColumn("snippet", F.array_join(marked, " ")).drop("_tokens", "_asked", "_hits", "_cover", "full_text")
