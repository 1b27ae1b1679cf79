"""Filters, record projections and small relational helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from casegraph.functions.text import trigram_list, jaccard, trigrams


def opt_filter(df: DataFrame, **params) -> DataFrame:
    """Equality filters; a parameter that is None or empty adds no filter."""
    for column, value in params.items():
        if value is not None and value != "":
            df = df.where(F.col(column) == F.lit(value))
    return df


def ilike_any(c: Column, query: str) -> Column:
    """Case-insensitive substring test; % and _ in the query stay wildcards."""
    return c.ilike(f"%{query}%")


def trigram_match(c: Column, query: str, num: int = 3, den: int = 10) -> Column:
    """Trigram similarity with one text is at least num/den, decided in integers."""
    grams = F.array(*[F.lit(g) for g in trigram_list(query)]).cast("array<string>")
    own = trigrams(c)
    shared = F.size(F.array_intersect(own, grams))
    union = F.size(own) + F.size(grams) - shared
    return (shared > 0) & (shared * den >= union * num)


def similarity_at_least(a: Column, b: Column, num: int = 7, den: int = 10) -> Column:
    """Trigram similarity of two columns is at least num/den, inclusive, decided in integers."""
    left, right = trigrams(a), trigrams(b)
    shared = F.size(F.array_intersect(left, right))
    return (shared > 0) & (shared * den >= (F.size(left) + F.size(right) - shared) * num)


def of_types(df: DataFrame, types: list[str], column: str = "entity_type") -> DataFrame:
    return df.where(F.col(column).isin(*types))


def lookup(df: DataFrame, ids: list | DataFrame, key: str = "id") -> DataFrame:
    """Rows by key, from a short literal list or from a table of keys."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")
    return df.where(F.col(key).isin(*ids))


def restrict_to(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    return df.join(keys, on, "left_semi")


def exclude_visited(df: DataFrame, visited: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key does not occur in ``visited``."""
    return df.join(visited, on, "left_anti")


def expand_ids(df: DataFrame, array_col: str, dim: DataFrame, dim_key: str = "id") -> DataFrame:
    """One row per array element that exists in ``dim``, with its attributes."""
    exploded = df.withColumn("_element", F.explode(F.array_distinct(F.col(array_col))))
    return exploded.join(dim, F.col("_element") == dim[dim_key]).drop("_element")


def pending(documents: DataFrame) -> DataFrame:
    """Documents that wait for analysis and have a text."""
    return documents.where((F.col("analysis_status") == "pending") & F.col("full_text").isNotNull())


def min_degree(df: DataFrame, n: int = 2, column: str = "connection_count") -> DataFrame:
    return df.where(F.col(column) >= n)


def any_nonempty(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with at least one array that is neither null nor empty."""
    tests = [F.coalesce(F.size(F.col(c)), F.lit(0)) > 0 for c in columns]
    return df.where(reduce(lambda a, b: a | b, tests))


def valid_matches(matches: DataFrame) -> DataFrame:
    return matches.where(~F.col("false_positive"))


def has_match(entities: DataFrame, matches: DataFrame, source: str) -> DataFrame:
    """Entities with any match from a source; matches marked false count as well."""
    keys = matches.where(F.col("source") == source).select(F.col("entity_id").alias("id"))
    return entities.join(keys, "id", "left_semi")


def attach_aggregate(df: DataFrame, aggregate: DataFrame, key: str) -> DataFrame:
    return df.join(aggregate, key, "left")


def with_defaults(df: DataFrame, zero: list[str], empty: list[str] = ()) -> DataFrame:
    """Nulls become 0 in counts and [] in match lists."""
    changes = {c: F.coalesce(F.col(c), F.lit(0)) for c in zero}
    types = dict(df.dtypes)
    changes |= {c: F.coalesce(F.col(c), F.expr(f"cast(array() as {types[c]})")) for c in empty}
    return df.withColumns(changes)


def first_n(df: DataFrame, order: list[Column], n: int = 50) -> DataFrame:
    return df.orderBy(*order).limit(n)


def distinct_keys(df: DataFrame, key: str | list[str]) -> DataFrame:
    return df.select(key).distinct()


def with_counts(page: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """Count of the rows on a page, and the count of all rows when they are given."""
    counts = page.agg(F.count(F.lit(1)).alias("returned"))
    if total is not None:
        counts = counts.withColumn("total", total.agg(F.count(F.lit(1))).scalar())
    return counts


def status_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def corpus_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, in long form."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def union_by_id(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Both tables, one row per key."""
    return a.unionByName(b).dropDuplicates([key])


def union_sources(**matches: DataFrame) -> DataFrame:
    """Match tables of several sources in one, tagged by source name."""
    parts = [df.withColumn("source", F.lit(name)) for name, df in matches.items()]
    return reduce(DataFrame.unionByName, parts)


def insert_new(target: DataFrame, batch: DataFrame, key: str | list[str]) -> DataFrame:
    """The target and those batch rows, one per key, whose key it lacks."""
    keys = [key] if isinstance(key, str) else key
    return target.unionByName(batch.dropDuplicates(keys).join(target, keys, "left_anti"))


def concat_aliases(a: Column, b: Column, dedup: bool = False) -> Column:
    """Both alias lists joined; a null side counts as empty."""
    empty = F.array().cast("array<string>")
    joined = F.concat(F.coalesce(a, empty), F.coalesce(b, empty))
    return F.array_distinct(joined) if dedup else joined


def match_flags(df: DataFrame) -> DataFrame:
    """Whether each registry gave the entity a match."""
    return df.withColumns(
        {
            f"has_{source}": F.coalesce(F.size(F.col(f"{source}_matches")), F.lit(0)) > 0
            for source in ("ppp", "fec", "grants")
        }
    )


def document_summary(documents: DataFrame) -> DataFrame:
    """List record of a document; the text is not read."""
    return documents.select("id", "doc_id", "dataset_id", "document_type", "summary", *_dates(documents))


def document_detail(documents: DataFrame) -> DataFrame:
    """Full record of a document without its text."""
    return documents.select(
        "id", "doc_id", "dataset_id", "document_type", "summary", "detailed_summary",
        *_dates(documents), "content_tags", "page_count",
    )


def document_text(documents: DataFrame) -> DataFrame:
    return documents.select("id", F.col("full_text").alias("text"))


def entity_record(entities: DataFrame) -> DataFrame:
    return entities.select(
        "id", "canonical_name", "entity_type", "layer", "document_count", "connection_count"
    )


def _dates(documents: DataFrame) -> list[Column]:
    return [documents[c].cast("string").alias(c) for c in ("date_earliest", "date_latest")]
