"""Deterministic mention extraction: typed patterns and a gazetteer of known names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from casegraph.workspace import stored

PATTERNS = {
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Judge|Senator)\.? [A-Z][a-z]+(?: [A-Z]\.)?(?: [A-Z][a-z]+)?|\b[A-Z][a-z]+ [A-Z]\. [A-Z][a-z]+",
    "organization": r"\b(?:[A-Z][A-Za-z&]* ){1,4}(?:Inc|LLC|Ltd|Corp|Corporation|Company|Bank|Trust|Foundation|University|Institute)\b",
    "location": r"\b\d{1,5} (?:[A-Z][a-z]+ ){1,3}(?:Street|Avenue|Road|Boulevard|Lane|Drive|Square)\b|\b[A-Z][a-z]+, [A-Z]{2} \d{5}\b",
    "date": r"\b\d{4}-\d{2}-\d{2}\b",
    "financial": r"\$ ?\d[\d,]*(?:\.\d{2})?|\b\d{16}\b",
    "reference": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b|\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b|\b[0-9a-f]{40}\b",
}
CONTEXT = 40
RUN = r"[\p{L}\p{N}]+"


def pattern_mentions(documents: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(document_id, name, entity_type, mention_count, first_mention, context_snippet).

    ``first_mention`` is the character offset of the first match, from 0. The context has up to
    ``CONTEXT`` characters on either side and ends at the neighbouring matches of the pattern.
    Texts are scanned once for all patterns and are not shuffled; what is left between matches
    gives their offsets.
    """
    text = F.col("full_text")

    def matches(entity_type: str, pattern: str) -> Column:
        names, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
        return F.when(F.size(names) > 0, F.transform(
            F.arrays_zip(names.alias("name"), F.slice(gaps, 1, F.size(names)).alias("before"), F.slice(gaps, 2, F.size(names)).alias("after")),
            lambda m, i: F.struct(
                F.lit(entity_type).alias("entity_type"), i.alias("at"), m["name"].alias("name"), F.length(m["before"]).alias("gap"),
                F.concat(F.right(m["before"], F.lit(CONTEXT)), m["name"], F.left(m["after"], F.lit(CONTEXT))).alias("context"))))

    none = F.array().cast("array<struct<entity_type:string,at:int,name:string,gap:int,context:string>>")
    every = F.concat(*[F.coalesce(matches(t, p), none) for t, p in patterns.items()])
    found = documents.select(F.col("id").alias("document_id"), F.explode(every).alias("m")).select("document_id", "m.*")
    until = Window.partitionBy("document_id", "entity_type").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("start", F.sum(F.col("gap") + F.length("name")).over(until) - F.length("name"))
    return placed.groupBy("document_id", "name", "entity_type").agg(
        F.count(F.lit(1)).cast("int").alias("mention_count"), F.min("start").cast("int").alias("first_mention"),
        F.min_by("context", "start").alias("context_snippet"))


def runs(c: Column) -> Column:
    """Lower-case runs of letters and digits, in text order."""
    return F.transform(F.regexp_extract_all(c, F.lit(RUN), F.lit(0)), F.lower)


def with_run_hashes(rows: DataFrame, words_col: str, levels: int) -> DataFrame:
    """``rows`` with h0, h1, ...: the hashes of all runs of 1, 2, 4, ... words of an array of words, in order.

    A run is hashed from its halves, so a text costs its length for each level.
    """
    rows = rows.withColumn("h0", F.transform(words_col, lambda w: F.xxhash64(F.lower(w))))
    for k in range(1, levels):
        shorter, half = f"h{k - 1}", 1 << (k - 1)
        begins = F.slice(shorter, 1, F.greatest(F.size(shorter) - half, F.lit(0)))
        rows = rows.withColumn(f"h{k}", F.transform(begins, lambda x, i: F.xxhash64(x, F.get(shorter, i + half))))
    return rows


def gazetteer_mentions(documents: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Mentions of the names in (name, entity_type), compared word by word without case.

    A name of n words is known by two runs of its words: the first and the last of 2**k, the largest
    power within n. Texts hash their own runs of these lengths where they lie; only places with a
    hash that some name begins or ends with go on, and where both of a name's meet it is mentioned.
    Frequent words start nothing unless a name is that word alone. Offsets and contexts are cut out
    in a second scan, which meets the first mentions of a document in one row, so a text moves once
    at most and not for each place. They are in characters, as for patterns; hashes have 64 bits.
    """
    names = gazetteer.select("name", "entity_type", runs(F.col("name")).alias("run")).where(F.size("run") > 0)
    names = names.groupBy("run", "entity_type").agg(F.min("name").alias("name"))
    sized = names.select("*", F.size("run").alias("n")).withColumn("level", (F.length(F.bin(F.col("n").cast("bigint"))) - 1).cast("int"))
    most = sized.agg(F.max("level")).first()[0]
    levels = 1 if most is None else most + 1  # as many as the longest name has doublings
    hashed = with_run_hashes(sized, "run", levels).withColumn("h", F.get(F.array(*[f"h{k}" for k in range(levels)]), F.col("level")))
    known = stored(hashed.select(
        "name", "entity_type", "n", "level", F.get("h", F.lit(0)).alias("hash"), F.element_at("h", -1).alias("last"),
        F.expr("n - shiftleft(1, level)").alias("apart")), "names")
    wanted = known.select("level", "hash").unionByName(known.select("level", F.col("last").alias("hash"))).distinct()

    words_ = documents.select(F.col("id").alias("document_id"), F.regexp_extract_all("full_text", F.lit(RUN), F.lit(0)).alias("w"))
    own = with_run_hashes(words_, "w", levels)
    # functions of columns run at once, so each sees its own k
    every = [F.transform(f"h{k}", lambda x, i: F.struct(F.lit(k).alias("level"), i.alias("place"), x.alias("hash"))) for k in range(levels)]
    places = own.select("document_id", F.explode(F.flatten(F.array(*every))).alias("p")).select("document_id", "p.*")
    met = stored(places.join(wanted, ["level", "hash"], "left_semi"), "places")
    begun = met.join(known, ["level", "hash"]).withColumn("end_place", F.col("place") + F.col("apart")).drop("hash")
    ends = met.select("document_id", F.col("place").alias("end_place"), "level", F.col("hash").alias("last"))
    columns = ["document_id", "name", "entity_type", "n", "place"]
    whole = begun.where("apart = 0").select(*columns).unionByName(
        begun.where("apart > 0").join(ends, ["document_id", "end_place", "level", "last"], "left_semi").select(*columns))
    counted = whole.groupBy("document_id", "name", "entity_type", "n").agg(
        F.count(F.lit(1)).cast("int").alias("mention_count"), F.min("place").alias("place"))
    asked = counted.groupBy("document_id").agg(F.collect_list(F.struct("name", "entity_type", "n", "mention_count", "place")).alias("asked"))
    return _first_mentions(documents, stored(asked, "met"))


STRIDE = 256  # words whose lengths are added up together


def with_word_offsets(rows: DataFrame) -> tuple[DataFrame, Callable[[Column, Column], tuple[Column, Column]]]:
    """``rows`` (full_text) with helper columns, and a function of a run's place and words to its begin and end.

    Both are in characters, the end exclusive. The characters before a word are added up by strides
    of words, then by words, so that no place costs the text before it.
    """
    rows = rows.withColumn("g", F.transform(F.split("full_text", RUN, -1), F.length))
    words_ = F.regexp_extract_all("full_text", F.lit(RUN), F.lit(0))
    rows = rows.withColumn("l", F.transform(words_, lambda x, i: F.length(x) + F.get("g", i)))

    def total(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0), lambda a, x: a + x)

    strides = F.sequence(F.lit(0), F.floor(F.size("l") / STRIDE).cast("int"))
    rows = rows.withColumn("s", F.transform(strides, lambda c: total(F.slice("l", c * STRIDE + 1, F.lit(STRIDE)))))

    def before(place: Column) -> Column:
        stride = F.floor(place / STRIDE).cast("int")
        return total(F.slice("s", F.lit(1), stride)) + total(F.slice("l", stride * STRIDE + 1, place - stride * STRIDE))

    return rows, lambda place, n: (before(place) + F.get("g", place), before(place + n))


def _first_mentions(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """Offsets and contexts of the asked places (in words) of each document."""
    rows, span = with_word_offsets(documents.select(F.col("id").alias("document_id"), "full_text").join(asked, "document_id"))

    # offsets are bound as fields, so that each is added up once
    def placed(a: Column) -> Column:
        begin, end = span(a["place"], a["n"])
        return F.struct(a["name"].alias("name"), a["entity_type"].alias("entity_type"), a["mention_count"].alias("mention_count"), begin.alias("begin"), end.alias("end"))

    def mention(a: Column) -> Column:
        lead = F.least(a["begin"], F.lit(CONTEXT))
        return F.struct(a["name"].alias("name"), a["entity_type"].alias("entity_type"), a["mention_count"].alias("mention_count"), a["begin"].alias("first_mention"),
                        F.substring("full_text", a["begin"] - lead + 1, lead + a["end"] - a["begin"] + CONTEXT).alias("context_snippet"))

    return rows.select("document_id", F.explode(F.transform(F.transform("asked", placed), mention)).alias("m")).select("document_id", "m.*")


def extract_mentions(
    documents: DataFrame, patterns: dict[str, str] | None = None, gazetteer: DataFrame | None = None
) -> DataFrame:
    """Typed mentions in every document by patterns, and by a gazetteer when one is given."""
    found = pattern_mentions(documents, patterns or PATTERNS)
    if gazetteer is None:
        return found
    return found.unionByName(gazetteer_mentions(documents, gazetteer))
