"""Personal data and the terms that give it away.

Four kinds of personal data are found by pattern in every whole text. Their values are the
protected entities. The corpus then says how strongly a word of a document that mentions an entity
reveals it: with document counts over all documents, the disclosure of entity e by term t is

    PMI(e, t) / IC(e) = log(N n(e,t) / (n(e) n(t))) / log(N / n(e)),

1 if t never occurs without e, 0 if they are independent. Every pair is rated, however few documents
hold it. A term is generalised to its class from ``generalise`` on and removed from ``remove`` on, wherever it occurs outside the base spans of a document that mentions e. Every word
of a document is paired with every entity of it, except terms in too many documents to reach
``generalise`` with the entity whatever n(e,t) is: as n(e,t) <= n(e), n(t) may be N (n(e) / N) **
``generalise`` at most. The most usual terms and entities are sent to the tasks for this; pairs of
others are rated like all that are left. Entities and terms are compared as 64-bit hashes.

Defined cases: a null text is empty and has no spans; rows alike in id and text are counted each
and get the same result; an entity in every document reveals nothing more and protects no term;
added spans never overlap the base ones, which stay as they are. Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from casegraph.llm.common import LETTERS, Words, chunks, key_columns, place_of, salted_join, stored, unnamed

GENERALISE = 0.95
REMOVE = 0.99
SHARD_BYTES = 1 << 20
USUAL = 50_000  # terms and entities whose counts are sent to the tasks
PAIR_ROWS = 1 << 17

#: Kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "removed", "generalised")

# The fixed patterns of the four kinds. A digit run that fails at its first digit fails at the
# others, so the look-behind changes no result and keeps long runs linear.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is the run before an @, from the end of the last match on."""
    until = 0
    for domain in DOMAIN.finditer(text):
        start = domain.start()
        while start > until and text[start - 1] in LOCAL:
            start -= 1
        if start < domain.start():
            until = domain.end()
            yield start, until


def digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def luhn(number: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(number)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of all personal data of the four kinds."""
    found = []
    if "@" in text:
        found += [(a, 0, b, text[a:b].lower()) for a, b in emails(text)]
    if DIGIT.search(text):
        if "." in text:
            found += [
                (m.start(), 1, m.end(), m[0]) for m in IP.finditer(text)
                if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(number := digits(m[0])) <= 19 and luhn(number):
                found.append((m.start(), 2, m.end(), number))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(number := digits(m[0])) <= 15:
                    found.append((m.start(), 3, m.end(), number))
    return sorted(found)


def entity(kind: int, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}:{value}") - (1 << 63)


def placed_words(text: str, spans: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words outside ``spans``, in code points."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    words = Words(data, np.array([0, len(data)]), LETTERS)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    start, end = points[words.start], points[words.end]
    outside = np.ones(len(start), dtype=bool)
    for a, _, b, _ in spans:
        outside[np.searchsorted(end, a, side="right") : np.searchsorted(start, b, side="left")] = False
    return words.hashes().view(np.int64)[outside], start[outside], end[outside]


def distinct_words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return np.unique(Words(data, np.array([0, len(data)]), LETTERS).hashes().view(np.int64))


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, base, entities, text): what each document holds; its text only if it mentions an entity."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, entities, texts = [], [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text or "")
                base.append([{"start": a, "kind": k, "end": b} for a, k, b, _ in spans])
                entities.append(sorted({entity(k, v) for _, k, _, v in spans}))
                texts.append(text if spans else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(base, pa.list_(SPAN)), pa.array(entities, pa.list_(pa.int64())),
                 pa.array(texts, pa.string())],
                names=["doc_id", "text_hash", "base", "entities", "text"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash bigint, base array<struct<start:bigint,kind:int,end:bigint>>, "
                                "entities array<bigint>, text string")


def pairs_of(scanned: DataFrame, of_entity: DataFrame, counted: DataFrame, total: int, generalise: float, usual: int = USUAL) -> DataFrame:
    """(doc_id, text_hash, entity, term): the entities of each document with its distinct terms, without
    pairs that cannot reach ``generalise``."""

    def most(df: DataFrame, key: str, n: str) -> tuple[np.ndarray, np.ndarray, int]:
        """The keys with the highest counts in order, their counts, and the most that another can have."""
        rows = df.select(key, n).orderBy(F.desc(n)).limit(usual).collect()
        keys, counts = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(2))
        order = np.argsort(keys)
        return keys[order], counts[order], int(counts.min()) if len(rows) == usual else 1

    sent = scanned.sparkSession.sparkContext.broadcast((most(counted, "term", "n_term"), most(of_entity, "entity", "n_entity")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (terms, n_terms, _), (entities, n_entities, other) = sent.value
        among = dict(zip(entities.tolist(), n_entities.tolist(), strict=True))
        for batch in batches:
            rows, parts, size = [], [], 0

            def put(batch=batch) -> pa.RecordBatch:
                lengths = [len(t) for _, t in parts]
                place = pa.array(np.repeat(np.array(rows, dtype=np.int64), lengths))
                return pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(place), batch.column("text_hash").take(place),
                     pa.array(np.repeat(np.array([e for e, _ in parts], dtype=np.int64), lengths)), pa.array(np.concatenate([t for _, t in parts]))],
                    names=["doc_id", "text_hash", "entity", "term"])

            for row, (text, own) in enumerate(zip(batch.column("text").to_pylist(), batch.column("entities").to_pylist(), strict=True)):
                if not own:
                    continue
                words = distinct_words(text)
                n = np.ones(len(words), dtype=np.int64)  # at least
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
                    n = np.where(terms[at] == words, n_terms[at], 1)
                for e in own:
                    bound = total * (among.get(e, other) / total) ** generalise * (1 + 1e-9)
                    rows.append(row)
                    parts.append((e, words[n <= bound]))
                    size += len(parts[-1][1])
                    if size >= PAIR_ROWS:
                        yield put()
                        rows, parts, size = [], [], 0
            if size:
                yield put()

    kind = dict(scanned.dtypes)["doc_id"]
    return scanned.select("doc_id", "text_hash", "entities", "text").where("size(entities) > 0").mapInArrow(
        run, f"doc_id {kind}, text_hash bigint, entity bigint, term bigint")


def term_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, n_term): the number of documents with each word, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0), SHARD_BYTES):
                words = Words(data, offsets, LETTERS)
                hashes = words.hashes()
                ordered = hashes[np.lexsort((hashes, np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))))]
                fresh = np.ones(len(ordered), dtype=bool)
                fresh[1:] = ordered[1:] != ordered[:-1]
                begins = words.bounds[:-1]
                fresh[begins[begins < len(fresh)]] = True
                terms, n = np.unique(ordered[fresh], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "n_term"])

    return docs.select(text_col).mapInArrow(run, "term bigint, n_term bigint").groupBy("term").agg(F.sum("n_term").alias("n_term"))


def revealing(
    pairs: DataFrame, of_entity: DataFrame, counted: DataFrame, total: int, *,
    generalise: float = GENERALISE, remove: float = REMOVE,
) -> DataFrame:
    """(entity, term, disclosure, action): the terms that exceed a threshold; action 4 removes, 5 generalises."""
    together = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
    rated = salted_join(together, of_entity, ["entity"]).join(counted, "term")
    information = F.log(F.lit(float(total)) / F.col("n_entity"))
    mutual = F.log(F.lit(float(total)) * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    rated = rated.where(F.col("n_entity") < total).withColumn("disclosure", mutual / information)
    return rated.where(F.col("disclosure") >= generalise).select(
        "entity", "term", "disclosure", F.when(F.col("disclosure") >= remove, 4).otherwise(5).alias("action"))


def find(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    generalise: float = GENERALISE, remove: float = REMOVE,
) -> DataFrame:
    """(doc_id, text_hash, base, added): base spans and those of revealing terms, one row per row of ``docs``.

    Spans are (start, kind, end) in order; kind is a place in ``KINDS``.
    """
    scanned = stored(scan(docs, id_col, text_col), "mentions")
    total = max(scanned.count(), 1)
    of_entity = stored(
        scanned.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")), "entities")
    counted = stored(term_counts(docs, text_col), "terms")
    held = pairs_of(scanned, of_entity, counted, total, generalise)
    risky = stored(revealing(held, of_entity, counted, total, generalise=generalise, remove=remove), "risky")
    key = key_columns("doc_id", "text_hash")
    names = ["absent", "id", "hash"]
    pairs = held.select(*key, "entity", "term")
    marked = salted_join(pairs, risky.select("entity", "term", "action"), ["entity", "term"]).groupBy(*names, "term").agg(
        F.min("action").alias("action"))
    by_document = marked.groupBy(*names).agg(F.collect_list(F.struct("term", "action")).alias("terms"))
    joined = scanned.select("*", *key).join(by_document, names, "left").select("doc_id", "text_hash", "base", "text", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = []
            for text, base, terms in zip(*[batch.column(c).to_pylist() for c in ("text", "base", "terms")], strict=True):
                if not terms:
                    added.append([])
                    continue
                action = {t["term"]: t["action"] for t in terms}
                hashes, start, end = placed_words(text, [(s["start"], s["kind"], s["end"], "") for s in base])
                added.append([{"start": a, "kind": action[h], "end": b}
                              for h, a, b in zip(hashes.tolist(), start.tolist(), end.tolist(), strict=True) if h in action])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), batch.column("base"), pa.array(added, pa.list_(SPAN))],
                names=["doc_id", "text_hash", "base", "added"])

    span = "array<struct<start:bigint,kind:int,end:bigint>>"
    return joined.mapInArrow(run, f"doc_id {dict(scanned.dtypes)['doc_id']}, text_hash bigint, base {span}, added {span}")


def rewrite(text: str, spans: list) -> str:
    """The text with personal data replaced by its kind, revealing terms gone or replaced by their class."""
    out, until = [], 0
    for start, kind, end in sorted(spans):
        if start < until:  # a span inside or across the one before
            until = max(until, end)
            continue
        word = text[start:end]
        out.append(text[until:start])
        if kind < 4:
            out.append(f"[{KINDS[kind].upper()}]")
        elif kind == 5:
            out.append("[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]")
        until = end
    return "".join([*out, text[until:]])


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with sanitised texts; everything else as it is, whatever the columns' names."""
    plain, id_at, text = unnamed(docs), f"c{place_of(docs, id_col)}", f"c{place_of(docs, text_col)}"
    found = find(plain, id_col=id_at, text_col=text, **options)
    names = ["absent", "id", "hash"]
    spans = (
        found.where("size(base) > 0").select(*key_columns("doc_id", "text_hash"), F.concat("base", "added").alias("spans"))
        .dropDuplicates(names)
    )

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else rewrite(t, [(x["start"], x["kind"], x["end"]) for x in s])
                          for t, s in zip(texts, spans, strict=True)], dtype=object)

    keyed = plain.withColumn("text_hash", F.xxhash64(text))
    joined = keyed.select("*", *key_columns(id_at, "text_hash")).join(spans, names, "left")
    return joined.select(*[cleaned(text, "spans").alias(c) if c == text else F.col(c) for c in plain.columns]).toDF(*docs.columns)
