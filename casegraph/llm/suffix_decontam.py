"""Benchmark decontamination with suffix arrays of the training text.

Every task cuts its documents into shards of whole documents and builds one suffix array of words
per shard. Each suffix of each benchmark item is looked up in it by binary search, word by word,
so that a range of equal beginnings narrows until the longest match is left. A match counts from
``window`` words on, or from the whole item if that is shorter. Nothing is shuffled.

The benchmark is the stated query set. It is passed to the tasks in blocks of at most
``block_words`` words; a larger benchmark takes more passes over each batch, not more memory.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item is never
found; repeated items count once per id, a null id is the empty string; repeated documents give the
same result each; a match never spans two documents. Result columns replace input columns of the
same name in any case; other columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casegraph.llm.common import LETTERS, Words, chunks, fields, place_of, unnamed

WINDOW = 10
SHARD_BYTES = 2 << 20
BLOCK_WORDS = 2_000_000
WORD_BITS = 21  # three words make one sort key; a block with more distinct words takes more bits

MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())])
FOUND = {"n_words": pa.int64(), "n_hit": pa.int64(), "item_ids": pa.list_(pa.string()), "matches": pa.list_(MATCH)}
FOUND_DDL = ("n_words bigint, n_hit bigint, item_ids array<string>, "
             "matches array<struct<item_id:string,item_start:bigint,doc_start:bigint,n_words:bigint>>")


def word_numbers(words: Words, vocabulary: np.ndarray) -> np.ndarray:
    """The place from 1 on of each word's hash in the sorted ``vocabulary``; one number beyond it for all others."""
    hashes = words.hashes()
    if not len(vocabulary):
        return np.ones(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, len(vocabulary)) + 1


class Queries:
    """All suffixes of a block of benchmark items, as word numbers."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in encoded])]).astype(np.int64)
        words = Words(np.frombuffer(b"".join(encoded), dtype=np.uint8), offsets, LETTERS)
        self.ids = ids
        self.vocabulary = np.unique(words.hashes())
        self.hash = word_numbers(words, self.vocabulary)
        self.bits = max(WORD_BITS, (len(self.vocabulary) + 1).bit_length())
        self.spelling = [words.word(i) for i in range(len(self.hash))]
        count = np.diff(words.bounds)
        self.item = np.repeat(np.arange(len(ids)), count)
        self.left = np.repeat(words.bounds[1:], count) - np.arange(len(self.hash))  # words from here to the item's end
        self.place = np.arange(len(self.hash)) - np.repeat(words.bounds[:-1], count)
        self.need = np.minimum(window, np.repeat(count, count))
        self.longest = int(count.max(initial=0))
        self.starts = np.flatnonzero(self.left >= self.need)


def suffix_array(words: np.ndarray, depth: int, bits: int = WORD_BITS) -> np.ndarray:
    """Places of ``words``, numbers of ``bits`` bits, in the order of their suffixes, told apart up to ``depth`` words."""
    n, taken = len(words), 63 // bits
    key, padded = words.copy(), np.concatenate([words, np.zeros(taken, dtype=np.int64)])
    for k in range(1, taken):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key)

    def regroup(places: np.ndarray, keys: np.ndarray, base: np.ndarray, into: np.ndarray) -> np.ndarray:
        """Gives places with equal sorted keys one rank; returns a mask of those that are not alone."""
        new = np.empty(len(keys), dtype=bool)
        new[:1] = True
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        head = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
        into[places] = base[head]
        alone = new.copy()
        alone[:-1] &= new[1:]
        return ~alone

    ranks = np.zeros(n + depth + 1, dtype=np.int64)
    slots = np.arange(n)
    open_ = regroup(order, key[order], slots, ranks)
    reach = taken
    while reach < depth and open_.any():
        slots = slots[open_]
        places = order[slots]
        key = ranks[places] * (n + 1) + ranks[places + reach]
        by = np.argsort(key)
        order[slots] = places[by]
        open_ = regroup(places[by], key[by], slots, ranks)
        reach *= 2
    return order


def narrow(words, order, low, high, depth, wanted):
    """The part of each range [low, high) of the suffix array whose word at ``depth`` is the wanted one."""

    def bound(right: bool) -> np.ndarray:
        a, b = low.copy(), high.copy()
        while True:
            going = np.flatnonzero(a < b)
            if not len(going):
                return a
            middle = (a[going] + b[going]) >> 1
            value, target = words[order[middle] + depth], wanted[going]
            beyond = (value <= target) if right else (value < target)
            a[going[beyond]] = middle[beyond] + 1
            b[going[~beyond]] = middle[~beyond]

    return bound(False), bound(True)


def spans_of(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, place in the suffix array) of every entry of the ranges."""
    size = high - low
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + low[owner]


def search(words: np.ndarray, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``words``, query suffix, length) of every match that cannot be longer at either end.

    ``words`` ends each document with a zero, which no word's number is.
    """
    order = suffix_array(words, queries.longest, queries.bits)
    padded = np.concatenate([words, np.zeros(queries.longest + 1, dtype=np.int64)])
    active = queries.starts
    low, high = np.zeros(len(active), dtype=np.int64), np.full(len(active), len(words), dtype=np.int64)
    places, suffixes = [], []
    for depth in range(int(queries.need.max(initial=0))):
        low, high = narrow(padded, order, low, high, depth, queries.hash[active + depth])
        done = (low < high) & (queries.need[active] == depth + 1)
        if done.any():
            owner, slot = spans_of(low[done], high[done])
            places.append(order[slot])
            suffixes.append(active[done][owner])
        going = (low < high) & ~done
        active, low, high = active[going], low[going], high[going]
    if not places:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    place, suffix = np.concatenate(places), np.concatenate(suffixes)
    # keep matches that start at a difference; each then runs on as far as the words agree
    before = np.where(place > 0, padded[place - 1], 0)
    begins = (queries.place[suffix] == 0) | (place == 0) | (before != queries.hash[suffix - 1])
    place, suffix = place[begins], suffix[begins]
    length = queries.need[suffix].astype(np.int64)
    growing = np.arange(len(place))
    while len(growing):
        growing = growing[length[growing] < queries.left[suffix[growing]]]
        same = padded[place[growing] + length[growing]] == queries.hash[suffix[growing] + length[growing]]
        growing = growing[same]
        length[growing] += 1
    return place, suffix, length


def covered(n: int, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + length, -1)
    return np.cumsum(edge[:-1]) > 0


def scan_shard(data: np.ndarray, offsets: np.ndarray, queries: Queries) -> dict[str, list]:
    """The result columns of the documents of one shard."""
    found = Words(data, offsets, LETTERS)
    count = np.diff(found.bounds)
    docs = len(count)
    # one zero after each document
    slot = np.arange(len(found.start)) + np.repeat(np.arange(docs), count)
    words = np.zeros(len(found.start) + docs, dtype=np.int64)
    words[slot] = word_numbers(found, queries.vocabulary)
    owner = np.repeat(np.arange(docs), count + 1)
    first = found.bounds[:-1] + np.arange(docs)
    while True:
        place, suffix, length = search(words, queries)
        # matches are held against the spelling; a word with the 64-bit hash of another is no word of the benchmark
        wrong = {p + k for p, s, n in zip(place.tolist(), suffix.tolist(), length.tolist(), strict=True) for k in range(n)
                 if found.word(p + k - owner[p]) != queries.spelling[s + k]}
        if not wrong:
            break
        words[list(wrong)] = len(queries.vocabulary) + 1
    hit = covered(len(words), place, length)
    n_hit = np.bincount(owner[hit], minlength=docs)
    result: dict[str, list] = {"n_words": count.tolist(), "n_hit": n_hit.tolist(),
                               "item_ids": [[] for _ in range(docs)], "matches": [[] for _ in range(docs)]}
    for p, s, n in sorted(zip(place.tolist(), suffix.tolist(), length.tolist(), strict=True)):
        doc = int(owner[p])
        result["matches"][doc].append(
            {"item_id": queries.ids[queries.item[s]], "item_start": int(queries.place[s]),
             "doc_start": int(p - first[doc]), "n_words": n})
    for doc in np.unique(owner[place]):
        result["item_ids"][doc] = sorted({m["item_id"] for m in result["matches"][doc]})
    return result


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[tuple[list[str], list[str]]]:
    """The benchmark's items, a bounded number of words at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).where(F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        ids.append(item)
        texts.append(text)
        size += len(text) // 2 + 1
        if size >= block_words:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find_matches(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside a match), item_ids, and matches: the longest verbatim
    matches as (item_id, item_start, doc_start, n_words), counted in words.

    Columns of ``docs`` that bear one of these names, in any case, are replaced.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in FOUND]
    shown, text = [f"c{place_of(docs, c)}" for c in names], f"c{place_of(docs, text_col)}"
    kept = shown if text in shown else [*shown, text]
    typed = unnamed(docs)
    searched = typed
    parts = list(blocks(benchmark, item_id_col, item_text_col, block_words)) or [([], [])]
    for number, (ids, texts) in enumerate(parts):
        sent = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, again=number > 0) -> Iterator[pa.RecordBatch]:
            queries = Queries(*sent.value, window)
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                for begin, end, data, offsets in chunks(rows[text], shard_bytes):
                    part = rows.slice(begin, end - begin)
                    found = scan_shard(data, offsets, queries)
                    if again:
                        found = merged(found, part.select(list(FOUND)).to_pydict())
                    out = part.select(kept)
                    for name, kind in FOUND.items():
                        out = out.append_column(name, pa.array(found[name], type=kind))
                    yield from out.combine_chunks().to_batches()

        plain = searched.select(*kept, *([] if number == 0 else FOUND))
        searched = plain.mapInArrow(run, ", ".join([*fields(typed.select(*kept)), FOUND_DDL]))
    return searched.select(*shown, *FOUND).toDF(*names, *FOUND)


def merged(now: dict[str, list], before: dict[str, list]) -> dict[str, list]:
    """The results of two blocks of items for the same documents."""
    out: dict[str, list] = {"n_words": now["n_words"], "n_hit": [], "item_ids": [], "matches": []}
    for n, a, b in zip(now["n_words"], now["matches"], before["matches"], strict=True):
        both = sorted(a + b, key=lambda m: (m["doc_start"], m["item_id"], m["item_start"]))
        hit = covered(n, np.array([m["doc_start"] for m in both], dtype=np.int64),
                      np.array([m["n_words"] for m in both], dtype=np.int64))
        out["n_hit"].append(int(hit.sum()))
        out["matches"].append(both)
        out["item_ids"].append(sorted({m["item_id"] for m in both}))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a verbatim match, with the columns of ``docs``.

    Columns of any name are kept as they are.
    """
    plain = unnamed(docs)
    text = f"c{place_of(docs, options.pop('text_col', 'text'))}"
    found = find_matches(plain, benchmark, text_col=text, **options)
    return found.where("n_hit = 0").select(*plain.columns).toDF(*docs.columns)
