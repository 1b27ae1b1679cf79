"""Near-duplicate texts and vectors against brute force."""

import math
import random

import numpy as np
import pytest

from casegraph.llm import minmax_dedup, pca_dedup
from casegraph.llm.common import components
from casegraph.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def joined(count, pairs):
    low = list(range(count))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return [root(x) for x in range(count)]


def brute_texts(texts, percent):
    sets = [shingles(t) for t in texts]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return [len(s) for s in sets], joined(len(texts), pairs)


def varied(seed, count=50):
    chance = random.Random(seed)
    word = lambda: "w" + str(chance.randint(0, 10**6))
    base = [[word() for _ in range(chance.choice([4, 30, 90, 150]))] for _ in range(5)]
    texts = []
    for _ in range(count):
        words = list(chance.choice(base))
        for _ in range(chance.choice([0, 0, 1, 1, 2, 4])):
            words[chance.randrange(len(words))] = word()
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("block", [64, 1])
def test_texts_equal_brute_force(spark, block):
    texts = [*varied(1), None, "", " \n", "short", "SHORT", "a b c d e f", "A b\tc d  e f", "é É"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    for percent in (85, 80):
        counts, roots = brute_texts(texts, percent)
        got = minmax_dedup.near_duplicates(rows, percent=percent, block=block, tile=8 * block).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [
            (i, counts[i], roots[i], roots[i] == i) for i in range(len(texts))]


def test_the_rest_of_a_star_is_compared(spark):
    """A chain whose centre does not reach both ends directly is still one component."""
    words = [f"t{i}" for i in range(200)]
    chain = [" ".join(words[8 * k : 8 * k + 120]) for k in range(9)]
    texts = [chain[k] for k in (8, 0, 3, 6, 1, 5, 2, 7, 4)] * 2
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, roots = brute_texts(texts, 80)
    got = minmax_dedup.near_duplicates(rows, block=2, tile=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == list(enumerate(roots))


def test_keep_one(spark):
    long = "the same words again and again in this text of some length"
    rows = [(3, long, 1), (2, long, 2), (2, long, 2), (None, long, 3), (7, None, 4), (7, None, 4), (8, "", 5), (None, "lonely words", 6), (9, "alone", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int")
    got = minmax_dedup.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in got.collect()) == sorted(
        [(2, long), (7, ""), (8, ""), (0, "lonely words"), (9, "alone")])
    assert minmax_dedup.keep_one(docs.limit(0)).count() == 0


def test_text_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    counts, roots = brute_texts([r.text for r in rows], 85)
    got = {r.doc_id: r for r in QUERIES["op10_minmax_dedup"](spark, FOLDER).collect()}
    for i, r in enumerate(rows):
        assert (got[r.doc_id].n_shingles, got[r.doc_id].component_id) == (counts[i], rows[roots[i]].doc_id)


def test_components(spark):
    chance = random.Random(3)
    pairs = [(chance.randrange(80), chance.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)]
    want = joined(200, pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {n: want[n] for pair in pairs for n in pair if pair[0] != pair[1]} | {
        n: want[n] for n in got if want[n] != n or n in {want[m] for m in got}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_vectors(vectors, threshold=0.95):
    usable = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, dtype=float) / np.linalg.norm(v) if u else None for v, u in zip(vectors, usable, strict=True)]
    pairs = [(a, b) for b in range(len(vectors)) for a in range(b)
             if usable[a] and usable[b] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= threshold]
    links = [0] * len(vectors)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    return links, joined(len(vectors), pairs)


@pytest.mark.parametrize("tile", [2048, 7])
def test_vectors_equal_brute_force(spark, tile):
    chance = np.random.default_rng(2)
    centres = chance.standard_normal((6, 12))
    vectors = [[float(x) for x in centres[i % 6] * chance.choice([0.1, 3]) + 0.16 * chance.standard_normal(12)] for i in range(60)]
    vectors += [vectors[0], vectors[0], [2 * x for x in vectors[1]], None, [], [0.0] * 12, [None] * 12, [math.nan] * 12, [math.inf] * 12,
                [1.0, 2.0], [2.0, 4.0], [1e300] * 12, [1e-300] * 12]
    rows = spark.createDataFrame([(i, v, i) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, node int")
    links, roots = brute_vectors([v if v is None or None not in v else None for v in vectors])
    # the two extreme lengths point the same way, which plain norms cannot see
    extreme = [len(vectors) - 2, len(vectors) - 1]
    got = {r.vec_id: r for r in pca_dedup.near_duplicates(rows, tile=tile).collect()}
    assert len(got) == len(vectors)
    for i in range(len(vectors)):
        if i not in extreme:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i], roots[i], roots[i] == i)
    assert got[extreme[1]].component_id == extreme[0] and got[extreme[0]].n_links == 1
    assert pca_dedup.near_duplicates(rows.limit(0)).count() == 0


def test_vector_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    links, roots = brute_vectors([r.embedding for r in rows])
    got = {r.vec_id: r for r in QUERIES["op7_pca_dedup"](spark, FOLDER).collect()}
    for i, r in enumerate(rows):
        assert (got[r.vec_id].n_links, got[r.vec_id].component_id) == (links[i], rows[roots[i]].vec_id)
