"""Decontamination, packing and line windows against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from casegraph.llm import best_fit_packing, suffix_decontam, window_dedup
from casegraph.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items, window=10):
    found, hit, hits = words(text), set(), set()
    for item, body in items:
        want = words(body)
        size = min(window, len(want))
        for j in range(len(want) - size + 1) if size else ():
            for p in range(len(found) - size + 1):
                if found[p : p + size] == want[j : j + size]:
                    hit.update(range(p, p + size))
                    hits.add("" if item is None else str(item))
    return len(found), len(hit), sorted(hits)


def random_case(seed):
    chance = random.Random(seed)
    vocabulary = ["a", "B", "cc", "Ünï", "x9", "don't"]
    text = lambda n: " ".join(chance.choice(vocabulary) for _ in range(n))
    items = [(i, text(chance.randint(0, 14))) for i in range(4)] + [(3, text(12)), (None, "only here"), (9, None), (10, "")]
    docs = [text(chance.randint(0, 60)) for _ in range(8)]
    docs += [docs[0], None, "", ".", "Only  HERE!", (items[4][1] + " ") * 3, "q" * 5000]
    docs += ["x y " + items[4][1].upper() + " z"]
    return items, docs


@pytest.mark.parametrize("block_words", [2_000_000, 5])
def test_decontamination_equals_brute_force(spark, block_words):
    for seed in range(3):
        items, texts = random_case(seed)
        docs = spark.createDataFrame([(i % 9, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, n_hit string")
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = suffix_decontam.find_matches(docs.repartition(3), bench, block_words=block_words, shard_bytes=200).collect()
        want = sorted([i % 9, t or "", *brute_hits(t, items)] for i, t in enumerate(texts))
        assert sorted([r.doc_id, r.text or "", r.n_words, r.n_hit, r.item_ids] for r in got) == want
        clean = suffix_decontam.decontaminate(docs, bench)
        assert clean.columns == docs.columns
        assert sorted((r.doc_id, r.text or "", r.n_hit) for r in clean.collect()) == sorted(
            (i % 9, t or "", "kept") for i, t in enumerate(texts) if not brute_hits(t, items)[1])


def test_matches_are_longest_and_placed(spark):
    docs = spark.createDataFrame([(1, "p q " + " ".join(f"w{i}" for i in range(14)) + " r")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "z " + " ".join(f"w{i}" for i in range(12)) + " y")], "item_id long, text string")
    row = suffix_decontam.find_matches(docs, bench).first()
    assert [tuple(m) for m in row.matches] == [("5", 1, 2, 12)]


def test_words_with_like_hashes_do_not_hide_a_match(spark):
    """A one-word item whose word shares 20 bits of its hash with a word of a true passage of another item."""
    names = [f"n{i}" for i in range(8000)]
    data = np.frombuffer(" ".join(names).encode(), dtype=np.uint8)
    short = suffix_decontam.Words(data, np.array([0, len(data)]), suffix_decontam.LETTERS).hashes() >> np.uint64(44)
    order = np.argsort(short, kind="stable")
    k = int(np.flatnonzero(np.diff(short[order].astype(np.int64)) == 0)[0])
    one, other = names[order[k]], names[order[k + 1]]
    passage = " ".join([*"abcde", other, *"fghi"])
    docs = spark.createDataFrame([(1, f"x {passage} y")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, one), (2, passage)], "item_id long, text string")
    row = suffix_decontam.find_matches(docs, bench).first()
    assert (row.n_hit, row.item_ids) == (10, ["2"])


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert suffix_decontam.find_matches(docs, bench).first().n_hit == 0
    assert suffix_decontam.find_matches(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_decontamination_query(spark):
    got = {r.doc_id: r for r in QUERIES["op3_suffix_decontamination"](spark, FOLDER).collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    windows = {}
    for item, body in items:
        w = words(body)
        size = min(10, len(w))
        for j in range(len(w) - size + 1) if size else ():
            windows.setdefault((size, tuple(w[j : j + size])), set()).add(str(item))
    sizes = {s for s, _ in windows}
    for d in docs:
        w, hit, ids = words(d.text), set(), set()
        for s in sizes:
            for p in range(len(w) - s + 1):
                if found := windows.get((s, tuple(w[p : p + s]))):
                    hit.update(range(p, p + s))
                    ids |= found
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def hf_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def check_packing(rows, texts, window=2048):
    """Every id lies in one piece; sequences have no gaps."""
    ids = {k: np.array([*i, 1], dtype="<u4") for k, i in zip(texts, hf_ids([t or "" for t in texts.values()]), strict=True)}
    seen, used = {}, {}
    for r in rows:
        tokens = ids[r.doc_id]
        assert r.doc_tokens == len(tokens) and zlib.crc32(tokens[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen.keys() == ids.keys()
    for parts, chain in ((seen, {k: len(v) for k, v in ids.items()}), (used, None)):
        for k, spans in parts.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at and length > 0
                at += length
            assert at == chain[k] if chain else at <= window
    return sum(len(v) for v in ids.values()) / (window * len(used))


def test_packing_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert check_packing(QUERIES["op5_best_fit_packing"](spark, FOLDER).collect(), texts) > 0.97


def test_packing_edges(spark):
    texts = {1: None, 2: "", 3: "word " * 9000, 4: "<|endoftext|> é 漢字 🙂", 5: "x"}
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, length int")
    check_packing(best_fit_packing.pack_documents(docs).collect(), texts)
    assert best_fit_packing.pack_documents(docs.limit(0)).count() == 0
    packed = best_fit_packing.pack_documents(docs, with_ids=True)
    for row in best_fit_packing.sequences(packed).collect():
        total = sum(row.lengths)
        assert len(row.ids) == (total if total & (total - 1) == 0 else 2048)


def test_best_fit_takes_the_tightest_window():
    sequence, offset = best_fit_packing.best_fit(np.array([6, 5, 4, 3, 3]), 10)
    assert sequence.tolist() == [0, 1, 0, 1, 2] and offset.tolist() == [0, 0, 6, 5, 0]
    chance = np.random.default_rng(1)
    for _ in range(50):
        lengths = chance.integers(1, 40, size=60)
        sequence, offset = best_fit_packing.best_fit(lengths, 40)
        open_, want = [], []
        for i in np.argsort(-lengths, kind="stable"):
            room = min((r for r in open_ if r >= lengths[i]), default=None)
            if room is not None:
                open_.remove(room)
            open_.append((40 if room is None else room) - lengths[i])
            want.append(40 if room is None else room)
        assert [40 - o for o in offset[np.argsort(-lengths, kind="stable")]] == want


def brute_lines(docs, size=3):
    """Kept lines of each (doc_id, text), ids ascending."""
    windows, out = {}, []
    keys = sorted({(-1 if d is None else d, t) for d, t in docs if t is not None})
    assert len({d for d, _ in keys}) == len(keys), "one text per id, so that the order is plain"
    for d, t in keys:
        lines = t.split("\n")
        for i in range(max(1, len(lines) - size + 1)):
            windows.setdefault(tuple(lines[i : i + size]), []).append((d, i))
    gone = {(d, i + k) for places in windows.values() for d, i in sorted(places)[1:] for k in range(size)}
    for d, t in docs:
        own = -1 if d is None else d
        out.append(None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (own, i) not in gone))
    return out


def test_line_windows(spark):
    docs = [(3, "p\nq\nr\ns"), (1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ny\nz"), (None, "q\nr\ns"), (5, None), (6, ""), (7, ""), (8, "one"),
            (9, "one"), (10, "m\nm\nm\nm\nm"), (11, "a\nb"), (12, "\n\n\n"), (13, "p\nq\nr\ns\nt"), (13, "p\nq\nr\ns\nt")]
    rows = spark.createDataFrame([(d, t, "extra") for d, t in docs], "doc_id long, text string, place string")
    got = {(r.doc_id, r.n_lines): (r.text, r.n_removed, r.place) for r in window_dedup.dedup_lines(rows).collect()}
    assert window_dedup.dedup_lines(rows).count() == len(docs)
    for (d, t), want in zip(docs, brute_lines(docs), strict=True):
        lines = 0 if t is None else len(t.split("\n"))
        text, removed, place = got[d, lines]
        assert text == want and place == "extra"
        if t:
            assert removed == lines - (len(want.split("\n")) if want or lines == 1 else 0) or want == ""
    assert window_dedup.dedup_lines(rows.limit(0)).count() == 0


def test_line_windows_at_random(spark):
    chance = random.Random(4)
    docs = [(i, "\n".join(chance.choice("abcd") for _ in range(chance.randint(1, 12)))) for i in range(60)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in window_dedup.dedup_lines(rows).collect()}
    for (d, _), want in zip(docs, brute_lines(docs), strict=True):
        assert got[d] == want
