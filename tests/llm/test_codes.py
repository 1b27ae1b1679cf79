"""Rule statistics and their forest, fill-in-the-middle over frames, vector codes: against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from casegraph.llm import frame_fim, rule_forest, trie_codes
from casegraph.llm.neighbour_quality import held_out
from casegraph.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


# --- rule statistics and the forest ---------------------------------------------------------------

def brute_counts(text):
    text = text or ""
    found = WORD.findall(text)
    windows = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    covered = {i + k for i in range(len(found) - 7) if windows[tuple(found[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, repeated = len(found), len(covered)
    return (n, sum(map(len, found)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, n < 20 or 100 * repeated > 30 * n)


def random_texts(seed, n=60):
    chance = random.Random(seed)
    alphabet = ["a", "bb", "#x", "é|", "*", "日本", "W", " ", "\n", "\t", " ", "1 2 3 4 5 6 7 8 ", "same line\n", "\r\n", "\x0b"]
    return ["".join(chance.choice(alphabet) for _ in range(chance.randint(0, 120))) for _ in range(n)] + [
        None, "", " \n \n", "w " * 7, "w " * 8, "w " * 9, "x y z " * 3000, "long" * 30000, "\n\n\nq\nq\n"]


def test_rule_statistics_equal_brute_force(spark):
    texts = random_texts(1)
    docs = spark.createDataFrame([(i % 40, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = Counter((r.id, *(r[c] for c in rule_forest.COUNTS), r.base_failed) for r in rule_forest.rule_statistics(docs).collect())
    assert got == Counter((i % 40, *brute_counts(t)) for i, t in enumerate(texts))


def test_forest_scores_equal_walks():
    chance = np.random.default_rng(2)
    rows = np.concatenate([chance.normal(size=(300, len(rule_forest.FEATURES))), chance.normal(9, 1, (3, len(rule_forest.FEATURES)))])
    forest = rule_forest.Forest(rows, trees=20, subsample=64)
    score = forest.score(rows)
    for i in (0, 7, 301):
        total = 0.0
        for tree in range(20):
            node = 0
            while (k := forest.feature[tree, node]) >= 0:
                node = 2 * node + 1 + int(rows[i, k] > forest.split[tree, node])
            total += forest.path[tree, node]
        assert score[i] == pytest.approx(2 ** (-total / 20 / float(rule_forest.average_path(64))))
    assert score[300:].min() > np.quantile(score[:300], 0.98)
    assert float(rule_forest.average_path(2)) == 1 and float(rule_forest.average_path(1)) == 0


def test_calibration_takes_the_best_allowed_cut():
    histogram = [(10, 90, 0), (20, 8, 1), (30, 1, 4), (40, 1, 5)]
    assert rule_forest.calibrated(histogram, 0.02) == 30 / rule_forest.BINS
    assert rule_forest.calibrated(histogram, 0.01) == 40 / rule_forest.BINS
    assert rule_forest.calibrated(histogram, 0.0) == rule_forest.calibrated([(1, 5, 0)], 1) == rule_forest.calibrated([], 1) == float("inf")


def test_held_out_verdicts(spark):
    """On labels that the model never saw: bad documents go, good ones stay unless a fixed rule fails them."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(held_out("doc_id"))
    rows = QUERIES["op11_rule_forest"](spark, folder).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert len(good) > 50 and len(bad) > 5
    assert sum(r.kept or r.base_failed for r in good) >= 0.97 * len(good)
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_rules_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op11_rule_forest"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(texts[r.doc_id])
        assert not (r.base_failed and r.kept) and 0 <= r.score <= 1


def test_rules_without_labels_or_rows(spark):
    names = ["doc_id", "text", "Kept", "a.b", "N_Words", "score", "features", "id", "quality"]
    docs = spark.createDataFrame([(i % 7, f"plain words {'and more of them ' * 8}{i % 5}", *[1] * 7) for i in range(30)] + [(None, None, *[1] * 7)], names)
    none = spark.createDataFrame([], "doc_id long, quality int")
    stats = rule_forest.rule_statistics(docs)
    model = rule_forest.fit(stats, none)
    assert model.threshold == float("inf")
    kept = rule_forest.keep_normal(docs, model)
    assert kept.columns == docs.columns and kept.count() == rule_forest.judged(stats, model).where("kept").count()
    empty = rule_forest.rule_statistics(docs.limit(0))
    assert rule_forest.judged(empty, rule_forest.fit(empty, none)).count() == rule_forest.keep_normal(docs.limit(0), model).count() == 0


# --- fill in the middle -----------------------------------------------------------------------------

def brute_fim(row, text, rate=100, spm=50):
    text = text or ""
    units = re.findall("[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"7:{'' if row is None else row}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts_of_lines(seed):
    chance = random.Random(seed)
    parts = ["\n", "a\n", "bé 日", "<", "P", ">", "S>", "\U0001f600" * 9, "line of some length\n", "x" * 50]
    return ["".join(chance.choice(parts) for _ in range(chance.randint(0, 30))) for _ in range(80)] + [
        None, "", "\n", "\n\n", "no end", "end\n", "has <M> in it\n", "é" * 70000, ("many lines\n" * 9000), "a<\n<b\n"]


@pytest.mark.parametrize("frame_bytes", [7, 64, frame_fim.FRAME_BYTES])
def test_fill_in_middle_equals_brute_force(spark, frame_bytes):
    texts = texts_of_lines(frame_bytes)
    docs = spark.createDataFrame([("kept", None if i == 3 else i, t, 1, 2, 3) for i, t in enumerate(texts)],
                                 "fim string, doc_id long, text string, `a.b` int, Stored int, Digest int").repartition(3)
    stored = frame_fim.framed(docs, frame_bytes=frame_bytes)
    for rate, spm in ((100, 50), (60, 0)):
        outputs = frame_fim.fill_in_middle(stored, rate=rate, spm=spm)
        assert [c for c in outputs.columns[:-1]] == ["fim", "doc_id", "a.b", "Stored", "Digest"]
        column = outputs.columns[-1]
        got = {}
        for r in frame_fim.digested(outputs).collect():
            f, d = r[column], r[-1]
            whole = b"".join(frame_fim.streamed(list(f.output)))
            assert hashlib.sha256(whole).hexdigest() == d.output_sha256
            again = b"".join(frame_fim.restored(list(f.output), f.form))
            assert d.restored_sha256 == hashlib.sha256(again).hexdigest()
            got[r.doc_id] = (f.units, f.form, f.prefix_chars, f.middle_chars, whole.decode(), again.decode())
        want = {None if i == 3 else i: (*brute_fim(None if i == 3 else i, t, rate, spm), t or "") for i, t in enumerate(texts)}
        assert got == want
    joined = frame_fim.texts(outputs)
    assert {r.doc_id: r.output_text for r in joined.collect()} == {k: v[4] for k, v in want.items()}


def test_only_cut_frames_are_packed_again():
    text = "".join(f"line {i}\n" for i in range(4000))
    stored = frame_fim.stored_text(text, 1000)
    out = frame_fim.formed(stored, "5", 7, 100, 50)
    kept = {x["data"] for x in stored["frames"]}
    assert len(stored["frames"]) > 30 and sum(x not in kept for x in out["output"]) <= 3 + 4
    assert b"".join(frame_fim.restored(out["output"], out["form"])).decode() == text


def test_fill_in_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert frame_fim.digested(frame_fim.fill_in_middle(frame_fim.framed(docs))).count() == 0


# --- vector codes -----------------------------------------------------------------------------------

def brute_codes(rows, rounds=6):
    kept = [(i, label, [max(min(int(np.floor(4096 * np.float64(x))), 1 << 62), -(1 << 62)) if abs(4096 * x) < 1e300 else int(np.sign(x)) << 62 for x in v])
            for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for width in {len(v) for *_, v in kept}:
        own = sorted((r for r in kept if len(r[2]) == width), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        cut = [(p * width // 8, (p + 1) * width // 8) for p in range(8)]
        books = [[list(r[2][a:b]) for r in own[:16]] for a, b in cut]

        def nearest(part, book):
            return min((sum((x - y) ** 2 for x, y in zip(part, entry, strict=True)), e) for e, entry in enumerate(book))

        for _ in range(rounds):
            for p, (a, b) in enumerate(cut):
                members = {}
                for _, _, v in own:
                    members.setdefault(nearest(v[a:b], books[p])[1], []).append(v[a:b])
                for e, parts in members.items():
                    books[p][e] = [sum(x) // len(parts) for x in zip(*parts, strict=True)]
        digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
        for i, label, v in own:
            best = [nearest(v[a:b], books[p]) for p, (a, b) in enumerate(cut)]
            out.append((i, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), digest))
    total = Counter()
    for _, label, _, error, _ in out:
        total[label] += error
    fits = lambda x: x if x < 1 << 63 else None
    whole = Counter()
    for _, label, _, error, _ in out:
        whole[label] += error if error < 1 << 63 else 0
    return Counter((i, code, fits(error), fits(whole[label]), digest) for i, label, code, error, digest in out)


def random_vectors(seed, n, width, levels=0):
    chance = np.random.default_rng(seed)
    v = chance.normal(size=(n, width)) if not levels else chance.integers(-levels, levels, (n, width)) / 4096
    return [(int(i), [float(x) for x in row], int(i) % 5 if i % 7 else None) for i, row in enumerate(v)]


@pytest.mark.parametrize("case", ["usual", "copies", "few", "odd", "huge", "widths"])
def test_codes_equal_brute_force(spark, case):
    rows = {"usual": lambda: random_vectors(1, 150, 16), "copies": lambda: random_vectors(2, 300, 16, 2) + random_vectors(2, 300, 16, 2)[:90],
            "few": lambda: random_vectors(3, 5, 16), "odd": lambda: random_vectors(4, 60, 13), "huge": lambda: [
                (i, [x * 10.0 ** (i % 6 * 4) for x in v], label) for i, v, label in random_vectors(5, 40, 8)] + [(99, [1e300, -1e308] * 4, 1)],
            "widths": lambda: random_vectors(6, 40, 8) + random_vectors(7, 40, 3) + [(7, [], 1), (8, [], None)]}[case]()
    rows += [(None, rows[0][1], 3), (1, None, 1), (2, [*rows[0][1][:-1], None], 1), (3, [*rows[0][1][:-1], float("nan")], 1), (4, [*rows[0][1][:-1], float("-inf")], None)]
    table = spark.createDataFrame([(i, v, label, 1, 2, 3) for i, v, label in rows],
                                  "vec_id long, embedding array<double>, label int, `a.b` int, Code int, `key` int").repartition(4)
    got = trie_codes.compressed(table)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_codes(rows)


def test_walk_shares_prefixes_and_breaks_ties_low():
    chance = np.random.default_rng(3)
    for width in (0, 1, 4):
        parts, _ = trie_codes.distinct_rows(chance.integers(-2, 3, (400, width)))
        entries = chance.integers(-2, 3, (16, width))
        entries[9] = entries[2]
        nearest, least = trie_codes.walk(parts, entries)
        want = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (nearest == want.argmin(axis=1)).all() and (least == want.min(axis=1)).all()


def test_codes_of_nothing(spark):
    table = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert trie_codes.compressed(table).count() == 0
