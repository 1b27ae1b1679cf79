"""Quality rules: an isolation forest over rule statistics judges what fixed rules leave over.

One scan counts the statistics of every whole text; only they are kept, so the forest never needs
the texts again. Documents with fewer than ``LEAST_WORDS`` words, or with more than
``MOST_REPEATED`` per cent of their words in repeated windows of eight, fail at once. The others
pass through a forest of random splits: trees grown on ``SUBSAMPLE`` rows each, whose short paths
mark anomalous rows. The forest is fitted on a sample of at most ``MOST_LABELLED`` labelled rows
(the lowest hashes); its threshold comes from the score histogram of *all* labelled rows, cut where
it parts the labels best while at most ``MOST_LOST`` of the good ones go.

Labels are learnt only from rows whose crc32 of the doc_id as text, modulo 4, is not 2, so that the
rest can measure the verdicts. Label, language, source and id are no input of a score.

Defined cases: a null or empty text has no words and fails; a line counts as repeated if an earlier
one of its text is equal to it and it holds a word; without good and bad labelled rows nothing is
anomalous; null labels are left out, and a label applies to all rows of its id; repeated rows get
equal verdicts; an empty table gives an empty result. Windows are compared by 64-bit hashes. Extra
columns, whatever their names, are left out of ``judged`` and kept by ``keep_normal``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casegraph.llm.common import VISIBLE, Words, chunks, fields, mix, place_of, segment_hash, unnamed
from casegraph.llm.neighbour_quality import held_out

LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent
WINDOW = 8

TREES = 200
SUBSAMPLE = 256
MOST_LABELLED = 8192
MOST_LOST = 0.01
BINS = 8192
SHARD_BYTES = 1 << 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Statistics of the rules, with the values up to which they are ordinary prose; a feature is what lies beyond.
RULES = {
    "word_length": 10.0,  # mean code points of a word
    "short_words": -3.0,  # the same with its sign changed: a mean below 3
    "symbols": 0.1,  # symbols for each word
    "marks": 0.2,  # other marks than full stops and commas for each word
    "capitals": 0.2,  # share of the visible characters
    "bare_words": 0.2,  # share of words without a letter
    "dup_lines": 0.3,  # share of the lines that hold a word
    "echoes": 0.1,  # share of words equal to the word before
}
FEATURES = list(RULES)
_ORDINARY = np.array(list(RULES.values()))


def _bytes_of(characters: str) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(characters.encode())] = True
    return found


_SYMBOL, _MARK = _bytes_of("#*$%&|<>"), _bytes_of("!?;:=+~^_{}[]\\/@")
_CAPITAL = _bytes_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _bytes_of("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER[128:] = True
_LEADING = np.ones(256, dtype=bool)  # bytes that begin a code point
_LEADING[0x80:0xC0] = False


def repeated_words(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of ``WINDOW`` words found twice or more in its own text."""
    n, covered = len(hashes), np.zeros(len(hashes), dtype=bool)
    if n < WINDOW:
        return covered
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.flatnonzero(text[: n - WINDOW + 1] == text[WINDOW - 1 :])
    windows = mix(text[starts].astype(np.uint64))
    for k in range(WINDOW):
        windows = mix(windows + hashes[starts + k])
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    again = np.zeros(len(starts), dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, starts[again], 1)
    np.add.at(steps, starts[again] + WINDOW, -1)
    return np.cumsum(steps[:-1]) > 0


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of each text; the columns are those of ``COUNTS`` and ``FEATURES``."""

    def per_text(marked: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marked, dtype=np.int64)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    words = Words(data, offsets, VISIBLE)
    hashes = segment_hash(data, words.start, words.end - words.start)
    bounds, leading = words.bounds, _LEADING[data]
    n = np.diff(bounds)
    chars = per_text(leading & VISIBLE[data], offsets)
    symbols = per_text(_SYMBOL[data], offsets)
    again = repeated_words(hashes, bounds)
    echo = np.zeros(len(hashes), dtype=bool)
    echo[1:] = hashes[1:] == hashes[:-1]
    echo[bounds[:-1][bounds[:-1] < len(hashes)]] = False
    letters = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    bare = letters[words.end] == letters[words.start]
    lines, dup = np.ones(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
    for i in range(len(n)):
        every = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
        worded = [x for x in every if x.strip(b" \t\n\x0b\x0c\r")]
        lines[i], dup[i] = max(len(worded), 1), len(worded) - len(set(worded))
    repeats = per_text(again, bounds)
    count = np.stack([n, chars, symbols, dup, repeats], axis=1)
    some, visible = np.maximum(n, 1), np.maximum(chars, 1)
    value = np.stack([
        chars / some, -chars / some, symbols / some, per_text(_MARK[data], offsets) / some, per_text(_CAPITAL[data], offsets) / visible,
        per_text(bare, bounds) / some, dup / lines, per_text(echo, bounds) / some], axis=1)
    return count, np.maximum(value - _ORDINARY, 0)


def failed(count: np.ndarray) -> np.ndarray:
    return (count[:, 0] < LEAST_WORDS) | (100 * count[:, 4] > MOST_REPEATED * count[:, 0])


def rule_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts, base_failed and the features of every text."""
    rows = unnamed(docs).select(F.col(f"c{place_of(docs, id_col)}").alias("id"), F.col(f"c{place_of(docs, text_col)}").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in chunks(batch.column("text"), SHARD_BYTES):
                count, feature = statistics(data, offsets)
                features = pa.FixedSizeListArray.from_arrays(pa.array(feature.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(begin, end - begin), *[pa.array(c) for c in count.T], pa.array(failed(count)), features],
                    names=["id", *COUNTS, "base_failed", "features"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return rows.mapInArrow(run, schema + ", base_failed boolean, features array<double>")


def average_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows of a random binary tree."""
    n = np.asarray(n, dtype=np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)


class Forest:
    """Random trees as heaps: the split of node i leads to 2i+1 and 2i+2; a leaf holds its path length."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 11):
        chance = np.random.default_rng(seed)
        self.size = min(subsample, len(rows))
        self.depth = int(np.ceil(np.log2(max(self.size, 2))))
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, nodes), -1, dtype=np.int16)
        self.split, self.path = np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for tree in range(trees if self.size else 0):
            self._grow(tree, 0, 0, rows[chance.choice(len(rows), self.size, replace=False)], chance)

    def _grow(self, tree: int, node: int, depth: int, rows: np.ndarray, chance: np.random.Generator) -> None:
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        varied = np.flatnonzero(high > low)
        if depth == self.depth or len(rows) < 2 or not len(varied):
            self.path[tree, node] = depth + average_path(len(rows))
            return
        k = int(chance.choice(varied))
        at = chance.uniform(low[k], high[k])
        self.feature[tree, node], self.split[tree, node] = k, at
        right = rows[:, k] > at
        self._grow(tree, 2 * node + 1, depth + 1, rows[~right], chance)
        self._grow(tree, 2 * node + 2, depth + 1, rows[right], chance)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly of each row, 0 to 1: the shorter its mean path, the higher."""
        if self.size < 2 or not len(rows):
            return np.full(len(rows), 0.5)
        total, index = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                k = feature[node]
                node = np.where(k < 0, node, 2 * node + 1 + (rows[index, k] > split[node]))
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / average_path(self.size))


class Model:
    """A forest and the score from which on a document is anomalous."""

    def __init__(self, forest: Forest, threshold: float):
        self.forest, self.threshold = forest, threshold


def _scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """``rows`` of statistics with the forest's score instead of their features."""
    sent = rows.sparkSession.sparkContext.broadcast(forest)
    kept = [c for c in rows.columns if c != "features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield batch.select(kept).append_column("score", pa.array(sent.value.score(features)))

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.select(*kept).dtypes) + ", score double")


def calibrated(histogram: list[tuple[int, int, int]], most_lost: float) -> float:
    """The threshold of the best difference between bad and good rows caught; ``histogram``: (bin, good, bad)."""
    good, bad = sum(g for _, g, _ in histogram), sum(b for _, _, b in histogram)
    best, found, lost, caught = 0.0, float("inf"), 0, 0
    if good and bad:
        for place, g, b in sorted(histogram, reverse=True):
            lost, caught = lost + g, caught + b
            if lost > most_lost * good:
                break
            if caught / bad - lost / good > best:
                best, found = caught / bad - lost / good, place / BINS
    return found


def fit(
    stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", most_labelled: int = MOST_LABELLED,
    most_lost: float = MOST_LOST,
) -> Model:
    """The forest and threshold for ``stats``, the result of ``rule_statistics`` (store it first: it is read twice)."""
    key, label = F.col(f"`{id_col}`"), F.col(f"`{label_col}`")
    known = (
        labels.where(key.isNotNull() & label.isin(0, 1)).select(key.alias("id"), label.cast("int").alias("label"))
        .where(~held_out("id")).groupBy("id").agg(F.min("label").alias("label"))
    )
    rows = stats.where(~F.col("base_failed")).join(known, "id").select("id", "label", "features")
    sample = rows.orderBy(F.xxhash64("id", "features"), "id", "features").limit(most_labelled).select("features").toArrow()
    found = sample["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    forest = Forest(found)
    bins = _scored(rows, forest).groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(
        F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad"))
    return Model(forest, calibrated([tuple(r) for r in bins.collect()], most_lost))


def judged(stats: DataFrame, model: Model) -> DataFrame:
    """id, the counts, base_failed, score and kept of every row of ``stats``."""
    return _scored(stats, model.forest).withColumn("kept", ~F.col("base_failed") & (F.col("score") < F.lit(model.threshold)))


def keep_normal(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The documents that ``model`` keeps, with the columns of ``docs``; no text is shuffled."""
    sent, at, plain = docs.sparkSession.sparkContext.broadcast(model), place_of(docs, text_col), unnamed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in chunks(batch.column(at), SHARD_BYTES):
                count, feature = statistics(data, offsets)
                kept = ~failed(count) & (sent.value.forest.score(feature) < sent.value.threshold)
                yield batch.slice(begin, end - begin).append_column("kept", pa.array(kept))

    return plain.mapInArrow(run, ", ".join([*fields(plain), "kept boolean"])).where("kept").drop("kept").toDF(*docs.columns)
