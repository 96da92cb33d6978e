"""Quality classifier (6): histogram gradient-boosted trees over document statistics.

Every document is measured once: shares of letters, capitals, digits, marks and white space,
word and line lengths, repetition. A bounded sample of labelled rows is binned and boosted
on the driver; the trees are flattened into arrays, and documents are scored by walking all
trees for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pressline.llm.store import stored
from pressline.llm.textarrays import SPACE, occurrence, slices, span_hashes, split_lines, split_words, window_hashes, window_starts, word_hashes

SAMPLE_ROWS = 20_000  # labelled rows that training reads at most, the least by a hash of their id
BINS = 64
FEATURES = (
    "log_words", "mean_word", "std_word", "letters", "capitals", "digits", "marks", "spaces", "wide", "word_marks", "short_words", "long_words",
    "capital_words", "mark_words", "distinct_words", "next_equal", "distinct_triples", "log_lines", "words_per_line", "repeated_lines", "stops",
)


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; a text without words has zeros."""
    words = split_words(column)
    rows, row, data = len(words.offsets) - 1, words.row, words.data
    byte_row = np.repeat(np.arange(rows), np.diff(words.offsets))
    per_byte = lambda mask: np.bincount(byte_row[mask], minlength=rows)
    per_word = lambda mask: np.bincount(row[mask], minlength=rows)
    lower, upper = (data >= 0x61) & (data <= 0x7A), (data >= 0x41) & (data <= 0x5A)
    # Two-byte Latin letters: the second byte tells capitals from small letters.
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80)
    upper |= latin & (data <= 0x9E)
    lower |= latin & (data > 0x9E)
    digit, space = (data >= 0x30) & (data <= 0x39), SPACE[data]
    follows = (data & 0xC0) == 0x80
    mark = ~lower & ~upper & ~digit & ~space & (data < 0x80)
    chars = np.maximum(per_byte(~follows), 1)
    count = np.maximum(words.counts, 1)
    total = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    marks, capitals, letters = total(mark), total(upper), total(upper | lower)
    length = words.end - words.start - (total(follows)[words.end] - total(follows)[words.start])
    in_word = lambda sums: sums[words.end] - sums[words.start]
    hashes = word_hashes(words)
    triples = window_starts(words.bounds, 3)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    first, last = split_lines(words)
    line_row = np.searchsorted(words.offsets, first, "right") - 1
    lines = np.bincount(line_row, minlength=rows)
    mean = np.bincount(row, length, rows) / count
    spread = np.sqrt(np.maximum(np.bincount(row, length.astype(float) ** 2, rows) / count - mean**2, 0))
    stop = np.zeros(len(words.end), bool)
    if len(data):
        stop = np.isin(data[words.end - 1], np.frombuffer(b".!?", np.uint8))
    out = np.stack(
        [
            np.log1p(words.counts), mean, spread, per_byte(lower | upper) / chars, per_byte(upper) / chars, per_byte(digit) / chars,
            per_byte(mark) / chars, per_byte(space) / chars, per_byte(data >= 0xC0) / chars, np.bincount(row, in_word(marks), rows) / count,
            per_word(length <= 2) / count, per_word(length >= 12) / count,
            per_word((in_word(capitals) == in_word(letters)) & (in_word(letters) > 1)) / count, per_word(in_word(marks) == words.end - words.start) / count,
            per_word(occurrence(hashes, row) == 0) / count, per_word(same) / count,
            np.bincount(row[triples][occurrence(window_hashes(hashes, 3)[triples], row[triples]) == 0], minlength=rows) / count,
            np.log1p(lines), words.counts / np.maximum(lines, 1),
            np.bincount(line_row[occurrence(span_hashes(data, first, last), line_row) > 0], minlength=rows) / np.maximum(lines, 1),
            per_word(stop) / count,
        ],
        axis=1,
    )
    out[words.counts == 0] = 0
    return out.astype(np.float32)


@dataclass
class Trees:
    """Complete binary trees of one depth, flattened: node ``k`` has the children ``2k+1`` and ``2k+2``."""

    depth: int
    base: float
    feature: np.ndarray  # (trees, inner nodes)
    limit: np.ndarray  # go right when the value is above
    value: np.ndarray  # (trees, leaves)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row, walking all trees level by level."""
        trees, inner = self.feature.shape
        tree = np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.limit[tree, node])
        raw = self.base + self.value[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(raw, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = BINS, ridge: float = 1.0, least: float = 8.0) -> Trees:
    """Boost ``rounds`` trees on the log loss; splits are searched on histograms of ``bins`` bins.

    Without rows, or with one label only, the trees are flat and the score is the base rate
    with one imaginary row of each label.
    """
    inner, leaves = 2**depth - 1, 2**depth
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    feature, limit, value = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
    if not len(y) or y.min() == y.max():
        return Trees(depth, base, feature[:1], limit[:1], value[:1])
    count = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(count)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(count)], axis=1)
    cell = binned + bins * np.arange(count)
    raw = np.full(len(y), base)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, offset = 2**level, 2**level - 1
            place = (node[:, None] * (count * bins) + cell).ravel()
            shape = (width, count, bins)
            g = np.bincount(place, np.repeat(gradient, count), width * count * bins).reshape(shape).cumsum(axis=2)
            h = np.bincount(place, np.repeat(weight, count), width * count * bins).reshape(shape).cumsum(axis=2)
            n = np.bincount(place, minlength=width * count * bins).reshape(shape).cumsum(axis=2)
            gain = g**2 / (h + ridge) + (g[..., -1:] - g) ** 2 / (h[..., -1:] - h + ridge) - g[..., -1:] ** 2 / (h[..., -1:] + ridge)
            gain[(n < least) | (n[..., -1:] - n < least)] = 0
            for f in range(count):
                gain[:, f, len(edges[f]) :] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9:
                    feature[t, offset + k], limit[t, offset + k] = f, edges[f][b]
            right = x[np.arange(len(y)), feature[t, offset + node]] > limit[t, offset + node]
            node = 2 * node + right
        g, h = np.bincount(node, gradient, leaves), np.bincount(node, weight, leaves)
        value[t] = -rate * g / (h + ridge)
        raw += value[t][node]
    return Trees(depth, base, feature, limit, value)


def held_out(doc_id: str = "doc_id") -> Column:
    """One in five rows by a checksum of the id; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            found = features(part.column("text"))
            ends = (np.arange(len(found) + 1) * found.shape[1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(ends, found.ravel())], names=["doc_id", "features"])


def document_features(docs: DataFrame) -> DataFrame:
    """``doc_id, features`` for every row, from whole texts; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_measure, "doc_id long, features array<float>")


def train(measured: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, **settings) -> Trees:
    """Fit trees to the labelled rows outside the held-out part, ``rows`` of them at most.

    ``labels`` has ``doc_id`` and ``quality``; other values than 0 and 1 and null are left
    out, and an id with several labels counts with the larger.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    usable = measured.filter(~held_out()).join(known, "doc_id").select("quality", "features", F.xxhash64("doc_id").alias("order"), "doc_id")
    sample = usable.orderBy("order", "doc_id", "features").limit(rows).select("quality", "features").toArrow()
    x = sample["features"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if sample.num_rows else np.zeros((0, len(FEATURES)), np.float32)
    return fit(x, sample["quality"].to_numpy().astype(np.float64), **settings)


def score(measured: DataFrame, trees: Trees) -> DataFrame:
    """``doc_id, score`` for every measured row."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = part.column("features").flatten().to_numpy().reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(trees.scores(x))], names=["doc_id", "score"])

    return measured.mapInArrow(walk, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Trees are trained on labelled rows outside the held-out fifth. Repeated rows and null ids
    are scored like any other; only the text enters a score. Other columns are not read.
    """
    measured = stored(document_features(docs))
    scored = score(measured, train(measured, labels, rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
