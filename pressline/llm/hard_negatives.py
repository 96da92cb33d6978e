"""Hard-negative mining (12): an inverted multi-index over two half spaces.

Vectors are scaled to whole numbers and halved. A codebook per half is fitted on a bounded
sample; the pair of a row's nearest codewords is its cell. A cell keeps its greatest residual
per half, so an anchor's score in a cell is at most its scores with the two codewords plus its
half norms times those radii. Per anchor a heap walks the pairs of the two codebooks, each
sorted by its half's bound, in falling order of the sum, and stops where no later cell can
reach what is still wanted: the fifth positive found so far, then the lower end of the windows
of the negatives. The visits are spread over the cluster: a visit is a row of an anchor and a
shard of cells, shards and blocks of anchors are of bounded size, and every shard emits its
best rows only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pressline.llm.store import stored
from pressline.operators.ranking import top_n

SCALE = 256
SAMPLE_ROWS = 8192  # rows the codebooks are fitted on
CELL_ROWS = 64  # rows per cell aimed at
MOST_CODEWORDS = 128
SEED_ROWS = 512  # rows of the first cells visited, which give the first thresholds
HINTS = 64  # scores of negatives from the first visit that tighten the later ones
SHARD_VALUES = 1 << 18  # components of the rows of a shard
ANCHOR_BLOCK = 4096
STRIP = 256  # anchors scored at once
_UNSEEN = np.iinfo(np.int64).min
_EXACT = 2.0**53
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def scaled_rows(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part, one per id, components scaled and floored."""
    x = lambda v: F.floor(v.cast("double") * scale)
    finite = F.forall("embedding", lambda v: F.coalesce(F.abs(v.cast("double") * scale) < float("inf"), F.lit(False)))
    valid = rows.select("vec_id", "label", "embedding").filter("vec_id is not null and label is not null and embedding is not null").filter(finite)
    # floor gives a long; components beyond its range are whole numbers already.
    whole = F.transform("embedding", lambda v: F.when(F.abs(v.cast("double") * scale) < 2.0**62, x(v).cast("double")).otherwise(v.cast("double") * scale))
    picked = valid.select(F.col("vec_id").cast("long"), F.struct(F.col("label").cast("long").alias("label"), whole.alias("vector")).alias("r"))
    return picked.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.vector")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy().astype(np.int64)
    size = np.diff(ends)
    flat = column.values.to_numpy()[ends[0] : ends[-1]]
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def fit_codebook(sample: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Centres of ``size`` clusters at most, from evenly spread first centres."""
    distinct = np.unique(sample, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(size, len(distinct))).astype(int)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(sample, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        used = count > 0
        centres[used] = sums[used] / count[used, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * (rows @ centres.T), axis=1)


@dataclass
class MultiIndex:
    """Codebooks, and per cell the number of rows, the radii and the shards that hold it."""

    width: int
    first: np.ndarray
    second: np.ndarray
    count: np.ndarray
    radius1: np.ndarray
    radius2: np.ndarray
    shard: np.ndarray  # first shard of a cell
    parts: np.ndarray  # shards of a cell, one or more

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def walk(self, anchor: np.ndarray, threshold: float, rows: int | None = None) -> Iterator[int]:
        """Cells in falling order of the summed half bounds, while they may hold a score of ``threshold``.

        With ``rows`` the walk ends after cells of that many rows.
        """
        one, two = anchor[: self.half], anchor[self.half :]
        n1, n2 = np.linalg.norm(one), np.linalg.norm(two)
        s1, s2 = self.first @ one, self.second @ two
        across = len(s2)
        slack = 1 + 1e-9 * (np.abs(s1).max() + np.abs(s2).max() + n1 * self.radius1.max() + n2 * self.radius2.max())
        tight = (s1[:, None] + s2[None, :]).ravel() + n1 * self.radius1 + n2 * self.radius2 + slack
        r1, r2 = self.radius1.reshape(-1, across).max(axis=1), self.radius2.reshape(-1, across).max(axis=0)
        u1, u2 = s1 + n1 * r1 + slack, s2 + n2 * r2
        a, b = np.argsort(-u1, kind="stable"), np.argsort(-u2, kind="stable")
        u1, u2 = u1[a].tolist(), u2[b].tolist()
        heap, seen = [(-(u1[0] + u2[0]), 0, 0)], 0
        while heap:
            bound, i, j = heapq.heappop(heap)
            if -bound < threshold:
                return
            # A pair follows its left neighbour, the first of a line the one above: each is pushed once.
            if j + 1 < len(u2):
                heapq.heappush(heap, (-(u1[i] + u2[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(u1):
                heapq.heappush(heap, (-(u1[i + 1] + u2[0]), i + 1, 0))
            cell = int(a[i]) * across + int(b[j])
            if self.count[cell] and tight[cell] >= threshold:
                yield cell
                seen += int(self.count[cell])
                if rows is not None and seen >= rows:
                    return


def _assign(first: np.ndarray, second: np.ndarray, width: int):
    half = first.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rows = matrix(part.column("vector"), width)
                one, two = rows[:, :half], rows[:, half:]
                i, j = nearest(one, first), nearest(two, second)
                r1, r2 = np.linalg.norm(one - first[i], axis=1), np.linalg.norm(two - second[j], axis=1)
                cell = pa.array((i * len(second) + j).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, cell, pa.array(r1), pa.array(r2)], names=[*part.schema.names, "cell", "r1", "r2"])

    return assign


def build_index(rows: DataFrame, n: int, width: int) -> tuple[DataFrame, MultiIndex]:
    """The rows with their ``cell`` and ``shard``, and the index over them."""
    half = (width + 1) // 2
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vector").toArrow()
    known = matrix(sample.column("vector"), width)
    size = int(min(MOST_CODEWORDS, max(1, round((n / CELL_ROWS) ** 0.5))))
    first, second = fit_codebook(known[:, :half], size), fit_codebook(known[:, half:], size)
    assigned = stored(rows.mapInArrow(_assign(first, second, width), "vec_id long, label long, vector array<double>, cell int, r1 double, r2 double"))
    cells = len(first) * len(second)  # MOST_CODEWORDS squared at most, whatever the table
    count, r1, r2 = np.zeros(cells, np.int64), np.zeros(cells), np.zeros(cells)
    for row in assigned.groupBy("cell").agg(F.count(F.lit(1)), F.max("r1"), F.max("r2")).collect():
        count[row[0]], r1[row[0]], r2[row[0]] = row[1], row[2], row[3]
    most = max(64, SHARD_VALUES // max(1, width))
    parts = np.maximum(1, -(-count // most))
    shard, held = np.zeros(cells, np.int64), 0
    at = 0
    for cell in range(cells):
        if held and held + count[cell] > most:
            at, held = at + 1, 0
        shard[cell] = at
        if parts[cell] > 1:  # a cell that fills shards of its own
            at, held = at + int(parts[cell]), 0
        else:
            held += int(count[cell])
    index = MultiIndex(width, first, second, count, r1, r2, shard, parts)
    places = assigned.select("vec_id", "label", "vector", "cell").mapInArrow(_shards(shard, parts), "vec_id long, label long, vector array<double>, cell int, shard long")
    return places, index


def _shards(shard: np.ndarray, parts: np.ndarray):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            spread = (batch.column("vec_id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own = shard[cell] + (spread % parts[cell].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*batch.schema.names, "shard"])

    return place


_VISIT = "shard long, block long, vec_id long, label long, vector array<double>, wanted array<long>, cells array<int>"


def _visits(index: MultiIndex, rows: int | None):
    """One row per anchor and shard it visits, with the cells to look into."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STRIP):
                part = batch.slice(at, STRIP)
                vectors = matrix(part.column("vector"), index.width)
                row, shard, cells = [], [], []
                for k, threshold in enumerate(part.column("threshold").to_pylist()):
                    met: dict[int, list[int]] = {}
                    for cell in index.walk(vectors[k], -np.inf if threshold is None else threshold, rows):
                        for own in range(int(index.shard[cell]), int(index.shard[cell] + index.parts[cell])):
                            met.setdefault(own, []).append(cell)
                    row += [k] * len(met)
                    shard += list(met)
                    cells += list(met.values())
                taken = part.select(["block", "vec_id", "label", "vector", "wanted"]).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int64()), *taken.columns, pa.array(cells, pa.list_(pa.int32()))],
                    names=["shard", "block", "vec_id", "label", "vector", "wanted", "cells"],
                )

    return visit


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows as exact longs; one that does not fit a long is an error."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)), np.int64)
    if left.shape[1] * np.abs(left).max() * np.abs(right).max() < _EXACT:
        return (left @ right.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return whole(left).dot(whole(right).T).astype(np.int64)


def best(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores, equal ones in order."""
    if len(scores) > n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")][:n]


def _scored(anchors: pa.Table, rows: pa.Table, width: int):
    """Per anchor of a group: its number, the visited rows' ids and labels in id order, and their scores."""
    ids = rows.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, labels, cells = ids[order], rows.column("label").to_numpy()[order], rows.column("cell").to_numpy()[order]
    vectors = matrix(rows.column("vector"), width)[order]
    members = {int(c): np.flatnonzero(cells == c) for c in np.unique(cells)}
    mine = anchors.column("vec_id").to_numpy()
    wanted = matrix(anchors.column("vector"), width)
    listed = anchors.column("cells").to_pylist()
    for at in range(0, len(mine), STRIP):
        strip = range(at, min(at + STRIP, len(mine)))
        scores = np.full((len(strip), len(ids)), _UNSEEN, np.int64)
        by_cell: dict[int, list[int]] = {}
        for k in strip:
            for cell in listed[k]:
                by_cell.setdefault(cell, []).append(k)
        for cell, who in by_cell.items():
            if cell in members:
                scores[np.ix_(np.array(who) - at, members[cell])] = products(wanted[who], vectors[members[cell]])
        for k in strip:
            seen = np.flatnonzero((scores[k - at] != _UNSEEN) & (ids != mine[k]))
            yield k, ids[seen], labels[seen], scores[k - at][seen]


def _positives(width: int, n: int, hints: int):
    """Best rows of an anchor's label in the visited cells, and the highest scores of other labels as hints."""

    def search(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        own = anchors.column("label").to_numpy()
        mine = anchors.column("vec_id").to_numpy()
        out: tuple[list, ...] = ([], [], [])
        for k, ids, labels, scores in _scored(anchors, rows, width):
            same = labels == own[k]
            top = best(scores[same], n)
            other = -np.sort(-scores[~same])[:hints] if hints else scores[:0]
            out[0].extend([mine[k]] * (len(top) + len(other)))
            out[1].extend([*ids[same][top].tolist(), *[None] * len(other)])
            out[2].extend([*scores[same][top].tolist(), *other.tolist()])
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "positive_id", "score"])

    return search


def _negatives(width: int, n: int, low: int, high: int):
    """Best rows of other labels in every window of an anchor; ``wanted`` holds the positives' scores."""

    def search(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        own = anchors.column("label").to_numpy()
        mine = anchors.column("vec_id").to_numpy()
        windows = anchors.column("wanted").to_pylist()
        out: tuple[list, ...] = ([], [], [], [])
        for k, ids, labels, scores in _scored(anchors, rows, width):
            other = labels != own[k]
            ids, scores = ids[other], scores[other]
            for positive in windows[k]:
                least, most = -(-low * positive // 100), high * positive // 100  # whole numbers that satisfy both sides
                inside = (scores >= least) & (scores <= most)
                top = best(scores[inside], n)
                out[0].extend([mine[k]] * len(top))
                out[1].extend([positive] * len(top))
                out[2].extend(ids[inside][top].tolist())
                out[3].extend(scores[inside][top].tolist())
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "positive_score", "negative_id", "negative_score"])

    return search


def _meet(visits: DataFrame, places: DataFrame, search, schema: str) -> DataFrame:
    """Bring each block of anchors together with the shards it visits."""
    needed = visits.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    met = places.join(needed, "shard").select(*[F.col(c).alias(c) for c in ("shard", "block", "vec_id", "label", "vector", "cell")])
    return visits.groupBy("shard", "block").cogroup(met.groupBy("shard", "block")).applyInArrow(search, schema)


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = SCALE
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Reads ``vec_id, label, embedding``; ``anchors`` is a condition on ``vec_id`` and ``label``.
    Rows with a null id, label or vector, or a null or non-finite component (scaled ones too),
    take no part. Components are scaled, floored and multiplied as whole numbers; a shorter
    vector counts as filled up with zeros. An anchor's positives are its ``positives`` best
    other rows of its label, by score, then by smaller id. For each, the ``negatives`` best rows
    of other labels are returned whose score is between ``low`` and ``high`` per cent of the
    positive's, ``rank`` from 1. All is exact: the index only leaves out cells that cannot
    hold a result. Of rows with one id the one with the least label and vector counts. A table
    without anchors or rows gives an empty result; other columns are not read.
    """
    spark = rows.sparkSession
    base = stored(scaled_rows(rows, scale))
    n, width, n_anchors = base.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0)), F.count_if(anchors)).first()
    if not n_anchors:
        return spark.createDataFrame([], RESULT)
    places, index = build_index(base, n, max(2, width))
    blocks = -(-n_anchors // ANCHOR_BLOCK)
    asked = base.filter(anchors).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("long"))

    def search(thresholds: DataFrame, task, schema: str, limit: int | None = None) -> DataFrame:
        return _meet(stored(thresholds.mapInArrow(_visits(index, limit), _VISIT)), places, task, schema)

    nothing = F.array().cast("array<long>").alias("wanted")
    found_schema = "anchor_id long, positive_id long, score long"
    first = asked.select("block", "vec_id", "label", "vector", nothing, F.lit(None).cast("long").alias("threshold"))
    seed = stored(search(first, _positives(index.width, positives, HINTS), found_schema, SEED_ROWS))
    ranked = top_n(seed.filter("positive_id is not null"), ["anchor_id"], [F.desc("score"), F.asc("positive_id")], positives)
    fifth = ranked.filter(F.col("rank") == positives).select(F.col("anchor_id").alias("vec_id"), F.col("score").alias("threshold"))
    second = asked.join(fifth, "vec_id", "left").select("block", "vec_id", "label", "vector", nothing, "threshold")
    every = search(second, _positives(index.width, positives, 0), found_schema)
    chosen = stored(top_n(every, ["anchor_id"], [F.desc("score"), F.asc("positive_id")], positives).drop("rank"))

    # A window is certain down to its lower end, or to the last wanted score already seen inside it.
    hints = seed.filter("positive_id is null").groupBy("anchor_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("hints"))
    window = chosen.groupBy("anchor_id").agg(F.collect_set("score").alias("wanted")).join(hints, "anchor_id", "left")
    times = lambda score, percent: score.cast("decimal(38,0)") * percent

    def certain(positive: Column) -> Column:
        seen = F.filter(
            F.coalesce("hints", F.array().cast("array<long>")),
            lambda s: (times(s, 100) <= times(positive, high)) & (times(s, 100) >= times(positive, low)),
        )
        return F.coalesce(F.get(seen, F.lit(negatives - 1)), F.floor(times(positive, low) / 100).cast("long"))

    open_ = F.filter("wanted", lambda s: times(s, low) <= times(s, high))
    windows = window.select(F.col("anchor_id").alias("vec_id"), open_.alias("wanted")).filter(F.size("wanted") > 0)
    lowest = window.select(F.col("anchor_id").alias("vec_id"), F.array_min(F.transform(open_, certain)).alias("threshold"))
    third = asked.join(windows, "vec_id").join(lowest, "vec_id").select("block", "vec_id", "label", "vector", "wanted", "threshold")
    beside = search(third, _negatives(index.width, negatives, low, high), "anchor_id long, positive_score long, negative_id long, negative_score long")
    order = [F.desc("negative_score"), F.asc("negative_id")]
    best_beside = top_n(beside, ["anchor_id", "positive_score"], order, negatives)
    pairs = chosen.withColumnRenamed("score", "positive_score")
    return pairs.join(best_beside, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
