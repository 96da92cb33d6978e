"""Hard negatives against brute force, and the walk over the cells."""

import math
import random

import numpy as np
import pytest

from pressline.llm import hard_negatives as mining
from pyspark.sql import functions as F

SCHEMA = "vec_id long, label int, embedding array<double>, cell string, shard int, r struct<x:int>"


def by_hand(rows, every=7, positives=5, negatives=5):
    known = {}
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in vector):
            continue
        whole = [math.floor(256 * x) for x in vector]
        known[vec_id] = min(known.get(vec_id, (label, whole)), (label, whole))
    out = []
    for anchor, (label, vector) in known.items():
        if anchor % every:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(vector, v)), i, l) for i, (l, v) in known.items() if i != anchor))
        for ps, positive, _ in [s for s in scores if s[2] == label][:positives]:
            inside = [s for s in scores if s[2] != label and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:negatives]
            out += [(anchor, positive, k + 1, i, -ps, -s) for k, (s, i, _) in enumerate(inside)]
    return sorted(out)


def fixture(kind):
    rng = random.Random(kind)
    gauss = lambda n: [rng.gauss(0, 1) for _ in range(n)]
    if kind == "odd":
        rows = [(k, k % 3, [rng.choice([0.0, 0.25, 0.5, -0.25]) for _ in range(rng.choice([0, 1, 2, 3]))]) for k in range(150)]
        rows += [
            (None, 1, [1.0]), (200, None, [1.0]), (201, 1, None), (202, 1, [None, 1.0]), (203, 1, [float("nan")]), (204, 1, [float("inf"), 1.0]),
            (210, 1, [1e306, 1.0]), (217, 2, []), (-7, 0, [0.5, 0.5]), (-14, 1, [0.0]), (5, 0, [0.25]), (5, 0, [0.25]), (5, 1, [9.0]), (7, 2, [0.5]), (7, 2, [0.5]),
        ]
        return rows
    if kind == "wide":  # products beyond 2**53 are still exact
        return [(k, k % 2, [float(rng.randint(-(2**22), 2**22)) for _ in range(5)]) for k in range(120)]
    centres = [gauss(12) for _ in range(8)]
    rows = [(k, rng.randint(0, 4), [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for k in range(900)]
    return rows + [(1000 + k, k % 2, [1.0] * 12) for k in range(500)]  # a third of the rows is one vector


@pytest.mark.parametrize("kind", ["odd", "wide", "clusters"])
def test_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(mining, "CELL_ROWS", 12)
    monkeypatch.setattr(mining, "SEED_ROWS", 20)
    monkeypatch.setattr(mining, "SHARD_VALUES", 64 * 12)
    monkeypatch.setattr(mining, "ANCHOR_BLOCK", 40)
    rows = fixture(kind)
    df = spark.createDataFrame([(*r, "c", 1, (1,)) for r in rows], SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in mining.hard_negatives(df, F.col("vec_id") % 7 == 0).collect())
    want = by_hand(rows)
    assert want and got == want


def test_nothing_to_search(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert mining.hard_negatives(empty, F.col("vec_id") % 7 == 0).count() == 0
    alone = spark.createDataFrame([(7, 1, [1.0, 2.0]), (8, 2, [1.0, 2.0])], "vec_id long, label int, embedding array<float>")
    assert mining.hard_negatives(alone, F.col("vec_id") % 100 == 0).count() == 0
    assert mining.hard_negatives(alone, F.col("vec_id") % 7 == 0).count() == 0  # no positive


def index_over(rows, size):
    half = rows.shape[1] // 2
    first, second = mining.fit_codebook(rows[:, :half], size), mining.fit_codebook(rows[:, half:], size)
    i, j = mining.nearest(rows[:, :half], first), mining.nearest(rows[:, half:], second)
    cell = i * len(second) + j
    r1, r2 = np.zeros(len(first) * len(second)), np.zeros(len(first) * len(second))
    np.maximum.at(r1, cell, np.linalg.norm(rows[:, :half] - first[i], axis=1))
    np.maximum.at(r2, cell, np.linalg.norm(rows[:, half:] - second[j], axis=1))
    count = np.bincount(cell, minlength=len(r1))
    return mining.MultiIndex(rows.shape[1], first, second, count, r1, r2, np.zeros(len(r1), np.int64), np.ones(len(r1), np.int64)), cell


def test_walk_misses_nothing_and_skips_most_cells_of_clustered_rows():
    rng = np.random.RandomState(3)
    centres = rng.normal(0, 200, (30, 16))
    rows = np.floor(centres[rng.randint(0, 30, 4000)] + rng.normal(0, 8, (4000, 16)))
    index, cell = index_over(rows, 16)
    shares = []
    for anchor in rows[:60]:
        scores = rows @ anchor
        threshold = np.sort(scores)[-6]
        visited = list(index.walk(anchor, threshold))
        assert len(set(visited)) == len(visited)
        assert set(cell[scores >= threshold]) <= set(visited)
        shares.append(np.isin(cell, visited).mean())
        assert set(index.walk(anchor, -np.inf)) == set(np.unique(cell))
    assert np.mean(shares) < 0.25
