"""Order MinHash classes against an alignment of all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pressline.llm import order_minhash as om

WORDS = [f"w{i}" for i in range(300)]


def shingles(text):
    words = text.split()
    parts = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []
    seen, out = {}, []
    for p in parts:
        seen[p] = seen.get(p, 0) + 1
        out.append((p, seen[p]))
    return out


def similarity(a, b):
    """Longest common subsequence of labelled shingles over their union, by the full table."""
    if not a or not b:
        return 0.0
    line = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            kept = line[j]
            line[j] = before + 1 if x == y else max(line[j], line[j - 1])
            before = kept
    return line[-1] / (len(a) + len(b) - line[-1])


def classes(rows):
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {d: shingles(t) for d, t in rows if t is not None}
    texts = dict(rows)
    for d in sets:
        for e in sets:
            if d < e and (texts[d] == texts[e] or min(len(sets[d]), len(sets[e])) >= 0.8 * max(len(sets[d]), len(sets[e])) and similarity(sets[d], sets[e]) >= 0.8):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: root(d) for d in parent}


def changed(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    make = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(i, make(rng.randint(20, 150))) for i in range(60)]
    base = rows[3][1] + " " + make(60)
    rows += [(100 + i, changed(rng, base, rng.randint(0, 3))) for i in range(40)]
    rows += [(200 + i, changed(rng, rows[i][1], i % 4)) for i in range(30)]
    rows += [(300, rows[5][1]), (301, rows[5][1]), (302, " ".join(reversed(rows[6][1].split())))]
    rows += [(310, "one two"), (311, "one  two"), (312, "three"), (313, ""), (314, ""), (315, None), (316, None), (317, " \n")]
    rows += [(320, "x " * 90), (321, "x " * 95), (322, "x " * 150)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_those_of_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in om.near_duplicates(docs).collect()}
    assert {d: r.component_id for d, r in got.items()} == classes(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def template_family(count=300):
    """Pages of one template at a similarity of 0.78, of which every two following ones reach 0.806."""
    template = [f"t{i}" for i in range(200)]
    return [(d, " ".join(template + [f"p{d // 2}-{i}" for i in range(4)] + [f"o{d}-{i}" for i in range(24)])) for d in range(count)]


def family_classes(rows):
    sets = [om.labelled_shingles(pa.array([t]))[0] for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and om.aligned(sets[a], sets[b], 0.8) > 0:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return dict(enumerate(root))


@pytest.mark.parametrize("weight", [om.BLOCK_WEIGHT, 4000])
def test_large_buckets_are_compared_completely(spark, monkeypatch, weight):
    monkeypatch.setattr(om, "BLOCK_WEIGHT", weight)
    rows = template_family()
    want = family_classes(rows)
    assert want == {d: d // 2 * 2 for d, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in om.near_duplicates(docs).collect()} == want


def test_alignment_equals_the_full_table():
    rng = random.Random(5)
    for _ in range(200):
        a = [rng.choice("ab") for _ in range(rng.randint(5, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b))
            b[at : at + 1] = rng.choice([[], ["c"], [b[at], "d"]])
        texts = [" ".join(a), " ".join(b)]
        values, bounds = om.labelled_shingles(pa.array(texts))
        x, y = values[: bounds[1]], values[bounds[1] :]
        if not len(x) or not len(y):
            continue
        want = similarity(shingles(texts[0]), shingles(texts[1]))
        assert np.isclose(om.aligned(x, y, 0.8), want if want >= 0.8 else 0.0)


def test_unnamed_and_repeated_rows(spark):
    text = " ".join(WORDS[:40])
    rows = [(None, text), (7, text), (7, text), (9, text + " more"), (None, None), (None, "")]
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, component_id string")
    got = om.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(7, 7, True), (7, 7, True), (9, 7, False)]
    assert sorted((str(r.component_id), r.kept) for r in got if r.doc_id is None) == [("7", False), ("None", True), ("None", True)]
    kept = om.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [7, 7]


def test_one_row_of_a_class_without_ids_stays(spark):
    a, b, c = (" ".join(WORDS[i : i + 40]) for i in (0, 60, 120))
    rows = [(None, a), (None, a), (None, a + " more"), (None, b), (None, b), (3, b), (5, c), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in om.keep_one(docs).collect()]
    alone = [t for d, t in kept if d is None and t is not None]
    assert len(alone) == 1 and alone[0] in (a, a + " more")
    assert sorted(d for d, _ in kept if d is not None) == [3, 5]
    assert kept.count((None, None)) == 2


def test_empty_table(spark):
    assert om.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
