"""Suffix-array dedup against every window of the texts."""

import random
from collections import defaultdict

import pytest

from pressline.llm.suffixes import remove_duplicates, repeated_places, suffix_duplicates

WORDS = [f"w{i}" for i in range(400)]


def brute(rows, passage):
    """Words covered by repeated passages, per row, without regard to which place is first."""
    seen = defaultdict(set)
    for doc_id, text in rows:
        words = (text or "").split()
        for at in range(len(words) - passage + 1):
            seen[tuple(words[at : at + passage])].add((doc_id, at))
    found = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for doc_id, at in places:
                found[doc_id].update(range(at, at + passage))
    return found


def corpus(seed):
    rng = random.Random(seed)
    make = lambda n: [rng.choice(WORDS) for _ in range(n)]
    shared = [make(rng.randint(50, 90)) for _ in range(4)]
    rows = []
    for i in range(60):
        words = make(rng.randint(0, 120))
        if i % 3 == 0:
            words += shared[rng.randrange(4)] + make(rng.randint(0, 40))
        if i % 10 == 9:
            words = rows[rng.randrange(len(rows))][1].split() + make(3)
        rows.append((i, " ".join(words)))
    rows += [(100, "a " * 130), (101, None), (102, ""), (103, " \t\n"), (104, "z " * 49), (105, "z " * 50)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("passage", [50, 12])
def test_spans_cover_all_repeated_passages(spark, seed, passage):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, removed = defaultdict(set), defaultdict(set)
    for r in suffix_duplicates(docs, passage).collect():
        words = set(range(r.span_start, r.span_end))
        assert not words & found[r.doc_id]
        found[r.doc_id] |= words
        if r.removed:
            removed[r.doc_id] |= words
    want = brute(rows, passage)
    assert {k: v for k, v in found.items() if v} == dict(want)
    # Every repeated passage keeps one place of which no word goes.
    text = {d: (t or "").split() for d, t in rows}
    kept, every = set(), set()
    for d, words in text.items():
        for at in range(len(words) - passage + 1):
            place = set(range(at, at + passage))
            if place <= want.get(d, set()):
                every.add(tuple(words[at : at + passage]))
                if not place & removed[d]:
                    kept.add(tuple(words[at : at + passage]))
    repeated = {w for w in every if sum(tuple(t[i : i + passage]) == w for t in text.values() for i in range(len(t) - passage + 1)) > 1}
    assert repeated <= kept


def test_removal_keeps_one_copy_and_other_columns(spark):
    passage = [f"p{i}" for i in range(60)]
    rows = [(1, "before one " + " ".join(passage), 7, "x"), (2, " ".join(passage), 7, "y"), (3, "alone", 7, None), (4, None, 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, doc string")
    out = {r.doc_id: r for r in remove_duplicates(docs).collect()}
    assert sum("p0 " in (r.text or "") for r in out.values()) == 1
    assert out[3].text == "alone" and out[4].text is None and out[3].n_chars == 5
    if 2 in out:
        assert out[1].text == "before one" and out[2].doc == "y"
    assert docs.columns == remove_duplicates(docs).columns


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_keys_that_fill_partitions(spark, partitions):
    rng = random.Random(partitions)
    rows = [(0, i, 0) for i in range(300)] + [(rng.randrange(50), rng.randrange(40), rng.randrange(3)) for _ in range(200)]
    rows += [(1000 + i, i, 0) for i in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = repeated_places(spark.createDataFrame(rows, "key long, doc long, pos int")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    places = defaultdict(set)
    for k, d, p in rows:
        places[k].add((d, p))
    want = sorted((k, d, p, (d, p) == min(v)) for k, v in places.items() if len(v) > 1 for d, p in v)
    assert sorted((r.key, r.doc, r.pos, r.first) for r in got) == want


def test_empty_table(spark):
    assert suffix_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
