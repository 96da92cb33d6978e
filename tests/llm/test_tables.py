"""Operators on whole tables against brute force and their SQL."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sqlcheck

import __spark_entry__ as entry
from pressline.llm import cross_polytope, poisson_mixing, sharding, url_reputation
from pressline.llm.queries import RULES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_url_reputation", "op2_near_vectors", "op3_poisson_mix"])
def test_query_agrees_with_sql(spark, name):
    problem, _ = sqlcheck.compare(entry.queries()[name](spark, DATA), sqlcheck.connect(DATA), entry.oracle_sql()[name])
    assert problem == ""


def test_url_rules(spark):
    urls = {
        "HTTP://A.Example.COM/en/7x?q": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        "https://example.com/en/8#x": ("example.com", "/en/8", "com/en/", "block"),
        "https://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "https://x.example.net/de/81": ("x.example.net", "/de/81", "example.net/de/8", "block"),
        "https://other.net/de/8": ("other.net", "/de/8", "net/de/", "allow"),
        "ftp://a://b/c": ("a:", "//b/c", None, "allow"),
        "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), "http://": ("", "", None, "allow"), "x://h?/en/": ("h", "", None, "allow"),
        "a\n://Ünï.ORG/es/\n": ("Ünï.org", "/es/\n", "org/es/", "block"),
    }
    rows = [*enumerate(urls), (99, None), (99, None)]
    pages = spark.createDataFrame([(i, u, "rule") for i, u in rows], "page_id long, url string, host string")
    got = url_reputation.judge_urls(pages, spark.createDataFrame([], "host string, good boolean"), RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        want = ("", "", None, "allow") if r.page_id == 99 else urls[rows[r.page_id][1]]
        assert (r.host, r.path, r.rule, r.verdict) == want


def verdicts(spark, pages, outcomes):
    df = spark.createDataFrame(outcomes, "host string, good boolean")
    got = url_reputation.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), df, []).collect()
    return {r.page_id: (r.verdict, r.n_labelled) for r in got}


def test_bad_hosts_are_blocked(spark):
    outcomes = [("bad.example.com", False)] * 200 + [("good.example.com", True)] * 200 + [("good.example.com", None)]
    pages = [(0, "http://bad.example.com/"), (1, "http://good.example.com/"), (2, "http://new.example.com/")]
    assert verdicts(spark, pages, outcomes) == {0: ("block", 200), 1: ("allow", 200), 2: ("allow", 0)}


def test_rare_hosts_lean_on_their_domain(spark):
    outcomes = [(f"h{i}.spam.org", i % 10 == 0) for i in range(300) for _ in range(3)] + [(f"h{i}.fine.org", i % 10 > 0) for i in range(300) for _ in range(3)]
    outcomes += [(f"h{i}.{d}.co.uk", i % 2 == 0) for i in range(50) for d in ("a", "b")] + [("x.spam.org", True)]
    pages = [(0, "http://x.spam.org/"), (1, "http://never.spam.org:80"), (2, "http://never.fine.org"), (3, "http://q.c.co.uk"), (4, "http://10.0.0.1/")]
    got = verdicts(spark, pages, outcomes)
    assert got[1] == ("block", 0) and got[2] == ("allow", 0) and got[3] == ("allow", 0) and got[4] == ("allow", 0) and got[0][1] == 1


def vectors(seed):
    rng = np.random.RandomState(seed)
    rows = [rng.randn(16) for _ in range(150)]
    hot = rng.randn(16)
    rows += [hot + 0.05 * rng.randn(16) for _ in range(120)] + [hot.copy() for _ in range(30)] + [3 * hot, -hot, 1e-30 * hot, 1e30 * hot]
    rows += [rows[k] + 0.1 * rng.randn(16) for k in range(60)]
    return [r.tolist() for r in rows]


@pytest.mark.parametrize("block", [7, 1024])
def test_links_equal_those_of_all_pairs(spark, block):
    made = vectors(1)
    x = cross_polytope.unit(np.array(made))
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, made[0][:8], made[0] + [0.0]]
    rows = [(i, v, "c") for i, v in enumerate(made + odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id string").repartition(3)
    got = {r.vec_id: r for r in cross_polytope.near_vectors(df, block=block).collect()}
    assert len(got) == len(rows)
    for i in range(len(made)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), label[i], label[i] == i)
    for i in range(len(made), len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_vectors_without_ids_and_empty_tables(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (5, [2.0, 0.0]), (None, None), (6, [0.0, 1.0]), (6, [0.0, 1.0])]
    got = cross_polytope.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == [
        ("5", 2, "5", True), ("6", 1, "6", True), ("6", 1, "6", True), ("None", 0, "None", True), ("None", 2, "5", False), ("None", 2, "5", False),
    ]
    assert cross_polytope.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_on_given_vectors(spark):
    x = cross_polytope.unit(np.random.RandomState(4).randn(3000, 64))
    other = np.random.RandomState(5).randn(3000, 64)
    other -= (other * x).sum(axis=1, keepdims=True) * x
    y = 0.951 * x + math.sqrt(1 - 0.951**2) * cross_polytope.unit(other)
    a, b = cross_polytope.probe_codes(x), cross_polytope.probe_codes(y)
    met = (a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)
    assert met.any(axis=1).mean() > 0.999


def draw(doc_id, rate):
    u = int(hashlib.md5(f"mix-1/{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_copies_follow_the_poisson_draw(spark):
    rates = {"a": 0.3, "b": 2.5, "c": 40.0, None: 1.0, "zero": 0.0}
    rows = [(i, f"t{i}", random.Random(i).choice(["a", "b", "c", None, "zero", "unlisted"])) for i in range(600)] + [(None, None, "b"), (7, "again", "b")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, rate int").repartition(5)
    mixed = poisson_mixing.replicate(docs, spark.createDataFrame(list(rates.items()), "source string, rate double"))
    got = Counter((r.doc_id, r.text, r.source) for r in mixed.collect())
    assert got == Counter({r: draw(r[0], rates[r[2]]) for r in rows if r[2] in rates and draw(r[0], rates[r[2]])})
    placed = poisson_mixing.positions(mixed).collect()
    assert sorted(r.position for r in placed) == list(range(len(placed)))
    assert [(r._key, r.doc_id or -1, r._copy) for r in sorted(placed, key=lambda r: r.position)] == sorted((r._key, r.doc_id or -1, r._copy) for r in placed)


def test_high_rates_keep_mean_and_variance(spark):
    rates = {"a": 699.0, "b": 800.0, "c": 5000.0}
    docs = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(900)], "doc_id long, source string")
    mixed = poisson_mixing.replicate(docs, spark.createDataFrame(list(rates.items()), "source string, rate double"))
    counts = mixed.groupBy("source", "doc_id").count().collect()
    for source, rate in rates.items():
        got = np.array([r["count"] for r in counts if r.source == source])
        assert len(got) == 300
        assert abs(got.mean() - rate) < 4 * math.sqrt(rate / 300)
        assert abs(got.var() / rate - 1) < 0.33


def test_mix_reaches_the_target_shares(spark):
    rows = [(i, "x" * 100, "big" if i % 4 else "small") for i in range(20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = poisson_mixing.mix(docs)
    assert mixed.columns == docs.columns
    share = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    want = math.sqrt(3) / (1 + math.sqrt(3))
    assert abs(share["big"] / sum(share.values()) - want) < 0.02 and abs(sum(share.values()) - 20000) < 600
    assert poisson_mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def brute_capacity(sizes, shards):
    """The least capacity for which greedy filling needs no more shards; larger groups stand alone."""

    def needed(capacity):
        count, used = 0, None
        for size in sizes:
            if used is None or used + size > capacity:
                count, used = count + 1, 0
            used += size
        return count

    low, high = 0, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needed(middle) <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("seed,shards,bits", [(1, 24, 3), (2, 5, 2), (3, 24, 12), (4, 7, 1)])
def test_shards_equal_the_search_over_all_groups(spark, monkeypatch, seed, shards, bits):
    monkeypatch.setattr(sharding, "FIRST_BITS", bits)
    monkeypatch.setattr(sharding, "STEP_BITS", 2)
    rng = random.Random(seed)
    rows = [(i, "y" * rng.choice([0, 3, 50, 400, 3000])) for i in range(300)] + [(1000 + i, "hot" * 30) for i in range(150 * (seed % 2))]
    rows = [(i, t + str(i % 200) if t and t[0] == "y" else t) for i, t in rows] + [(2000, None), (2001, None), (2002, ""), (None, "z"), (3, "z"), (3, "z")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, slot int").repartition(4)
    got = sharding.shard_documents(docs, shards).collect()
    assert len(got) == len(rows)
    text = defaultdict(set)
    sizes = Counter()
    for i, t in rows:
        key = hashlib.md5(t.encode()).hexdigest() if t is not None else ""
        sizes[key] += len((t or "").encode()) + 8
        text[i].add(key)
    order = [sizes[k] for k in sorted(sizes)]
    capacity = brute_capacity(order, shards)
    total, slots = Counter(), defaultdict(list)
    for r in got:
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(total) < shards
    assert max(total.values()) == max(max(order), max(v for v in total.values())) and max(v for v in total.values()) <= max(capacity, max(order))
    place = {}
    for r in got:
        for key in text[r.doc_id] if len(text[r.doc_id]) == 1 else ():
            assert place.setdefault(key, r.shard) == r.shard
    assert [s for _, s in sorted(place.items())] == sorted(place.values())  # contiguous in hash order
    assert sharding.shard_documents(docs.limit(0), shards).count() == 0
