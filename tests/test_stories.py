"""Story matching against a step-by-step model of the assignment."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressline.operators import similarity, stories

AS_OF = datetime(2024, 1, 31)
START_DAY = datetime(2024, 1, 1)
ARTICLE = "article_id bigint, embedding array<double>, published_at timestamp, scraped_at timestamp, importance_score int, entity_set array<string>"
STORY = "id bigint, centroid array<double>, entity_set array<string>, last_seen_at timestamp, importance_score int, status string"


def now():
    return F.lit(AS_OF).cast("timestamp")


def at_cosine(c):
    return [c, math.sqrt(1 - c * c)]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def brute_match(article, existing, as_of):
    """The first strong story in story order, else the best combined score."""
    best, best_score = None, 0.0
    window = as_of - timedelta(days=14)
    for s in sorted(existing, key=lambda s: (s["last"], s["importance"], -s["id"]), reverse=True):
        if s["last"] < window:
            continue
        cos = float(np.dot(article["v"], s["v"]) / (np.linalg.norm(article["v"]) * np.linalg.norm(s["v"])))
        if cos < 0.52:
            continue
        if article["date"] is not None:
            if abs((article["date"] - s["last"]).days) > 14:
                continue
        elif cos < 0.86:
            continue
        if cos >= 0.86:
            return s["id"], True, cos
        ent = jaccard(article["names"], s["names"])
        if ent < 0.04:
            continue
        score = 0.7 * cos + 0.3 * ent
        if score > best_score:
            best, best_score = s["id"], score
    return best, False, best_score


def test_match_active_equals_the_step_by_step_model(spark):
    rng = random.Random(5)
    draw = lambda: [rng.gauss(0, 1) for _ in range(4)]
    names = lambda: {f"person:n{rng.randint(0, 12)}" for _ in range(rng.randint(0, 4))}
    arts = [
        {"id": i, "v": draw(), "names": names(), "date": None if i % 17 == 0 else AS_OF - timedelta(hours=rng.randint(-48, 900))} for i in range(150)
    ]
    known = [
        {"id": 1000 + i, "v": draw(), "names": names(), "last": AS_OF - timedelta(hours=rng.randint(0, 500)), "importance": rng.randint(0, 3)} for i in range(60)
    ]
    a = spark.createDataFrame([(x["id"], x["v"], x["date"], None, 1, sorted(x["names"])) for x in arts], ARTICLE)
    s = spark.createDataFrame([(x["id"], x["v"], sorted(x["names"]), x["last"], x["importance"], "active") for x in known], STORY)
    found = {r.article_id: r for r in stories.match_active(a, s, now(), rows=16).collect()}
    strong = 0
    for x in arts:
        story, is_strong, score = brute_match(x, known, AS_OF)
        if story is None:
            assert x["id"] not in found
            continue
        row = found[x["id"]]
        assert (row.story_id, row.strong) == (story, is_strong) and abs(row.score - score) < 1e-9
        assert row.attached == (is_strong or score >= 0.66)
        strong += is_strong
    assert strong > 10 and len(found) > strong


def test_day_gate_floors_before_the_absolute_value(spark):
    seen = AS_OF - timedelta(days=1)
    dates = [seen - timedelta(days=14), seen - timedelta(days=14, hours=1), seen + timedelta(days=14, hours=23), seen + timedelta(days=15), None]
    a = spark.createDataFrame([(i, [1.0, 0.0], d, None, 1, []) for i, d in enumerate(dates)], ARTICLE)
    s = spark.createDataFrame([(9, [1.0, 0.0], [], seen, 1, "active")], STORY)
    assert {r.article_id for r in stories.match_active(a, s, now()).collect()} == {0, 2, 4}


def test_thresholds(spark):
    cases = [(1, 0.87, []), (2, 0.85, []), (3, 0.85, ["person:x"]), (4, 0.53, ["person:x"]), (5, 0.51, ["person:x"]), (6, 0.53, ["person:x", "person:y", "person:z"])]
    a = spark.createDataFrame([(i, at_cosine(c), AS_OF, None, 1, n) for i, c, n in cases], ARTICLE)
    s = spark.createDataFrame([(9, [1.0, 0.0], ["person:x"], AS_OF, 1, "active")], STORY)
    found = {r.article_id: r.attached for r in stories.match_active(a, s, now()).collect()}
    assert found == {1: True, 3: True, 4: True, 6: False}


def test_revival(spark):
    old, ancient = AS_OF - timedelta(days=20), AS_OF - timedelta(days=400)
    s = spark.createDataFrame(
        [(1, [1.0, 0.0], ["person:x"], old, 1, "dormant"), (2, at_cosine(0.9), ["person:x"], old, 1, "active"), (3, [1.0, 0.0], ["person:x"], ancient, 1, "active")], STORY
    )
    a = spark.createDataFrame(
        [(10, [1.0, 0.0], AS_OF, None, 1, ["person:x"]), (11, [1.0, 0.0], AS_OF, None, 1, []), (12, [0.0, -1.0], AS_OF, None, 1, ["person:x"])], ARTICLE
    )
    table = spark.createDataFrame([(11, 2, "related_story"), (10, 2, "same_story")], "article_id bigint, story_id bigint, verdict string")
    found = {r.article_id: (r.story_id, r.action) for r in stories.match_revival(a, s, stories.verdicts_from(table), now()).collect()}
    assert found == {10: (1, "attach"), 11: (2, "related")}


def test_one_article_per_batch_equals_the_step_by_step_assignment(spark):
    rng = random.Random(21)
    centers = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(3)]
    arts = []
    for i in range(9):
        c = centers[i % 3]
        arts.append({"id": i, "v": [x + rng.gauss(0, 0.25) for x in c], "names": {f"person:p{i % 3}"}, "date": AS_OF - timedelta(hours=100 - 10 * i)})
    known, links, got, linked = [], {}, {}, {}
    for x in arts:
        story, strong, score = brute_match(x, known, AS_OF)
        if story is None or not (strong or score >= 0.66):
            story = max([s["id"] for s in known], default=-1) + 1
            known.append({"id": story, "v": x["v"], "names": set(x["names"]), "last": x["date"], "importance": 1})
            links[story] = [x]
        else:
            links[story].append(x)
            s = known[story]
            s["v"] = list(np.mean([m["v"] for m in links[story]], axis=0))
            s["last"], s["names"] = max(s["last"], x["date"]), s["names"] | x["names"]
        linked[x["id"]] = story
    members = {}
    for x in arts:
        rows = [
            (sid, [float(v) for v in np.mean([m["v"] for m in ms], axis=0)], sorted(set().union(*[m["names"] for m in ms])), max(m["date"] for m in ms), 1, "active")
            for sid, ms in members.items()
        ]
        s = spark.createDataFrame(rows, STORY)
        a = spark.createDataFrame([(x["id"], x["v"], x["date"], None, 1, sorted(x["names"]))], ARTICLE)
        row = stories.assign_batch(a, s, lambda c: c.withColumn("verdict", F.lit(None).cast("string")), now()).first()
        members.setdefault(row.story_id, []).append(x)
        got[x["id"]] = row.story_id
    same = lambda labels: {frozenset(i for i in labels if labels[i] == s) for s in labels.values()}
    assert same(got) == same(linked)


def test_groups_do_not_depend_on_the_block_size(spark):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        copied = [1.0, 0.5, 0.0] if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(3)]
        rows.append((i, copied, AS_OF - timedelta(hours=rng.randint(0, 700)), None, 1, [f"person:{rng.randint(0, 5)}"]))
    df = spark.createDataFrame(rows, ARTICLE)
    label = lambda n: {r.article_id: r.group_id for r in stories.same_event_groups(df, now(), rows=n).collect()}
    whole = label(4096)

    parent = list(range(120))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(120):
        for j in range(i):
            a, b = rows[i], rows[j]
            days = math.floor(abs((a[2] - b[2]).total_seconds()) / 86400)
            cos = float(np.dot(a[1], b[1]) / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])))
            ent = jaccard(set(a[5]), set(b[5]))
            if days <= 14 and (cos >= 0.86 or (cos >= 0.52 and ent >= 0.04 and 0.7 * cos + 0.3 * ent >= 0.66)):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert whole == {i: find(i) for i in range(120)}
    assert label(13) == whole


def test_links_inside_a_label_are_not_compared_again(spark, monkeypatch):
    """Many articles: what a few connect is left out of later comparisons, with the groups of all pairs."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        vector = [1.0, rng.gauss(0, 0.4), rng.gauss(0, 0.4)] if i % 4 else [rng.gauss(0, 1) for _ in range(3)]
        rows.append((i, vector, AS_OF - timedelta(hours=rng.randint(0, 1500)), None, 1, [f"person:{rng.randint(0, 5)}"]))
    df = spark.createDataFrame(rows, ARTICLE)
    groups = lambda: {r.article_id: r.group_id for r in stories.same_event_groups(df, now()).collect()}
    whole = groups()
    compared, real = [], similarity.compare_blocks

    def counted(left, right, *more):
        compared.append((left.count(), right.count()))
        return real(left, right, *more)

    monkeypatch.setattr(similarity, "compare_blocks", counted)
    monkeypatch.setattr(stories, "SEED_ARTICLES", 16)
    monkeypatch.setattr(stories, "SEED_GROWTH", 5)
    assert groups() == whole and 1 < len(set(whole.values())) < 100
    (first, few), (second, more), (last, every) = compared
    assert first == 400 and few < 90 and few < more < every and last < second < 200, compared


def test_two_older_stories_are_found_in_order():
    """The two most similar stories, the first in story order where cosines are equal."""
    import pandas as pd

    stored = pd.DataFrame({"story_id": [1, 2, 3, 4], "centroid": [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [float("nan"), 1.0]], "entity_set": [[]] * 4, "last_seen": [5, 9, 7, 9], "importance": [1] * 4})
    new = pd.DataFrame({"article_id": [8, 9], "embedding": [[1.0, 0.0], [1.0, 1.0]], "entity_set": [[], []]})
    found = stories._revival_block(new, stored)
    assert list(zip(found["article_id"], found["story_id"])) == [(8, 3), (8, 1), (9, 2), (9, 3)]


def test_forest_connects_what_is_linked():
    linked = np.zeros((3, 3), dtype=bool)
    linked[0, 0] = linked[1, 0] = linked[1, 2] = True
    edges = similarity.forest(linked, np.array([1, 2, 3]), np.array([7, 8, 9]))
    assert {frozenset(e) for e in edges.itertuples(index=False)} == {frozenset({2, 1}), frozenset({7, 1}), frozenset({9, 1})}


def test_rebuild_equals_a_story_by_story_model(spark):
    """One article a day: each pass is one article, as in the step-by-step model; undated ones come last."""
    rng = random.Random(11)
    start = AS_OF - timedelta(days=40)
    arts = []
    for i in range(0, 24, 3):
        angle = rng.choice([0.0, 0.25, 1.2]) + rng.uniform(-0.05, 0.05)
        names = {rng.choice(["person:a", "person:b", "org:c"])}
        arts.append({"id": i, "v": [math.cos(angle), math.sin(angle)], "names": names, "date": None if i in (6, 15) else start + timedelta(days=i), "scraped": start + timedelta(days=i, hours=2)})
    existing, want = {}, {}
    for a in sorted(arts, key=lambda a: (a["date"] is None, a["date"] or a["scraped"])):
        day = a["date"] or a["scraped"]
        end = datetime(day.year, day.month, day.day) + timedelta(days=1) if a["date"] else AS_OF
        rows = [{"id": k, "v": np.mean(s["v"], axis=0), "last": s["last"], "importance": 5, "names": s["names"]} for k, s in existing.items()]
        story, strong, score = brute_match(a, rows, min(end, AS_OF))
        if not strong and score < 0.66:
            story = None
        if story is None:
            older = [r for r in rows if r["last"] < min(end, AS_OF) - timedelta(days=14)]
            cosine = lambda r: np.dot(a["v"], r["v"]) / np.linalg.norm(r["v"])
            best = max(older, key=cosine, default=None)
            story = best["id"] if best and cosine(best) >= 0.80 and jaccard(a["names"], best["names"]) >= 0.10 else None
        if story is None:
            story = a["id"]
            existing[story] = {"v": [], "last": day, "names": set()}
        s = existing[story]
        s["v"].append(a["v"])
        s["last"] = max(s["last"], day)
        s["names"] |= a["names"]
        want[a["id"]] = story
    articles = spark.createDataFrame([(a["id"], a["date"], a["scraped"]) for a in arts], "id bigint, published_at timestamp, scraped_at timestamp")
    by = lambda kind, a: [n.split(":")[1] for n in a["names"] if n.startswith(kind)]
    notes = spark.createDataFrame(
        [(a["id"], "completed", 5, ["politics"], by("person", a), by("org", a), [], a["scraped"]) for a in arts],
        "article_id bigint, status string, importance_score int, themes array<string>, entities_people array<string>, entities_organizations array<string>, entities_locations array<string>, analyzed_at timestamp",
    )
    vectors = spark.createDataFrame([(a["id"], a["v"]) for a in arts], "article_id bigint, embedding array<double>")
    never = stories.verdicts_by(lambda article, story: F.lit("different"))
    done = {r.article_id: r.story_id for r in stories.rebuild_all(articles, notes, vectors, never, now()).collect()}
    groups = lambda labels: sorted(sorted(k for k, v in labels.items() if v == label) for label in set(labels.values()))
    assert len(done) == len(arts) and groups(done) == groups(want), (groups(done), groups(want))


def test_undated_members_come_last_and_are_the_latest(spark):
    links = spark.createDataFrame([(1, i) for i in (10, 11, 12)], "story_id bigint, article_id bigint")
    articles = spark.createDataFrame([(10, "t", "u", AS_OF, AS_OF, 1), (11, "t", "u", None, AS_OF, 1), (12, "t", "u", AS_OF - timedelta(days=1), AS_OF, 1)], "id bigint, title string, url string, published_at timestamp, scraped_at timestamp, source_id int")
    notes = spark.createDataFrame([(i, "completed", None, None, None) for i in (10, 11, 12)], "article_id bigint, status string, summary string, key_facts array<string>, importance_score int")
    story = spark.createDataFrame([(1, "s", AS_OF, "x")], "id bigint, title string, last_seen_at timestamp, short_summary string")
    outlet = spark.createDataFrame([(1, "src")], "id int, name string")
    none = spark.createDataFrame([], "from_story_id bigint, to_story_id bigint")
    row = stories.synthesis_payload(story, links, articles, notes, outlet, none).first()
    import json

    assert [e["article_id"] for e in json.loads(row.articles_json)] == [12, 10, 11]
    many = spark.range(1000).selectExpr("1L AS story_id", "id AS article_id")
    facts = spark.range(1000).selectExpr("id", "cast(null AS string) AS title", "'' AS url", "cast(null AS timestamp) AS published_at", "timestamp'2024-01-01' AS scraped_at", "1 AS source_id")
    bare = spark.range(1000).selectExpr("id AS article_id", "'completed' AS status", "cast(null AS string) AS summary", "cast(null AS array<string>) AS key_facts", "cast(null AS int) AS importance_score")
    whole = stories.synthesis_payload(story, many, facts, bare, outlet, none).first().articles_json
    cut = stories.synthesis_payload(story, many, facts, bare, outlet, none, text_limit=24000).first().articles_json
    assert len(json.loads(whole)) == 1000 and cut == whole[:24000]


def test_a_broken_rebuild_goes_on_after_the_last_finished_pass(spark, tmp_path, monkeypatch):
    rng = np.random.RandomState(2)
    rows = [(k, START_DAY + timedelta(days=k // 4), rng.normal(size=4).tolist()) for k in range(20)]
    articles = spark.createDataFrame([(k, t, t) for k, t, _ in rows], "id bigint, published_at timestamp, scraped_at timestamp")
    people = "array<string>"
    notes = spark.createDataFrame(
        [(k, "completed", 5, ["a"], [], [], []) for k, _, _ in rows],
        f"article_id bigint, status string, importance_score int, entities_people {people}, entities_organizations {people}, entities_locations {people}, themes {people}",
    )
    vectors = spark.createDataFrame([(k, v) for k, _, v in rows], "article_id bigint, embedding array<double>")
    judge = stories.verdicts_by(lambda a, b: F.lit("unrelated"))
    as_of = F.lit(START_DAY + timedelta(days=30))
    done, real = [], stories.assign_batch

    def fails_in_the_third(*args):
        done.append(1)
        if len(done) == 3:
            raise RuntimeError("lost")
        return real(*args)

    run = lambda **more: sorted(tuple(r) for r in stories.rebuild_all(articles, notes, vectors, judge, as_of, **more).collect())
    monkeypatch.setattr(stories, "assign_batch", fails_in_the_third)
    folder = str(tmp_path / "rebuild")
    with pytest.raises(RuntimeError):
        run(folder=folder)
    assert len(run(folder=folder)) == 20 and len(done) == 6  # two passes, the broken one, and three more
    again = run(folder=folder)
    assert len(done) == 6
    monkeypatch.setattr(stories, "assign_batch", real)
    assert again == run()
    with pytest.raises(ValueError):
        run(folder=folder, batch_days=2)


def clustered(n, seed, zero=3, noise=0.25):
    rng = np.random.RandomState(seed)
    centres = np.random.RandomState(0).normal(size=(9, 24))
    rows = centres[np.arange(n) % 9] * rng.uniform(0.5, 2, (n, 1)) + rng.normal(0, noise, (n, 24))
    rows[:zero] = 0
    return rows


def test_pruned_similarity_join_equals_the_block_product(spark, monkeypatch):
    sim = similarity

    monkeypatch.setattr(sim, "PIVOT_SAMPLE", 200)
    monkeypatch.setattr(sim, "WORTH_BLOCKS", 2)
    base = datetime(2024, 1, 1)
    left = [(k, v.tolist(), base + timedelta(hours=5 * (k % 300))) for k, v in enumerate(clustered(700, 1))]
    right = [(k, v.tolist(), base + timedelta(hours=7 * (k % 200))) for k, v in enumerate(clustered(400, 2))]
    articles = spark.createDataFrame(left, "article_id bigint, embedding array<double>, published_at timestamp").repartition(4)
    events = spark.createDataFrame(right, "id bigint, centroid array<double>, last_seen_at timestamp").repartition(3)
    pairs = lambda df: sorted((r.article_id, r.story_id, r.days, round(r.cosine, 9)) for r in df.collect())
    for floor in (0.52, 0.9):
        got = pairs(stories.interval_similarity_join(articles, events, floor, rows=40))
        a, b = clustered(700, 1), clustered(400, 2)
        unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
        cosine = unit(a) @ unit(b).T
        want = []
        for i, j in zip(*np.nonzero(cosine >= floor)):
            days = (left[i][2] - right[j][2]) // timedelta(days=1)
            if abs(days) <= 14:
                want.append((int(i), int(j), days, round(float(cosine[i, j]), 9)))
        assert got == sorted(want) and got
    best = pairs(stories.interval_similarity_join(articles, events, 0.9, rows=40, top=2).drop("rank"))
    order = {}
    for row in sorted(got, key=lambda r: (r[0], -r[3], r[1])):
        order.setdefault(row[0], []).append(row)
    assert best == sorted(r for rows in order.values() for r in rows[:2])


def test_most_block_pairs_of_clustered_vectors_are_skipped(spark, monkeypatch):
    sim = similarity

    rows = clustered(2000, 5, noise=0.1)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "id bigint, v array<double>").repartition(4)
    pivots = sim.choose_pivots(sim.unit_rows(df.limit(300).toPandas()["v"])[4:], 16)
    a, b = sim.with_blocks(df, "id", "v", pivots, 50), sim.with_blocks(df, "id", "v", pivots, 50)
    blocks = a.select("block").distinct().count()
    kept = sim.block_pairs(a, b, len(pivots), 0.8).count()
    print('SKIPPED', 1 - kept / blocks**2)
    assert blocks > 30 and kept < 0.35 * blocks * blocks
    sizes = a.groupBy("block").count().agg({"count": "max"}).first()[0]
    assert sizes <= 100
