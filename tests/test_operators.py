"""Operators on small fixtures: traps, ties, hot keys and properties."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from pressline.operators import annotations, audience, entities, feeds, graph, identity, joins, ranking, search, trends, video
from pressline.session import cut_lineage

AS_OF = datetime(2024, 1, 31)


def now():
    return F.lit(AS_OF).cast("timestamp")


# --- ranking ---------------------------------------------------------------------------


def hot_rows(spark, n=3000):
    """A third of all rows share one key."""
    rng = random.Random(7)
    rows = [(i, 0 if i % 3 == 0 else rng.randint(1, 50), AS_OF - timedelta(minutes=rng.randint(0, 200000))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, k int, ts timestamp")


def test_rank_all_numbers_a_hot_key(spark):
    rows, df = hot_rows(spark)
    ranked = ranking.rank_all(df.withColumn("day", F.to_date("ts")), ["k"], [("day", True)], [F.desc("ts"), F.desc("id")])
    found = {(r.k, r["rank"]): r.id for r in ranked.collect()}
    for key in {k for _, k, _ in rows}:
        expected = [i for i, k, t in sorted(rows, key=lambda r: (r[2], r[0]), reverse=True) if k == key]
        assert [found[key, n + 1] for n in range(len(expected))] == expected


def brute_sessions(times, gap, break_at_gap):
    runs = []
    for t in sorted(times):
        near = runs and ((t - runs[-1][-1] < gap) if break_at_gap else (t - runs[-1][-1] <= gap))
        if near:
            runs[-1].append(t)
        else:
            runs.append([t])
    return [(len(r), r[0], r[-1]) for r in runs]


@pytest.mark.parametrize("break_at_gap", [False, True])
def test_gap_sessions_of_a_hot_key(spark, break_at_gap):
    rows, df = hot_rows(spark)
    exact = [(10**6 + i, 99, AS_OF + timedelta(hours=6 * i)) for i in range(5)]
    df = df.unionByName(spark.createDataFrame(exact, df.schema))
    gap = timedelta(hours=6)
    found = {}
    for r in ranking.session_summary(df, ["k"], "ts", 6 * 3600, break_at_gap).orderBy("k", "session_no").collect():
        found.setdefault(r.k, []).append((r.n_rows, r.first_at, r.last_at))
    for key in {k for _, k, _ in rows + exact}:
        assert found[key] == brute_sessions([t for _, k, t in rows + exact if k == key], gap, break_at_gap)


def test_queue_position_counts_higher_levels_queued_earlier(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(ranking.QUEUE_PRIORITIES), "queued", AS_OF + timedelta(minutes=rng.randint(-3000, 3000))) for i in range(200)]
    # A third of the queue inside one second.
    rows += [(1000 + i, rng.choice(ranking.QUEUE_PRIORITIES), "queued", AS_OF + timedelta(microseconds=rng.randint(0, 40) * 20_011)) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, priority string, status string, queued_at timestamp")
    level = ranking.QUEUE_PRIORITIES.index
    for r in ranking.queue_position(df).collect():
        assert r.position == 1 + sum(level(p) >= level(r.priority) and t < r.queued_at for _, p, _, t in rows)


def test_page_past_the_end(spark):
    df = spark.range(45).withColumn("scraped_at", now())
    rows = ranking.page(df, [F.asc("id")], 3, 20).collect()
    assert [r.id for r in rows] == list(range(40, 45)) and not rows[0].has_next and rows[0].total_pages == 3


# --- graph and threads -----------------------------------------------------------------


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 400)] + [(1000, 1000 + i) for i in range(1, 500)] + [(5000, 5001)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    found = {r.id: r.component for r in graph.connected_components(df).collect()}
    assert all(found[i] == 1 for i in range(1, 401)) and all(found[1000 + i] == 1000 for i in range(500)) and found[5001] == 5000


def test_thread_tree_hides_replies_of_hidden_comments(spark):
    rows = [(1, 9, None, True), (2, 9, 1, True), (3, 9, 2, False), (4, 9, 3, True), (5, 9, 2, True), (6, 9, 77, True)]
    df = spark.createDataFrame(rows, "id bigint, article_id bigint, parent_id bigint, is_approved boolean")
    found = {r.id: (r.root_id, r.depth, r.path) for r in joins.thread_tree(df).collect()}
    assert found == {1: (1, 0, [1]), 2: (1, 1, [1, 2]), 5: (1, 2, [1, 2, 5])}


def test_thread_cycle_is_an_error(spark):
    df = spark.createDataFrame([(1, 9, 2, True), (2, 9, 1, True)], "id bigint, article_id bigint, parent_id bigint, is_approved boolean")
    with pytest.raises(Exception, match="cycle"):
        joins.thread_tree(df).collect()


# --- identity --------------------------------------------------------------------------


def articles(spark, rows):
    columns = "id bigint, external_id string, source_id int, url string, canonical_url string, content_hash string, normalized_title_hash string, has_full_content boolean, word_count int, scraped_at timestamp"
    return spark.createDataFrame(rows, columns)


def test_titles_exactly_thirty_days_apart_are_one_run(spark):
    at = lambda days, seconds=0: AS_OF + timedelta(days=days, seconds=seconds)
    rows = [(1, "a", 1, "u1", "c1", "", "t", True, 10, at(0)), (2, "b", 1, "u2", "c2", "", "t", True, 20, at(30)),
            (3, "c", 1, "u3", "c3", "", "t", True, 5, at(60, 1)), (4, "d", 2, "u4", "c4", "", "t", True, 5, at(1))]
    assert [(r.id, r.keeper_id) for r in identity.title_dups(articles(spark, rows)).collect()] == [(1, 2)]


def test_keeper_ties(spark):
    rows = [(3, "x", 1, "u", "c", "", "", True, 10, AS_OF), (1, "x", 1, "v", "d", "", "", False, 99, AS_OF),
            (2, "x", 1, "w", "e", "", "", True, 10, AS_OF)]
    found = identity.dup_groups(articles(spark, rows), ["external_id", "source_id"], "r").collect()
    assert sorted((r.id, r.keeper_id) for r in found) == [(1, 2), (3, 2)]


def test_dedupe_keeps_one_of_a_hot_group_and_is_idempotent(spark):
    rows = [(i, "same" if i % 3 == 0 else f"e{i}", 1, f"u{i}", f"c{i}", "", "", True, i, AS_OF) for i in range(900)]
    df = articles(spark, rows)
    kept = identity.apply_dedupe(df, identity.dedupe_plan(df))
    assert kept.count() == 601 and kept.filter("external_id = 'same'").first().id == 897
    assert identity.dedupe_plan(kept).count() == 0


def test_transitive_plan_closes_over_rules(spark):
    rows = [(1, "a", 1, "u1", "same", "", "", True, 30, AS_OF), (2, "b", 1, "u2", "same", "", "", True, 20, AS_OF),
            (3, "b", 1, "u3", "other", "", "", True, 25, AS_OF)]
    df = articles(spark, rows)
    assert {r.id for r in identity.dedupe_plan(df).collect()} == {2}
    assert {r.id for r in identity.dedupe_plan(df, transitive=True).collect()} == {2, 3}


def test_match_existing_takes_the_first_key(spark):
    stored = articles(spark, [
        (1, "e", 1, "u1", "c1", "h", "t", True, 1, AS_OF - timedelta(days=40)), (2, "f", 1, "u2", "c2", "h", "t", True, 1, AS_OF - timedelta(days=31)),
        (3, "g", 2, "u3", "c3", "k", "t", True, 1, AS_OF),
    ])
    new = articles(spark, [
        (10, "e", 1, "u3", "c3", "", "", True, 1, AS_OF), (11, "x", 9, "x", "c2", "h", "", True, 1, AS_OF), (12, "x", 9, "x", "x", "h", "", True, 1, AS_OF),
        (13, "x", 1, "x", "x", "", "t", True, 1, AS_OF), (14, "x", 2, "x", "x", "", "t", True, 1, AS_OF),
    ])
    found = {r.new_id: (r.existing_id, r.priority) for r in identity.match_existing(new, stored, now()).collect()}
    assert found == {10: (1, 1), 11: (2, 2), 12: (2, 4), 14: (3, 5)}


# --- feeds -----------------------------------------------------------------------------


def test_read_next_scores_and_hot_category(spark):
    rng = random.Random(11)
    rows = [
        (i, 0 if i % 3 == 0 else rng.randint(1, 12), rng.randint(0, 5), [f"t{rng.randint(0, 8)}", f"t{rng.randint(0, 8)}"], rng.random() < 0.2, rng.randint(1, 10),
         rng.random() < 0.5, AS_OF - timedelta(minutes=rng.randint(0, 9000)))
        for i in range(150)
    ]
    df = cut_lineage(spark.createDataFrame(
        rows, "id bigint, category_id int, source_id int, tags array<string>, is_breaking_candidate boolean, importance_score int, follow_up_worthy boolean, scraped_at timestamp"))
    found = {}
    for r in feeds.read_next_for_articles(df, df, 4).collect():
        found.setdefault(r.seed_id, {})[r["rank"]] = (r.id, r.read_next_score)

    def score(seed, other):
        return 40 if seed[1] == other[1] else 20 if seed[2] == other[2] else 30 if set(seed[3]) & set(other[3]) else 0

    for seed in rows:
        best = sorted((r for r in rows if r[0] != seed[0]), key=lambda r: (score(seed, r), r[4], r[5], r[6], r[7], r[0]), reverse=True)[:4]
        assert [found[seed[0]][n + 1] for n in range(4)] == [(r[0], score(seed, r)) for r in best]


def test_nulls_come_first_in_intelligence_order(spark):
    df = spark.createDataFrame([(1, True, 5, True, AS_OF), (2, True, None, True, AS_OF)], "id bigint, is_breaking_candidate boolean, importance_score int, follow_up_worthy boolean, scraped_at timestamp")
    assert [r.id for r in df.orderBy(*ranking.intelligence_order()).collect()] == [2, 1]


def test_calendar_adds_up(spark):
    rows = [(1, "a", "person", datetime(2024, 1, 3).date()), (1, "a", "person", datetime(2024, 1, 3).date()), (2, "a", "person", datetime(2024, 1, 9).date())]
    df = spark.createDataFrame(rows, "article_id bigint, normalized_name string, entity_type string, mention_date date")
    days = trends.mention_calendar(df, F.lit("2024-01-01").cast("date")).collect()
    assert len(days) == 31 and sum(d.mention_count for d in days) == days[0].total_mentions == 3
    assert days[0].total_articles == 2 and {d.day: d.level for d in days if d.level} == {3: 4, 9: 2}


# --- entities, search, annotations -----------------------------------------------------


def test_new_names_that_are_aliases_become_one_entity(spark):
    mentions = spark.createDataFrame(
        [("Bank of Nowhere", "organization"), ("Nowhere Bank", "organization"), ("The Nowhere Bank Ltd", "organization"), ("Old Name", "person")],
        "entity_name string, entity_type string",
    )
    stored = spark.createDataFrame([(7, "Old Name", "old name", "person", ["old name"])], "id bigint, name string, normalized_name string, entity_type string, aliases array<string>")
    made = entities.create_entities(mentions, stored).collect()
    assert [(r.normalized_name, len(r.aliases)) for r in made] == [("bank of nowhere", 5)]


def test_query_language():
    assert search.parse_query('a "b c" or d -e') == [
        {"terms": ["a", "b", "c"], "phrases": ["b c"], "excluded": []}, {"terms": ["d"], "phrases": [], "excluded": ["e"]},
    ]
    assert search.search_terms("it's an old-time query") == ["old", "time", "query"]


JSON_VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-1000, 1000) | st.text("ab `\n\\\"{}", max_size=6),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text("xyz", min_size=1, max_size=3), inner, max_size=3), max_leaves=8,
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.dictionaries(st.text("key", min_size=1, max_size=3), JSON_VALUES, max_size=3), st.sampled_from(["", "```", "```json"]), st.integers(0, 3), st.integers(0, 12)), min_size=20, max_size=40))
def test_wrapped_json_is_read_back_and_cut_json_is_not(spark, cases):
    """Any object inside a fence and padding is found; the same text without its end is an error."""
    rows, want = [], []
    for value, fence, padding, cut in cases:
        body = json.dumps(value)
        whole = f"{fence}\n{body}\n```" if fence else body
        rows.append((len(rows), "\n " * padding + whole + " \n" * padding))
        want.append(value)
        rows.append((len(rows), body[: max(0, len(body) - 1 - cut)]))
        want.append(None)
    parsed = annotations.parse_model_json(spark.createDataFrame(rows, "id int, raw string"))
    for row in parsed.selectExpr("id", "to_json(data) AS data", "error").collect():
        assert (row.error is None) == (want[row.id] is not None), rows[row.id]
        if want[row.id] is not None:
            assert json.loads(row.data) == want[row.id]


def validated(spark, raw):
    rows = spark.createDataFrame([(5, "u", "t", "s", raw)], "article_id bigint, url string, title string, source_name string, raw string")
    return annotations.validate_analysis(annotations.parse_model_json(rows)).first()


def test_analysis_cuts_lists_before_filtering(spark):
    row = validated(spark, '{"summary":"s","sentiment":"happy","importance_score":99,"themes":["x","health","crime","y","sports"],"key_facts":["a"," ","b","c","d","e","f"],"entities":{"people":[" A "]}}')
    assert (row.error, row.sentiment, row.importance_score) == (None, "neutral", 10)
    assert (row.themes, row.key_facts, row.entities_people, row.entities_locations) == (["health", "crime"], ["a", "b", "c", "d", "e"], ["A"], [])
    assert [c.article_id for c in row.citations] == [5]


@pytest.mark.parametrize(("raw", "error"), [("{}", "missing required key: summary"), ('{"summary":"s","sentiment":"x","importance_score":"5","themes":[],"key_facts":[],"entities":{}}', "key 'importance_score' must be int")])
def test_analysis_errors(spark, raw, error):
    assert validated(spark, raw).error == error


# --- audiences and videos --------------------------------------------------------------


def test_exclusions_keep_unknown_dates(spark):
    rows = [(1, True, True, None, None, None), (2, True, True, "evening", AS_OF.date(), "evening"), (3, True, True, "evening", AS_OF.date(), None)]
    df = spark.createDataFrame(rows, "id int, is_active boolean, confirmed boolean, frequency string, last_digest_date date, last_slot_sent string")
    assert [r.id for r in audience.digest_audience(df, F.lit(AS_OF.date())).collect()] == [1]
    assert [r.id for r in audience.flash_audience(df, F.lit(AS_OF.date()), "evening").collect()] == [3]


def test_breaking_audience_never_meets_recent_history(spark):
    items = spark.createDataFrame([(1, 100, False, [2], [], ), (2, 101, False, [], []), (3, 102, True, [], [])], "id bigint, article_id bigint, is_sent boolean, target_categories array<int>, target_sources array<int>")
    tokens = spark.createDataFrame([(1, "a", True), (1, "b", True), (2, "c", True), (3, "d", False)], "user_id bigint, token string, is_active boolean")
    profiles = spark.createDataFrame([(1, [2], [])], "user_id bigint, preferred_categories array<int>, followed_sources array<int>")
    history = spark.createDataFrame([(2, 101, AS_OF - timedelta(hours=1))], "user_id bigint, article_id bigint, sent_at timestamp")
    found = audience.breaking_audience(items, tokens, history, profiles, now())
    assert {(r.breaking_id, r.user_id) for r in found.collect()} == {(1, 1), (2, 1)}
    many = spark.range(20000).selectExpr(
        "id + 10 AS id", "id + 1000 AS article_id", "false AS is_sent", "IF(id % 2 = 0, array(2, 3), cast(array() AS array<int>)) AS target_categories",
        "IF(id % 4 < 2, array(7), cast(array() AS array<int>)) AS target_sources",
    )
    fans = spark.createDataFrame([(1, [3, 2], [7]), (2, [], [7])], "user_id bigint, preferred_categories array<int>, followed_sources array<int>")
    reached = audience.breaking_audience(many, tokens, history, fans, now())
    # User 1 fits every item; user 2 those without categories, whatever their outlet.
    assert {(r.user_id, r["count"]) for r in reached.groupBy("user_id").count().collect()} == {(1, 20000), (2, 10000)}
    assert reached.distinct().count() == 30000


def shuffles_above_the_join(df):
    """Exchanges between the result and the join of items and users, in the plan without adaptive changes."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return plan[: plan.index("_salt#")].count("Exchange")


def test_breaking_pairs_are_final_where_they_arise(spark):
    """N10 shuffles no pair, N15 only counts; repeated profiles and items count a user once and each delivery."""
    items = spark.createDataFrame(
        [(1, 100, False, [], []), (2, 101, False, [2], []), (2, 101, False, [], []), (2, 105, False, [], [7]), (3, 102, True, [], []), (4, None, False, [], [])],
        "id bigint, article_id bigint, is_sent boolean, target_categories array<int>, target_sources array<int>",
    )
    tokens = spark.createDataFrame([(1, "a", True), (1, "b", True), (2, "c", True), (3, "d", False), (None, "e", True), (4, "f", True)], "user_id bigint, token string, is_active boolean")
    profiles = spark.createDataFrame([(1, [2], []), (1, [2], [7]), (2, [], [])], "user_id bigint, preferred_categories array<int>, followed_sources array<int>")
    history = spark.createDataFrame(
        [(2, 101, AS_OF), (2, 101, AS_OF), (4, 100, AS_OF - timedelta(hours=30)), (None, 100, AS_OF), (1, None, AS_OF)], "user_id bigint, article_id bigint, sent_at timestamp"
    )
    found = audience.breaking_audience(items, tokens, history, profiles, now())
    rows = {(1, 1): 2, (1, 2): 1, (1, 4): 1, (1, None): 1, (2, 1): 5, (2, 4): 1, (2, None): 1, (4, 1): 2, (4, 2): 1, (4, 4): 1, (4, None): 1}
    assert {(r.breaking_id, r.user_id): r["count"] for r in found.groupBy("breaking_id", "user_id").count().collect()} == rows
    assert shuffles_above_the_join(found) == 0
    stats = audience.breaking_delivery_stats(audience.breaking_audience(items, tokens, history, profiles, now(), counted=True))
    assert {(r.breaking_id, r.total_recipients, r.successful_deliveries) for r in stats.collect()} == {(1, 3, 6), (2, 2, 11), (4, 3, 6)}


def odd_audience(spark, seed):
    """Tables with repeated and null keys, and what N10 gives for them, pair by pair."""
    rng = random.Random(seed)
    some = lambda values, most: None if rng.random() < 0.1 else [rng.choice(values) for _ in range(rng.randint(0, most))]
    items = [(rng.choice([None, 1, 2, 3, 4, 5, 6, 7]), rng.choice([None, 100, 101, 102, 103, 104]), rng.choice([True, False, False, None]), some([1, 2, 3], 2), some([7, 8], 2)) for _ in range(25)]
    tokens = [(rng.choice([None, *range(12)]), str(k), rng.random() < 0.8) for k in range(30)]
    fans = [(rng.choice([None, *range(12)]), some([1, 2, 3], 2), some([7, 8], 1)) for _ in range(20)]
    history = [(rng.choice([None, *range(12)]), rng.choice([None, 100, 101, 102, 103, 104]), AS_OF - timedelta(hours=rng.choice([1, 30]))) for _ in range(40)]
    active = {}
    for user, _, on in tokens:
        if on:
            active[user] = active.get(user, 0) + 1
    recent = {(u, a) for u, a, at in history if at > AS_OF - timedelta(hours=24)}
    pairs = []
    for breaking_id, article_id, sent, categories, outlets in items:
        for user in active if sent is False else ():
            for _, own, sources in [f for f in fans if user is not None and f[0] == user] or [(user, [], [])]:
                fits = all(not wanted or set(wanted) & set(has or []) for wanted, has in ((categories, own), (outlets, sources)))
                if fits and (None in (user, article_id) or (user, article_id) not in recent):
                    pairs.append((breaking_id, article_id, user))
    frames = (
        spark.createDataFrame(items, "id bigint, article_id bigint, is_sent boolean, target_categories array<int>, target_sources array<int>"),
        spark.createDataFrame(tokens, "user_id bigint, token string, is_active boolean"),
        spark.createDataFrame(history, "user_id bigint, article_id bigint, sent_at timestamp"),
        spark.createDataFrame(fans, "user_id bigint, preferred_categories array<int>, followed_sources array<int>"),
    )
    return frames, pairs, active


@pytest.mark.parametrize("seed", [1, 2])
def test_breaking_stats_count_without_pairs(spark, seed):
    frames, pairs, active = odd_audience(spark, seed)
    stats = audience.breaking_delivery_stats(audience.breaking_audience(*frames, now(), counted=True)).collect()
    known = {}
    for breaking_id, _, user in pairs:
        if user is not None:
            known.setdefault(breaking_id, []).append(user)
    assert {r.breaking_id: (r.total_recipients, r.successful_deliveries) for r in stats} == {
        b: (len(set(users)), sum(active[u] for u in users)) for b, users in known.items()
    }
    # A row per item, and one for each item and user of the last day: none for each pair.
    items = spark.range(300).selectExpr("id", "id AS article_id", "false AS is_sent", "array(cast(id % 2 AS int)) AS target_categories", "cast(array() AS array<int>) AS target_sources")
    tokens = spark.range(400).selectExpr("id AS user_id", "'t' AS token", "true AS is_active")
    fans = spark.range(400).selectExpr("id AS user_id", "array(0, 1) AS preferred_categories", "cast(array() AS array<int>) AS followed_sources")
    history = spark.createDataFrame([(5, 7, AS_OF), (6, 7, AS_OF)], "user_id bigint, article_id bigint, sent_at timestamp")
    counts = audience.breaking_audience(items, tokens, history, fans, now(), counted=True)
    assert counts.count() == 302
    totals = {r.breaking_id: r.total_recipients for r in audience.breaking_delivery_stats(counts).collect()}
    assert totals == {b: 398 if b == 7 else 400 for b in range(300)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_breaking_audience_of_odd_rows(spark, seed):
    frames, pairs, _ = odd_audience(spark, seed)
    found = audience.breaking_audience(*frames, now(), salts=2).collect()
    assert Counter((r.breaking_id, r.article_id, r.user_id) for r in found) == Counter(pairs)


def test_breaking_pairs_take_little_room(spark, tmp_path):
    """Users of one kind recur in the same order for each item, in many tasks, and so take few bytes where they are stored."""
    items = spark.range(200).selectExpr("id", "id AS article_id", "false AS is_sent", "cast(array() AS array<int>) AS target_categories", "cast(array() AS array<int>) AS target_sources")
    tokens = spark.range(20000).selectExpr("xxhash64(id) AS user_id", "'t' AS token", "true AS is_active")
    fans = spark.range(20000).selectExpr("xxhash64(id) AS user_id", "array(cast(id % 2 AS int)) AS preferred_categories", "cast(array() AS array<int>) AS followed_sources")
    history = spark.range(200).selectExpr("xxhash64(id) AS user_id", "id AS article_id", f"TIMESTAMP '{AS_OF}' AS sent_at")
    found = audience.breaking_audience(items, tokens, history, fans, now(), salts=8)
    found.write.parquet(f"{tmp_path}/reached")
    files = list((tmp_path / "reached").glob("*.parquet"))
    assert spark.read.parquet(f"{tmp_path}/reached").count() == 200 * 19999
    assert len(files) > 4 and sum(f.stat().st_size for f in files) < 2_000_000


def test_batches_hold_a_hundred(spark):
    messages = spark.range(1050).selectExpr("1 AS alert_id", "id AS user_id", "concat('t', id) AS token")
    sizes = audience.message_batches(messages, "alert_id", bucket=100).groupBy("batch_no").count().orderBy("batch_no").collect()
    assert [r["count"] for r in sizes] == [100] * 10 + [50]


def test_completion_is_capped_and_engagement_counts_a_quarter(spark):
    videos = spark.createDataFrame([(1, "v", "ready", 100), (2, "w", "ready", 0)], "id bigint, title string, status string, duration_seconds int")
    views = spark.createDataFrame([(1, 1, 250, "tv", ""), (1, None, 25, "tv", "low"), (1, 1, 0, None, "low"), (2, 3, 50, "tv", "low")], "video_id bigint, user_id bigint, watch_seconds int, device_type string, quality_watched string")
    row = {r.video_id: r for r in video.video_analytics(videos, views).collect()}
    assert (row[1].completion_rate, row[1].engagement_rate, row[1].unique_users) == (33.33, 66.67, 1)
    assert row[1].device_breakdown == {"tv": 2, "unknown": 1} and row[2].engagement_rate == 0.0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_extended_components_equal_a_recomputation(spark, seed):
    from pressline.operators.graph import connected_components, extended_components

    rng = random.Random(seed)
    pair = lambda: (rng.randrange(300), rng.randrange(300))
    old, new = [pair() for _ in range(140)], [pair() for _ in range(60)] + [(900, 901), (901, 5), (950, 950), (2, 2)]
    edges = lambda rows: spark.createDataFrame(rows, "src bigint, dst bigint")
    rows = lambda df: {r.id: r.component for r in df.collect()}
    labels = connected_components(edges(old))
    got, want = extended_components(labels, edges(new)).collect(), rows(connected_components(edges(old + new)))
    assert len(got) == len({r.id for r in got})
    assert {r.id: r.component for r in got} == {950: 950, 2: rows(labels).get(2, 2)} | want
    assert rows(extended_components(labels, edges([])))== rows(labels)


START = datetime(2024, 1, 1)


def test_suggestions_for_many_texts_equal_one_by_one(spark):
    from pressline.operators import search

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcAé ") for _ in range(rng.randint(1, 9)))
    articles = spark.createDataFrame(
        [(k, word() + word(), START + timedelta(hours=rng.randint(0, 400)), rng.random() < 0.8) for k in range(250)] + [(900, None, START, True)],
        "id bigint, title string, scraped_at timestamp, has_full_content boolean",
    )
    categories = spark.createDataFrame([(k, word()) for k in range(20)], "id int, name string")
    sources = spark.createDataFrame([(k, word(), k % 3 > 0) for k in range(20)], "id int, name string, is_active boolean")
    as_of = F.lit(START + timedelta(hours=300))
    texts = ["", "a", "ab", " Ab ", "abc", "a b", "b a a", "aaaa", "abcab", "éa", None] + [word()[:6] for _ in range(25)]
    suffixes = search.suggestion_suffixes(search.suggestion_entries(articles, categories, sources, as_of)).cache()
    requests = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    got = sorted(tuple(r) for r in search.suggest_many(requests, suffixes, search.short_suggestions(suffixes)).collect())
    want = sorted((n, *r) for n, text in enumerate(texts) if text is not None for r in search.suggestions(articles, categories, sources, text, as_of).collect())
    assert got == want and len(got) > 50


def test_edges_of_one_task_and_rounds_give_the_same_components(spark, monkeypatch):
    from pressline.operators import graph

    edges = [(k, k + 1) for k in range(300, 360)] + [(5, 5), (None, 3), (9, 7), (7, 8), (400, 359), (2, None)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    found = lambda: {(r.id, r.component) for r in graph.connected_components(df).collect()}
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one", "")
    one = found()
    spark.sparkContext.setJobGroup("rounds", "")
    monkeypatch.setattr(graph, "ONE_TASK_EDGES", 0)
    assert one == found() == {(k, 300) for k in range(300, 361)} | {(400, 300), (7, 7), (8, 7), (9, 7)}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 3 * len(jobs.getJobIdsForGroup("one")) < len(jobs.getJobIdsForGroup("rounds"))


def test_rounds_of_few_edges_use_few_tasks(spark):
    """Rounds of a small edge set leave few files, however many partitions the session has."""
    from pressline.operators.graph import LEAST_TASKS, connected_components

    keep = {key: spark.conf.get(key) for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = connected_components(spark.createDataFrame([(k, k + 1) for k in range(50)] + [(90, 95)], "src bigint, dst bigint"))
        assert found.rdd.getNumPartitions() <= LEAST_TASKS
        assert {(r.id, r.component) for r in found.collect()} == {(k, 0) for k in range(51)} | {(90, 90), (95, 90)}
    finally:
        for key, value in keep.items():
            spark.conf.set(key, value)
