"""Registered queries for counts, trends, calendars and ranking helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.operators import ranking, trends
from pressline.plans.model import AS_OF_SQL, Model
from pressline.plans.registry import query

DONE = "SELECT article_id FROM enrichments WHERE status = 'completed'"
FULL = "SELECT id FROM articles WHERE has_full_content"
ACTIVE = "SELECT a.id FROM articles a JOIN sources s ON s.id = a.source_id WHERE a.has_full_content AND s.is_active"


def complete(m: Model):
    return trends.complete_mentions(m.mentions, m.enrichments, m.articles, m.sources)


@query("a1_view_counts", "SELECT a.id, count(v.id) AS view_count FROM articles a LEFT JOIN views v ON v.article_id = a.id GROUP BY a.id")
def _(m):
    return trends.view_counts(m.articles.select("id"), m.views)


@query("a2_recent_and_total_views", f"""
SELECT article_id, count(*) FILTER (WHERE viewed_at >= {AS_OF_SQL} - INTERVAL 7 DAY) AS recent_view_count, count(*) AS total_view_count
FROM views GROUP BY article_id""")
def _(m):
    return trends.recent_and_total_views(m.views, m.as_of - F.expr("INTERVAL 7 DAYS"))


@query("a2_status_counts", """
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'pending') AS pending FROM enrichments""")
def _(m):
    return trends.status_counts(m.enrichments)


@query("a3_story_counts", """
SELECT story_id, count(DISTINCT article_id) AS article_count, count(DISTINCT source_id) AS source_count
FROM story_articles JOIN articles ON articles.id = story_articles.article_id WHERE has_full_content GROUP BY story_id HAVING count(DISTINCT article_id) >= 2""")
def _(m):
    return trends.story_counts(m.story_articles, m.articles, full_content_only=True, at_least=2)


@query("a4_trending_entities", f"""
SELECT normalized_name, entity_name, entity_type, count(*) AS mention_count FROM mentions
WHERE mention_date >= CAST({AS_OF_SQL} AS DATE) - 7 GROUP BY ALL ORDER BY mention_count DESC, 1, 2, 3 LIMIT 50""")
def _(m):
    return trends.trending_entities(m.mentions, m.as_of, 7, 50)


@query("a5_digest_trending_entities", """
SELECT entity_name, entity_type, count(*) AS mention_count, round(avg(sentiment_score), 6) AS avg_sentiment FROM mentions
WHERE mention_date >= DATE '2024-01-24' GROUP BY ALL ORDER BY mention_count DESC, 1, 2 LIMIT 20""")
def _(m):
    top = trends.digest_trending_entities(m.mentions, F.to_date(m.as_of))
    return top.withColumn("avg_sentiment", F.round("avg_sentiment", 6))


@query("a6_entity_context_counts", f"""
SELECT normalized_name, entity_type, count(*) AS mention_count, count(DISTINCT article_id) AS article_count FROM mentions
WHERE mention_date >= DATE '2024-01-24' AND article_id IN ({DONE}) AND article_id IN ({FULL})
GROUP BY ALL HAVING count(*) >= 2 ORDER BY mention_count DESC, 1, 2 LIMIT 8""")
def _(m):
    rows = trends.complete_mentions(m.mentions, m.enrichments, m.articles)
    return trends.entity_context_counts(rows, m.as_of)


@query("a7_top_entities", f"""
SELECT coalesce(nullif(normalized_name, ''), entity_name) AS resolved_name, entity_type, count(*) AS mention_count FROM mentions
WHERE mention_date >= DATE '2024-01-24' AND article_id IN ({DONE}) AND article_id IN ({ACTIVE})
GROUP BY ALL ORDER BY mention_count DESC, 1, 2 LIMIT 10""")
def _(m):
    return trends.top_entities(complete(m), m.as_of)


@query("a8_mention_calendar", f"""
WITH rows AS (SELECT * FROM mentions WHERE article_id IN ({DONE}) AND article_id IN ({ACTIVE}) AND mention_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'),
daily AS (SELECT normalized_name, entity_type, mention_date, count(*) AS n, count(DISTINCT article_id) AS arts FROM rows GROUP BY ALL),
monthly AS (SELECT normalized_name, entity_type, max(n) AS max_count, CAST(sum(n) AS BIGINT) AS total_mentions, CAST(sum(arts) AS BIGINT) AS total_articles FROM daily GROUP BY ALL),
days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS date)
SELECT m.normalized_name, m.entity_type, CAST(days.date AS VARCHAR) AS date, day(days.date) AS day, isodow(days.date) - 1 AS weekday, coalesce(n, 0) AS mention_count,
  coalesce(arts, 0) AS article_count, CASE WHEN coalesce(n, 0) = 0 THEN 0 WHEN n / max_count <= 0.25 THEN 1 WHEN n / max_count <= 0.5 THEN 2
  WHEN n / max_count <= 0.75 THEN 3 ELSE 4 END AS level, max_count, total_mentions, total_articles
FROM monthly m CROSS JOIN days LEFT JOIN daily d ON d.normalized_name = m.normalized_name AND d.entity_type = m.entity_type AND d.mention_date = days.date""")
def _(m):
    month = trends.mention_calendar(complete(m), F.lit("2024-01-01").cast("date"))
    return month.withColumn("date", F.col("date").cast("string"))


COST = """round(CAST(input_tokens / 1000000.0 * CASE model_used WHEN 'gpt-4o' THEN 2.50 WHEN 'gpt-5-nano' THEN 0.05 ELSE 0.15 END
 + output_tokens / 1000000.0 * CASE model_used WHEN 'gpt-4o' THEN 10.0 WHEN 'gpt-5-nano' THEN 0.40 ELSE 0.60 END AS DECIMAL(18,10)), 6)"""


@query("a9_cost_totals", f"""
SELECT CAST(sum({COST}) AS DOUBLE) AS total_cost, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens FROM enrichments""")
def _(m):
    return trends.cost_totals(m.enrichments).withColumn("total_cost", F.col("total_cost").cast("double"))


@query("a10_source_health", f"""
WITH run AS (SELECT source_id, max(struct_pack(a := started_at, b := run_id, c := status, d := articles_found)) AS latest,
    sum(CASE WHEN started_at >= {AS_OF_SQL} - INTERVAL 24 HOUR THEN error_count END) AS errors FROM scrape_runs GROUP BY 1),
output AS (SELECT source_id, count(*) AS n, count(*) FILTER (WHERE has_full_content) AS full_n FROM articles
    WHERE scraped_at >= {AS_OF_SQL} - INTERVAL 24 HOUR GROUP BY 1)
SELECT s.id AS source_id, name, latest.c AS latest_run_status, latest.a AS latest_run_started_at, coalesce(n, 0) AS articles_24h,
  coalesce(full_n, 0) AS full_content_24h, CAST(coalesce(errors, 0) AS BIGINT) AS error_count_24h
FROM sources s LEFT JOIN run ON run.source_id = s.id LEFT JOIN output o ON o.source_id = s.id""")
def _(m):
    return trends.source_health(m.sources, m.scrape_runs, m.articles, m.as_of)


SENT = f"(SELECT * FROM notifications WHERE sent_at >= {AS_OF_SQL} - INTERVAL 7 DAY)"
LOGGED = f"(SELECT * FROM history WHERE sent_at >= {AS_OF_SQL} - INTERVAL 7 DAY)"


@query("a11_notification_stats", f"""
WITH rows AS (
SELECT 'users' AS section, 'total' AS name, CAST(count(*) AS DOUBLE) AS value FROM profiles
UNION ALL SELECT 'users', 'with_tokens', count(DISTINCT user_id) FROM push_tokens WHERE is_active
UNION ALL SELECT 'users', 'with_schedules', count(DISTINCT user_id) FROM schedules WHERE is_active
UNION ALL SELECT 'tokens', 'total', count(*) FROM push_tokens
UNION ALL SELECT 'tokens', 'active', count(*) FROM push_tokens WHERE is_active
UNION ALL SELECT 'tokens_by_platform', coalesce(nullif(platform, ''), 'unknown'), count(*) FROM push_tokens WHERE is_active GROUP BY 2
UNION ALL SELECT 'notifications', 'total', count(*) FROM {SENT}
UNION ALL SELECT 'notifications', 'read', count(*) FROM {SENT} WHERE is_read
UNION ALL SELECT 'notifications', 'read_rate', round(count(*) FILTER (WHERE is_read) * 100 / count(*), 1) FROM {SENT}
UNION ALL SELECT 'notifications_by_type', notification_type, count(*) FROM {SENT} GROUP BY 2
UNION ALL SELECT 'articles', 'sends', count(*) FROM {LOGGED}
UNION ALL SELECT 'articles', 'distinct', count(DISTINCT article_id) FROM {LOGGED}
UNION ALL SELECT 'articles', 'sends_per_article', round(count(*) / count(DISTINCT article_id), 1) FROM {LOGGED}
UNION ALL SELECT 'schedules_by_frequency', frequency, count(*) FROM schedules WHERE is_active GROUP BY 2
UNION ALL SELECT 'breaking', 'sent', count(*) FROM breaking_news WHERE is_sent AND created_at >= {AS_OF_SQL} - INTERVAL 7 DAY
UNION ALL SELECT 'breaking', 'pending', count(*) FROM breaking_news WHERE NOT is_sent
UNION ALL (SELECT 'top_user', CAST(user_id AS VARCHAR), count(*) FROM {SENT} GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 5))
SELECT section, name, value FROM rows""")
def _(m):
    return trends.notification_stats(
        m.profiles, m.push_tokens, m.schedules, m.notifications, m.history, m.breaking_news, m.as_of
    )


@query("a11_user_notification_stats", """
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE NOT is_read) AS unread, count(*) FILTER (WHERE is_read) AS "read",
  count(*) FILTER (WHERE notification_type = 'scheduled_digest') AS scheduled_digest,
  count(*) FILTER (WHERE notification_type = 'breaking_news') AS breaking_news,
  count(*) FILTER (WHERE notification_type = 'story_alert') AS story_alert FROM notifications GROUP BY user_id""")
def _(m):
    return trends.user_notification_stats(m.notifications)


@query("a12_incomplete_by_source", """
SELECT name AS source_name, count(*) AS total FROM articles a JOIN sources s ON s.id = a.source_id WHERE NOT has_full_content GROUP BY 1""")
def _(m):
    return trends.incomplete_by_source(m.articles, m.sources)


def named_articles(m: Model):
    categories = m.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    authors = m.authors.select(F.col("id").alias("author_id"), F.col("name").alias("author_name"))
    return m.articles.join(categories, "category_id", "left").join(authors, "author_id", "left")


@query("a13_corpus_summary", """
WITH named AS (SELECT a.*, c.name AS cname, u.name AS uname FROM articles a JOIN categories c ON c.id = a.category_id JOIN authors u ON u.id = a.author_id),
entries AS (SELECT 'category' AS section, cname AS name FROM named UNION ALL SELECT 'author', uname FROM named
  UNION ALL SELECT 'published_hour', strftime(published_at, '%H') FROM named
  UNION ALL SELECT 'image', CASE WHEN image_url <> '' THEN 'with' ELSE 'without' END FROM named UNION ALL SELECT 'tag', unnest(tags) FROM named),
counts AS (SELECT section, name, count(*) AS n, row_number() OVER (PARTITION BY section ORDER BY count(*) DESC, name) AS rank FROM entries GROUP BY 1, 2)
SELECT section, name, n, round(n * 100 / (SELECT count(*) FROM articles), 1) AS share, rank FROM counts WHERE rank <= 10""")
def _(m):
    return trends.corpus_summary(named_articles(m))


@query("a13_length_summary", """
SELECT round(avg(word_count), 1) AS mean_words, max(word_count) AS longest, min(word_count) AS shortest, CAST(sum(word_count) AS BIGINT) AS total_words,
  count(*) AS n_articles FROM articles""")
def _(m):
    return trends.length_summary(m.articles)


@query("a14_headline_keywords", r"""
SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')) AS word FROM articles)
WHERE length(word) > 3 AND word NOT IN ('the','and','for','are','with','his','her','this','that','from','they','been','have','has','will','said','says')
GROUP BY word ORDER BY freq DESC, word LIMIT 10""")
def _(m):
    return trends.headline_keywords(m.articles)


@query("a15_dimension_counts", """
SELECT 'category' AS dimension, name, (SELECT count(*) FROM articles a WHERE a.category_id = c.id) AS n FROM categories c
UNION ALL SELECT 'author', name, (SELECT count(*) FROM articles a WHERE a.author_id = u.id) FROM authors u
UNION ALL SELECT 'source_followers', name, (SELECT count(*) FROM (SELECT unnest(followed_sources) AS f FROM profiles) p WHERE p.f = s.id) FROM sources s
UNION ALL SELECT 'source_breaking', name, (SELECT count(*) FROM breaking_news b JOIN articles a ON a.id = b.article_id WHERE a.source_id = s.id) FROM sources s""")
def _(m):
    def of(label, dimension, facts, key):
        counted = trends.dimension_counts(dimension, facts, key)
        return counted.select(F.lit(label).alias("dimension"), "name", "n")

    followers = m.profiles.select(F.explode("followed_sources").alias("source_id"))
    breaking = m.breaking_news.select("article_id").join(
        m.articles.select(F.col("id").alias("article_id"), "source_id"), "article_id"
    )
    return (
        of("category", m.categories, m.articles, "category_id")
        .unionByName(of("author", m.authors, m.articles, "author_id"))
        .unionByName(of("source_followers", m.sources, followers, "source_id"))
        .unionByName(of("source_breaking", m.sources, breaking, "source_id"))
    )


@query("a16_mean_vector", """
WITH ranked AS (SELECT story_id, embedding
  FROM story_articles sa JOIN enrichments e ON e.article_id = sa.article_id JOIN embeddings v ON v.vec_id = sa.article_id WHERE status = 'completed'),
parts AS (SELECT story_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM ranked)
SELECT story_id, pos - 1 AS pos, round(avg(CAST(x AS DOUBLE)), 5) AS x FROM parts GROUP BY story_id, pos""")
def _(m):
    members = (
        m.story_articles.join(m.enrichments.filter("status = 'completed'").select("article_id", "analyzed_at"), "article_id")
        .join(m.embeddings.select("article_id", "embedding"), "article_id")
    )
    centroid = trends.mean_vector(members, "story_id")
    return centroid.select("story_id", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 5))


@query("a17_set_union_agg", """
WITH ranked AS (SELECT story_id, entities_people || entities_organizations || entities_locations AS names
  FROM story_articles sa JOIN articles a ON a.id = sa.article_id JOIN enrichments e ON e.article_id = sa.article_id WHERE status = 'completed')
SELECT story_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM (SELECT story_id, unnest(names) AS name FROM ranked) GROUP BY 1""")
def _(m):
    done = m.enrichments.filter("status = 'completed'").select(
        "article_id", F.concat("entities_people", "entities_organizations", "entities_locations").alias("names")
    )
    dates = m.articles.select(F.col("id").alias("article_id"), "published_at")
    rows = m.story_articles.join(done, "article_id").join(dates, "article_id")
    union = trends.set_union(rows, "story_id", "names")
    return union.select("story_id", F.array_join("names", ",").alias("names"))


@query("a18_change_pair_counts", """
SELECT normalized_name AS old_name, entity_type || ' ' || normalized_name AS new_name, count(*) AS n FROM mentions
WHERE entity_type <> 'person' GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 25""")
def _(m):
    changes = m.mentions.filter("entity_type <> 'person'").selectExpr(
        "normalized_name AS old_name", "concat(entity_type, ' ', normalized_name) AS new_name"
    )
    return trends.change_pair_counts(changes, "old_name", "new_name")


@query("a19_sector_sentiment", """
SELECT theme, round(avg(sentiment_score), 6) AS sentiment, count(*) AS n_articles FROM (
  SELECT unnest(themes) AS theme, sentiment_score FROM enrichments e JOIN articles a ON a.id = e.article_id
  WHERE status = 'completed' AND CAST(published_at AS DATE) = DATE '2024-01-20') GROUP BY theme""")
def _(m):
    return trends.sector_sentiment(m.enrichments, m.articles, F.lit("2024-01-20").cast("date"))


@query("w1_latest_run_per_source", """
SELECT source_id, started_at, run_id, status, articles_found FROM (SELECT *, row_number() OVER (PARTITION BY source_id
  ORDER BY started_at DESC, run_id DESC, status DESC, articles_found DESC) AS r FROM scrape_runs) WHERE r = 1""")
def _(m):
    order = [F.desc(c) for c in ("started_at", "run_id", "status", "articles_found")]
    picked = ranking.latest_per_key(m.scrape_runs, ["source_id"], order)
    return picked.select("source_id", "started_at", "run_id", "status", "articles_found")


@query("w2_top_n_per_source", """
SELECT source_id, id, rank FROM (SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY word_count DESC, id) AS rank FROM articles) WHERE rank <= 3""")
def _(m):
    return ranking.top_n(m.articles, ["source_id"], [F.desc("word_count"), F.asc("id")], 3).select("source_id", "id", "rank")


def entity_article_rows(m: Model):
    """One row per (entity, article) with the ranking columns."""
    rows = complete(m).filter(F.col("mention_date") >= F.date_sub(F.to_date(m.as_of), 14))
    once = rows.groupBy("normalized_name", "entity_type", "article_id").agg(F.max("mention_date").alias("mention_date"))
    views = m.views.groupBy("article_id").agg(F.count(F.lit(1)).alias("view_count"))
    facts = m.enrichments.select("article_id", "importance_score").join(
        m.articles.select(F.col("id").alias("article_id"), "scraped_at"), "article_id"
    )
    joined = once.join(facts, "article_id").join(views, "article_id", "left")
    return joined.withColumn("view_count", F.coalesce("view_count", F.lit(0)))


ENTITY_ROWS = f"""
once AS (SELECT normalized_name, entity_type, article_id, max(mention_date) AS mention_date FROM mentions
  WHERE mention_date >= DATE '2024-01-17' AND article_id IN ({DONE}) AND article_id IN ({ACTIVE}) GROUP BY ALL),
ranked AS (SELECT o.normalized_name, o.entity_type, o.article_id, row_number() OVER (PARTITION BY o.normalized_name, o.entity_type
    ORDER BY importance_score DESC, coalesce(v.n, 0) DESC, mention_date DESC, scraped_at DESC, o.article_id) AS rank
  FROM once o JOIN enrichments e ON e.article_id = o.article_id JOIN articles a ON a.id = o.article_id
  LEFT JOIN (SELECT article_id, count(*) AS n FROM views GROUP BY 1) v ON v.article_id = o.article_id)"""


@query("w3_rank_articles_for_entity", f"WITH {ENTITY_ROWS} SELECT normalized_name, entity_type, article_id, rank FROM ranked")
def _(m):
    rows = entity_article_rows(m)
    order = [F.desc("importance_score"), F.desc("view_count"), F.desc("mention_date"), F.desc("scraped_at"), F.asc("article_id")]
    coarse = [("importance_score", True), ("view_count", True), ("mention_date", True)]
    ranked = ranking.rank_all(rows, ["normalized_name", "entity_type"], coarse, order)
    return ranked.select("normalized_name", "entity_type", "article_id", "rank")


@query("w2_top_entities_with_articles", f"""
WITH {ENTITY_ROWS},
top AS (SELECT normalized_name, entity_type, count(*) AS mention_count FROM mentions
  WHERE mention_date >= DATE '2024-01-17' AND article_id IN ({DONE}) AND article_id IN ({ACTIVE}) GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 10)
SELECT 'Entity ' || split_part(t.normalized_name, ' ', 2) AS entity, t.normalized_name, t.entity_type, mention_count, article_id, rank FROM top t
JOIN ranked r ON r.normalized_name = t.normalized_name AND r.entity_type = t.entity_type WHERE rank <= 3""")
def _(m):
    top = trends.top_entities(complete(m), m.as_of, 14, 10).withColumnRenamed("resolved_name", "normalized_name")
    rows = entity_article_rows(m).join(top, ["normalized_name", "entity_type"])
    order = [F.desc("importance_score"), F.desc("view_count"), F.desc("mention_date"), F.desc("scraped_at"), F.asc("article_id")]
    best = ranking.top_n(rows, ["normalized_name", "entity_type"], order, 3)
    return best.select(
        F.initcap("normalized_name").alias("entity"), "normalized_name", "entity_type", "mention_count", "article_id", "rank"
    )


@query("w4_first_seen_sources", """
SELECT story_id, source_id, article_id, relevance_score FROM (SELECT story_id, source_id, article_id, relevance_score,
  row_number() OVER (PARTITION BY story_id, source_id ORDER BY relevance_score DESC, article_id) AS r
  FROM story_articles JOIN articles ON articles.id = story_articles.article_id WHERE has_full_content) WHERE r = 1""")
def _(m):
    members = m.story_articles.join(
        m.articles.filter("has_full_content").select(F.col("id").alias("article_id"), "source_id"), "article_id"
    )
    seen = ranking.first_seen(members, ["story_id"], "source_id", [F.desc("relevance_score"), F.asc("article_id")])
    return seen.select("story_id", "source_id", "article_id", "relevance_score")


@query("w5_gap_sessions", """
WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session_no FROM marked)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n_rows, min(ts) AS first_at, max(ts) AS last_at FROM numbered GROUP BY ALL""")
def _(m):
    events = m.raw("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return ranking.session_summary(events, ["user_id"], "ts", 6 * 3600)


@query("w6_card_image", """
SELECT story_id, arg_max(image_url, struct_pack(a := relevance_score, b := -article_id)) AS card_image_url
FROM story_articles JOIN articles ON articles.id = story_articles.article_id WHERE image_url <> '' GROUP BY 1""")
def _(m):
    return ranking.card_image(m.story_articles, m.articles)


@query("w7_queue_position", """
WITH q AS (SELECT id, priority, queued_at, list_position(['low', 'normal', 'high', 'urgent'], priority) AS level FROM video_queue WHERE status = 'queued')
SELECT id, priority, queued_at, 1 + (SELECT count(*) FROM q o WHERE o.level >= q.level AND o.queued_at < q.queued_at) AS position FROM q""")
def _(m):
    return ranking.queue_position(m.video_queue)


@query("l1_freshness_order", "SELECT id, scraped_at, row_number() OVER (ORDER BY scraped_at DESC, id DESC) AS position FROM articles")
def _(m):
    return ranking.global_positions(m.articles.select("id", "scraped_at"), ranking.freshness_order(), by_time="scraped_at")


@query("l2_page", """
SELECT id, total_count, CAST(ceil(total_count / 20) AS INTEGER) AS total_pages, 3 < ceil(total_count / 20) AS has_next, true AS has_previous
FROM (SELECT id, scraped_at, count(*) OVER () AS total_count FROM articles WHERE has_full_content) ORDER BY scraped_at DESC, id DESC LIMIT 20 OFFSET 40""")
def _(m):
    rows = m.articles.filter("has_full_content").select("id", "scraped_at")
    return ranking.page(rows, ranking.freshness_order(), 3, 20).drop("scraped_at")


@query("l4_intelligence_order", """
SELECT id, importance_score, row_number() OVER (ORDER BY is_breaking_candidate DESC, importance_score DESC, follow_up_worthy DESC, scraped_at DESC, id DESC) AS position
FROM articles a JOIN enrichments e ON e.article_id = a.id WHERE status = 'completed'""")
def _(m):
    done = m.enrichments.filter("status = 'completed'").withColumnRenamed("article_id", "id")
    rows = m.articles.select("id", "scraped_at").join(done, "id")
    leading = ["is_breaking_candidate", "importance_score", "follow_up_worthy"]
    placed = ranking.global_positions(rows, ranking.intelligence_order(), by_time="scraped_at", leading=leading)
    return placed.select("id", "importance_score", "position")


@query("l2_page_after", """
SELECT id, scraped_at FROM articles WHERE has_full_content AND (scraped_at < TIMESTAMP '2024-01-30 00:00:00' OR scraped_at = TIMESTAMP '2024-01-30 00:00:00' AND id < 7)
ORDER BY scraped_at DESC, id DESC LIMIT 20""")
def _(m):
    """The page after a key; the key reaches the scan as a filter."""
    rows = m.articles.filter("has_full_content").select("id", "scraped_at")
    last = {"scraped_at": F.lit("2024-01-30 00:00:00").cast("timestamp"), "id": F.lit(7)}
    return ranking.page_after(rows, last, 20)
