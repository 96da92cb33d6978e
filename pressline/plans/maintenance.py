"""Registered queries for sources, sinks, joins, sets and upkeep."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pressline.functions import text as tx
from pressline.operators import feeds, joins, maintenance, sets
from pressline.operators.ranking import freshness_order
from pressline.plans.feeds import INTEL, NEWS, news
from pressline.plans.identity import WS, sql_hash, sql_strip, sql_title
from pressline.plans.model import AS_OF, AS_OF_SQL, Model
from pressline.plans.registry import query
from pressline.session import shared_dir
from pressline.sources import merge, tables


def scratch(m: Model, name: str) -> str:
    """A new folder for one run of a writing query, where all executors can reach it."""
    return f"{shared_dir(m.spark)}/{name}-{uuid.uuid4().hex}"


def sql_squash(text):
    return sql_strip(f"regexp_replace({text}, '{WS}+', ' ', 'g')")


@query("s1_scan_table", "SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def _(m):
    return tables.scan_table(m.spark, f"{m.folder}/documents.parquet", ["doc_id", "lang"], F.col("lang") == "en")


@query("s1_articles_with_parents", """
SELECT a.id, s.name AS source_name, s.is_active AS source_active, c.name AS category_name, u.name AS author_name
FROM articles a JOIN sources s ON s.id = a.source_id JOIN categories c ON c.id = a.category_id JOIN authors u ON u.id = a.author_id""")
def _(m):
    rows = tables.articles_with_parents(m.articles, m.sources, m.categories, m.authors)
    return rows.select("id", "source_name", "source_active", "category_name", "author_name")


def replies(m: Model):
    """Every article as an interface reply; the whole text is the markup of its body."""
    i = F.col("id")
    story = F.struct(
        i.cast("string").alias("iID"), F.concat(F.lit("/story/"), i).alias("permalink"), F.concat(F.lit(" Title "), i, F.lit(" ")).alias("tTitle"),
        F.concat(F.lit("<p>"), tx.escape_html(F.replace("content", F.lit("\n"), F.lit(" <br/> "))), F.lit("</p>//Cue in: 'x'\nCue out: 'y'//")).alias("tContents"),
        F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("Summary  "), i)).alias("tSummary"),
        F.array(F.struct(F.concat(F.lit("Cat "), F.col("category_id")).alias("tName"))).alias("categories"),
        F.struct(F.when(i % 2 == 0, F.lit("Ann")).alias("tFirstName"), F.when(i % 2 == 0, F.lit("Bee")).alias("tLastName")).alias("submitter"),
        F.lit("Desk").alias("tAuthor"),
        F.create_map(F.lit("a"), F.transform("tags", lambda t: F.struct(t.alias("tName"))), F.lit("b"), F.array(F.struct(F.lit("t0").alias("tName")))).alias("keywords"),
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("sLive"),
    )
    broken = F.struct(F.lit("").alias("iID"), F.lit("/x").alias("permalink"))
    return m.articles.select(F.concat(F.lit('{"results":{"1":'), F.to_json(story), F.lit(',"2":'), F.to_json(broken), F.lit("}}")).alias("reply"))


@query("s3_read_story_api_json", f"""
WITH t AS (SELECT *, CASE WHEN length(body) > 2 THEN body ELSE '' END AS text FROM (SELECT *, {sql_squash('content')} AS body FROM articles))
SELECT CAST(id AS VARCHAR) AS external_id, 'https://agency.example/story/' || id AS url, 'Title ' || id AS title, md5(text) AS content_md5,
  CASE WHEN id % 3 <> 0 THEN 'Summary ' || id WHEN text = '' THEN '' ELSE regexp_replace(substr(text, 1, 260), ' [^ ]*$', '') || '...' END AS excerpt,
  'Cat ' || category_id AS category, CASE WHEN id % 2 = 0 THEN 'Ann Bee' ELSE 'Desk' END AS author_name,
  CASE WHEN list_contains(tags, 't0') THEN array_to_string(tags, '|') ELSE array_to_string(list_append(tags, 't0'), '|') END AS tags,
  published_at - INTERVAL 3 HOUR AS published_at, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS word_count,
  len(list_filter(string_split(text, ' '), lambda w: w <> '')) >= 60 AS has_full_content FROM t""")
def _(m):
    rows = tables.read_story_api_json(replies(m), "reply", "https://agency.example", m.as_of)
    return rows.withColumns({"tags": F.array_join("tags", "|"), "content_md5": F.md5("content")}).drop("content", "image_url")


def headlines(m: Model):
    return m.articles.select(
        F.concat(F.lit("post-"), "id").alias("post_id"), F.array(F.concat(F.lit("cat "), "category_id")).alias("categories"), "tags", "title", "url",
        F.col("image_url").alias("featured_image"), F.concat(F.lit("Cat "), "category_id").alias("primary_category"),
        F.concat(F.col("id") % 20, F.lit(" hours ago")).alias("published_time"), F.concat(F.lit("By "), "author_id").alias("author"),
        F.col("content").alias("excerpt"), F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at"), F.lit("Wire").alias("source_website"),
    )


HEADLINES_SQL = """
SELECT 'post-' || id AS post_id, 'cat ' || category_id AS categories, array_to_string(tags, ', ') AS tags, title, url, image_url AS featured_image, 'Cat ' || category_id AS primary_category,
  (id % 20) || ' hours ago' AS published_time, 'By ' || author_id AS author, content AS excerpt, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS scraped_at, 'Wire' AS source_website FROM articles"""


@query("s5_write_csv_flattened", HEADLINES_SQL)
def _(m):
    """Written as CSV, read back with its lists."""
    path = scratch(m, "headlines-csv")
    tables.write_csv_flattened(headlines(m), path)
    back = tables.flatten_lists(tables.read_headlines_csv(m.spark, path))
    return back.withColumn("featured_image", F.coalesce("featured_image", F.lit("")))


@query("s6_write_json", HEADLINES_SQL)
def _(m):
    """Written as JSON, read back."""
    path = scratch(m, "headlines-json")
    tables.write_json(headlines(m), path)
    return tables.flatten_lists(m.spark.read.schema(tables.HEADLINE).json(path))


@query("s4_read_headlines", """
SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM articles) GROUP BY tag""")
def _(m):
    """Headline files written as CSV, read back and counted by their split tags."""
    path = scratch(m, "headlines-csv")
    tables.write_csv_flattened(headlines(m), path)
    rows = tables.read_headlines_csv(m.spark, path)
    return rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("s7_insert_if_absent", """
SELECT tag AS name, min(id) AS first_id FROM (SELECT unnest(tags) AS tag, id FROM articles) WHERE tag NOT IN (SELECT 't' || id FROM categories WHERE id < 2) GROUP BY tag""")
def _(m):
    used = m.articles.select(F.explode("tags").alias("name"), F.col("id").alias("first_id"))
    known = m.categories.filter("id < 2").select(F.concat(F.lit("t"), "id").alias("name"))
    return merge.insert_if_absent(used, known, ["name"], [F.asc("first_id")])


@query("s8_upsert", f"""
WITH o AS (SELECT id, title, excerpt, word_count FROM articles WHERE scraped_at < {AS_OF_SQL} - to_days(5)),
n AS (SELECT id, 'New ' || id AS title, CASE WHEN id % 2 = 0 THEN '' ELSE 'fresh' END AS excerpt, word_count + 1 AS word_count FROM articles WHERE scraped_at >= {AS_OF_SQL} - to_days(10))
SELECT coalesce(o.id, n.id) AS id, coalesce(nullif(n.title, ''), o.title) AS title, coalesce(nullif(n.excerpt, ''), o.excerpt, '') AS excerpt, coalesce(n.word_count, o.word_count) AS word_count,
  CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS change FROM o FULL JOIN n ON n.id = o.id""")
def _(m):
    old = m.articles.filter(F.col("scraped_at") < feeds.hours_before(m.as_of, 120)).select("id", "title", "excerpt", "word_count")
    new = m.articles.filter(F.col("scraped_at") >= feeds.hours_before(m.as_of, 240)).select(
        "id", F.concat(F.lit("New "), "id").alias("title"), F.when(F.col("id") % 2 == 0, "").otherwise("fresh").alias("excerpt"),
        (F.col("word_count") + 1).alias("word_count"),
    )
    merged = merge.upsert(new, old, ["id"], ["title", "excerpt"], ["word_count"])
    return merged.withColumn("excerpt", F.coalesce("excerpt", F.lit("")))


@query("s8_upsert_by_day", f"""
WITH o AS (SELECT id, title, scraped_at, word_count FROM articles WHERE scraped_at < {AS_OF_SQL} - to_days(5)),
n AS (SELECT id, 'New ' || id AS title, scraped_at, word_count + 1 AS word_count FROM articles WHERE scraped_at >= {AS_OF_SQL} - to_days(10))
SELECT coalesce(o.id, n.id) AS id, coalesce(n.title, o.title) AS title, coalesce(n.scraped_at, o.scraped_at) AS scraped_at, coalesce(n.word_count, o.word_count) AS word_count,
  CAST(coalesce(o.scraped_at, n.scraped_at) AS DATE)::VARCHAR AS day FROM o FULL JOIN n ON n.id = o.id""")
def _(m):
    """A stored table laid out by day takes an upsert; only the days of the last ten days are written."""
    path = scratch(m, "by-day")
    base = m.articles.select("id", "title", "scraped_at", "word_count")
    merge.write_by_day(base.filter(F.col("scraped_at") < feeds.hours_before(m.as_of, 120)), path, "scraped_at")
    new = base.filter(F.col("scraped_at") >= feeds.hours_before(m.as_of, 240)).select(
        "id", F.concat(F.lit("New "), "id").alias("title"), "scraped_at", (F.col("word_count") + 1).alias("word_count")
    )
    for _ in range(2):  # a repeat changes nothing
        merge.upsert_by_day(new, path, "scraped_at", ["id"], ["title", "scraped_at"], ["word_count"])
    return m.spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))


@query("s10_observed_write", """
SELECT count(*) AS articles_found, count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS articles_added, count(*) FILTER (WHERE event_type = 'click') AS articles_updated,
  count(*) FILTER (WHERE event_type = 'view') AS articles_skipped, count(*) FILTER (WHERE event_type = 'error') AS error_count FROM events""")
def _(m):
    """Figures of a run taken from the write of its rows."""
    kinds = F.create_map(*[F.lit(x) for x in ("purchase", "added", "signup", "added", "click", "updated", "view", "skipped", "error", "error")])
    rows = m.raw("events").select("event_id", kinds[F.col("event_type")].alias("outcome"))
    found = merge.write_observed(rows, merge.outcome_figures(), lambda out: out.write.mode("overwrite").parquet(scratch(m, "outcomes")))
    return m.spark.createDataFrame([found])


@query("s9_rewrite_changed", f"SELECT id, {sql_squash('title')} AS title FROM articles WHERE title <> {sql_squash('title')}")
def _(m):
    return merge.rewrite_changed(m.articles.select("id", "title"), {"title": tx.squash(F.col("title"))})


@query("s10_run_metrics", """
SELECT user_id AS run_id, count(*) AS articles_found, count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS articles_added, count(*) FILTER (WHERE event_type = 'click') AS articles_updated,
  count(*) FILTER (WHERE event_type = 'view') AS articles_skipped, count(*) FILTER (WHERE event_type = 'error') AS error_count,
  CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0) AS BIGINT) AS duration_seconds,
  CASE WHEN count(*) = count(*) FILTER (WHERE event_type = 'error') THEN 'failed' ELSE 'completed' END AS status FROM events GROUP BY 1""")
def _(m):
    kinds = F.create_map(*[F.lit(x) for x in ("purchase", "added", "signup", "added", "click", "updated", "view", "skipped", "error", "error")])
    outcomes = m.raw("events").select(F.col("user_id").alias("run_id"), kinds[F.col("event_type")].alias("outcome"), F.col("ts").cast("timestamp").alias("at"))
    return merge.run_metrics(outcomes).drop("started_at", "completed_at")


@query("j1_lookup_join", "SELECT a.id, coalesce(importance_score, -1) AS importance, status FROM articles a LEFT JOIN enrichments e ON e.article_id = a.id")
def _(m):
    notes = m.enrichments.withColumnRenamed("article_id", "id")
    return joins.lookup_join(m.articles.select("id"), notes, "id", {"importance_score": "importance", "status": "status"})


@query("j2_nest_children", """
WITH r AS (SELECT article_id, id, row_number() OVER (PARTITION BY article_id ORDER BY sent_at DESC, id) AS k FROM notifications)
SELECT a.id, coalesce(string_agg(CAST(r.id AS VARCHAR), ',' ORDER BY k), '') AS children FROM articles a LEFT JOIN r ON r.article_id = a.id AND k <= 5 GROUP BY a.id""")
def _(m):
    nested = joins.nest_children(
        m.articles.select("id"), m.notifications.withColumn("child_id", F.col("id")), "article_id", ["child_id"], [F.desc("sent_at"), F.asc("child_id")], 5
    )
    return nested.select("id", F.array_join(F.transform("children", lambda c: c["child_id"].cast("string")), ",").alias("children"))


@query("j3_semi_join", "SELECT user_id, token FROM push_tokens WHERE user_id IN (SELECT user_id FROM history)")
def _(m):
    return joins.semi_join(m.push_tokens, m.history, ["user_id"]).select("user_id", "token")


@query("j4_anti_join", f"""
SELECT user_id, article_id FROM (SELECT DISTINCT user_id, article_id FROM views) v
WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.user_id = v.user_id AND h.article_id = v.article_id AND sent_at >= {AS_OF_SQL} - to_days(14))""")
def _(m):
    pairs = m.views.select("user_id", "article_id").distinct()
    return joins.anti_join(pairs, m.history, ["user_id", "article_id"], feeds.hours_before(m.as_of, 336), "sent_at")


@query("j5_bridge_join", "SELECT id FROM articles WHERE list_has_any(tags, (SELECT list('t' || id) FROM categories WHERE name LIKE 'b%'))")
def _(m):
    wanted = m.categories.filter("name LIKE 'b%'").select(F.concat(F.lit("t"), "id").alias("tag"))
    return joins.bridge_join(m.articles, "tags", wanted, "tag").select("id")


@query("j6_overlap_top_n", """
WITH done AS (SELECT * FROM enrichments WHERE status = 'completed'),
pairs AS (SELECT s.article_id AS seed_id, c.article_id AS id, c.importance_score FROM enrichments s JOIN done c ON c.article_id <> s.article_id AND list_has_any(c.related_themes, s.related_themes))
SELECT seed_id, id, importance_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY importance_score DESC, id DESC) AS rank FROM pairs) WHERE rank <= 3""")
def _(m):
    rows = m.enrichments.select(F.col("article_id").alias("id"), F.col("related_themes").alias("keys"), "importance_score", "status")
    order = [F.desc("importance_score"), F.desc("id")]
    return feeds.overlap_top_n(rows, rows.filter("status = 'completed'"), [F.col("importance_score")], order, 3)


@query("j8_id_map_join", """
SELECT h.user_id, coalesce(string_agg(a.id || ':' || category_id, ',' ORDER BY h.id) FILTER (WHERE a.id IS NOT NULL), '') AS items FROM history h
LEFT JOIN (SELECT * FROM articles WHERE has_full_content) a ON a.id = h.article_id GROUP BY h.user_id""")
def _(m):
    lists = m.history.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", "article_id"))), lambda x: x["article_id"]).alias("ids")
    )
    mapped = joins.id_map_join(lists, "user_id", "ids", m.articles.filter("has_full_content"), ["category_id"])
    shown = F.transform("items", lambda x: F.concat(x["id"], F.lit(":"), x["category_id"]))
    return mapped.select("user_id", F.array_join(shown, ",").alias("items"))


@query("j9_thread_tree", """
WITH RECURSIVE tree AS (SELECT id, article_id, id AS root_id, 0 AS depth, CAST(id AS VARCHAR) AS path FROM comments WHERE parent_id IS NULL AND is_approved
  UNION ALL SELECT c.id, c.article_id, t.root_id, t.depth + 1, t.path || '/' || c.id FROM comments c JOIN tree t ON c.parent_id = t.id WHERE c.is_approved)
SELECT id, article_id, root_id, depth, path FROM tree""")
def _(m):
    return joins.thread_tree(m.comments).withColumn("path", F.array_join("path", "/"))


@query("u1_union_ranked", """
WITH every AS (SELECT article_id AS id, 0.9::DOUBLE AS confidence, 'alert' AS kind FROM alerts UNION ALL SELECT article_id, relevance_score, 'story' FROM story_articles
  UNION ALL SELECT id, 0.7, 'breaking' FROM breaking_news)
SELECT id, confidence, kind FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, kind) AS r FROM every) WHERE r = 1""")
def _(m):
    streams = [
        m.alerts.select(F.col("article_id").alias("id"), F.lit(0.9).alias("confidence"), F.lit("alert").alias("kind")),
        m.story_articles.select(F.col("article_id").alias("id"), F.col("relevance_score").alias("confidence"), F.lit("story").alias("kind")),
        m.breaking_news.select("id", F.lit(0.7).alias("confidence"), F.lit("breaking").alias("kind")),
    ]
    return sets.union_ranked(streams, "id", [F.desc("confidence"), F.asc("kind")])


@query("u2_union_ids", "SELECT id FROM breaking_news UNION SELECT article_id FROM alerts UNION SELECT article_id FROM views")
def _(m):
    as_id = lambda df: df.select(F.col("article_id").alias("id"))
    return sets.union_ids([m.breaking_news, as_id(m.alerts), as_id(m.views)])


@query("u3_union_filters", "SELECT id FROM mentions WHERE normalized_name IN ('entity 1', 'entity 2') OR entity_type = 'person'")
def _(m):
    return sets.union_filters(m.mentions, F.col("normalized_name").isin("entity 1", "entity 2"), F.col("entity_type") == "person").select("id")


@query("u4_union_limited", """
(SELECT 1 AS part, title AS label FROM articles ORDER BY scraped_at DESC, id DESC LIMIT 5) UNION ALL (SELECT 2, name FROM categories ORDER BY name LIMIT 2)
UNION ALL (SELECT 3, name FROM sources ORDER BY name LIMIT 2)""")
def _(m):
    heads = sets.union_limited([
        (m.articles.select(F.col("title").alias("label"), "scraped_at", "id"), freshness_order(), 5),
        (m.categories.select(F.col("name").alias("label"), F.lit(None).cast("timestamp").alias("scraped_at"), F.col("id").cast("bigint").alias("id")), [F.asc("label")], 2),
        (m.sources.select(F.col("name").alias("label"), F.lit(None).cast("timestamp").alias("scraped_at"), F.col("id").cast("bigint").alias("id")), [F.asc("label")], 2),
    ])
    return heads.select("part", "label")


@query("u5_top_up", f"SELECT id, CASE WHEN importance_score >= 9 THEN 0 ELSE 1 END AS tier FROM {NEWS} ORDER BY tier, {INTEL} LIMIT 200")
def _(m):
    from pressline.operators.ranking import intelligence_order

    return sets.top_up(news(m), F.col("importance_score") >= 9, intelligence_order(), 200).select("id", "tier")


@query("u6_difference", "SELECT DISTINCT article_id AS id FROM history EXCEPT SELECT id FROM articles WHERE has_full_content")
def _(m):
    return sets.difference(m.history.select(F.col("article_id").alias("id")), m.articles.filter("has_full_content"), "id")


@query("u7_jaccard_sets", """
SELECT article_id, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS jaccard
FROM (SELECT article_id, themes AS a, ['health', 'crime', 'economy'] AS b FROM enrichments)""")
def _(m):
    rows = m.enrichments.withColumn("b", F.array(F.lit("health"), F.lit("crime"), F.lit("economy")))
    return sets.jaccard_sets(rows, "themes", "b").select("article_id", F.round("jaccard", 6).alias("jaccard"))


@query("m1_retain_notifications", f"SELECT id, sent_at FROM notifications WHERE sent_at >= {AS_OF_SQL} - to_days(14)")
def _(m):
    return maintenance.retain(m.notifications, "sent_at", m.as_of, 14).select("id", "sent_at")


@query("m1_retain_by_day", f"SELECT id, sent_at FROM notifications WHERE sent_at >= {AS_OF_SQL} - to_days(14)")
def _(m):
    """The same rows on a table laid out by day, of which only old days are touched."""
    path = scratch(m, "notifications")
    merge.write_by_day(m.notifications.select("id", "sent_at"), path, "sent_at")
    merge.retain_by_day(m.spark, path, "sent_at", datetime.fromisoformat(AS_OF) - timedelta(days=14))
    return m.spark.read.parquet(path).select("id", "sent_at")


@query("m1_retain_finished_runs", f"""
SELECT run_id, status, count(*) AS n FROM scrape_runs WHERE NOT (started_at < {AS_OF_SQL} - to_days(14) AND status IN ('completed', 'failed')) GROUP BY ALL""")
def _(m):
    kept = maintenance.retain(m.scrape_runs, "started_at", m.as_of, 14, F.col("status").isin("completed", "failed"))
    return kept.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("m2_drop_incomplete", f"SELECT id FROM articles WHERE has_full_content OR scraped_at > {AS_OF_SQL} - to_hours(72)")
def _(m):
    return maintenance.drop_incomplete(m.articles, m.as_of, older_than_hours=72).select("id")


@query("m2_incomplete_limited", "SELECT id FROM articles WHERE NOT has_full_content ORDER BY scraped_at, id LIMIT 20")
def _(m):
    return maintenance.incomplete(m.articles, m.as_of, limit=20).select("id")


def untidy(m: Model):
    """Articles as a careless scraper would store them: entities, odd quotes and blanks."""
    return m.articles.withColumn(
        "content", F.when(F.col("id") % 3 == 0, F.concat(F.lit("&amp;quot;‘ "), "content", F.lit(" —​  x \r\n\n\n\n y&#39;"))).otherwise(F.col("content"))
    ).select("id", "source_id", "url", "external_id", tx.squash(F.col("title")).alias("title"), F.lit("").alias("excerpt"), "content")


@query("t1_clean_text", f"""
SELECT id, {sql_strip("regexp_replace(regexp_replace(regexp_replace(c, '[ ]+', ' ', 'g'), ' *(?:' || chr(13) || chr(10) || '|' || chr(13) || '|' || chr(10) || ') *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS clean,
  {sql_squash("c")} AS line FROM (SELECT id, CASE WHEN id % 3 = 0 THEN '"'' ' || content || ' -  x ' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || ' y''' ELSE content END AS c FROM articles)""")
def _(m):
    rows = untidy(m)
    return rows.select("id", tx.clean_text(F.col("content")).alias("clean"), tx.clean_text(F.col("content"), False).alias("line"))


@query("m3_clean_corpus", f"""
WITH c AS (SELECT id, {sql_squash('title')} AS title, CASE WHEN id % 3 = 0 THEN '"'' ' || content || ' -  x ' || chr(10) || chr(10) || ' y''' ELSE content END AS c, content AS old FROM articles),
d AS (SELECT id, title, id % 3 = 0 AS untidy, old, {sql_strip("regexp_replace(regexp_replace(regexp_replace(c, '[ ]+', ' ', 'g'), ' *' || chr(10) || ' *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS content FROM c)
SELECT id, {sql_hash('content')} AS content_hash, {sql_hash(sql_title('title'))} AS normalized_title_hash,
  len(list_filter(regexp_split_to_array(content, '{WS}+'), lambda w: w <> '')) AS word_count FROM d WHERE untidy OR content <> old""")
def _(m):
    return maintenance.clean_corpus(untidy(m)).select("id", "content_hash", "normalized_title_hash", "word_count")


@query("m4_strip_cues_corpus", f"""
WITH own AS (SELECT id, {sql_squash('content')} AS line, content FROM articles WHERE source_id = 3 AND content <> '')
SELECT id, line || chr(10) || chr(10) || 'Last words' AS content, len(string_split(line, ' ')) + 2 AS word_count FROM own""")
def _(m):
    marked = m.articles.withColumn(
        "content", F.concat("content", F.lit("//Cue in: 'they say\n\n more'//\n\n"), F.lit("Last words\nCue out : 'no'"))
    )
    return maintenance.strip_cues_corpus(marked, 3).select("id", "content", "word_count")


@query("u3_merge_filter_report", """
SELECT entity_type, count(*) AS n FROM mentions WHERE lower(entity_name) LIKE 'entity 1%' OR sentiment_score > 0.5 GROUP BY 1""")
def _(m):
    kept = sets.union_filters(m.mentions, F.lower("entity_name").startswith("entity 1"), F.col("sentiment_score") > 0.5)
    return kept.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
