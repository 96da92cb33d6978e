"""The article model built from the given test tables, in Spark and in SQL.

Every derived column uses the same formula on both sides, so that a query and its
SQL counterpart start from equal rows. Derived values are synthetic test data; the
operators do not depend on them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressline.session import prepare

AS_OF = "2024-01-31 00:00:00"
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
THEMES = [
    "governance", "education", "health", "economy", "entertainment", "sports", "crime", "environment",
    "technology", "politics", "social", "business", "infrastructure", "agriculture", "tourism",
]
CATEGORIES = ["politics", "business", "sports", "health", "breaking", "technology", "culture"]
SCREENS = ["mobile", "tablet", "desktop", "tv"]
QUALITIES = ["low", "medium", "high"]


def _array(values):
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


class Model:
    """Lazily built model tables over one folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder
        self.as_of = F.lit(AS_OF).cast("timestamp")  # read in the session time zone, UTC

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def n_documents(self) -> int:
        return self.raw("documents").count()

    @cached_property
    def articles(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "doc_id AS id",
            "cast(substr(source, 4) AS int) AS source_id",
            "cast(doc_id % 7 AS int) AS category_id",
            "cast(doc_id % 23 AS int) AS author_id",
            "concat('post-', doc_id % 180) AS external_id",
            "concat('http://www.Wire.example/story-', doc_id % 950,"
            " CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '?utm_source=feed' ELSE '#top' END) AS url",
            "substr(text, 1, 80) AS title",
            "substr(text, 1, 200) AS excerpt",
            "text AS content",
            "cast(length(text) - length(replace(text, ' ', '')) + 1 AS int) AS word_count",
            "length(text) - length(replace(text, ' ', '')) + 1 >= 80 AS has_full_content",
            f"cast({AS_OF_SQL} - make_dt_interval(0, 0, cast(doc_id * 37 % 43200 AS int)) AS timestamp) AS scraped_at",
            f"cast({AS_OF_SQL} - make_dt_interval(0, cast(doc_id % 48 AS int), cast(doc_id * 37 % 43200 AS int)) AS timestamp) AS published_at",
            "CASE WHEN doc_id % 5 = doc_id % 3 THEN array(concat('t', doc_id % 5))"
            " ELSE array(concat('t', doc_id % 5), concat('t', doc_id % 3)) END AS tags",
            "CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('https://img.example/', doc_id, '.jpg') END AS image_url",
            "doc_id % 9 = 0 AS is_processed",
        )

    @cached_property
    def sources(self) -> DataFrame:
        ids = self.raw("documents").selectExpr("cast(substr(source, 4) AS int) AS id").distinct()
        return ids.selectExpr(
            "id", "concat('Source ', id) AS name", "id % 10 <> 9 AS is_active",
            "concat('https://source', id, '.example') AS base_url",
        )

    @cached_property
    def categories(self) -> DataFrame:
        ids = self.raw("documents").selectExpr("cast(doc_id % 7 AS int) AS id").distinct()
        return ids.selectExpr("id", f"element_at({_array(CATEGORIES)}, id + 1) AS name")

    @cached_property
    def authors(self) -> DataFrame:
        ids = self.raw("documents").selectExpr("cast(doc_id % 23 AS int) AS id").distinct()
        return ids.selectExpr("id", "concat('Author ', id) AS name")

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.raw("embeddings").selectExpr("vec_id AS article_id", "embedding", "label")

    @cached_property
    def vectors(self) -> DataFrame:
        """The embeddings with dimensions that count less and less, as in vectors of text models.

        All dimensions take part; independent ones alone would leave no two articles similar.
        """
        scaled = "transform(embedding, (x, i) -> cast(x AS double) / (i + 1))"
        return self.raw("embeddings").selectExpr("vec_id AS article_id", f"{scaled} AS embedding")

    @cached_property
    def enrichments(self) -> DataFrame:
        docs = self.raw("documents")
        labels = self.raw("labels")
        joined = docs.join(labels, "doc_id", "left")
        themes = _array(THEMES)
        return joined.selectExpr(
            "doc_id AS article_id",
            "CASE WHEN doc_id % 11 = 0 THEN 'failed' WHEN doc_id % 7 = 0 THEN 'pending'"
            " WHEN doc_id % 31 = 0 THEN 'processing' ELSE 'completed' END AS status",
            "cast(1 + doc_id * 7 % 10 AS int) AS importance_score",
            "(doc_id * 13 % 201 - 100) / 100.0D AS sentiment_score",
            "CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment",
            "doc_id % 29 = 0 AS is_breaking_candidate",
            "doc_id % 5 = 0 AS follow_up_worthy",
            f"array_distinct(array(element_at({themes}, cast(doc_id % 15 AS int) + 1),"
            f" element_at({themes}, cast(doc_id * 7 % 15 AS int) + 1))) AS themes",
            "CASE WHEN doc_id % 3 = 0 THEN array(concat('arc-', doc_id % 37), concat('arc-', doc_id % 53 + 100))"
            " WHEN doc_id % 3 = 1 THEN array(concat('arc-', doc_id % 37)) ELSE cast(array() AS array<string>) END AS related_themes",
            "concat('Summary of article ', doc_id, '.') AS summary",
            "CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('Neutral title ', doc_id) END AS neutral_title",
            "array(concat('fact a ', doc_id), '', concat('fact b ', doc_id), concat('fact c ', doc_id), concat('fact d ', doc_id)) AS key_facts",
            "CASE WHEN doc_id % 6 = 0 THEN concat('Impact ', doc_id) ELSE '' END AS impact_note",
            "CASE WHEN doc_id % 8 = 0 THEN array(concat('Note ', doc_id)) ELSE cast(array() AS array<string>) END AS bias_notes",
            "array(concat('Entity ', doc_id % 50)) AS entities_people",
            "array(concat('Entity ', doc_id * 2 % 50)) AS entities_organizations",
            "array(concat('Entity ', doc_id * 3 % 50)) AS entities_locations",
            f"cast({AS_OF_SQL} - make_dt_interval(0, -1, cast(doc_id * 37 % 43200 AS int)) AS timestamp) AS analyzed_at",
            "cast(100 + doc_id % 900 AS int) AS input_tokens",
            "cast(50 + doc_id % 300 AS int) AS output_tokens",
            "element_at(array('gpt-4o-mini', 'gpt-4o', 'gpt-5-nano'), cast(doc_id % 3 AS int) + 1) AS model_used",
            "cast(doc_id % 4 AS int) AS retry_count",
        )

    @cached_property
    def mentions(self) -> DataFrame:
        rows = self.raw("documents").selectExpr(
            "doc_id", "(doc_id * 13 % 201 - 100) / 100.0D AS sentiment_score",
            f"cast({AS_OF_SQL} - make_dt_interval(0, cast(doc_id % 48 AS int), cast(doc_id * 37 % 43200 AS int)) AS date) AS mention_date",
            "explode(array(1, 2, 3)) AS k",
        )
        return rows.selectExpr(
            "doc_id * 10 + k AS id", "doc_id AS article_id",
            "concat('Entity ', doc_id * k % 50) AS entity_name",
            "concat('entity ', doc_id * k % 50) AS normalized_name",
            "element_at(array('person', 'organization', 'location'), k) AS entity_type",
            "mention_date", "sentiment_score",
        )

    @cached_property
    def views(self) -> DataFrame:
        return self.raw("events").filter("event_type = 'view'").selectExpr(
            "event_id AS id", "user_id", f"event_id % {self.n_documents} AS article_id",
            "cast(ts AS timestamp) AS viewed_at", "value AS duration_seconds",
        )

    @cached_property
    def profiles(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS user_id", "array(c_nationkey % 7) AS preferred_categories",
            "CASE WHEN c_custkey % 3 = 0 THEN array(c_nationkey % 20) ELSE cast(array() AS array<int>) END AS followed_sources",
        )

    @cached_property
    def push_tokens(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS user_id", "concat('tok-', c_custkey) AS token",
            "element_at(array('ios', 'android', ''), cast(c_custkey % 3 AS int) + 1) AS platform",
            "c_custkey % 4 <> 0 AS is_active",
        )

    @cached_property
    def schedules(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS id", "c_custkey AS user_id",
            "CASE WHEN c_custkey % 2 = 0 THEN 'daily' ELSE 'weekly' END AS frequency",
            "cast(c_custkey * 7 % 1440 AS int) AS scheduled_minutes", "c_custkey % 5 <> 0 AS is_active",
            f"cast({AS_OF_SQL} + make_dt_interval(0, 0, cast(c_custkey * 13 % 2880 AS int) - 1440) AS timestamp) AS next_send_at",
            f"CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE cast({AS_OF_SQL} - make_dt_interval(0, cast(c_custkey % 72 AS int)) AS timestamp) END AS last_sent_at",
            "cast(1 + c_custkey % 5 AS int) AS max_articles",
            "CASE WHEN c_custkey % 4 = 0 THEN array(cast(c_custkey % 7 AS int)) ELSE cast(array() AS array<int>) END AS include_categories",
            "CASE WHEN c_custkey % 10 = 1 THEN array(cast(c_custkey % 20 AS int), 3) ELSE cast(array() AS array<int>) END AS include_sources",
        )

    @cached_property
    def history(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS id", "o_custkey AS user_id", f"o_orderkey % {self.n_documents} AS article_id",
            f"cast({AS_OF_SQL} - make_dt_interval(0, 0, cast(o_orderkey * 11 % 43200 AS int)) AS timestamp) AS sent_at",
        )

    @cached_property
    def notifications(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS id", "o_custkey AS user_id", f"o_orderkey % {self.n_documents} AS article_id",
            f"cast({AS_OF_SQL} - make_dt_interval(0, 0, cast(o_orderkey * 11 % 43200 AS int)) AS timestamp) AS sent_at",
            "o_orderstatus = 'F' AS is_read",
            "CASE WHEN o_orderpriority LIKE '1%' THEN 'breaking_news' WHEN o_orderpriority LIKE '2%' THEN 'story_alert'"
            " ELSE 'scheduled_digest' END AS notification_type",
        )

    @cached_property
    def breaking_news(self) -> DataFrame:
        """Every article of the ``breaking`` category, newest id first, some already sent."""
        return self.raw("documents").filter("doc_id % 7 = 4").selectExpr(
            "doc_id AS id", "doc_id AS article_id",
            "element_at(array('low', 'medium', 'high', 'critical'), cast(doc_id % 4 AS int) + 1) AS priority",
            "doc_id % 3 = 0 AS is_sent",
            f"cast({AS_OF_SQL} - make_dt_interval(0, 0, cast(doc_id * 37 % 43200 AS int)) AS timestamp) AS created_at",
            "CASE WHEN doc_id % 2 = 0 THEN array(cast(doc_id % 5 AS int)) ELSE cast(array() AS array<int>) END AS target_categories",
            "CASE WHEN doc_id % 5 = 0 THEN array(cast(doc_id % 20 AS int)) ELSE cast(array() AS array<int>) END AS target_sources",
        )

    @cached_property
    def comments(self) -> DataFrame:
        return self.raw("conversations").selectExpr(
            "conv_id * 1000 + turn AS id", "conv_id AS article_id", "conv_id % 100 + turn AS user_id",
            "CASE WHEN turn = 0 THEN NULL ELSE conv_id * 1000 + turn - 1 END AS parent_id",
            "text AS content", "turn % 7 <> 6 AS is_approved",
        )

    @cached_property
    def scrape_runs(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey * 10 + l_linenumber AS run_id", "cast(l_suppkey % 20 AS int) AS source_id",
            f"cast({AS_OF_SQL} - make_dt_interval(0, 0, cast((l_orderkey * 17 + l_partkey) % 43200 AS int)) AS timestamp) AS started_at",
            "cast(l_quantity AS int) AS duration_minutes",
            "CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'started' END AS status",
            "cast(l_quantity AS int) AS articles_found", "cast(l_quantity / 2 AS int) AS articles_added",
            "cast(l_partkey % 5 AS int) AS articles_updated", "cast(l_linenumber AS int) - 1 AS error_count",
        )

    @cached_property
    def story_articles(self) -> DataFrame:
        """Story membership: 200 consecutive vectors per label form one story each."""
        docs = self.raw("documents").selectExpr("doc_id AS article_id")
        links = self.raw("embeddings").selectExpr(
            "cast(label + 10 * floor(vec_id / 200) AS bigint) AS story_id", "vec_id AS article_id",
            "0.5D + (vec_id % 50) / 100.0D AS relevance_score",
        )
        return links.join(docs, "article_id", "left_semi")

    @cached_property
    def stories(self) -> DataFrame:
        """One row per story; dates, importance and centroid come from its members."""
        member = self.story_articles.join(
            self.articles.select(F.col("id").alias("article_id"), "published_at"), "article_id"
        )
        base = member.groupBy("story_id").agg(
            F.min("published_at").alias("first_seen_at"), F.max("published_at").alias("last_seen_at")
        )
        themes = _array(THEMES)
        return base.selectExpr(
            "story_id AS id", "concat('Story ', story_id) AS title", "concat('story-', story_id) AS slug",
            "CASE WHEN story_id % 4 = 0 THEN '' ELSE concat('Short summary of story ', story_id) END AS short_summary",
            "concat('Overview of story ', story_id) AS overview",
            "CASE WHEN story_id % 3 = 0 THEN concat('Why story ', story_id, ' matters') ELSE '' END AS why_this_matters",
            f"element_at({themes}, cast(story_id % 15 AS int) + 1) AS primary_theme",
            "cast(1 + story_id * 3 % 10 AS int) AS importance_score",
            "CASE WHEN story_id % 5 = 4 THEN 'dormant' ELSE 'active' END AS status",
            "cast(story_id % 3 AS int) AS version", "cast(story_id % 6 AS int) AS articles_at_synthesis",
            "cast(story_id % 4 AS int) AS eli5_version",
            "array(concat('Entity ', story_id % 50), concat('Entity ', story_id % 7)) AS entities",
            "first_seen_at", "last_seen_at",
        )

    @cached_property
    def story_relations(self) -> DataFrame:
        return self.stories.filter("id >= 10").selectExpr(
            "id AS from_story_id", "id - 10 AS to_story_id",
            "CASE WHEN id % 2 = 0 THEN 'related' ELSE 'follow_up' END AS relation_type",
        )

    @cached_property
    def alerts(self) -> DataFrame:
        return self.story_articles.filter("article_id % 6 = 0").selectExpr(
            "article_id AS id", "story_id", "article_id",
            "element_at(array('pending', 'sent', 'suppressed'), cast(article_id / 6 % 3 AS int) + 1) AS status",
            "cast(1 + article_id * 3 % 10 AS int) AS importance_score",
            "concat('Alert ', article_id) AS title", "concat('Reason ', article_id) AS reason",
            f"cast({AS_OF_SQL} - make_dt_interval(0, 0, cast(article_id * 7 % 5000 AS int)) AS timestamp) AS created_at",
        )

    @cached_property
    def subscribers(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS id", "concat('user', c_custkey, '@mail.example') AS email",
            "c_custkey % 6 <> 0 AS is_active", "c_custkey % 5 <> 0 AS confirmed",
            "element_at(array('morning', 'evening', 'morning_evening'), cast(c_custkey % 3 AS int) + 1) AS frequency",
            "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE date_sub(DATE '2024-01-31', cast(c_custkey % 2 AS int)) END AS last_digest_date",
            "element_at(array('', 'midday', 'evening'), cast(c_custkey % 7 % 3 AS int) + 1) AS last_slot_sent",
        )

    @cached_property
    def video_views(self) -> DataFrame:
        return self.raw("events").filter("event_type IN ('view', 'click')").selectExpr(
            "event_id AS id", "event_id % 40 AS video_id",
            "CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id END AS user_id",
            "concat('s', user_id) AS session_id", "cast(value AS int) AS watch_seconds",
            f"element_at({_array(SCREENS)}, cast(event_id % 4 AS int) + 1) AS device_type",
            f"CASE WHEN event_id % 17 = 0 THEN '' ELSE element_at({_array(QUALITIES)}, cast(event_id % 3 AS int) + 1) END AS quality_watched",
            "cast(value / 2 AS int) AS last_position_seconds",
            "cast(ts AS timestamp) AS started_at",
        )

    @cached_property
    def videos(self) -> DataFrame:
        ids = self.raw("events").selectExpr("event_id % 40 AS id").distinct()
        return ids.selectExpr(
            "id", "concat('Video ', id) AS title", "concat('About video ', id) AS description",
            "cast(60 + 10 * id AS int) AS duration_seconds",
            "element_at(array('ready', 'ready', 'ready', 'processing', 'pending', 'failed'), cast(id % 6 AS int) + 1) AS status",
            "id % 8 <> 7 AS is_active", "id % 5 = 0 AS is_featured", "id % 10 AS uploaded_by",
            f"cast({AS_OF_SQL} - make_dt_interval(0, cast(id * 3 AS int)) AS timestamp) AS created_at",
        )

    @cached_property
    def video_queue(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS id", "o_orderkey % 40 AS video_id",
            "element_at(array('low', 'normal', 'high', 'urgent'), cast(o_orderkey % 4 AS int) + 1) AS priority",
            "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'completed' ELSE 'processing' END AS status",
            f"cast({AS_OF_SQL} - make_dt_interval(0, 0, cast(o_orderkey * 11 % 43200 AS int)) AS timestamp) AS queued_at",
        )


SQL_TABLES = {
    "articles": f"""
  SELECT doc_id AS id, CAST(substr(source, 4) AS INTEGER) AS source_id, CAST(doc_id % 7 AS INTEGER) AS category_id,
    CAST(doc_id % 23 AS INTEGER) AS author_id, 'post-' || (doc_id % 180) AS external_id,
    'http://www.Wire.example/story-' || (doc_id % 950) || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/'
      WHEN 2 THEN '?utm_source=feed' ELSE '#top' END AS url,
    substr(text, 1, 80) AS title, substr(text, 1, 200) AS excerpt, text AS content,
    CAST(length(text) - length(replace(text, ' ', '')) + 1 AS INTEGER) AS word_count,
    length(text) - length(replace(text, ' ', '')) + 1 >= 80 AS has_full_content,
    {AS_OF_SQL} - to_minutes(doc_id * 37 % 43200) AS scraped_at,
    {AS_OF_SQL} - to_minutes(doc_id * 37 % 43200) - to_hours(doc_id % 48) AS published_at,
    CASE WHEN doc_id % 5 = doc_id % 3 THEN ['t' || (doc_id % 5)] ELSE ['t' || (doc_id % 5), 't' || (doc_id % 3)] END AS tags,
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'https://img.example/' || doc_id || '.jpg' END AS image_url,
    doc_id % 9 = 0 AS is_processed
  FROM documents""",
    "sources": """
  SELECT DISTINCT source_id AS id, 'Source ' || source_id AS name, source_id % 10 <> 9 AS is_active,
    'https://source' || source_id || '.example' AS base_url FROM articles""",
    "categories": f"""
  SELECT DISTINCT category_id AS id, ({_list(CATEGORIES)})[category_id + 1] AS name FROM articles""",
    "authors": "SELECT DISTINCT author_id AS id, 'Author ' || author_id AS name FROM articles",
    "vectors": "SELECT vec_id AS article_id, [CAST(embedding[i] AS DOUBLE) / i FOR i IN range(1, len(embedding) + 1)] AS embedding FROM embeddings",
    "enrichments": f"""
  SELECT d.doc_id AS article_id,
    CASE WHEN d.doc_id % 11 = 0 THEN 'failed' WHEN d.doc_id % 7 = 0 THEN 'pending' WHEN d.doc_id % 31 = 0 THEN 'processing' ELSE 'completed' END AS status,
    CAST(1 + d.doc_id * 7 % 10 AS INTEGER) AS importance_score, (d.doc_id * 13 % 201 - 100) / 100.0::DOUBLE AS sentiment_score,
    CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment,
    d.doc_id % 29 = 0 AS is_breaking_candidate, d.doc_id % 5 = 0 AS follow_up_worthy,
    CASE WHEN d.doc_id % 15 = d.doc_id * 7 % 15 THEN [({_list(THEMES)})[d.doc_id % 15 + 1]]
      ELSE [({_list(THEMES)})[d.doc_id % 15 + 1], ({_list(THEMES)})[d.doc_id * 7 % 15 + 1]] END AS themes,
    CASE WHEN d.doc_id % 3 = 0 THEN ['arc-' || (d.doc_id % 37), 'arc-' || (d.doc_id % 53 + 100)]
      WHEN d.doc_id % 3 = 1 THEN ['arc-' || (d.doc_id % 37)] ELSE CAST([] AS VARCHAR[]) END AS related_themes,
    'Summary of article ' || d.doc_id || '.' AS summary,
    CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE 'Neutral title ' || d.doc_id END AS neutral_title,
    ['fact a ' || d.doc_id, '', 'fact b ' || d.doc_id, 'fact c ' || d.doc_id, 'fact d ' || d.doc_id] AS key_facts,
    CASE WHEN d.doc_id % 6 = 0 THEN 'Impact ' || d.doc_id ELSE '' END AS impact_note,
    CASE WHEN d.doc_id % 8 = 0 THEN ['Note ' || d.doc_id] ELSE CAST([] AS VARCHAR[]) END AS bias_notes,
    ['Entity ' || (d.doc_id % 50)] AS entities_people, ['Entity ' || (d.doc_id * 2 % 50)] AS entities_organizations,
    ['Entity ' || (d.doc_id * 3 % 50)] AS entities_locations,
    {AS_OF_SQL} - to_minutes(d.doc_id * 37 % 43200) + to_hours(1) AS analyzed_at,
    CAST(100 + d.doc_id % 900 AS INTEGER) AS input_tokens, CAST(50 + d.doc_id % 300 AS INTEGER) AS output_tokens,
    (['gpt-4o-mini', 'gpt-4o', 'gpt-5-nano'])[d.doc_id % 3 + 1] AS model_used, CAST(d.doc_id % 4 AS INTEGER) AS retry_count
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "mentions": """
  SELECT id * 10 + k AS id, id AS article_id, 'Entity ' || (id * k % 50) AS entity_name, 'entity ' || (id * k % 50) AS normalized_name,
    (['person', 'organization', 'location'])[k] AS entity_type, CAST(published_at AS DATE) AS mention_date,
    (id * 13 % 201 - 100) / 100.0::DOUBLE AS sentiment_score
  FROM articles, (SELECT unnest([1, 2, 3]) AS k)""",
    "views": """
  SELECT event_id AS id, user_id, event_id % (SELECT count(*) FROM documents) AS article_id, ts AS viewed_at, value AS duration_seconds
  FROM events WHERE event_type = 'view'""",
    "profiles": """
  SELECT c_custkey AS user_id, [c_nationkey % 7] AS preferred_categories,
    CASE WHEN c_custkey % 3 = 0 THEN [c_nationkey % 20] ELSE CAST([] AS INTEGER[]) END AS followed_sources FROM customer""",
    "push_tokens": """
  SELECT c_custkey AS user_id, 'tok-' || c_custkey AS token, (['ios', 'android', ''])[c_custkey % 3 + 1] AS platform,
    c_custkey % 4 <> 0 AS is_active FROM customer""",
    "schedules": f"""
  SELECT c_custkey AS id, c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'daily' ELSE 'weekly' END AS frequency,
    CAST(c_custkey * 7 % 1440 AS INTEGER) AS scheduled_minutes, c_custkey % 5 <> 0 AS is_active,
    {AS_OF_SQL} + to_minutes(c_custkey * 13 % 2880 - 1440) AS next_send_at,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE {AS_OF_SQL} - to_hours(c_custkey % 72) END AS last_sent_at,
    CAST(1 + c_custkey % 5 AS INTEGER) AS max_articles,
    CASE WHEN c_custkey % 4 = 0 THEN [CAST(c_custkey % 7 AS INTEGER)] ELSE CAST([] AS INTEGER[]) END AS include_categories,
    CASE WHEN c_custkey % 10 = 1 THEN [CAST(c_custkey % 20 AS INTEGER), 3] ELSE CAST([] AS INTEGER[]) END AS include_sources
  FROM customer""",
    "history": f"""
  SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey % (SELECT count(*) FROM documents) AS article_id,
    {AS_OF_SQL} - to_minutes(o_orderkey * 11 % 43200) AS sent_at FROM orders""",
    "notifications": f"""
  SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey % (SELECT count(*) FROM documents) AS article_id,
    {AS_OF_SQL} - to_minutes(o_orderkey * 11 % 43200) AS sent_at, o_orderstatus = 'F' AS is_read,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'breaking_news' WHEN o_orderpriority LIKE '2%' THEN 'story_alert'
      ELSE 'scheduled_digest' END AS notification_type FROM orders""",
    "breaking_news": f"""
  SELECT doc_id AS id, doc_id AS article_id, (['low', 'medium', 'high', 'critical'])[doc_id % 4 + 1] AS priority, doc_id % 3 = 0 AS is_sent,
    {AS_OF_SQL} - to_minutes(doc_id * 37 % 43200) AS created_at,
    CASE WHEN doc_id % 2 = 0 THEN [CAST(doc_id % 5 AS INTEGER)] ELSE CAST([] AS INTEGER[]) END AS target_categories,
    CASE WHEN doc_id % 5 = 0 THEN [CAST(doc_id % 20 AS INTEGER)] ELSE CAST([] AS INTEGER[]) END AS target_sources
  FROM documents WHERE doc_id % 7 = 4""",
    "comments": """
  SELECT conv_id * 1000 + turn AS id, conv_id AS article_id, conv_id % 100 + turn AS user_id,
    CASE WHEN turn = 0 THEN NULL ELSE conv_id * 1000 + turn - 1 END AS parent_id, text AS content, turn % 7 <> 6 AS is_approved
  FROM conversations""",
    "scrape_runs": f"""
  SELECT l_orderkey * 10 + l_linenumber AS run_id, CAST(l_suppkey % 20 AS INTEGER) AS source_id,
    {AS_OF_SQL} - to_minutes((l_orderkey * 17 + l_partkey) % 43200) AS started_at, CAST(l_quantity AS INTEGER) AS duration_minutes,
    CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'started' END AS status,
    CAST(l_quantity AS INTEGER) AS articles_found, CAST(floor(l_quantity / 2) AS INTEGER) AS articles_added,
    CAST(l_partkey % 5 AS INTEGER) AS articles_updated, l_linenumber - 1 AS error_count FROM lineitem""",
    "story_articles": """
  SELECT CAST(label + 10 * (vec_id // 200) AS BIGINT) AS story_id, vec_id AS article_id, 0.5::DOUBLE + (vec_id % 50) / 100.0::DOUBLE AS relevance_score
  FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)""",
    "stories": f"""
  SELECT story_id AS id, 'Story ' || story_id AS title, 'story-' || story_id AS slug,
    CASE WHEN story_id % 4 = 0 THEN '' ELSE 'Short summary of story ' || story_id END AS short_summary,
    'Overview of story ' || story_id AS overview,
    CASE WHEN story_id % 3 = 0 THEN 'Why story ' || story_id || ' matters' ELSE '' END AS why_this_matters,
    ({_list(THEMES)})[story_id % 15 + 1] AS primary_theme, CAST(1 + story_id * 3 % 10 AS INTEGER) AS importance_score,
    CASE WHEN story_id % 5 = 4 THEN 'dormant' ELSE 'active' END AS status, CAST(story_id % 3 AS INTEGER) AS version,
    CAST(story_id % 6 AS INTEGER) AS articles_at_synthesis, CAST(story_id % 4 AS INTEGER) AS eli5_version,
    ['Entity ' || (story_id % 50), 'Entity ' || (story_id % 7)] AS entities,
    min(published_at) AS first_seen_at, max(published_at) AS last_seen_at
  FROM story_articles JOIN articles ON articles.id = story_articles.article_id GROUP BY story_id""",
    "story_relations": """
  SELECT id AS from_story_id, id - 10 AS to_story_id, CASE WHEN id % 2 = 0 THEN 'related' ELSE 'follow_up' END AS relation_type
  FROM stories WHERE id >= 10""",
    "alerts": f"""
  SELECT article_id AS id, story_id, article_id, (['pending', 'sent', 'suppressed'])[article_id // 6 % 3 + 1] AS status,
    CAST(1 + article_id * 3 % 10 AS INTEGER) AS importance_score, 'Alert ' || article_id AS title, 'Reason ' || article_id AS reason,
    {AS_OF_SQL} - to_minutes(article_id * 7 % 5000) AS created_at
  FROM story_articles WHERE article_id % 6 = 0""",
    "subscribers": """
  SELECT c_custkey AS id, 'user' || c_custkey || '@mail.example' AS email, c_custkey % 6 <> 0 AS is_active, c_custkey % 5 <> 0 AS confirmed,
    (['morning', 'evening', 'morning_evening'])[c_custkey % 3 + 1] AS frequency,
    CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE DATE '2024-01-31' - CAST(c_custkey % 2 AS INTEGER) END AS last_digest_date,
    (['', 'midday', 'evening'])[c_custkey % 7 % 3 + 1] AS last_slot_sent FROM customer""",
    "video_views": f"""
  SELECT event_id AS id, event_id % 40 AS video_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id END AS user_id,
    's' || user_id AS session_id, CAST(floor(value) AS INTEGER) AS watch_seconds, ({_list(SCREENS)})[event_id % 4 + 1] AS device_type,
    CASE WHEN event_id % 17 = 0 THEN '' ELSE ({_list(QUALITIES)})[event_id % 3 + 1] END AS quality_watched,
    CAST(floor(value / 2) AS INTEGER) AS last_position_seconds, ts AS started_at
  FROM events WHERE event_type IN ('view', 'click')""",
    "videos": f"""
  SELECT id, 'Video ' || id AS title, 'About video ' || id AS description, CAST(60 + 10 * id AS INTEGER) AS duration_seconds,
    (['ready', 'ready', 'ready', 'processing', 'pending', 'failed'])[id % 6 + 1] AS status, id % 8 <> 7 AS is_active, id % 5 = 0 AS is_featured,
    id % 10 AS uploaded_by, {AS_OF_SQL} - to_hours(id * 3) AS created_at FROM (SELECT DISTINCT event_id % 40 AS id FROM events)""",
    "video_queue": f"""
  SELECT o_orderkey AS id, o_orderkey % 40 AS video_id, (['low', 'normal', 'high', 'urgent'])[o_orderkey % 4 + 1] AS priority,
    CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'completed' ELSE 'processing' END AS status,
    {AS_OF_SQL} - to_minutes(o_orderkey * 11 % 43200) AS queued_at FROM orders""",
}


def model_sql(body: str) -> str:
    """A complete SQL statement: the model tables as common table expressions, then ``body``."""
    import re

    used: list[str] = []

    def visit(text):
        for name in SQL_TABLES:
            if name not in used and re.search(rf"\b(?:FROM|JOIN|,)\s*{name}\b", text):
                visit(SQL_TABLES[name])
                if name not in used:
                    used.append(name)

    visit(body)
    tables = ",\n".join(f"{name} AS ({SQL_TABLES[name]})" for name in used)
    body = body.strip()
    if not tables:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {tables},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {tables},\n{body[5:]}"
    return f"WITH {tables}\n{body}"
