"""Registered queries for filters and scored feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.functions import text as tx
from pressline.operators import feeds
from pressline.plans.model import AS_OF_SQL, Model
from pressline.plans.registry import query

ELIGIBLE = "(SELECT a.* FROM articles a JOIN sources s ON s.id = a.source_id WHERE a.has_full_content AND s.is_active)"
NEWS = f"""(SELECT a.*, e.importance_score, e.is_breaking_candidate, e.follow_up_worthy, e.bias_notes, e.impact_note
  FROM {ELIGIBLE} a JOIN enrichments e ON e.article_id = a.id WHERE e.status = 'completed')"""
INTEL = "is_breaking_candidate DESC, importance_score DESC, follow_up_worthy DESC, scraped_at DESC, id DESC"


def score_sql(recency, engagement, quality, hours, rows):
    return f"""
SELECT x.*, recency_score * {recency} + engagement_score * {engagement} + quality_score * {quality} AS article_score FROM (
SELECT a.*, coalesce(r.recent, 0) AS recent_view_count, coalesce(r.total, 0) AS total_view_count,
  CASE WHEN h <= 6 THEN 100.0 WHEN h <= 12 THEN 80.0 WHEN h <= 24 THEN 60.0 WHEN h <= 48 THEN 40.0 WHEN h <= 72 THEN 20.0 ELSE 10.0 END::DOUBLE AS recency_score,
  CAST(CASE WHEN h <= 24 THEN 10 WHEN h <= 48 THEN 5 ELSE 2 END * coalesce(r.recent, 0) AS DOUBLE) AS engagement_score,
  CASE WHEN word_count >= 800 AND has_full_content THEN 100.0 WHEN word_count >= 400 AND has_full_content THEN 70.0 WHEN has_full_content THEN 50.0
    WHEN word_count >= 200 THEN 30.0 ELSE 10.0 END::DOUBLE AS quality_score
FROM (SELECT *, epoch({AS_OF_SQL} - scraped_at) / 3600.0 AS h FROM {rows}) a
LEFT JOIN (SELECT article_id, count(*) FILTER (WHERE viewed_at >= {AS_OF_SQL} - to_hours({hours})) AS recent, count(*) AS total FROM views GROUP BY 1) r
  ON r.article_id = a.id) x"""


def eligible(m: Model):
    return feeds.eligible_articles(m.articles, m.sources)


def news(m: Model):
    return feeds.intelligence_articles(eligible(m), m.enrichments)


@query("f1_eligible_articles", f"SELECT id, source_id FROM {ELIGIBLE}")
def _(m):
    return eligible(m).select("id", "source_id")


@query("f1_latest_for_users", f"""
WITH seen AS (SELECT p.user_id, a.id, a.scraped_at FROM (SELECT user_id, unnest(followed_sources) AS sid FROM profiles) p
    JOIN articles a ON a.source_id = p.sid WHERE has_full_content
  UNION ALL SELECT user_id, id, scraped_at FROM profiles, (SELECT id, scraped_at FROM {ELIGIBLE} ORDER BY scraped_at DESC, id DESC LIMIT 10) n WHERE len(followed_sources) = 0)
SELECT user_id, scraped_at, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY scraped_at DESC, id DESC) AS rank FROM seen) WHERE rank <= 10""")
def _(m):
    return feeds.latest_for_users(m.articles, m.sources, m.profiles, 10)


@query("f2_intelligence_articles", f"SELECT id, importance_score FROM {NEWS}")
def _(m):
    return news(m).select("id", "importance_score")


@query("f3_search_filters", """
SELECT id FROM articles WHERE category_id = 2 AND CAST(scraped_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND has_full_content""")
def _(m):
    return feeds.search_filters(m.articles, category=2, date_from="2024-01-05", date_to="2024-01-25", full_content=True).select("id")


@query("f4_story_filters", """
SELECT id, title FROM stories WHERE status = 'active' AND (lower(title) LIKE '%story 1%' OR lower(short_summary) LIKE '%story 1%'
  OR lower(overview) LIKE '%story 1%' OR lower(CAST(to_json(entities) AS VARCHAR)) LIKE '%story 1%')""")
def _(m):
    return feeds.story_filters(m.stories, status="active", search="Story 1").select("id", "title")


@query("f5_exclude_ids", f"""
SELECT id FROM {ELIGIBLE} WHERE id NOT IN (SELECT article_id FROM views WHERE viewed_at >= {AS_OF_SQL} - INTERVAL 7 DAY)
  AND id NOT IN (SELECT article_id FROM story_articles)""")
def _(m):
    seen = m.views.filter(F.col("viewed_at") >= feeds.hours_before(m.as_of, 168)).select(F.col("article_id").alias("id"))
    return feeds.exclude_ids(eligible(m), seen, m.story_articles.select(F.col("article_id").alias("id"))).select("id")


@query("f6_visible_comments", "SELECT id, article_id FROM comments WHERE parent_id IS NULL AND is_approved")
def _(m):
    return feeds.visible_comments(m.comments).select("id", "article_id")


@query("f6_unsuppressed_alerts", """
SELECT id, story_id, status FROM alerts WHERE status <> 'suppressed' AND article_id IN (SELECT id FROM articles WHERE has_full_content)""")
def _(m):
    return feeds.unsuppressed_alerts(m.alerts, m.articles).select("id", "story_id", "status")


@query("f6_active_tokens", "SELECT user_id, token FROM push_tokens WHERE is_active")
def _(m):
    return feeds.active_tokens(m.push_tokens).select("user_id", "token")


@query("f6_published_digests", "SELECT DISTINCT CAST(CAST(published_at AS DATE) AS VARCHAR) AS digest_date FROM articles WHERE day(published_at) % 7 <> 0")
def _(m):
    from pressline.plans.audiences import digests

    return feeds.published_digests(digests(m)).select(F.col("digest_date").cast("string").alias("digest_date"))


@query("f7_filter_by_keyword", """
SELECT id FROM articles WHERE lower(title) LIKE '%ation%' OR lower(excerpt) LIKE '%ation%' OR lower(content) LIKE '%ation%'""")
def _(m):
    return feeds.filter_by_keyword(m.articles, "Ation").select("id")


@query("f7_filter_by_category", """
SELECT id, category_id FROM articles WHERE category_id IN (SELECT id FROM categories WHERE lower(name) LIKE '%s%')""")
def _(m):
    return feeds.filter_by_category(m.articles, m.categories, "S").select("id", "category_id")


@query("f8_article_list", """
SELECT a.id, a.title, a.url, a.excerpt, a.image_url, s.name AS source_name, c.name AS category_name, published_at, scraped_at,
  CASE WHEN word_count > 0 THEN greatest(1, word_count // 200) ELSE 0 END AS read_time_minutes, e.summary,
  coalesce(e.importance_score, -1) AS importance_score
FROM articles a LEFT JOIN sources s ON s.id = a.source_id LEFT JOIN categories c ON c.id = a.category_id
LEFT JOIN (SELECT * FROM enrichments WHERE status = 'completed') e ON e.article_id = a.id""")
def _(m):
    rows = feeds.article_list(m.articles, m.sources, m.categories, m.enrichments)
    return rows.withColumn("importance_score", F.coalesce("importance_score", F.lit(-1)))


@query("f8_article_snippet", """
SELECT a.id, a.title, a.url, a.excerpt, a.image_url, s.name AS source_name, c.name AS category_name, u.name AS author_name, published_at,
  CASE WHEN word_count > 0 THEN greatest(1, word_count // 200) ELSE 0 END AS read_time_minutes
FROM articles a JOIN sources s ON s.id = a.source_id JOIN categories c ON c.id = a.category_id JOIN authors u ON u.id = a.author_id WHERE has_full_content""")
def _(m):
    return feeds.article_snippet(m.articles, m.sources, m.categories, m.authors)


@query("f10_exclude_themes", "SELECT article_id FROM enrichments WHERE NOT list_contains(themes, 'sports')")
def _(m):
    return feeds.exclude_themes(m.enrichments).select("article_id")


@query("f11_rows_by_ids", "SELECT id, title FROM articles WHERE id IN (SELECT article_id FROM history)")
def _(m):
    ids = m.history.select(F.col("article_id").alias("id"))
    return feeds.rows_by_ids(m.articles, ids).select("id", "title")


@query("r1_article_score", f"""
SELECT id, recency_score, engagement_score, quality_score, round(article_score, 6) AS article_score, recent_view_count, total_view_count
FROM ({score_sql(0.4, 0.3, 0.3, 48, ELIGIBLE)})""")
def _(m):
    scored = feeds.article_score(eligible(m), m.views, m.as_of)
    return scored.select(
        "id", "recency_score", "engagement_score", "quality_score", F.round("article_score", 6).alias("article_score"),
        "recent_view_count", "total_view_count",
    )


@query("r2_top_story", f"""
SELECT id, tier, round(importance_score * CASE WHEN h <= 4 THEN 1.0 WHEN h <= 8 THEN 0.8 WHEN h <= 12 THEN 0.6 WHEN h <= 18 THEN 0.4 ELSE 0.2 END
  + CASE WHEN is_breaking_candidate AND h <= 6 THEN 2.0 ELSE 0.0 END, 6)::DOUBLE AS top_story_score
FROM (SELECT *, epoch({AS_OF_SQL} - scraped_at) / 3600.0 AS h, CASE WHEN scraped_at >= {AS_OF_SQL} - INTERVAL 18 HOUR THEN 0 ELSE 1 END AS tier FROM {NEWS})
WHERE h <= 36 ORDER BY tier, top_story_score DESC, scraped_at DESC, id DESC LIMIT 1""")
def _(m):
    return feeds.top_story(news(m), m.as_of).select("id", "tier", F.round("top_story_score", 6).alias("top_story_score"))


@query("r3_featured", f"""
SELECT id, CASE WHEN scraped_at >= {AS_OF_SQL} - INTERVAL 72 HOUR THEN 0 ELSE 1 END AS tier FROM {NEWS} ORDER BY tier, {INTEL} LIMIT 5""")
def _(m):
    return feeds.featured(news(m), m.as_of).select("id", "tier")


@query("r4_top_reads", f"""
SELECT id, engagement_score, round(article_score, 6) AS article_score, recent_view_count FROM ({score_sql(0.2, 0.6, 0.2, 168, ELIGIBLE)}) s
WHERE scraped_at >= {AS_OF_SQL} - to_days(7) ORDER BY engagement_score DESC, article_score DESC, scraped_at DESC, id DESC LIMIT 10""")
def _(m):
    top = feeds.top_reads(eligible(m), m.views, m.as_of)
    return top.select("id", "engagement_score", F.round("article_score", 6).alias("article_score"), "recent_view_count")


@query("r5_latest", f"SELECT id, scraped_at FROM {ELIGIBLE} WHERE scraped_at >= {AS_OF_SQL} - to_hours(48) ORDER BY scraped_at DESC, id DESC LIMIT 20")
def _(m):
    return feeds.latest(eligible(m), m.as_of, 48).select("id", "scraped_at")


MID = "TIMESTAMP '2024-01-16 00:00:00'"


@query("r6_trending", f"""
WITH s AS (SELECT a.*, n, CASE WHEN scraped_at < {MID} THEN n / greatest(epoch({MID} - scraped_at) / 3600.0, 1.0) ELSE n END AS score
  FROM {ELIGIBLE} a JOIN (SELECT article_id, count(*) AS n FROM views WHERE viewed_at >= {MID} - to_hours(24) GROUP BY 1) v ON v.article_id = a.id
  WHERE scraped_at >= {MID} - to_hours(24))
SELECT id, n AS recent_views, round(score, 6) AS trending_score FROM s ORDER BY score DESC, n DESC, scraped_at DESC, id DESC LIMIT 10""")
def _(m):
    top = feeds.trending(eligible(m), m.views, m.as_of - F.expr("INTERVAL 15 DAYS"))
    return top.select("id", "recent_views", F.round("trending_score", 6).alias("trending_score"))


@query("r7_read_next_for_articles", f"""
WITH news AS (SELECT * FROM {NEWS}),
pairs AS (SELECT s.id AS seed_id, c.*, CASE WHEN c.category_id = s.category_id THEN 40 WHEN c.source_id = s.source_id THEN 20
    WHEN list_has_any(c.tags, s.tags) THEN 30 ELSE 0 END AS read_next_score FROM news s JOIN news c ON c.id <> s.id)
SELECT seed_id, id, read_next_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY read_next_score DESC, {INTEL}) AS rank FROM pairs) WHERE rank <= 5""")
def _(m):
    rows = news(m)
    return feeds.read_next_for_articles(rows, rows, 5)


@query("r7_read_next_for_users", f"""
WITH news AS (SELECT * FROM {NEWS}),
pairs AS (SELECT p.user_id, c.*, CASE WHEN list_contains(p.followed_sources, c.source_id) THEN 30
    WHEN list_contains(p.preferred_categories, c.category_id) THEN 20 ELSE 0 END AS read_next_score
  FROM profiles p JOIN news c ON true
  WHERE NOT EXISTS (SELECT 1 FROM views v WHERE v.user_id = p.user_id AND v.article_id = c.id AND viewed_at >= {AS_OF_SQL} - to_days(14)))
SELECT user_id, id, read_next_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY read_next_score DESC, {INTEL}) AS rank FROM pairs) WHERE rank <= 5""")
def _(m):
    return feeds.read_next_for_users(news(m), m.profiles, m.views, m.as_of, 5)


@query("r8_related", f"""
WITH recent AS ({score_sql(0.5, 0.3, 0.2, 168, f"(SELECT * FROM {ELIGIBLE} WHERE scraped_at >= {AS_OF_SQL} - to_days(7))")}),
pairs AS (SELECT s.id AS seed_id, c.id, c.article_score, c.scraped_at FROM {ELIGIBLE} s JOIN recent c
  ON c.id <> s.id AND (c.category_id = s.category_id OR c.source_id = s.source_id OR list_has_any(c.tags, s.tags)))
SELECT seed_id, id, round(article_score, 6) AS article_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY article_score DESC, scraped_at DESC, id DESC) AS rank FROM pairs) WHERE rank <= 5""")
def _(m):
    rows = eligible(m)
    return feeds.related(rows, rows, m.views, m.as_of).withColumn("article_score", F.round("article_score", 6))


@query("r9_suggested_next_reads", """
WITH full_a AS (SELECT id, published_at FROM articles WHERE has_full_content),
base AS (SELECT a.*, e.importance_score, e.status, e.related_themes FROM full_a a JOIN enrichments e ON e.article_id = a.id),
own AS (SELECT sa.article_id AS id, arg_max(sa.story_id, struct_pack(a := importance_score, b := last_seen_at, c := sa.story_id)) AS story_id
  FROM story_articles sa JOIN stories s ON s.id = sa.story_id GROUP BY 1),
names AS (SELECT article_id, normalized_name, row_number() OVER (PARTITION BY article_id ORDER BY id) AS k FROM mentions),
pairs AS (
  SELECT o.id AS seed_id, c.id, 1 AS tier, c.importance_score, c.published_at FROM own o JOIN full_a f ON f.id = o.id
    JOIN story_articles sa ON sa.story_id = o.story_id JOIN base c ON c.id = sa.article_id AND c.id <> o.id
  UNION SELECT s.id, c.id, 2, c.importance_score, c.published_at FROM base s JOIN base c ON c.id <> s.id AND c.status = 'completed' AND list_has_any(c.related_themes, s.related_themes)
  UNION SELECT s.id, c.id, 3, c.importance_score, c.published_at FROM base s JOIN names n ON n.article_id = s.id
    JOIN names o ON o.normalized_name = n.normalized_name JOIN base c ON c.id = o.article_id AND c.id <> s.id AND c.status = 'completed'),
best AS (SELECT *, min(tier) OVER (PARTITION BY seed_id) AS first_tier FROM pairs)
SELECT seed_id, id, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY importance_score DESC, published_at DESC, id DESC) AS rank
  FROM best WHERE tier = first_tier) WHERE rank <= 5""")
def _(m):
    return feeds.suggested_next_reads(m.articles, m.enrichments, m.story_articles, m.stories, m.mentions)


@query("r10_guide_cards", f"""
WITH done AS (SELECT article_id FROM enrichments WHERE status = 'completed'),
counts AS (SELECT story_id, count(DISTINCT article_id) AS n, count(DISTINCT source_id) AS ns FROM story_articles JOIN articles ON articles.id = story_articles.article_id GROUP BY 1),
cards AS (
  (SELECT 'cluster-' || id AS id, 'cluster' AS type, title, CASE WHEN why_this_matters <> '' THEN why_this_matters ELSE
     'This story is appearing across ' || ns || ' sources and ' || n || ' related articles.' END AS reason,
     least(0.95, 0.55 + importance_score / 20) AS confidence, 6 AS hours, CAST(NULL AS BIGINT) AS anchor
   FROM stories s JOIN counts c ON c.story_id = s.id WHERE n >= 2 ORDER BY importance_score DESC, last_seen_at DESC, s.id LIMIT 8)
  UNION ALL (SELECT 'alert-' || id, 'alert', title, reason, least(0.98, 0.6 + importance_score / 20), 3, article_id FROM alerts
   WHERE status <> 'suppressed' AND article_id IN (SELECT id FROM articles WHERE has_full_content) ORDER BY importance_score DESC, created_at DESC, id LIMIT 6)
  UNION ALL (SELECT 'entity-' || entity_type || '-' || replace(normalized_name, ' ', '-'), 'entity', 'Entity ' || split_part(normalized_name, ' ', 2),
     'Mentioned ' || count(*) || ' times across ' || count(DISTINCT article_id) || ' articles in this reading context.', least(0.92, 0.5 + count(*) / 20), 6, NULL
   FROM mentions WHERE mention_date >= DATE '2024-01-24' AND article_id IN (SELECT article_id FROM done)
     AND article_id IN (SELECT id FROM articles WHERE has_full_content)
   GROUP BY normalized_name, entity_type HAVING count(*) >= 2 ORDER BY count(*) DESC, normalized_name, entity_type LIMIT 8))
SELECT id, type, title, reason, round(confidence, 6) AS confidence, {AS_OF_SQL} + to_hours(hours) AS expires_at, coalesce(anchor, -1) AS insert_after_article_id FROM cards""")
def _(m):
    cards = feeds.guide_cards(m.story_articles, m.stories, m.alerts, m.mentions, m.enrichments, m.articles, m.as_of)
    return cards.select(
        "id", "type", "title", "reason", F.round("confidence", 6).alias("confidence"), "expires_at",
        F.coalesce("insert_after_article_id", F.lit(-1)).alias("insert_after_article_id"),
    )


@query("r10_guide_cards_visible", f"""
WITH visible AS (SELECT DISTINCT article_id FROM history WHERE sent_at >= {AS_OF_SQL} - to_hours(24)),
last AS (SELECT max(article_id) AS anchor FROM visible),
full_a AS (SELECT * FROM articles WHERE has_full_content),
counts AS (SELECT story_id, count(DISTINCT article_id) AS n, count(DISTINCT source_id) AS ns FROM story_articles JOIN articles ON articles.id = story_articles.article_id GROUP BY 1),
seen_stories AS (SELECT DISTINCT story_id FROM story_articles WHERE article_id IN (SELECT article_id FROM visible)),
cards AS (
  (SELECT 'cluster-' || id AS id, CASE WHEN why_this_matters <> '' THEN why_this_matters ELSE
     'This story is appearing across ' || ns || ' sources and ' || n || ' related articles.' END AS reason,
     least(0.95, 0.55 + importance_score / 20) AS confidence, CAST(NULL AS BIGINT) AS anchor
   FROM stories s JOIN counts c ON c.story_id = s.id WHERE s.id IN (SELECT story_id FROM seen_stories) ORDER BY importance_score DESC, last_seen_at DESC, s.id LIMIT 8)
  UNION ALL (SELECT 'alert-' || id, reason, least(0.98, 0.6 + importance_score / 20), NULL FROM alerts
   WHERE status <> 'suppressed' AND article_id IN (SELECT id FROM full_a)
     AND (article_id IN (SELECT article_id FROM visible) OR story_id IN (SELECT story_id FROM seen_stories)) ORDER BY importance_score DESC, created_at DESC, id LIMIT 6)
  UNION ALL (SELECT 'entity-' || entity_type || '-' || replace(normalized_name, ' ', '-'),
     'Mentioned ' || count(*) || ' times across ' || count(DISTINCT article_id) || ' articles in this reading context.', least(0.92, 0.5 + count(*) / 20), NULL
   FROM mentions WHERE article_id IN (SELECT article_id FROM visible) AND article_id IN (SELECT article_id FROM enrichments WHERE status = 'completed')
     AND article_id IN (SELECT id FROM full_a)
   GROUP BY normalized_name, entity_type HAVING count(*) >= 2 ORDER BY count(*) DESC, normalized_name, entity_type LIMIT 8)
  UNION ALL (SELECT 'context-' || article_id, reason, confidence, article_id FROM (SELECT article_id, least(0.9, 0.5 + importance_score / 20) AS confidence,
     CASE WHEN len(bias_notes) > 0 THEN bias_notes[1] WHEN impact_note <> '' THEN 'This story has local impact context worth checking before moving on.'
       WHEN follow_up_worthy THEN 'This article connects to a developing story worth following.' ELSE '' END AS reason
   FROM enrichments WHERE status = 'completed' AND article_id IN (SELECT article_id FROM visible) AND article_id IN (SELECT id FROM full_a)
   ORDER BY importance_score DESC, article_id LIMIT 6) WHERE reason <> ''))
SELECT id, reason, round(confidence, 6) AS confidence, coalesce(cards.anchor, last.anchor) AS insert_after_article_id FROM cards, last""")
def _(m):
    visible = (
        m.history.filter(F.col("sent_at") >= feeds.hours_before(m.as_of, 24)).select("article_id").distinct()
        .withColumn("position", F.col("article_id"))
    )
    cards = feeds.guide_cards(
        m.story_articles, m.stories, m.alerts, m.mentions, m.enrichments, m.articles, m.as_of, visible=visible
    )
    return cards.select("id", "reason", F.round("confidence", 6).alias("confidence"), "insert_after_article_id")


@query("r11_article_guidance", """
WITH own AS (SELECT sa.article_id AS id, arg_max(sa.story_id, struct_pack(a := importance_score, b := last_seen_at, c := sa.story_id)) AS story_id
  FROM story_articles sa JOIN stories s ON s.id = sa.story_id GROUP BY 1),
counts AS (SELECT story_id, count(DISTINCT article_id) AS n, count(DISTINCT source_id) AS ns FROM story_articles JOIN articles ON articles.id = story_articles.article_id GROUP BY 1),
ents AS (SELECT article_id, string_agg(entity_type || ':' || entity_name, '|' ORDER BY entity_type, entity_name) AS names FROM mentions GROUP BY 1),
voices AS (SELECT o.id, sa.article_id, 'Source ' || b.source_id || ': left out ' || sa.article_id AS said, row_number() OVER (PARTITION BY o.id ORDER BY sa.article_id) AS k
  FROM own o JOIN story_articles sa ON sa.story_id = o.story_id AND sa.article_id <> o.id JOIN articles b ON b.id = sa.article_id),
said AS (SELECT id, string_agg(said, '|' ORDER BY article_id) AS notes FROM voices WHERE k <= 5 AND article_id % 2 = 0 GROUP BY id)
SELECT a.id, a.title, coalesce(o.story_id, -1) AS story_id, coalesce(c.n, 0) AS article_count, coalesce(c.ns, 0) AS source_count, coalesce(ents.names, '') AS key_entities,
  array_to_string(e.related_themes, '|') AS story_arcs, array_to_string(e.key_facts, '|') AS key_facts,
  coalesce(nullif(s.why_this_matters, ''), nullif(e.impact_note, ''), nullif(e.summary, ''), a.excerpt) AS why_it_matters,
  concat_ws('|', nullif(array_to_string(e.bias_notes, '|'), ''), said.notes) AS missing_context
FROM articles a JOIN enrichments e ON e.article_id = a.id LEFT JOIN own o ON o.id = a.id LEFT JOIN stories s ON s.id = o.story_id
LEFT JOIN counts c ON c.story_id = o.story_id LEFT JOIN ents ON ents.article_id = a.id LEFT JOIN said ON said.id = a.id WHERE a.has_full_content""")
def _(m):
    voices = m.story_articles.join(m.articles.select(F.col("id").alias("article_id"), "source_id"), "article_id").select(
        "story_id", "article_id", "source_id",
        F.when(F.col("article_id") % 2 == 0, F.concat(F.lit("left out "), F.col("article_id"))).otherwise("").alias("omitted_context"),
    )
    out = feeds.article_guidance(m.articles, m.enrichments, m.story_articles, m.stories, m.mentions, voices, m.sources)
    return out.select(
        "id", "title", F.coalesce("story_id", F.lit(-1)).alias("story_id"), F.coalesce("article_count", F.lit(0)).alias("article_count"),
        F.coalesce("source_count", F.lit(0)).alias("source_count"),
        *[F.array_join(c, "|").alias(c) for c in ("key_entities", "story_arcs", "key_facts", "missing_context")], "why_it_matters",
    )


@query("t15_display_strings", f"""
SELECT id, CASE WHEN length(content) > 220 THEN substr(content, 1, 220) || '...' ELSE content END AS excerpt,
  CASE WHEN word_count >= 3600 THEN format('{{:d}}:{{:02d}}:{{:02d}}', word_count // 3600, word_count % 3600 // 60, word_count % 60)
    ELSE format('{{:d}}:{{:02d}}', word_count // 60, word_count % 60) END AS clock,
  CASE WHEN word_count >= 3600 THEN format('{{:02d}}:{{:02d}}:{{:02d}}', word_count // 3600, word_count % 3600 // 60, word_count % 60)
    ELSE format('{{:02d}}:{{:02d}}', word_count // 60, word_count % 60) END AS padded
FROM articles""")
def _(m):
    words = F.col("word_count")
    return m.articles.select(
        "id", tx.excerpt(F.col("content")).alias("excerpt"), tx.clock(words).alias("clock"), tx.clock(words, True).alias("padded")
    )


@query("t18_age_hours", f"SELECT id, round(epoch({AS_OF_SQL} - scraped_at) / 3600.0, 6) AS hours FROM articles")
def _(m):
    return m.articles.select("id", F.round(tx.age_hours(F.col("scraped_at"), m.as_of), 6).alias("hours"))
