"""Registered queries for digests, mail and notification audiences."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.functions import clients
from pressline.functions import tables as table_functions
from pressline.functions import text as tx
from pressline.operators import audience, feeds, trends
from pressline.operators.ranking import top_n
from pressline.plans.model import AS_OF_SQL, Model
from pressline.plans.registry import query

CANDIDATES = f"""cand AS (SELECT * FROM (SELECT *, CASE WHEN analyzed_at >= {AS_OF_SQL} - to_hours(27) THEN 0 WHEN analyzed_at >= {AS_OF_SQL} - to_hours(48) THEN 1 ELSE 2 END AS tier
  FROM enrichments WHERE status = 'completed') c, (SELECT count(*) FILTER (WHERE analyzed_at >= {AS_OF_SQL} - to_hours(27)) AS n0, count(*) FILTER (WHERE analyzed_at >= {AS_OF_SQL} - to_hours(48)) AS n1
  FROM enrichments WHERE status = 'completed') s WHERE tier = 0 OR (tier = 1 AND n0 < 10) OR (tier = 2 AND n1 = 0) ORDER BY tier, importance_score DESC, analyzed_at DESC, article_id DESC LIMIT 50)"""


@query("n1_digest_candidates", f"WITH {CANDIDATES} SELECT article_id, tier, importance_score FROM cand")
def _(m):
    return audience.digest_candidates(m.enrichments, m.as_of).select("article_id", "tier", "importance_score")


@query("n1_digest_candidates_thin", f"""
WITH {CANDIDATES.replace(AS_OF_SQL, "TIMESTAMP '2024-01-31 20:00:00'")} SELECT article_id, tier, importance_score FROM cand""")
def _(m):
    evening = m.as_of + F.expr("INTERVAL 20 HOURS")
    return audience.digest_candidates(m.enrichments, evening).select("article_id", "tier", "importance_score")


@query("n2_digest_payload", f"""
WITH {CANDIDATES}, rows AS (SELECT c.*, a.title, s.name AS source FROM cand c JOIN articles a ON a.id = c.article_id JOIN sources s ON s.id = a.source_id),
trend AS (SELECT entity_name, entity_type, count(*) AS mention_count FROM mentions WHERE mention_date >= DATE '2024-01-24' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20)
SELECT '2024-01-31' AS digest_date, count(*) AS article_count, CASE WHEN count(*) < 5 THEN '1-2 paragraph briefing' WHEN count(*) < 15 THEN '2-3 paragraph briefing' ELSE '3-4 paragraph briefing' END AS guidance,
  '[' || string_agg(CAST(to_json(struct_pack(id := article_id, title := title, source := source, summary := summary, sentiment := sentiment, importance := importance_score, themes := themes,
    story_arcs := related_themes, key_facts := key_facts[1:3], follow_up := follow_up_worthy)) AS VARCHAR), ',' ORDER BY tier, importance_score DESC, analyzed_at DESC, article_id DESC) || ']' AS articles_json,
  (SELECT '[' || string_agg(CAST(to_json(struct_pack(entity_name := entity_name, entity_type := entity_type, mention_count := mention_count)) AS VARCHAR), ',' ORDER BY mention_count DESC, entity_name, entity_type) || ']' FROM trend) AS trending_json
FROM rows""")
def _(m):
    trending = trends.digest_trending_entities(m.mentions, F.to_date(m.as_of))
    payload = audience.digest_payload(audience.digest_candidates(m.enrichments, m.as_of), m.articles, m.sources, trending, F.to_date(m.as_of))
    return payload.withColumn("digest_date", F.col("digest_date").cast("string"))


def digests(m: Model):
    """One digest per publication day: its five most important articles, two threads, text."""
    rows = m.articles.select("id", F.to_date("published_at").alias("digest_date")).join(
        m.enrichments.select(F.col("article_id").alias("id"), "importance_score", "summary"), "id"
    )
    best = top_n(rows, ["digest_date"], [F.desc("importance_score"), F.asc("id")], 5, rank="k")
    listed = best.groupBy("digest_date").agg(F.array_sort(F.collect_list(F.struct("k", "id", "summary"))).alias("l"))
    ids = F.transform("l", lambda x: x["id"])
    return listed.select(
        "digest_date", F.transform("l", lambda x: F.struct(x["id"].alias("article_id"), x["summary"].alias("headline"))).alias("top_stories"),
        F.array(
            F.struct(F.lit("first").alias("title"), F.concat(F.slice(ids, 1, 2), F.array(F.lit(-1).cast("bigint"))).alias("article_ids")),
            F.struct(F.lit("rest").alias("title"), F.slice(ids, 3, 3).alias("article_ids")),
        ).alias("story_threads"),
        F.element_at(ids, -1).alias("under_radar_id"),
        F.array_join(F.transform("l", lambda x: F.concat(x["summary"], F.lit(" It matters to many readers across the whole region today. Officials will say more soon!"))), "\n\n").alias("digest_text"),
        F.concat(F.lit("Key concern of the day "), F.get(ids, F.lit(0)).cast("string"), F.lit(". More below.")).alias("key_concern"),
        (F.dayofmonth("digest_date") % 7 != 0).alias("is_published"),
    )


DIGESTS = """best AS (SELECT CAST(published_at AS DATE) AS d, a.id, summary, row_number() OVER (PARTITION BY CAST(published_at AS DATE) ORDER BY importance_score DESC, a.id) AS k
  FROM articles a JOIN enrichments e ON e.article_id = a.id),
digests AS (SELECT d, list(id ORDER BY k) AS ids, list(summary ORDER BY k) AS heads FROM best WHERE k <= 5 GROUP BY d),
full_a AS (SELECT * FROM articles WHERE has_full_content)"""


@query("n3_digest_detail", f"""
WITH {DIGESTS}, tops AS (SELECT d, k, summary || ':' || coalesce(CAST(f.id AS VARCHAR), 'none') || ':' || coalesce(s.name, 'none') AS entry, f.id AS known FROM best LEFT JOIN full_a f ON f.id = best.id
  LEFT JOIN sources s ON s.id = f.source_id WHERE k <= 5),
t AS (SELECT d, string_agg(entry, '|' ORDER BY k) AS top_stories, coalesce(string_agg(CAST(known AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k <= 2 AND known IS NOT NULL), '') AS first_thread,
  coalesce(string_agg(CAST(known AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k > 2 AND known IS NOT NULL), '') AS rest_thread FROM tops GROUP BY d)
SELECT CAST(t.d AS VARCHAR) AS digest_date, top_stories, first_thread, rest_thread, coalesce(f.id, -1) AS radar FROM t JOIN digests g ON g.d = t.d LEFT JOIN full_a f ON f.id = g.ids[-1]""")
def _(m):
    snippets = feeds.article_snippet(m.articles, m.sources, m.categories, m.authors).select("id", "title", "source_name")
    rows = audience.digest_detail(digests(m), snippets)
    none = F.lit("none")
    entry = lambda s: F.concat_ws(":", s["headline"], F.coalesce(s["article"]["id"].cast("string"), none), F.coalesce(s["article"]["source_name"], none))
    thread = lambda i: F.array_join(F.transform(F.get("story_threads", F.lit(i))["articles"], lambda a: a["id"].cast("string")), ",")
    return rows.select(
        F.col("digest_date").cast("string").alias("digest_date"), F.array_join(F.transform("top_stories", entry), "|").alias("top_stories"),
        thread(0).alias("first_thread"), thread(1).alias("rest_thread"), F.coalesce("under_radar_article.id", F.lit(-1)).alias("radar"),
    )


@query("j8_mail_stories", f"""
WITH {DIGESTS} SELECT CAST(d AS VARCHAR) AS digest_date, k - 1 AS pos, best.id AS article_id, summary AS headline, a.image_url, a.url AS article_url, s.name AS source_name, s.base_url AS source_url, u.name AS author_name
FROM best JOIN articles a ON a.id = best.id JOIN sources s ON s.id = a.source_id JOIN authors u ON u.id = a.author_id WHERE k <= 5""")
def _(m):
    rows = audience.mail_stories(digests(m), m.articles, m.sources, m.authors)
    return rows.withColumn("digest_date", F.col("digest_date").cast("string"))


@query("n4_flash_articles", f"""
SELECT article_id, title, importance_score FROM (SELECT * FROM enrichments WHERE status = 'completed' AND importance_score >= 7 AND analyzed_at >= {AS_OF_SQL} - to_hours(60)
  ORDER BY importance_score DESC, analyzed_at DESC, article_id DESC LIMIT 5) JOIN articles ON articles.id = article_id""")
def _(m):
    return audience.flash_articles(m.enrichments, m.articles, m.as_of, 60).select("article_id", "title", "importance_score")


@query("n5_digest_audience", """
SELECT id, email FROM subscribers WHERE is_active AND confirmed AND frequency <> 'evening' AND last_digest_date IS DISTINCT FROM DATE '2024-01-31'""")
def _(m):
    return audience.digest_audience(m.subscribers, F.to_date(m.as_of)).select("id", "email")


@query("n5_flash_audience", """
SELECT id, email FROM subscribers WHERE is_active AND confirmed AND frequency IN ('morning_evening', 'evening')
  AND NOT (last_digest_date IS NOT DISTINCT FROM DATE '2024-01-31' AND last_slot_sent IS NOT DISTINCT FROM 'evening')""")
def _(m):
    return audience.flash_audience(m.subscribers, F.to_date(m.as_of), "evening").select("id", "email")


@query("n6_due_schedules", f"SELECT id, user_id FROM schedules WHERE next_send_at <= {AS_OF_SQL} AND is_active")
def _(m):
    return audience.due_schedules(m.schedules, m.as_of).select("id", "user_id")


SELECTED = f"""due AS (SELECT s.*, p.preferred_categories, p.followed_sources, coalesce(last_sent_at, CASE WHEN frequency = 'weekly' THEN {AS_OF_SQL} - to_days(7) ELSE {AS_OF_SQL} - to_hours(24) END) AS since
  FROM schedules s LEFT JOIN profiles p ON p.user_id = s.user_id WHERE next_send_at <= {AS_OF_SQL} AND is_active),
ranked AS (SELECT d.id AS schedule_id, d.user_id, a.id AS article_id, max_articles, row_number() OVER (PARTITION BY d.id ORDER BY scraped_at DESC, a.id DESC) AS rank FROM due d JOIN articles a
  ON a.scraped_at > d.since AND NOT a.is_processed
  AND CASE WHEN len(include_categories) > 0 THEN list_contains(include_categories, a.category_id) WHEN len(preferred_categories) > 0 THEN list_contains(preferred_categories, a.category_id) ELSE true END
  AND CASE WHEN len(include_sources) > 0 THEN list_contains(include_sources, a.source_id) WHEN len(followed_sources) > 0 THEN list_contains(followed_sources, a.source_id) ELSE true END
  WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.user_id = d.user_id AND h.article_id = a.id AND h.sent_at >= {AS_OF_SQL} - to_days(7))),
selected AS (SELECT schedule_id, user_id, article_id, rank FROM ranked WHERE rank <= max_articles)"""


def selected(m: Model):
    return audience.schedule_articles(audience.due_schedules(m.schedules, m.as_of), m.articles, m.history, m.profiles, m.as_of)


@query("n7_schedule_articles", f"WITH {SELECTED} SELECT * FROM selected")
def _(m):
    return selected(m)


@query("n8_schedule_messages", f"""
WITH {SELECTED}, facts AS (SELECT s.*, title, o.name AS source FROM selected s JOIN articles a ON a.id = article_id JOIN sources o ON o.id = a.source_id),
firsts AS (SELECT schedule_id, source, min(rank) AS k FROM facts WHERE rank <= 3 GROUP BY 1, 2), names AS (SELECT schedule_id, string_agg(source, ', ' ORDER BY k) AS names FROM firsts GROUP BY 1),
grouped AS (SELECT schedule_id, user_id, count(*) AS n, arg_min(title, rank) AS t, arg_min(source, rank) AS s, string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM facts GROUP BY 1, 2)
SELECT g.schedule_id, g.user_id, token, CASE WHEN n = 1 THEN 'Featured Story — ' || s ELSE 'News Highlights' END AS title,
  CASE WHEN n = 1 THEN t || ' — tap to read the details.' ELSE n || ' fresh stories from ' || names || ' — don’t miss out!' END AS body, n AS article_count, ids AS article_ids
FROM grouped g JOIN names USING (schedule_id) JOIN push_tokens p ON p.user_id = g.user_id AND p.is_active""")
def _(m):
    messages = audience.schedule_messages(selected(m), m.articles, m.sources, m.push_tokens)
    return messages.withColumn("article_ids", F.array_join("article_ids", ","))


@query("n8_alert_message_batches", """
WITH top AS (SELECT * FROM alerts WHERE status = 'pending' ORDER BY importance_score DESC, created_at, id LIMIT 20),
messages AS (SELECT user_id, token, t.id AS alert_id, substr(reason, 1, 180) AS body FROM push_tokens, top t WHERE is_active)
SELECT alert_id, user_id, token, body, (row_number() OVER (PARTITION BY alert_id ORDER BY user_id, token) - 1) // 100 AS batch_no FROM messages""")
def _(m):
    messages = audience.alert_messages(audience.pending_alerts(m.alerts), m.push_tokens)
    batched = audience.message_batches(messages, per="alert_id")
    return batched.select("alert_id", "user_id", "token", "body", "batch_no")


@query("n9_send_history", f"""
WITH {SELECTED} SELECT DISTINCT user_id, article_id FROM selected s WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.user_id = s.user_id AND h.article_id = s.article_id)""")
def _(m):
    return audience.send_history(selected(m), m.history, m.as_of).select("user_id", "article_id")


REACHED = f"""reached AS (SELECT b.id AS breaking_id, b.article_id, u.user_id FROM breaking_news b JOIN (SELECT DISTINCT user_id FROM push_tokens WHERE is_active) u ON true
  LEFT JOIN profiles p ON p.user_id = u.user_id WHERE NOT b.is_sent
  AND (len(target_categories) = 0 OR list_has_any(target_categories, preferred_categories)) AND (len(target_sources) = 0 OR list_has_any(target_sources, followed_sources))
  AND NOT EXISTS (SELECT 1 FROM history h WHERE h.user_id = u.user_id AND h.article_id = b.article_id AND sent_at >= {AS_OF_SQL} - to_hours(24)))"""


def reached(m: Model, counted: bool = False):
    return audience.breaking_audience(m.breaking_news, m.push_tokens, m.history, m.profiles, m.as_of, counted=counted)


@query("n10_breaking_audience", f"WITH {REACHED} SELECT * FROM reached")
def _(m):
    return reached(m)


@query("n11_classify_breaking", """
WITH t AS (SELECT a.id, lower(CASE a.id % 5 WHEN 0 THEN 'BREAKING: ' WHEN 1 THEN 'Confirmed by ' WHEN 2 THEN 'Crisis in ' ELSE '' END || title) AS title, name FROM articles a JOIN categories c ON c.id = category_id),
k AS (SELECT *, len(list_filter(['breaking','urgent','just in','developing story','live update','flash','alert','exclusive','confirmed'], lambda w: contains(title, w))) > 0 AS keyword,
  len(list_filter(['breaking:','urgent:','alert:','developing:','just in:','live:','update:','flash:','exclusive:'], lambda w: starts_with(title, w))) > 0 AS prefix FROM t)
SELECT id, CASE WHEN prefix OR name = 'breaking' THEN 'high' WHEN keyword THEN 'medium' ELSE '' END AS priority,
  len(list_filter(['breaking','urgent','alert','crisis','disaster'], lambda w: contains(title, w))) > 0 AS older FROM k""")
def _(m):
    kind = F.col("id") % 5
    title = F.concat(F.when(kind == 0, "BREAKING: ").when(kind == 1, "Confirmed by ").when(kind == 2, "Crisis in ").otherwise(""), F.col("title"))
    sections = m.categories.select(F.col("id").alias("category_id"), "name")
    rows = m.articles.withColumn("title", title).join(sections, "category_id", "left")
    return rows.select(
        "id", F.coalesce(audience.classify_breaking(F.col("title"), F.col("name")), F.lit("")).alias("priority"),
        audience.classify_breaking_older(F.col("title")).alias("older"),
    )


@query("n12_pending_alerts", "SELECT id, importance_score FROM alerts WHERE status = 'pending' ORDER BY importance_score DESC, created_at, id LIMIT 20")
def _(m):
    return audience.pending_alerts(m.alerts).select("id", "importance_score")


@query("n13_unread", "SELECT id, user_id FROM notifications WHERE NOT is_read")
def _(m):
    return audience.unread(m.notifications).select("id", "user_id")


@query("n13_mark_read", f"""
WITH asked AS (SELECT id, user_id FROM notifications WHERE notification_type = 'story_alert')
SELECT id, is_read OR id IN (SELECT id FROM asked) AS is_read, NOT is_read AND id IN (SELECT id FROM asked) AS newly FROM notifications""")
def _(m):
    asked = m.notifications.filter("notification_type = 'story_alert'").select("id", "user_id")
    foreign = m.notifications.select("id", (F.col("user_id") + 1000000).alias("user_id"))
    out = audience.mark_read(m.notifications, asked.unionByName(foreign), m.as_of)
    return out.select("id", "is_read", F.col("read_at").isNotNull().alias("newly"))


@query("n13_mark_all_read", """
SELECT id, is_read OR user_id IN (SELECT user_id FROM push_tokens WHERE platform = 'ios') AS is_read FROM notifications""")
def _(m):
    return audience.mark_all_read(m.notifications, m.push_tokens.filter("platform = 'ios'"), m.as_of).select("id", "is_read")


SENTENCE_SPLIT = "list_filter(list_transform(string_split(regexp_replace(replace({t}, chr(10), ' '), '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)), lambda s: trim(s)), lambda s: s <> '')"


def sql_pack(text, limit):
    """Sentences packed greedily: chunks are joined by chr(1)."""
    listed = SENTENCE_SPLIT.format(t=text)
    last = "regexp_extract(acc, '([^\x01]*)$', 1)"
    packed = f"list_reduce({listed}, lambda acc, s: CASE WHEN length({last}) + 1 + length(s) <= {limit} THEN acc || ' ' || s ELSE acc || chr(1) || s END)"
    return f"CASE WHEN len({listed}) = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split({packed}, chr(1)) END"


@query("n14_thread_chunks", f"""
WITH {DIGESTS}, texts AS (SELECT d, ids, array_to_string(list_transform(heads, lambda h: h || ' It matters to many readers across the whole region today. Officials will say more soon!'), chr(10) || chr(10)) AS txt FROM digests),
posts AS (SELECT d, list_concat(['🗞 Daily News — Daily Brief' || chr(10) || chr(10) || 'Key concern of the day ' || ids[1] || '. More below.' || chr(10) || chr(10) || '#news #today'],
  list_concat({sql_pack('txt', 280)}, ['📖 Read the full brief → https://news.example/digest/' || d])) AS p FROM texts)
SELECT CAST(d AS VARCHAR) AS digest_date, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS post FROM posts""")
def _(m):
    rows = audience.thread_chunks(digests(m), "Daily News", "#news #today", "https://news.example")
    return rows.withColumn("digest_date", F.col("digest_date").cast("string"))


@query("n15_breaking_delivery_stats", f"""
WITH {REACHED} SELECT breaking_id, count(DISTINCT r.user_id) AS total_recipients, count(*) AS successful_deliveries FROM reached r JOIN push_tokens t ON t.user_id = r.user_id AND t.is_active GROUP BY 1""")
def _(m):
    return audience.breaking_delivery_stats(reached(m, counted=True))


@query("n16_digest_page", f"""
WITH {DIGESTS}, pub AS (SELECT * FROM digests WHERE day(d) % 7 <> 0), top AS (SELECT max(d) AS d FROM pub)
SELECT CAST(top.d AS VARCHAR) AS shown_date, len(pub.ids) * 1 AS n_paragraphs, (SELECT string_agg(CAST(d AS VARCHAR), ',' ORDER BY d DESC) FROM (SELECT d FROM pub WHERE d < top.d ORDER BY d DESC LIMIT 14)) AS previous,
  top.d < DATE '2024-02-02' AS waiting_for_today, 'Brief from ' || strftime(top.d, '%-d %B') AS digest_label,
  (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY last_seen_at DESC, id) FROM (SELECT id, last_seen_at FROM stories WHERE status = 'active' AND short_summary <> '' ORDER BY last_seen_at DESC, id LIMIT 6)) AS latest_stories
FROM top JOIN pub ON pub.d = top.d""")
def _(m):
    rows = audience.digest_page(digests(m), m.stories, m.as_of + F.expr("INTERVAL 46 HOURS"), "Africa/Kampala")
    return rows.select(
        F.col("shown_date").cast("string").alias("shown_date"), F.size("paragraphs").alias("n_paragraphs"),
        F.array_join(F.transform("previous", lambda d: d.cast("string")), ",").alias("previous"), "waiting_for_today", "digest_label",
        F.array_join(F.transform("latest_stories", lambda s: s.cast("string")), ",").alias("latest_stories"),
    )


@query("t12_shorten", """
SELECT id, CASE WHEN len(w) <= 450 THEN content ELSE array_to_string(w[1:450], ' ') || '...' END AS words450,
  CASE WHEN length(content) <= 120 THEN content ELSE rtrim(substr(content, 1, 119), ' ') || '…' END AS short
FROM (SELECT id, content, list_filter(regexp_split_to_array(content, '[\\s\\x0B\\x1c-\\x1f\\x85\\p{Z}]+'), lambda x: x <> '') AS w FROM articles)""")
def _(m):
    return m.articles.select("id", tx.truncate_words(F.col("content")).alias("words450"), tx.shorten(F.col("content"), 120).alias("short"))


@query("t12_sentences", r"""
WITH c AS (SELECT id, content, substr(content, 1, 300) AS chunk, regexp_extract(substr(content, 1, 300), '(?s)^(.+[.!?])(?:[ \n].*)?$', 1) AS ended,
  list_filter(list_transform(string_split(regexp_replace(trim(content, ' ' || chr(10)), '([.!?])([ \n])', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '') AS parts FROM articles),
f AS (SELECT *, array_to_string(parts[1:2], ' ') AS firsts FROM c)
SELECT id, CASE WHEN length(content) <= 300 THEN content WHEN ended <> '' AND length(ended) > greatest(1, length(chunk) - 119) THEN rtrim(ended, ' ' || chr(10))
    ELSE rtrim(CASE WHEN regexp_extract(chunk, '(?s)^(.+) [^ ]*$', 1) <> '' THEN regexp_extract(chunk, '(?s)^(.+) [^ ]*$', 1) ELSE chunk END, ' ') || '…' END AS to_sentence,
  CASE WHEN length(firsts) <= 200 THEN firsts ELSE rtrim(CASE WHEN regexp_extract(substr(firsts, 1, 200), '(?s)^(.+) [^ ]*$', 1) <> '' THEN regexp_extract(substr(firsts, 1, 200), '(?s)^(.+) [^ ]*$', 1)
    ELSE substr(firsts, 1, 200) END, ' ') || '…' END AS first FROM f""")
def _(m):
    return m.articles.select(
        "id", tx.shorten_to_sentence(F.col("content"), 300).alias("to_sentence"), tx.first_sentences(F.col("content"), 200).alias("first")
    )


@query("t13_pack_sentences", f"""
SELECT id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS chunk FROM (SELECT id, {sql_pack('content', 280)} AS p FROM articles)""")
def _(m):
    return m.articles.select("id", F.posexplode(tx.pack_sentences(F.col("content"), 280)).alias("pos", "chunk"))


@query("t13_pack_sentences_lateral", f"""
SELECT id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS chunk FROM (SELECT id, {sql_pack('content', 280)} AS p FROM articles)""")
def _(m):
    """The same rows from SQL, by the registered table function."""
    table_functions.register(m.spark)
    return m.spark.sql("SELECT a.id, p.pos, p.chunk FROM {articles} a, LATERAL pack_sentences(a.content, 280) p", articles=m.articles)


@query("t14_tag_entities", """
SELECT article_id, replace(replace('Met Entity ' || (article_id % 50) || ' & friends <today>', '&', '&amp;'), '<today>', '&lt;today&gt;') AS plain,
  'Met <a class="entity entity-person" href="/stories/?q=Entity%20' || (article_id % 50) || '">Entity ' || (article_id % 50) || '</a> &amp; friends &lt;today&gt;' AS tagged FROM enrichments""")
def _(m):
    name = F.concat(F.lit("Entity "), F.col("article_id") % 50)
    text = F.concat(F.lit("Met "), name, F.lit(" & friends <today>"))
    listed = F.array(F.struct(F.lit("Entity").alias("name"), F.lit("location").alias("type")), F.struct(name.alias("name"), F.lit("person").alias("type")))
    return m.enrichments.select("article_id", tx.escape_html(text).alias("plain"), tx.tag_entities(text, listed).alias("tagged"))


@query("t15_time_ago", f"""
WITH u AS (SELECT id, date_diff('minute', scraped_at, {AS_OF_SQL}) AS mins FROM articles),
p AS (SELECT id, mins, mins // 10080 AS w, mins % 10080 // 1440 AS d, mins % 1440 // 60 AS h, mins % 60 AS m FROM u)
SELECT id, CASE WHEN mins = 0 THEN '0 minutes' WHEN w > 0 THEN w || ' week' || CASE WHEN w = 1 THEN '' ELSE 's' END || CASE WHEN d > 0 THEN ', ' || d || ' day' || CASE WHEN d = 1 THEN '' ELSE 's' END ELSE '' END
  WHEN d > 0 THEN d || ' day' || CASE WHEN d = 1 THEN '' ELSE 's' END || CASE WHEN h > 0 THEN ', ' || h || ' hour' || CASE WHEN h = 1 THEN '' ELSE 's' END ELSE '' END
  WHEN h > 0 THEN h || ' hour' || CASE WHEN h = 1 THEN '' ELSE 's' END || CASE WHEN m > 0 THEN ', ' || m || ' minute' || CASE WHEN m = 1 THEN '' ELSE 's' END ELSE '' END
  ELSE m || ' minute' || CASE WHEN m = 1 THEN '' ELSE 's' END END AS ago FROM p""")
def _(m):
    return m.articles.select("id", tx.time_ago(F.col("scraped_at"), m.as_of).alias("ago"))


@query("t17_token_cost", """
SELECT article_id, CAST(round(CAST(input_tokens / 1000000.0 * CASE model_used WHEN 'gpt-4o' THEN 2.50 WHEN 'gpt-5-nano' THEN 0.05 ELSE 0.15 END
  + output_tokens / 1000000.0 * CASE model_used WHEN 'gpt-4o' THEN 10.0 WHEN 'gpt-5-nano' THEN 0.40 ELSE 0.60 END AS DECIMAL(18,10)), 6) AS DOUBLE) AS cost FROM enrichments""")
def _(m):
    return m.enrichments.select("article_id", clients.token_cost(F.col("model_used"), F.col("input_tokens"), F.col("output_tokens")).cast("double").alias("cost"))


def _agents(m: Model):
    agent = F.expr("element_at(array('Mozilla Android 14', 'Mozilla iPad Tablet', 'SmartTV Browser', 'Mozilla Linux x86', 'iPhone Mobile', 'Android Tablet'), cast(event_id % 6 AS int) + 1)")
    return m.raw("events").select("event_id", clients.classify_device(agent).alias("device"))


DEVICE = "CASE event_id % 6 WHEN 0 THEN 'mobile' WHEN 1 THEN 'tablet' WHEN 2 THEN 'tv' WHEN 3 THEN 'desktop' ELSE 'mobile' END"


@query("t19_classify_device", f"SELECT event_id, {DEVICE} AS device FROM events")
def _(m):
    return _agents(m)


@query("t20_recommended_quality", f"SELECT event_id, CASE WHEN {DEVICE} IN ('tv', 'desktop') THEN 'high' ELSE 'medium' END AS quality FROM events")
def _(m):
    return _agents(m).select("event_id", clients.recommended_quality(F.col("device")).alias("quality"))


@query("t21_client_ip", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '10.0.0.' || (event_id % 250) ELSE '192.168.1.1' END AS ip FROM events")
def _(m):
    forwarded = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" 10.0.0."), F.col("event_id") % 250, F.lit(", 172.16.0.1")))
    return m.raw("events").select("event_id", clients.client_ip(forwarded, F.lit("192.168.1.1")).alias("ip"))


@query("t24_next_send_at", """
SELECT id, CASE WHEN scheduled_minutes > 615 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END + to_minutes(scheduled_minutes) AS next_at FROM schedules""")
def _(m):
    now = m.as_of + F.expr("INTERVAL 615 MINUTES")
    return m.schedules.select("id", tx.next_send_at(F.col("scheduled_minutes"), now).alias("next_at"))
