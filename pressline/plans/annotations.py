"""Registered queries for the validation of model-written annotations.

The raw answers are written by Spark from the document and label tables, in the shapes a
model returns: fenced, blank, cut off, with wrong types, wrong enums and stray lists.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.operators import annotations
from pressline.plans.model import Model
from pressline.plans.registry import query


def raw_answers(m: Model):
    rows = m.articles.select(F.col("id").alias("article_id"), "url", "title", "source_id", "content").join(
        m.enrichments.select("article_id", "sentiment", "sentiment_score"), "article_id"
    )
    rows = rows.join(m.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id", "left")
    i = F.col("article_id")
    text = F.to_json(F.struct(F.col("content").alias("t")))
    summary = F.when(i % 13 == 5, F.lit('"note":1')).when(i % 13 == 6, F.lit('"summary":7')).otherwise(
        F.concat(F.lit('"summary":'), F.substring(text, F.lit(6), F.length(text) - 6))
    )
    body = F.concat(
        F.lit("{"), summary, F.lit(',"sentiment":"'), F.when(i % 9 == 0, F.lit("angry")).otherwise(F.col("sentiment")),
        F.lit('","importance_score":'), i % 14, F.lit(',"sentiment_score":'), F.col("sentiment_score") * 3,
        F.lit(',"themes":["sports","made-up","health","crime","economy"],"key_facts":["f1"," ","f'), i, F.lit('","f4","f5","f6","f7"],'),
        F.lit('"entities":{"people":[" Ann ",""],"organizations":["Org '), i, F.lit('"],"locations":[]},'),
        F.lit('"claims":[{"claim":" c1 ","confidence":1.7,"evidence_text":" e "},{"claim":""},{"claim":"c2","source_article_id":9},"x"],'),
        F.lit('"key_highlights":[{"text":"h1","type":"FACT"},{"text":"h1","type":"fact"},{"text":"h2","type":"link","url":"https://u.example"},'
              '{"text":"h3","type":"opinion"},{"text":"h4","type":"link","url":"ftp://x"}],'),
        F.lit('"citations":[{"article_id":'), i, F.lit(',"url":" u ","title":"t"},{"article_id":-5,"url":"v"}]}'),
    )
    raw = (
        F.when(i % 17 == 3, F.lit("  ")).when(i % 17 == 4, F.substring(body, F.lit(1), F.length(body) - 3))
        .when(i % 17 == 5, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(i % 17 == 6, F.concat(F.lit(" ```\n\n"), body, F.lit("\n\n``` ")))
        .otherwise(body)
    )
    return rows.select("article_id", "url", "title", "source_name", raw.alias("raw"))


def validated(m: Model):
    return annotations.validate_analysis(annotations.parse_model_json(raw_answers(m)))


ERROR = """CASE WHEN id % 17 = 3 THEN 'empty' WHEN id % 17 = 4 THEN 'invalid' WHEN id % 13 = 5 THEN 'missing required key: summary'
  WHEN id % 13 = 6 THEN 'key ''summary'' must be str' ELSE '' END"""


@query("v1_parse_model_json", """
SELECT id AS article_id, id % 17 NOT IN (3, 4) AS parsed, CASE id % 17 WHEN 3 THEN 'empty' WHEN 4 THEN 'invalid' ELSE '' END AS error FROM articles""")
def _(m):
    rows = annotations.parse_model_json(raw_answers(m))
    error = F.when(F.col("error").startswith("empty"), "empty").when(F.col("error").startswith("JSON parse failed"), "invalid").otherwise("")
    return rows.select("article_id", F.col("data").isNotNull().alias("parsed"), error.alias("error"))


@query("v2_validate_analysis", f"""
WITH e AS (SELECT a.id, a.content, {ERROR} AS error, n.sentiment, n.sentiment_score FROM articles a JOIN enrichments n ON n.article_id = a.id)
SELECT id AS article_id, error, CASE WHEN error = '' THEN md5(content) ELSE '' END AS summary_md5,
  CASE WHEN error <> '' THEN '' WHEN id % 9 = 0 THEN 'neutral' ELSE sentiment END AS sentiment,
  CASE WHEN error = '' THEN greatest(1, least(10, id % 14)) ELSE 0 END AS importance_score,
  CASE WHEN error = '' THEN round(greatest(-1.0, least(1.0, sentiment_score * 3)), 6) ELSE 0 END AS sentiment_score,
  CASE WHEN error = '' THEN 'sports|health|crime' ELSE '' END AS themes, CASE WHEN error = '' THEN 'f1|f' || id || '|f4|f5|f6' ELSE '' END AS key_facts,
  CASE WHEN error = '' THEN 'Ann' ELSE '' END AS people, CASE WHEN error = '' THEN 'Org ' || id ELSE '' END AS organizations FROM e""")
def _(m):
    rows = validated(m)
    error = (
        F.when(F.col("error").startswith("empty"), "empty").when(F.col("error").startswith("JSON parse failed"), "invalid")
        .otherwise(F.coalesce("error", F.lit("")))
    )
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    return rows.select(
        "article_id", error.alias("error"), F.coalesce(F.md5("summary"), F.lit("")).alias("summary_md5"),
        F.coalesce("sentiment", F.lit("")).alias("sentiment"), F.coalesce("importance_score", F.lit(0)).alias("importance_score"),
        F.round(F.coalesce("sentiment_score", F.lit(0.0)), 6).alias("sentiment_score"), joined("themes").alias("themes"),
        joined("key_facts").alias("key_facts"), joined("entities_people").alias("people"), joined("entities_organizations").alias("organizations"),
    )


@query("v3_claim_rows", f"""
SELECT id AS article_id, 0 AS pos, 'c1' AS claim_text, 1.0::DOUBLE AS confidence FROM articles WHERE {ERROR} = ''
UNION ALL SELECT id, 1, 'c2', 0.5 FROM articles WHERE {ERROR} = ''""")
def _(m):
    return annotations.claim_rows(validated(m))


@query("v4_normalize_highlights", f"""
SELECT id AS article_id, CASE WHEN {ERROR} = '' THEN 'h1/fact/|h2/link/https://u.example|h4/link/' ELSE '' END AS highlights FROM articles""")
def _(m):
    shown = F.transform("key_highlights", lambda h: F.concat_ws("/", h["text"], h["type"], F.coalesce(h["url"], F.lit(""))))
    return validated(m).select("article_id", F.coalesce(F.array_join(shown, "|"), F.lit("")).alias("highlights"))


@query("v5_normalize_citations", f"""
SELECT a.id AS article_id, CASE WHEN error = '' THEN a.id || '/' || a.url || '/' || s.name || '|' || a.id || '/u/' ELSE '' END AS citations
FROM (SELECT *, {ERROR} AS error FROM articles) a JOIN sources s ON s.id = a.source_id""")
def _(m):
    shown = F.transform("citations", lambda c: F.concat_ws("/", c["article_id"].cast("string"), c["url"], c["source"]))
    return validated(m).select("article_id", F.coalesce(F.array_join(shown, "|"), F.lit("")).alias("citations"))


@query("v6_validate_digest", """
WITH day AS (SELECT CAST(published_at AS DATE) AS d, id FROM articles), ids AS (SELECT d, list(id ORDER BY id)[1:50] AS ids FROM day GROUP BY d)
SELECT CAST(d AS VARCHAR) AS digest_date, CAST(ids[1] AS VARCHAR) AS top_stories, CAST(CASE WHEN len(ids) > 1 THEN 1 ELSE 0 END AS INTEGER) AS n_threads,
  CASE WHEN day(d) % 2 = 0 THEN ids[1] ELSE -1 END AS radar FROM ids""")
def _(m):
    from pressline.operators.ranking import top_n

    day = m.articles.select(F.to_date("published_at").alias("digest_date"), "id")
    few = top_n(day, ["digest_date"], [F.asc("id")], 50)
    ids = few.groupBy("digest_date").agg(F.array_sort(F.collect_list("id")).alias("valid_ids"))
    first = F.get("valid_ids", F.lit(0))
    second = F.coalesce(F.get("valid_ids", F.lit(1)), F.lit(-1))
    radar = F.when(F.dayofmonth("digest_date") % 2 == 0, first).otherwise(F.lit(-7))
    data = F.concat(
        F.lit('{"top_stories":[{"article_id":'), first, F.lit(',"headline":"a"},{"article_id":-3,"headline":"b"}],"story_threads":[{"title":"x","article_ids":['),
        first, F.lit(","), second, F.lit(']},{"title":"y","article_ids":[-9]}],"under_radar_story":{"article_id":'), radar, F.lit("}}"),
    )
    out = annotations.validate_digest(ids.withColumn("data", F.parse_json(data)))
    return out.select(
        F.col("digest_date").cast("string").alias("digest_date"),
        F.array_join(F.transform("top_stories", lambda s: s["article_id"].cast("string")), ",").alias("top_stories"),
        F.size("story_threads").alias("n_threads"), F.coalesce("under_radar_story.article_id", F.lit(-1)).alias("radar"),
    )


@query("v7_enrichment_state", """
SELECT article_id, CASE WHEN status = 'completed' OR sentiment = 'positive' THEN 'completed' WHEN sentiment = 'negative' THEN 'failed' ELSE 'skipped' END AS status,
  retry_count + CASE WHEN status <> 'completed' AND sentiment = 'negative' THEN 1 ELSE 0 END AS retry_count,
  CASE WHEN status = 'completed' OR sentiment = 'positive' THEN '' ELSE 'was ' || sentiment END AS error_message FROM enrichments""")
def _(m):
    outcomes = m.enrichments.select(
        "article_id", F.when(F.col("sentiment") == "negative", "network").when(F.col("sentiment") == "neutral", "data").alias("failure"),
        F.concat(F.lit("was "), F.col("sentiment")).alias("message"),
    )
    return annotations.enrichment_state(m.enrichments, outcomes)


@query("v7_retry_list", "SELECT article_id, retry_count FROM enrichments WHERE status = 'failed' AND retry_count < 2")
def _(m):
    return annotations.retry_list(m.enrichments).select("article_id", "retry_count")


@query("v8_pending_enrichment", """
SELECT id, scraped_at FROM articles WHERE has_full_content AND id NOT IN (SELECT article_id FROM enrichments WHERE status IN ('completed', 'processing'))
ORDER BY scraped_at DESC, id DESC LIMIT 50""")
def _(m):
    return annotations.pending_enrichment(m.articles, m.enrichments).select("id", "scraped_at")


@query("v9_model_costs", """
SELECT model_used, CAST(sum(round(CAST(input_tokens / 1000000.0 * CASE model_used WHEN 'gpt-4o' THEN 2.50 WHEN 'gpt-5-nano' THEN 0.05 ELSE 0.15 END
  + output_tokens / 1000000.0 * CASE model_used WHEN 'gpt-4o' THEN 10.0 WHEN 'gpt-5-nano' THEN 0.40 ELSE 0.60 END AS DECIMAL(18,10)), 6)) AS DOUBLE) AS total_cost,
  CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens FROM enrichments GROUP BY 1""")
def _(m):
    return annotations.model_costs(m.enrichments).withColumn("total_cost", F.col("total_cost").cast("double"))


@query("v10_summary_payload", """
WITH j AS (SELECT a.*, e.*, s.name AS source, CASE WHEN e.status IN ('completed', 'processing') THEN e.status WHEN NOT has_full_content THEN 'excerpt_only' ELSE 'to_do' END AS state
  FROM articles a JOIN enrichments e ON e.article_id = a.id JOIN sources s ON s.id = a.source_id)
SELECT article_id, state AS status, CASE WHEN state = 'completed' THEN title ELSE '' END AS title, CASE WHEN state = 'completed' THEN source ELSE '' END AS source,
  CASE state WHEN 'completed' THEN summary WHEN 'excerpt_only' THEN excerpt ELSE '' END AS summary,
  CASE WHEN state = 'completed' THEN array_to_string(key_facts, '|') ELSE '' END AS key_facts, CASE WHEN state = 'completed' THEN array_to_string(themes, '|') ELSE '' END AS themes,
  CASE WHEN state = 'completed' THEN array_to_string(related_themes, '|') ELSE '' END AS story_arcs, CASE WHEN state = 'completed' THEN importance_score ELSE 0 END AS importance_score,
  CASE WHEN state = 'completed' THEN impact_note ELSE '' END AS impact_note, CASE WHEN state = 'completed' THEN array_to_string(bias_notes, '|') ELSE '' END AS bias_notes,
  CASE WHEN state = 'processing' THEN 8 ELSE 0 END AS retry_after_seconds FROM j""")
def _(m):
    rows = annotations.summary_payload(m.articles, m.enrichments, m.sources)
    none = F.lit("")
    return rows.select(
        "article_id", "status", *[F.coalesce(c, none).alias(c) for c in ("title", "source", "summary", "impact_note")],
        *[F.coalesce(F.array_join(c, "|"), none).alias(c) for c in ("key_facts", "themes", "story_arcs", "bias_notes")],
        F.coalesce("importance_score", F.lit(0)).alias("importance_score"), F.coalesce("retry_after_seconds", F.lit(0)).alias("retry_after_seconds"),
    )
