"""Registered queries for story clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.functions import vectors as vec
from pressline.operators import stories
from pressline.plans.identity import sql_strip
from pressline.plans.model import AS_OF_SQL, Model
from pressline.plans.registry import query
from pressline.session import cut_lineage

LATER_SQL = "TIMESTAMP '2024-03-05 00:00:00'"


def later(m: Model):
    """A time at which every story of the model is old enough to be revived."""
    return m.as_of + F.expr("INTERVAL 34 DAYS")


def embedded(m: Model):
    """All embedded, completed articles as the matcher reads them."""
    no_links = m.story_articles.limit(0)
    return stories.unassigned(m.enrichments, m.vectors, no_links, m.articles)


def matchable(m: Model):
    """Stories with centroid and names."""
    centroid = stories.update_centroids(m.story_articles, m.enrichments, m.vectors).select(F.col("story_id").alias("id"), "centroid")
    names = stories.story_entity_sets(m.story_articles, m.enrichments, m.articles).withColumnRenamed("story_id", "id")
    return m.stories.join(centroid, "id").join(names.select("id", "entity_set"), "id", "left")


def judge(article_id, story_id):
    """Stands for an adjudicator: a third of the pairs each way."""
    kind = (article_id + story_id) % 3
    return F.when(kind == 0, "same_story").when(kind == 1, "related_story").otherwise("unrelated")


NAMES = """list_distinct(list_concat(list_transform(entities_people, lambda n: 'person:' || lower(n)), list_concat(
  list_transform(entities_organizations, lambda n: 'org:' || lower(n)), list_transform(entities_locations, lambda n: 'loc:' || lower(n)))))"""
EMBEDDED = f"""emb AS (SELECT e.article_id, v.embedding AS v, published_at, scraped_at, importance_score, {NAMES} AS names
  FROM enrichments e JOIN vectors v ON v.article_id = e.article_id JOIN articles a ON a.id = e.article_id
  WHERE status = 'completed' AND NOT list_contains(themes, 'sports'))"""
CENTROIDS = f"""ranked AS (SELECT sa.story_id, v.embedding, row_number() OVER (PARTITION BY sa.story_id ORDER BY analyzed_at DESC, e.article_id DESC) AS r
  FROM story_articles sa JOIN enrichments e ON e.article_id = sa.article_id JOIN vectors v ON v.article_id = sa.article_id WHERE status = 'completed'),
parts AS (SELECT story_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM ranked),
means AS (SELECT story_id, pos, avg(CAST(x AS DOUBLE)) AS x FROM parts GROUP BY 1, 2),
centroids AS (SELECT story_id, list(x ORDER BY pos) AS c FROM means GROUP BY 1),
newest AS (SELECT sa.story_id, {NAMES} AS names, row_number() OVER (PARTITION BY sa.story_id ORDER BY published_at DESC, a.id DESC) AS r
  FROM story_articles sa JOIN enrichments e ON e.article_id = sa.article_id JOIN articles a ON a.id = sa.article_id WHERE status = 'completed'),
story_names AS (SELECT story_id, list(DISTINCT n) AS names FROM (SELECT story_id, unnest(names) AS n FROM newest) GROUP BY 1),
matchable AS (SELECT s.*, c, coalesce(n.names, []) AS names FROM stories s JOIN centroids ON centroids.story_id = s.id LEFT JOIN story_names n ON n.story_id = s.id)"""


def sql_jaccard(a, b):
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


ACTIVE = f"""pairs AS (SELECT e.article_id, s.id AS story_id, last_seen_at, s.importance_score, list_cosine_similarity(e.v, s.c) AS cos,
    {sql_jaccard('e.names', 's.names')} AS ent, floor(epoch(published_at - last_seen_at) / 86400) AS days
  FROM emb e JOIN matchable s ON s.status = 'active' AND last_seen_at >= {AS_OF_SQL} - to_days(14)),
scored AS (SELECT *, cos >= 0.86 AS strong, CASE WHEN cos >= 0.86 THEN cos WHEN ent >= 0.04 THEN 0.7 * cos + 0.3 * ent ELSE 0 END AS score
  FROM pairs WHERE cos >= 0.52 AND abs(days) <= 14),
best AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY strong DESC, CASE WHEN strong THEN 0 ELSE score END DESC,
    last_seen_at DESC, importance_score DESC, story_id) AS r FROM scored WHERE score > 0),
active AS (SELECT article_id, story_id, strong, score, cos, ent, strong OR score >= 0.66 AS attached FROM best WHERE r = 1)"""


def revival_sql(as_of, rows="emb"):
    return f"""old AS (SELECT e.article_id, s.id AS story_id, last_seen_at, s.importance_score, list_cosine_similarity(e.v, s.c) AS cos, {sql_jaccard('e.names', 's.names')} AS ent
  FROM {rows} e JOIN matchable s ON last_seen_at >= {as_of} - to_days(365) AND last_seen_at < {as_of} - to_days(14)),
candidates AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY cos DESC, last_seen_at DESC, importance_score DESC, story_id) AS r FROM old WHERE cos >= 0.62),
decided AS (SELECT *, CASE WHEN r = 1 AND cos >= 0.80 AND ent >= 0.10 THEN 'attach' WHEN (article_id + story_id) % 3 = 0 THEN 'attach'
    WHEN (article_id + story_id) % 3 = 1 THEN 'related' END AS action FROM candidates WHERE r <= 2),
revival AS (SELECT article_id, story_id, action FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY r) AS k FROM decided WHERE action IS NOT NULL) WHERE k = 1)"""


EMBEDDING_TEXT = f"""title || chr(10) || CASE WHEN {sql_strip('content')} <> '' THEN {sql_strip('content')} ELSE summary END || chr(10) || 'Entities: ' ||
  array_to_string(list_concat(entities_people, list_concat(entities_organizations, entities_locations)), ', ') || chr(10) || 'Topics: ' || array_to_string(themes, ', ')"""


@query("c1_embedding_text", f"SELECT article_id, {EMBEDDING_TEXT} AS text FROM enrichments JOIN articles ON articles.id = article_id")
def _(m):
    return stories.embedding_text(m.articles, m.enrichments)


@query("c2_pending_embeddings", """
SELECT article_id FROM enrichments WHERE status = 'completed' AND NOT list_contains(themes, 'sports') AND article_id NOT IN (SELECT vec_id FROM embeddings)""")
def _(m):
    return stories.pending_embeddings(m.enrichments, m.embeddings).select("article_id")


@query("c2_embed_pending", f"""
SELECT article_id, length({EMBEDDING_TEXT}) AS first_value FROM enrichments JOIN articles ON articles.id = article_id
WHERE status = 'completed' AND NOT list_contains(themes, 'sports') AND article_id NOT IN (SELECT vec_id FROM embeddings)""")
def _(m):
    waiting = stories.pending_embeddings(m.enrichments, m.embeddings)
    counted = lambda text: F.array(F.length(text).cast("float"), F.ascii(text).cast("float"))
    made = stories.embed_pending(waiting, m.articles, counted)
    return made.select("article_id", F.get("embedding", F.lit(0)).cast("bigint").alias("first_value"))


@query("c2_unassigned", f"""
WITH {EMBEDDED} SELECT article_id, importance_score, array_to_string(list_sort(names), '|') AS names FROM emb
WHERE article_id NOT IN (SELECT article_id FROM story_articles WHERE relevance_score >= 0.75)""")
def _(m):
    linked = m.story_articles.filter("relevance_score >= 0.75")
    rows = stories.unassigned(m.enrichments, m.embeddings, linked, m.articles)
    return rows.select("article_id", "importance_score", F.array_join(F.array_sort("entity_set"), "|").alias("names"))


@query("c3_cosine", f"""
WITH {CENTROIDS} SELECT sa.story_id, sa.article_id, round(list_cosine_similarity(v.embedding, c), 6) AS cosine
FROM story_articles sa JOIN vectors v ON v.article_id = sa.article_id JOIN centroids ON centroids.story_id = sa.story_id""")
def _(m):
    centroid = stories.update_centroids(m.story_articles, m.enrichments, m.vectors).select("story_id", "centroid")
    rows = m.story_articles.join(m.vectors, "article_id").join(centroid, "story_id")
    return rows.select("story_id", "article_id", F.round(vec.cosine(F.col("embedding"), F.col("centroid")), 6).alias("cosine"))


@query("c4_entity_jaccard", f"""
WITH {EMBEDDED}, {CENTROIDS} SELECT sa.story_id, sa.article_id, round({sql_jaccard('emb.names', 'n.names')}, 6) AS similarity
FROM story_articles sa JOIN emb ON emb.article_id = sa.article_id JOIN story_names n ON n.story_id = sa.story_id""")
def _(m):
    names = stories.story_entity_sets(m.story_articles, m.enrichments, m.articles).select("story_id", F.col("entity_set").alias("story_set"))
    rows = m.story_articles.join(embedded(m), "article_id").join(names, "story_id")
    return rows.select("story_id", "article_id", F.round(vec.jaccard(F.col("entity_set"), F.col("story_set")), 6).alias("similarity"))


@query("c5_match_active", f"""
WITH {EMBEDDED}, {CENTROIDS}, {ACTIVE} SELECT article_id, story_id, strong, round(score, 6) AS score, round(cos, 6) AS cosine, round(ent, 6) AS entity, attached FROM active""")
def _(m):
    found = stories.match_active(embedded(m), matchable(m), m.as_of)
    return found.select("article_id", "story_id", "strong", *[F.round(c, 6).alias(c) for c in ("score", "cosine", "entity")], "attached")


@query("j7_interval_similarity_join", f"""
WITH {EMBEDDED}, {CENTROIDS}, pairs AS (SELECT e.article_id, s.id AS story_id, list_cosine_similarity(e.v, s.c) AS cos, CAST(floor(epoch(published_at - last_seen_at) / 86400) AS INTEGER) AS days
  FROM emb e JOIN matchable s ON true) SELECT article_id, story_id, round(cos, 6) AS cosine, days FROM pairs WHERE cos >= 0.52 AND abs(days) <= 14""")
def _(m):
    pairs = stories.interval_similarity_join(embedded(m), matchable(m))
    return pairs.withColumn("cosine", F.round("cosine", 6))


@query("c6_match_revival", f"WITH {EMBEDDED}, {CENTROIDS}, {revival_sql(LATER_SQL)} SELECT article_id, story_id, action FROM revival")
def _(m):
    return stories.match_revival(embedded(m), matchable(m), stories.verdicts_by(judge), later(m)).select("article_id", "story_id", "action")


@query("c7_assign_batch", f"""
WITH RECURSIVE {EMBEDDED}, {CENTROIDS}, {ACTIVE}, rest AS (SELECT * FROM emb WHERE article_id NOT IN (SELECT article_id FROM active WHERE attached)),
{revival_sql(AS_OF_SQL, 'rest')},
residue AS (SELECT * FROM rest WHERE article_id NOT IN (SELECT article_id FROM revival WHERE action = 'attach')),
twos AS (SELECT a.article_id AS a, b.article_id AS b, list_cosine_similarity(a.v, b.v) AS cos, {sql_jaccard('a.names', 'b.names')} AS ent
  FROM residue a JOIN residue b ON a.article_id <> b.article_id AND floor(abs(epoch(a.published_at - b.published_at)) / 86400) <= 14),
edges AS (SELECT a, b FROM twos WHERE cos >= 0.86 OR (cos >= 0.52 AND ent >= 0.04 AND 0.7 * cos + 0.3 * ent >= 0.66)),
reach(a, b) AS (SELECT article_id, article_id FROM residue UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
groups AS (SELECT a AS article_id, min(b) AS group_id FROM reach GROUP BY a),
seeds AS (SELECT group_id, arg_min(r.article_id, struct_pack(d := published_at, i := r.article_id)) AS seed FROM groups g JOIN residue r ON r.article_id = g.article_id GROUP BY 1)
SELECT article_id, 'attached' AS action, story_id AS target, round(score, 6) AS relevance, -1 AS related FROM active WHERE attached
UNION ALL SELECT article_id, 'revived', story_id, 0.8, -1 FROM revival WHERE action = 'attach'
UNION ALL SELECT g.article_id, CASE WHEN g.article_id = seed THEN 'created' ELSE 'grouped' END, seed, round(CASE WHEN g.article_id = seed THEN greatest(coalesce(x.score, 0), 0.5)
    ELSE greatest(list_cosine_similarity(r.v, sr.v), 0.5) END, 6), coalesce(v.story_id, -1)
  FROM groups g JOIN seeds USING (group_id) JOIN residue r ON r.article_id = g.article_id JOIN residue sr ON sr.article_id = seed
  LEFT JOIN active x ON x.article_id = g.article_id LEFT JOIN revival v ON v.article_id = g.article_id""")
def _(m):
    made = stories.assign_batch(embedded(m), matchable(m), stories.verdicts_by(judge), m.as_of)
    seeds = made.filter("action = 'created'").select("story_id", F.col("article_id").alias("seed"))
    joined = made.join(seeds, "story_id", "left")
    return joined.select(
        "article_id", "action", F.coalesce("seed", "story_id").alias("target"), F.round("relevance_score", 6).alias("relevance"),
        F.coalesce("related_story_id", F.lit(-1)).alias("related"),
    )


def assignments(m: Model):
    """The model's stories as if their earliest article had created them."""
    dated = m.story_articles.join(m.articles.select(F.col("id").alias("article_id"), "published_at"), "article_id")
    first = dated.groupBy("story_id").agg(F.min_by("article_id", F.struct("published_at", "article_id")).alias("seed"))
    action = F.when(F.col("article_id") == F.col("seed"), "created").otherwise("grouped")
    return m.story_articles.join(first, "story_id").select(
        "story_id", "article_id", "relevance_score", action.alias("action"), F.lit(None).cast("bigint").alias("related_story_id")
    )


SEEDS = """seeds AS (SELECT story_id, arg_min(article_id, struct_pack(d := published_at, i := article_id)) AS seed, min(published_at) AS first_seen_at,
  max(published_at) AS last_seen_at, max(importance_score) AS importance, count(*) AS n FROM story_articles JOIN articles ON articles.id = article_id
  JOIN enrichments USING (article_id) GROUP BY 1)"""


@query("c8_new_story_card", f"""
WITH {SEEDS}, card AS (SELECT story_id, n, importance, s.first_seen_at, s.last_seen_at, coalesce(nullif(neutral_title, ''), title) AS title, summary, impact_note, themes[1] AS primary_theme,
    list_filter(key_facts[1:6], lambda f: trim(f) <> '') AS facts, entities_people AS p, entities_organizations AS o, entities_locations AS l
  FROM seeds s JOIN articles a ON a.id = seed JOIN enrichments e ON e.article_id = seed),
texts AS (SELECT *, concat_ws(' ', title, summary, impact_note, array_to_string(facts, ' ')) AS txt FROM card)
SELECT story_id, title, summary, impact_note AS why_this_matters, primary_theme, importance AS importance_score, n AS article_count, first_seen_at, last_seen_at,
  array_to_string(facts, '|') AS highlights, len(list_distinct(list_filter(list_concat(p, list_concat(o, l)), lambda x: contains(txt, x)))) AS n_entities FROM texts""")
def _(m):
    cards = stories.new_story_card(assignments(m), m.articles, m.enrichments, m.sources, m.as_of)
    return cards.select(
        "story_id", "title", "summary", "why_this_matters", "primary_theme", "importance_score", "article_count", "first_seen_at", "last_seen_at",
        F.array_join(F.transform("key_highlights", lambda h: h["text"]), "|").alias("highlights"), F.size("entities").alias("n_entities"),
    )


@query("c9_story_links", """
SELECT story_id, article_id, relevance_score FROM story_articles WHERE article_id NOT IN (SELECT article_id FROM story_articles WHERE relevance_score >= 0.9)""")
def _(m):
    existing = m.story_articles.filter("relevance_score >= 0.9")
    return stories.story_links(assignments(m), existing)


@query("c9_story_perspectives", """
SELECT story_id, article_id, source_id, summary AS framing_summary, array_to_string(themes, '|') AS notable_emphasis, sentiment_score
FROM story_articles JOIN articles ON articles.id = article_id JOIN enrichments USING (article_id)""")
def _(m):
    rows = stories.story_perspectives(assignments(m), m.articles, m.enrichments)
    return rows.withColumn("notable_emphasis", F.array_join("notable_emphasis", "|"))


@query("c9_story_timeline", """
SELECT story_id, article_id, title, published_at AS event_date, summary AS description, url AS cited
FROM story_articles JOIN articles ON articles.id = article_id JOIN enrichments USING (article_id)""")
def _(m):
    rows = stories.story_timeline(assignments(m), m.articles, m.enrichments, m.as_of)
    return rows.withColumn("cited", F.get("citations", F.lit(0))["url"]).drop("citations")


@query("c7_refreshed_stories", f"""
WITH gained AS (SELECT story_id, max(published_at) AS d, max(importance_score) AS i, count(*) AS n_new FROM story_articles JOIN articles ON articles.id = article_id
  JOIN enrichments USING (article_id) WHERE relevance_score >= 0.8 GROUP BY 1)
SELECT id, greatest(last_seen_at, d) AS last_seen_at, greatest(importance_score, i) AS importance_score, 'active' AS status, n_new FROM stories JOIN gained ON story_id = id""")
def _(m):
    gained = m.story_articles.filter("relevance_score >= 0.8").withColumn("action", F.lit("attached"))
    rows = stories.refreshed_stories(m.stories, gained, m.articles, m.enrichments, m.as_of)
    return rows.select("id", "last_seen_at", "importance_score", "status", "n_new")


@query("c10_update_centroids", f"""
WITH {CENTROIDS}, touched AS (SELECT DISTINCT story_id FROM story_articles JOIN articles ON articles.id = article_id WHERE published_at >= {AS_OF_SQL} - to_days(3))
SELECT story_id, pos - 1 AS pos, round(x, 5) AS x FROM means WHERE story_id IN (SELECT story_id FROM touched)""")
def _(m):
    recent = m.articles.filter(F.col("published_at") >= m.as_of - F.expr("INTERVAL 3 DAYS")).select(F.col("id").alias("article_id"))
    touched = m.story_articles.join(recent, "article_id", "left_semi").select("story_id").distinct()
    rows = stories.update_centroids(m.story_articles, m.enrichments, m.vectors, touched)
    return rows.select("story_id", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 5))


@query("c11_needs_synthesis", """
WITH counts AS (SELECT story_id, count(DISTINCT article_id) AS n FROM story_articles GROUP BY 1)
SELECT id AS story_id, n AS article_count, CASE WHEN version = 0 THEN 'first synthesis (' || n || ' articles)' ELSE (n - articles_at_synthesis) || ' new articles since v' || version END AS reason
FROM stories JOIN counts ON story_id = id WHERE n >= 2 AND (version = 0 OR n - articles_at_synthesis >= 1)""")
def _(m):
    return stories.needs_synthesis(m.stories, m.story_articles, m.enrichments, m.articles)


@query("c12_synthesis_payload", """
WITH rows AS (SELECT story_id, a.id, s.name AS source, published_at, title, summary, key_facts, importance_score, row_number() OVER (PARTITION BY story_id ORDER BY published_at, a.id) AS r,
    row_number() OVER (PARTITION BY story_id ORDER BY published_at DESC, a.id DESC) AS back FROM story_articles sa JOIN articles a ON a.id = sa.article_id
    JOIN enrichments e ON e.article_id = a.id JOIN sources s ON s.id = a.source_id WHERE status = 'completed'),
listed AS (SELECT story_id, count(*) AS n, '[' || string_agg(CAST(to_json(struct_pack(article_id := id, source := source, published := strftime(published_at, '%Y-%m-%d %H:%M:%S'), title := title,
    summary := summary, key_facts := key_facts, importance := importance_score)) AS VARCHAR), ',' ORDER BY r) || ']' AS articles_json FROM rows GROUP BY 1),
lines AS (SELECT from_story_id AS story_id, string_agg(substr('- [' || CAST(CAST(last_seen_at AS DATE) AS VARCHAR) || '] ' || title || ': ' || short_summary, 1, 300), chr(10) ORDER BY to_story_id) AS t
  FROM story_relations JOIN stories ON stories.id = to_story_id GROUP BY 1)
SELECT listed.story_id, n AS article_count, articles_json, coalesce(t, '(none)') AS related_stories, '[' || source || '] ' || title || ' — ' || summary AS latest_article
FROM listed JOIN rows ON rows.story_id = listed.story_id AND back = 1 LEFT JOIN lines ON lines.story_id = listed.story_id""")
def _(m):
    return stories.synthesis_payload(m.stories, m.story_articles, m.articles, m.enrichments, m.sources, m.story_relations)


def versions(m: Model):
    rows = m.stories.select(F.col("id").alias("story_id"), F.explode(F.sequence(F.lit(1), (F.col("id") % 13 + 1).cast("int"))).alias("version"))
    return rows.withColumn("title", F.concat(F.lit("v"), F.col("version")))


VERSIONS = "versions AS (SELECT id AS story_id, unnest(generate_series(1, id % 13 + 1)) AS version FROM stories)"


@query("c13_apply_synthesis", f"""
WITH {VERSIONS}, members AS (SELECT story_id, min(article_id) AS lo, max(article_id) AS hi, count(*) AS n FROM story_articles GROUP BY 1)
SELECT s.id AS story_id, greatest(s.version, (SELECT max(version) FROM versions v WHERE v.story_id = s.id)) + 1 AS version,
  CASE WHEN s.id % 2 = 0 THEN s.title ELSE 'Written ' || s.id END AS title, s.why_this_matters, n AS article_count,
  'Point ' || s.id || '/' || CASE WHEN lo = hi THEN 2 ELSE 2 END || '/' || hi || ':http://www.Wire.example|Second/1/' AS highlights, 'Entity ' || s.id || '/person' AS entities
FROM stories s JOIN members ON members.story_id = s.id""")
def _(m):
    members = m.story_articles.groupBy("story_id").agg(F.min("article_id").alias("lo"), F.max("article_id").alias("hi"))
    i = F.col("story_id")
    none = F.array().cast("array<bigint>")
    point = F.struct(F.concat(F.lit("Point "), i).alias("text"), F.array(F.col("hi"), F.lit(-1).cast("bigint"), F.col("lo")).alias("article_ids"))
    listed = F.array(point, F.struct(F.lit("").alias("text"), none.alias("article_ids")), F.struct(F.lit("Second").alias("text"), none.alias("article_ids")))
    named = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("type"))
    own = F.concat(F.lit(" Entity "), i)
    written = members.select(
        "story_id", F.when(i % 2 == 0, "").otherwise(F.concat(F.lit("Written "), i)).alias("title"),
        F.concat(F.lit("About Entity "), i, F.lit(" today")).alias("short_summary"), F.lit("").alias("overview"), F.lit("").alias("why_it_matters"),
        F.lit("forced").alias("reason"), listed.alias("highlights"),
        F.array(named(own, "person"), named(own, "location"), named(F.lit("Nobody"), "person"), named(F.lit("About"), "thing")).alias("entities"),
    )
    out = stories.apply_synthesis(m.stories, written, m.story_articles, m.articles, m.sources, versions(m))
    first = lambda h: F.coalesce(F.concat(F.get(h["citations"], F.lit(0))["article_id"], F.lit(":"), F.substring(F.get(h["citations"], F.lit(0))["url"], 1, 23)), F.lit(""))
    shown = F.transform("key_highlights", lambda h: F.concat_ws("/", h["text"], h["sources_count"].cast("string"), first(h)))
    return out.select(
        "story_id", "version", "title", "why_this_matters", "article_count", F.array_join(shown, "|").alias("highlights"),
        F.array_join(F.transform("entities", lambda e: F.concat_ws("/", e["name"], e["type"])), "|").alias("entities"),
    )


@query("c14_split_contaminated", """
WITH dated AS (SELECT story_id, article_id, published_at AS d, importance_score AS imp FROM story_articles JOIN articles ON articles.id = article_id JOIN enrichments USING (article_id)),
marked AS (SELECT *, CASE WHEN floor(epoch(d - lag(d) OVER w) / 86400) > 0 THEN 1 ELSE 0 END AS starts FROM dated WINDOW w AS (PARTITION BY story_id ORDER BY d)),
runs AS (SELECT *, 1 + sum(starts) OVER (PARTITION BY story_id ORDER BY d RANGE UNBOUNDED PRECEDING) AS no FROM marked),
groups AS (SELECT story_id, no, count(*) AS n, min(d) AS first_seen_at, max(d) AS last_seen_at, max(imp) AS imp, avg(CAST(v.embedding[1] AS DOUBLE)) AS c0
  FROM runs JOIN embeddings v ON v.vec_id = article_id GROUP BY 1, 2),
sized AS (SELECT *, count(*) OVER (PARTITION BY story_id) AS n_groups, row_number() OVER (PARTITION BY story_id ORDER BY n DESC, no) AS r FROM groups)
SELECT story_id, CAST(no AS BIGINT) AS session_no, r = 1 AS kept, n AS article_count, first_seen_at, last_seen_at, imp AS importance_score, round(c0, 5) AS c0 FROM sized WHERE n_groups > 1""")
def _(m):
    out = stories.split_contaminated(m.story_articles, m.articles, m.enrichments, m.embeddings, gap_days=0)
    return out.select(
        "story_id", "session_no", "kept", "article_count", "first_seen_at", "last_seen_at", "importance_score",
        F.round(F.get("centroid", F.lit(0)), 5).alias("c0"),
    )


@query("c15_prune_by_theme", """
WITH doomed AS (SELECT id FROM stories WHERE primary_theme = 'sports')
SELECT 'stories' AS name, id AS story_id, count(*) AS n FROM stories WHERE primary_theme <> 'sports' GROUP BY 2
UNION ALL SELECT 'links', story_id, count(*) FROM story_articles WHERE story_id NOT IN (SELECT id FROM doomed) GROUP BY 2
UNION ALL SELECT 'alerts', story_id, count(*) FROM alerts WHERE story_id NOT IN (SELECT id FROM doomed) GROUP BY 2""")
def _(m):
    kept = stories.prune_by_theme(m.stories, "sports", {"links": m.story_articles, "alerts": m.alerts})
    kept["stories"] = kept["stories"].withColumnRenamed("id", "story_id")
    out = None
    for name, df in kept.items():
        part = df.groupBy("story_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "story_id", "n")
        out = part if out is None else out.unionByName(part)
    return out


def rebuilt(m: Model):
    """A rebuild in which every 13th article has no publication date."""
    articles = m.articles.withColumn("published_at", F.when(F.col("id") % 13 != 0, F.col("published_at")))
    return stories.rebuild_all(articles, m.enrichments, m.vectors, stories.verdicts_by(judge), m.as_of, batch_days=8)


@query("c16_rebuild_all")
def _(m):
    return rebuilt(m)


@query("c16_rebuild_members", f"""
WITH {EMBEDDED} SELECT article_id, 1::BIGINT AS n_stories, true AS seeded FROM emb""")
def _(m):
    """Every eligible article, dated or not, is in one story, and every story has the article that made it."""
    done = cut_lineage(rebuilt(m))
    seeds = done.filter("action = 'created'").select("story_id").distinct().withColumn("seeded", F.lit(True))
    joined = done.join(seeds, "story_id", "left")
    return joined.groupBy("article_id").agg(F.countDistinct("story_id").alias("n_stories"), F.every(F.coalesce("seeded", F.lit(False))).alias("seeded"))


@query("c17_story_card", """
WITH full_a AS (SELECT * FROM articles WHERE has_full_content), counts AS (SELECT story_id, count(DISTINCT article_id) AS n, count(DISTINCT source_id) AS ns
  FROM story_articles JOIN full_a ON full_a.id = article_id GROUP BY 1),
outlets AS (SELECT story_id, source_id, max(struct_pack(a := relevance_score, b := -article_id)) AS best FROM story_articles JOIN full_a ON full_a.id = article_id GROUP BY 1, 2),
listed AS (SELECT story_id, string_agg('Source ' || source_id, '|' ORDER BY best.a DESC, best.b DESC) AS sources FROM outlets GROUP BY 1),
pics AS (SELECT story_id, arg_max(image_url, struct_pack(a := relevance_score, b := -article_id)) AS url FROM story_articles JOIN articles ON articles.id = article_id WHERE image_url <> '' GROUP BY 1)
SELECT id AS story_id, title, status, upper(substr(primary_theme, 1, 1)) || substr(primary_theme, 2) AS theme_display, coalesce(n, 0) AS article_count, coalesce(ns, 0) AS source_count,
  coalesce(sources, '') AS sources, coalesce(url, '') AS card_image_url FROM stories LEFT JOIN counts c ON c.story_id = id LEFT JOIN listed l ON l.story_id = id LEFT JOIN pics p ON p.story_id = id""")
def _(m):
    cards = stories.story_card(m.stories, m.story_articles, m.articles, m.sources)
    return cards.select(
        "story_id", "title", "status", "theme_display", "article_count", "source_count", F.array_join("sources", "|").alias("sources"),
        F.coalesce("card_image_url", F.lit("")).alias("card_image_url"),
    )


@query("c17_story_articles", """
SELECT story_id, article_id, row_number() OVER (PARTITION BY story_id ORDER BY relevance_score DESC, importance_score DESC, published_at DESC, article_id) AS position,
  CASE WHEN status = 'completed' THEN summary ELSE '' END AS summary, sentiment_score
FROM story_articles JOIN articles ON articles.id = article_id JOIN enrichments USING (article_id) WHERE has_full_content""")
def _(m):
    framing = stories.story_perspectives(assignments(m), m.articles, m.enrichments)
    rows = stories.story_articles(m.story_articles, m.articles, m.enrichments, framing)
    return rows.select("story_id", "article_id", "position", F.coalesce("summary", F.lit("")).alias("summary"), "sentiment_score")


@query("c17_story_versions", f"""
WITH {VERSIONS} SELECT story_id, version, rank FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY version DESC) AS rank FROM versions) WHERE rank <= 10""")
def _(m):
    return stories.story_versions(versions(m)).select("story_id", "version", "rank")


@query("j10_related_stories", """
SELECT from_story_id AS story_id, id, relation_type, 'earlier' AS direction, title, last_seen_at FROM story_relations JOIN stories ON id = to_story_id
UNION ALL SELECT to_story_id, id, relation_type, 'later', title, last_seen_at FROM story_relations JOIN stories ON id = from_story_id""")
def _(m):
    return stories.related_stories(m.stories, m.story_relations).drop("slug")


@query("c18_eli5_stale", "SELECT id, version, eli5_version FROM stories WHERE eli5_version < version")
def _(m):
    return stories.eli5_stale(m.stories).select("id", "version", "eli5_version")
