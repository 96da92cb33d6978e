"""Registered queries for URLs, hashes and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.functions import text as tx
from pressline.functions import urls
from pressline.operators import identity
from pressline.operators.graph import connected_components, extended_components
from pressline.plans.model import AS_OF_SQL, Model
from pressline.plans.registry import query
from pressline.session import cut_lineage

WS = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"


def sql_strip(text):
    return rf"regexp_replace(regexp_replace({text}, '^{WS}+', ''), '{WS}+$', '')"


def sql_title(text):
    spaced = rf"regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"
    return sql_strip(f"regexp_replace({spaced}, '{WS}+', ' ', 'g')")


def sql_hash(text):
    return f"CASE WHEN {sql_strip(text)} = '' THEN '' ELSE sha256({sql_strip(text)}) END"


def sql_canonical(url):
    """Canonical form for the URLs of the test tables (no escapes in their queries)."""
    query_text = rf"regexp_extract({url}, '\?([^#]*)', 1)"
    kept = f"""array_to_string(list_sort(list_filter(string_split({query_text}, '&'),
      lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid'))), '&')"""
    path = f"regexp_replace(regexp_extract({url}, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
    return f"""lower(regexp_extract({url}, '^([A-Za-z]+):', 1)) || '://' || regexp_replace(lower(regexp_extract({url}, '://([^/?#]*)', 1)), '^www\\.', '')
      || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END"""


IDENTIFIED = f"""identified AS (SELECT *, {sql_canonical('url')} AS canonical_url, {sql_hash(sql_title('title'))} AS normalized_title_hash,
  {sql_hash('content')} AS content_hash FROM articles)"""


def identified(m: Model):
    return urls.identity_columns(m.articles)


def identity_table(m: Model):
    """The identity columns as a stored table: the texts are read once."""
    columns = ["id", "has_full_content", "word_count", "scraped_at", "url", "canonical_url", "external_id", "source_id", "normalized_title_hash", "title"]
    return cut_lineage(identified(m).select(*columns))


@query("t2_normalize_url", f"SELECT page_id, {sql_canonical('url')} AS canonical FROM pages")
def _(m):
    return m.raw("pages").select("page_id", urls.normalize_url(F.col("url")).alias("canonical"))


@query("t3_normalize_title", f"SELECT id, {sql_title('content')} AS words FROM articles")
def _(m):
    return m.articles.select("id", tx.normalize_title(F.col("content")).alias("words"))


@query("t4_hash_text", f"SELECT id, {sql_hash('content')} AS digest FROM articles")
def _(m):
    return m.articles.select("id", tx.hash_text(F.col("content")).alias("digest"))


@query("t5_bounded_identifier", f"""
SELECT id, CASE WHEN length(c) <= 120 THEN c ELSE substr(c, 1, 103) || '-' || substr(sha1(c), 1, 16) END AS bounded
FROM (SELECT id, {sql_strip(f"regexp_replace(content, '{WS}+', ' ', 'g')")} AS c FROM articles)""")
def _(m):
    return m.articles.select("id", tx.bounded_identifier(F.col("content")).alias("bounded"))


@query("t6_slugify", r"""
SELECT id, substr(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(regexp_replace(strip_accents(excerpt), '[^\x00-\x7F]', '', 'g')),
  '[^a-z0-9_\s-]', '', 'g')), '[-\s]+', '-', 'g'), '^[-_]+', ''), '[-_]+$', ''), 1, 200) AS slug FROM articles""")
def _(m):
    return m.articles.select("id", tx.slugify(F.col("excerpt")).alias("slug"))


@query("t7_identity_columns", f"""
WITH {IDENTIFIED} SELECT id, canonical_url, normalized_title_hash, content_hash, external_id AS source_published_id FROM identified""")
def _(m):
    return identified(m).select("id", "canonical_url", "normalized_title_hash", "content_hash", "source_published_id")


@query("t8_content_metrics", f"""
SELECT id, len(list_filter(regexp_split_to_array(content, '{WS}+'), lambda w: w <> '')) AS words,
  len(list_filter(string_split(content, chr(10) || chr(10)), lambda p: {sql_strip('p')} <> '')) AS paragraphs,
  greatest(1, len(list_filter(regexp_split_to_array(content, '{WS}+'), lambda w: w <> '')) // 200) AS minutes FROM articles""")
def _(m):
    words = tx.word_count(F.col("content"))
    return m.articles.select(
        "id", words.alias("words"), tx.paragraph_count(F.col("content")).alias("paragraphs"), tx.read_minutes(words).alias("minutes")
    )


@query("t9_event_date", f"""
SELECT id, coalesce(CASE WHEN id % 4 = 0 THEN NULL ELSE published_at END, CASE WHEN id % 8 = 0 THEN NULL ELSE scraped_at END, {AS_OF_SQL}) AS event_date FROM articles""")
def _(m):
    published = F.when(F.col("id") % 4 != 0, F.col("published_at"))
    scraped = F.when(F.col("id") % 8 != 0, F.col("scraped_at"))
    return m.articles.select("id", tx.event_date(published, scraped, m.as_of).alias("event_date"))


def dup_sql(keys, rule, rows="identified", extra=""):
    key = ", ".join(keys)
    return f"""
SELECT '{rule}' AS rule, id, keeper_id, group_size FROM (SELECT id, count(*) OVER (PARTITION BY {key}) AS group_size,
  first_value(id) OVER (PARTITION BY {key} ORDER BY has_full_content DESC, word_count DESC, scraped_at, id) AS keeper_id FROM {rows} {extra})
WHERE group_size > 1 AND id <> keeper_id"""


RUNS = """marked AS (SELECT *, CASE WHEN scraped_at - lag(scraped_at) OVER w <= INTERVAL 30 DAY THEN 0 ELSE 1 END AS starts FROM identified
  WHERE normalized_title_hash <> '' WINDOW w AS (PARTITION BY normalized_title_hash, source_id ORDER BY scraped_at)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY normalized_title_hash, source_id ORDER BY scraped_at RANGE UNBOUNDED PRECEDING) AS run FROM marked)"""
RULES = " UNION ALL ".join([
    dup_sql(["url"], "url"), dup_sql(["canonical_url"], "canonical_url"), dup_sql(["external_id", "source_id"], "external_id"),
    dup_sql(["normalized_title_hash", "source_id", "run"], "title", "runs"),
])


@query("d1_dup_groups_canonical_url", f"WITH {IDENTIFIED} {dup_sql(['canonical_url'], 'canonical_url')}")
def _(m):
    return identity.dup_groups(identified(m), ["canonical_url"], "canonical_url")


@query("d1_dup_groups_external_id", f"WITH {IDENTIFIED} {dup_sql(['external_id', 'source_id'], 'external_id')}")
def _(m):
    return identity.dup_groups(identified(m), ["external_id", "source_id"], "external_id")


@query("d2_title_dups", f"WITH {IDENTIFIED}, {RUNS} {dup_sql(['normalized_title_hash', 'source_id', 'run'], 'title', 'runs')}")
def _(m):
    return identity.title_dups(identified(m))


@query("d3_pick_keeper", f"""
WITH {IDENTIFIED} SELECT content_hash, arg_min(id, struct_pack(a := NOT has_full_content, b := -word_count, c := scraped_at, d := id)) AS keeper_id,
  count(*) AS group_size FROM identified GROUP BY content_hash""")
def _(m):
    return identity.pick_keeper(identified(m), ["content_hash"])


@query("d4_dedupe_plan", f"WITH {IDENTIFIED}, {RUNS} SELECT DISTINCT id FROM ({RULES})")
def _(m):
    return identity.dedupe_plan(identity_table(m))


@query("d4_dedupe_audit", f"""
WITH {IDENTIFIED}, {RUNS} SELECT rule, count(DISTINCT keeper_id) AS n_groups, count(*) AS n_remove FROM ({RULES}) GROUP BY rule""")
def _(m):
    return identity.dedupe_audit(identity_table(m))


@query("d4_extended_components", """
WITH RECURSIVE e AS (SELECT a.id AS src, b.id AS dst FROM articles a JOIN articles b ON a.external_id = b.external_id AND a.source_id = b.source_id
  UNION SELECT a.id, b.id FROM articles a JOIN articles b ON a.title = b.title),
reach(a, b) AS (SELECT id, id FROM articles UNION SELECT r.a, e.dst FROM reach r JOIN e ON e.src = r.b)
SELECT a AS id, min(b) AS component FROM reach GROUP BY a""")
def _(m):
    """Classes of articles with one outlet's id, extended by those with one title."""
    def stars(*keys):
        first = m.articles.groupBy(*keys).agg(F.min("id").alias("dst"))
        return m.articles.join(first, list(keys)).select(F.col("id").alias("src"), "dst")

    labels = cut_lineage(connected_components(stars("external_id", "source_id")))
    alone = m.articles.select("id").join(labels, "id", "left_anti").select("id", F.col("id").alias("component"))
    return extended_components(labels.unionByName(alone), stars("title"))


@query("d4_apply_dedupe", f"WITH {IDENTIFIED}, {RUNS} SELECT id, title FROM articles WHERE id NOT IN (SELECT id FROM ({RULES}))")
def _(m):
    rows = identity_table(m)
    return identity.apply_dedupe(rows, identity.dedupe_plan(rows)).select("id", "title")


@query("d4_dedupe_plan_transitive", f"""
WITH RECURSIVE {IDENTIFIED}, {RUNS}, pairs AS (SELECT DISTINCT id, keeper_id FROM ({RULES})),
edges AS (SELECT id AS a, keeper_id AS b FROM pairs UNION SELECT keeper_id, id FROM pairs),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a),
members AS (SELECT articles.*, component FROM articles JOIN comp ON comp.id = articles.id)
SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY component ORDER BY has_full_content DESC, word_count DESC, scraped_at, id) AS r FROM members) WHERE r > 1""")
def _(m):
    return identity.dedupe_plan(identity_table(m), transitive=True)


@query("d5_match_existing", f"""
WITH {IDENTIFIED}, fresh AS (SELECT * FROM identified WHERE scraped_at >= {AS_OF_SQL} - to_days(7)), stored AS (SELECT * FROM identified WHERE scraped_at < {AS_OF_SQL} - to_days(7)),
hits AS (SELECT n.id AS new_id, s.id AS existing_id, s.scraped_at, CASE WHEN s.external_id = n.external_id AND s.source_id = n.source_id THEN 1
    WHEN s.canonical_url = n.canonical_url THEN 2 WHEN s.url = n.url THEN 3 WHEN s.content_hash = n.content_hash THEN 4 ELSE 5 END AS priority
  FROM fresh n JOIN stored s ON (s.external_id = n.external_id AND s.source_id = n.source_id) OR s.canonical_url = n.canonical_url OR s.url = n.url
    OR (s.content_hash = n.content_hash AND n.content_hash <> '')
    OR (s.normalized_title_hash = n.normalized_title_hash AND s.source_id = n.source_id AND s.scraped_at >= {AS_OF_SQL} - INTERVAL 30 DAY))
SELECT new_id, existing_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY priority, scraped_at DESC, existing_id) AS r FROM hits) WHERE r = 1""")
def _(m):
    rows = identified(m)
    week_ago = m.as_of - F.expr("INTERVAL 7 DAYS")
    return identity.match_existing(rows.filter(F.col("scraped_at") >= week_ago), rows.filter(F.col("scraped_at") < week_ago), m.as_of)


@query("j11_priority_lookup", f"""
WITH {IDENTIFIED}, hits AS (SELECT n.id AS new_id, s.id AS existing_id, s.scraped_at, CASE WHEN s.external_id = n.external_id AND s.source_id = n.source_id THEN 1
    WHEN s.canonical_url = n.canonical_url THEN 2 WHEN s.url = n.url THEN 3 WHEN s.content_hash = n.content_hash THEN 4 ELSE 5 END AS priority
  FROM identified n JOIN identified s ON (s.external_id = n.external_id AND s.source_id = n.source_id) OR s.canonical_url = n.canonical_url OR s.url = n.url
    OR (s.content_hash = n.content_hash AND n.content_hash <> '') OR (s.normalized_title_hash = n.normalized_title_hash AND s.source_id = n.source_id))
SELECT new_id, existing_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY priority, scraped_at DESC, existing_id) AS r FROM hits) WHERE r = 1""")
def _(m):
    """Every article looked up in the whole corpus: the newest of its own key group."""
    rows = identified(m)
    return identity.match_existing(rows, rows, m.as_of)


@query("d6_already_sent", f"""
SELECT DISTINCT user_id, article_id FROM views WHERE (user_id, article_id) IN (SELECT (user_id, article_id) FROM history WHERE sent_at >= {AS_OF_SQL} - to_days(7))""")
def _(m):
    return identity.already_sent(m.views.select("user_id", "article_id").distinct(), m.history, m.as_of)
