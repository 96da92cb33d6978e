"""Registered queries for page extraction.

The given pages carry no structured data, so the queries for JSON-LD and meta fields run
on pages that Spark builds from the document table: whole texts as paragraphs, and the
structured data in the spellings outlets use.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.functions import text as tx
from pressline.functions import urls
from pressline.functions.markup import page_elements
from pressline.operators import extract, phrases
from pressline.plans.identity import WS, sql_canonical, sql_strip
from pressline.plans.model import AS_OF_SQL, Model
from pressline.plans.registry import query


def built_pages(m: Model):
    """One page per document; the forms of type, author, image and keywords vary."""
    rows = m.articles.selectExpr("id", "content", "source_id", f"unix_timestamp({AS_OF_SQL}) - unix_timestamp(published_at) AS age")
    node = F.concat(
        F.lit('"@type":'), F.when(F.col("id") % 3 == 0, F.lit('["Thing","NewsArticle"]')).otherwise(F.lit('"Article"')),
        F.lit(',"headline":"Headline  '), F.col("id"), F.lit('","author":'),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit('"By Writer '), F.col("id"), F.lit('"')))
        .when(F.col("id") % 3 == 1, F.concat(F.lit('{"name":"Writer '), F.col("id"), F.lit('"}')))
        .otherwise(F.concat(F.lit('[{"name":"Writer '), F.col("id"), F.lit('"},{"name":"Other"}]'))),
        F.lit(',"image":'),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit('"/img/'), F.col("id"), F.lit('.jpg"')))
        .when(F.col("id") % 3 == 1, F.concat(F.lit('{"url":"https://cdn.example/'), F.col("id"), F.lit('.jpg"}')))
        .otherwise(F.concat(F.lit('["//cdn.example/'), F.col("id"), F.lit('.jpg"]'))),
        F.lit(',"keywords":'),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit('"news, k'), F.col("id") % 9, F.lit('; news"')))
        .otherwise(F.concat(F.lit('["k'), F.col("id") % 9, F.lit('","k'), F.col("id") % 9, F.lit('","news"]'))),
        F.lit(',"datePublished":"'),
        F.when(F.col("id") % 3 == 0, F.concat(F.col("id") % 50 + 1, F.lit(" hours ago")))
        .when(F.col("id") % 3 == 1, F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"), F.lit("T08:30:00+03:00")))
        .otherwise(F.concat(F.lit("January "), F.col("id") % 28 + 1, F.lit(", 2024"))),
        F.lit('"'),
    )
    graph = F.when(
        F.col("id") % 4 == 0, F.concat(F.lit('{"@context":"x","@graph":[{"@type":"WebSite","name":"w"},{'), node, F.lit("}]}"))
    ).otherwise(F.concat(F.lit('[{"@type":"WebPage"},{'), node, F.lit("}]")))
    paragraphs = F.array_join(
        F.transform(F.split("content", "\n"), lambda p: F.concat(F.lit("<p>"), tx.escape_html(p), F.lit("</p>"))), ""
    )
    html = F.concat(
        F.lit('<html><head><meta name="description" content="About '), F.col("id"), F.lit('"><link rel="shortcut icon" href="/i'), F.col("id"),
        F.lit('.png"><script type="application/ld+json">'), graph,
        F.lit('</script></head><body><nav><p>Navigation text that is long enough to count</p></nav><main><article><h1>Other title</h1>'),
        paragraphs, F.lit('<p>Please subscribe to our daily newsletter now</p></article></main><footer><p>'), paragraphs, F.lit("</p></footer></body></html>"),
    )
    return rows.select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.site"), F.col("source_id"), F.lit(".example/my-section/story-"), F.col("id")).alias("url"), html.alias("html"))


def sql_squash(text):
    return sql_strip(f"regexp_replace({text}, '{WS}+', ' ', 'g')")


PHRASES = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in extract.BOILERPLATE) + "]"
KEPT = f"""kept AS (SELECT id, list_filter(list_transform(string_split(content, chr(10)), lambda p: {sql_squash('p')}),
    lambda p: length(p) >= 20 AND len(list_filter({PHRASES}, lambda x: contains(lower(p), x))) = 0) AS ps FROM articles),
bodies AS (SELECT id, list_filter(ps, lambda p, i: list_position(ps, p) = i) AS ps FROM kept),
counted AS (SELECT id, ps, array_to_string(ps, chr(10) || chr(10)) AS content, len(ps) AS paragraph_count,
    CASE WHEN len(ps) = 0 THEN 0 ELSE len(string_split(array_to_string(ps, ' '), ' ')) END AS word_count FROM bodies)"""
PUBLISHED = f"""CASE id % 3 WHEN 0 THEN {AS_OF_SQL} - to_hours(id % 50 + 1) WHEN 1 THEN TIMESTAMP '2024-01-01 05:30:00' + to_days(CAST(id % 28 AS INTEGER))
  ELSE TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(id % 28 AS INTEGER)) END"""
IMAGE = """CASE id % 3 WHEN 0 THEN 'https://www.site' || source_id || '.example/img/' || id || '.jpg' ELSE 'https://cdn.example/' || id || '.jpg' END"""
TAGS = "CASE WHEN id % 2 = 0 THEN 'news|k' || (id % 9) ELSE 'k' || (id % 9) || '|news' END"


@query("s2_extract_articles", f"""
WITH {KEPT} SELECT a.id AS page_id, 'story-' || a.id AS external_id, 'Headline ' || a.id AS title, 'About ' || a.id AS excerpt, c.content, c.word_count,
  c.paragraph_count, 'Writer ' || a.id AS author_name, {IMAGE} AS image_url, {TAGS} AS tags, 'My Section' AS category,
  {PUBLISHED} AS published_at, c.word_count >= 80 AS has_full_content, CASE WHEN c.word_count >= 80 THEN 'complete' ELSE 'partial' END AS scrape_status
FROM (SELECT id, source_id FROM articles) a JOIN (SELECT id AS cid, * EXCLUDE (id) FROM counted) c ON cid = id""")
def _(m):
    rows = extract.extract_articles(built_pages(m), None, m.as_of)
    return rows.withColumn("tags", F.array_join("tags", "|")).drop("url", "published_time_str")


@query("s2_extract_articles_raw_pages")
def _(m):
    rows = extract.extract_articles(m.raw("pages"), None, m.as_of)
    return rows.withColumn("tags", F.array_join("tags", "|"))


@query("x1_jsonld_nodes", """
SELECT id AS page_id, CASE WHEN id % 4 = 0 THEN 3 ELSE 2 END AS n_nodes FROM articles""")
def _(m):
    page = extract.parsed_pages(built_pages(m))
    return page.select("page_id", F.size("nodes").alias("n_nodes"))


@query("x2_jsonld_article", "SELECT id AS page_id, 'Headline  ' || id AS headline FROM articles")
def _(m):
    return extract.parsed_pages(built_pages(m)).select("page_id", "node.headline")


@query("x3_extract_title", f"""
SELECT page_id, {sql_squash("replace(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&quot;', chr(34)), '&amp;', '&')")} AS title FROM pages""")
def _(m):
    page = extract.parsed_pages(m.raw("pages"))
    return page.select("page_id", extract.extract_title(F.col("node"), F.col("page")).alias("title"))


SENTENCES = f"""list_filter(list_transform(string_split(regexp_replace(content, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda p: {sql_squash('p')}),
  lambda p: length(p) >= 20 AND len(list_filter({PHRASES}, lambda x: contains(lower(p), x))) = 0)"""
BLOCKS = f"""list_filter(list_transform(regexp_split_to_array(content, '\\n\\s*\\n+'), lambda p: {sql_squash('p')}),
  lambda p: length(p) >= 20 AND len(list_filter({PHRASES}, lambda x: contains(lower(p), x))) = 0)"""


@query("x4_body_paragraphs_from_text", f"""
SELECT id, array_to_string(CASE WHEN len(list_filter(regexp_split_to_array(trim(content), '\\n\\s*\\n+'), lambda p: trim(p) <> '')) > 1 THEN {BLOCKS} ELSE {SENTENCES} END, '|') AS paragraphs FROM articles""")
def _(m):
    rule = extract.default_rule()
    furniture = extract.phrase_pattern(rule["boilerplate"])
    found = extract.body_paragraphs_from_text(F.col("content"), furniture, rule["min_chars"])
    return m.articles.select("id", F.array_join(found, "|").alias("paragraphs"))


@query("x5_body_paragraphs_from_html", f"WITH {KEPT} SELECT id AS page_id, content FROM counted")
def _(m):
    page = extract.with_rules(built_pages(m), None).withColumn("page", page_elements(F.col("html")))
    return extract.body_paragraphs_from_html(page).select("page_id", F.array_join("from_html", "\n\n").alias("content"))


@query("x5_body_paragraphs_raw_pages")
def _(m):
    page = extract.with_rules(m.raw("pages"), None).withColumn("page", page_elements(F.col("html")))
    return extract.body_paragraphs_from_html(page).select("page_id", F.array_join("from_html", "\n\n").alias("content"))


@query("x6_is_boilerplate", f"""
SELECT id, length(title) < 20 OR len(list_filter({PHRASES}, lambda x: contains(lower(content), x))) > 0 AS boilerplate FROM articles""")
def _(m):
    furniture = extract.phrase_pattern(extract.default_rule()["boilerplate"])
    short = extract.is_boilerplate(F.col("title"), F.lit("(?!)"), F.lit(20))
    return m.articles.select("id", (short | extract.is_boilerplate(F.col("content"), furniture, F.lit(0))).alias("boilerplate"))


OUTLET_PHRASES = ["of the", "and the", "in the ", "to be", "die ", " der", "und ", "les ", "que ", "el ", "ing. ", "tion,"]


@query("x6_phrases_of_outlets", f"""
WITH p AS (SELECT s.id AS source_id, phrase FROM sources s, (SELECT unnest({OUTLET_PHRASES!r}) AS phrase, generate_subscripts({OUTLET_PHRASES!r}, 1) AS n) WHERE (s.id + n) % 5 = 0)
SELECT id, EXISTS (SELECT 1 FROM p WHERE p.source_id = a.source_id AND contains(lower(a.content), phrase)) AS held FROM articles a""")
def _(m):
    """A rules table with phrases of their own for many outlets, matched in one pass."""
    listed = F.array(*[F.lit(x) for x in OUTLET_PHRASES])
    rules = m.sources.select(F.col("id").alias("owner"), F.posexplode(listed).alias("n", "phrase")).filter((F.col("owner") + F.col("n") + 1) % 5 == 0)
    return phrases.owned_phrases(m.articles.select("id", F.col("source_id").alias("owner"), F.col("content").alias("text")), rules)


@query("x7_full_content_gate", """
SELECT id, word_count >= CASE WHEN source_id % 3 = 0 THEN 60 WHEN source_id % 3 = 1 THEN 70 ELSE 80 END AS has_full_content,
  CASE WHEN word_count >= CASE WHEN source_id % 3 = 0 THEN 60 WHEN source_id % 3 = 1 THEN 70 ELSE 80 END THEN 'complete' ELSE 'partial' END AS scrape_status FROM articles""")
def _(m):
    limit = F.when(F.col("source_id") % 3 == 0, 60).when(F.col("source_id") % 3 == 1, 70).otherwise(80)
    return extract.full_content_gate(m.articles.withColumn("min_words", limit)).select("id", "has_full_content", "scrape_status")


@query("x8_parse_published", f"""
SELECT id, CASE id % 6 WHEN 0 THEN {AS_OF_SQL} - to_minutes(id % 500) WHEN 1 THEN {AS_OF_SQL} - to_days(CAST(id % 40 AS INTEGER)) WHEN 2 THEN {AS_OF_SQL} - INTERVAL 1 DAY
  WHEN 3 THEN date_trunc('second', scraped_at) - INTERVAL 3 HOUR WHEN 4 THEN CAST(CAST(scraped_at AS DATE) AS TIMESTAMP) - INTERVAL 3 HOUR ELSE NULL END AS published_at FROM articles""")
def _(m):
    kind = F.col("id") % 6
    spelled = (
        F.when(kind == 0, F.concat(F.col("id") % 500, F.lit(" mins ago"))).when(kind == 1, F.concat(F.lit("Posted "), F.col("id") % 40, F.lit(" days ago")))
        .when(kind == 2, F.lit("Yesterday")).when(kind == 3, F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss'+03:00'"))
        .when(kind == 4, F.date_format("scraped_at", "MMMM d, yyyy")).otherwise(F.lit("soon"))
    )
    return m.articles.select("id", extract.parse_published(spelled, m.as_of, F.lit("Africa/Kampala")).alias("published_at"))


@query("x9_make_excerpt", """
SELECT id, CASE WHEN length(content) <= 260 THEN content WHEN contains(substr(content, 1, 260), ' ')
  THEN regexp_extract(substr(content, 1, 260), '(?s)^(.*) [^ ]*$', 1) || '...' ELSE substr(content, 1, 260) || '...' END AS excerpt FROM articles""")
def _(m):
    return m.articles.select("id", extract.make_excerpt(F.lit(""), F.array("content"), F.lit(260)).alias("excerpt"))


@query("x9_packed_excerpt")
def _(m):
    return m.articles.select("id", extract.packed_excerpt(F.split("content", "\n")).alias("excerpt"))


@query("x10_external_id_from_url", rf"""
WITH u AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') AS parts, {sql_canonical('url')} AS canonical FROM pages)
SELECT page_id, CASE WHEN regexp_extract(url, '-(\d{{6,}})/?$', 1) <> '' THEN regexp_extract(url, '-(\d{{6,}})/?$', 1) ELSE substr(sha1(url), 1, 16) END AS trailing_digits,
  CASE WHEN regexp_extract(url, '/(\d+)(?:/|$)', 1) <> '' THEN regexp_extract(url, '/(\d+)(?:/|$)', 1) ELSE substr(sha1(url), 1, 16) END AS path_number,
  substr(sha1(canonical), 1, 16) AS dated_slug, substr(sha1(canonical), 1, 16) AS canonical_hash,
  CASE WHEN len(parts) >= 2 THEN substr(parts[-1], 1, 64) ELSE substr(sha1(url), 1, 16) END AS last_segment FROM u""")
def _(m):
    rules = ["trailing_digits", "path_number", "dated_slug", "canonical_hash", "last_segment"]
    return m.raw("pages").select("page_id", *[urls.external_id(F.col("url"), F.lit(r)).alias(r) for r in rules])


@query("x11_category_from_url", """
WITH u AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') AS parts FROM pages)
SELECT page_id, CASE WHEN len(parts) = 0 THEN 'News' ELSE upper(substr(parts[1], 1, 1)) || lower(substr(parts[1], 2)) END AS first_segment,
  CASE WHEN len(parts) >= 2 THEN parts[2] ELSE 'News' END AS third_segment FROM u""")
def _(m):
    return m.raw("pages").select(
        "page_id", urls.category_from_url(F.col("url")).alias("first_segment"), urls.category_from_url(F.col("url"), 3).alias("third_segment")
    )


@query("x12_author_from_node", "SELECT id AS page_id, 'Writer ' || id AS author_name FROM articles")
def _(m):
    return extract.parsed_pages(built_pages(m)).select("page_id", extract.author_from_node(F.col("node")).alias("author_name"))


@query("x13_image_from_node", f"SELECT id AS page_id, {IMAGE} AS image_url FROM articles")
def _(m):
    page = extract.parsed_pages(built_pages(m))
    linked = page.select("page_id", "url", extract.image_link(F.col("node"), F.col("page")).alias("link"))
    return linked.select("page_id", urls.resolve_url(F.col("link"), F.col("url")).alias("image_url"))


@query("x14_tags_from_page", f"SELECT id AS page_id, {TAGS} AS tags FROM articles")
def _(m):
    page = extract.parsed_pages(built_pages(m))
    return page.select("page_id", F.array_join(extract.tags(F.col("node"), F.col("page"), 10), "|").alias("tags"))


@query("x15_listing_links", r"""
WITH a AS (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">', 1), 1) AS pos FROM pages),
b AS (SELECT page_id, regexp_extract(page_url, '^([a-z]+://[^/?#]*)', 1) || href AS url, substr(href, 2) AS title, pos FROM a WHERE length(substr(href, 2)) >= 8)
SELECT page_id, url, arg_min(title, pos) AS title, 2 AS origin FROM b GROUP BY page_id, url""")
def _(m):
    return extract.listing_links(m.raw("pages"), r"^/[^/]{8,}$")


@query("x16_resolve_url", """
SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/a/b.html' AS rooted, 'https://cdn.example/x' AS schemeless,
  regexp_extract(url, '^([a-z]+://[^/?#]*/(?:[^?#]*/)?)', 1) || 'next' AS sibling FROM pages""")
def _(m):
    def to(href):
        return urls.resolve_url(F.lit(href), F.col("url"))

    return m.raw("pages").select("page_id", to("/a/b.html").alias("rooted"), to("//cdn.example/x").alias("schemeless"), to("next").alias("sibling"))


@query("x17_html_to_text", rf"""
WITH plain AS (SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(html, '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
    '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', chr(1), 'g'), '(?s)<[a-zA-Z/!][^>]*>', chr(1), 'g') AS t FROM pages),
pieces AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(1)), lambda s: {sql_strip('s')}), lambda s: s <> ''), chr(10)) AS t FROM plain),
cued AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?s)//.*?//', ' ', 'g'), '(?im)^\s*cue\s*(in|out)\s*[:\-].*$', ' ', 'g') AS t FROM pieces),
parts AS (SELECT page_id, list_transform(regexp_split_to_array(t, '\n\s*\n'), lambda p: {sql_squash('p')}) AS ps FROM cued)
SELECT page_id, array_to_string(list_filter(ps, lambda p: length(p) > 2), chr(10) || chr(10)) AS text FROM parts""")
def _(m):
    return m.raw("pages").select("page_id", extract.html_to_text(F.col("html")).alias("text"))


@query("x18_favicon_candidates", """
SELECT id AS page_id, 0 AS priority, 'https://www.site' || source_id || '.example/i' || id || '.png' AS icon_url FROM articles
UNION ALL SELECT id, 1, 'https://www.site' || source_id || '.example/favicon.ico' FROM articles""")
def _(m):
    return extract.favicon_candidates(built_pages(m))
