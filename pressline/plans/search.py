"""Registered queries for search."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import functions as F

from pressline.operators import search, substrings
from pressline.plans.feeds import ELIGIBLE, eligible
from pressline.plans.model import AS_OF_SQL, Model
from pressline.plans.registry import query
from pressline.session import shared_dir

QUERIES = [
    (1, "the and"), (2, '"of the"'), (3, "nation or rechts"), (4, "the -and"), (5, "xyzzy tion"), (6, "zzzz politics"),
    (7, '"by the" -"of the"'), (8, "qqqq"), (9, "on the"),
]
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
INDEX = f"""
occ AS (SELECT id, unnest({TOKENS.format('title')}) AS term, 't' AS f FROM pool UNION ALL SELECT id, unnest({TOKENS.format('excerpt')}), 'e' FROM pool
  UNION ALL SELECT id, unnest({TOKENS.format('content')}), 'c' FROM pool),
postings AS (SELECT term, id, count(*) FILTER (WHERE f = 't') AS tf_title, count(*) FILTER (WHERE f = 'e') AS tf_excerpt,
  count(*) FILTER (WHERE f = 'c') AS tf_content FROM occ GROUP BY 1, 2),
idx AS (SELECT *, CASE WHEN tf_title > 0 THEN 1.0 * (1 + ln(tf_title)) ELSE 0 END + CASE WHEN tf_excerpt > 0 THEN 0.4 * (1 + ln(tf_excerpt)) ELSE 0 END
  + CASE WHEN tf_content > 0 THEN 0.2 * (1 + ln(tf_content)) ELSE 0 END AS weight FROM postings)"""
JOINED = " || ' | ' || ".join(f"' ' || array_to_string({TOKENS.format(f)}, ' ') || ' '" for f in ("title", "excerpt", "content"))
POOL = f"""pool AS (SELECT a.*, s.name AS source_name, c.name AS category_name, {JOINED} AS toks
  FROM {ELIGIBLE} a JOIN sources s ON s.id = a.source_id JOIN categories c ON c.id = a.category_id)"""


def _has(*terms):
    return " AND ".join(f"id IN (SELECT id FROM idx WHERE term = '{t}')" for t in terms)


def _rank(*terms):
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"(SELECT sum(weight) FROM idx i WHERE i.id = pool.id AND term IN ({listed}))"


FTS = f"""fts AS (SELECT query_id, id, max(rank) AS rank FROM (
  SELECT 1 AS query_id, id, {_rank('the', 'and')} AS rank FROM pool WHERE {_has('the', 'and')}
  UNION ALL SELECT 2, id, {_rank('of', 'the')} FROM pool WHERE {_has('of', 'the')} AND contains(toks, ' of the ')
  UNION ALL SELECT 3, id, {_rank('nation')} FROM pool WHERE {_has('nation')} UNION ALL SELECT 3, id, {_rank('rechts')} FROM pool WHERE {_has('rechts')}
  UNION ALL SELECT 4, id, {_rank('the')} FROM pool WHERE {_has('the')} AND NOT contains(toks, ' and ')
  UNION ALL SELECT 5, id, {_rank('xyzzy', 'tion')} FROM pool WHERE {_has('xyzzy', 'tion')}
  UNION ALL SELECT 6, id, {_rank('zzzz', 'politics')} FROM pool WHERE {_has('zzzz', 'politics')}
  UNION ALL SELECT 7, id, {_rank('by', 'the')} FROM pool WHERE {_has('by', 'the')} AND contains(toks, ' by the ') AND NOT contains(toks, ' of the ')
  UNION ALL SELECT 8, id, {_rank('qqqq')} FROM pool WHERE {_has('qqqq')}
  UNION ALL SELECT 9, id, {_rank('on', 'the')} FROM pool WHERE {_has('on', 'the')}) GROUP BY query_id, id)"""


def pool(m: Model):
    names = m.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    sections = m.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    # Texts stay where they are; a shuffle by outlet or section would pile them up in few tasks.
    return eligible(m).join(F.broadcast(names), "source_id").join(F.broadcast(sections), "category_id")


_indexes: dict[tuple[str, str, str], str] = {}


def stored_index(m: Model, name: str, write: Callable[[str], object]) -> str:
    """The folder of an index over the model's articles, written once per application and data folder."""
    key = (m.spark.sparkContext.applicationId, m.folder, name)
    if key not in _indexes:
        path = f"{shared_dir(m.spark)}/search-{uuid.uuid4().hex}"
        write(path)
        _indexes[key] = path
    return _indexes[key]


def postings(m: Model):
    """Stored postings with positions of the searchable articles."""
    path = stored_index(m, "postings", lambda to: search.write_search_index(search.build_search_index(pool(m), positions=True, packed=True), to))
    return m.spark.read.parquet(path)


def maxima(m: Model):
    return m.spark.read.parquet(stored_index(m, "maxima", lambda to: search.block_maxima(postings(m)).write.parquet(to)))


def grams(m: Model):
    """The stored gram index over all six fields."""
    path = stored_index(m, "grams", lambda to: substrings.write_gram_index(search.tag_names(pool(m)), search.SIX_FIELDS, to))
    return substrings.GramIndex(m.spark, path, search.SIX_FIELDS)


@query("q1_build_search_index", f"""
WITH pool AS (SELECT * FROM articles), {INDEX} SELECT term, id, tf_title, tf_excerpt, tf_content, round(weight, 6) AS weight FROM idx""")
def _(m):
    return search.build_search_index(m.articles).withColumn("weight", F.round("weight", 6))


@query("q2_fts_search", f"WITH {POOL}, {INDEX}, {FTS} SELECT query_id, id, round(rank, 6) AS rank FROM fts")
def _(m):
    return search.fts_search(QUERIES, pool(m), postings(m)).withColumn("rank", F.round("rank", 6))


@query("q2_fts_built_for_the_queries", f"WITH {POOL}, {INDEX}, {FTS} SELECT query_id, id, round(rank, 6) AS rank FROM fts")
def _(m):
    """The postings of the queries' terms alone, from one scan."""
    return search.fts_search(QUERIES, pool(m)).withColumn("rank", F.round("rank", 6))


@query("q2_fts_top", f"""
WITH {POOL}, {INDEX}, {FTS} SELECT query_id, id, round(rank, 6) AS rank FROM fts QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, id DESC) <= 10""")
def _(m):
    return search.fts_top(QUERIES, postings(m), maxima(m), 10).withColumn("rank", F.round("rank", 6))


@query("q3_phrase_search", f"SELECT id FROM {ELIGIBLE} WHERE contains(lower(title), 'of the') OR contains(lower(excerpt), 'of the')")
def _(m):
    return search.phrase_search(eligible(m), "of the").select("id")


def _terms_sql(terms, how, fields=("title", "excerpt", "content")):
    return how.join("(" + " OR ".join(f"contains(lower({f}), '{t}')" for f in fields) + ")" for t in terms)


@query("q4_all_terms_search", f"SELECT id FROM {ELIGIBLE} WHERE {_terms_sql(('tion', 'ere', 'ing'), ' AND ')}")
def _(m):
    return search.all_terms_search(eligible(m), "tion, ere (ing)").select("id")


SIX = ("title", "excerpt", "content", "source_name", "category_name", "array_to_string(tags, ' ')")


@query("q5_any_term_search", f"WITH {POOL} SELECT id FROM pool WHERE {_terms_sql(('politics', 'heitlich'), ' OR ', SIX)}")
def _(m):
    return search.any_term_search(pool(m), "politics heitlich").select("id")


def _tier(qid, phrase, terms):
    return f"""
  UNION ALL SELECT {qid}, id, 2, NULL FROM pool WHERE contains(lower(title), '{phrase}') OR contains(lower(excerpt), '{phrase}')
  UNION ALL SELECT {qid}, id, 3, NULL FROM pool WHERE {_terms_sql(terms, ' AND ')}
  UNION ALL SELECT {qid}, id, 4, NULL FROM pool WHERE {_terms_sql(terms, ' OR ', SIX)}"""


NEEDLES = ["of the", "e", "ve", "the", "nation", "é", "zzqq", "politics", "t4", "source 1", "ich "]


@query("q5_substrings", f"WITH {POOL} " + " UNION ALL ".join(
    f"SELECT {n} AS needle, id FROM pool WHERE {_terms_sql([t], '', SIX)}" for n, t in enumerate(NEEDLES)))
def _(m):
    """Needles of any length, from the gram index."""
    wanted = [substrings.Needle(n, t, search.SIX_FIELDS) for n, t in enumerate(NEEDLES)]
    found = substrings.substring_matches(wanted, search.tag_names(pool(m)), grams(m))
    return found.select(F.col("key").cast("int").alias("needle"), "id")


@query("q3_q4_q5_indexed", f"""
WITH {POOL} SELECT 1 AS query_id, id, 2 AS tier FROM pool WHERE contains(lower(title), 'tion, ere (ing)') OR contains(lower(excerpt), 'tion, ere (ing)')
UNION ALL SELECT 1, id, 3 FROM pool WHERE {_terms_sql(('tion', 'ere', 'ing'), ' AND ')} UNION ALL SELECT 1, id, 4 FROM pool WHERE {_terms_sql(('tion', 'ere', 'ing'), ' OR ', SIX)}
UNION ALL SELECT 2, id, 2 FROM pool WHERE contains(lower(title), 'of the') OR contains(lower(excerpt), 'of the')
UNION ALL SELECT 2, id, 3 FROM pool WHERE {_terms_sql(('the',), ' AND ')} UNION ALL SELECT 2, id, 4 FROM pool WHERE {_terms_sql(('the',), ' OR ', SIX)}""")
def _(m):
    """The three text strategies from the gram index."""
    found = search.indexed_text_search([(1, "tion, ere (ing)"), (2, "of the")], search.tag_names(pool(m)), grams(m))
    return found.select(F.col("query_id").cast("int").alias("query_id"), "id", "tier")


CASCADE = "SELECT query_id, id, 1 AS tier, rank FROM fts" + "".join(
    _tier(qid, text, search.search_terms(text)) for qid, text in QUERIES
)


@query("q6_cascade_search", f"""
WITH {POOL}, {INDEX}, {FTS}, matches AS ({CASCADE}),
best AS (SELECT *, min(tier) OVER (PARTITION BY query_id) AS first_tier FROM matches)
SELECT query_id, id, tier, round(coalesce(rank, 0), 6) AS rank FROM best WHERE tier = first_tier""")
def _(m):
    found = search.cascade_search(QUERIES, pool(m), postings(m), grams(m))
    return found.withColumn("rank", F.round(F.coalesce("rank", F.lit(0.0)), 6))


@query("q7_search_terms", r"""
SELECT id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(title, '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda w: length(w) >= 3), ' ') AS terms FROM articles""")
def _(m):
    words = F.split(F.regexp_replace("title", r"[^\p{L}\p{N}_\s]", " "), r"\s+")
    return m.articles.select("id", F.array_join(F.filter(words, lambda w: F.length(w) >= 3), " ").alias("terms"))


@query("q8_suggestions", f"""
SELECT part, suggestion FROM (
  (SELECT 1 AS part, title AS suggestion FROM articles WHERE scraped_at >= {AS_OF_SQL} - to_days(7) AND has_full_content AND contains(lower(title), 'er')
   GROUP BY title ORDER BY max(scraped_at) DESC, title LIMIT 5)
  UNION ALL (SELECT 2, name FROM categories WHERE contains(name, 'er') ORDER BY name LIMIT 2)
  UNION ALL (SELECT 3, name FROM sources WHERE contains(lower(name), 'er') AND is_active ORDER BY name LIMIT 2))""")
def _(m):
    return search.suggestions(m.articles, m.categories, m.sources, "er", m.as_of, 10)


PARTIAL = ["er", "the", "x", " Politics ", "source 1", "of the", "zzqq", "and the re", "nt", ""]


def _suggested(n, text):
    t = text.strip().lower()
    if len(t) < 2:
        return f"SELECT {n} AS query_id, 1 AS part, '' AS suggestion WHERE false"
    return f"""SELECT {n} AS query_id, * FROM (
  (SELECT 1 AS part, title AS suggestion FROM articles WHERE scraped_at >= {AS_OF_SQL} - to_days(7) AND has_full_content AND contains(lower(title), '{t}')
   GROUP BY title ORDER BY max(scraped_at) DESC, title LIMIT 5)
  UNION ALL (SELECT DISTINCT 2, name FROM categories WHERE contains(lower(name), '{t}') ORDER BY name LIMIT 2)
  UNION ALL (SELECT DISTINCT 3, name FROM sources WHERE contains(lower(name), '{t}') AND is_active ORDER BY name LIMIT 2))"""


@query("q8_suggest_many", " UNION ALL ".join(_suggested(n, text) for n, text in enumerate(PARTIAL)))
def _(m):
    """Suggestions for many partial texts from a table of suffixes."""
    entries = search.suggestion_entries(m.articles, m.categories, m.sources, m.as_of)
    path = stored_index(m, "suffixes", lambda to: search.suggestion_suffixes(entries).repartitionByRange("key").write.parquet(to))
    suffixes = m.spark.read.parquet(path)
    short = m.spark.read.parquet(stored_index(m, "short", lambda to: search.short_suggestions(suffixes).write.parquet(to)))
    requests = m.spark.createDataFrame(list(enumerate(PARTIAL)), "query_id int, text string")
    return search.suggest_many(requests, suffixes, short)


@query("l5_search_sort_relevance", f"""
WITH {POOL}, {INDEX}, {FTS} SELECT id, round(rank, 6) AS rank FROM fts JOIN articles USING (id) WHERE query_id = 9
ORDER BY fts.rank DESC, CASE WHEN contains(lower(title), 'on the') THEN 1 ELSE 0 END DESC, scraped_at DESC, id DESC LIMIT 25""")
def _(m):
    found = search.fts_search([QUERIES[8]], pool(m), postings(m))
    return search.search_sort(found, m.articles, "relevance", "on the").limit(25).select("id", F.round("rank", 6).alias("rank"))


@query("l5_search_sort_popularity", f"""
SELECT a.id, coalesce(n, 0) AS view_count FROM {ELIGIBLE} a LEFT JOIN (SELECT article_id, count(*) AS n FROM views GROUP BY 1) v ON v.article_id = a.id
WHERE contains(lower(title), 'en') OR contains(lower(excerpt), 'en') ORDER BY view_count DESC, scraped_at DESC, a.id DESC LIMIT 25""")
def _(m):
    found = search.phrase_search(eligible(m), "en").select("id")
    return search.search_sort(found, m.articles, "popularity", views=m.views).limit(25).select("id", "view_count")
