"""Queries that apply each operator with production settings to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressline.llm import (
    boosted_trees, cross_polytope, fertility, hard_negatives, hilbert_packing, license_scan, middle_filling, order_minhash, poisson_mixing, sharding, suffixes, token_counts, url_reputation,
)
from pressline.llm.registry import QUERIES, SQL, query, table  # noqa: F401

RULES = [
    url_reputation.Rule("block", "com/en/"), url_reputation.Rule("allow", "example.com/en/7"), url_reputation.Rule("allow", "net/de/"),
    url_reputation.Rule("block", "example.net/de/8"), url_reputation.Rule("block", "org/es/"),
]

OP1_SQL = r"""
WITH split AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), known AS (
  SELECT doc_id, max(CAST(quality = 1 AND toxic = 0 AS INT)) AS good FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id
), outcomes AS (
  SELECT host, good FROM split JOIN known ON try_cast(regexp_extract(path, '/([0-9]{1,18})(\.html)?/?$', 1) AS BIGINT) = doc_id
), judged AS (SELECT host, count(*) AS n, sum(good) AS good FROM outcomes GROUP BY host),
named AS (
  SELECT h.host, coalesce(n, 0) AS n, coalesce(good, 0) AS good,
    regexp_replace(regexp_replace(regexp_replace(h.host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS name
  FROM (SELECT DISTINCT host FROM split) h LEFT JOIN judged USING (host)
), every AS (
  SELECT host, n, good,
    CASE WHEN regexp_matches(name, '^([0-9.]+|\[.*\])$') THEN name ELSE list_last(string_split(name, '.')) END AS suffix,
    CASE WHEN regexp_matches(name, '^([0-9.]+|\[.*\])$') THEN name ELSE array_to_string(string_split(name, '.')[-2:], '.') END AS domain
  FROM named
), web AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS p FROM every),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT p FROM web) AS p FROM every GROUP BY suffix),
s1 AS (SELECT least(10000.0, greatest(1.0, 1 / greatest(CASE WHEN sum(n * (n - 1)) > 0 THEN (sum((good - n * p) ^ 2 / (p * (1 - p))) - sum(n)) / sum(n * (n - 1)) ELSE 0 END, 1e-9) - 1)) AS s FROM s0),
s2 AS (SELECT suffix, (good + s * p) / (n + s) AS p FROM s0, s1),
d0 AS (SELECT e.domain, sum(e.n) AS n, sum(e.good) AS good, any_value(s2.p) AS p FROM every e JOIN s2 USING (suffix) GROUP BY e.domain),
d1 AS (SELECT least(10000.0, greatest(1.0, 1 / greatest(CASE WHEN sum(n * (n - 1)) > 0 THEN (sum((good - n * p) ^ 2 / (p * (1 - p))) - sum(n)) / sum(n * (n - 1)) ELSE 0 END, 1e-9) - 1)) AS s FROM d0),
d2 AS (SELECT domain, (good + s * p) / (n + s) AS p FROM d0, d1),
h0 AS (SELECT host, n, good, p FROM every JOIN d2 USING (domain)),
h1 AS (SELECT least(10000.0, greatest(1.0, 1 / greatest(CASE WHEN sum(n * (n - 1)) > 0 THEN (sum((good - n * p) ^ 2 / (p * (1 - p))) - sum(n)) / sum(n * (n - 1)) ELSE 0 END, 1e-9) - 1)) AS s FROM h0),
h2 AS (SELECT host, n, (good + s * p) / (n + s) AS m, n + s AS w FROM h0, h1),
h3 AS (SELECT host, n, least(1.0, m + 1.645 * sqrt(m * (1 - m) / (w + 1))) AS upper FROM h2),
ruled AS (
  SELECT page_id, host, path, CAST(n AS BIGINT) AS n_labelled, upper, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/' END AS rule
  FROM split JOIN h3 USING (host)
)
SELECT page_id, host, path, rule, n_labelled,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN upper < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), g AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS s, b.vec_id AS d FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95
), reached(s, d) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.s, l.d FROM reached r JOIN links l ON r.d = l.s
)
SELECT v.vec_id, coalesce(any_value(n), 0) AS n_links, min(r.d) AS component_id, min(r.d) = v.vec_id AS kept
FROM v JOIN reached r ON r.s = v.vec_id LEFT JOIN (SELECT s, count(*) AS n FROM links GROUP BY s) c ON c.s = v.vec_id GROUP BY v.vec_id
"""

OP3_SQL = """
WITH sizes AS (SELECT source, sum(coalesce(strlen(text), 0)) AS size FROM documents GROUP BY source),
weights AS (SELECT source, size, CAST(size AS DOUBLE) ^ 0.5 / (SELECT sum(CAST(size AS DOUBLE) ^ 0.5) FROM sizes) AS weight FROM sizes),
rates AS (SELECT source, (SELECT sum(size) FROM sizes) * (weight / (SELECT sum(weight) FROM weights)) / size AS rate FROM weights WHERE size > 0),
masses AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM rates, range(0, 200) t(k)),
draws AS (
  SELECT doc_id, source, CAST('0x' || substr(md5('mix-1/' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents
), counts AS (
  SELECT doc_id, d.source, count(*) FILTER (c <= u) AS n FROM draws d JOIN masses m ON d.source IS NOT DISTINCT FROM m.source GROUP BY doc_id, d.source
), copies AS (
  SELECT doc_id, source, CAST(k AS INT) AS copy, CAST('0x' || substr(md5('mix-1/order/' || doc_id || '/' || k), 1, 13) AS BIGINT) AS key
  FROM counts, range(0, 200) t(k) WHERE k < n
)
SELECT doc_id, source, copy, row_number() OVER (ORDER BY key, doc_id, copy) - 1 AS position FROM copies
"""

OP11_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || doc_id) AS h
  FROM documents
), numbers AS (
  SELECT doc_id, text, u, len(u) AS n, [CAST('0x' || substr(h, k, 8) AS BIGINT) FOR k IN [1, 9, 17, 25]] AS h FROM units
), forms AS (
  SELECT doc_id, text, u, CAST(n AS BIGINT) AS n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM forms
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5
"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


def license_sql() -> str:
    """The license scan on DuckDB, with the library's templates and phrases as values."""
    words, phrases, notices = [], [], []
    for number, template in enumerate(license_scan.TEMPLATES):
        own = license_scan.template_words(template.text)
        words += [(number, place, word) for place, word in enumerate(own)]
        phrases += [(number, phrase) for phrase in template.phrases]
        notices.append((number, template.label))
    base = list(license_scan.BASE_PHRASES.items())
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), flat AS (SELECT r, unnest(w) AS word, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS pos FROM d),
t(t, place, word) AS (VALUES {_values(words)}), n(t, label) AS (VALUES {_values(notices)}),
p(t, phrase) AS (VALUES {_values(phrases)}), b(phrase, label) AS (VALUES {_values(base)}),
df AS (
  SELECT v.word, count(DISTINCT flat.r) AS df, greatest(1, CAST(floor(1000 * ln(((SELECT count(*) FROM d) + 1) / (count(DISTINCT flat.r) + 1)) + 0.5) AS BIGINT)) AS weight
  FROM (SELECT DISTINCT word FROM t) v LEFT JOIN flat USING (word) GROUP BY v.word
), ranked AS (
  SELECT t, word, weight, row_number() OVER (PARTITION BY t ORDER BY df, word) AS rk, count(*) OVER (PARTITION BY t) AS many
  FROM (SELECT DISTINCT t, word FROM t) JOIN df USING (word)
), indexed AS (SELECT t, word, weight FROM ranked WHERE rk <= least({license_scan.INDEXED}, (many + 1) // 2)),
total AS (SELECT t, sum(weight) AS total FROM indexed GROUP BY t),
needles AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS parts FROM (SELECT phrase FROM p UNION ALL SELECT phrase FROM b)),
standing AS (
  SELECT r, phrase, pos FROM needles JOIN flat ON flat.word = parts[1] JOIN d USING (r) WHERE w[pos + 1:pos + len(parts)] = parts
), own AS (SELECT t, list(word ORDER BY place) AS words FROM t GROUP BY t),
placed AS (
  SELECT t, phrase, (SELECT min(i) FROM range(0, len(words)) g(i) WHERE words[i + 1:i + len(string_split(phrase, ' '))] = string_split(phrase, ' ')) AS place
  FROM p JOIN own USING (t)
), votes AS (
  SELECT flat.r, i.t, flat.word AS item, i.weight, 0 AS phrase, pos - place AS off FROM flat JOIN indexed i USING (word) JOIN t ON t.t = i.t AND t.word = i.word
  UNION ALL SELECT s.r, placed.t, s.phrase, 0, 1, s.pos - placed.place FROM standing s JOIN placed USING (phrase)
), binned AS (
  SELECT DISTINCT r, t, item, weight, phrase, CAST(floor(off / {license_scan.BAND}) AS BIGINT) - k AS bin FROM votes, (VALUES (0), (1)) x(k)
), judged AS (
  SELECT r, t, sum(weight) / any_value(total) AS share, sum(phrase) AS have FROM binned JOIN total USING (t) GROUP BY r, t, bin
), found AS (
  SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM judged JOIN n USING (t)
  WHERE share >= {license_scan.LEAST_SHARE} AND have = (SELECT count(*) FROM p WHERE p.t = judged.t) GROUP BY r
), based AS (
  SELECT r, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM standing JOIN b USING (phrase) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(based.n, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(based.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(based.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CASE WHEN based.n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM d LEFT JOIN based USING (r) LEFT JOIN found USING (r)
"""


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``host, good`` of pages whose path ends in the number of a labelled document.

    A page is good when its document is of quality 1 and not toxic.
    """
    path = url_reputation.path_of(F.col("url"))
    number = F.regexp_extract(path, r"/([0-9]{1,18})(\.html)?/?$", 1)
    numbered = pages.select(url_reputation.host_of(F.col("url")).alias("host"), F.when(number != "", number.cast("long")).alias("doc_id"))
    known = labels.filter("quality is not null and toxic is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")
    )
    return numbered.join(known, "doc_id").select("host", "good")


@query("op1_url_reputation", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Rules and host reputation for every page."""
    pages = table(spark, folder, "pages")
    return url_reputation.judge_urls(pages, page_outcomes(pages, table(spark, folder, "labels")), RULES)


@query("op2_near_vectors", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95."""
    return cross_polytope.near_vectors(table(spark, folder, "embeddings"))


@query("op3_poisson_mix", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """The copies of all documents in a mix with tempered source weights, with their place in the shuffle."""
    docs = table(spark, folder, "documents")
    rates = poisson_mixing.repetition_rates(poisson_mixing.tempered_weights(docs))
    placed = poisson_mixing.positions(poisson_mixing.replicate(docs.select("doc_id", "source"), rates))
    return placed.select("doc_id", "source", F.col("_copy").alias("copy"), F.col("position"))


@query("op4_suffix_duplicates")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Word ranges of all documents that repeat a passage of fifty words."""
    return suffixes.suffix_duplicates(table(spark, folder, "documents"))


@query("op5_minimax_shards")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    return sharding.shard_documents(table(spark, folder, "documents"))


@query("op6_quality_trees")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of all documents."""
    return boosted_trees.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_token_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-level BPE token counts of all documents."""
    return token_counts.token_counts(table(spark, folder, "documents"))


@query("op8_quality_rules")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Quality rules with fertility bands over all documents."""
    return fertility.quality_rules(table(spark, folder, "documents")).drop("lang")


@query("op9_order_minhash")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of near copies among all documents."""
    return order_minhash.near_duplicates(table(spark, folder, "documents"))


@query("op10_curve_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed along the curve; ids as checksums."""
    packed = hilbert_packing.pack_along_curve(table(spark, folder, "documents"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op11_fill_in_middle", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """All documents cut for filling in the middle; texts as checksums."""
    made = middle_filling.fill_in_middle(table(spark, folder, "documents"))
    back = middle_filling.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth embedding."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").withColumn("label", moved)
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


@query("op13_license_scan", license_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and notices in all documents."""
    return license_scan.scan_licenses(table(spark, folder, "documents"))
