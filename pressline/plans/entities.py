"""Registered queries for entity names, mentions and canonical entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.functions import names as nm
from pressline.operators import entities
from pressline.plans.identity import WS, sql_strip
from pressline.plans.model import Model
from pressline.plans.registry import query


def sql_clean(name):
    return sql_strip(f"regexp_replace({name}, '{WS}+', ' ', 'g')")


def sql_normalize(name, kind):
    base = rf"trim(regexp_replace(regexp_replace(replace(replace(lower({sql_clean(name)}), 'ß', 'ss'), '&', ' and '), '[’'']', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    return f"""CASE {kind} WHEN 'person' THEN regexp_replace({base}, '{nm.LEADING_TITLES}', '')
      WHEN 'organization' THEN regexp_replace(regexp_replace({base}, '{nm.LEADING_ARTICLES}', ''), '{nm.TRAILING_FORMS}', '') ELSE {base} END"""


# Names with titles and company forms around the model's entities, one per mention.
DECORATED = """decorated AS (SELECT m.*, CASE entity_type
    WHEN 'person' THEN CASE id % 4 WHEN 0 THEN 'President  ' WHEN 1 THEN 'Hon. Dr. ' WHEN 2 THEN 'vice president Gen ' ELSE '' END || entity_name
    WHEN 'organization' THEN CASE id % 4 WHEN 0 THEN 'The ' || entity_name || ' Company Ltd' WHEN 1 THEN split_part(entity_name, ' ', 2) || ' of Entity'
      WHEN 2 THEN entity_name || ' & Sons' ELSE upper(entity_name) END
    ELSE entity_name || CASE id % 3 WHEN 0 THEN ' ' ELSE '''s' END END AS full_name FROM mentions m)"""


def decorated(m: Model):
    return m.mentions.selectExpr(
        "id", "article_id", "entity_type", "normalized_name",
        """CASE entity_type
    WHEN 'person' THEN concat(CASE id % 4 WHEN 0 THEN 'President  ' WHEN 1 THEN 'Hon. Dr. ' WHEN 2 THEN 'vice president Gen ' ELSE '' END, entity_name)
    WHEN 'organization' THEN CASE id % 4 WHEN 0 THEN concat('The ', entity_name, ' Company Ltd') WHEN 1 THEN concat(split_part(entity_name, ' ', 2), ' of Entity')
      WHEN 2 THEN concat(entity_name, ' & Sons') ELSE upper(entity_name) END
    ELSE concat(entity_name, CASE id % 3 WHEN 0 THEN ' ' ELSE "'s" END) END AS entity_name""",
    )


def stored(m: Model):
    """Known entities: every second name per type, with one alias each."""
    kinds = m.mentions.select("entity_type", "normalized_name").distinct()
    number = F.split_part("normalized_name", F.lit(" "), F.lit(2)).cast("bigint")
    return (
        kinds.withColumn("n", number).filter("n % 2 = 0")
        .selectExpr(
            "n * 10 + CASE entity_type WHEN 'person' THEN 1 WHEN 'organization' THEN 2 ELSE 3 END AS id",
            "concat('Entity ', n) AS name", "normalized_name", "entity_type", "array(concat('entity ', n + 1), concat('alias ', n)) AS aliases",
        )
    )


STORED = """stored AS (SELECT n * 10 + CASE entity_type WHEN 'person' THEN 1 WHEN 'organization' THEN 2 ELSE 3 END AS id, 'Entity ' || n AS name, normalized_name, entity_type,
  ['entity ' || (n + 1), 'alias ' || n] AS aliases FROM (SELECT DISTINCT entity_type, normalized_name, CAST(split_part(normalized_name, ' ', 2) AS BIGINT) AS n FROM mentions) WHERE n % 2 = 0)"""
KEYED = f"""keyed AS (SELECT *, {sql_clean('full_name')} AS clean, {sql_normalize('full_name', 'entity_type')} AS base FROM decorated),
aliased AS (SELECT *, CASE WHEN entity_type = 'organization' AND len(string_split(base, ' ')) = 3 AND split_part(base, ' ', 2) = 'of'
    THEN [base, split_part(base, ' ', 3) || ' ' || split_part(base, ' ', 1)]
  WHEN entity_type = 'organization' AND len(string_split(base, ' ')) = 2 THEN [base, split_part(base, ' ', 2) || ' of ' || split_part(base, ' ', 1)] ELSE [base] END AS keys FROM keyed),
spelled AS (SELECT DISTINCT entity_type, clean, keys FROM aliased),
resolved AS (SELECT p.entity_type, p.clean, min(s.id) AS entity_id FROM spelled p LEFT JOIN stored s ON s.entity_type = p.entity_type
  AND (list_contains(p.keys, s.normalized_name) OR list_has_any(p.keys, s.aliases) OR lower(s.name) = lower(p.clean)) GROUP BY ALL)"""


@query("t10_normalize_entity_name", f"""
WITH {DECORATED} SELECT id, {sql_clean('full_name')} AS display, {sql_normalize('full_name', 'entity_type')} AS normalized FROM decorated""")
def _(m):
    name, kind = F.col("entity_name"), F.col("entity_type")
    return decorated(m).select("id", nm.clean_entity_name(name).alias("display"), nm.normalize_entity_name(name, kind).alias("normalized"))


@query("t11_entity_alias_keys", f"WITH {DECORATED}, {STORED}, {KEYED} SELECT id, array_to_string(keys, '|') AS keys FROM aliased")
def _(m):
    keys = nm.entity_alias_keys(F.col("entity_name"), F.col("entity_type"))
    return decorated(m).select("id", F.array_join(keys, "|").alias("keys"))


@query("t16_title_case", """
SELECT DISTINCT normalized_name, 'Entity ' || split_part(normalized_name, ' ', 2) AS label FROM mentions""")
def _(m):
    from pressline.functions.text import title_case

    return m.mentions.select("normalized_name", title_case(F.col("normalized_name")).alias("label")).distinct()


@query("e1_explode_mentions", """
SELECT article_id, kind AS entity_type, name AS entity_name, CAST(CAST(published_at AS DATE) AS VARCHAR) AS mention_date, sentiment_score FROM (
  SELECT article_id, 'person' AS kind, unnest(entities_people) AS name, sentiment_score, status FROM enrichments
  UNION ALL SELECT article_id, 'organization', unnest(entities_organizations), sentiment_score, status FROM enrichments
  UNION ALL SELECT article_id, 'location', unnest(entities_locations), sentiment_score, status FROM enrichments) JOIN articles ON articles.id = article_id
WHERE status = 'completed'""")
def _(m):
    rows = entities.explode_mentions(m.enrichments, m.articles, m.as_of)
    return rows.withColumn("mention_date", F.col("mention_date").cast("string"))


@query("e2_resolve_canonical", f"""
WITH {DECORATED}, {STORED}, {KEYED} SELECT entity_type, clean AS entity_name, coalesce(entity_id, -1) AS entity_id FROM resolved""")
def _(m):
    found = entities.resolve_canonical(decorated(m), stored(m))
    return found.select("entity_type", "entity_name", F.coalesce("entity_id", F.lit(-1)).alias("entity_id"))


@query("e3_create_entities", f"""
WITH {DECORATED}, {STORED}, {KEYED},
unknown AS (SELECT p.*, list_sort(list_transform(p.keys, lambda k: struct_pack(n := -length(k), a := k)))[1].a AS canon FROM spelled p
  JOIN resolved r ON r.entity_type = p.entity_type AND r.clean = p.clean WHERE entity_id IS NULL),
parts AS (SELECT entity_type, canon, clean AS alias FROM unknown UNION SELECT entity_type, canon, unnest(keys) FROM unknown)
SELECT u.entity_type, u.canon AS normalized_name, min(u.clean) AS name,
  (SELECT string_agg(alias, '|' ORDER BY alias) FROM parts p WHERE p.entity_type = u.entity_type AND p.canon = u.canon) AS aliases FROM unknown u GROUP BY 1, 2""")
def _(m):
    made = entities.create_entities(decorated(m), stored(m))
    return made.select("entity_type", "normalized_name", "name", F.array_join("aliases", "|").alias("aliases"))


@query("e4_extend_aliases", f"""
WITH {DECORATED}, {STORED}, {KEYED},
added AS (SELECT entity_id, r.clean AS alias FROM resolved r WHERE entity_id IS NOT NULL UNION SELECT entity_id, unnest(keys) FROM resolved r
  JOIN spelled p ON p.entity_type = r.entity_type AND p.clean = r.clean WHERE entity_id IS NOT NULL),
every AS (SELECT id, unnest(aliases) AS alias FROM stored UNION SELECT entity_id, alias FROM added)
SELECT e.id, string_agg(alias, '|' ORDER BY alias) AS aliases FROM every e JOIN stored s ON s.id = e.id GROUP BY e.id, s.aliases HAVING count(*) > len(s.aliases)""")
def _(m):
    grown = entities.extend_aliases(decorated(m), stored(m))
    return grown.select("id", F.array_join("aliases", "|").alias("aliases"))


@query("e5_canonicalize_mentions", f"""
WITH {DECORATED}, {STORED}, {KEYED} SELECT k.id, k.normalized_name, s.normalized_name AS canonical_name FROM keyed k
JOIN resolved r ON r.entity_type = k.entity_type AND r.clean = k.clean JOIN stored s ON s.id = r.entity_id WHERE k.normalized_name <> s.normalized_name""")
def _(m):
    return entities.canonicalize_mentions(decorated(m), stored(m)).select("id", "normalized_name", "canonical_name")


@query("e5_canonicalization_report", f"""
WITH {DECORATED}, {STORED}, {KEYED} SELECT k.normalized_name, s.normalized_name AS canonical_name, count(*) AS n FROM keyed k
JOIN resolved r ON r.entity_type = k.entity_type AND r.clean = k.clean JOIN stored s ON s.id = r.entity_id WHERE k.normalized_name <> s.normalized_name
GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 25""")
def _(m):
    return entities.canonicalization_report(decorated(m), stored(m))


@query("e6_merge_aliases", """
SELECT id, 'entity 4' AS normalized_name FROM mentions WHERE entity_type = 'organization' AND (normalized_name IN ('entity 4', 'entity 6', 'entity 8')
  OR entity_name IN ('Entity 4', 'The Entity 6 Ltd', 'Entity 8'))""")
def _(m):
    merged = entities.merge_aliases(m.mentions, "Entity 4", ["The Entity 6 Ltd", "Entity  8"], "organization")
    return merged.select("id", "normalized_name")


@query("e6_merged_alias_list", f"""
WITH {STORED} SELECT entity_type, normalized_name, 'Entity 4' AS name, (SELECT string_agg(DISTINCT a, '|' ORDER BY a) FROM (SELECT unnest(list_concat(aliases,
  ['Entity 4', 'Entity 8', 'The Entity 6 Ltd', 'entity 4', '4 of entity', 'entity 6', '6 of entity', 'entity 8', '8 of entity'])) AS a)) AS aliases
FROM stored WHERE entity_type = 'organization' AND normalized_name = 'entity 4'""")
def _(m):
    merged = entities.merged_alias_list("Entity 4", ["The Entity 6 Ltd", "Entity  8"], "organization", stored(m))
    return merged.withColumn("aliases", F.array_join("aliases", "|"))


@query("e7_entity_name_variants", f"""
WITH {STORED}, asked AS (SELECT DISTINCT entity_name AS entity, entity_type FROM mentions),
matched AS (SELECT a.entity, a.entity_type, s.normalized_name, s.aliases, row_number() OVER (PARTITION BY a.entity, a.entity_type ORDER BY s.id) AS r
  FROM asked a JOIN stored s ON s.entity_type = a.entity_type AND (s.normalized_name = lower(a.entity) OR lower(s.name) = lower(a.entity)))
SELECT entity, entity_type, lower(entity) AS variant FROM asked UNION SELECT entity, entity_type, normalized_name FROM matched WHERE r <= 5
UNION SELECT entity, entity_type, lower(unnest(aliases)) FROM matched WHERE r <= 5""")
def _(m):
    asked = m.mentions.select(F.col("entity_name").alias("entity"), "entity_type")
    return entities.entity_name_variants(asked, stored(m))


@query("e8_verbatim_entities", """
WITH cards AS (SELECT article_id, entities_people AS p, entities_organizations AS o, entities_locations AS l, 'Talks at Entity ' || (article_id % 60) || ' today' AS card FROM enrichments),
every AS (SELECT article_id, 1 AS k, 'person' AS kind, unnest(p) AS name, card FROM cards UNION ALL SELECT article_id, 2, 'organization', unnest(o), card FROM cards
  UNION ALL SELECT article_id, 3, 'location', unnest(l), card FROM cards),
firsts AS (SELECT article_id, name, arg_min(kind, k) AS kind, min(k) AS k FROM every WHERE contains(card, name) GROUP BY 1, 2)
SELECT c.article_id, coalesce(string_agg(name || '/' || kind, '|' ORDER BY f.k), '') AS found FROM cards c LEFT JOIN firsts f ON f.article_id = c.article_id GROUP BY 1""")
def _(m):
    card = F.concat(F.lit("Talks at Entity "), F.col("article_id") % 60, F.lit(" today"))
    found = entities.verbatim_entities(F.col("entities_people"), F.col("entities_organizations"), F.col("entities_locations"), card)
    joined = F.array_join(F.transform(found, lambda e: F.concat(e["name"], F.lit("/"), e["type"])), "|")
    return m.enrichments.select("article_id", joined.alias("found"))
