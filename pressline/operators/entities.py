"""Entity mentions and canonical entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pressline.functions import names as nm
from pressline.functions.binding import let
from pressline.operators.trends import change_pair_counts

_NO_TEXT = "array<string>"


def explode_mentions(enrichments: DataFrame, articles: DataFrame, as_of: Column) -> DataFrame:
    """One row per named entity of every completed annotation, dated by publication."""
    def typed(column, kind):
        listed = F.coalesce(F.col(column), F.array().cast(_NO_TEXT))
        return F.transform(listed, lambda n: F.struct(F.lit(kind).alias("entity_type"), nm.clean_entity_name(n).alias("entity_name")))

    entries = F.concat(
        typed("entities_people", "person"), typed("entities_organizations", "organization"), typed("entities_locations", "location")
    )
    dates = articles.select(F.col("id").alias("article_id"), "published_at")
    rows = enrichments.filter("status = 'completed'").join(dates, "article_id")
    return (
        rows.select("article_id", "sentiment_score", F.to_date(F.coalesce("published_at", as_of)).alias("mention_date"),
                    F.explode(entries).alias("e"))
        .select("article_id", "e.entity_type", "e.entity_name", "mention_date", "sentiment_score")
        .filter("entity_name <> ''")
    )


def _distinct_names(mentions: DataFrame) -> DataFrame:
    """Every distinct spelling once, with its lookup keys."""
    name = nm.clean_entity_name(F.col("entity_name"))
    names = mentions.select("entity_type", name.alias("entity_name")).distinct().filter("entity_name <> ''")
    return names.withColumn("alias_keys", nm.entity_alias_keys(F.col("entity_name"), F.col("entity_type"))).filter(F.size("alias_keys") > 0)


def _lookup_keys(aliases: Column, display: Column) -> Column:
    """Alias keys and the display name as two kinds of lookup keys."""
    by_alias = F.transform(aliases, lambda a: F.struct(F.lit("alias").alias("kind"), a.alias("key")))
    by_name = F.array(F.struct(F.lit("name").alias("kind"), F.lower(display).alias("key")))
    return F.array_distinct(F.concat(by_alias, by_name))


def resolve_canonical(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """``(entity_type, entity_name) -> entity_id``; the lowest id wins, null when unknown.

    Names are made distinct first, so a name that fills a third of the mentions is
    looked up once.
    """
    names = _distinct_names(mentions)
    known = F.array_distinct(F.concat(F.array("normalized_name"), F.coalesce("aliases", F.array().cast(_NO_TEXT))))
    stored = entities.select(
        "entity_type", F.col("id").alias("entity_id"), F.explode(_lookup_keys(known, F.col("name"))).alias("k")
    ).select("entity_type", "entity_id", "k.kind", "k.key")
    lowest = stored.groupBy("entity_type", "kind", "key").agg(F.min("entity_id").alias("entity_id"))
    wanted = names.select(
        "entity_type", "entity_name", F.explode(_lookup_keys(F.col("alias_keys"), F.col("entity_name"))).alias("k")
    ).select("entity_type", "entity_name", "k.kind", "k.key")
    found = (
        wanted.join(lowest, ["entity_type", "kind", "key"], "left")
        .groupBy("entity_type", "entity_name").agg(F.min("entity_id").alias("entity_id"))
    )
    return found.join(
        entities.select(F.col("id").alias("entity_id"), F.col("normalized_name").alias("canonical_name")), "entity_id", "left"
    )


def canonical_key(aliases: Column) -> Column:
    """The longest lookup key (first in the alphabet on a tie); equal for all alias spellings."""
    ranked = F.transform(aliases, lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a")))
    return F.array_min(ranked)["a"]


def create_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """One new entity per group of unknown names that share lookup keys.

    The alias rule swaps 'X of Y' and 'Y X' both ways, so names that share any key share
    all keys; grouping by the longest key therefore equals closing over shared keys.
    """
    unknown = resolve_canonical(mentions, entities).filter("entity_id IS NULL").select("entity_type", "entity_name")
    keyed = unknown.withColumn("alias_keys", nm.entity_alias_keys(F.col("entity_name"), F.col("entity_type")))
    grouped = keyed.groupBy("entity_type", canonical_key(F.col("alias_keys")).alias("normalized_name")).agg(
        F.min("entity_name").alias("name"),
        F.array_sort(F.array_union(F.flatten(F.collect_set("alias_keys")), F.collect_set("entity_name"))).alias("aliases"),
    )
    return grouped.withColumn("aliases", F.array_distinct("aliases")).withColumn(
        "id", F.xxhash64("entity_type", "normalized_name")
    )


def extend_aliases(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities with the spellings and keys of their mentions added; changed rows only."""
    resolved = resolve_canonical(mentions, entities).filter("entity_id IS NOT NULL")
    added = (
        resolved.withColumn("alias_keys", nm.entity_alias_keys(F.col("entity_name"), F.col("entity_type")))
        .select(F.col("entity_id").alias("id"), F.explode(F.concat("alias_keys", F.array("entity_name"))).alias("alias"))
        .groupBy("id").agg(F.collect_set("alias").alias("_added"))
    )
    clean = F.filter(
        F.transform(F.coalesce("aliases", F.array().cast(_NO_TEXT)), nm.clean_entity_name), lambda a: a != ""
    )
    grown = F.array_sort(F.array_union(clean, F.col("_added")))
    joined = entities.join(added, "id").withColumn("_new", grown)
    changed = joined.filter(F.size("_new") > F.size(F.array_distinct(clean)))
    return changed.withColumn("aliases", F.col("_new")).drop("_new", "_added")


def canonicalize_mentions(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """E5: mentions whose normalized name changes, with old and new name."""
    lookup = resolve_canonical(mentions, entities).filter("canonical_name IS NOT NULL").select(
        "entity_type", F.col("entity_name").alias("_clean"), "canonical_name"
    )
    joined = mentions.withColumn("_clean", nm.clean_entity_name(F.col("entity_name"))).join(lookup, ["entity_type", "_clean"])
    return joined.filter(~F.col("normalized_name").eqNullSafe(F.col("canonical_name"))).drop("_clean")


def canonicalization_report(mentions: DataFrame, entities: DataFrame, limit: int = 25) -> DataFrame:
    """E5 with A18: the most frequent renames."""
    changed = canonicalize_mentions(mentions, entities)
    return change_pair_counts(changed, "normalized_name", "canonical_name", limit)


def merge_aliases(mentions: DataFrame, canonical: str, aliases: Sequence[str], entity_type: str) -> DataFrame:
    """Mentions of any listed spelling, renamed to the canonical key.

    The curated list is a short literal, so the match is a filter on the scan.
    """
    spellings = [canonical, *aliases]
    kind = F.lit(entity_type)
    keys = F.array(*[nm.normalize_entity_name(F.lit(s), kind) for s in spellings])
    displays = F.array(*[nm.clean_entity_name(F.lit(s)) for s in spellings])
    by_key = F.array_contains(F.filter(keys, lambda k: k != ""), F.col("normalized_name"))
    by_name = F.array_contains(displays, F.col("entity_name"))
    merged = mentions.filter((F.col("entity_type") == entity_type) & (by_key | by_name))
    return merged.withColumn("normalized_name", nm.normalize_entity_name(F.lit(canonical), kind))


def merged_alias_list(canonical: str, aliases: Sequence[str], entity_type: str, entities: DataFrame) -> DataFrame:
    """The canonical entity with its alias list after the merge."""
    spellings = [canonical, *aliases]
    kind = F.lit(entity_type)
    keys = F.flatten(F.array(*[F.concat(nm.entity_alias_keys(F.lit(s), kind), F.array(nm.clean_entity_name(F.lit(s)))) for s in spellings]))
    own_key = nm.normalize_entity_name(F.lit(canonical), kind)
    stored = entities.filter((F.col("entity_type") == entity_type) & (F.col("normalized_name") == own_key))
    # The key is unique per type, so at most one row is on record.
    known = F.coalesce(F.flatten(F.collect_list("aliases")), F.array().cast(_NO_TEXT))
    return stored.agg(known.alias("_known")).select(
        kind.alias("entity_type"), own_key.alias("normalized_name"), nm.clean_entity_name(F.lit(canonical)).alias("name"),
        F.array_sort(F.array_union("_known", keys)).alias("aliases"),
    )


def entity_name_variants(requests: DataFrame, entities: DataFrame, limit: int = 5) -> DataFrame:
    """The lower-case names to look for, per requested ``(entity, entity_type)``.

    Aliases of at most ``limit`` matching entities (lowest ids) are added.
    """
    from pressline.operators.ranking import top_n

    asked = requests.select("entity", "entity_type").distinct().withColumn("_key", F.trim(F.lower("entity")))
    keys = F.array_distinct(F.array(F.col("normalized_name"), F.lower("name")))
    stored = entities.select("id", "entity_type", F.col("normalized_name").alias("_canonical"), "aliases", F.explode(keys).alias("_key"))
    matched = asked.join(stored, ["entity_type", "_key"])
    few = top_n(matched, ["entity", "entity_type"], [F.asc("id")], limit)
    names = F.concat(F.array("_canonical"), F.coalesce("aliases", F.array().cast(_NO_TEXT)))
    extra = few.select("entity", "entity_type", F.explode(names).alias("n")).select("entity", "entity_type", F.trim(F.lower("n")).alias("variant"))
    own = asked.select("entity", "entity_type", F.col("_key").alias("variant"))
    return own.unionByName(extra).filter("variant <> ''").distinct()


def verbatim_entities(people: Column, organizations: Column, locations: Column, text: Column) -> Column:
    """``array<struct<name, type>>`` of the names that appear in the text, first type wins."""
    def typed(column, kind):
        bare = F.transform(F.coalesce(column, F.array().cast(_NO_TEXT)), lambda n: F.trim(n))
        present = F.filter(bare, lambda n: (n != "") & text.contains(n))
        return F.transform(present, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type")))

    found = F.concat(typed(people, "person"), typed(organizations, "organization"), typed(locations, "location"))
    return let(
        found,
        lambda v: let(F.transform(v, lambda e: e["name"]), lambda n: F.filter(v, lambda e, i: F.array_position(n, e["name"]) == i + 1)),
    )
