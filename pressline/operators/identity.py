"""Article identity and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressline.operators.graph import connected_components
from pressline.operators.ranking import gap_sessions

REPOST_WINDOW_SECONDS = 30 * 24 * 3600


def keeper_order() -> Column:
    """D3: full content, then most words, then earliest scrape, then lowest id."""
    return F.struct(
        (~F.col("has_full_content")).alias("a"), (-F.col("word_count")).alias("b"), F.col("scraped_at").alias("c"),
        F.col("id").alias("d"),
    )


def _losers(rows: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Rows that are not the keeper of their group, one aggregation and one join."""
    groups = rows.groupBy(*keys).agg(F.min(keeper_order()).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.filter("group_size > 1").select(*keys, F.col("_best.d").alias("keeper_id"), "group_size")
    condition = None
    for key in keys:
        match = F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
        condition = match if condition is None else condition & match
    joined = rows.alias("l").join(groups.alias("r"), condition).filter("l.id <> r.keeper_id")
    return joined.select(F.lit(rule).alias("rule"), F.col("l.id").alias("id"), "r.keeper_id", "r.group_size")


def pick_keeper(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D3: the article to keep of every group."""
    best = rows.groupBy(*keys).agg(F.min(keeper_order()).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    return best.select(*keys, F.col("_best.d").alias("keeper_id"), "group_size")


_NEEDED = ("id", "has_full_content", "word_count", "scraped_at")


def dup_groups(articles: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Duplicates by equal, non-empty keys; strings count as empty when ''."""
    rows = articles.select(*_NEEDED, *keys)
    text = [f.name for f in rows.schema if f.name in keys and f.dataType.simpleString() == "string"]
    for key in text:
        rows = rows.filter(F.coalesce(F.col(key), F.lit("")) != "")
    return _losers(rows, keys, rule)


def title_dups(articles: DataFrame) -> DataFrame:
    """Same headline and outlet, in runs whose neighbours lie at most 30 days apart."""
    rows = articles.filter(F.col("normalized_title_hash") != "").select(*_NEEDED, "normalized_title_hash", "source_id")
    runs = gap_sessions(rows, ["normalized_title_hash", "source_id"], "scraped_at", REPOST_WINDOW_SECONDS)
    return _losers(runs, ["normalized_title_hash", "source_id", "session_no"], "title")


def _key(*parts: str) -> Column:
    return F.concat_ws("\x1f", *[F.col(p).cast("string") for p in parts])


def dedupe_rules(articles: DataFrame) -> DataFrame:
    """All four rules: ``(rule, id, keeper_id, group_size)``, one row per rule and loser.

    Every article is expanded to its keys, so one aggregation and one join find the
    losers of all rules. Run it on a stored table with the identity columns; on computed
    ones the texts would be read for every use.
    """
    def rule(name, key, given):
        return F.when(F.coalesce(F.col(given), F.lit("")) != "", F.struct(F.lit(name).alias("rule"), key.alias("key")))

    keys = F.array_compact(
        F.array(
            rule("url", F.col("url"), "url"), rule("canonical_url", F.col("canonical_url"), "canonical_url"),
            rule("external_id", _key("external_id", "source_id"), "external_id"),
        )
    )
    direct = articles.select(*_NEEDED, F.explode(keys).alias("k")).select(*_NEEDED, "k.rule", "k.key")
    titled = articles.filter("normalized_title_hash <> ''").select(*_NEEDED, "normalized_title_hash", "source_id")
    runs = gap_sessions(titled, ["normalized_title_hash", "source_id"], "scraped_at", REPOST_WINDOW_SECONDS)
    by_title = runs.select(*_NEEDED, F.lit("title").alias("rule"), _key("normalized_title_hash", "source_id", "session_no").alias("key"))
    rows = direct.unionByName(by_title)
    groups = rows.groupBy("rule", "key").agg(F.min(keeper_order()).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    shared = groups.filter("group_size > 1").select("rule", "key", F.col("_best.d").alias("keeper_id"), "group_size")
    return rows.select("id", "rule", "key").join(shared, ["rule", "key"]).filter("id <> keeper_id").drop("key")


def dedupe_plan(articles: DataFrame, source_id: int | None = None, transitive: bool = False) -> DataFrame:
    """The ids to remove.

    As in the reference, the losers of the rules are united as they are, so a keeper of
    one rule may be a loser of another. With ``transitive`` the duplicate pairs of all
    rules are closed first, and each closed group keeps its best article.
    """
    rows = articles.filter(F.col("source_id") == source_id) if source_id is not None else articles
    found = dedupe_rules(rows)
    if not transitive:
        return found.select("id").distinct()
    labels = connected_components(found.select(F.col("id").alias("src"), F.col("keeper_id").alias("dst")))
    members = rows.select(*_NEEDED).join(labels, "id")
    return _losers(members, ["component"], "closed").select("id")


def dedupe_audit(articles: DataFrame) -> DataFrame:
    """D4 audit: groups and losers per rule."""
    found = dedupe_rules(articles)
    return found.groupBy("rule").agg(F.countDistinct("keeper_id").alias("n_groups"), F.count(F.lit(1)).alias("n_remove"))


def apply_dedupe(articles: DataFrame, plan: DataFrame) -> DataFrame:
    return articles.join(plan.select("id"), "id", "left_anti")


def _keyed() -> Column:
    """The lookup keys of an article, by priority; blank hashes are no key."""
    def key(priority, *parts):
        return F.struct(F.lit(priority).alias("priority"), F.concat_ws("\x1f", *[p.cast("string") for p in parts]).alias("key"))

    keys = F.array(
        key(1, F.col("external_id"), F.col("source_id")),
        key(2, F.col("canonical_url")),
        key(3, F.col("url")),
        F.when(F.col("content_hash") != "", key(4, F.col("content_hash"))),
        F.when(F.col("normalized_title_hash") != "", key(5, F.col("normalized_title_hash"), F.col("source_id"))),
    )
    return F.array_compact(keys)


_KEY_COLUMNS = ["id", "external_id", "source_id", "canonical_url", "url", "content_hash", "normalized_title_hash"]
_HEADLINE = 5  # the priority of the headline key


def lookup_keys(articles: DataFrame) -> DataFrame:
    """``(id, scraped_at, priority, key)``: the keys under which an article is found again."""
    keyed = articles.select(*_KEY_COLUMNS, "scraped_at").withColumn("k", F.explode(_keyed()))
    return keyed.select("id", "scraped_at", "k.priority", "k.key")


def _in_time(as_of: Column) -> Column:
    """Headlines only count for 30 days."""
    return (F.col("priority") != _HEADLINE) | (F.col("scraped_at") >= as_of - F.expr("INTERVAL 30 DAYS"))


def _newest() -> Column:
    return F.struct("scraped_at", (-F.col("id")).alias("i"))


def _first_hit(hits: DataFrame) -> DataFrame:
    first = F.min(F.struct("priority", "existing_id")).alias("m")
    return hits.groupBy("new_id").agg(first).select("new_id", "m.existing_id", "m.priority")


def match_existing(new: DataFrame, corpus: DataFrame, as_of: Column) -> DataFrame:
    """The stored article each new one duplicates, by the first key that hits.

    Keys in order: (external id, outlet), canonical URL, URL, body hash, and headline of
    the same outlet within 30 days. The newest scrape wins inside a key. Every article
    is expanded to its keys once, so one aggregation and one join serve all five rules.
    Returns ``(new_id, existing_id, priority)`` for the articles that matched.
    """
    known = lookup_keys(corpus).filter(_in_time(as_of)).groupBy("priority", "key").agg(F.max_by("id", _newest()).alias("existing_id"))
    wanted = new.select(*_KEY_COLUMNS).withColumn("k", F.explode(_keyed())).select(F.col("id").alias("new_id"), "k.priority", "k.key")
    return _first_hit(wanted.join(known, ["priority", "key"]))


def match_arriving(new_keys: DataFrame, known_keys: DataFrame, as_of: Column) -> DataFrame:
    """Like :func:`match_existing`, from lookup keys, and new articles also find earlier new ones.

    Within the new articles the order is that of their scrape times, then ids.
    """
    known = known_keys.filter(_in_time(as_of)).groupBy("priority", "key").agg(F.max(F.struct(F.struct("scraped_at", (-F.col("id")).alias("i")).alias("at"), "id")).alias("k"))
    before = Window.partitionBy("priority", "key").orderBy("scraped_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    entry = F.struct(F.struct("scraped_at", (-F.col("id")).alias("i")).alias("at"), "id")
    wanted = new_keys.withColumn("_e", F.max(F.when(_in_time(as_of), entry)).over(before))
    found = wanted.join(known, ["priority", "key"], "left").withColumn("_best", F.greatest("_e", "k"))
    return _first_hit(found.filter("_best IS NOT NULL").select(F.col("id").alias("new_id"), "priority", F.col("_best.id").alias("existing_id")))


def already_sent(pairs: DataFrame, history: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """The (user, article) pairs that were sent in the last ``days``."""
    recent = history.filter(F.col("sent_at") >= as_of - F.make_dt_interval(days=F.lit(days)))
    return pairs.join(recent.select("user_id", "article_id"), ["user_id", "article_id"], "left_semi")
