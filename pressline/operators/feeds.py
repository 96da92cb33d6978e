"""Eligibility filters and scored feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressline.functions import text as tx
from pressline.operators.ranking import freshness_order, intelligence_order, list_depths, pick_places, ranked_places, top_n
from pressline.operators.trends import recent_and_total_views


def hours_before(as_of: Column, hours: int) -> Column:
    return as_of - F.make_dt_interval(hours=F.lit(hours))


# --- filters -------------------------------------------------------------------------


def eligible_articles(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """F1 for anonymous readers: full articles of active outlets."""
    active = sources.filter("is_active").select(F.col("id").alias("source_id"))
    # Outlets are few and each has many articles: a shuffle by outlet would pile up texts in few tasks.
    return articles.filter("has_full_content").join(F.broadcast(active), "source_id", "left_semi")


def ranked_lists(rows: DataFrame, key: str, entry: Column, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` entries of every key as one array: ``(key, list)`` with at most n entries."""
    kept = top_n(rows, [key], order, n, rank="_pos")
    return kept.groupBy(F.col(key).alias("key")).agg(F.collect_list(entry).alias("list"))


def best_of_lists(keys: DataFrame, lists: DataFrame, owner: str, limit: int, skip_owner: bool = True) -> DataFrame:
    """Merge the ranked lists of all keys of an owner and keep its best ``limit`` entries.

    ``keys`` is ``(owner, key)``; entries are structs that sort best-last and end in
    ``id``. One owner has few keys and every list is short, so the merge is an array
    operation; a hot key only means that one short list is read often.
    """
    joined = keys.alias("s").join(lists.alias("r"), F.col("s.key").eqNullSafe(F.col("r.key")))
    merged = joined.groupBy(owner).agg(F.array_distinct(F.flatten(F.collect_list("list"))).alias("_all"))
    pool = F.filter("_all", lambda x: x["id"] != F.col(owner)) if skip_owner else F.col("_all")
    best = F.slice(F.sort_array(pool, asc=False), 1, limit)
    placed = merged.select(owner, F.posexplode(best).alias("_at", "x"))
    return placed.select(owner, "x.*", (F.col("_at") + 1).alias("rank"))


def latest_for_users(articles: DataFrame, sources: DataFrame, profiles: DataFrame, limit: int = 20) -> DataFrame:
    """F1 and L1 for every user: newest full articles of the followed outlets.

    Followed outlets count even when inactive; users who follow none get the active ones.
    """
    full = articles.filter("has_full_content").select("id", "source_id", "scraped_at")
    entry = F.struct("scraped_at", "id")
    by_source = ranked_lists(full, "source_id", entry, freshness_order(), limit)
    newest = eligible_articles(articles, sources).select("id", "scraped_at").orderBy(*freshness_order()).limit(limit)
    everywhere = newest.groupBy().agg(F.collect_list(entry).alias("list")).withColumn("key", F.lit(-1))
    follows = F.size("followed_sources") > 0
    wanted = F.when(follows, F.array_distinct("followed_sources")).otherwise(F.array(F.lit(-1)))
    keys = profiles.select("user_id", F.explode(wanted).alias("key"))
    return best_of_lists(keys, by_source.unionByName(everywhere), "user_id", limit, skip_owner=False)


def intelligence_articles(articles: DataFrame, enrichments: DataFrame) -> DataFrame:
    """articles with a completed annotation that has an importance."""
    done = enrichments.filter("status = 'completed' AND importance_score IS NOT NULL")
    return articles.filter("has_full_content").join(done.withColumnRenamed("article_id", "id"), "id")


def search_filters(
    articles: DataFrame, category: int | None = None, source: int | None = None, date_from: str | None = None,
    date_to: str | None = None, full_content: bool = False,
) -> DataFrame:
    """optional conjuncts; all of them reach the scan."""
    out = articles
    if category is not None:
        out = out.filter(F.col("category_id") == category)
    if source is not None:
        out = out.filter(F.col("source_id") == source)
    if date_from:
        out = out.filter(F.col("scraped_at") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        out = out.filter(F.col("scraped_at") < F.lit(date_to).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    return out.filter("has_full_content") if full_content else out


def story_filters(stories: DataFrame, status: str | None = None, theme: str | None = None, search: str | None = None) -> DataFrame:
    """case-insensitive contains over the card text and the entity list."""
    out = stories
    if status:
        out = out.filter(F.col("status") == status)
    if theme:
        out = out.filter(F.col("primary_theme") == theme)
    if search and search.strip():
        needle = search.strip().lower()
        fields = [F.col("title"), F.col("short_summary"), F.col("overview"), F.to_json("entities")]
        found = F.lit(False)
        for field in fields:
            found = found | F.lower(F.coalesce(field, F.lit(""))).contains(needle)
        out = out.filter(found)
    return out


def exclude_ids(df: DataFrame, *id_tables: DataFrame) -> DataFrame:
    """drop rows whose id is in any of the tables."""
    out = df
    for ids in id_tables:
        out = out.join(ids.select("id"), "id", "left_anti")
    return out


def visible_comments(comments: DataFrame) -> DataFrame:
    """approved top-level comments."""
    return comments.filter(F.col("parent_id").isNull() & F.col("is_approved"))


def unsuppressed_alerts(alerts: DataFrame, articles: DataFrame, status: str | None = None) -> DataFrame:
    """alerts on full articles, of one status or all but the suppressed."""
    full = articles.filter("has_full_content").select(F.col("id").alias("article_id"))
    wanted = F.col("status") == status if status else ~F.col("status").eqNullSafe(F.lit("suppressed"))
    return alerts.filter(wanted).join(full, "article_id", "left_semi")


def active_tokens(tokens: DataFrame) -> DataFrame:
    """F6."""
    return tokens.filter("is_active")


def published_digests(digests: DataFrame) -> DataFrame:
    """newest first."""
    return digests.filter("is_published").orderBy(F.desc("digest_date"))


def filter_by_keyword(articles: DataFrame, keyword: str) -> DataFrame:
    """F7."""
    needle = keyword.lower()
    found = F.lit(False)
    for field in ("title", "excerpt", "content"):
        found = found | F.lower(F.coalesce(field, F.lit(""))).contains(needle)
    return articles.filter(found)


def filter_by_category(articles: DataFrame, categories: DataFrame, needle: str) -> DataFrame:
    """by part of the category name."""
    wanted = categories.filter(F.lower("name").contains(needle.lower())).select(F.col("id").alias("category_id"))
    return articles.join(wanted, "category_id", "left_semi")


def article_list(articles: DataFrame, sources: DataFrame, categories: DataFrame, enrichments: DataFrame) -> DataFrame:
    """F8: the columns of a feed row, with names and summary."""
    outlet = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    section = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    notes = enrichments.filter("status = 'completed'").select(F.col("article_id").alias("id"), "summary", "importance_score")
    return (
        articles.join(outlet, "source_id", "left").join(section, "category_id", "left").join(notes, "id", "left")
        .select(
            "id", "title", "url", "excerpt", "image_url", "source_name", "category_name", "published_at", "scraped_at",
            tx.read_minutes(F.col("word_count")).alias("read_time_minutes"), "summary", "importance_score",
        )
    )


def article_snippet(articles: DataFrame, sources: DataFrame, categories: DataFrame, authors: DataFrame) -> DataFrame:
    """F8: the compact form nested in digests and guidance."""
    outlet = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    section = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    writer = authors.select(F.col("id").alias("author_id"), F.col("name").alias("author_name"))
    return (
        articles.filter("has_full_content").join(outlet, "source_id", "left").join(section, "category_id", "left")
        .join(writer, "author_id", "left")
        .select(
            "id", "title", "url", "excerpt", "image_url", "source_name", "category_name", "author_name", "published_at",
            tx.read_minutes(F.col("word_count")).alias("read_time_minutes"),
        )
    )


def exclude_themes(df: DataFrame, themes: Sequence[str] = ("sports",), column: str = "themes") -> DataFrame:
    """F10."""
    banned = F.array(*[F.lit(t) for t in themes])
    return df.filter(~F.coalesce(F.arrays_overlap(column, banned), F.lit(False)))


def rows_by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """batch lookup."""
    return df.join(ids.select(key), key, "left_semi")


# --- scored feeds --------------------------------------------------------------------


def article_score(
    articles: DataFrame, views: DataFrame, as_of: Column, recency: float = 0.4, engagement: float = 0.3,
    quality: float = 0.3, window_hours: int = 48,
) -> DataFrame:
    """Recency, engagement and quality ladders and their weighted sum.

    Views are counted per article before the join, so nothing multiplies them.
    """
    since = hours_before(as_of, window_hours)
    counts = recent_and_total_views(views, since).withColumnRenamed("article_id", "id")
    joined = articles.join(counts, "id", "left")
    hours, words, full = F.col("hours_old"), F.col("word_count"), F.col("has_full_content")
    ladder = lambda steps, rest: _ladder(hours, steps, rest)
    recent = F.col("recent_view_count")
    return (
        joined.withColumns(
            {
                "hours_old": tx.age_hours(F.col("scraped_at"), as_of),
                "recent_view_count": F.coalesce("recent_view_count", F.lit(0)),
                "total_view_count": F.coalesce("total_view_count", F.lit(0)),
            }
        )
        .withColumns(
            {
                "recency_score": ladder([(6, 100.0), (12, 80.0), (24, 60.0), (48, 40.0), (72, 20.0)], 10.0),
                "engagement_score": F.when(hours <= 24, recent * 10).when(hours <= 48, recent * 5).otherwise(recent * 2).cast("double"),
                "quality_score": F.when(full & (words >= 800), 100.0).when(full & (words >= 400), 70.0).when(full, 50.0)
                .when(words >= 200, 30.0).otherwise(10.0),
            }
        )
        .withColumn(
            "article_score",
            F.col("recency_score") * recency + F.col("engagement_score") * engagement + F.col("quality_score") * quality,
        )
    )


def _ladder(value: Column, steps: Sequence[tuple[float, float]], rest: float) -> Column:
    out = None
    for bound, score in steps:
        out = F.when(value <= bound, score) if out is None else out.when(value <= bound, score)
    return out.otherwise(rest)


def top_story(candidates: DataFrame, as_of: Column) -> DataFrame:
    """R2: the best story of the last 18 hours, else of the last 36."""
    hours = F.col("hours_old")
    decay = _ladder(hours, [(4, 1.0), (8, 0.8), (12, 0.6), (18, 0.4)], 0.2)
    boost = F.when(F.col("is_breaking_candidate") & (hours <= 6), 2.0).otherwise(0.0)
    scored = (
        candidates.filter(F.col("scraped_at") >= hours_before(as_of, 36))
        .withColumn("hours_old", tx.age_hours(F.col("scraped_at"), as_of))
        .withColumn("top_story_score", F.col("importance_score") * decay + boost)
        .withColumn("tier", F.when(F.col("scraped_at") >= hours_before(as_of, 18), 0).otherwise(1))
    )
    return scored.orderBy("tier", F.desc("top_story_score"), *freshness_order()).limit(1)


def featured(candidates: DataFrame, as_of: Column, limit: int = 5, hours: int = 72) -> DataFrame:
    """Recent articles first, topped up from the rest, in one pass."""
    tier = F.when(F.col("scraped_at") >= hours_before(as_of, hours), 0).otherwise(1)
    return candidates.withColumn("tier", tier).orderBy("tier", *intelligence_order()).limit(limit)


def top_reads(articles: DataFrame, views: DataFrame, as_of: Column, days: int = 7, limit: int = 10) -> DataFrame:
    """Most-read articles of the last days."""
    recent = articles.filter(F.col("scraped_at") >= hours_before(as_of, days * 24))
    scored = article_score(recent, views, as_of, 0.2, 0.6, 0.2, window_hours=days * 24)
    return scored.orderBy(F.desc("engagement_score"), F.desc("article_score"), *freshness_order()).limit(limit)


def latest(articles: DataFrame, as_of: Column, hours: int | None = None, limit: int = 20) -> DataFrame:
    """R5."""
    rows = articles.filter(F.col("scraped_at") >= hours_before(as_of, hours)) if hours else articles
    return rows.orderBy(*freshness_order()).limit(limit)


def trending(articles: DataFrame, views: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    """Views of the last day per hour of age."""
    since = hours_before(as_of, 24)
    counts = views.filter(F.col("viewed_at") >= since).groupBy(F.col("article_id").alias("id")).agg(
        F.count(F.lit(1)).alias("recent_views")
    )
    fresh = articles.filter(F.col("scraped_at") >= since).join(counts, "id")
    hours = tx.age_hours(F.col("scraped_at"), as_of)
    score = F.when(hours > 0, F.col("recent_views") / F.greatest(hours, F.lit(1.0))).otherwise(F.col("recent_views").cast("double"))
    return fresh.withColumn("trending_score", score).orderBy(
        F.desc("trending_score"), F.desc("recent_views"), *freshness_order()
    ).limit(limit)


_ORDER_COLUMNS = ("is_breaking_candidate", "importance_score", "follow_up_worthy", "scraped_at")


def _as_rank_key(*columns: str) -> list[Column]:
    """Struct fields that sort like ``desc_nulls_first`` when the struct is sorted descending."""
    return [field for c in columns for field in (F.col(c).isNull().alias(f"_{c}_null"), F.col(c))]


def read_next_for_articles(candidates: DataFrame, seeds: DataFrame, limit: int = 5) -> DataFrame:
    """R7 for every seed article at once.

    Score: same category 40, else same outlet 20, else a shared tag 30, else 0; the
    highest score counts when tags match more than once. The order inside a score does
    not depend on the seed, so short ranked lists per category, outlet and tag hold
    every article that can reach a seed's first ``limit`` places, and no category is
    ever paired with itself.

    A seed whose category has more than ``limit`` candidates is done with that list. For
    the others a lower score is only needed when the higher ones fill fewer than
    ``limit`` places, so at most that many entries of a list belong to a higher score,
    plus the seed itself. A tag list may also hold the seed's own outlet, which scores
    lower; it is capped per outlet first, which leaves one outlet's share to skip.
    """
    depth = 2 * limit + 1
    base = candidates.select("id", "category_id", "source_id", "tags", *_ORDER_COLUMNS)
    entry = F.struct(*_as_rank_key(*_ORDER_COLUMNS), "id", F.col("category_id").alias("ccat"), F.col("source_id").alias("csrc"))
    order = intelligence_order()
    by_category = ranked_lists(base, "category_id", entry, order, depth)
    seed = seeds.select(F.col("id").alias("seed_id"), F.col("category_id").alias("scat"), F.col("source_id").alias("ssrc"), "tags")
    placed = seed.join(by_category, F.col("scat").eqNullSafe(F.col("key")), "left").drop("key")
    none = F.array().cast(by_category.schema["list"].dataType)
    own = F.filter(F.coalesce("list", none), lambda x: x["id"] != F.col("seed_id"))
    placed = placed.withColumn("own", F.sort_array(own, asc=False)).drop("list")
    rich = placed.filter(F.size("own") >= limit).select("seed_id", F.posexplode(F.slice("own", 1, limit)).alias("_at", "x"))
    done = rich.select("seed_id", "x.id", F.lit(40).alias("read_next_score"), (F.col("_at") + 1).alias("rank"))

    poor = placed.filter(F.size("own") < limit)
    by_source = ranked_lists(base, "source_id", entry, order, depth)
    tagged = base.withColumn("tag", F.explode(F.array_distinct("tags")))
    capped = top_n(tagged, ["tag", "source_id"], order, depth, rank="_pos").drop("_pos")
    by_tag = ranked_lists(capped, "tag", entry, order, 2 * depth)
    everywhere = base.orderBy(*order).limit(depth).groupBy().agg(F.collect_list(entry).alias("anywhere"))
    tag_hits = (
        poor.select("seed_id", F.explode(F.array_distinct("tags")).alias("key")).join(by_tag, "key")
        .groupBy("seed_id").agg(F.array_distinct(F.flatten(F.collect_list("list"))).alias("tag_hits"))
    )
    wide = (
        poor.join(by_source, F.col("ssrc").eqNullSafe(F.col("key")), "left").drop("key")
        .join(tag_hits, "seed_id", "left").withColumn("anywhere", everywhere.scalar())
    )
    shared = F.transform(F.coalesce("tag_hits", none), lambda x: x["id"])
    pool = F.array_distinct(F.concat("own", F.coalesce("tag_hits", none), F.coalesce("list", none), "anywhere"))

    def scored(x):
        score = (
            F.when(x["ccat"].eqNullSafe(F.col("scat")), 40)
            .when(x["csrc"].eqNullSafe(F.col("ssrc")), 20)
            .when(F.array_contains("shared", x["id"]), 30).otherwise(0)
        )
        return F.struct(score.alias("read_next_score"), x.alias("x"))

    others = wide.withColumn("shared", shared).withColumn("pool", F.filter(pool, lambda x: x["id"] != F.col("seed_id")))
    best = F.slice(F.sort_array(F.transform("pool", scored), asc=False), 1, limit)
    rest = others.select("seed_id", F.posexplode(best).alias("_at", "y")).select(
        "seed_id", "y.x.id", "y.read_next_score", (F.col("_at") + 1).alias("rank")
    )
    return done.unionByName(rest)


def read_next_for_users(
    candidates: DataFrame, profiles: DataFrame, views: DataFrame, as_of: Column, limit: int = 5
) -> DataFrame:
    """R7 for every user: followed outlets 30, else preferred categories 20, else 0.

    Articles the user viewed in the last 14 days are left out. A user who viewed v
    candidates needs v places more of every ranked list; those places are looked up by
    (list, position), so the work is the sum of the places, not users times articles.
    """
    base = candidates.select("id", "category_id", "source_id", *_ORDER_COLUMNS).withColumn("_day", F.to_date("scraped_at"))
    coarse = [("is_breaking_candidate", True), ("importance_score", True), ("follow_up_worthy", True), ("_day", True)]
    viewed = (
        views.filter(F.col("viewed_at") >= hours_before(as_of, 14 * 24)).select("user_id", F.col("article_id").alias("id"))
        .distinct().join(base.select("id"), "id", "left_semi")
    )
    seen = viewed.groupBy("user_id").agg(F.count(F.lit(1)).alias("_seen"))
    # Fewer than ``limit`` rows of a list can hold a higher score when the list is
    # needed at all, so twice the limit plus the viewed rows is always deep enough.
    users = profiles.select("user_id", "preferred_categories", "followed_sources").join(seen, "user_id", "left")
    lists = F.concat(
        F.transform("followed_sources", lambda x: F.concat(F.lit("s"), x)),
        F.transform("preferred_categories", lambda x: F.concat(F.lit("c"), x)), F.array(F.lit("all")),
    )
    requests = users.select("user_id", (F.coalesce("_seen", F.lit(0)) + 2 * limit).alias("need"), lists.alias("lists"))
    named = [F.concat(F.lit("s"), "source_id"), F.concat(F.lit("c"), "category_id"), F.lit("all")]
    places = ranked_places(base, named, coarse, intelligence_order(), ["id", "category_id", "source_id", *_ORDER_COLUMNS], list_depths(requests))
    hits = pick_places(requests, places, "user_id")
    fresh = hits.join(viewed, ["user_id", "id"], "left_anti").join(
        profiles.select("user_id", "preferred_categories", "followed_sources"), "user_id"
    )
    score = (
        F.when(F.array_contains("followed_sources", F.col("source_id")), 30)
        .when(F.array_contains("preferred_categories", F.col("category_id")), 20).otherwise(0)
    )
    ranked = top_n(fresh.withColumn("read_next_score", score), ["user_id"], [F.desc("read_next_score"), *intelligence_order()], limit)
    return ranked.select("user_id", "id", "read_next_score", "rank")


def related(articles: DataFrame, seeds: DataFrame, views: DataFrame, as_of: Column, limit: int = 5) -> DataFrame:
    """R8 for every seed: best recent articles of its category, outlet or tags.

    The score belongs to the candidate alone, so the first ``limit + 1`` per category,
    outlet and tag contain the answer for every seed; no group is paired with itself.
    """
    recent = articles.filter(F.col("scraped_at") >= hours_before(as_of, 7 * 24))
    scored = article_score(recent, views, as_of, 0.5, 0.3, 0.2, window_hours=168)
    order = [F.desc("article_score"), *freshness_order()]
    entry = F.struct("article_score", "scraped_at", "id")

    def keyed(df, owner):
        label = lambda prefix, c: F.concat(F.lit(prefix), F.coalesce(c.cast("string"), F.lit("-")))
        keys = F.concat(
            F.array(label("c", F.col("category_id")), label("s", F.col("source_id"))),
            F.transform(F.array_distinct("tags"), lambda t: label("t", t)),
        )
        return df.withColumn("key", F.explode(keys)).withColumnRenamed("id", owner)

    lists = ranked_lists(keyed(scored, "id"), "key", entry, order, limit + 1)
    return best_of_lists(keyed(seeds, "seed_id").select("seed_id", "key"), lists, "seed_id", limit).drop("scraped_at")


def overlap_top_n(seeds: DataFrame, candidates: DataFrame, rank_key: Sequence[Column], order: Sequence[Column], limit: int) -> DataFrame:
    """For every seed the first ``limit`` candidates that share an element of ``keys``.

    Candidates are ranked per element first; ``limit + 1`` of each are enough, since the
    order does not depend on the seed.
    """
    entries = candidates.withColumn("key", F.explode(F.array_distinct("keys")))
    lists = ranked_lists(entries, "key", F.struct(*rank_key, "id"), order, limit + 1)
    keys = seeds.select(F.col("id").alias("seed_id"), F.explode(F.array_distinct("keys")).alias("key"))
    return best_of_lists(keys, lists, "seed_id", limit)


def suggested_next_reads(
    articles: DataFrame, enrichments: DataFrame, links: DataFrame, stories: DataFrame, mentions: DataFrame, limit: int = 5
) -> DataFrame:
    """R9 for every full article: same story, else shared arc, else shared entity."""
    full = articles.filter("has_full_content").select("id", "published_at")
    notes = enrichments.select(F.col("article_id").alias("id"), "importance_score", "status", "related_themes")
    base = full.join(notes, "id", "left")
    order = [F.desc_nulls_first("importance_score"), F.desc_nulls_first("published_at"), F.desc("id")]
    rank_key = _as_rank_key("importance_score", "published_at")
    weight = stories.select(F.col("id").alias("story_id"), F.col("importance_score").alias("_w"), "last_seen_at")
    own_story = (
        links.join(weight, "story_id").groupBy(F.col("article_id").alias("id"))
        .agg(F.max_by("story_id", F.struct("_w", "last_seen_at", "story_id")).alias("story_id"))
    )
    story_key = F.array(F.col("story_id").cast("string")).alias("keys")
    members = links.select(F.col("article_id").alias("id"), story_key).distinct()
    done = base.filter("status = 'completed'")
    names = mentions.select(F.col("article_id").alias("id"), F.array("normalized_name").alias("keys")).distinct()

    def tier(number, seeds, candidates):
        found = overlap_top_n(seeds, candidates, rank_key, order, limit)
        return found.select("seed_id", "id", "rank", F.lit(number).alias("tier"))

    annotated = base.filter("status IS NOT NULL")
    arcs = F.coalesce("related_themes", F.array().cast("array<string>"))
    tiers = (
        tier(1, full.join(own_story, "id").select("id", story_key), base.join(members, "id"))
        .unionByName(tier(2, annotated.select("id", arcs.alias("keys")), done.withColumn("keys", arcs)))
        .unionByName(tier(3, annotated.select("id").join(names, "id"), done.join(names, "id")))
    )
    kept = tiers.withColumn("_best", F.min("tier").over(Window.partitionBy("seed_id"))).filter("tier = _best")
    return kept.select("seed_id", "id", "tier", "rank")


def guide_cards(
    links: DataFrame, stories: DataFrame, alerts: DataFrame, mentions: DataFrame, enrichments: DataFrame, articles: DataFrame,
    as_of: Column, visible: DataFrame | None = None, brand: str = "News",
) -> DataFrame:
    """Story, alert, entity and context cards with capped confidence, best first.

    ``visible`` holds ``article_id`` and ``position`` of the articles on screen; without
    it the cards come from the whole corpus and there are no context cards.
    """
    from pressline.operators.trends import complete_mentions, entity_context_counts, story_counts

    counts = story_counts(links, articles)
    in_view = visible.select("article_id") if visible is not None else None
    anchor = F.lit(None).cast("bigint")
    if visible is not None:
        last = visible.agg(F.max_by("article_id", "position").alias("_anchor"))

    story_rows = stories.withColumnRenamed("id", "story_id").join(counts, "story_id")
    if visible is None:
        story_rows = story_rows.filter("article_count >= 2")
    else:
        story_rows = story_rows.join(links.join(in_view, "article_id", "left_semi"), "story_id", "left_semi")
    spread = F.concat(
        F.lit("This story is appearing across "), F.col("source_count"), F.lit(" sources and "), F.col("article_count"),
        F.lit(" related articles."),
    )
    why = F.coalesce("why_this_matters", F.lit(""))

    def card(df, key, kind, label, title, reason, confidence, hours, insert_after):
        return df.select(
            key.alias("id"), F.lit(kind).alias("type"), F.lit(label).alias("label"), title.alias("title"), reason.alias("reason"),
            confidence.alias("confidence"), (as_of + F.make_dt_interval(hours=F.lit(hours))).alias("expires_at"),
            insert_after.cast("bigint").alias("insert_after_article_id"),
        )

    def capped(top, base, score):
        return F.least(F.lit(top), F.lit(base) + F.coalesce(score, F.lit(0)) / 20)

    story_cards = card(
        story_rows.orderBy(F.desc_nulls_first("importance_score"), F.desc_nulls_first("last_seen_at"), "story_id").limit(8),
        F.concat(F.lit("cluster-"), F.col("story_id")), "cluster", f"{brand} guide",
        F.coalesce(F.nullif("title", F.lit("")), F.lit("Follow this story thread")),
        F.when(why != "", why).otherwise(spread), capped(0.95, 0.55, F.col("importance_score")), 6, anchor,
    )
    alert_rows = unsuppressed_alerts(alerts, articles)
    if visible is not None:
        shown_stories = links.join(in_view, "article_id", "left_semi").select("story_id").distinct()
        alert_rows = alert_rows.join(in_view, "article_id", "left_semi").unionByName(
            alert_rows.join(shown_stories, "story_id", "left_semi").select(*alert_rows.columns)
        ).distinct()
    alert_cards = card(
        alert_rows.orderBy(F.desc_nulls_first("importance_score"), F.desc("created_at"), "id").limit(6),
        F.concat(F.lit("alert-"), F.col("id")), "alert", f"{brand} alert", F.col("title"), F.col("reason"),
        capped(0.98, 0.6, F.col("importance_score")), 3, F.col("article_id") if visible is None else anchor,
    )
    names = entity_context_counts(complete_mentions(mentions, enrichments, articles), as_of, in_view)
    entity_cards = card(
        names, F.concat(F.lit("entity-"), F.col("entity_type"), F.lit("-"), F.replace("normalized_name", F.lit(" "), F.lit("-"))),
        "entity", "Entity watch", F.initcap("normalized_name"),
        F.concat(F.lit("Mentioned "), F.col("mention_count"), F.lit(" times across "), F.col("article_count"),
                 F.lit(" articles in this reading context.")),
        capped(0.92, 0.5, F.col("mention_count")), 6, anchor,
    )
    cards = story_cards.unionByName(alert_cards).unionByName(entity_cards)
    if visible is not None:
        notes = intelligence_articles(articles, enrichments.withColumn("importance_score", F.coalesce("importance_score", F.lit(0))))
        shown = notes.join(in_view.withColumnRenamed("article_id", "id"), "id", "left_semi")
        reason = (
            F.when(F.size("bias_notes") > 0, F.get("bias_notes", F.lit(0)))
            .when(F.col("impact_note") != "", "This story has local impact context worth checking before moving on.")
            .when(F.col("follow_up_worthy"), "This article connects to a developing story worth following.")
            .otherwise("")
        )
        first = shown.orderBy(F.desc_nulls_first("importance_score"), "id").limit(6).withColumn("_reason", reason).filter("_reason <> ''")
        context_cards = card(
            first, F.concat(F.lit("context-"), F.col("id")), "context", f"{brand} context", F.lit("Before you move on"),
            F.col("_reason"), capped(0.9, 0.5, F.col("importance_score")), 6, F.col("id"),
        )
        cards = cards.withColumn(
            "insert_after_article_id", F.coalesce("insert_after_article_id", last.scalar())
        ).unionByName(context_cards)
    return cards.orderBy(F.desc("confidence"), "id")


def article_guidance(
    articles: DataFrame, enrichments: DataFrame, links: DataFrame, stories: DataFrame, mentions: DataFrame,
    perspectives: DataFrame, sources: DataFrame,
) -> DataFrame:
    """R11 for every full article: its story, first entities, arcs, facts and missing context."""
    from pressline.operators.trends import story_counts

    base = articles.filter("has_full_content").select("id", "title", "excerpt")
    notes = enrichments.select(
        F.col("article_id").alias("id"), "summary", "impact_note", "bias_notes",
        F.col("related_themes").alias("story_arcs"), "key_facts",
    )
    weight = stories.select(
        F.col("id").alias("story_id"), F.col("importance_score").alias("_w"), "last_seen_at",
        F.col("title").alias("story_title"), "why_this_matters",
    )
    best = F.max(F.struct("_w", "last_seen_at", "story_id", "story_title", "why_this_matters")).alias("story")
    own = links.join(weight, "story_id").groupBy(F.col("article_id").alias("id")).agg(best)
    counts = story_counts(links, articles)
    entities = (
        top_n(mentions, ["article_id"], [F.asc("entity_type"), F.asc("entity_name")], 12, rank="_pos")
        .groupBy(F.col("article_id").alias("id"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "entity_name", "entity_type"))),
                         lambda e: F.concat(e["entity_type"], F.lit(":"), e["entity_name"])).alias("key_entities"))
    )
    # Five perspectives of the story other than the article's own: six per story suffice.
    outlet = sources.select(F.col("id").alias("source_id"), "name")
    voices = (
        top_n(perspectives, ["story_id"], [F.asc("article_id")], 6, rank="_pos").join(outlet, "source_id", "left")
        .groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("_pos", "article_id", "name", "omitted_context"))).alias("_voices"))
    )
    joined = (
        base.join(notes, "id", "left").join(own, "id", "left").withColumn("story_id", F.col("story.story_id"))
        .join(counts, "story_id", "left").join(entities, "id", "left").join(voices, "story_id", "left")
    )
    others = F.slice(F.filter(F.coalesce("_voices", F.array()), lambda v: v["article_id"] != F.col("id")), 1, 5)
    said = F.transform(
        F.filter(others, lambda v: F.coalesce(v["omitted_context"], F.lit("")) != ""),
        lambda v: F.concat(v["name"], F.lit(": "), v["omitted_context"]),
    )
    no_text = F.array().cast("array<string>")
    filled = lambda c: F.nullif(c, F.lit(""))
    return joined.select(
        "id", "title", "story_id", F.col("story.story_title").alias("story_title"), "article_count", "source_count",
        F.coalesce("key_entities", no_text).alias("key_entities"), F.coalesce("story_arcs", no_text).alias("story_arcs"),
        F.coalesce("key_facts", no_text).alias("key_facts"),
        F.coalesce(filled(F.col("story.why_this_matters")), filled("impact_note"), filled("summary"), "excerpt", F.lit("")).alias("why_it_matters"),
        F.concat(F.coalesce("bias_notes", no_text), F.coalesce(said, no_text)).alias("missing_context"),
    )
