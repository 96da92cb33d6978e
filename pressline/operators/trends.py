"""Counts, trends, calendars and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from pressline.functions import clients
from pressline.operators.ranking import top_n

# --- fixed values: words left out of headline keywords ---
HEADLINE_STOP_WORDS = [
    "the", "and", "for", "are", "with", "his", "her", "this", "that", "from", "they", "been", "have", "has",
    "will", "said", "says",
]


def days_before(as_of: Column, days: int) -> Column:
    return F.date_sub(F.to_date(as_of), days)


def view_counts(articles: DataFrame, views: DataFrame) -> DataFrame:
    """A1: views per article, 0 where there are none."""
    counts = views.groupBy(F.col("article_id").alias("id")).agg(F.count("id").alias("view_count"))
    return articles.join(counts, "id", "left").withColumn("view_count", F.coalesce("view_count", F.lit(0)))


def recent_and_total_views(views: DataFrame, since: Column) -> DataFrame:
    """A2: both counts in one pass."""
    return views.groupBy("article_id").agg(
        F.count_if(F.col("viewed_at") >= since).alias("recent_view_count"),
        F.count(F.lit(1)).alias("total_view_count"),
    )


def status_counts(enrichments: DataFrame) -> DataFrame:
    """A2: annotation progress."""
    def of(status):
        return F.count_if(F.col("status") == status).alias(status)

    return enrichments.agg(F.count(F.lit(1)).alias("total"), of("completed"), of("failed"), of("pending"))


def story_counts(links: DataFrame, articles: DataFrame, full_content_only: bool = False, at_least: int = 0) -> DataFrame:
    """A3: distinct articles and outlets per story."""
    members = articles.select(F.col("id").alias("article_id"), "source_id", "has_full_content")
    counted = F.col("has_full_content") if full_content_only else F.lit(True)
    counts = (
        links.select("story_id", "article_id").distinct().join(members, "article_id")
        .groupBy("story_id")
        .agg(
            F.count_if(counted).alias("article_count"),
            F.countDistinct(F.when(counted, F.col("source_id"))).alias("source_count"),
        )
    )
    return counts.filter(F.col("article_count") >= at_least) if at_least else counts


def trending_entities(mentions: DataFrame, as_of: Column, window_days: int = 7, limit: int = 50) -> DataFrame:
    """A4."""
    return (
        mentions.filter(F.col("mention_date") >= days_before(as_of, window_days))
        .groupBy("normalized_name", "entity_name", "entity_type")
        .agg(F.count(F.lit(1)).alias("mention_count"))
        .orderBy(F.desc("mention_count"), "normalized_name", "entity_name", "entity_type")
        .limit(limit)
    )


def digest_trending_entities(
    mentions: DataFrame, target_date: Column, window_days: int = 7, limit: int = 20, until: Column | None = None
) -> DataFrame:
    """A5: no upper date bound unless ``until`` is given."""
    rows = mentions.filter(F.col("mention_date") >= F.date_sub(target_date, window_days))
    if until is not None:
        rows = rows.filter(F.col("mention_date") <= until)
    return (
        rows.groupBy("entity_name", "entity_type")
        .agg(F.count(F.lit(1)).alias("mention_count"), F.avg("sentiment_score").alias("avg_sentiment"))
        .orderBy(F.desc("mention_count"), "entity_name", "entity_type")
        .limit(limit)
    )


def complete_mentions(mentions: DataFrame, enrichments: DataFrame, articles: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Mentions of completed annotations on full articles, of active outlets when ``sources`` is given."""
    done = enrichments.filter(F.col("status") == "completed").select("article_id")
    full = articles.filter("has_full_content")
    if sources is not None:
        full = full.join(sources.filter("is_active").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    eligible = done.join(full.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    return mentions.join(eligible, "article_id", "left_semi")


def entity_context_counts(
    mentions: DataFrame, as_of: Column, visible: DataFrame | None = None, at_least: int = 2, limit: int = 8
) -> DataFrame:
    """Entities of the visible articles, or of the last seven days."""
    rows = (
        mentions.join(visible.select("article_id"), "article_id", "left_semi")
        if visible is not None
        else mentions.filter(F.col("mention_date") >= days_before(as_of, 7))
    )
    return (
        rows.groupBy("normalized_name", "entity_type")
        .agg(F.count(F.lit(1)).alias("mention_count"), F.countDistinct("article_id").alias("article_count"))
        .filter(F.col("mention_count") >= at_least)
        .orderBy(F.desc("mention_count"), "normalized_name", "entity_type")
        .limit(limit)
    )


def top_entities(mentions: DataFrame, as_of: Column, window_days: int = 7, limit: int = 10) -> DataFrame:
    """By the resolved name, which falls back to the display name."""
    resolved = F.coalesce(F.nullif(F.col("normalized_name"), F.lit("")), F.col("entity_name"))
    return (
        mentions.filter(F.col("mention_date") >= days_before(as_of, window_days))
        .groupBy(resolved.alias("resolved_name"), "entity_type")
        .agg(F.count(F.lit(1)).alias("mention_count"))
        .orderBy(F.desc("mention_count"), "resolved_name", "entity_type")
        .limit(limit)
    )


def intensity_level(count: Column, peak: Column) -> Column:
    share = count / peak
    return (
        F.when((count <= 0) | (peak <= 0), 0)
        .when(share <= 0.25, 1)
        .when(share <= 0.5, 2)
        .when(share <= 0.75, 3)
        .otherwise(4)
    )


def mention_calendar(mentions: DataFrame, month_start: Column) -> DataFrame:
    """A zero-filled month for every entity, with daily and monthly figures.

    ``total_articles`` adds up the daily distinct counts. A month has at most 31 days,
    so the per-entity map that fills the gaps stays small.
    """
    last = F.last_day(month_start)
    daily = (
        mentions.filter(F.col("mention_date").between(month_start, last))
        .groupBy("normalized_name", "entity_type", "mention_date")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("article_id").alias("articles"))
    )
    monthly = daily.groupBy("normalized_name", "entity_type").agg(
        F.map_from_entries(F.collect_list(F.struct("mention_date", F.struct("n", "articles")))).alias("by_day"),
        F.max("n").alias("max_count"), F.sum("n").alias("total_mentions"), F.sum("articles").alias("total_articles"),
    )
    days = monthly.withColumn("date", F.explode(F.sequence(month_start, last)))
    found = F.col("by_day")[F.col("date")]
    filled = days.withColumns(
        {"mention_count": F.coalesce(found["n"], F.lit(0)), "article_count": F.coalesce(found["articles"], F.lit(0))}
    )
    return filled.select(
        "normalized_name", "entity_type", "date", F.dayofmonth("date").alias("day"), F.weekday("date").alias("weekday"),
        "mention_count", "article_count", intensity_level(F.col("mention_count"), F.col("max_count")).alias("level"),
        "max_count", "total_mentions", "total_articles",
    )


def cost_totals(enrichments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tokens and dollars over all calls, or per given columns."""
    cost = clients.token_cost(F.col("model_used"), F.col("input_tokens"), F.col("output_tokens"))
    return enrichments.withColumn("cost", cost).groupBy(*by).agg(
        F.sum("cost").alias("total_cost"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
    )


def source_health(sources: DataFrame, runs: DataFrame, articles: DataFrame, as_of: Column) -> DataFrame:
    """A10: the latest run and the last day's output of every outlet."""
    day_ago = as_of - F.expr("INTERVAL 24 HOURS")
    run_facts = runs.groupBy("source_id").agg(
        F.max(F.struct("started_at", "run_id", "status", "articles_found")).alias("latest"),
        F.sum(F.when(F.col("started_at") >= day_ago, F.col("error_count"))).alias("error_count_24h"),
    )
    fresh = articles.filter(F.col("scraped_at") >= day_ago)
    output = fresh.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("articles_24h"), F.count_if("has_full_content").alias("full_content_24h")
    )
    return (
        sources.withColumnRenamed("id", "source_id").join(run_facts, "source_id", "left").join(output, "source_id", "left")
        .select(
            "source_id", "name", F.col("latest.status").alias("latest_run_status"),
            F.col("latest.started_at").alias("latest_run_started_at"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("articles_24h", "full_content_24h", "error_count_24h")],
        )
    )


def notification_stats(
    users: DataFrame, tokens: DataFrame, schedules: DataFrame, notifications: DataFrame, history: DataFrame,
    breaking: DataFrame, as_of: Column, days: int = 7,
) -> DataFrame:
    """The notification report as ``(section, name, value)`` rows."""
    since = as_of - F.make_dt_interval(days=F.lit(days))

    def facts(df, section, **metrics):
        one = df.agg(*[expr.cast("double").alias(name) for name, expr in metrics.items()])
        pairs = F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("value")) for name in metrics])
        return one.select(F.lit(section).alias("section"), F.explode(pairs).alias("m")).select("section", "m.name", "m.value")

    def counts(df, section, column):
        label = F.when(F.coalesce(F.col(column), F.lit("")) == "", "unknown").otherwise(F.col(column))
        grouped = df.groupBy(label.alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
        return grouped.select(F.lit(section).alias("section"), "name", "value")

    active_tokens, active_schedules = tokens.filter("is_active"), schedules.filter("is_active")
    sent = notifications.filter(F.col("sent_at") >= since)
    logged = history.filter(F.col("sent_at") >= since)
    total = F.count(F.lit(1))
    top_users = (
        sent.groupBy("user_id").agg(total.cast("double").alias("value"))
        .orderBy(F.desc("value"), "user_id").limit(5)
        .select(F.lit("top_user").alias("section"), F.col("user_id").cast("string").alias("name"), "value")
    )
    parts = [
        facts(users, "users", total=total),
        facts(active_tokens, "users", with_tokens=F.countDistinct("user_id")),
        facts(active_schedules, "users", with_schedules=F.countDistinct("user_id")),
        facts(tokens, "tokens", total=total, active=F.count_if("is_active")),
        counts(active_tokens, "tokens_by_platform", "platform"),
        facts(sent, "notifications", total=total, read=F.count_if("is_read"),
              read_rate=F.round(F.try_divide(F.count_if("is_read") * 100, total), 1)),
        counts(sent, "notifications_by_type", "notification_type"),
        facts(logged, "articles", sends=total, distinct=F.countDistinct("article_id"),
              sends_per_article=F.round(F.try_divide(total, F.countDistinct("article_id")), 1)),
        counts(active_schedules, "schedules_by_frequency", "frequency"),
        facts(breaking, "breaking", sent=F.count_if(F.col("is_sent") & (F.col("created_at") >= since)),
              pending=F.count_if(~F.col("is_sent"))),
        top_users,
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def user_notification_stats(notifications: DataFrame) -> DataFrame:
    """A11 for every user: totals, unread and counts by type."""
    def of(kind):
        return F.count_if(F.col("notification_type") == kind).alias(kind)

    return notifications.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_read")).alias("unread"), F.count_if("is_read").alias("read"),
        of("scheduled_digest"), of("breaking_news"), of("story_alert"),
    )


def incomplete_by_source(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """A12."""
    counts = articles.filter(~F.col("has_full_content")).groupBy("source_id").agg(F.count(F.lit(1)).alias("total"))
    names = sources.select(F.col("id").alias("source_id"), "name")
    return counts.join(names, "source_id", "left").select(F.coalesce("name", F.lit("Unknown")).alias("source_name"), "total")


def corpus_summary(articles: DataFrame, limit: int = 10) -> DataFrame:
    """Categories with shares, authors, tags and publish hours, counted in one pass.

    Every article contributes one row per dimension; Spark combines them before the
    shuffle, so one scan serves all sections.
    """
    def entry(section, value):
        return F.struct(F.lit(section).alias("section"), value.cast("string").alias("name"))

    entries = F.concat(
        F.array(
            entry("total", F.lit("all")), entry("category", F.col("category_name")), entry("author", F.col("author_name")),
            entry("published_hour", F.date_format("published_at", "HH")),
            entry("image", F.when(F.coalesce(F.col("image_url"), F.lit("")) != "", F.lit("with")).otherwise(F.lit("without"))),
        ),
        F.transform(F.col("tags"), lambda t: entry("tag", t)),
    )
    counts = (
        articles.select(F.explode(entries).alias("e")).filter("e.name IS NOT NULL")
        .groupBy("e.section", "e.name").agg(F.count(F.lit(1)).alias("n"))
    )
    total = counts.filter("section = 'total'").select("n").scalar()
    ranked = top_n(counts.filter("section <> 'total'"), ["section"], [F.desc("n"), F.asc("name")], limit)
    return ranked.select("section", "name", "n", F.round(F.col("n") * 100 / total, 1).alias("share"), "rank")


def length_summary(articles: DataFrame) -> DataFrame:
    """Word counts over articles that have words."""
    words = F.when(F.col("word_count") > 0, F.col("word_count"))
    return articles.agg(
        F.round(F.avg(words), 1).alias("mean_words"), F.max(words).alias("longest"), F.min(words).alias("shortest"),
        F.sum(words).alias("total_words"), F.count(F.lit(1)).alias("n_articles"),
    )


def headline_keywords(articles: DataFrame, limit: int = 10) -> DataFrame:
    """Frequent title words longer than three letters."""
    found = F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    words = articles.select(F.explode(found).alias("word"))
    kept = words.filter((F.length("word") > 3) & ~F.col("word").isin(HEADLINE_STOP_WORDS))
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("freq")).orderBy(F.desc("freq"), "word").limit(limit)


def dimension_counts(dimension: DataFrame, facts: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Rows of ``facts`` per row of ``dimension`` (joined on its id), 0 where none."""
    counts = facts.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias(count))
    return dimension.join(counts, "id", "left").withColumn(count, F.coalesce(count, F.lit(0)))


def mean_vector(
    vectors: DataFrame, key: str, order: Sequence[Column] = (), members: int | None = None, vector: str = "embedding"
) -> DataFrame:
    """Element-wise mean of the vectors of every key, summed before the shuffle.

    With ``members`` only the first so many under ``order`` count.
    """
    present = vectors.filter(F.col(vector).isNotNull())
    kept = top_n(present, [key], order, members) if members else present
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("_mean")
    grouped = kept.groupBy(key).agg(mean, F.count(F.lit(1)).cast("int").alias("n_members"))
    return grouped.select(key, vector_to_array("_mean").alias("centroid"), "n_members")


def set_union(rows: DataFrame, key: str, values: str, order: Sequence[Column] = (), members: int | None = None) -> DataFrame:
    """Distinct values over the rows of every key, or the first ``members`` under ``order``."""
    kept = top_n(rows, [key], order, members) if members else rows
    single = kept.select(key, F.explode(values).alias("_value")).distinct()
    found = single.groupBy(key).agg(F.array_sort(F.collect_list("_value")).alias(values))
    none = F.array().cast(rows.schema[values].dataType)
    return kept.select(key).distinct().join(found, key, "left").withColumn(values, F.coalesce(values, none))


def change_pair_counts(changes: DataFrame, old: str, new: str, limit: int = 25) -> DataFrame:
    """A18."""
    return (
        changes.groupBy(old, new).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), old, new).limit(limit)
    )


def sector_sentiment(enrichments: DataFrame, articles: DataFrame, date: Column) -> DataFrame:
    """Mean sentiment per theme on one publication date."""
    day = articles.filter(F.to_date("published_at") == date).select(F.col("id").alias("article_id"))
    done = enrichments.filter("status = 'completed'").join(day, "article_id", "left_semi")
    return (
        done.select(F.explode("themes").alias("theme"), "sentiment_score").groupBy("theme")
        .agg(F.round(F.avg("sentiment_score"), 6).alias("sentiment"), F.count(F.lit(1)).alias("n_articles"))
    )


def video_totals(videos: DataFrame, rollup: DataFrame) -> DataFrame:
    """Library figures; ``rollup`` holds views and watch seconds per video."""
    def of(status):
        return F.count_if(F.col("status") == status).alias(f"{status}_videos")

    joined = videos.join(rollup.withColumnRenamed("video_id", "id"), "id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total_videos"), of("ready"), of("processing"), of("failed"),
        F.coalesce(F.sum("view_count"), F.lit(0)).alias("total_views"),
        F.round(F.coalesce(F.sum("total_watch_seconds"), F.lit(0)) / 3600, 2).alias("total_watch_hours"),
    )
