"""Video views and library figures (VA1-VA7, F9, R12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressline.operators.ranking import top_n


def completion(watched: Column, duration: Column) -> Column:
    """VA1: watched percentage, at most 100; 0 without a duration or watch time."""
    known = (F.coalesce(duration, F.lit(0)) > 0) & (F.coalesce(watched, F.lit(0)) > 0)
    return F.when(known, F.least(F.lit(100.0), watched / duration * 100)).otherwise(0.0)


def with_completion(views: DataFrame, videos: DataFrame) -> DataFrame:
    """VA1 on every view, recomputed from the stored watch time."""
    durations = videos.select(F.col("id").alias("video_id"), "duration_seconds")
    joined = views.join(durations, "video_id")
    pct = completion(F.col("watch_seconds"), F.col("duration_seconds"))
    return joined.withColumn("completion_pct", pct).withColumn("is_completed", F.col("completion_pct") >= 90.0)


def video_analytics(videos: DataFrame, views: DataFrame) -> DataFrame:
    """VA2: totals, rates and breakdowns for every video.

    Views are reduced to one row per (video, device, quality) before anything is put
    together per video, so a video with most of the views costs a few rows.
    """
    marked = with_completion(views, videos)
    watched = F.col("watch_seconds")
    engaged = (F.col("duration_seconds") > 0) & (watched >= F.col("duration_seconds") * 0.25)
    label = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "unknown").otherwise(F.col(c))
    cells = marked.groupBy("video_id", label("device_type").alias("device"), label("quality_watched").alias("quality")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(watched).alias("watch"), F.count_if("is_completed").alias("completed"), F.count_if(engaged).alias("engaged")
    )
    totals = cells.groupBy("video_id").agg(*[F.sum(c).alias(c) for c in ("n", "watch", "completed", "engaged")])

    def breakdown(column, name):
        counts = cells.groupBy("video_id", column).agg(F.sum("n").alias("n"))
        return counts.groupBy("video_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))

    users = views.groupBy("video_id").agg(F.countDistinct("user_id").alias("unique_users"))
    joined = videos.select(F.col("id").alias("video_id"), "title", "status", "duration_seconds").join(totals, "video_id", "left")
    for part in (users, breakdown("device", "device_breakdown"), breakdown("quality", "quality_breakdown")):
        joined = joined.join(part, "video_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.col(c) * 100, F.col("n")), F.lit(0.0)), 2)
    return joined.select(
        "video_id", "title", "status", "duration_seconds", zero("n").alias("total_views"), zero("unique_users").alias("unique_users"),
        zero("watch").alias("total_watch_seconds"), F.round(F.coalesce(F.try_divide("watch", "n"), F.lit(0.0)), 2).alias("average_watch_seconds"),
        rate("completed").alias("completion_rate"), rate("engaged").alias("engagement_rate"), "device_breakdown", "quality_breakdown",
    )


def video_rollup(views: DataFrame) -> DataFrame:
    """VA3."""
    return views.groupBy("video_id").agg(F.count(F.lit(1)).alias("view_count"), F.sum("watch_seconds").alias("total_watch_seconds"))


def avg_engagement(videos: DataFrame, views: DataFrame) -> DataFrame:
    """VA4: mean of the capped watched share; 0 for videos without views or duration."""
    mean = with_completion(views, videos).groupBy("video_id").agg(F.avg("completion_pct").alias("engagement"))
    return videos.select(F.col("id").alias("video_id")).join(mean, "video_id", "left").withColumn("engagement", F.coalesce("engagement", F.lit(0.0)))


def quality_distribution(views: DataFrame) -> DataFrame:
    """VA5: count and share per quality; blank is unknown."""
    quality = F.when(F.coalesce("quality_watched", F.lit("")) == "", "unknown").otherwise(F.col("quality_watched"))
    counts = views.groupBy("video_id", quality.alias("quality")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("video_id").agg(F.sum("n").alias("total"))
    return counts.join(totals, "video_id").select("video_id", "quality", "n", F.round(F.col("n") * 100 / F.col("total"), 2).alias("percentage"))


def completion_rate(videos: DataFrame, views: DataFrame) -> DataFrame:
    """VA6: completed share of the views of every video, 0 without views."""
    rates = with_completion(views, videos).groupBy("video_id").agg((F.count_if("is_completed") * 100 / F.count(F.lit(1))).alias("completion_rate"))
    joined = videos.select(F.col("id").alias("video_id")).join(rates, "video_id", "left")
    return joined.withColumn("completion_rate", F.coalesce("completion_rate", F.lit(0.0)))


def stale_tasks(queue: DataFrame, as_of: Column, hours: int = 2) -> DataFrame:
    """VA7: tasks in work for too long, as failed rows."""
    stuck = queue.filter((F.col("status") == "processing") & (F.col("queued_at") < as_of - F.make_dt_interval(hours=F.lit(hours))))
    return stuck.withColumns({"status": F.lit("failed"), "error_message": F.lit("Task timed out or was interrupted")})


def stale_uploads(videos: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """VA7: uploads that were never processed."""
    return videos.filter(F.col("status").isin("pending", "uploaded") & (F.col("created_at") < as_of - F.make_dt_interval(hours=F.lit(hours))))


def video_visibility(videos: DataFrame, role: str, viewer: int | None = None, status: str | None = None, featured: bool = False, search: str | None = None) -> DataFrame:
    """staff see all, users what is ready or their own, others what is ready."""
    ready = F.col("is_active") & (F.col("status") == "ready")
    seen = {"staff": F.lit(True), "user": ready | (F.col("uploaded_by") == F.lit(viewer)), "anonymous": ready}[role]
    out = videos.filter(seen)
    if status:
        out = out.filter(F.col("status") == status)
    if featured:
        out = out.filter("is_featured")
    if search:
        needle = search.lower()
        out = out.filter(F.lower("title").contains(needle) | F.lower("description").contains(needle))
    return out


def trending_videos(videos: DataFrame, views: DataFrame, as_of: Column, days: int = 7, limit: int = 10) -> DataFrame:
    """Visible videos by views of the last days."""
    recent = views.filter(F.col("started_at") >= as_of - F.make_dt_interval(days=F.lit(days)))
    counts = recent.groupBy(F.col("video_id").alias("id")).agg(F.count(F.lit(1)).alias("recent_views"))
    return video_visibility(videos, "anonymous").join(counts, "id").orderBy(F.desc("recent_views"), "id").limit(limit)


def featured_videos(videos: DataFrame) -> DataFrame:
    """R12."""
    return video_visibility(videos, "anonymous", featured=True)


def watch_history(videos: DataFrame, views: DataFrame, limit: int = 20) -> DataFrame:
    """R12 for every user: their last watched visible videos."""
    last = views.filter("user_id IS NOT NULL").groupBy("user_id", F.col("video_id").alias("id")).agg(F.max("started_at").alias("watched_at"))
    shown = last.join(video_visibility(videos, "anonymous").select("id", "title"), "id")
    return top_n(shown, ["user_id"], [F.desc("watched_at"), F.asc("id")], limit)
