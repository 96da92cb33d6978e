"""Registered queries for videos."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.functions.text import video_slug
from pressline.operators import trends, video
from pressline.plans.model import AS_OF_SQL
from pressline.plans.registry import query

MARKED = """marked AS (SELECT v.*, duration_seconds, CASE WHEN watch_seconds > 0 AND duration_seconds > 0 THEN least(100.0, watch_seconds / duration_seconds * 100) ELSE 0 END AS pct
  FROM video_views v JOIN videos d ON d.id = v.video_id)"""


def two(value):
    """Two places, halves up, on the decimal value as Spark rounds."""
    return f"CAST(round(CAST({value} AS DECIMAL(18, 8)), 2) AS DOUBLE)"


READY = "is_active AND status = 'ready'"


@query("va1_completion", f"WITH {MARKED} SELECT id, round(pct, 6) AS completion_pct, pct >= 90 AS is_completed FROM marked")
def _(m):
    rows = video.with_completion(m.video_views, m.videos)
    return rows.select("id", F.round("completion_pct", 6).alias("completion_pct"), "is_completed")


@query("va2_video_analytics", f"""
WITH {MARKED}, totals AS (SELECT video_id, count(*) AS n, count(DISTINCT user_id) AS users, sum(watch_seconds) AS watch, count(*) FILTER (WHERE pct >= 90) AS done,
    count(*) FILTER (WHERE watch_seconds >= duration_seconds * 0.25) AS engaged FROM marked GROUP BY 1),
dev AS (SELECT video_id, string_agg(device_type || ':' || n, ',' ORDER BY device_type) AS t FROM (SELECT video_id, device_type, count(*) AS n FROM marked GROUP BY 1, 2) GROUP BY 1),
qual AS (SELECT video_id, string_agg(q || ':' || n, ',' ORDER BY q) AS t FROM (SELECT video_id, coalesce(nullif(quality_watched, ''), 'unknown') AS q, count(*) AS n FROM marked GROUP BY 1, 2) GROUP BY 1)
SELECT v.id AS video_id, v.title, v.status, coalesce(n, 0) AS total_views, coalesce(users, 0) AS unique_users, CAST(coalesce(watch, 0) AS BIGINT) AS total_watch_seconds,
  {two('coalesce(watch / n, 0)')} AS average_watch_seconds, {two('coalesce(done * 100 / n, 0)')} AS completion_rate, {two('coalesce(engaged * 100 / n, 0)')} AS engagement_rate,
  coalesce(dev.t, '') AS devices, coalesce(qual.t, '') AS qualities FROM videos v LEFT JOIN totals t ON t.video_id = v.id LEFT JOIN dev ON dev.video_id = v.id LEFT JOIN qual ON qual.video_id = v.id""")
def _(m):
    rows = video.video_analytics(m.videos, m.video_views)
    shown = lambda c: F.coalesce(F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ","), F.lit(""))
    return rows.withColumns(
        {"devices": shown("device_breakdown"), "qualities": shown("quality_breakdown")}
    ).drop("device_breakdown", "quality_breakdown", "duration_seconds")


@query("va3_video_rollup", "SELECT video_id, count(*) AS view_count, CAST(sum(watch_seconds) AS BIGINT) AS total_watch_seconds FROM video_views GROUP BY 1")
def _(m):
    return video.video_rollup(m.video_views)


@query("va4_avg_engagement", f"WITH {MARKED} SELECT d.id AS video_id, round(coalesce(avg(pct), 0), 6) AS engagement FROM videos d LEFT JOIN marked m ON m.video_id = d.id GROUP BY 1")
def _(m):
    return video.avg_engagement(m.videos, m.video_views).withColumn("engagement", F.round("engagement", 6))


@query("va5_quality_distribution", f"""
SELECT video_id, q AS quality, n, {two('n * 100 / sum(n) OVER (PARTITION BY video_id)')} AS percentage
FROM (SELECT video_id, coalesce(nullif(quality_watched, ''), 'unknown') AS q, count(*) AS n FROM video_views GROUP BY 1, 2)""")
def _(m):
    return video.quality_distribution(m.video_views)


@query("va6_completion_rate", f"""
WITH {MARKED} SELECT d.id AS video_id, round(coalesce(count(*) FILTER (WHERE pct >= 90) * 100 / count(m.id), 0), 6) AS completion_rate FROM videos d LEFT JOIN marked m ON m.video_id = d.id GROUP BY 1""")
def _(m):
    return video.completion_rate(m.videos, m.video_views).withColumn("completion_rate", F.round("completion_rate", 6))


@query("va7_stale_tasks", f"SELECT id, 'failed' AS status, 'Task timed out or was interrupted' AS error_message FROM video_queue WHERE status = 'processing' AND queued_at < {AS_OF_SQL} - to_hours(2)")
def _(m):
    return video.stale_tasks(m.video_queue, m.as_of).select("id", "status", "error_message")


@query("va7_stale_uploads", f"SELECT id FROM videos WHERE status IN ('pending', 'uploaded') AND created_at < {AS_OF_SQL} - to_hours(24)")
def _(m):
    return video.stale_uploads(m.videos, m.as_of).select("id")


@query("f9_video_visibility", f"""
SELECT 'staff' AS role, id FROM videos UNION ALL SELECT 'user', id FROM videos WHERE ({READY}) OR uploaded_by = 3 UNION ALL SELECT 'anonymous', id FROM videos WHERE {READY}
UNION ALL SELECT 'search', id FROM videos WHERE {READY} AND is_featured AND (lower(title) LIKE '%video 1%' OR lower(description) LIKE '%video 1%')""")
def _(m):
    def of(label, **options):
        return video.video_visibility(m.videos, **options).select(F.lit(label).alias("role"), "id")

    return (
        of("staff", role="staff").unionByName(of("user", role="user", viewer=3)).unionByName(of("anonymous", role="anonymous"))
        .unionByName(of("search", role="anonymous", featured=True, search="Video 1"))
    )


@query("r12_trending_videos", f"""
SELECT v.id, count(*) AS recent_views FROM videos v JOIN video_views w ON w.video_id = v.id AND started_at >= {AS_OF_SQL} - to_days(7) WHERE {READY} GROUP BY v.id ORDER BY 2 DESC, 1 LIMIT 10""")
def _(m):
    return video.trending_videos(m.videos, m.video_views, m.as_of).select("id", "recent_views")


@query("r12_featured_videos", f"SELECT id FROM videos WHERE {READY} AND is_featured")
def _(m):
    return video.featured_videos(m.videos).select("id")


@query("r12_watch_history", f"""
WITH last AS (SELECT user_id, video_id AS id, max(started_at) AS watched_at FROM video_views WHERE user_id IS NOT NULL GROUP BY 1, 2)
SELECT user_id, id, watched_at, rank FROM (SELECT user_id, last.id, watched_at, row_number() OVER (PARTITION BY user_id ORDER BY watched_at DESC, last.id) AS rank FROM last JOIN videos v ON v.id = last.id WHERE {READY}) WHERE rank <= 20""")
def _(m):
    return video.watch_history(m.videos, m.video_views).select("user_id", "id", "watched_at", "rank")


@query("a20_video_totals", """
SELECT count(*) AS total_videos, count(*) FILTER (WHERE status = 'ready') AS ready_videos, count(*) FILTER (WHERE status = 'processing') AS processing_videos,
  count(*) FILTER (WHERE status = 'failed') AS failed_videos, CAST(sum(n) AS BIGINT) AS total_views, CAST(round(CAST(sum(w) / 3600 AS DECIMAL(18, 8)), 2) AS DOUBLE) AS total_watch_hours
FROM videos LEFT JOIN (SELECT video_id, count(*) AS n, sum(watch_seconds) AS w FROM video_views GROUP BY 1) r ON r.video_id = id""")
def _(m):
    return trends.video_totals(m.videos, video.video_rollup(m.video_views))


@query("t6_video_slug", "SELECT id, 'video-' || id || '-' || id AS slug FROM videos")
def _(m):
    return m.videos.select("id", video_slug(F.col("title"), F.col("id")).alias("slug"))
