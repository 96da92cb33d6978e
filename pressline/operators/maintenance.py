"""Upkeep of stored tables (M1-M4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressline.functions import text as tx
from pressline.functions.urls import identity_columns
from pressline.operators.extract import clean_cue_text
from pressline.sources.merge import rewrite_changed


def retain(table: DataFrame, ts: str, as_of: Column, days: int, only: Column | None = None) -> DataFrame:
    """M1: rows to keep: newer than ``days``, or outside the rows that may be dropped."""
    old = F.col(ts) < as_of - F.make_dt_interval(days=F.lit(days))
    doomed = old if only is None else old & only
    return table.filter(~F.coalesce(doomed, F.lit(False)))


def incomplete(articles: DataFrame, as_of: Column, older_than_hours: int = 0, source_id: int | None = None, limit: int | None = None) -> DataFrame:
    """M2: the incomplete articles an upkeep run would drop, oldest first when limited."""
    rows = articles.filter(~F.col("has_full_content"))
    if older_than_hours:
        rows = rows.filter(F.col("scraped_at") <= as_of - F.make_dt_interval(hours=F.lit(older_than_hours)))
    if source_id is not None:
        rows = rows.filter(F.col("source_id") == source_id)
    return rows.orderBy("scraped_at", "id").limit(limit) if limit else rows


def drop_incomplete(articles: DataFrame, as_of: Column, **options) -> DataFrame:
    """M2: the table without them."""
    return articles.join(incomplete(articles, as_of, **options).select("id"), "id", "left_anti")


def clean_corpus(articles: DataFrame) -> DataFrame:
    """M3: articles whose text changes when cleaned, with new hashes and counts."""
    changed = rewrite_changed(
        articles,
        {
            "title": tx.clean_text(F.col("title"), preserve_paragraphs=False),
            "excerpt": tx.clean_text(F.col("excerpt"), preserve_paragraphs=False),
            "content": tx.clean_text(F.col("content")),
        },
    )
    return with_text_facts(changed)


def strip_cues_corpus(articles: DataFrame, source_id: int) -> DataFrame:
    """M4: articles of a radio outlet whose body holds cue marks, cleaned."""
    own = articles.filter((F.col("source_id") == source_id) & (F.coalesce("content", F.lit("")) != ""))
    return with_text_facts(rewrite_changed(own, {"content": clean_cue_text(F.col("content"))}))


def with_text_facts(articles: DataFrame) -> DataFrame:
    """Counts and identity columns after a change of text."""
    counted = articles.withColumns(
        {"word_count": tx.word_count(F.col("content")), "paragraph_count": tx.paragraph_count(F.col("content"))}
    )
    return identity_columns(counted.withColumn("read_time_minutes", tx.read_minutes(F.col("word_count"))))
