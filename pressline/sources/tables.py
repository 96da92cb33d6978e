"""Reading and writing article tables and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressline.functions import text as tx
from pressline.operators import extract
from pressline.operators.joins import lookup_join


def scan_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """A table scan; filter and columns reach the Parquet reader."""
    table = spark.read.parquet(path)
    kept = table.filter(where) if where is not None else table
    return kept.select(*columns) if columns else kept


def articles_with_parents(articles: DataFrame, sources: DataFrame, categories: DataFrame, authors: DataFrame) -> DataFrame:
    """S1 with parents: articles with outlet, category and author names."""
    named = lookup_join(articles, sources, "source_id", {"name": "source_name", "is_active": "source_active"})
    named = lookup_join(named, categories, "category_id", {"name": "category_name"})
    return lookup_join(named, authors, "author_id", {"name": "author_name"})


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """S2 input: saved pages with ``page_id``, ``url`` and ``html``."""
    return spark.read.parquet(path).select("page_id", "url", "html")


# One story of the agency's JSON interface, and a reply with stories by number.
STORY = (
    "struct<iID: string, permalink: string, tTitle: string, tContents: string, tSummary: string, categories: array<struct<tName: string>>, "
    "submitter: struct<tFirstName: string, tLastName: string>, tAuthor: string, keywords: map<string, array<struct<tName: string>>>, "
    "imageUrl: string, sLive: string, sTime: string>"
)
REPLY = f"struct<results: map<string, {STORY}>>"
MIN_STORY_WORDS = 60


def read_story_api_json(replies: DataFrame, column: str, base_url: str, as_of: Column, zone: str = "Africa/Kampala") -> DataFrame:
    """S3: article rows from replies ``{"results": {"1": {...}, ...}}``; stories without
    id or link are left out."""
    stories = replies.select(F.from_json(column, REPLY).alias("r")).select(F.explode(F.map_values("r.results")).alias("s"))
    valid = stories.filter("coalesce(s.iID, '') <> '' AND coalesce(s.permalink, '') <> ''")
    parsed = valid.withColumn("content", extract.html_to_text(F.col("s.tContents")))
    summary = tx.squash(F.col("s.tSummary"))
    head = extract.cut_at_word(F.concat("content", F.lit(" ")), F.lit(260))
    cut = F.when(F.length("content") > 260, head).otherwise(F.concat(F.regexp_replace("content", r" [^ ]*$", ""), F.lit("...")))
    submitter = F.concat_ws(" ", F.nullif("s.submitter.tFirstName", F.lit("")), F.nullif("s.submitter.tLastName", F.lit("")))
    groups = F.coalesce(F.map_values("s.keywords"), F.array().cast("array<array<struct<tName: string>>>"))
    names = F.transform(F.flatten(groups), lambda k: F.trim(F.coalesce(k["tName"], F.lit(""))))
    counted = parsed.withColumn("word_count", tx.word_count(F.col("content")))
    return counted.select(
        F.col("s.iID").alias("external_id"), F.concat(F.lit(base_url), F.col("s.permalink")).alias("url"),
        F.coalesce(F.nullif(F.trim("s.tTitle"), F.lit("")), F.lit("Untitled story")).alias("title"), "content",
        F.when(summary != "", summary).when(F.col("content") != "", cut).otherwise("").alias("excerpt"),
        F.coalesce(F.get("s.categories", F.lit(0))["tName"], F.lit("News")).alias("category"),
        F.coalesce(F.nullif(F.trim(submitter), F.lit("")), F.trim("s.tAuthor"), F.lit("")).alias("author_name"),
        F.slice(F.array_distinct(F.filter(names, lambda n: n != "")), 1, 10).alias("tags"),
        F.coalesce("s.imageUrl", F.lit("")).alias("image_url"),
        extract.parse_published(F.coalesce("s.sLive", "s.sTime"), as_of, F.lit(zone)).alias("published_at"), "word_count",
        (F.col("word_count") >= MIN_STORY_WORDS).alias("has_full_content"),
    )


HEADLINE = (
    "post_id string, categories array<string>, tags array<string>, title string, url string, featured_image string, "
    "primary_category string, published_time string, author string, excerpt string, scraped_at string, source_website string"
)
LIST_COLUMNS = ("categories", "tags")
# Quotes are doubled, and blanks at the ends of a value belong to it.
CSV_FORM = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_headlines_json(spark: SparkSession, path: str) -> DataFrame:
    """Headline files with a JSON array of records."""
    return spark.read.schema(HEADLINE).json(path, multiLine=True)


def read_headlines_csv(spark: SparkSession, path: str) -> DataFrame:
    """The CSV form, whose lists are joined by commas."""
    flat = HEADLINE.replace("array<string>", "string")
    rows = spark.read.schema(flat).csv(path, header=True, multiLine=True, **CSV_FORM)
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumns({c: split(F.col(c)) for c in LIST_COLUMNS})


def flatten_lists(df: DataFrame) -> DataFrame:
    """Array columns as text joined by ', '."""
    arrays = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    return df.withColumns({name: F.array_join(name, ", ") for name in arrays}) if arrays else df


def write_csv_flattened(df: DataFrame, path: str) -> None:
    """S5."""
    flatten_lists(df).write.mode("overwrite").csv(path, header=True, **CSV_FORM)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record per line."""
    df.write.mode("overwrite").json(path)


def export_filtered(df: DataFrame, keyword: str, prefix: str) -> None:
    """S5/S6 for the articles that hold a keyword, in both forms."""
    from pressline.operators.feeds import filter_by_keyword

    name = keyword.replace(" ", "_")
    found = filter_by_keyword(df, keyword)
    write_json(found, f"{prefix}_{name}.json")
    write_csv_flattened(found, f"{prefix}_{name}.csv")
