"""Validation of model-written annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressline.functions import text as tx
from pressline.functions.binding import let
from pressline.operators.trends import cost_totals

# --- fixed values: allowed enumerations ---
THEMES = [
    "governance", "education", "health", "economy", "entertainment", "sports", "crime", "environment", "technology",
    "politics", "social", "business", "infrastructure", "agriculture", "tourism",
]
SENTIMENTS = ["positive", "negative", "neutral", "mixed"]
HIGHLIGHT_TYPES = ["fact", "figure", "claim", "link"]
REQUIRED = [
    ("summary", "str"), ("sentiment", "str"), ("importance_score", "int"), ("themes", "list"), ("key_facts", "list"), ("entities", "dict"),
]
_TEXTS = "array<string>"


def strip_code_fence(raw: Column) -> Column:
    """Drop a first line that opens a code fence and a last line that closes it."""
    bare = tx.strip(F.coalesce(raw, F.lit("")))
    lines = F.split(bare, "\n")
    inner = F.when(F.size(lines) > 1, F.slice(lines, F.lit(2), F.greatest(F.lit(0), F.size(lines) - 1))).otherwise(lines)
    closed = tx.strip(F.element_at(inner, -1)) == "```"
    body = F.when(closed, F.slice(inner, F.lit(1), F.size(inner) - 1)).otherwise(inner)
    return F.when(bare.startswith("```"), tx.strip(F.array_join(body, "\n"))).otherwise(bare)


def parse_model_json(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """V1: columns ``data`` (variant) and ``error``; exactly one of them is set."""
    cleaned = rows.withColumn("_json", strip_code_fence(F.col(raw)))
    parsed = cleaned.withColumn("data", F.try_parse_json("_json"))
    preview = F.replace(F.substring(F.col(raw), 1, 500), F.lit("\n"), F.lit(" "))
    blank = tx.strip(F.coalesce(F.col(raw), F.lit(""))) == ""
    error = (
        F.when(blank, "empty response: no JSON to parse")
        .when(F.col("data").isNull(), F.concat(F.lit("JSON parse failed; response starts: "), preview))
    )
    return parsed.withColumn("error", error).withColumn("data", F.when(F.col("error").isNull(), F.col("data"))).drop("_json")


def _at(data: Column, path: str) -> Column:
    return F.try_variant_get(data, path, "variant")


def _kind(value: Column) -> Column:
    """str, int, float, bool, list, dict or null for a variant; NULL when it is missing."""
    found = F.schema_of_variant(value)
    return (
        F.when(found == "STRING", "str").when(found == "BIGINT", "int").when(found.startswith("DECIMAL"), "float")
        .when(found.isin("DOUBLE", "FLOAT"), "float").when(found == "BOOLEAN", "bool").when(found.startswith("ARRAY"), "list")
        .when(found.startswith("OBJECT"), "dict").when(found.isNotNull(), "null")
    )


def _string(value: Column, path: str = "$") -> Column:
    return F.coalesce(F.try_variant_get(value, path, "string"), F.lit(""))


def _items(data: Column, path: str, limit: int) -> Column:
    """The first ``limit`` elements of a list, none when it is not a list."""
    listed = F.try_variant_get(data, path, "array<variant>")
    return F.slice(F.coalesce(listed, F.array().cast("array<variant>")), 1, limit)


def _clean_names(data: Column, path: str) -> Column:
    listed = F.coalesce(F.try_variant_get(data, path, _TEXTS), F.array().cast(_TEXTS))
    return F.filter(F.transform(listed, tx.strip), lambda n: F.coalesce(n, F.lit("")) != "")


def normalize_claims(data: Column, article_id: Column) -> Column:
    """V3: the first 12 claims without blank ones; confidence within 0..1, evidence to 500."""
    named = F.filter(_items(data, "$.claims", 12), lambda c: (_kind(c) == "dict") & (_string(c, "$.claim") != ""))
    number = lambda c: F.coalesce(F.try_variant_get(c, "$.confidence", "double"), F.lit(0.5))
    return F.transform(
        named,
        lambda c: F.struct(
            tx.strip(_string(c, "$.claim")).alias("claim"),
            F.coalesce(F.nullif(F.try_variant_get(c, "$.source_article_id", "bigint"), F.lit(0)), article_id).alias("source_article_id"),
            F.substring(tx.strip(_string(c, "$.evidence_text")), 1, 500).alias("evidence_text"),
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), number(c))).alias("confidence"),
        ),
    )


def normalize_highlights(data: Column) -> Column:
    """V4: the first 8 highlights with text and a known type; first of equal texts; url for links."""
    entries = F.transform(
        _items(data, "$.key_highlights", 8),
        lambda h: F.struct(
            tx.strip(_string(h, "$.text")).alias("text"), F.lower(tx.strip(_string(h, "$.type"))).alias("type"),
            tx.strip(_string(h, "$.url")).alias("url"),
        ),
    )
    valid = F.filter(entries, lambda h: (h["text"] != "") & h["type"].isin(HIGHLIGHT_TYPES))
    first = let(
        valid,
        lambda v: let(F.transform(v, lambda h: h["text"]), lambda t: F.filter(v, lambda h, i: F.array_position(t, h["text"]) == i + 1)),
    )
    is_link = lambda h: (h["type"] == "link") & h["url"].startswith("http")
    return F.transform(first, lambda h: F.struct(h["text"].alias("text"), h["type"].alias("type"), F.when(is_link(h), h["url"]).alias("url")))


def normalize_citations(data: Column, valid_ids: Column, own: Column | None = None) -> Column:
    """V5: the article itself first, then those of the first 20 citations whose id is known."""
    known = F.filter(
        _items(data, "$.citations", 20),
        lambda c: (_kind(c) == "dict") & F.coalesce(F.array_contains(valid_ids, F.try_variant_get(c, "$.article_id", "bigint")), F.lit(False)),
    )
    cited = F.transform(
        known,
        lambda c: F.struct(
            F.try_variant_get(c, "$.article_id", "bigint").alias("article_id"), tx.strip(_string(c, "$.url")).alias("url"),
            tx.strip(_string(c, "$.title")).alias("title"), tx.strip(_string(c, "$.source")).alias("source"),
            F.substring(tx.strip(_string(c, "$.evidence_text")), 1, 500).alias("evidence_text"),
        ),
    )
    return cited if own is None else F.concat(F.array(own), cited)


def validate_analysis(parsed: DataFrame) -> DataFrame:
    """V2: typed annotation columns from parsed answers, or the first error in ``error``.

    ``parsed`` carries ``article_id``, ``url``, ``title``, ``source_name``, ``data`` and
    ``error``. Lists are cut first and filtered afterwards, as in the reference.
    """
    data = F.col("data")
    error = F.col("error")
    for key, kind in REQUIRED:
        found = _kind(_at(data, f"$.{key}"))
        error = F.coalesce(
            error, F.when(found.isNull(), F.lit(f"missing required key: {key}")).when(found != kind, F.lit(f"key '{key}' must be {kind}"))
        )
    score = _kind(_at(data, "$.sentiment_score"))
    error = F.coalesce(error, F.when(~score.isin("int", "float", "null"), F.lit("sentiment_score must be numeric")))
    checked = parsed.withColumn("error", error).withColumn("data", F.when(F.col("error").isNull(), F.col("data")))
    themes = F.filter(F.transform(_items(data, "$.themes", 4), lambda t: _string(t)), lambda t: t.isin(THEMES))
    facts = F.filter(F.transform(_items(data, "$.key_facts", 6), lambda t: _string(t)), lambda t: tx.strip(t) != "")
    sentiment = _string(data, "$.sentiment")
    bounded = lambda value, low, high: F.greatest(F.lit(low), F.least(F.lit(high), value))
    own = F.struct(
        F.col("article_id").cast("bigint").alias("article_id"), F.col("url").alias("url"), F.col("title").alias("title"),
        F.coalesce("source_name", F.lit("")).alias("source"), F.lit(None).cast("string").alias("evidence_text"),
    )
    valid = F.col("error").isNull()
    columns = {
        "summary": _string(data, "$.summary"),
        "sentiment": F.when(sentiment.isin(SENTIMENTS), sentiment).otherwise("neutral"),
        "importance_score": bounded(F.try_variant_get(data, "$.importance_score", "int"), 1, 10),
        "sentiment_score": bounded(F.try_variant_get(data, "$.sentiment_score", "double"), -1.0, 1.0),
        "themes": themes,
        "key_facts": facts,
        "entities_people": _clean_names(data, "$.entities.people"),
        "entities_organizations": _clean_names(data, "$.entities.organizations"),
        "entities_locations": _clean_names(data, "$.entities.locations"),
        "claims": normalize_claims(data, F.col("article_id").cast("bigint")),
        "key_highlights": normalize_highlights(data),
        "citations": normalize_citations(data, F.array(F.col("article_id").cast("bigint")), own),
    }
    return checked.withColumns({name: F.when(valid, value) for name, value in columns.items()}).drop("data")


def claim_rows(validated: DataFrame) -> DataFrame:
    """V3 rows: one per claim.

    The outer form keeps Spark from copying the whole validation into a filter below.
    """
    rows = validated.select("article_id", F.posexplode_outer("claims").alias("pos", "c")).filter("pos IS NOT NULL")
    return rows.select("article_id", "pos", F.col("c.claim").alias("claim_text"), "c.confidence")


def validate_digest(digests: DataFrame) -> DataFrame:
    """V6: drop stories, threads and an under-radar story that cite unknown articles.

    ``digests`` carries ``data`` (variant) and ``valid_ids``, the at most 50 candidate
    ids of the digest, so the check is a local array lookup.
    """
    data, ids = F.col("data"), F.col("valid_ids")
    known = lambda v: F.coalesce(F.array_contains(ids, v), F.lit(False))
    story = "struct<article_id: bigint, headline: string, summary: string>"
    thread = "struct<title: string, article_ids: array<bigint>>"
    stories = F.coalesce(F.try_variant_get(data, "$.top_stories", f"array<{story}>"), F.array().cast(f"array<{story}>"))
    threads = F.coalesce(F.try_variant_get(data, "$.story_threads", f"array<{thread}>"), F.array().cast(f"array<{thread}>"))
    radar = F.try_variant_get(data, "$.under_radar_story", story)
    none = F.array().cast("array<bigint>")
    return digests.withColumns(
        {
            "top_stories": F.filter(stories, lambda s: known(s["article_id"])),
            "story_threads": F.filter(threads, lambda t: F.forall(F.coalesce(t["article_ids"], none), known)),
            "under_radar_story": F.when(known(radar["article_id"]), radar),
            "citations": normalize_citations(data, ids),
        }
    ).drop("data")


def enrichment_state(enrichments: DataFrame, outcomes: DataFrame) -> DataFrame:
    """V7: status after a run. ``outcomes``: ``(article_id, failure, message)``.

    A completed row stays; no failure completes; a ``data`` failure skips for good; any
    other failure marks for retry and counts.
    """
    joined = enrichments.select("article_id", "status", "retry_count").join(outcomes, "article_id")
    failed = F.col("failure").isNotNull() & (F.col("failure") != "data")
    kept = F.col("status") == "completed"
    status = F.when(kept | F.col("failure").isNull(), "completed").when(failed, "failed").otherwise("skipped")
    return joined.select(
        "article_id", status.alias("status"), (F.col("retry_count") + F.when(failed & ~kept, 1).otherwise(0)).alias("retry_count"),
        F.when(kept | F.col("failure").isNull(), "").otherwise(F.coalesce("message", F.lit(""))).alias("error_message"),
    )


def retry_list(enrichments: DataFrame, max_retries: int = 2) -> DataFrame:
    """V7: failed rows that may be tried again."""
    return enrichments.filter((F.col("status") == "failed") & (F.col("retry_count") < max_retries))


def pending_enrichment(articles: DataFrame, enrichments: DataFrame, batch: int = 50) -> DataFrame:
    """V8: the newest full articles that are neither done nor in work."""
    handled = enrichments.filter(F.col("status").isin("completed", "processing")).select(F.col("article_id").alias("id"))
    waiting = articles.filter("has_full_content").join(handled, "id", "left_anti")
    return waiting.orderBy(F.desc("scraped_at"), F.desc("id")).limit(batch)


def model_costs(enrichments: DataFrame) -> DataFrame:
    """V9: cost and tokens per model."""
    return cost_totals(enrichments, ["model_used"])


def summary_payload(articles: DataFrame, enrichments: DataFrame, sources: DataFrame) -> DataFrame:
    """What a reader gets for every article.

    completed with all fields, processing, excerpt_only (no full text), or to_do.
    """
    notes = enrichments.withColumnRenamed("article_id", "id")
    outlet = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    joined = articles.select("id", "title", "excerpt", "source_id", "published_at", "has_full_content").join(notes, "id", "left").join(outlet, "source_id", "left")
    state = (
        F.when(F.col("status") == "completed", "completed").when(F.col("status") == "processing", "processing")
        .when(~F.col("has_full_content"), "excerpt_only").otherwise("to_do")
    )
    done = F.col("state") == "completed"
    none = F.array().cast(_TEXTS)
    shown = lambda c: F.when(done, F.col(c))
    listed = lambda c: F.when(done, F.coalesce(c, none)).when(F.col("state") == "excerpt_only", none)
    return joined.withColumn("state", state).select(
        F.col("id").alias("article_id"), F.col("state").alias("status"), shown("title").alias("title"), shown("source").alias("source"),
        F.when(done, F.col("summary")).when(F.col("state") == "excerpt_only", F.coalesce("excerpt", F.lit(""))).alias("summary"),
        listed("key_facts").alias("key_facts"), listed("themes").alias("themes"), listed("related_themes").alias("story_arcs"),
        shown("sentiment").alias("sentiment"), shown("sentiment_score").alias("sentiment_score"), shown("importance_score").alias("importance_score"),
        F.when(done & (F.col("impact_note") != ""), F.col("impact_note")).alias("impact_note"), listed("bias_notes").alias("bias_notes"),
        F.when(F.col("state") == "processing", 8).alias("retry_after_seconds"),
    )
