"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressline.functions import text as tx

# --- fixed values: query parameters that never identify a page ---
TRACKING_PARAMETERS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid"]

# RFC 3986 appendix B, split into scheme, authority, path and query.
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_part(url: Column, part: str) -> Column:
    """One of scheme, host, path, query; '' when missing. Never fails on malformed input."""
    index = {"scheme": 1, "host": 2, "path": 3, "query": 4}[part]
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), f"(?s){_PARTS}", index)


def _decode(text: Column) -> Column:
    valid = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(valid)


def _encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _sorted_query(query: Column) -> Column:
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decode(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("k"),
            _decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~p["k"].isin(TRACKING_PARAMETERS))
    return F.array_join(
        F.transform(F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&"
    )


def normalize_url(url: Column, ignore_scheme: bool = False) -> Column:
    """One spelling per page.

    The scheme is kept, so http and https stay two pages unless ``ignore_scheme``.
    """
    bare = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(url_part(bare, "scheme"))
    scheme = F.lit("https") if ignore_scheme else F.when(scheme == "", F.lit("https")).otherwise(scheme)
    host = F.regexp_replace(F.lower(url_part(bare, "host")), r"^www\.", "")
    path = F.regexp_replace(url_part(bare, "path"), "/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    path = F.when((host != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    query = _sorted_query(url_part(bare, "query"))
    joined = F.concat(
        scheme, F.lit(":"),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit("//")),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )
    return F.when(bare == "", F.lit("")).otherwise(joined)


def path_segments(url: Column) -> Column:
    return F.filter(F.split(url_part(url, "path"), "/"), lambda p: p != "")


def identity_columns(articles: DataFrame) -> DataFrame:
    """canonical_url, title hash, content hash and published id on an article table."""
    body = F.when(F.coalesce(F.col("content"), F.lit("")) != "", F.col("content")).otherwise(F.col("excerpt"))
    external = tx.bounded_identifier(F.col("external_id"))
    published = external
    if "source_published_id" in articles.columns:
        given = tx.bounded_identifier(F.col("source_published_id"))
        published = F.when(given != "", given).otherwise(external)
    return articles.withColumns(
        {
            "canonical_url": normalize_url(F.col("url")),
            "normalized_title_hash": tx.hash_text(tx.normalize_title(F.col("title"))),
            "content_hash": tx.hash_text(body),
            "external_id": external,
            "source_published_id": published,
        }
    )


def resolve_url(href: Column, base_url: Column) -> Column:
    """An absolute URL for a link found on a page of ``base_url``."""
    link = F.trim(F.coalesce(href, F.lit("")))
    scheme = url_part(base_url, "scheme")
    scheme = F.when(scheme == "", F.lit("https")).otherwise(scheme)
    root = F.concat(scheme, F.lit("://"), url_part(base_url, "host"))
    folder = F.regexp_extract(url_part(base_url, "path"), "^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    bare_base = F.regexp_replace(base_url, r"[?#].*$", "")
    return (
        F.when(link == "", F.lit(""))
        .when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?") | link.startswith("#"), F.concat(bare_base, link))
        .otherwise(F.concat(root, folder, link))
    )


def external_id(url: Column, rule: Column) -> Column:
    """The stable id inside a URL, by the outlet's rule.

    Rules: ``trailing_digits`` (-123456), ``path_number`` (/123/), ``dated_slug``
    (/2024/01/02/slug), ``last_segment``, ``timestamp`` (-1700000000); every rule
    falls back to a SHA-1 prefix.
    """
    raw = F.coalesce(url, F.lit(""))
    hashed = F.substring(F.sha1(raw), 1, 16)
    hashed_canonical = F.substring(F.sha1(normalize_url(raw)), 1, 16)
    digits = F.regexp_extract(raw, r"-(\d{6,})/?$", 1)
    number = F.regexp_extract(raw, r"/(\d+)(?:/|$)", 1)
    dated = r"/(\d{4})/(\d{2})/(\d{2})/([^/]+)/?"
    slug_key = F.concat_ws("|", *[F.regexp_extract(raw, dated, i) for i in range(1, 5)])
    parts = path_segments(raw)
    last = F.when(F.size(parts) >= 2, F.substring(F.element_at(parts, -1), 1, 64)).otherwise(hashed)
    stamp = F.regexp_extract(url_part(raw, "path"), r"-(\d{10,})/?$", 1)
    return (
        F.when(rule == "trailing_digits", F.when(digits != "", digits).otherwise(hashed))
        .when(rule == "path_number", F.when(number != "", number).otherwise(hashed))
        .when(rule == "dated_slug", F.when(raw.rlike(dated), F.substring(F.sha1(slug_key), 1, 16)).otherwise(hashed_canonical))
        .when(rule == "timestamp", F.when(stamp != "", F.substring(stamp, 1, 64)).otherwise(last))
        .when(rule == "canonical_hash", hashed_canonical)
        .otherwise(last)
    )


def category_from_url(url: Column, segment: int = 1) -> Column:
    """X11: a path segment as a title; the nearest earlier one when it is missing."""
    parts = path_segments(url)
    name = F.lit("News")
    for position in range(max(1, segment - 1), segment + 1):
        name = F.when(F.size(parts) >= position, F.get(parts, F.lit(position - 1))).otherwise(name)
    return F.initcap(F.replace(name, F.lit("-"), F.lit(" ")))
