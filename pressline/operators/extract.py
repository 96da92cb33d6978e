"""Saved web pages to article rows.

One job serves every outlet: what differs between outlets is a row of a rules table.
Pages are parsed once into elements; all extraction is column expressions over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressline.functions import text as tx
from pressline.functions import urls
from pressline.functions.markup import page_elements

# --- fixed values: page structure known to hold article text, and phrases that do not ---
ARTICLE_TYPES = ["NewsArticle", "Article", "ReportageNewsArticle", "BlogPosting"]
PARAGRAPH_SCOPES = [
    [".entry-content"], [".td-post-content"], [".post-content"], [".article-content"], ["article"], ["main", "article"],
    [".story-body"], ["main"],
]
OUTSIDE_ARTICLE = ["nav", "footer", "aside", "header", "script", "style"]
BOILERPLATE = [
    "all rights reserved", "follow us on", "subscribe", "advertisement", "also read", "related stories", "you may also like",
    "privacy policy", "terms of use", "leave a reply", "your email address will not be published", "comment policy",
    "share this", "click here", "powered by", "this article", "email protected", "[email",
]
FAVICON_RELS = ["icon", "shortcut icon", "apple-touch-icon", "apple-touch-icon-precomposed", "mask-icon"]
MIN_FULL_CONTENT_WORDS = 80

RULE_SCHEMA = (
    "host string, scopes array<array<string>>, boilerplate array<string>, min_chars int, min_words int, id_rule string, "
    "category_segment int, zone string, prefer_body boolean, excerpt_length int"
)


def default_rule() -> dict[str, Column]:
    """The rule for hosts without one of their own."""
    return {
        "scopes": F.array(*[F.array(*[F.lit(x) for x in scope]) for scope in PARAGRAPH_SCOPES]),
        "boilerplate": F.array(*[F.lit(p) for p in BOILERPLATE]), "min_chars": F.lit(20), "min_words": F.lit(MIN_FULL_CONTENT_WORDS),
        "id_rule": F.lit("last_segment"), "category_segment": F.lit(1), "zone": F.lit("UTC"), "prefer_body": F.lit(False),
        "excerpt_length": F.lit(260),
    }


def with_rules(pages: DataFrame, rules: DataFrame | None) -> DataFrame:
    """Attach each page's rule by host; the rules table has one row per outlet."""
    host = F.regexp_replace(F.lower(urls.url_part(F.col("url"), "host")), r"^www\.", "")
    defaults = default_rule()
    if rules is None:
        ruled = pages.withColumns(defaults)
    else:
        joined = pages.withColumn("_host", host).join(rules.withColumnRenamed("host", "_host"), "_host", "left")
        ruled = joined.withColumns({name: F.coalesce(name, value) for name, value in defaults.items()}).drop("_host")
    return ruled.withColumn("furniture", phrase_pattern(F.col("boilerplate")))


def phrase_pattern(phrases: Column) -> Column:
    """One regular expression that finds any of the phrases, in any case."""
    quoted = F.transform(phrases, lambda p: F.concat(F.lit(r"\Q"), p, F.lit(r"\E")))
    return F.when(F.size(phrases) > 0, F.concat(F.lit("(?i)"), F.array_join(quoted, "|"))).otherwise("(?!)")


# --- JSON-LD ---------------------------------------------------------------------------

_FIELDS = (
    "`@type`: variant, headline: string, name: string, url: string, articleBody: string, datePublished: string, "
    "author: variant, image: variant, keywords: variant, itemListElement: variant"
)
GRAPH_DEPTH = 8  # graphs inside graphs that are followed


def _node_type(depth: int) -> str:
    return f"struct<{_FIELDS}>" if depth == 0 else f"struct<{_FIELDS}, `@graph`: array<{_node_type(depth - 1)}>>"


_NAMES = ["@type", "headline", "name", "url", "articleBody", "datePublished", "author", "image", "keywords", "itemListElement"]


def _leaf(node: Column) -> Column:
    return F.struct(*[node[n].alias(n) for n in _NAMES])


def _graph_members(nodes: str, depth: int) -> Column:
    none = F.array().cast(f"array<{_node_type(depth)}>")
    return F.flatten(F.transform(nodes, lambda n: F.coalesce(n["@graph"], none)))


def jsonld_nodes(page: DataFrame) -> DataFrame:
    """Column ``nodes`` with all JSON-LD objects: top-level ones, then ``@graph`` members.

    Lists are flattened; graphs inside graphs are followed ``GRAPH_DEPTH`` levels, the nearer first.
    """
    scripts = F.filter("page.scripts", lambda e: e["attrs"]["type"] == "application/ld+json")
    kind = f"array<{_node_type(GRAPH_DEPTH)}>"
    parsed = F.flatten(F.transform(scripts, lambda e: F.coalesce(F.from_json(e["text"], kind), F.array().cast(kind))))
    levels = page.withColumn("_level0", F.filter(parsed, lambda n: n.isNotNull()))
    for depth in range(1, GRAPH_DEPTH + 1):
        levels = levels.withColumn(f"_level{depth}", _graph_members(f"_level{depth - 1}", GRAPH_DEPTH - depth))
    names = [f"_level{depth}" for depth in range(GRAPH_DEPTH + 1)]
    return levels.withColumn("nodes", F.concat(*[F.transform(name, _leaf) for name in names])).drop(*names)


def _types(node: Column) -> Column:
    single = F.try_variant_get(node["@type"], "$", "string")
    return F.coalesce(F.try_variant_get(node["@type"], "$", "array<string>"), F.array(single))


def jsonld_article(nodes: Column, prefer_body: Column) -> Column:
    """The first article node; with ``prefer_body`` the first that has a body."""
    wanted = F.array(*[F.lit(t) for t in ARTICLE_TYPES])
    articles = F.filter(nodes, lambda n: F.coalesce(F.arrays_overlap(_types(n), wanted), F.lit(False)))
    with_body = F.filter(articles, lambda n: F.coalesce(n["articleBody"], F.lit("")) != "")
    return F.when(prefer_body & (F.size(with_body) > 0), F.get(with_body, F.lit(0))).otherwise(F.get(articles, F.lit(0)))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _as_string(value: Column, path: str = "$") -> Column:
    """The value at ``path`` when it is a plain string."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(_kind(found) == "STRING", F.try_variant_get(found, "$", "string"))


def _first_text(*candidates: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))


# --- DOM fields ------------------------------------------------------------------------


def _first(elements: Column, test, value) -> Column:
    """``value`` of the first element that passes, '' when there is none."""
    return F.coalesce(value(F.get(F.filter(elements, test), F.lit(0))), F.lit(""))


def _attr(name: str):
    return lambda e: e["attrs"][name]


def _text(e: Column) -> Column:
    return e["text"]


def _meta(page: Column, *names: str) -> Column:
    """The content of the first named meta element that has any."""
    def named(name):
        return lambda e: F.coalesce(e["attrs"]["property"], e["attrs"]["name"], F.lit("")) == name

    return _first_text(*[tx.squash(_first(page["metas"], named(name), _attr("content"))) for name in names])


def _class_contains(e: Column, part: str) -> Column:
    return F.lower(F.coalesce(e["attrs"]["class"], F.lit(""))).contains(part)


def extract_title(node: Column, page: Column) -> Column:
    """JSON-LD headline, else the first ``h1``."""
    return _first_text(tx.squash(node["headline"]), _first(page["others"], lambda e: e["tag"] == "h1", _text))


def is_boilerplate(text: Column, furniture: Column, min_chars: Column) -> Column:
    """Too short, or holds a phrase of the outlet's furniture (a :func:`phrase_pattern`)."""
    return (F.length(text) < min_chars) | F.rlike(text, furniture)


def body_paragraphs_from_text(body: Column, furniture: Column, min_chars: Column) -> Column:
    """Split on blank lines, else where a sentence ends before a capital."""
    flat = F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"\r\n|\r", "\n"))
    blocks = F.filter(F.split(flat, r"\n\s*\n+"), lambda p: tx.strip(p) != "")
    sentences = F.filter(F.split(flat, r"(?<=[.!?])\s+(?=[A-Z])"), lambda p: tx.strip(p) != "")
    parts = F.transform(F.when(F.size(blocks) > 1, blocks).otherwise(sentences), tx.squash)
    return F.filter(parts, lambda p: (p != "") & ~is_boilerplate(p, furniture, min_chars))


def _within(inside: Column, scope: Column) -> Column:
    """True when all labels of ``scope`` occur among the ancestors, in order."""
    reached = F.aggregate(inside, F.lit(0), lambda n, label: F.when(F.get(scope, n) == label, n + 1).otherwise(n))
    return reached >= F.size(scope)


def _total_words(paragraphs: Column) -> Column:
    """Words of cleaned paragraphs, whose words are one blank apart."""
    counts = F.transform(paragraphs, lambda p: F.size(F.split(p, " ")))
    return F.aggregate(counts, F.lit(0), lambda total, n: total + n)


def body_paragraphs_from_html(page: DataFrame, out: str = "from_html") -> DataFrame:
    """Column of the paragraphs of the scope with most words, distinct, in order.

    Every paragraph is cleaned and tested against the scopes once; the scopes are then
    compared by their word totals, and the first of equal ones wins.
    """
    outside = F.array(*[F.lit(t) for t in OUTSIDE_ARTICLE])
    bad = lambda e: F.arrays_overlap(e["inside"], outside) | is_boilerplate(e["text"], F.col("furniture"), F.col("min_chars"))
    kept = F.filter("page.paragraphs", lambda e: ~bad(e))
    marked = F.transform(
        kept,
        lambda e: F.struct(
            e["text"].alias("text"), F.size(F.split(e["text"], " ")).alias("n"),
            F.transform("scopes", lambda scope: _within(e["inside"], scope)).alias("hits"),
        ),
    )

    def total(_, at):
        words = F.transform("_marked", lambda e: F.when(F.get(e["hits"], at), e["n"]).otherwise(0))
        return F.aggregate(words, F.lit(0), lambda acc, n: acc + n)

    totals = page.withColumn("_marked", marked).withColumn("_totals", F.transform("scopes", total))
    at = F.array_position("_totals", F.array_max("_totals")).cast("int") - 1
    chosen = totals.withColumn("_at", at)
    body = F.transform(F.filter("_marked", lambda e: F.get(e["hits"], F.col("_at"))), lambda e: e["text"])
    return chosen.withColumn(out, F.array_distinct(body)).drop("_marked", "_totals", "_at")


# --- fixed values: date spellings tried in this order ---
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "MMMM d, yyyy h:mm a", "MMMM d, yyyy HH:mm",
    "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "d MMMM yyyy HH:mm", "d MMM yyyy HH:mm",
]


def parse_published(text: Column, as_of: Column, zone: Column) -> Column:
    """Relative ('3 hours ago'), 'yesterday', ISO and written-out dates; UTC out.

    Times without an offset are read in ``zone``.
    """
    value = tx.squash(text)
    lower = F.lower(value)
    relative = r"(\d+)\s*(min|minute|hour|day)s?\s+ago"
    amount = F.try_to_number(F.nullif(F.regexp_extract(lower, relative, 1), F.lit("")), F.lit("999999")).cast("int")
    unit = F.regexp_extract(lower, relative, 2)
    since = (
        F.when(unit.startswith("min"), as_of - F.make_dt_interval(mins=amount))
        .when(unit == "hour", as_of - F.make_dt_interval(hours=amount))
        .when(unit == "day", as_of - F.make_dt_interval(days=amount))
    )
    has_offset = value.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]")
    absolute = F.try_to_timestamp(F.when(has_offset, value))
    iso_local = F.try_to_timestamp(F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}T") & ~has_offset, value))
    bare = F.regexp_replace(lower, r"^(?:mon|tues|wednes|thurs|fri|satur|sun)day,?\s+", "")
    cased = F.initcap(F.regexp_replace(bare, r"(?<=\d)(st|nd|rd|th)\b", ""))
    cased = F.regexp_replace(F.regexp_replace(cased, "Am$", "AM"), "Pm$", "PM")
    local = F.coalesce(iso_local, *[F.try_to_timestamp(cased, F.lit(fmt)) for fmt in DATE_FORMATS])
    yesterday = F.when(lower.isin("yesterday", "yesterday listen"), as_of - F.expr("INTERVAL 1 DAY"))
    return F.coalesce(since, yesterday, absolute, F.to_utc_timestamp(local, zone))


def cut_at_word(text: Column, limit: Column) -> Column:
    """The text, or its head up to the last blank before ``limit`` plus '...'."""
    head = F.substring(text, F.lit(1), limit)
    whole_words = F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.when(head.contains(" "), whole_words).otherwise(head), F.lit("..."))
    )


def make_excerpt(described: Column, paragraphs: Column, limit: Column) -> Column:
    """The page's description, else its first paragraph cut at a word."""
    first = F.coalesce(F.get(paragraphs, F.lit(0)), F.lit(""))
    return F.when(described != "", described).otherwise(cut_at_word(first, limit))


def packed_excerpt(paragraphs: Column, limit: int = 200) -> Column:
    """X9, sentence form: whole sentences while they fit, then part of one if there is room.

    A sentence that does not fit ends its paragraph; the next paragraph may still add
    shorter ones while the text stays under ``limit``.
    """
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"))

    def add_paragraph(acc, paragraph):
        sentences = F.filter(F.transform(F.split(paragraph, r"[.!?]+"), tx.strip), lambda s: s != "")
        opened = F.struct(acc["out"].alias("out"), acc["n"].alias("n"), (acc["n"] >= limit).alias("full"))

        def add_sentence(state, sentence):
            longer = state["n"] + F.length(sentence) > limit
            part = F.concat(F.substring(sentence, F.lit(1), F.lit(limit) - state["n"]), F.lit("..."))
            room = state["n"] < limit * 0.7
            cut = F.when(room, F.concat(state["out"], F.array(part))).otherwise(state["out"])
            grown = state["n"] + F.length(sentence)
            return (
                F.when(state["full"], state)
                .when(longer, F.struct(cut.alias("out"), state["n"].alias("n"), F.lit(True).alias("full")))
                .otherwise(F.struct(F.concat(state["out"], F.array(sentence)).alias("out"), grown.alias("n"), (grown >= limit).alias("full")))
            )

        return F.aggregate(sentences, opened, add_sentence, lambda s: F.struct(s["out"].alias("out"), s["n"].alias("n")))

    out = F.aggregate(paragraphs, start, add_paragraph)["out"]
    return F.when(F.size(out) > 0, F.concat(F.array_join(out, ". "), F.lit("."))).otherwise("")


def linked_category(page: Column) -> Column:
    """The section named by the page's meta element or category links."""
    def is_section(e):
        rel = F.coalesce(e["attrs"]["rel"], F.lit("")) == "category tag"
        return rel | F.arrays_overlap(e["inside"], F.array(F.lit(".cat-links"), F.lit(".entry-category")))

    return _first_text(_meta(page, "article:section"), _first(page["anchors"], is_section, _text))


def category(named: Column, url: Column, segment: Column) -> Column:
    """X11: the named section unless it is the home page, else a path segment."""
    from_url = F.when(segment == 3, urls.category_from_url(url, 3)).otherwise(urls.category_from_url(url, 1))
    return F.when((named != "") & (F.lower(named) != "home"), named).otherwise(from_url)


def author_from_node(node: Column) -> Column:
    """The author as a string, an object or a list of either."""
    author = node["author"]
    name = F.coalesce(
        _as_string(author), _as_string(author, "$.name"), _as_string(author, "$[0].name"), _as_string(author, "$[0]")
    )
    return without_byline(name)


def without_byline(name: Column) -> Column:
    return tx.squash(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)^By\s+", ""))


def author(node: Column, page: Column) -> Column:
    def is_author(e):
        return (F.coalesce(e["attrs"]["rel"], F.lit("")) == "author") | F.exists(e["inside"], lambda x: x.contains("author"))

    return _first_text(author_from_node(node), without_byline(_first(page["anchors"], is_author, _text)))


def image_from_node(node: Column) -> Column:
    """The image as a string, an object or a list of either."""
    image = node["image"]
    return F.coalesce(
        _as_string(image), _as_string(image, "$.url"), _as_string(image, "$[0].url"), _as_string(image, "$[0]"), F.lit("")
    )


def image_link(node: Column, page: Column) -> Column:
    """The article's image as written on the page."""
    shown = _first(
        page["others"],
        lambda e: (e["tag"] == "img") & (F.array_contains(e["inside"], "figure") | _class_contains(e, "wp-post-image")),
        lambda e: F.coalesce(e["attrs"]["src"], e["attrs"]["data-src"]),
    )
    return _first_text(image_from_node(node), shown, _meta(page, "og:image", "twitter:image"))


def tags(node: Column, page: Column, limit: int | None = None) -> Column:
    """Keywords as a string or a list, else tag links; distinct, in order."""
    keywords = node["keywords"]
    listed = F.coalesce(
        F.split(_as_string(keywords), r"[,;]"), F.try_variant_get(keywords, "$", "array<string>"), F.array().cast("array<string>")
    )
    boxes = F.array(F.lit(".tags-links"), F.lit(".post-tags"), F.lit(".entry-tags"))
    is_tag = lambda e: (F.coalesce(e["attrs"]["rel"], F.lit("")) == "tag") | F.arrays_overlap(e["inside"], boxes)
    links = F.transform(F.filter(page["anchors"], is_tag), _text)
    clean = lambda values: F.array_distinct(F.filter(F.transform(values, tx.squash), lambda t: t != ""))
    chosen = F.when(F.size(clean(listed)) > 0, clean(listed)).otherwise(clean(links))
    return F.slice(chosen, 1, limit) if limit else chosen


def published_text(node: Column, page: Column) -> Column:
    stamped = _first(page["others"], lambda e: (e["tag"] == "time") & e["attrs"]["datetime"].isNotNull(), _attr("datetime"))
    dated = _first(page["others"], lambda e: _class_contains(e, "date"), lambda e: F.coalesce(e["attrs"]["datetime"], e["text"]))
    return _first_text(tx.squash(node["datePublished"]), _meta(page, "article:published_time"), tx.squash(stamped), tx.squash(dated))


def parsed_pages(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Pages with their elements (``page``), JSON-LD ``nodes``, article ``node`` and rule."""
    parsed = with_rules(pages, rules).withColumn("page", page_elements(F.col("html"))).drop("html")
    return jsonld_nodes(parsed).withColumn("node", jsonld_article(F.col("nodes"), F.col("prefer_body")))


def extract_articles(pages: DataFrame, rules: DataFrame | None, as_of: Column) -> DataFrame:
    """``(page_id, url, html)`` to article rows, all outlets in one job."""
    node, page, url = F.col("node"), F.col("page"), F.col("url")
    from_body = body_paragraphs_from_text(node["articleBody"], F.col("furniture"), F.col("min_chars"))
    bodies = body_paragraphs_from_html(parsed_pages(pages, rules)).withColumn("from_body", from_body)
    enough = _total_words(F.col("from_body")) >= F.col("min_words")
    body = bodies.withColumn("paragraphs", F.when(enough, F.col("from_body")).otherwise(F.col("from_html")))
    # Fields that later expressions use several times get their own projection.
    found = body.withColumns(
        {
            "described": _meta(page, "og:description", "description"), "image_link": image_link(node, page),
            "published_time_str": published_text(node, page), "linked_category": linked_category(page),
        }
    )
    filled = found.withColumns(
        {
            "title": extract_title(node, page), "content": F.array_join("paragraphs", "\n\n"),
            "paragraph_count": F.size("paragraphs"), "word_count": _total_words(F.col("paragraphs")),
            "excerpt": make_excerpt(F.col("described"), F.col("paragraphs"), F.col("excerpt_length")),
            "author_name": author(node, page), "image_url": urls.resolve_url(F.col("image_link"), url), "tags": tags(node, page),
            "category": category(F.col("linked_category"), url, F.col("category_segment")), "external_id": urls.external_id(url, F.col("id_rule")),
        }
    )
    gated = full_content_gate(filled.withColumn("published_at", parse_published(F.col("published_time_str"), as_of, F.col("zone"))))
    return gated.select(
        "page_id", "url", "external_id", "title", "excerpt", "content", "word_count", "paragraph_count", "author_name", "image_url",
        "tags", "category", "published_time_str", "published_at", "has_full_content", "scrape_status",
    )


def full_content_gate(articles: DataFrame) -> DataFrame:
    """Complete when the body reaches the outlet's word count."""
    full = F.col("word_count") >= F.col("min_words")
    return articles.withColumns(
        {"has_full_content": full, "scrape_status": F.when(full, "complete").otherwise("partial")}
    )


def listing_links(pages: DataFrame, article_path: str, min_title: int = 8) -> DataFrame:
    """Article links of listing pages, first mention per page and URL.

    Sources in order: JSON-LD item lists, anchors inside cards, then all other anchors.
    A title shorter than ``min_title`` drops a link unless it comes from an item list.
    """
    page = parsed_pages(pages)
    items = F.flatten(
        F.transform(
            F.col("nodes"),
            lambda n: F.coalesce(
                F.try_variant_get(n["itemListElement"], "$", "array<struct<url string, name string, headline string, item struct<url string, name string, headline string>>>"),
                F.array().cast("array<struct<url string, name string, headline string, item struct<url string, name string, headline string>>>"),
            ),
        )
    )

    def link(rank, href, title):
        return F.struct(F.lit(rank).alias("origin"), href.alias("href"), tx.squash(title).alias("title"))

    listed = F.transform(items, lambda i: link(0, F.coalesce(i["item"]["url"], i["url"]), _first_text(i["item"]["name"], i["item"]["headline"], i["name"], i["headline"])))
    anchors = F.filter("page.anchors", lambda e: F.coalesce(e["attrs"]["href"], F.lit("")) != "")
    cards = F.array(*[F.lit(c) for c in ("article", ".post", ".td-module-container", ".td_module_flex", ".item-details", ".blog-item")])
    linked = F.transform(
        anchors, lambda e: link(1, e["attrs"]["href"], e["text"]).withField("origin", F.when(F.arrays_overlap(e["inside"], cards), 1).otherwise(2))
    )
    rows = page.select("page_id", "url", F.posexplode(F.concat(listed, linked)).alias("pos", "l"))
    resolved = rows.select("page_id", "pos", "l.origin", "l.title", F.col("url").alias("page_url"), urls.resolve_url(F.col("l.href"), F.col("url")).alias("url"))
    same_host = urls.url_part(F.col("url"), "host") == urls.url_part(F.col("page_url"), "host")
    kept = resolved.filter(same_host & urls.url_part(F.col("url"), "path").rlike(article_path)).filter(
        (F.col("origin") == 0) | (F.length("title") >= min_title)
    )
    first = F.min(F.struct("origin", "pos", "title")).alias("f")
    return kept.groupBy("page_id", "url").agg(first).select("page_id", "url", "f.title", "f.origin")


_STRAY_TAG = r"(?i)</?\s*(br|p|div|span)\s*/?>"


def strip_cues(text: Column) -> Column:
    """Drop radio cue blocks between double slashes and 'Cue in/out:' lines."""
    blocks = F.regexp_replace(text, r"(?s)//.*?//", " ")
    return F.regexp_replace(blocks, r"(?im)^\s*cue\s*(in|out)\s*[:\-].*$", " ")


def _paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\n\s*\n"), tx.squash)
    single = F.array(tx.squash(F.regexp_replace(text, r"\s*\n\s*", " ")))
    chosen = F.when(F.size(parts) <= 1, single).otherwise(parts)
    return F.array_join(F.filter(chosen, lambda p: F.length(p) > 2), "\n\n")


def html_to_text(markup: Column) -> Column:
    """A markup fragment as paragraphs of plain text, without radio cues."""
    plain = tx.unescape_html(F.coalesce(markup, F.lit("")))
    bare = F.regexp_replace(plain, r"(?is)<(script|style|template)\b.*?</\1\s*>|<!--.*?-->", "\x01")
    pieces = F.filter(F.transform(F.split(F.regexp_replace(bare, r"(?s)<[a-zA-Z/!][^>]*>", "\x01"), "\x01+"), tx.strip), lambda s: s != "")
    text = F.replace(F.array_join(pieces, "\n"), F.lit(" "), F.lit(" "))
    return _paragraphs(strip_cues(F.regexp_replace(text, _STRAY_TAG, "\n")))


def clean_cue_text(text: Column) -> Column:
    """M4: the same cleaning for stored text, where blank lines already mark paragraphs."""
    plain = F.replace(tx.unescape_html(F.coalesce(text, F.lit(""))), F.lit(" "), F.lit(" "))
    bare = strip_cues(F.regexp_replace(plain, _STRAY_TAG, "\n"))
    parts = F.transform(F.split(bare, r"\n\s*\n"), tx.squash)
    return F.array_join(F.filter(parts, lambda p: F.length(p) > 2), "\n\n")


def favicon_candidates(pages: DataFrame) -> DataFrame:
    """Icon links of a page by kind and order, then the site's default icon."""
    root = F.concat(F.coalesce(F.nullif(urls.url_part(F.col("url"), "scheme"), F.lit("")), F.lit("https")), F.lit("://"), urls.url_part(F.col("url"), "host"), F.lit("/"))
    page = pages.select("page_id", root.alias("root"), page_elements(F.col("html")).alias("page"))

    def of(rel):
        def test(e):
            rels = F.lower(F.regexp_replace(F.coalesce(e["attrs"]["rel"], F.lit("")), r"\s+", " "))
            href = F.trim(F.coalesce(e["attrs"]["href"], F.lit("")))
            return (e["tag"] == "link") & rels.contains(rel) & (href != "") & ~href.startswith("data:")

        return F.transform(F.filter("page.others", test), lambda e: urls.resolve_url(e["attrs"]["href"], F.col("root")))

    found = F.concat(*[of(rel) for rel in FAVICON_RELS], F.array(F.concat("root", F.lit("favicon.ico"))))
    return page.select("page_id", F.posexplode(F.array_distinct(found)).alias("priority", "icon_url"))
