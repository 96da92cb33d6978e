"""Page extraction on hand-made pages."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pressline.functions.markup import _Elements
from pressline.operators import extract

AS_OF = datetime(2024, 1, 31, 12, 0)
LONG = "This sentence is long enough to count as a paragraph of the article body."
PAGE = f"""<html><head><title>T</title><meta property="og:description" content="About &amp; more">
<meta property="article:section" content="World News"><meta property="article:published_time" content="2024-01-05T08:00:00+03:00">
<script type="application/ld+json">{{bad json</script>
<script type="application/ld+json">{{"@graph":[{{"@type":"WebSite"}},{{"@type":["Thing","NewsArticle"],"headline":" The  headline ",
"author":[{{"name":"By Ann Bee","url":"/ann"}}],"image":{{"url":"/i.jpg"}},"keywords":"a, b; a"}}]}}</script></head>
<body><nav><p>{LONG} in the menu</p></nav><main><article class="entry-content"><h1>Other</h1><p>{LONG}</p><p>short</p><p>{LONG}</p>
<p>Please subscribe to this newsletter right now</p><p>{LONG} Two</p></article></main><footer><p>{LONG} footer</p></footer></body></html>"""


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id bigint, url string, html string")


def test_article_fields(spark):
    row = extract.extract_articles(pages(spark, (1, "https://www.x.example/world/my-story-1234567", PAGE)), None, F.lit(AS_OF)).first()
    assert row.title == "The headline"
    assert row.author_name == "Ann Bee"
    assert row.image_url == "https://www.x.example/i.jpg"
    assert row.tags == ["a", "b"]
    assert row.category == "World News"
    assert row.excerpt == "About & more"
    assert row.published_at == datetime(2024, 1, 5, 5, 0)
    assert row.external_id == "my-story-1234567"
    assert row.content == f"{LONG}\n\n{LONG} Two"
    assert (row.paragraph_count, row.has_full_content, row.scrape_status) == (2, False, "partial")


def test_rules_by_host(spark):
    rules = spark.createDataFrame(
        [("x.example", None, None, None, 5, "trailing_digits", 1, "UTC", True, 30)], extract.RULE_SCHEMA
    )
    row = extract.extract_articles(pages(spark, (1, "https://www.x.example/world/my-story-1234567", PAGE)), rules, F.lit(AS_OF)).first()
    assert (row.external_id, row.has_full_content) == ("1234567", True)


def test_body_from_structured_data(spark):
    body = " ".join(f"Sentence number {i} has some more words in it." for i in range(20))
    page = f'<script type="application/ld+json">[{{"@type":"Article","headline":"h","articleBody":"{body}"}}]</script><p>{LONG}</p>'
    row = extract.extract_articles(pages(spark, (1, "https://x.example/a/b", page)), None, F.lit(AS_OF)).first()
    assert row.paragraph_count == 20 and row.has_full_content


def test_prefers_node_with_body(spark):
    page = (
        '<script type="application/ld+json">[{"@type":"Article","headline":"first"},{"@type":"BlogPosting","headline":"second","articleBody":"x"}]</script>'
    )
    parsed = extract.jsonld_nodes(extract.with_rules(pages(spark, (1, "u", page)), None).withColumn("page", extract.page_elements(F.col("html"))))
    first = parsed.select(extract.jsonld_article(F.col("nodes"), F.lit(False))["headline"], extract.jsonld_article(F.col("nodes"), F.lit(True))["headline"]).first()
    assert tuple(first) == ("first", "second")


def brute_paragraphs(html, scopes, phrases, min_chars):
    """Paragraph choice written out for one page."""
    reader = _Elements()
    reader.feed(html)
    reader.close()
    best, best_words = [], 0
    paragraphs = reader.page()["paragraphs"]
    for scope in scopes:
        found = []
        for p in paragraphs:
            labels = iter(p["inside"])
            if not all(any(label == wanted for label in labels) for wanted in scope):
                continue
            if set(p["inside"]) & set(extract.OUTSIDE_ARTICLE):
                continue
            if len(p["text"]) < min_chars or any(x in p["text"].lower() for x in phrases):
                continue
            found.append(p["text"])
        if sum(len(p.split()) for p in found) > best_words:
            best, best_words = found, sum(len(p.split()) for p in found)
    return list(dict.fromkeys(best))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_paragraphs_of_the_given_pages(spark):
    raw = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    page = extract.with_rules(raw, None).withColumn("page", extract.page_elements(F.col("html")))
    found = extract.body_paragraphs_from_html(page).select("html", "from_html").collect()
    assert any(row.from_html for row in found)
    for row in found:
        assert row.from_html == brute_paragraphs(row.html, extract.PARAGRAPH_SCOPES, extract.BOILERPLATE, 20)


def test_listing_links(spark):
    listing = (
        '<script type="application/ld+json">{"itemListElement":[{"item":{"url":"/news/from-the-list","name":"L"}}]}</script>'
        '<a href="/news/plain-anchor">A long enough title</a><article><h2><a href="/news/in-a-card">Title of a card</a></h2></article>'
        '<a href="/news/in-a-card">Another mention of it</a><a href="/news/too-short-title">Short</a><a href="https://else.example/news/other-host">Other host title</a>'
    )
    rows = extract.listing_links(pages(spark, (1, "https://x.example/news", listing)), r"^/news/[a-z-]{8,}$").collect()
    assert {(r.url.rsplit("/", 1)[1], r.title, r.origin) for r in rows} == {
        ("from-the-list", "L", 0), ("in-a-card", "Title of a card", 1), ("plain-anchor", "A long enough title", 2),
    }


def test_html_to_text_drops_cues(spark):
    markup = "&lt;p&gt;One&lt;/p&gt; //Cue in : 'they are\n suffering'// <p>Two &amp; three</p>\nCue out: gone\nfour"
    df = spark.createDataFrame([(markup,)], "v string")
    assert df.select(extract.html_to_text(F.col("v"))).first()[0] == "One\n\nTwo & three\n\nfour"


def test_favicons(spark):
    page = '<link rel="apple-touch-icon" href="/t.png"><link rel="Shortcut Icon" href="//c.example/s.ico"><link rel="icon" href="data:x">'
    rows = extract.favicon_candidates(pages(spark, (1, "https://x.example/a", page))).orderBy("priority").collect()
    assert [r.icon_url for r in rows] == ["https://x.example/t.png", "https://c.example/s.ico", "https://x.example/favicon.ico"]  # every kind holds "icon"


def test_graphs_inside_graphs(spark):
    inner = '{"@type":"NewsArticle","headline":"deep"}'
    for _ in range(6):
        inner = '{"@type":"WebPage","@graph":[' + inner + "]}"
    html = f'<html><script type="application/ld+json">{inner}</script></html>'
    pages = spark.createDataFrame([(1, "https://a.example/x", html)], "page_id long, url string, html string")
    parsed = pages.select(extract.page_elements(F.col("html")).alias("page"))
    nodes = extract.jsonld_nodes(parsed).selectExpr("transform(nodes, n -> n.headline) AS h").first().h
    assert nodes == [None] * 6 + ["deep"]


def test_phrases_of_outlets_equal_the_pattern_of_each(spark):
    import random

    from pyspark.sql import functions as F

    from pressline.operators import phrases

    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcAB é.[(") for _ in range(n))
    rules = [(k % 8, text(rng.randint(1, 4))) for k in range(40)] + [(9, ""), (None, "a"), (3, None), (2, "AbC")]
    rows = [(k, k % 11, text(rng.randint(0, 30))) for k in range(400)] + [(900, 1, None), (901, None, "abc"), (902, 9, "")]
    texts = spark.createDataFrame(rows, "id int, owner int, text string").repartition(3)
    table = spark.createDataFrame(rules, "owner int, phrase string")
    got = {r.id: r.held for r in phrases.owned_phrases(texts, table).collect()}
    listed = table.filter("owner is not null and phrase is not null").groupBy("owner").agg(F.collect_list("phrase").alias("p"))
    joined = texts.join(listed, "owner", "left").select("id", F.rlike("text", extract.phrase_pattern(F.coalesce("p", F.array().cast("array<string>")))).alias("held"))
    assert got == {r.id: r.held for r in joined.collect()} and sum(v is True for v in got.values()) > 100
    assert not any(r.held for r in phrases.owned_phrases(texts, table.limit(0)).collect())


def test_few_pages_are_python_objects_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from pressline.functions import markup

    page = "<article>" + "".join(f'<p class="a" id="p{k}">Paragraph {k} of the page</p>' for k in range(60)) + "</article>"
    one = markup._parsed(pa.array([page, None]))

    def peak(n):
        pages = pa.array([page] * n)
        tracemalloc.start()
        parsed = markup._parsed(pages)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(parsed) == n and parsed[n - 1] == one[0]
        return most

    assert len(one[0]["paragraphs"]) == 60 and len(one[1]["paragraphs"]) == 0
    assert peak(markup.PARSED_TOGETHER * 12) < 2 * peak(markup.PARSED_TOGETHER)
