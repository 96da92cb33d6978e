"""Article search.

The reference ranks with a database text search whose stemming is not reproducible.
Here a term is a lower-case run of letters, digits and underscores, and the rank of an
article for a set of terms is the sum of ``w * (1 + ln(tf))`` over terms and fields,
with w = 1.0 for the title, 0.4 for the excerpt and 0.2 for the body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from pressline.functions.text import strip
from pressline.operators.ranking import freshness_order, top_n
from pressline.operators.substrings import GramIndex, Needle, substring_matches
from pressline.session import cut_lineage

TERM = r"[\p{L}\p{N}_]+"
FIELD_WEIGHTS = {"title": 1.0, "excerpt": 0.4, "content": 0.2}
FIELD_STEP = 1 << 40  # positions of one field end long before those of the next begin
SIX_FIELDS = ("title", "excerpt", "content", "source_name", "category_name", "tag_names")
ID_BLOCK = 4096  # articles of a block of postings
PACK_TOKENS = 1 << 20  # a packed posting covers articles with about this many tokens
SPREAD = 16  # tasks among which the packed postings of one term are dealt


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def build_search_index(
    articles: DataFrame, only: Sequence[str] | None = None, positions: bool = False, packed: bool = False
) -> DataFrame:
    """Q1: postings ``(term, id, tf_title, tf_excerpt, tf_content, weight)``.

    All occurrences of a term in an article come from one row, so they are combined
    before the shuffle; a frequent term spreads over its articles. With ``only`` the
    postings of the listed terms are built and no others leave the scan. With ``positions``
    the postings also list where the term stands, each field ``FIELD_STEP`` after the last, so
    that phrases need no text. ``packed`` postings hold many articles in a row
    (:func:`packed_postings`), always with positions.
    """
    if packed:
        index = packed_postings(articles)
        return index if only is None else index.filter(F.col("term").isin(list(only)))

    def tagged(number: int, field: str) -> Column:
        placed = F.transform(terms(F.col(field)), lambda t, i: F.struct(t.alias("term"), (i + number * F.lit(FIELD_STEP)).alias("at")))
        return F.filter(placed, lambda o: o["term"].isin(list(only))) if only is not None else placed

    occurrences = F.concat(*[tagged(number, field) for number, field in enumerate(FIELD_WEIGHTS)])
    rows = articles.select("id", F.explode(occurrences).alias("o"))
    of = F.floor(F.col("o.at") / FIELD_STEP)
    counted = [F.count_if(of == number).alias(f"tf_{field}") for number, field in enumerate(FIELD_WEIGHTS)]
    counts = rows.groupBy("o.term", "id").agg(*counted, *([F.sort_array(F.collect_list("o.at")).alias("positions")] if positions else []))
    return counts.withColumn("weight", _weight())


def _weight() -> Column:
    return reduce(
        lambda a, b: a + b,
        [F.when(F.col(f"tf_{f}") > 0, F.lit(w) * (1 + F.log(F.col(f"tf_{f}")))).otherwise(0.0) for f, w in FIELD_WEIGHTS.items()],
    )


def _pack_articles(rows: pa.Table) -> pa.RecordBatch:
    """One row per term of whole articles, with a list entry for each article that holds it."""
    ids = rows.column("id").combine_chunks().dictionary_encode(null_encoding="encode")
    article = ids.indices.to_numpy()
    words, owner, at = [], [], []
    for number, field in enumerate(FIELD_WEIGHTS):
        lists = rows.column(field).combine_chunks()
        length = lists.value_lengths().to_numpy()
        first = np.cumsum(length) - length
        words.append(lists.flatten())
        owner.append(np.repeat(article, length))
        at.append(np.arange(length.sum()) - np.repeat(first, length) + number * FIELD_STEP)
    names = pa.concat_arrays(words).dictionary_encode()
    owner, at = np.concatenate(owner), np.concatenate(at)
    count = max(1, len(ids.dictionary))
    pair = names.indices.to_numpy().astype(np.int64) * count + owner
    order = np.lexsort((at, pair))
    pair, at = pair[order], at[order]
    start = np.flatnonzero(np.diff(pair, prepend=-1))  # postings
    term, owner = pair[start] // count, pair[start] % count
    begin = np.flatnonzero(np.diff(term, prepend=-1))  # rows
    ends = pa.array(np.append(begin, len(start)).astype(np.int32))
    field = at // FIELD_STEP
    listed = lambda values: pa.ListArray.from_arrays(ends, values)
    tallies = [np.add.reduceat(field == number, start, dtype=np.int32) if len(start) else np.zeros(0, np.int32) for number in range(len(FIELD_WEIGHTS))]
    places = pa.ListArray.from_arrays(pa.array(np.append(start, len(at)).astype(np.int32)), pa.array(at))
    return pa.RecordBatch.from_arrays(
        [names.dictionary.take(pa.array(term[begin])), listed(ids.dictionary.take(pa.array(owner))), *(listed(pa.array(t)) for t in tallies), listed(places)],
        names=["term", "ids", *(f"tf_{f}" for f in FIELD_WEIGHTS), "positions"],
    )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by id; the rows of one id are packed together."""
    held: list[pa.RecordBatch] = []
    tokens = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and tokens >= PACK_TOKENS:
            last = held[-1].column(0)[-1]
            same = next((k for k in range(batch.num_rows) if batch.column(0)[k] != last), batch.num_rows)
            held.append(batch.slice(0, same))
            batch = batch.slice(same)
            if not batch.num_rows:
                continue
            yield _pack_articles(pa.Table.from_batches(held))
            held, tokens = [], 0
        held.append(batch)
        tokens += sum(len(batch.column(f).flatten()) for f in FIELD_WEIGHTS)
    if held:
        yield _pack_articles(pa.Table.from_batches(held))


def packed_postings(articles: DataFrame) -> DataFrame:
    """The postings of :func:`build_search_index` with positions, many articles to a row.

    ``(term, ids, tf_title, tf_excerpt, tf_content, positions)``, all but the term lists with an
    entry per article. Texts are shuffled once, so that the rows of an id and articles of near
    ids meet; no row per term and article is.
    """
    kind = articles.schema["id"].dataType
    near = F.floor(F.col("id") / ID_BLOCK) if isinstance(kind, NumericType) else F.col("id")
    rows = articles.select("id", *FIELD_WEIGHTS).repartition(near).sortWithinPartitions("id")
    lists = ", ".join(f"tf_{f} array<int>" for f in FIELD_WEIGHTS)
    return rows.select("id", *[terms(F.col(f)).alias(f) for f in FIELD_WEIGHTS]).mapInArrow(
        _pack, f"term string, ids array<{kind.simpleString()}>, {lists}, positions array<array<bigint>>"
    )


def posting_rows(index: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """Postings, packed or not, as one row per term and article; with ``only`` of these terms."""
    if only is not None:
        index = index.filter(F.col("term").isin(list(only)))
    if "ids" not in index.columns:
        return index
    lists = F.arrays_zip("ids", *(f"tf_{f}" for f in FIELD_WEIGHTS), "positions")
    return index.select("term", F.inline(lists)).withColumnRenamed("ids", "id").withColumn("weight", _weight())


def write_search_index(index: DataFrame, path: str) -> None:
    """Store postings clustered by term, so that a term lookup reads few row groups."""
    if "ids" in index.columns:
        # A frequent term's rows go to many tasks, by their first article.
        clustered = index.repartition("term", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(SPREAD))).sortWithinPartitions("term")
    else:
        clustered = index.repartitionByRange("term", "id").sortWithinPartitions("term", "id")
    clustered.write.mode("overwrite").parquet(path)


def block_maxima(index: DataFrame) -> DataFrame:
    """The greatest weight of every term per block of article ids: bounds for :func:`fts_top`."""
    rows = posting_rows(index).select("term", "weight", F.floor(F.col("id") / ID_BLOCK).alias("block"))
    return rows.groupBy("term", "block").agg(F.max("weight").alias("most"))


def parse_query(query: str) -> list[dict]:
    """A web-style query as alternatives of terms, phrases and excluded terms.

    Quotes make a phrase, a leading minus excludes, ``or`` starts an alternative.
    """
    alternatives = [{"terms": [], "phrases": [], "excluded": []}]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query.lower()):
        if word == "or" and not minus:
            alternatives.append({"terms": [], "phrases": [], "excluded": []})
            continue
        found = re.findall(r"\w+", phrase or word)
        if not found:
            continue
        current = alternatives[-1]
        if minus:
            current["excluded"].append(" ".join(found))
        else:
            current["terms"].extend(found)
            if len(found) > 1:
                current["phrases"].append(" ".join(found))
    return [a for a in alternatives if a["terms"]]


def search_terms(query: str) -> list[str]:
    """Q7: query words of at least three characters."""
    return [w for w in re.sub(r"[^\w\s]", " ", query).split() if len(w) >= 3]


def _lookups(queries: Sequence[tuple[int, str]]) -> tuple[list, list]:
    """Positive terms, and the terms of phrases and exclusions with their place inside them.

    ``(query_id, alternative, term, n_terms)`` and ``(query_id, alternative, part, kind, place, length, term)``.
    """
    wanted, parts = [], []
    for qid, text in queries:
        for n, alt in enumerate(parse_query(text)):
            wanted += [(qid, n, t, len(set(alt["terms"]))) for t in sorted(set(alt["terms"]))]
            for number, (kind, phrase) in enumerate([*(("phrase", p) for p in alt["phrases"]), *(("excluded", p) for p in alt["excluded"])]):
                own = phrase.split()
                parts += [(qid, n, number, kind, place, len(own), t) for place, t in enumerate(own)]
    return wanted, parts


_WANTED = "query_id bigint, alternative int, term string, n_terms int"
_PARTS = "query_id bigint, alternative int, part int, kind string, place int, length int, term string"


def _terms_of(wanted: list, parts: list) -> list[str]:
    return sorted({row[2] for row in wanted} | {row[-1] for row in parts})


def _matching(hits: DataFrame, postings: DataFrame, parts: list) -> DataFrame:
    """Those of ``hits`` that hold every phrase and no exclusion, by the positions of their terms."""
    if not parts:
        return hits
    rules = hits.sparkSession.createDataFrame(parts, _PARTS)
    ids = hits.select("query_id", "alternative", "id")
    placed = postings.select("term", "id", "positions").join(F.broadcast(rules), "term").join(ids, ["query_id", "alternative", "id"], "left_semi")
    # Where the phrase would begin, by each of its terms; a phrase stands where all agree.
    begins = placed.withColumn("begins", F.transform("positions", lambda p: p - F.col("place")))
    met = begins.groupBy("query_id", "alternative", "part", "kind", "length", "id").agg(F.collect_list("begins").alias("all"))
    common = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    standing = met.filter((F.size("all") == F.col("length")) & (F.size(common) > 0))
    held = standing.groupBy("query_id", "alternative", "id").agg(
        F.count_if(F.col("kind") == "phrase").alias("n_phrases"), F.count_if(F.col("kind") == "excluded").alias("n_excluded")
    )
    needed = rules.filter("kind = 'phrase'").groupBy("query_id", "alternative").agg(F.countDistinct("part").alias("needed"))
    judged = hits.join(F.broadcast(needed), ["query_id", "alternative"], "left").join(held, ["query_id", "alternative", "id"], "left")
    passes = (F.coalesce("n_phrases", F.lit(0)) == F.coalesce("needed", F.lit(0))) & (F.coalesce("n_excluded", F.lit(0)) == 0)
    return judged.filter(passes).select(*hits.columns)


def fts_search(queries: Sequence[tuple[int, str]], articles: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Q2: ``(query_id, id, rank)`` for a short list of queries.

    Terms, phrases and exclusions are answered by postings with positions; no text is read
    when ``index`` holds them (:func:`build_search_index` with ``positions``).
    """
    wanted, parts = _lookups(queries)
    spark = articles.sparkSession
    if index is None:
        index = build_search_index(articles, only=_terms_of(wanted, parts), positions=bool(parts))
    else:
        index = posting_rows(index, _terms_of(wanted, parts))
    hits = _scored(index, spark.createDataFrame(wanted, _WANTED))
    return _matching(hits, index, parts).groupBy("query_id", "id").agg(F.max("rank").alias("rank"))


def _scored(index: DataFrame, lookups: DataFrame) -> DataFrame:
    """Articles that hold all positive terms of an alternative, with their rank."""
    return (
        index.select("term", "id", "weight").join(F.broadcast(lookups), "term")
        .groupBy("query_id", "alternative", "n_terms", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("rank"))
        .filter("n = n_terms").select("query_id", "alternative", "id", "rank")
    )


def fts_top(queries: Sequence[tuple[int, str]], index: DataFrame, maxima: DataFrame, k: int, first: int = 4) -> DataFrame:
    """Q2: the ``k`` best articles per query, by rank, then by higher id: ``(query_id, id, rank)``.

    The greatest weights of a block of articles bound the ranks inside it. The ``first`` blocks
    by bound are scored; of the others only those that can still reach the k-th rank found
    there are read. The result is that of the full ranking.
    """
    spark = index.sparkSession
    wanted, parts = _lookups(queries)
    lookups = F.broadcast(spark.createDataFrame(wanted, _WANTED))
    index = posting_rows(index, _terms_of(wanted, parts))
    bounds = maxima.filter(F.col("term").isin(_terms_of(wanted, []))).join(lookups, "term").groupBy("query_id", "alternative", "n_terms", "block").agg(F.sum("most").alias("bound"), F.count(F.lit(1)).alias("n"))
    blocks = cut_lineage(bounds.filter("n = n_terms").groupBy("query_id", "block").agg(F.max("bound").alias("bound")))
    order = [F.desc("rank"), F.desc("id")]

    def scored(inside: DataFrame) -> DataFrame:
        """Matches in the given blocks (``query_id``, ``block``) of each query."""
        some = index.withColumn("block", F.floor(F.col("id") / ID_BLOCK)).join(inside.select("block").distinct(), "block", "left_semi")
        found = _matching(_scored(some, lookups), some, parts).groupBy("query_id", "id").agg(F.max("rank").alias("rank"))
        return found.withColumn("block", F.floor(F.col("id") / ID_BLOCK)).join(inside.select("query_id", "block"), ["query_id", "block"], "left_semi").drop("block")

    tried = top_n(blocks, ["query_id"], [F.desc("bound"), F.asc("block")], first, "place").drop("place")
    best = cut_lineage(top_n(scored(tried), ["query_id"], order, k, "place"))
    reached = best.filter(F.col("place") == k).select("query_id", F.col("rank").alias("least"))
    # The slack covers sums of weights in another order.
    open_ = blocks.join(tried, ["query_id", "block"], "left_anti").join(reached, "query_id", "left").filter("least is null or bound >= least - 1e-9")
    rest = scored(cut_lineage(open_))
    return top_n(best.drop("place").unionByName(rest), ["query_id"], order, k, "place").drop("place")


def _contains_any(fields: Sequence[Column], needle: str) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(f, F.lit(""))).contains(needle.lower()) for f in fields])


def phrase_match(query: str) -> Column:
    """Q3: the query text in title or excerpt."""
    return _contains_any([F.col("title"), F.col("excerpt")], query)


def all_terms_match(query: str) -> Column:
    """Q4: every significant word somewhere in the article; never true without one."""
    found = search_terms(query)
    if not found:
        return F.lit(False)
    return reduce(lambda a, b: a & b, [_contains_any([F.col(f) for f in FIELD_WEIGHTS], t) for t in found])


def any_term_match(query: str) -> Column:
    """Q5: any significant word in six fields (text, outlet, category and tag names)."""
    found = search_terms(query)
    if not found:
        return F.lit(False)
    fields = [F.col("title"), F.col("excerpt"), F.col("content"), F.col("source_name"), F.col("category_name"), F.array_join("tags", " \x1f ")]
    return reduce(lambda a, b: a | b, [_contains_any(fields, t) for t in found])


def phrase_search(articles: DataFrame, query: str) -> DataFrame:
    return articles.filter(phrase_match(query))


def all_terms_search(articles: DataFrame, query: str) -> DataFrame:
    return articles.filter(all_terms_match(query))


def any_term_search(articles: DataFrame, query: str) -> DataFrame:
    """``articles`` carries ``source_name`` and ``category_name``."""
    return articles.filter(any_term_match(query))


def tag_names(articles: DataFrame) -> DataFrame:
    """``articles`` with their tags as one text, the sixth field of :func:`any_term_search`."""
    return articles.withColumn("tag_names", F.array_join("tags", " \x1f "))


def _needles(qid: int, query: str) -> list[tuple[int, Needle]]:
    """What the text strategies look for: (tier, needle)."""
    found = search_terms(query)
    out = [(2, Needle(qid, query, ("title", "excerpt")))]
    out += [(3, Needle(qid, t, tuple(FIELD_WEIGHTS))) for t in found]
    return out + [(4, Needle(qid, t, SIX_FIELDS)) for t in found]


def indexed_text_search(queries: Sequence[tuple[int, str]], articles: DataFrame, grams: GramIndex) -> DataFrame:
    """Q3-Q5 for many queries: ``(query_id, id, tier)``, tier 2 for the phrase, 3 for all and 4 for any terms.

    ``articles`` has the six fields, ``grams`` is an index over them; texts are read only for
    articles that hold the rarest trigrams of a needle.
    """
    spark = articles.sparkSession
    listed = [pair for qid, text in queries for pair in _needles(qid, text)]
    tiers = spark.createDataFrame([(n, tier) for n, (tier, _) in enumerate(listed)], "needle_no int, tier int")
    needed = F.broadcast(tiers.join(spark.createDataFrame([(n, x.key) for n, (_, x) in enumerate(listed)], "needle_no int, key long"), "needle_no"))
    count = needed.groupBy("key", "tier").agg(F.count(F.lit(1)).alias("all"))
    found = substring_matches([x for _, x in listed], articles, grams).join(F.broadcast(tiers), "needle_no")
    met = found.groupBy("key", "tier", "id").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(count), ["key", "tier"])
    return met.filter("tier = 4 or n = all").select(F.col("key").alias("query_id"), "id", "tier")


def cascade_search(
    queries: Sequence[tuple[int, str]], articles: DataFrame, index: DataFrame | None = None, grams: GramIndex | None = None
) -> DataFrame:
    """Q6: for each query the matches of the first strategy that finds anything.

    The ranked strategy comes from the postings. Only the queries it leaves open go to the
    text strategies, of which the smallest tier per query is kept. With ``grams`` (over
    :func:`tag_names` of the articles) these are index look-ups, without it one scan.
    """
    ranked = cut_lineage(fts_search(queries, articles, index).select("query_id", "id", F.lit(1).alias("tier"), "rank"))
    answered = {row["query_id"] for row in ranked.select("query_id").distinct().collect()}  # as many as queries
    waiting = [(qid, text) for qid, text in queries if qid not in answered]
    if not waiting:
        return ranked
    if grams is not None:
        found = indexed_text_search(waiting, tag_names(articles), grams)
    else:
        tests = F.array(
            *[
                F.struct(F.lit(qid).cast("bigint").alias("query_id"), F.lit(tier).alias("tier"), match.alias("hit"))
                for qid, text in waiting
                for tier, match in ((2, phrase_match(text)), (3, all_terms_match(text)), (4, any_term_match(text)))
            ]
        )
        found = articles.select("id", F.explode(F.filter(tests, lambda t: t["hit"])).alias("t")).select("t.query_id", "id", "t.tier")
    scanned = cut_lineage(found.withColumn("rank", F.lit(None).cast("double")))
    first = scanned.groupBy("query_id").agg(F.min("tier").alias("_tier"))
    kept = scanned.join(first, "query_id").filter("tier = _tier").drop("_tier")
    return ranked.unionByName(kept.select(*ranked.columns))


def search_sort(matches: DataFrame, articles: DataFrame, mode: str, query: str = "", views: DataFrame | None = None) -> DataFrame:
    """Relevance, date_desc, date_asc or popularity."""
    rows = matches.join(articles.select("id", "title", "scraped_at"), "id")
    if mode == "relevance":
        title_hit = F.when(F.lower("title").contains(query.lower()), 1).otherwise(0)
        return rows.orderBy(F.desc_nulls_last("rank"), F.desc(title_hit), *freshness_order())
    if mode == "date_asc":
        return rows.orderBy("scraped_at", "id")
    if mode == "popularity":
        counts = views.groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("view_count"))
        counted = rows.join(counts, "id", "left").withColumn("view_count", F.coalesce("view_count", F.lit(0)))
        return counted.orderBy(F.desc("view_count"), *freshness_order())
    return rows.orderBy(*freshness_order())


def suggestions(
    articles: DataFrame, categories: DataFrame, sources: DataFrame, text: str, as_of: Column, limit: int = 10
) -> DataFrame:
    """Q8/U4: recent titles, then categories, then active outlets that contain the text.

    A title counts once, at its latest scrape. Empty for texts shorter than two letters.
    """
    needle = text.strip().lower()
    recent = articles.filter((F.col("scraped_at") >= as_of - F.expr("INTERVAL 7 DAYS")) & F.col("has_full_content"))
    titles = (
        recent.filter(F.lower("title").contains(needle)).groupBy(F.col("title").alias("suggestion"))
        .agg(F.max("scraped_at").alias("_at")).orderBy(F.desc("_at"), "suggestion").limit(limit // 2)
        .select(F.lit(1).alias("part"), "suggestion")
    )

    def named(df, part):
        names = df.filter(F.lower("name").contains(needle)).select(F.col("name").alias("suggestion")).distinct()
        return names.orderBy("suggestion").limit(limit // 4).select(F.lit(part).alias("part"), "suggestion")

    out = titles.unionByName(named(categories, 2)).unionByName(named(sources.filter("is_active"), 3))
    return out if len(needle) >= 2 else out.limit(0)


SHORT_PREFIX = 4  # suggestions of texts up to this length are kept ready


def suggestion_entries(articles: DataFrame, categories: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """Q8 input: ``part, suggestion, at``: distinct recent titles (1), categories (2), active outlets (3)."""
    recent = articles.filter((F.col("scraped_at") >= as_of - F.expr("INTERVAL 7 DAYS")) & F.col("has_full_content"))
    titles = recent.groupBy(F.col("title").alias("suggestion")).agg(F.max("scraped_at").alias("at")).select(F.lit(1).alias("part"), "suggestion", "at")
    never = F.lit(None).cast("timestamp").alias("at")
    named = lambda df, part: df.select(F.lit(part).alias("part"), F.col("name").alias("suggestion"), never).distinct()
    return titles.unionByName(named(categories, 2)).unionByName(named(sources.filter("is_active"), 3)).filter("suggestion is not null")


def suggestion_suffixes(entries: DataFrame) -> DataFrame:
    """Every suffix of every entry in lower case, clustered by its first letters (``key``).

    A text is a substring of an entry if it is the prefix of one of its suffixes.
    """
    lowered = F.lower("suggestion")
    places = F.sequence(F.lit(1), F.length(lowered))
    suffix = F.transform(F.when(F.length(lowered) > 0, places), lambda at: F.substring(lowered, at, F.length(lowered)))
    rows = entries.select("part", "suggestion", "at", F.explode(F.array_distinct(suffix)).alias("suffix")).filter(F.length("suffix") > 1)
    return rows.withColumn("key", F.substring("suffix", 1, SHORT_PREFIX))


def _best_suggestions(rows: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The first titles by time and names by spelling of every key and part."""
    distinct = rows.groupBy(*keys, "part", "suggestion").agg(F.max("at").alias("at"))
    ranked = top_n(distinct, [*keys, "part"], [F.desc_nulls_last("at"), F.asc("suggestion")], max(limit // 2, limit // 4), "place")
    return ranked.filter(F.col("place") <= F.when(F.col("part") == 1, limit // 2).otherwise(limit // 4)).drop("place")


def short_suggestions(suffixes: DataFrame, limit: int = 10) -> DataFrame:
    """The suggestions of every text of two to ``SHORT_PREFIX`` letters: ``prefix, part, suggestion, at``."""
    sizes = F.sequence(F.lit(2), F.least(F.lit(SHORT_PREFIX), F.length("key")))
    prefixes = suffixes.select("part", "suggestion", "at", F.explode(F.transform(sizes, lambda n: F.substring("key", 1, n))).alias("prefix"))
    return _best_suggestions(prefixes, ["prefix"], limit)


def suggest_many(requests: DataFrame, suffixes: DataFrame, short: DataFrame, limit: int = 10) -> DataFrame:
    """Q8 for many partial texts: ``query_id, part, suggestion``, the rows of :func:`suggestions` for each.

    ``requests`` has ``query_id, text``. Short texts are one look-up of what ``short`` keeps for
    ``limit``; longer ones meet the suffixes that begin with their first letters.
    """
    asked = requests.select("query_id", F.lower(strip(F.coalesce("text", F.lit("")))).alias("needle")).filter(F.length("needle") >= 2)
    ready = asked.join(short, F.col("needle") == F.col("prefix")).select("query_id", "part", "suggestion")
    longer = asked.filter(F.length("needle") > SHORT_PREFIX).withColumn("key", F.substring("needle", 1, SHORT_PREFIX))
    met = longer.join(suffixes, "key").filter(F.startswith("suffix", "needle"))
    return ready.unionByName(_best_suggestions(met, ["query_id"], limit).select("query_id", "part", "suggestion"))
