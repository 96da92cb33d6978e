"""Search indexes against scans of the texts."""

import random

import pytest
from pyspark.sql import functions as F

from pressline.operators import search, substrings
from pressline.operators.ranking import top_n

LETTERS = "abcé日😀 .-_Aİ"


@pytest.fixture(scope="module")
def articles(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(k, text(5), text(12), text(60), f"outlet {k % 3}", "news", [f"t{k % 4}", "Ab c"]) for k in range(300)]
    rows += [(300 + k, "".join(rng.choice(LETTERS) for _ in range(20)), None, "", None, "news", []) for k in range(60)]
    rows += [(400, None, None, None, None, None, None), (401, "\x00a\x00", "😀😀", "x", "y", "z", ["q"])]
    schema = "id bigint, title string, excerpt string, content string, source_name string, category_name string, tags array<string>"
    return spark.createDataFrame(rows, schema).repartition(4).cache()


def test_substrings_equal_a_scan(spark, articles, tmp_path):
    rng = random.Random(2)
    tagged = search.tag_names(articles)
    index = substrings.write_gram_index(tagged, search.SIX_FIELDS, str(tmp_path / "grams"))
    texts = ["", "a", "é", "ab", "B", "a b", "outlet 1", "t3", "日", "😀", "😀😀", "\x00a", "İ", "zzz", "a a a a", "bcd abc"]
    texts += ["".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    fields = [("title", "excerpt"), ("content",), search.SIX_FIELDS]
    needles = [substrings.Needle(n, t, fields[n % 3]) for n, t in enumerate(texts)]
    got = {(r.key, r.id) for r in substrings.substring_matches(needles, tagged, index).collect()}
    want = set()
    for needle in needles:
        holds = F.lit(False)
        for field in needle.fields:
            holds = holds | F.lower(F.coalesce(F.col(field), F.lit(""))).contains(needle.text.lower())
        want |= {(needle.key, r.id) for r in tagged.filter(holds).select("id").collect()}
    assert got == want and len(got) > 2000


def test_short_needles_read_no_text(articles, tmp_path):
    tagged = search.tag_names(articles)
    index = substrings.write_gram_index(tagged, search.SIX_FIELDS, str(tmp_path / "grams"))
    plan = substrings.candidates([substrings.Needle(1, "ab", ("title",))], index)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan and "title" not in plan


QUERIES = [(1, "a b"), (2, '"a b"'), (3, "a -b"), (4, 'c or "b a c"'), (5, '"a a"'), (6, '-"b c" a'), (7, "zzzz"), (8, "d"), (9, '"a b a"')]


def by_text(articles):
    """Every match of QUERIES with the rank of its terms, from the fields as token texts."""
    out = {}
    rows = articles.select("id", *[search.terms(F.col(f)).alias(f) for f in search.FIELD_WEIGHTS]).collect()
    import math

    for qid, text in QUERIES:
        for alt in search.parse_query(text):
            for row in rows:
                fields = [row[f] for f in search.FIELD_WEIGHTS]
                joined = "|".join(f" {' '.join(f)} " for f in fields)
                if not all(any(t in f for f in fields) for t in alt["terms"]) or not all(f" {p} " in joined for p in alt["phrases"]):
                    continue
                if any(f" {p} " in joined for p in alt["excluded"]):
                    continue
                rank = sum(w * (1 + math.log(f.count(t))) for t in set(alt["terms"]) for f, w in zip(fields, search.FIELD_WEIGHTS.values()) if t in f)
                out[qid, row.id] = max(out.get((qid, row.id), 0), rank)
    return out


@pytest.fixture(scope="module")
def index(spark, articles, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("postings") / "p")
    search.write_search_index(search.build_search_index(articles, positions=True), path)
    return spark.read.parquet(path)


def test_phrases_and_exclusions_by_positions(articles, index):
    want = by_text(articles)
    for found in (search.fts_search(QUERIES, articles, index), search.fts_search(QUERIES, articles)):
        got = {(r.query_id, r.id): r["rank"] for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # The postings answer all of it: no text is read.
    assert "content" not in search.fts_search(QUERIES, articles.select("id"), index)._jdf.queryExecution().optimizedPlan().toString().replace("tf_content", "")


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_best_blocks_give_the_full_ranking(articles, index, monkeypatch, k):
    monkeypatch.setattr(search, "ID_BLOCK", 16)
    full = top_n(search.fts_search(QUERIES, articles, index), ["query_id"], [F.desc("rank"), F.desc("id")], k)
    want = {(r.query_id, r.id) for r in full.collect()}
    got = {(r.query_id, r.id) for r in search.fts_top(QUERIES, index, search.block_maxima(index), k, first=2).collect()}
    assert got == want and want


def test_cascade_is_the_same_with_and_without_the_gram_index(articles, tmp_path):
    queries = [*QUERIES, (20, "bcd"), (21, "outlet qqq"), (22, "xx yy")]
    index = substrings.write_gram_index(search.tag_names(articles), search.SIX_FIELDS, str(tmp_path / "grams"))
    rows = lambda df: sorted((r.query_id, r.id, r.tier) for r in df.collect())
    assert rows(search.cascade_search(queries, articles, None, index)) == rows(search.cascade_search(queries, articles))


REPEATED = [(1, "a b a", "b", None), (None, "a", None, "c"), (1, "b", "a a", "c"), (2, "", None, ""), (None, "c a", "b", "a"), (5000, "a", "b b", "a c a"), (9, None, None, None)]


def test_packed_postings_are_those_of_the_rows(spark, tmp_path):
    """Ids that repeat or are null are one article each, as in the postings by row."""
    rows = spark.createDataFrame(REPEATED, "id bigint, title string, excerpt string, content string").repartition(3)
    columns = ["term", "id", "tf_title", "tf_excerpt", "tf_content", "positions", "weight"]
    listed = lambda df: sorted(map(repr, (tuple(r) for r in df.select(columns).collect())))
    want = search.build_search_index(rows, positions=True)
    packed = search.build_search_index(rows, packed=True)
    assert listed(search.posting_rows(packed)) == listed(want)
    search.write_search_index(packed, str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    assert stored.count() < want.count()
    assert listed(search.posting_rows(stored, ["a", "c"])) == listed(want.filter("term in ('a', 'c')"))
    found = lambda index: sorted(map(repr, search.fts_search([(1, "a b"), (2, '"a a"'), (3, "b -c")], rows, index).collect()))
    assert found(stored) == found(want)
    assert sorted(map(repr, search.block_maxima(stored).collect())) == sorted(map(repr, search.block_maxima(want).collect()))


def test_rows_of_an_id_are_packed_together(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(search, "PACK_TOKENS", 1)
    words = [["x"], ["x", "y"], ["x"], ["y"], ["x"]]
    batches = [pa.RecordBatch.from_pydict({"id": [i], "title": [w], "excerpt": [[]], "content": [[]]}, pa.schema([("id", pa.int64()), *((f, pa.list_(pa.string())) for f in search.FIELD_WEIGHTS)])) for i, w in zip([None, None, 3, 3, 4], words)]
    packs = [{r["term"]: (r["ids"], r["tf_title"]) for r in pack.to_pylist()} for pack in search._pack(iter(batches))]
    assert packs == [{"x": ([None], [2]), "y": ([None], [1])}, {"x": ([3], [1]), "y": ([3], [1])}, {"x": ([4], [1])}]


def test_grams_hold_many_articles_in_a_row(articles, tmp_path):
    """A gram has a row per pack of articles, not one per article."""
    index = substrings.write_gram_index(search.tag_names(articles), search.SIX_FIELDS, str(tmp_path / "grams"))
    sizes = index.postings.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.sum(F.size("ids")).alias("ids"), F.countDistinct("gram").alias("grams")).first()
    assert sizes["n"] == sizes["ids"] == index.counts.agg(F.sum("n")).first()[0]
    assert sizes["rows"] <= 4 * sizes["grams"] < sizes["n"]


def test_texts_are_not_shuffled_by_outlet(spark, tmp_path):
    from pressline.plans import search as plans
    from pressline.plans.model import Model

    spark.createDataFrame([(k, "word " * 90, f"src{k % 3}") for k in range(9)], "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = plans.pool(Model(spark, str(tmp_path)))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == 9
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 3
