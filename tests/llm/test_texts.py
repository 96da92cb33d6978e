"""Operators on single texts against plain Python and the tokenizer libraries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import public_tokenizers as P

from pressline.llm import boosted_trees, fertility, hilbert_packing, token_counts, word_bpe
from pressline.llm.memo import TokenMemo, joined
from pressline.llm.word_bpe import WordBpe

DATA = "/root/testdata/sf0.001"
ODD = [
    "", " ", "\n\n", None, "a", "it's we'LL I'd  they've\tdon't", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> c", "<|ENDOFTEXT|> x",
    "İstanbul ΣΑΣ ΟΔΟΣ straße ﬁne e\u0301tude \u0301x", "数字 123４５ and ١٢٣ 😀😀👩‍👩‍👧", "x\x1cy \x85 z\u00a0w\u2003v\u3000u", "aaaaaaaaaaaaaaaaaaa" * 40, " " * 300 + "end", "\r\n \r\n",
    "#*$%&|<> " * 30, "a\u200bb\ufeffc", "ｆｕｌｌ ｗｉｄｔｈ", "don''t ''s 's'll", "tab\tvert\vform\fcr\rlf\n", "one two three " * 40, "é" * 5000, "_under_score__ 1_000",
]


def texts():
    found = pq.read_table(f"{DATA}/documents.parquet")["text"].to_pylist()
    rng = random.Random(3)
    letters = "abc XYZ'\"<>|#1٣é数\n\t\u0301\u00a0ßσΣ😀"
    return ODD + found[:120] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts()))
    return rows, spark.createDataFrame([(i, t, "en", i) for i, t in rows], "doc_id long, text string, lang string, n_words long").repartition(3)


def test_token_counts_equal_the_library(docs):
    from tokenizers import Tokenizer

    rows, df = docs
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in token_counts.token_counts(df).collect()}
    for doc_id, text in rows:
        want = len(library.encode(text or "", add_special_tokens=False).ids)
        row = got[doc_id]
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (want, len((text or "").encode()), want > 1024), repr(text)[:80]


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), WordBpe(P.path("word_bpe_49k.json"))
    own.words.entries = own.parts.entries = 500
    every = [t or "" for t in texts()]
    for at in range(0, len(every), 37):
        for text, ids in zip(every[at : at + 37], own.encode(every[at : at + 37])):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)[:80]


def test_memo_is_bounded():
    memo = TokenMemo(lambda words: joined([[len(w), ord(w[0])] for w in words]), entries=3)
    for words in (["a", "bb"], ["ccc", "dd", "e", "a"], ["ff", "a", "ff"], []):
        length, ids = memo.tokens(words)
        assert length.tolist() == [2] * len(words) and ids.tolist() == [x for w in words for x in (len(w), ord(w[0]))]
        assert len(memo.place) <= 3 + len(set(words))


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    rows, df = docs
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in hilbert_packing.pack_along_curve(df).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, text in rows:
        want = library.encode(text or "", add_special_tokens=False).ids + [1]
        mine = sorted(pieces[doc_id], key=lambda r: r.start)
        assert b"".join(r.ids for r in mine) == b"".join(i.to_bytes(4, "little") for i in want)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))] and {r.doc_tokens for r in mine} == {len(want)}
    for mine in sequences.values():
        mine.sort(key=lambda r: r.offset)
        assert [r.offset for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
        total = sum(r.length for r in mine)
        assert total <= 2048 and total & (total - 1) == 0  # nothing needs padding


def test_a_packing_task_remembers_nothing_after_its_end(monkeypatch):
    task = SimpleNamespace(partitionId=lambda: 0)
    monkeypatch.setattr(hilbert_packing, "TaskContext", SimpleNamespace(get=lambda: task))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some plain words", "other words_with 3 marks"]})
    for _ in range(2):  # a second task of the same worker gives the same ids
        pieces = [r for part in hilbert_packing._pack(P.path("word_bpe_49k.json"), 2048)(iter([batch])) for r in part.to_pylist()]
        assert sum(r["length"] for r in pieces) == sum(len(ids) + 1 for ids in WordBpe(P.path("word_bpe_49k.json")).encode(batch["text"].to_pylist()))
        assert [(len(e.parts.place), len(e.words.place), e.parts.used) for e in word_bpe._loaded.values()] == [(0, 0, 0)]


def test_hilbert_neighbours_touch():
    import itertools

    import numpy as np

    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hilbert_packing.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        walk = grid[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_statistics_equal_plain_python(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows, df = docs
    got = {r.doc_id: r for r in fertility.quality_rules(df).collect()}
    for doc_id, text in rows:
        words, row = words_of(text), got[doc_id]
        triples = Counter(zip(words, words[1:], words[2:]))
        hit = {k + s for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for s in range(3)}
        lines = [line for line in (text or "").split("\n") if words_of(line)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want, repr(text)[:80]
        assert row.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
        ids = [i for word in words for i in model.encode(word)]
        assert row.n_tokens == len(ids)
        if ids:
            share = [n / len(ids) for n in Counter(ids).values()]
            assert math.isclose(row.token_entropy, -sum(p * math.log2(p) for p in share), abs_tol=1e-9)
        assert not (row.kept and row.base_failed) and row.kept == (not row.base_failed and not row.reasons)


def test_words_have_the_tokens_of_the_whole_text():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for text in pq.read_table(f"{DATA}/documents.parquet")["text"].to_pylist()[:60]:
        plain = " ".join(text.split())
        assert model.encode(plain) == [i for word in plain.split() for i in model.encode(word)]


def test_passing_keeps_all_columns(docs):
    _, df = docs
    clashing = df.withColumnRenamed("n_words", "kept")
    kept = fertility.passing(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in fertility.quality_rules(df).filter("kept").collect())


def test_clean_documents_pass_and_symbol_soup_fails(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    judged = fertility.quality_rules(docs).filter("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    count = {(r.quality, r.kept): r["count"] for r in judged}
    assert count.get((1, False), 0) == 0 and count.get((0, False), 0) >= count.get((0, True), 0)


def test_scores_rank_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = boosted_trees.quality_scores(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert good and bad and sum(g > b for g in good for b in bad) > 0.98 * len(good) * len(bad)
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_scores_without_labels_and_odd_texts(spark, docs):
    _, df = docs
    rows = boosted_trees.quality_scores(df, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.score for r in rows} == {0.5} and len(rows) == df.count()
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "y"), (1, "", "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in boosted_trees.quality_scores(odd, labels).collect())


def test_flattened_trees_walk_like_nodes():
    import numpy as np

    rng = np.random.RandomState(1)
    x = rng.rand(400, len(boosted_trees.FEATURES)).astype(np.float32)
    trees = boosted_trees.fit(x, (x[:, 0] + x[:, 3] > 1).astype(float), rounds=5, depth=3)
    for row, score in zip(x[:40], trees.scores(x[:40])):
        raw = trees.base
        for feature, limit, value in zip(trees.feature, trees.limit, trees.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
            raw += value[node - len(feature)]
        assert math.isclose(score, 1 / (1 + math.exp(-raw)), rel_tol=1e-9)


@pytest.mark.parametrize("run", [token_counts.token_counts, hilbert_packing.pack_along_curve, fertility.quality_rules])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
