"""The pipeline, stage by stage, against plain Python on a small corpus."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers as P
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pressline.llm import fertility
from test_order_minhash import classes, shingles
from test_suffixes import brute
from test_tables import draw
from test_texts import words_of


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(9)
    rows = [r for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist() if r["n_chars"] < 1400]
    passage = " ".join(f"{a}{b}" for a in "abcdefgh" for b in ("lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed"))
    made = []
    for k, r in enumerate(rows[:24]):
        words = r["text"].split(" ")
        words[rng.randrange(len(words))] = "changed"
        made.append(r | {"doc_id": 5000 + k, "text": " ".join(words)})
        if k % 3 == 0:
            made.append(r | {"doc_id": 6000 + k, "text": rows[40 + k]["text"] + "\n" + passage + "\n" + " ".join(rng.sample(words, len(words)))})
    made += [rows[0] | {"doc_id": 7000}, rows[0] | {"doc_id": 7001, "text": None}, rows[0] | {"doc_id": 7002, "text": ""}, rows[0] | {"doc_id": 7003, "lang": None, "source": None}]
    every = rows + made
    table = pa.Table.from_pylist([r | {"n_chars": len(r["text"] or "")} for r in every], schema=pq.read_schema("/root/testdata/sf0.001/documents.parquet"))
    path = tmp_path_factory.mktemp("corpus")
    pq.write_table(table, path / "documents.parquet")
    return str(path)


def passes(text, lang, model):
    words = words_of(text)
    triples = Counter(zip(words, words[1:], words[2:]))
    hit = {k + s for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for s in range(3)}
    if len(words) < 50 or 100 * len(hit) > 50 * len(words):
        return False
    ids = [i for word in words for i in model.encode(word)]
    entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())
    band = fertility.BANDS[lang or "latin"]
    floor = np.interp(math.log2(len(ids)), range(6, 14), fertility.ENTROPY_FLOOR) + band.entropy_allowance
    chars = sum(map(len, words)) / len(ids)
    share = sum(model.is_byte(i) or model.is_unknown(i) for i in ids) / len(ids)
    return band.min_chars_per_token <= chars <= band.max_chars_per_token and share <= band.max_fallback_share and entropy >= floor


def test_stages(spark, folder):
    import sentencepiece
    from tokenizers import Tokenizer

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, tables[-1], folder)
        assert found.columns == columns or name == "pack"
        found.write.parquet(f"{folder}/{name}")
        tables.append(spark.read.parquet(f"{folder}/{name}"))
    start, ruled, unique, cut, mixed, packed = [t.collect() for t in tables]

    assert {r.doc_id for r in ruled} == {r.doc_id for r in start if passes(r.text, r.lang, model)} and len(ruled) > 50
    label = classes([(r.doc_id, r.text) for r in ruled])
    assert sorted(r.doc_id for r in unique) == sorted(set(label.values())) and len(unique) < len(ruled)
    assert all(shingles(r.text) for r in unique)

    before, after = {r.doc_id: r.text for r in unique}, {r.doc_id: r.text for r in cut}
    repeats = brute(before.items(), 50)
    assert repeats and not brute(after.items(), 50)
    assert all(after[d] == before[d] for d in before if d not in repeats)
    assert all(r.n_chars == len(r.text) for r in cut)

    size = Counter()
    for r in cut:
        size[r.source] += len(r.text.encode())
    root = {s: math.sqrt(n) for s, n in size.items()}
    rate = {s: sum(size.values()) * root[s] / sum(root.values()) / size[s] for s in size}
    want = Counter({r: draw(r.doc_id, rate[r.source]) for r in cut})
    assert Counter(mixed) == +want

    ids = defaultdict(int)
    for r in packed:
        ids[r.doc_id] += r.length
    counted = {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in after.items()}
    assert ids == {r.doc_id: counted[r.doc_id] * n for r, n in (+want).items()}


def test_run_equals_its_stages(spark, folder):
    ran = entry.queries()["pipeline"](spark, folder)
    assert {r.doc_id for r in ran.select("doc_id").distinct().collect()} == {r.doc_id for r in spark.read.parquet(f"{folder}/mix_sources").collect()}


def test_an_empty_corpus(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
