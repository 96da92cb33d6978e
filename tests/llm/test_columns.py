"""Each stage of the pipeline hands back columns it does not know, whatever they are called."""

import os
import subprocess
import sys

import pytest

from pressline.llm import fertility, order_minhash, poisson_mixing, suffixes

EXTRA = ["spans", "_doc", "_vertex", "_n", "_source", "_copy", "_key", "_rule_n_words", "_row", "a.b", "key", "rep", "extra_0", "with `tick`"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = __import__("random").Random(4)
    words = "the of and to in that was for with his on be at by had not but from they which you one were all her would there".split()
    text = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    texts = [text(rng.randint(60, 150)) for _ in range(30)] + [None, "", "short"]
    texts += [texts[0], texts[1] + " more"] + [texts[2]] * 3
    rows = [(k, t, "en", f"s{k % 3}", len(t or ""), *[f"{name}/{k}" for name in EXTRA]) for k, t in enumerate(texts)]
    names = ["doc_id", "text", "lang", "source", "n_chars", *EXTRA]
    schema = "c0 long, c1 string, c2 string, c3 string, c4 long, " + ", ".join(f"c{5 + k} string" for k in range(len(EXTRA)))
    return spark.createDataFrame(rows, schema).toDF(*names)


@pytest.mark.parametrize("stage", [fertility.passing, order_minhash.keep_one, suffixes.remove_duplicates, poisson_mixing.mix])
def test_columns_come_back(docs, stage):
    out = stage(docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    rows = out.collect()
    assert rows
    for row in rows:
        for name, value in zip(docs.columns[5:], row[5:]):
            assert value == f"{name}/{row[0]}"
        assert row[3] == f"s{row[0] % 3}"


@pytest.mark.parametrize("stage", [fertility.passing, order_minhash.keep_one, suffixes.remove_duplicates, poisson_mixing.mix])
def test_empty_table_stays_empty(docs, stage):
    assert stage(docs.filter("doc_id < 0")).count() == 0


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("op2_near_vectors", "op7_token_counts", "op11_fill_in_middle", "pipeline"):
    print("GOT", name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_from_another_folder_with_a_plain_session(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.stdout.count("GOT") == 4, run.stderr[-3000:]
