"""Fill-in-middle against plain Python on whole texts."""

import hashlib
import random
import re

import numpy as np
import pytest

from pressline.llm import middle_filling
from pyspark.sql import functions as F

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [
    None, "", " ", "\n\n", "a", "a ", " a", "a b", "12345678", "1234567 ", "12345678 x", "é" * 9, "日本 語\t文 ", "\x1c\x85   ", "\x08\x0e\x1f!\x7f",
    "x<P>y", "a <S", "<S", "S>a", "P> <", "<M", "😀 😀\r\n😀", "\x00a \x00", "a" * 40 + " " * 40, " " * 17 + "b",
]


def texts():
    rng = random.Random(11)
    letters = "ab <>PSM\n\t\r\x0b\x0c\x1f é日😀"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 70))) for _ in range(400)] + ["wort é " * 60000, "z" * 300000]


def by_hand(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_equals_plain_python(spark):
    rows = [(i, t) for i, t in enumerate(texts() * 3)] + [(None, "null id a b"), (7, "twice x y"), (7, "twice x y")]
    # Other columns, some named as the operator's own, are not read.
    docs = spark.createDataFrame([(i, t, "n", 1, "o") for i, t in rows], "doc_id long, text string, digest string, h1 int, output string").repartition(5)
    made = middle_filling.fill_in_middle(docs)
    back = made.withColumn("back", middle_filling.restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in back.collect()), key=repr)
    want = sorted(((i, *by_hand(i, t), t or "") for i, t in rows), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert middle_filling.fill_in_middle(docs).count() == 0


@pytest.mark.parametrize("size", [1, 7, 8, 9, 64, 1000])
def test_rank_and_select_on_random_bytes(size):
    rng = np.random.RandomState(size)
    data = rng.choice(np.array([0x08, 0x09, 0x0A, 0x0D, 0x0E, 0x1F, 0x20, 0x21, 0x41, 0x80, 0x89, 0xA0, 0xFF], np.uint8), size)
    words = middle_filling.as_words(data)
    marks = middle_filling.Marks(middle_filling.unit_ends(words, np.array([size - 1])))
    space = [x in b" \t\n\x0b\x0c\r" for x in data.tobytes()]
    ends = [k for k in range(size) if k == size - 1 or (not space[k] and space[k + 1])]
    assert marks.rank(np.arange(size + 1)).tolist() == [sum(e < k for e in ends) for k in range(size + 1)]
    assert marks.select(np.arange(1, len(ends) + 1)).tolist() == ends
