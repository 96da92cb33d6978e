"""Substring search by character grams (the index behind Q3-Q6).

The index holds, for every article, the runs of one, two and three characters of each field
in lower case, as whole numbers, with a bit per field. A needle of up to three characters is
one look-up and needs no text. A longer needle occurs in a field only if all its trigrams do;
the rarest of them are looked up and intersected, and only the articles that are left are
tested on their texts. So the result is that of a scan with ``contains``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

LONGEST = 3
LOOKED_UP = 4  # grams of a needle that are intersected; the texts decide
PACK_GRAMS = 1 << 21  # postings of articles that share a row per gram
SPREAD = 16  # tasks among which the rows of one gram are dealt
_CHARACTER = 21  # bits of a code point and one; 0 stands for no character


@dataclass(frozen=True)
class Needle:
    """A text to find in any of ``fields``, under a key of the caller's."""

    key: int
    text: str
    fields: tuple[str, ...]


def _packed(codes: np.ndarray, length: int) -> np.ndarray:
    """One number per run of ``length`` characters; equal runs have equal numbers."""
    codes = codes.astype(np.int64) + 1
    key = np.zeros(max(0, len(codes) - length + 1), np.int64)
    for k in range(length):
        key = (key << _CHARACTER) | codes[k : len(codes) - length + 1 + k]
    return key


def grams(text: str, length: int) -> list[int]:
    """The distinct runs of ``length`` characters of a text, as numbers."""
    return np.unique(_packed(np.frombuffer(text.encode("utf-32-le"), np.uint32), length)).tolist()


def _article_grams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of an article and a bit for each field that holds them."""
    found = []
    for number, text in enumerate(texts):
        codes = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
        for length in range(1, LONGEST + 1):
            own = np.unique(_packed(codes, length))
            found.append((own, np.full(len(own), 1 << number, np.int64)))
    every = np.concatenate([f[0] for f in found])
    order = np.argsort(every, kind="stable")
    every = every[order]
    start = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    marks = np.bitwise_or.reduceat(np.concatenate([f[1] for f in found])[order], start) if len(every) else np.zeros(0, np.int64)
    return every[start], marks


def _grouped(ids: pa.Array, names: list[np.ndarray], marks: list[np.ndarray]) -> pa.RecordBatch:
    """One row per gram with the articles that hold it."""
    row = np.repeat(np.arange(len(names)), [len(n) for n in names])
    gram, mark = np.concatenate(names), np.concatenate(marks)
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    ends = pa.array(np.append(start, len(gram)).astype(np.int32))
    holders = pa.ListArray.from_arrays(ends, ids.take(pa.array(row[order])))
    held = pa.ListArray.from_arrays(ends, pa.array(mark[order]))
    return pa.RecordBatch.from_arrays([pa.array(gram[start]), pa.array(np.diff(np.append(start, len(gram)))), holders, held], names=["gram", "n", "ids", "fields"])


def _emit(fields: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names, marks, count = [], [], [], 0
        for batch in batches:
            columns = [batch.column(k + 1).to_pylist() for k in range(fields)]
            for k, texts in enumerate(zip(*columns)):
                own, held = _article_grams(texts)
                ids.append(batch.column(0).slice(k, 1))
                names.append(own)
                marks.append(held.astype(np.int32))
                count += len(own)
                if count >= PACK_GRAMS:
                    yield _grouped(pa.concat_arrays(ids), names, marks)
                    ids, names, marks, count = [], [], [], 0
        if ids:
            yield _grouped(pa.concat_arrays(ids), names, marks)

    return emit


def gram_postings(articles: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``gram, n, ids, fields``: a row per gram and pack of articles that lie together in the input.

    ``ids`` lists the ``n`` articles of the pack that hold the gram, ``fields`` a number for each
    with a bit per field that holds it. A field that is null holds nothing. All grams of an
    article come from its own row, so nothing is shuffled to build them.
    """
    texts = [F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"f{k}") for k, f in enumerate(fields)]
    kind = articles.schema["id"].dataType.simpleString()
    return articles.select("id", *texts).mapInArrow(_emit(len(fields)), f"gram long, n long, ids array<{kind}>, fields array<int>")


class GramIndex:
    """Postings and gram counts in a folder, and the fields they cover.

    Postings are clustered by gram, so a look-up reads the row groups of its grams only.
    """

    def __init__(self, spark: SparkSession, path: str, fields: Sequence[str]):
        self.fields = tuple(fields)
        self.postings = spark.read.parquet(f"{path}/postings")
        self.counts = spark.read.parquet(f"{path}/counts")


def write_gram_index(articles: DataFrame, fields: Sequence[str], path: str) -> GramIndex:
    """Build the index and store it below ``path``, replacing what is there."""
    spark = articles.sparkSession
    rows = gram_postings(articles, fields)
    # A gram that most articles have goes to many tasks, by the first article of each row.
    dealt = rows.repartition("gram", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(SPREAD)))
    dealt.sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    stored.groupBy("gram").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{path}/counts")
    return GramIndex(spark, path, fields)


def _holds(fields: Sequence[str]) -> Column:
    """Whether a field of the needle's mask contains it."""
    tests = [
        (F.col("mask").bitwiseAND(1 << k) != 0) & F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).contains(F.col("needle"))
        for k, f in enumerate(fields)
    ]
    return reduce(lambda a, b: a | b, tests)


def candidates(needles: Sequence[Needle], index: GramIndex) -> DataFrame:
    """``needle_no, id``: the articles that hold the looked-up grams of a needle in one field."""
    spark = index.postings.sparkSession
    rows = []
    for number, needle in enumerate(needles):
        text = needle.text.lower()
        mask = sum(1 << k for k, f in enumerate(index.fields) if f in needle.fields)
        found = grams(text, min(LONGEST, len(text))) if text else []
        rows += [(number, gram, len(found), mask) for gram in found]
    asked = spark.createDataFrame(rows, "needle_no int, gram long, n_grams int, mask int")
    # As many rows as the needles have characters: broadcast to the counts and the postings.
    counted = index.counts.join(F.broadcast(asked), "gram")
    rank = F.row_number().over(Window.partitionBy("needle_no").orderBy("n", "gram"))
    known = F.count(F.lit(1)).over(Window.partitionBy("needle_no"))
    picked = counted.select("needle_no", "gram", "mask", "n_grams", rank.alias("r"), known.alias("known")).filter("known = n_grams").filter(F.col("r") <= LOOKED_UP)
    wanted = picked.select("needle_no", "gram", "mask", F.least("n_grams", F.lit(LOOKED_UP)).alias("needed"))
    packs = index.postings.filter(F.col("gram").isin(sorted({gram for _, gram, _, _ in rows}))).drop("n").join(F.broadcast(wanted), "gram")
    listed = packs.select("needle_no", "needed", "mask", F.inline(F.arrays_zip("ids", "fields"))).withColumnRenamed("ids", "id")
    hits = listed.withColumn("both", F.col("fields").bitwiseAND(F.col("mask")))
    met = hits.groupBy("needle_no", "id", "needed").agg(F.count(F.lit(1)).alias("n"), F.bit_and("both").alias("both"))
    return met.filter("n = needed and both <> 0").select("needle_no", "id")


def substring_matches(needles: Sequence[Needle], articles: DataFrame, index: GramIndex) -> DataFrame:
    """``key, needle_no, id`` for every needle and article with the needle in one of its fields.

    Equals a scan with ``contains`` on lower-case fields. An empty needle is in every article.
    """
    spark = articles.sparkSession
    facts = [(n, x.key, x.text.lower(), sum(1 << k for k, f in enumerate(index.fields) if f in x.fields)) for n, x in enumerate(needles)]
    table = F.broadcast(spark.createDataFrame(facts, "needle_no int, key long, needle string, mask int"))
    found = candidates(needles, index).join(table, "needle_no")
    short = found.filter(F.length("needle") <= LONGEST).select("key", "needle_no", "id")
    empty = articles.select("id").crossJoin(table.filter("needle = ''")).select("key", "needle_no", "id") if any(not x.text for x in needles) else None
    longer = found.filter(F.length("needle") > LONGEST)
    tested = longer.join(articles.select("id", *index.fields), "id").filter(_holds(index.fields)).select("key", "needle_no", "id")
    out = short.unionByName(tested)
    return out if empty is None else out.unionByName(empty)
