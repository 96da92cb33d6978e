"""Set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pressline.functions.vectors import jaccard
from pressline.operators.ranking import latest_per_key


def union_ranked(streams: Sequence[DataFrame], key: str, order: Sequence[Column]) -> DataFrame:
    """All candidates, the best row per key."""
    return latest_per_key(reduce(DataFrame.unionByName, streams), [key], order)


def union_ids(tables: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """U2."""
    return reduce(DataFrame.unionByName, [t.select(key) for t in tables]).distinct()


def union_filters(df: DataFrame, *filters: Column) -> DataFrame:
    """Rows that pass any filter, in one scan."""
    return df.filter(reduce(lambda a, b: a | b, filters))


def union_limited(parts: Sequence[tuple[DataFrame, Sequence[Column], int]]) -> DataFrame:
    """U4: the head of every part, in part order (column ``part``)."""
    heads = [df.orderBy(*order).limit(n).withColumn("part", F.lit(i + 1)) for i, (df, order, n) in enumerate(parts)]
    return reduce(DataFrame.unionByName, heads)


def top_up(df: DataFrame, primary: Column, order: Sequence[Column], limit: int) -> DataFrame:
    """Primary rows first, filled up from the others, in one pass."""
    tiered = df.withColumn("tier", F.when(primary, 0).otherwise(1))
    return tiered.orderBy("tier", *order).limit(limit)


def difference(known: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Keys of ``known`` that ``other`` lacks, e.g. folders without a record."""
    return known.select(key).distinct().join(other.select(key), key, "left_anti")


def jaccard_sets(df: DataFrame, a: str, b: str) -> DataFrame:
    """U7."""
    return df.withColumn("jaccard", jaccard(F.array_distinct(a), F.array_distinct(b)))
