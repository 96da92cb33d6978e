"""Connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pressline.session import cut_lineage

TASK_EDGES = 1 << 14  # edges of a task when an edge set is small
LEAST_TASKS = 4
ONE_TASK_EDGES = 1 << 18  # whole-number edges up to here are labelled by one task; more are contracted in rounds


def _state(edges: DataFrame):
    """A fingerprint of an edge set; two equal sets have equal fingerprints."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("h")).first()
    return row["n"], row["h"]


def _tasks(edges: DataFrame, count: int):
    """A function that gives a table about ``count`` edges long as few partitions as it needs.

    A round has several shuffles, each of which leaves files for every task that writes it. A
    small set in as many tasks as the session's default would leave more files than rows; a
    large one keeps them all.
    """
    wanted = max(LEAST_TASKS, -(-count // TASK_EDGES))
    if wanted >= int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return lambda df: df
    return lambda df: df.coalesce(wanted)


def smallest_connected(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex connected to each of the vertices 0 to n - 1."""
    label = np.arange(n)
    while len(src):
        low = np.minimum(label[src], label[dst])
        np.minimum.at(label, label[src], low)
        np.minimum.at(label, label[dst], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[src] != label[dst]
        src, dst = src[apart], dst[apart]
    return label


def _labelled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    edges = list(parts)
    if edges:
        whole = pd.concat(edges, ignore_index=True)
        ids, place = np.unique(np.concatenate([whole["src"], whole["dst"]]), return_inverse=True)
        label = smallest_connected(place[: len(whole)], place[len(whole) :], len(ids))
        yield pd.DataFrame({"id": ids, "component": ids[label]})


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every vertex of an edge; the component is its smallest id.

    Alternates two contractions: every vertex points its larger neighbours to its
    smallest neighbour, then keeps one edge per smaller neighbour. Long chains halve
    per round, so the rounds grow with the logarithm of the component size. Neighbour
    lists are never collected: each step is a minimum per vertex and a join.
    Ends when a round changes nothing, which the halving makes certain. Up to
    ``ONE_TASK_EDGES`` edges need no rounds: one task labels them.
    """
    pairs = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    current = cut_lineage(pairs.filter("src <> dst").distinct())
    known = _state(current)
    kind = current.schema["src"].dataType.simpleString()
    if known[0] <= ONE_TASK_EDGES and kind in ("int", "bigint"):
        return current.coalesce(1).mapInPandas(_labelled, f"id {kind}, component {kind}")
    few = _tasks(current, known[0])
    current = few(current)
    while known[0]:
        both = current.unionByName(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        smallest = few(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m")))
        large = few(
            few(both.filter("dst > src").join(smallest, "src"))
            .select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        )
        lowest = few(large.groupBy("src").agg(F.min("dst").alias("m")))
        small = few(large.join(lowest, "src")).select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst")
        current = cut_lineage(few(small.unionByName(lowest.withColumnRenamed("m", "dst")).distinct()))
        state = _state(current)
        if state == known:
            break
        known = state
    labels = current.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    roots = current.select(F.col("dst").alias("id"), F.col("dst").alias("component"))
    return few(labels.unionByName(roots).distinct())


def extended_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)`` after new ``edges`` (``src``, ``dst``) joined what ``labels`` held apart.

    Old components are contracted to one vertex each, so the search runs over the new edges
    alone; the stored labels are read in two joins. Only labels of components that were joined
    change. Vertices of an edge that have no label yet are components of their own before it.
    Ids of ``labels`` are distinct and ``component`` is the smallest id of each.
    """
    known = labels.select("id", "component")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    touched = cut_lineage(ends.join(known, "id", "left").select("id", F.coalesce("component", "id").alias("old"), F.col("component").isNull().alias("fresh")))
    side = lambda name: touched.select(F.col("id").alias(name), F.col("old").alias(f"{name}_old"))
    contracted = edges.join(side("src"), "src").join(side("dst"), "dst").select(F.col("src_old").alias("src"), F.col("dst_old").alias("dst"))
    joined = cut_lineage(connected_components(contracted).select(F.col("id").alias("old"), F.col("component").alias("new")))
    moved = joined.filter("old <> new").select(F.col("old").alias("component"), "new")
    kept = known.join(moved, "component", "left").select("id", F.coalesce("new", "component").alias("component"))
    added = touched.filter("fresh").join(joined, "old", "left").select("id", F.coalesce("new", "old").alias("component"))
    return kept.unionByName(added)
