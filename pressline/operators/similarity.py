"""Exact vector matching by blocks.

Vectors of both sides are cut into blocks of bounded size; a pair of blocks is one matrix
product in one task. A block emits only its best rows or a spanning forest of its matches,
never all pairs. The number of blocks follows from the row counts, so no task grows with the
data.

:func:`compare_blocks` compares all pairs of blocks. :func:`compare_near` is given the least
cosine that matters and skips pairs of blocks that cannot reach it. Angles are a metric: with
the angles of a row to a few pivots known, the angle between two rows is at least the largest
difference of their angles to one pivot. Blocks hold rows of one nearest pivot and of similar
angles to it, so a block is described by the least and greatest angle to every pivot, and most
pairs of blocks are excluded by these numbers alone where the vectors form clusters.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pressline.operators.graph import smallest_connected
from pressline.session import cut_lineage

BLOCK_ROWS = 4096
NEAR_ROWS = 1024  # rows of a block where pairs of blocks are skipped: small blocks are tighter
PIVOTS = 32
PIVOT_SAMPLE = 1024  # rows of each side that pivots are chosen from
WORTH_BLOCKS = 16  # blocks of the larger side from which on skipping pays for its own steps
WORTH_SHARE = 0.5  # share of the pairs of blocks up to which the rest is worth skipping
_LOOSE = 1e-6  # radians; rounding of angles never excludes a pair
STRIP_ROWS = 512  # rows of a block that are compared at once; bounds the dense matrices of a task


def _blocked(df: DataFrame, id_column: str, rows: int, block: str, blocks: str) -> DataFrame:
    """Spread rows over blocks: column ``block``, with the number of blocks in ``blocks``."""
    size = F.ceil(F.count(F.lit(1)) / rows).cast("int")
    if "cell" in df.columns:
        counted = df.join(df.groupBy("cell").agg(size.alias(blocks)), "cell")
    else:
        counted = df.withColumn(blocks, df.agg(size).scalar())
    return counted.withColumn(block, F.pmod(F.xxhash64(F.col(id_column)), F.col(blocks)).cast("int"))


def _copied(df: DataFrame, own: str, other: DataFrame, block: str, blocks: str) -> DataFrame:
    """One copy of every row per block of the other side; none where that side is empty."""
    bare = df.drop(own)
    if "cell" in df.columns:
        met = bare.join(other.select("cell", blocks).distinct(), "cell")
    else:
        met = bare.withColumn(blocks, other.agg(F.coalesce(F.max(blocks), F.lit(0))).scalar()).filter(F.col(blocks) > 0)
    return met.withColumn(block, F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))).drop(blocks)


def compare_blocks(
    left: DataFrame, right: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
    left_id: str, right_id: str, rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply ``compare`` to every pair of blocks.

    When both sides carry a ``cell`` column, rows of different cells never meet.
    """
    a = _blocked(left, left_id, rows, "block_l", "n_l")
    b = _blocked(right, right_id, rows, "block_r", "n_r")
    keys = [*(["cell"] if "cell" in left.columns else []), "block_l", "block_r"]
    spread_a = _copied(a, "n_l", b, "block_r", "n_r")
    spread_b = _copied(b, "n_r", a, "block_l", "n_l")
    # Both sides may come from one table: fresh aliases tell their columns apart.
    spread_b = spread_b.select(*[F.col(name).alias(name) for name in spread_b.columns])
    return spread_a.groupBy(*keys).cogroup(spread_b.groupBy(*keys)).applyInPandas(striped(compare), schema)


def choose_pivots(vectors: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Vectors far from each other: each next one has the greatest angle to those before."""
    chosen = [0]
    nearest = vectors @ vectors[0]
    while len(chosen) < n and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    return vectors[chosen]


def _sample(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    return df.select(F.col(vector).alias("v"), F.xxhash64(F.col(id_column)).alias("h")).orderBy("h").limit(PIVOT_SAMPLE).select("v")


def pivots_of(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_vector: str, right_vector: str, rows: int
) -> np.ndarray | None:
    """Pivots from a bounded sample of both sides, one per four blocks; None where the sides are too small to skip anything."""
    a, b = left.agg(F.count(F.lit(1)).alias("n")), right.agg(F.count(F.lit(1)).alias("n"))
    most = a.unionByName(b).agg(F.max("n")).first()[0]
    if most < WORTH_BLOCKS * rows:
        return None
    sample = _sample(left, left_id, left_vector).unionByName(_sample(right, right_id, right_vector)).toPandas()
    units = unit_rows(sample["v"])
    units = units[np.linalg.norm(units, axis=1) > 0]
    return choose_pivots(units, int(min(PIVOTS, most // (4 * rows)))) if len(units) else None


def _angles(pivots: np.ndarray):
    @F.pandas_udf("array<double>")
    def angles(vectors: pd.Series) -> pd.Series:
        units = unit_rows(vectors)
        found = np.arccos(np.clip(units @ pivots.T, -1, 1))
        zero = ~units.any(axis=1)  # a vector of zeros has no direction
        return pd.Series([None if z else row for z, row in zip(zero, found)])

    return angles


def with_blocks(df: DataFrame, id_column: str, vector: str, pivots: np.ndarray, rows: int) -> DataFrame:
    """Add ``angles`` to the pivots, the nearest ``pivot`` and the ``block`` (a struct) of every row.

    Rows of a pivot are counted per degree of their angle to it; a block takes degrees until it
    is full, and a degree with more rows than a block is split by a hash. Vectors of zeros have
    blocks of their own, pivot -1.
    """
    cell = ["cell"] if "cell" in df.columns else []
    own = F.array_min("angles")
    placed = df.withColumn("angles", _angles(pivots)(F.col(vector)))
    placed = placed.withColumn("pivot", F.coalesce(F.array_position("angles", own) - 1, F.lit(-1)).cast("int"))
    placed = cut_lineage(placed.withColumn("degree", F.coalesce(F.floor(F.degrees(own)), F.lit(-1)).cast("int")))
    counts = placed.groupBy(*cell, "pivot", "degree").agg(F.count(F.lit(1)).alias("_n"))
    # 181 degrees of a pivot at most.
    before = F.sum("_n").over(Window.partitionBy(*cell, "pivot").orderBy("degree")) - F.col("_n")
    plan = counts.select(*cell, "pivot", "degree", F.floor(before / rows).alias("_part"), F.ceil(F.col("_n") / rows).alias("_parts"))
    keys = [*cell, "pivot", "degree"]
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    split = F.pmod(F.xxhash64(F.col(f"l.{id_column}")), F.col("r._parts"))
    block = F.struct(F.col("l.pivot").alias("pivot"), F.col("r._part").alias("part"), split.alias("split"))
    return placed.alias("l").join(plan.alias("r"), same).select("l.*", block.alias("block")).drop("degree")


def _bounds(blocked: DataFrame, pivots: int) -> DataFrame:
    """One row per block: the least and greatest angle to every pivot; all angles for vectors of zeros."""
    cell = ["cell"] if "cell" in blocked.columns else []
    angle = lambda k: F.get("angles", F.lit(k))
    lo = F.array(*[F.coalesce(F.min(angle(k)), F.lit(0.0)) for k in range(pivots)])
    hi = F.array(*[F.coalesce(F.max(angle(k)), F.lit(np.pi)) for k in range(pivots)])
    return blocked.groupBy(*cell, "block").agg(lo.alias("lo"), hi.alias("hi"))


def _reachable(angle: float) -> Column:
    """Whether rows of two blocks can be within ``angle``: no pivot keeps them further apart."""
    apart = F.zip_with(
        F.arrays_zip(F.col("lo_l").alias("lo"), F.col("hi_l").alias("hi")), F.arrays_zip(F.col("lo_r").alias("lo"), F.col("hi_r").alias("hi")),
        lambda a, b: F.greatest(a["lo"] - b["hi"], b["lo"] - a["hi"]),
    )
    return F.array_max(apart) <= angle + _LOOSE


def block_pairs(left: DataFrame, right: DataFrame, pivots: int, least: float) -> DataFrame:
    """Pairs of blocks (``block_l``, ``block_r``) of one cell that can hold a cosine of ``least``.

    Whole pivots are compared first, a bounded table, so that blocks only meet those of pivots
    in reach.
    """
    angle = float(np.arccos(np.clip(least, -1, 1)))
    named = lambda df, side: df.select(*[F.col(c).alias(c if c == "cell" else f"{c}_{side}") for c in df.columns])
    a, b = named(_bounds(left, pivots), "l"), named(_bounds(right, pivots), "r")

    def whole(df: DataFrame, side: str) -> DataFrame:
        part = lambda f, name: F.array(*[f(F.get(f"{name}_{side}", F.lit(k))) for k in range(pivots)]).alias(f"{name}_{side}")
        return df.groupBy(F.col(f"block_{side}.pivot").alias(f"pivot_{side}")).agg(part(F.min, "lo"), part(F.max, "hi"))

    # PIVOTS + 1 rows on either side.
    near = F.broadcast(whole(a, "l")).join(whole(b, "r"), _reachable(angle)).select("pivot_l", "pivot_r")
    met = a.join(F.broadcast(near), F.col("block_l.pivot") == F.col("pivot_l"))
    same = F.col("pivot_r") == F.col("block_r.pivot")
    if "cell" in left.columns:
        met, b, same = met.withColumnRenamed("cell", "cell_l"), b.withColumnRenamed("cell", "cell_r"), same & F.col("cell_l").eqNullSafe(F.col("cell_r"))
    pairs = met.join(b, same).filter(_reachable(angle))
    return pairs.select(*([F.col("cell_l").alias("cell")] if "cell" in left.columns else []), "block_l", "block_r")


def compare_near(
    left: DataFrame, right: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
    left_id: str, right_id: str, left_vector: str, right_vector: str, least: float, rows: int = NEAR_ROWS,
) -> DataFrame:
    """Apply ``compare`` to the pairs of blocks that can hold a cosine of ``least`` or more.

    The result is that of :func:`compare_blocks` for every ``compare`` whose results rest on
    pairs of at least that cosine only. Null vectors are not allowed. Where neither side fills
    ``WORTH_BLOCKS`` blocks, or pivots skip less than half of the pairs, all pairs are compared.
    """
    pivots = pivots_of(left, right, left_id, right_id, left_vector, right_vector, rows)
    if pivots is None:
        return compare_blocks(left, right, compare, schema, left_id, right_id)
    a, b = with_blocks(left, left_id, left_vector, pivots, rows), with_blocks(right, right_id, right_vector, pivots, rows)
    pairs = cut_lineage(block_pairs(a, b, len(pivots), least))
    cell = ["cell"] if "cell" in left.columns else []
    blocks = lambda df, name: df.groupBy(*cell).agg(F.countDistinct("block").alias(name))
    met = blocks(a, "n_l").join(blocks(b, "n_r"), cell) if cell else blocks(a, "n_l").crossJoin(blocks(b, "n_r"))
    # Every row is copied to each block it meets: small blocks pay only where most pairs are skipped.
    if pairs.count() > WORTH_SHARE * met.agg(F.coalesce(F.sum(F.col("n_l") * F.col("n_r")), F.lit(0))).first()[0]:
        return compare_blocks(left, right, compare, schema, left_id, right_id)

    def copied(df: DataFrame, side: str) -> DataFrame:
        met = df.drop("angles", "pivot").withColumnRenamed("block", f"block_{side}")
        keys = [*cell, f"block_{side}"]
        renamed = pairs.select(*[F.col(c).alias(f"_{c}") for c in pairs.columns])
        same = F.lit(True)
        for key in keys:
            same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
        other = "block_r" if side == "l" else "block_l"
        return met.join(renamed, same).select(*[F.col(c).alias(c) for c in met.columns], F.col(f"_{other}").alias(other))

    keys = [*cell, "block_l", "block_r"]
    return copied(a, "l").groupBy(*keys).cogroup(copied(b, "r").groupBy(*keys)).applyInPandas(striped(compare), schema)


def striped(compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Compare a few left rows at a time, so that a task holds no matrix of a whole block pair."""

    def compare_strips(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) <= STRIP_ROWS:
            return compare(left, right)
        strips = [compare(left.iloc[at : at + STRIP_ROWS].reset_index(drop=True), right) for at in range(0, len(left), STRIP_ROWS)]
        found = [strip for strip in strips if len(strip)]
        return pd.concat(found, ignore_index=True) if found else strips[0]

    return compare_strips


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of length one; zero vectors stay zero."""
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _shared_names(left: pd.Series, right: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """How many names every left set has in common with every right set, and the sizes of both together."""
    where: dict[str, list[int]] = {}
    for at, names in enumerate(right):
        for name in names:
            where.setdefault(name, []).append(at)
    found = {name: np.array(places) for name, places in where.items()}
    shared = np.zeros((len(left), len(right)), dtype=np.int32)
    for at, names in enumerate(left):
        for name in names:
            if name in found:
                shared[at, found[name]] += 1
    return shared, np.array([len(n) for n in left])[:, None] + np.array([len(n) for n in right])[None, :]


def jaccard_matrix(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Set similarity of every left set with every right set; 0 where one is empty."""
    shared, sizes = _shared_names(left, right)
    total = sizes - shared
    return np.divide(shared, total, out=np.zeros(shared.shape), where=(total > 0) & (shared > 0))


def jaccard_pairs(left: pd.Series, right: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left place, right place and similarity of the pairs of sets that share a name."""
    shared, sizes = _shared_names(left, right)
    i, j = np.nonzero(shared)
    common = shared[i, j]
    return i, j, common / (sizes[i, j] - common)


def forest(linked: np.ndarray, left_ids: np.ndarray, right_ids: np.ndarray) -> pd.DataFrame:
    """Edges that connect what ``linked`` connects, at most one per row and column."""
    i, j = np.nonzero(linked)
    n = linked.shape[0]
    label = smallest_connected(i, n + j, n + linked.shape[1])
    rows, columns = np.unique(i), np.unique(j)
    src = np.concatenate([left_ids[rows], right_ids[columns]])
    dst = np.concatenate([left_ids[label[rows]], left_ids[label[n + columns]]])
    edges = pd.DataFrame({"src": src, "dst": dst})
    return edges[edges.src != edges.dst].drop_duplicates()
