"""Mixing sources to target weights (3): Poisson replication.

A source that should make up more of the mix than it does is repeated, one that should make
up less is thinned. Its rate is the mean number of copies of each of its documents. Every
document draws its own number of copies from a Poisson distribution with that mean, by
inverting the distribution at a uniform value hashed from a seed and the document's id, so
the draw needs no state and is the same on every run. A high rate is drawn as a sum of
independent draws of equal rates. Copies are then shuffled globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressline.llm.columns import as_before, set_aside
from pressline.llm.store import stored

SEED = "mix-1"
ALPHA = 0.5
BROADCAST_SOURCES = 5000  # up to this many distributions, a few MB, travel to every task; more are joined
DRAW_RATE = 700  # highest rate of one draw: exp(-rate) keeps its full precision
_CELL_BITS = 40  # positions are counted in 2**12 parts of the hash range of 2**52


def _uniform(*parts: Column) -> Column:
    """A whole number below 2**52 from an MD5 hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 13), 16, 10).cast("long")


def tempered_weights(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``source, weight, size``: weights in proportion to the bytes of a source to the power ``alpha``."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    total = sizes.agg(F.sum(F.pow(F.col("size").cast("double"), F.lit(alpha)))).scalar()
    return sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(alpha)) / total)


def repetition_rates(weights: DataFrame, budget: float = 1.0) -> DataFrame:
    """``source, rate``: mean copies that bring each source to its share of ``budget`` times the corpus."""
    total = weights.agg(F.sum("size")).scalar().cast("double")
    share = F.col("weight") / weights.agg(F.sum("weight")).scalar()
    return weights.select("source", F.when(F.col("size") > 0, F.lit(budget) * total * share / F.col("size")).otherwise(F.lit(0.0)).alias("rate"))


def _distribution(rate: Column) -> Column:
    """The cumulative Poisson probabilities of 0, 1, 2, … copies, past all that a draw can tell from 1."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    steps = F.aggregate(
        F.sequence(F.lit(1), most), start,
        lambda acc, k: F.struct(
            (acc["p"] * rate / k).alias("p"),
            F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * rate / k)).alias("c"),
        ),
    )
    return steps["c"]


def replicate(docs: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with each row repeated as drawn, and columns ``_copy`` and ``_key``.

    ``rates`` has one row per source, a null source included; a source without a rate is left
    out of the mix. ``_copy`` counts the copies of a row from 0 and ``_key`` is its place in
    the global shuffle, below 2**52. Rates above ``DRAW_RATE`` are split into equal parts, each
    drawn from a hash of its own.
    """
    parts = F.greatest(F.ceil(F.col("rate") / DRAW_RATE).cast("int"), F.lit(1))
    known = stored(rates.select(F.col("source").alias("_source"), _distribution(F.col("rate") / parts).alias("_c"), parts.alias("_parts")))
    if known.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    drawn = _uniform(F.lit(seed), name) / float(1 << 52)
    further = F.transform(
        F.sequence(F.lit(1), F.col("_parts") - 1), lambda k: _uniform(F.lit(seed), F.lit("part"), k.cast("string"), name) / float(1 << 52)
    )
    joined = docs.join(known, docs["source"].eqNullSafe(known["_source"])).withColumn("_u", drawn)
    joined = joined.withColumn("_us", F.when(F.col("_parts") > 1, further))
    copies = F.size(F.filter("_c", lambda c: c <= F.col("_u")))
    rest = F.aggregate("_us", F.lit(0), lambda n, u: n + F.size(F.filter("_c", lambda c: c <= u)))
    counted = joined.withColumn("_n", copies + F.coalesce(rest, F.lit(0))).filter("_n > 0").drop("_source", "_c", "_parts", "_u", "_us")
    spread = counted.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    key = _uniform(F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("_copy").cast("string"))
    return spread.withColumn("_key", key)


def shuffled(mixed: DataFrame) -> DataFrame:
    """Rows in the order of their keys over all partitions."""
    return mixed.repartitionByRange("_key", "_copy").sortWithinPartitions("_key", "_copy")


def positions(mixed: DataFrame) -> DataFrame:
    """Add ``position``, the gapless place of every row in the global order.

    Rows are counted per part of the hash range and numbered inside it; ties of a key are
    ordered by id and copy.
    """
    celled = mixed.withColumn("_cell", F.shiftright("_key", _CELL_BITS))
    counts = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_cell", (F.sum("_n").over(Window.orderBy("_cell")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy("_key", "doc_id", "_copy")) - 1
    # One row per part of the range: 4096 rows at most.
    return celled.withColumn("_at", inside).join(F.broadcast(before), "_cell").withColumn("position", F.col("_before") + F.col("_at")).drop("_cell", "_at", "_before")


def mix(docs: DataFrame, rates: DataFrame | None = None, budget: float = 1.0, alpha: float = ALPHA, seed: str = SEED) -> DataFrame:
    """The mixed corpus with the columns of ``docs``, in shuffled order.

    Without ``rates`` the target weights are the tempered ones of :func:`tempered_weights`.
    A null text has no bytes; a source of such texts alone gets rate 0. Repeated rows and rows
    without an id draw the same number of copies as each other. An empty table stays empty.
    """
    own = ("doc_id", "source")
    known = repetition_rates(tempered_weights(docs, alpha), budget) if rates is None else rates
    return as_before(shuffled(replicate(set_aside(docs, *own), known, seed)), docs, *own)
