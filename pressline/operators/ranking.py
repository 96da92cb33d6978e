"""Ranking, top-k, sessions and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

FRESHNESS = ("scraped_at", "id")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every key.

    The ``rank <= n`` filter lets Spark keep only n rows per key and input partition
    before the shuffle, so a key that holds most rows does not reach one task whole.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first under ``order``."""
    return top_n(df, keys, order, 1, rank="_rank").drop("_rank")


def rank_all(
    df: DataFrame, keys: Sequence[str], coarse: Sequence[tuple[str, bool]], order: Sequence[Column], rank: str = "rank",
    depths: DataFrame | None = None,
) -> DataFrame:
    """Position of every row inside its key, for keys of any size.

    ``coarse`` names columns (with True for descending) that are a leading, coarsened
    part of ``order``, e.g. the day of a timestamp. Rows are numbered inside
    (key, coarse) cells and shifted by the sizes of the earlier cells, so the largest
    sort is one cell, not one key. With ``depths`` (the keys and ``depth``) only the first
    positions of a key are kept, as many as its depth; keys without one are left out, and cells
    that start beyond it are dropped before any row is sorted.
    """
    cell = [name for name, _ in coarse]
    sizes = df.groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias("_size"))
    directions = [F.desc(name) if descending else F.asc(name) for name, descending in coarse]
    before = Window.partitionBy(*keys).orderBy(*directions).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    if depths is not None:
        wanted = depths.select(*keys, F.col("depth").alias("_depth"))
        offsets = offsets.join(wanted, list(keys)).filter(F.col("_offset") < F.col("_depth"))
    condition = F.lit(True)
    for name in [*keys, *cell]:
        condition = condition & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
    carried = ["r._offset"] if depths is None else ["r._offset", "r._depth"]
    placed = df.alias("l").join(offsets.alias("r"), condition).select("l.*", *carried)
    inside = Window.partitionBy(*keys, *cell).orderBy(*order)
    ranked = placed.withColumn(rank, F.row_number().over(inside) + F.col("_offset")).drop("_offset")
    return ranked if depths is None else ranked.filter(F.col(rank) <= F.col("_depth")).drop("_depth")


def list_depths(requests: DataFrame) -> DataFrame:
    """``list, depth``: how deep the neediest owner of each list goes; the lists nobody asks for are not there."""
    asked = requests.select("need", F.explode(F.array_distinct("lists")).alias("list"))
    return asked.groupBy("list").agg(F.max("need").alias("depth"))


def ranked_places(
    base: DataFrame, lists: Sequence[Column], coarse: Sequence[tuple[str, bool]], order: Sequence[Column], keep: Sequence[str], depths: DataFrame
) -> DataFrame:
    """Every row once per named list, with its position there: ``(list, pos, ...keep)``.

    ``lists`` are string columns that name the lists a row belongs to; positions beyond a
    list's own depth (:func:`list_depths`) are left out.
    """
    member = base.withColumn("list", F.explode(F.array(*lists)))
    ranked = rank_all(member, ["list"], coarse, order, rank="pos", depths=depths)
    return ranked.select("list", F.col("pos").cast("int").alias("pos"), *keep)


def pick_places(requests: DataFrame, places: DataFrame, owner: str) -> DataFrame:
    """The first ``need`` rows of each of an owner's ``lists``, each row once per owner.

    Rows are looked up by (list, position), so the work is the number of places asked
    for. ``requests`` is ``(owner, need, lists)``.
    """
    wanted = requests.select(owner, "need", F.explode(F.array_distinct("lists")).alias("list")).select(
        owner, "list", F.explode(F.sequence(F.lit(1), F.col("need").cast("int"))).alias("pos")
    )
    return wanted.join(places, ["list", "pos"]).drop("list", "pos").dropDuplicates([owner, "id"])


def gap_sessions(
    df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int, break_at_gap: bool = False
) -> DataFrame:
    """Number the runs of rows whose neighbours lie at most ``gap_seconds`` apart.

    With ``break_at_gap`` a distance of exactly the gap already starts a new run.
    Time is cut into cells one gap wide. Rows of one cell always belong together, so
    only the first and last time of each cell are compared, not the rows: a key with
    many rows costs one row per cell, and no task sees the whole key.
    Adds ``session_no`` (from 1, in time order) and ``session_start``.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = gap_seconds * 1_000_000
    tagged = df.filter(F.col(ts).isNotNull()).withColumn("_cell", F.floor(micros / gap))
    cells = tagged.groupBy(*keys, "_cell").agg(F.min(micros).alias("_lo"), F.max(micros).alias("_hi"))
    window = Window.partitionBy(*keys).orderBy("_cell")
    distance = F.col("_lo") - F.lag("_hi").over(window)
    apart = distance >= gap if break_at_gap else distance > gap
    starts = F.when(distance.isNull() | apart, 1).otherwise(0)
    numbered = cells.withColumn("_new", starts).withColumn("session_no", F.sum("_new").over(window))
    first = F.min("_lo").over(Window.partitionBy(*keys, "session_no"))
    sessions = numbered.withColumn("session_start", F.timestamp_micros(first)).drop("_lo", "_hi", "_new")
    condition = F.col("l._cell") == F.col("r._cell")
    for key in keys:
        condition = condition & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    joined = tagged.alias("l").join(sessions.alias("r"), condition)
    return joined.select("l.*", "r.session_no", "r.session_start").drop("_cell")


def session_summary(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int, break_at_gap: bool = False) -> DataFrame:
    """Size and span of every run found by :func:`gap_sessions`."""
    sessions = gap_sessions(df, keys, ts, gap_seconds, break_at_gap)
    return sessions.groupBy(*keys, "session_no").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at")
    )


def first_seen(df: DataFrame, keys: Sequence[str], value: str, position: Sequence[Column]) -> DataFrame:
    """Distinct values per key in the order they are first met."""
    once = latest_per_key(df, [*keys, value], position)
    return once


def card_image(links: DataFrame, articles: DataFrame) -> DataFrame:
    """The picture of the most relevant member that has one."""
    pictured = articles.filter(F.coalesce(F.col("image_url"), F.lit("")) != "").select(
        F.col("id").alias("article_id"), "image_url"
    )
    best = F.max_by("image_url", F.struct("relevance_score", -F.col("article_id")))
    return links.join(pictured, "article_id").groupBy("story_id").agg(best.alias("card_image_url"))


# --- fixed values: queue priorities from lowest to highest ---
QUEUE_PRIORITIES = ["low", "normal", "high", "urgent"]


# Widths in microseconds of the cells in which a queue is counted: day, minute, second, millisecond, microsecond.
_QUEUE_CELLS = (86_400_000_000, 60_000_000, 1_000_000, 1_000, 1)


def queue_position(queue: DataFrame) -> DataFrame:
    """One plus the queued tasks of equal or higher priority that were queued earlier.

    Tasks are counted per level and microsecond, and the counts are added up in a hierarchy
    of cells. A running total covers the days, or the few parts of one cell: 1440 at most.
    """
    level = F.array_position(F.array(*[F.lit(p) for p in QUEUE_PRIORITIES]), F.col("priority"))
    waiting = queue.filter(F.col("status") == "queued").withColumn("_level", level).withColumn("_at", F.unix_micros("queued_at"))
    levels = range(1, len(QUEUE_PRIORITIES) + 1)
    counts = waiting.groupBy("_at").agg(*[F.count_if(F.col("_level") >= n).alias(f"_n{n}") for n in levels])
    before = None
    for width, parent in zip(_QUEUE_CELLS, (None, *_QUEUE_CELLS)):
        cell = F.floor(F.col("_at") / width).alias("_cell")
        outer = F.lit(0).alias("_outer") if parent is None else F.floor(F.col("_at") / parent).alias("_outer")
        sums = counts.groupBy(outer, cell).agg(*[F.sum(f"_n{n}").alias(f"_n{n}") for n in levels])
        earlier = Window.partitionBy("_outer").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        here = sums.select("_outer", "_cell", *[F.coalesce(F.sum(f"_n{n}").over(earlier), F.lit(0)).alias(f"_o{n}") for n in levels])
        if before is None:
            before = here.drop("_outer")
        else:
            above = before.select(F.col("_cell").alias("_outer"), *[F.col(f"_o{n}").alias(f"_b{n}") for n in levels])
            before = here.join(above, "_outer").select("_cell", *[(F.col(f"_o{n}") + F.col(f"_b{n}")).alias(f"_o{n}") for n in levels])
    counted = waiting.join(before.withColumnRenamed("_cell", "_at"), "_at")
    position = F.lit(None).cast("bigint")
    for n in levels:
        position = F.when(F.col("_level") == n, F.col(f"_o{n}") + 1).otherwise(position)
    return counted.withColumn("position", position).select("id", "priority", "queued_at", "position")


def freshness_order(prefix: str = "") -> list[Column]:
    """L1: newest scrape first, then highest id."""
    return [F.desc(f"{prefix}scraped_at"), F.desc(f"{prefix}id")]


def intelligence_order() -> list[Column]:
    """L4: breaking, importance, follow-up, then freshness."""
    return [
        F.desc_nulls_first("is_breaking_candidate"), F.desc_nulls_first("importance_score"),
        F.desc_nulls_first("follow_up_worthy"), *freshness_order(),
    ]


_PLACE_UNITS = ("month", "day", "hour", "second")


def global_positions(
    df: DataFrame, order: Sequence[Column], by_time: str, leading: Sequence[str] = (), position: str = "position"
) -> DataFrame:
    """L1/L4: the place of every row in a descending order over the whole table.

    The order is ``leading`` columns, then the time ``by_time``, then anything. Rows are counted
    per second and the counts added up in a hierarchy of months, days, hours and seconds: a
    running total covers the parts of one cell, and no task numbers more rows than one second
    of one combination of leading values holds.
    """
    cells = [f"_{unit}" for unit in _PLACE_UNITS]
    celled = df.withColumns({cell: F.date_trunc(unit, by_time) for cell, unit in zip(cells, _PLACE_UNITS)})
    finest = celled.groupBy(*leading, *cells).agg(F.count(F.lit(1)).alias("_n"))

    def matched(left, right, names):
        condition = F.lit(True)
        for name in names:
            condition = condition & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
        extra = [c for c in right.columns if c not in names]
        return left.alias("l").join(right.alias("r"), condition).select("l.*", *[f"r.{c}" for c in extra])

    before = None
    for level, cell in enumerate(cells):
        keys = [*leading, *cells[: level + 1]]
        sums = finest.groupBy(*keys).agg(F.sum("_n").alias("_n"))
        if before is None:  # one row per month and leading values in one task
            earlier = Window.orderBy(*[F.desc_nulls_first(c) for c in leading], F.desc(cell))
        else:
            earlier = Window.partitionBy(*keys[:-1]).orderBy(F.desc(cell))
        own = F.coalesce(F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        here = sums.select(*keys, own.alias("_before"))
        if before is not None:
            above = before.withColumnRenamed("_before", "_above")
            here = matched(here, above, keys[:-1]).select(*keys, (F.col("_before") + F.col("_above")).alias("_before"))
        before = here
    placed = matched(celled, before, [*leading, *cells])
    inside = F.row_number().over(Window.partitionBy(*leading, *cells).orderBy(*order))
    return placed.withColumn(position, inside + F.col("_before")).drop(*cells, "_before")


def page_after(df: DataFrame, last: dict[str, Column], size: int) -> DataFrame:
    """L2 by key: the ``size`` rows that follow the row with the values ``last``.

    ``last`` names the columns of a descending order, the last of them unique, with the
    values of the last row shown. Deep pages cost no more than the first.
    """
    names = list(last)
    beyond, equal = F.lit(False), F.lit(True)
    for name in names:
        beyond = beyond | (equal & (F.col(name) < last[name]))
        equal = equal & (F.col(name) == last[name])
    return df.filter((F.col(names[0]) <= last[names[0]]) & beyond).orderBy(*[F.desc(n) for n in names]).limit(size)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """L2: one page of a sorted table with the paging facts on every row."""
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    pages = F.greatest(F.lit(1), F.ceil(F.col("total_count") / size))
    return rows.withColumn("total_count", df.agg(F.count(F.lit(1))).scalar()).withColumns(
        {
            "total_pages": pages.cast("int"),
            "has_next": F.lit(number) < pages,
            "has_previous": F.lit(number > 1),
        }
    )
