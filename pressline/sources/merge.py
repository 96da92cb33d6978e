"""Merging new rows into stored tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from pressline.operators.ranking import latest_per_key
from pressline.session import cut_lineage


def insert_if_absent(new: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The new rows to add: keys not on record, one row (the first) per key."""
    absent = new.join(existing.select(*keys), list(keys), "left_anti")
    return latest_per_key(absent, list(keys), order)


def upsert(new: DataFrame, existing: DataFrame, keys: Sequence[str], keep_filled: Sequence[str], replace: Sequence[str]) -> DataFrame:
    """The table after the update.

    ``keep_filled`` columns take the new value unless it is empty, ``replace`` columns
    always when the key is among the new rows. Both sides have one row per key.
    """
    marked = new.withColumn("_new", F.lit(True)).alias("n")
    stored = existing.withColumn("_old", F.lit(True)).alias("o")
    condition = None
    for key in keys:
        match = F.col(f"n.{key}").eqNullSafe(F.col(f"o.{key}"))
        condition = match if condition is None else condition & match
    joined = stored.join(marked, condition, "full_outer")
    changed = F.col("n._new").isNotNull()

    def filled(name):
        value = F.col(f"n.{name}")
        given = value.isNotNull() & (value.cast("string") != "")
        return F.when(given, value).otherwise(F.col(f"o.{name}")).alias(name)

    columns = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys]
    columns += [filled(name) for name in keep_filled]
    columns += [F.when(changed, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name) for name in replace]
    change = F.when(F.col("o._old").isNull(), "added").when(changed, "updated").otherwise("kept")
    return joined.select(*columns, change.alias("change"))


def rewrite_changed(df: DataFrame, updates: dict[str, Column]) -> DataFrame:
    """Rows in which at least one recomputed column differs, with the new values."""
    fresh = df.withColumns({f"_new_{name}": value for name, value in updates.items()})
    differs = F.lit(False)
    for name in updates:
        differs = differs | ~F.col(name).eqNullSafe(F.col(f"_new_{name}"))
    changed = fresh.filter(differs)
    return changed.withColumns({name: F.col(f"_new_{name}") for name in updates}).drop(*[f"_new_{name}" for name in updates])


DAY = "day"  # partition column of tables laid out by date
DAY_FILES = 8  # files of a day when a table is first laid out


def write_by_day(table: DataFrame, path: str, ts: str) -> None:
    """Lay a table out by the date of ``ts``; rows without one are in the partition of null."""
    part = F.pmod(F.xxhash64(*table.columns), F.lit(DAY_FILES))
    table.withColumn(DAY, F.to_date(ts)).repartition(DAY, part).write.partitionBy(DAY).mode("overwrite").parquet(path)


def write_observed(rows: DataFrame, figures: dict[str, Column], write: Callable[[DataFrame], None]) -> dict:
    """Run ``write(rows)`` and return the aggregates ``figures`` of what it wrote, without a second scan."""
    watched = Observation()
    write(rows.observe(watched, *[value.alias(name) for name, value in figures.items()]))
    return watched.get


def outcome_figures(outcome: str = "outcome") -> dict[str, Column]:
    """The counts of a run, from one row per handled article."""
    of = lambda kind: F.count_if(F.col(outcome) == kind)
    return {
        "articles_found": F.count(F.lit(1)), "articles_added": of("added"), "articles_updated": of("updated"), "articles_skipped": of("skipped"),
        "error_count": of("error"),
    }


def _overwrite_days(rows: DataFrame, path: str) -> None:
    """Replace the partitions that ``rows`` holds; files of all others keep their names and times."""
    rows.write.partitionBy(DAY).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _inside(days: Sequence) -> Column:
    """Rows of the listed days, null for rows without one; Spark reads these partitions only."""
    named = F.col(DAY).isin([day for day in days if day is not None])
    return named | F.col(DAY).isNull() if None in days else named


def upsert_by_day(new: DataFrame, path: str, ts: str, keys: Sequence[str], keep_filled: Sequence[str], replace: Sequence[str]) -> dict:
    """S8 on a table of :func:`write_by_day`: rewrite only the days that new rows touch.

    An update of a stored row stays in that row's partition, a new row goes to the date of its
    ``ts``. Of the rest of the table the key columns are read, and files of other days stay as
    they are. The same call again changes nothing more. Both sides have one row per key.
    Returns the rows ``added``, ``updated`` and ``kept`` in the written days, counted by the
    write itself.
    """
    stored = new.sparkSession.read.parquet(path)
    names = [*keys, DAY]
    places = stored.select(*[F.col(n).alias(f"_{n}") for n in names])
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    known = F.col(f"_{keys[0]}").isNotNull()
    placed = new.join(places, same, "left").withColumn(DAY, F.when(known, F.col(f"_{DAY}")).otherwise(F.to_date(ts)))
    arriving = cut_lineage(placed.drop(*[f"_{n}" for n in names]))
    days = [row[0] for row in arriving.select(DAY).distinct().collect()]  # one value per day touched
    figures = {kind: F.count_if(F.col("change") == kind) for kind in ("added", "updated", "kept")}
    if not days:
        return dict.fromkeys(figures, 0)
    merged = upsert(arriving, stored.filter(_inside(days)), names, keep_filled, replace)
    # The plan reads files that the write replaces, so its result stands elsewhere first.
    return write_observed(cut_lineage(merged), figures, lambda rows: _overwrite_days(rows.drop("change"), path))


def replace_by_day(changed: DataFrame, path: str, keys: Sequence[str]) -> dict:
    """S9 on a table of :func:`write_by_day`: store changed rows (with their day), rewriting their days only."""
    stored = changed.sparkSession.read.parquet(path)
    fresh = cut_lineage(changed.select(*stored.columns))
    days = [row[0] for row in fresh.select(DAY).distinct().collect()]
    if not days:
        return {"changed": 0, "kept": 0}
    rest = stored.filter(_inside(days)).join(fresh.select(*keys), list(keys), "left_anti").select(*stored.columns)
    rows = fresh.withColumn("_fresh", F.lit(True)).unionByName(rest.withColumn("_fresh", F.lit(False)))
    figures = {"changed": F.count_if("_fresh"), "kept": F.count_if(~F.col("_fresh"))}
    return write_observed(cut_lineage(rows), figures, lambda out: _overwrite_days(out.drop("_fresh"), path))


def retain_by_day(spark: SparkSession, path: str, ts: str, limit: datetime, only: Column | None = None) -> dict:
    """M1 on a table of :func:`write_by_day`: drop rows before ``limit``, or of them those that ``only`` names.

    ``limit`` is a time without a zone, read in the session's.
    Days after the limit are neither read nor written; a day of which no row stays is removed,
    one of which some stay is rewritten. Rows without a time stay. The same call again changes
    nothing more. Returns the numbers of rows ``dropped``, days ``removed`` and ``rewritten``.
    """
    stored = spark.read.parquet(path)
    doomed = F.col(ts) < F.lit(limit.isoformat(sep=" ")).cast("timestamp")
    doomed = F.coalesce(doomed if only is None else doomed & only, F.lit(False))
    old = stored.filter(F.col(DAY) <= F.lit(limit.date()))
    counts = old.groupBy(DAY).agg(F.count(F.lit(1)).alias("n"), F.count_if(doomed).alias("d")).filter("d > 0").collect()  # a row per day
    mixed, emptied = [r[DAY] for r in counts if r["d"] < r["n"]], [r[DAY] for r in counts if r["d"] == r["n"]]
    if mixed:
        _overwrite_days(cut_lineage(stored.filter(_inside(mixed)).filter(~doomed)), path)
    for day in emptied:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{DAY}={day}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return {"dropped": sum(r["d"] for r in counts), "removed": len(emptied), "rewritten": len(mixed)}


def run_metrics(outcomes: DataFrame) -> DataFrame:
    """Figures per run from one row per handled article: run_id, outcome, at."""
    def of(kind):
        return F.count_if(F.col("outcome") == kind)

    counted = outcomes.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("articles_found"), of("added").alias("articles_added"), of("updated").alias("articles_updated"),
        of("skipped").alias("articles_skipped"), of("error").alias("error_count"), F.min("at").alias("started_at"), F.max("at").alias("completed_at"),
    )
    seconds = F.floor((F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6)
    status = F.when(F.col("error_count") == F.col("articles_found"), "failed").otherwise("completed")
    return counted.withColumns({"duration_seconds": seconds, "status": status})
