"""Tables laid out by day: what an update writes, and what it leaves alone."""

import glob
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pressline.sources import merge
from pressline.streaming import events as st

START = datetime(2024, 1, 1, 12)
SCHEMA = "id bigint, at timestamp, title string, n int"


def files(path):
    return {f: (os.path.getmtime(f), os.path.getsize(f)) for f in glob.glob(f"{path}/day=*/*.parquet")}


def row(k, day, title="old", n=0):
    return (k, None if day is None else START + timedelta(days=day), title, n)


def stored(spark, path):
    return sorted((r.id, r.title, r.n, str(r.day)) for r in spark.read.parquet(path).collect())


def test_upsert_writes_the_touched_days_only(spark, tmp_path):
    path = str(tmp_path / "t")
    merge.write_by_day(spark.createDataFrame([row(k, k % 10) for k in range(100)] + [row(200, None)], SCHEMA), path, "at")
    before = files(path)
    # An update keeps its day even where its time has changed; a new row makes a new day.
    new = spark.createDataFrame([row(3, 7, "new", 5), row(13, 3, "", 6), row(300, 20, "fresh", 1), row(200, None, "none", 2)], SCHEMA)
    for turn in range(2):
        figures = merge.upsert_by_day(new, path, "at", ["id"], ["title", "at"], ["n"])
        assert figures == ({"added": 1, "updated": 3, "kept": 8} if turn == 0 else {"added": 0, "updated": 4, "kept": 8})
        want = {k: (k, "old", 0, str((START + timedelta(days=k % 10)).date())) for k in range(100)}
        want |= {3: (3, "new", 5, "2024-01-04"), 13: (13, "old", 6, "2024-01-04"), 300: (300, "fresh", 1, "2024-01-21"), 200: (200, "none", 2, "None")}
        assert stored(spark, path) == sorted(want.values())
    after = files(path)
    untouched = {f for f in before if "2024-01-04" not in f and "HIVE_DEFAULT" not in f}
    assert len({os.path.dirname(f) for f in untouched}) == 9 and all(after[f] == before[f] for f in untouched)
    assert merge.upsert_by_day(new.limit(0), path, "at", ["id"], ["title", "at"], ["n"]) == {"added": 0, "updated": 0, "kept": 0}
    assert files(path) == after


def test_retain_removes_days_and_rewrites_the_one_in_between(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [row(k, k % 10, "a" if k % 2 else "b") for k in range(100)] + [(500, START + timedelta(days=4, hours=3), "a", 0), row(600, None)]
    merge.write_by_day(spark.createDataFrame(rows, SCHEMA), path, "at")
    before = files(path)
    limit = START + timedelta(days=4, hours=1)
    assert merge.retain_by_day(spark, path, "at", limit, F.col("title") == "a") == {"dropped": 20, "removed": 2, "rewritten": 0}
    assert merge.retain_by_day(spark, path, "at", limit) == {"dropped": 30, "removed": 2, "rewritten": 1}
    assert [r[0] for r in stored(spark, path)] == sorted([k for k in range(100) if k % 10 > 4] + [500, 600])
    assert merge.retain_by_day(spark, path, "at", limit) == {"dropped": 0, "removed": 0, "rewritten": 0}
    later = {f for f in before if any(f"2024-01-{d:02}" in f for d in range(6, 11)) or "HIVE_DEFAULT" in f}
    assert later and all(files(path)[f] == before[f] for f in later)


def test_changed_rows_replace_their_days(spark, tmp_path):
    path = str(tmp_path / "t")
    merge.write_by_day(spark.createDataFrame([row(k, k % 10) for k in range(50)], SCHEMA), path, "at")
    before = files(path)
    table = spark.read.parquet(path)
    changed = merge.rewrite_changed(table, {"title": F.when(F.col("id") == 12, F.lit("x")).otherwise(F.col("title"))})
    assert merge.replace_by_day(changed, path, ["id"]) == {"changed": 1, "kept": 4}
    assert sum(r[1] == "x" for r in stored(spark, path)) == 1 and len(stored(spark, path)) == 50
    assert sum(files(path).get(f) == v for f, v in before.items()) >= 9


def test_figures_come_from_the_write(spark, tmp_path):
    kinds = ["added", "updated", "skipped", "error", "added"]
    rows = spark.createDataFrame([(k, kinds[k % 5]) for k in range(103)], "id int, outcome string").repartition(5)
    figures = merge.write_observed(rows, merge.outcome_figures(), lambda out: out.write.parquet(str(tmp_path / "o")))
    again = spark.read.parquet(str(tmp_path / "o")).agg(*[v.alias(k) for k, v in merge.outcome_figures().items()]).first().asDict()
    assert figures == again and again["articles_found"] == 103


def test_late_rows_are_counted(spark, tmp_path):
    at = lambda hours: START + timedelta(hours=hours)
    batches = [[(1, at(0)), (2, at(48))], [(3, at(1)), (4, at(2)), (5, at(47))], [(6, at(3)), (7, at(50))]]
    for rows in batches:
        spark.createDataFrame(rows, "id bigint, scraped_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    figures = {}
    stream = st.exactly_once(st.file_stream(spark, str(tmp_path / "in"), 1))
    path = st.run_available(stream, "append", figures=figures)
    # All ids differ, so what is missing is late: batches are held against the watermark of the batch before.
    assert figures["rows"] == 7 and figures["late"] == 7 - spark.read.parquet(f"{path}/*").count() == 1
