"""State, restarts and repeated batches of the streams, and what a table on disk rewrites."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspan.sources import files, tables
from larkspan.streaming import counters, ordered, refresh

SHAPE = "opis_id int, price_milli long, price_source string"


def land(spark, path, rows):
    """Events (event_id, user, day of 2024 as a number, type)."""
    start = dt.datetime(2024, 1, 30)
    told = [(i, start + dt.timedelta(days=day, seconds=i), user, kind) for i, user, day, kind in rows]
    spark.createDataFrame(told, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string").parquet(path)


def test_budget_over_restarts_with_rows_out_of_order_and_too_late(spark, tmp_path):
    path, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    landings = [
        [(3, 1, 0, "x"), (1, 1, 0, "x"), (2, 1, 0, "x"), (9, 2, 1, "x")],  # two a day: 1 and 2 come first, 3 is refused
        [(4, 1, 1, "x"), (5, 1, 2, "x"), (6, 1, 4, "x"), (7, 1, 4, "x"), (30, 2, 9, "x")],  # January ends after day 1
        [(8, 1, 1, "x"), (10, 1, 9, "x"), (99, -1, 200, "x")],  # 8 comes when the watermark has passed it
    ]
    for rows in landings:
        ordered.run_to_end(ordered.stream_budget(land(spark, path, rows), 2, 3, "3 days"), sink, checkpoint)
    got = {r["event_id"]: (r["admitted"], r["refused_by"]) for r in spark.read.parquet(sink).where("user_id > 0").collect()}
    good = (True, None)
    assert got == {1: good, 2: good, 3: (False, "day"), 4: good, 5: good, 6: good, 7: good, 10: (False, "month"), 9: good, 30: good}


def test_caps_of_zero_and_a_first_call_after_the_state_was_cleared(spark, tmp_path):
    path, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for rows in ([(1, 1, 0, "x"), (2, 1, 0, "x")], [(3, 2, 60, "x")], [(4, 1, 62, "x"), (99, -1, 300, "x")]):
        ordered.run_to_end(ordered.stream_budget(land(spark, path, rows), 0, 1, "0 days"), sink, checkpoint)
    got = {r["event_id"]: r["refused_by"] for r in spark.read.parquet(sink).where("user_id > 0").collect()}
    assert got == {1: None, 2: "month", 3: None, 4: None}


def test_state_has_a_row_a_bucket_of_users_and_answers_as_tables_do(spark, tmp_path):
    shape, start = "event_id long, ts timestamp_ntz, user_id long, event_type string", dt.datetime(2024, 1, 30)
    kinds = ("view", "error", "view", "purchase", "view", "click", "view")
    rows = [(7 * u + n, start + dt.timedelta(days=n * (1 + u % 4), hours=u % 5), u, kind) for u in range(60) for n, kind in enumerate(kinds)]
    rows += [(2**62 + n, t + dt.timedelta(minutes=1), None, kind) for n, (_, t, _, kind) in enumerate(rows[:7])]  # nobody's, one of them without an id
    rows += [(None, start, None, "view"), (9001, dt.datetime(9000, 1, 1), 5, "view"), (9002, dt.datetime(9500, 1, 1), -1, "none")]
    events = spark.createDataFrame(rows, shape)
    rules = {
        "state": lambda s: ordered.stream_table_state(s, "purchase", "error", "view", 86_400, 604_800, 86_400, "40 days", buckets=4),
        "budget": lambda s: ordered.stream_budget(s, 1, 4, "40 days", buckets=4),
    }
    keys = {}
    for name, rule in rules.items():
        path, sink, checkpoint = (str(tmp_path / name / n) for n in ("in", "out", "checkpoint"))
        for landed in (events.where("user_id % 3 = 1 OR event_type = 'error'"), events.where("NOT coalesce(user_id % 3 = 1 OR event_type = 'error', false)")):
            landed.coalesce(1).write.mode("append").parquet(path)
            ordered.run_to_end(rule(spark.readStream.schema(shape).parquet(path)), sink, checkpoint)
            for kept in ("waiting", "known"):
                state = spark.read.format("statestore").option("stateVarName", kept).load(checkpoint)
                keys[name, kept] = max(keys.get((name, kept), 0), state.select("key").distinct().count())
    assert all(n <= 4 for n in keys.values()) and keys["state", "waiting"] and keys["state", "known"] and keys["budget", "waiting"], keys  # not one a user
    told = lambda name, *columns: sorted(map(repr, spark.read.parquet(str(tmp_path / name / "out")).where("event_id IS NULL OR event_id <> 9002").select("user_id", "event_id", *columns).collect()))
    want = counters.as_of_state(events, "purchase", "error", "view", 86_400, 604_800, 86_400)
    assert told("state", "state", "fetches") == sorted(map(repr, want.select("user_id", "event_id", "state", "fetches").collect()))
    line = lambda *by: Window.partitionBy("user_id", *by).orderBy("ts", "event_id")
    day = events.where("event_id IS NULL OR event_id <> 9002").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("ok", F.row_number().over(line("day")) <= 1)
    both = day.withColumn("admitted", F.col("ok") & (F.sum(F.col("ok").cast("int")).over(line(F.date_format("ts", "yyyy-MM"))) <= 4))
    want = both.withColumn("refused_by", F.expr("CASE WHEN NOT ok THEN 'day' WHEN NOT admitted THEN 'month' END"))
    assert told("budget", "day", "admitted", "refused_by") == sorted(map(repr, want.select("user_id", "event_id", "day", "admitted", "refused_by").collect()))


def releases(spark, path, name, rows):
    spark.createDataFrame([(*r, name) for r in rows], refresh.SHAPE).write.mode("append").partitionBy("release").parquet(path)


def test_refresh_applies_a_repeated_batch_once(spark, tmp_path):
    landing, home = str(tmp_path / "landing"), str(tmp_path / "home")
    releases(spark, landing, "2025-01-01.0", [(1, 10), (2, 20)])
    refresh.work_off(spark, landing, home)
    refresh.work_off(spark, landing, home)  # nothing has landed since: no turn
    releases(spark, landing, "2025-02-01.0", [(2, 25), (3, 30)])
    refresh.work_off(spark, landing, home)
    told = lambda: sorted(tuple(r) for r in refresh.differences(spark, home).select("turn", "opis_id", "price_milli", "change").collect())
    want = [(0, 1, 10, "created"), (0, 2, 20, "created"), (1, 1, 10, "untouched"), (1, 2, 25, "updated"), (1, 3, 30, "created")]
    assert told() == want
    batch = spark.read.schema(refresh.SHAPE).parquet(landing).where("release = '2025-02-01.0'")
    refresh.turn(batch, 1, home)  # as after a failure between the batch and its commit
    assert told() == want
    refresh.turn(batch.limit(0), 2, home)
    assert told() == want


def folders(spark, path):
    return {(r["file"], r["modified"]) for r in tables.file_times(spark, path, SHAPE).collect()}


def test_upsert_and_purge_touch_only_changed_folders(spark, tmp_path):
    path = str(tmp_path / "stations")
    rows = spark.range(64).select(F.col("id").cast("int").alias("opis_id"), (F.col("id") * 10).alias("price_milli"), F.when(F.col("id") % 16 == 3, "est").otherwise("real").alias("price_source"))
    tables.create(rows, path)
    before = folders(spark, path)
    landed = spark.createDataFrame([(5, 1, 1, 1), (5, 2, 1, 55), (7, 1, 1, 70), (1000, 1, 1, 9)], "opis_id int, file_no int, line_no int, price_milli long")
    shape = "opis_id int, price_milli long"
    plan = tables.upsert(spark, path, shape, landed, "price_milli")
    assert dict(plan.groupBy("change").count().collect()) == {"created": 1, "updated": 1, "unchanged": 1, "untouched": 62}
    after = folders(spark, path)
    assert {f.split("folder=")[1].split("/")[0] for f, _ in after - before} == {"5", "8"}
    got = {r["opis_id"]: r["price_milli"] for r in tables.read(spark, path, shape).collect()}
    assert got == {**{i: i * 10 for i in range(64)}, 5: 55, 1000: 9}
    again = tables.upsert(spark, path, shape, landed, "price_milli")
    assert again.where("change IN ('created', 'updated')").count() == 0 and folders(spark, path) == after


def test_purge_deletes_rows_and_folders_that_have_none_left(spark, tmp_path):
    path = str(tmp_path / "stations")
    rows = spark.range(64).select(F.col("id").cast("int").alias("opis_id"), F.col("id").alias("price_milli"), F.when(F.col("id") % 16 == 3, "est").when(F.col("id") == 4, "est").when(F.col("id") % 2 == 0, "real").alias("price_source"))
    tables.create(rows, path)
    before = folders(spark, path)
    assert tuple(tables.purge(spark, path, SHAPE, "est").first()) == (64, 5, 59) and folders(spark, path) == before
    assert tuple(tables.purge(spark, path, SHAPE, "est", dry_run=False).first()) == (64, 5, 59)
    assert tables.read(spark, path, SHAPE).count() == 59
    changed = {f.split("folder=")[1].split("/")[0] for f, _ in before ^ folders(spark, path)}
    assert changed == {"3", "4"} and not (tmp_path / "stations" / "folder=3").exists()
    files.drop_written(spark)
