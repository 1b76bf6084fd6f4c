"""Every query of the engine's own operators that has a SQL twin, against DuckDB on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from larkspan import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def rows(df):
    def plain(v):
        if pd.isna(v):
            return "null"
        return round(float(v), 6) if isinstance(v, (int, float, Decimal)) or hasattr(v, "dtype") else str(v)

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    mine, theirs = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_exact_is_never_dearer(spark):
    got = {n: {r["route_id"]: r for r in registry.QUERIES[n](spark, DATA).collect()} for n in ("pln6_exact", "pln8_heuristic", "pln9_greedy")}
    for route, row in got["pln6_exact"].items():
        for other in ("pln8_heuristic", "pln9_greedy"):
            assert got[other][route]["feasible"] and row["objective"] <= got[other][route]["objective"]


def test_bursts_of_a_stream_equal_batch(spark, tmp_path):
    from larkspan.streaming import counters

    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = counters.stream_bursts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 hour", "0 seconds")
    run = stream.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = {(r["session_window"]["start"], r["user_id"]): r["last_event_id"] for r in counters.stream_bursts(events, "1 hour").collect()}
    told = {(r["session_window"]["start"], r["user_id"]): r["last_event_id"] for r in spark.sql("select * from bursts").collect()}
    assert told and told.items() <= batch.items()


def test_streaming_counts_equal_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from larkspan.streaming import counters

    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = counters.stream_daily_counts(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = {(r[0], r[1]): r[2] for r in events.groupBy(F.date_format("ts", "yyyy-MM-dd"), "event_type").count().collect()}
    assert {(str(r["window"]["start"])[:10], r["event_type"]): r["calls"] for r in spark.sql("select * from daily").collect()} == batch


def test_brute_force_equals_the_search(spark):
    """Every route with at most six kept stations: same objective, and where the best plan is alone the same stops."""
    brute = {r["route_id"]: r for r in registry.QUERIES["pln17_brute_force"](spark, DATA).collect()}
    exact = {r["route_id"]: r for r in registry.QUERIES["pln6_exact"](spark, DATA).collect()}
    assert len(brute) > 50 and any(r["n_stops"] > 1 for r in brute.values())
    for route, r in brute.items():
        assert r["objective"] == exact[route]["objective"]
        if r["is_unique"]:
            assert r["stops"] == exact[route]["stops"]


def test_plan_identity_tells_searches_that_end_in_one_world_alone(spark):
    from larkspan.plans import trips
    from larkspan.sources import adapters

    routes, c = adapters.routes(spark, DATA), adapters.candidates(spark, DATA)
    told = {n: dict(trips.plan_identity(routes, c, most_labels=n).groupBy("verdict").count().collect()) for n in (0, 12, None)}
    assert "strategy_differs" not in told[None] and told[None]["identical"] > 0 and "moved" not in told[None]
    assert told[12]["strategy_differs"] > 0 and told[0].get("both_heuristic", 0) > told[None].get("both_heuristic", 0)


def test_plans_are_solved_once_a_session_until_dropped(spark):
    from larkspan.registry_plans import _plans
    from larkspan.sources import files

    one = _plans(spark, DATA, "greedy")
    assert one.inputFiles() == _plans(spark, DATA, "greedy").inputFiles()
    before = sorted(map(str, one.collect()))
    files.drop_written(spark)
    again = _plans(spark, DATA, "greedy")
    assert set(again.inputFiles()) and sorted(map(str, again.collect())) == before
