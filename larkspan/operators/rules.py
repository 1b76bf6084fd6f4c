"""Import rules, picks along a route, and throttles."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reimported(snapshot: DataFrame, incoming: DataFrame, in_scope: Column) -> DataFrame:
    """Upsert by id; a changed address clears the coordinates and sets the status to pending, or out_of_scope by state."""
    new = incoming.select("opis_id", F.col("city").alias("_city"), F.col("state").alias("_state"), F.lit(True).alias("_in"))
    moved = F.col("_in") & ~(F.col("city").eqNullSafe(F.col("_city")) & F.col("state").eqNullSafe(F.col("_state")))
    rows = snapshot.join(new, "opis_id", "full").withColumn("_moved", F.coalesce(moved, F.lit(False)))
    rows = rows.withColumn("city", F.when(F.col("_in"), F.col("_city")).otherwise(F.col("city"))).withColumn("state", F.when(F.col("_in"), F.col("_state")).otherwise(F.col("state")))
    for c in ("lat_u", "lng_u"):
        rows = rows.withColumn(c, F.when(~F.col("_moved"), F.col(c)))
    status = F.when(~F.col("_moved"), F.col("geocode_status")).when(in_scope, "pending").otherwise("out_of_scope")
    return rows.select("opis_id", "city", "state", "lat_u", "lng_u", status.alias("geocode_status"))


def purge_counts(df: DataFrame, source: str) -> DataFrame:
    """What a delete by source would leave: rows before, deleted and after.  Nothing is deleted."""
    gone = F.coalesce(F.col("price_source") == source, F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("before"), F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("after"))


def invariant_violations(stations: DataFrame, base: int, span: int) -> DataFrame:
    """One row of counts, all 0 for a sound data set (``max_other_id`` apart).

    ``stations`` carry source, gers_id, price_source and baseline_milli.  Minted ids lie in the ``span`` from ``base`` on
    and belong to rows of the place source, which have a source key; an estimate is its region's baseline.
    """
    placed, inside = F.col("source") == "overture", (F.col("opis_id") >= base) & (F.col("opis_id") < base + span)
    return stations.agg(
        F.count_if(~F.coalesce(F.col("source").isin("opis", "overture") & F.col("price_source").isin("opis_indexed", "eia_regional_estimate"), F.lit(False))).alias("unknown_source"),
        F.count_if(placed & (F.col("gers_id").isNull() | ~inside)).alias("bad_minted"), F.count_if(~placed & inside).alias("in_reserved_span"), F.max(F.when(~placed, F.col("opis_id"))).alias("max_other_id"),
        F.count_if((F.col("price_source") == "eia_regional_estimate") & ~F.col("price_milli").eqNullSafe(F.col("baseline_milli"))).alias("estimate_off_baseline"),
    )


def checked(violations: DataFrame) -> DataFrame:
    """The counts, or an error that names the first broken invariant when they are read."""
    names = [c for c in violations.columns if c != "max_other_id"]
    bad = F.coalesce(*[F.when(F.col(c) > 0, F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in names])
    return violations.where(F.when(bad.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("broken invariant "), bad)).cast("boolean")))


def token_rule(tokens: Column, singles: tuple[str, ...], pairs: tuple[str, ...]) -> Column:
    """True if a token is among ``singles`` or two neighbours are among ``pairs``."""
    two = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.arrays_overlap(tokens, F.array(*map(F.lit, singles))) | F.arrays_overlap(two, F.array(*map(F.lit, pairs)))


def first_fault(total: Column, tank: Column, mpg: Column, fuel: Column, price: Column, pos: Column) -> Column:
    """The first input rule that a problem row breaks, null for a good row; a null value breaks its rule."""
    rules = (("total", total > 0), ("tank", tank > 0), ("mpg", mpg > 0), ("fuel", fuel.between(0, 1)), ("price", price >= 0), ("position", pos.between(0, total)))
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules])


def own_fault(mpg: int = 10) -> Column:
    """The first input rule that a route by itself breaks."""
    fuel = F.when(F.col("tank_milli_mi") > 0, F.col("on_board_milli_mi") / F.col("tank_milli_mi")).otherwise(0)
    return first_fault(F.col("total_milli_mi"), F.col("tank_milli_mi"), F.lit(mpg), fuel, F.lit(0), F.lit(0))


def route_faults(routes: DataFrame, candidates: DataFrame, mpg: int = 10) -> DataFrame:
    """(route_id, fault) of every route: the first input rule that it or one of its stations breaks, null for a good one.

    Rules go in order: a route's own come before those of stations, and of stations the first rule that any breaks counts.
    """
    zero = F.lit(0)
    own = routes.select("route_id", own_fault(mpg).alias("own"))
    bad = candidates.select("route_id", first_fault(F.lit(1), F.lit(1), F.lit(mpg), zero, F.col("price_milli"), F.lit(1)).alias("price"), (~F.coalesce(F.col("pos_milli_mi").between(0, F.col("total_milli_mi")), F.lit(False))).alias("off"))
    per = bad.groupBy("route_id").agg(F.max("price").alias("price"), F.max("off").alias("off"))
    return own.join(per, "route_id", "left").select("route_id", F.coalesce("own", "price", F.when(F.col("off"), "position")).alias("fault"))


def picks_in_reach(candidates: DataFrame) -> DataFrame:
    """Per route, of the stations within the first tank: nearest, farthest, cheapest, all ties broken by (position, price, id)."""
    near = candidates.where("pos_milli_mi <= tank_milli_mi")
    return near.groupBy("route_id").agg(
        F.min_by("opis_id", F.struct("pos_milli_mi", "price_milli", "opis_id")).alias("nearest"),
        F.min_by("opis_id", F.struct(-F.col("pos_milli_mi"), "price_milli", "opis_id")).alias("farthest"),
        F.min_by("opis_id", F.struct("price_milli", "pos_milli_mi", "opis_id")).alias("cheapest"),
    )


def frontier(candidates: DataFrame) -> DataFrame:
    """Stations that none at the same place or farther undercuts or equals in price: one running minimum from the far end."""
    beyond = Window.partitionBy("route_id").orderBy(F.col("pos_milli_mi").desc(), "price_milli", "opis_id").rowsBetween(Window.unboundedPreceding, -1)
    return candidates.withColumn("_least", F.min("price_milli").over(beyond)).where("_least IS NULL OR price_milli < _least").drop("_least")


def tank_levels(rows: DataFrame, key: str, order: list[str], used: str, bought: str, start: int, capacity: int) -> DataFrame:
    """Level after each leg and after the purchase that follows it; what is displayed stays between 0 and the capacity."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    after = F.lit(start) + F.sum(F.col(bought) - F.col(used)).over(w)
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(capacity), c))
    return rows.withColumn("arrival", clamp(after - F.col(bought))).withColumn("departure", clamp(after))


def throttled(events: DataFrame, burst: int = 20, burst_seconds: int = 60, sustained: int = 200, sustained_seconds: int = 86_400) -> DataFrame:
    """Every event with ``admitted``: fewer than ``burst`` admitted ones of its user in the seconds before, likewise ``sustained``.

    Refused calls do not count, so a user's events are read in order; a limit of 0 admits none.  A task holds the last
    admitted times, at most as many as the limits.  Where no event falls for as long as the longest window both logs are
    empty, so a user's events are dealt in pieces that such gaps part.
    """
    limits = ((burst, burst_seconds * 1_000_000), (sustained, sustained_seconds * 1_000_000))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, logs = object(), ()
        for pdf in batches:
            flags = []
            for who, piece, at in zip(pdf["user_id"].astype(object), pdf["piece"].tolist(), pdf["at"].tolist()):
                who = (None if pd.isna(who) else who, piece)
                if who != user:
                    user, logs = who, tuple(deque() for _ in limits)
                for log, (_, span) in zip(logs, limits):
                    while log and log[0] <= at - span:
                        log.popleft()
                good = all(len(log) < most for log, (most, _) in zip(logs, limits))
                if good:
                    for log in logs:
                        log.append(at)
                flags.append(good)
            yield pdf[["event_id", "user_id"]].assign(admitted=flags)

    rows = events.where("ts IS NOT NULL").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    line = Window.partitionBy("user_id").orderBy("at", "event_id")
    gap = F.col("at") - F.lag("at").over(line) >= max(span for _, span in limits)
    rows = rows.withColumn("gap", gap).withColumn("piece", F.count_if("gap").over(line)).drop("gap")
    return rows.repartition("user_id", "piece").sortWithinPartitions("user_id", "piece", "at", "event_id").mapInPandas(run, "event_id long, user_id long, admitted boolean")
