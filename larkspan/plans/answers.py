"""The whole answer to a trip as one JSON object: the winning route, its plan, and what a client shows around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import lines
from . import search

#: What is told of prices where no weekly index is at hand: the date of the snapshot and a sentence.
SNAPSHOT = ("2025-01-01", "Fuel prices come from a static snapshot without a date of their own.")


def hundredths(whole: Column) -> Column:
    """A number of hundredths as text with two places."""
    return (whole.cast("decimal(20,0)") * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(18,2)").cast("string")


def money(units: Column, mpg: int = search.MPG) -> Column:
    """Cost units as dollars and cents, half up."""
    return hundredths(F.floor((units + 5_000 * mpg) / (10_000 * mpg)))


def price(milli: Column) -> Column:
    return hundredths(F.floor(geo.half_up(milli / 10, 0)).cast("long"))


def gallons(milli_mi: Column, mpg: int = search.MPG) -> Column:
    return hundredths(F.floor((milli_mi + 5 * mpg) / (10 * mpg)))


def miles(milli_mi: Column) -> Column:
    return F.floor((milli_mi + 500) / 1000).cast("long").cast("string")


def tenths(share: Column) -> Column:
    """A share in percent to one place."""
    return (F.floor(geo.half_up(share * 1000, 0)).cast("decimal(12,0)") * F.lit(0.1).cast("decimal(2,1)")).cast("decimal(8,1)").cast("string")


def degrees(micro: Column) -> Column:
    return (micro.cast("decimal(12,0)") * F.lit(0.000001).cast("decimal(7,6)")).cast("decimal(10,6)").cast("string")


def place(lat_u: Column, lng_u: Column) -> Column:
    return F.struct(degrees(lat_u).alias("lat"), degrees(lng_u).alias("lng"))


def _when_known(value: Column, shown: Column) -> Column:
    return F.when(value.isNotNull(), shown)


def rationale(s) -> Column:
    """Why a stop happened and for how much, eleven facts; ``s`` gives a column by name."""
    return F.struct(
        s("reason").alias("purchase_reason"),
        s("target").alias("reason_target_station_id"),
        s("target_name").alias("reason_target_name"),
        s("skipped_count").cast("long").alias("skipped_count"),
        _when_known(s("skipped_avg_milli"), price(s("skipped_avg_milli"))).alias("skipped_avg_price"),
        price(s("corridor_avg_milli")).alias("corridor_avg_price"),
        tenths(s("price_percentile")).alias("price_percentile"),
        s("bypassed_count").cast("long").alias("bypassed_cheaper_count"),
        _when_known(s("bypassed_saving"), money(s("bypassed_saving"))).alias("bypassed_saving_forgone"),
        s("bypassed_estimate_count").cast("long").alias("bypassed_estimate_count"),
        _when_known(s("bypassed_estimate_saving"), money(s("bypassed_estimate_saving"))).alias("bypassed_estimate_saving_forgone"),
    )


def _seconds(elapsed: Column) -> Column:
    return F.floor(elapsed + F.lit(0.5000001)).cast("long")


def whole_answers(trips: DataFrame, stops: DataFrame, stations: DataFrame, candidates: DataFrame, points: DataFrame, trends: DataFrame, composition: DataFrame, elapsed, maps: str, token: str, mpg: int = search.MPG) -> DataFrame:
    """(trip, answer): one JSON object of 26 keys for every trip with a feasible alternative.

    ``trips``: alternatives with their plan's and the price-blind driver's figures and the line's ``duration_s``;
    ``stops``: of the plans, with their context; ``stations`` by id; ``candidates`` of the routes; ``points`` of the lines;
    ``trends`` (route_id, region, delta_cents, week); ``composition`` (note), one row; ``elapsed(mile, route's columns)``
    gives the time at a mile.  Whole units become texts only here, rounded half up.
    """
    order = F.struct("cost", "total_milli_mi", F.coalesce("duration_s", F.lit(2**62)), "alternative_index", "route_id")
    alternative = F.struct(
        "alternative_index", "route_id", F.struct(miles(F.col("total_milli_mi")).alias("total_route_mi"), F.col("duration_s"), _when_known(F.col("cost"), money(F.col("cost"), mpg)).alias("total_cost"), F.col("feasible")).alias("j")
    )
    per_trip = trips.groupBy("trip").agg(F.min(F.when(F.col("feasible"), order)).alias("best"), F.sort_array(F.collect_list(alternative)).alias("listed")).where("best IS NOT NULL")
    chosen = F.transform("listed", lambda a: F.struct(a["j"]["total_route_mi"].alias("total_route_mi"), a["j"]["duration_s"].alias("duration_s"), a["j"]["total_cost"].alias("total_cost"), (a["route_id"] == F.col("best.route_id")).alias("chosen"), a["j"]["feasible"].alias("feasible")))
    winners = per_trip.select(F.col("best.route_id").alias("route_id"), chosen.alias("alternatives")).join(trips, "route_id")
    only = winners.select("route_id")

    coords = stations.where("geocode_status = 'ok'").select("opis_id", "lat_u", "lng_u")
    named = stations.select(F.col("opis_id").alias("target_key"), F.col("name").alias("target_name"))
    own = stops.join(only, "route_id", "left_semi").join(stations.select("opis_id", "name", "price_source"), "opis_id").join(coords, "opis_id", "left")
    own = own.join(named, F.col("target") == F.col("target_key"), "left")
    c = F.col
    stop = F.struct(
        c("name"), c("opis_id").cast("long").alias("station_id"), F.when(c("lat_u").isNotNull(), place(c("lat_u"), c("lng_u"))).alias("location"), miles(c("pos")).alias("distance_from_start_mi"), price(c("price")).alias("price_per_gallon"),
        gallons(c("amount"), mpg).alias("gallons"), money(c("amount") * c("price"), mpg).alias("cost"), c("price_source"), rationale(c).alias("rationale"),
    )
    pin = F.when(c("lat_u").isNotNull(), F.concat(degrees(c("lng_u")), F.lit(","), degrees(c("lat_u"))))
    node = F.struct("stop_no", stop.alias("j"), pin.alias("pin"), F.struct("name", "pos", "amount", (c("amount") * c("price")).alias("cost")).alias("node"))
    own = own.groupBy("route_id").agg(F.sort_array(F.collect_list(node)).alias("stops"))

    near = candidates.join(only, "route_id", "left_semi").join(coords, "opis_id")
    seen = F.struct("pos_milli_mi", "price_milli", "opis_id", F.struct(c("opis_id").cast("long").alias("station_id"), degrees(c("lat_u")).alias("lat"), degrees(c("lng_u")).alias("lng"), price(c("price_milli")).alias("price_per_gallon"), miles(c("pos_milli_mi")).alias("distance_from_start_mi")).alias("j"))
    near = near.groupBy("route_id").agg(F.sort_array(F.collect_list(seen)).alias("near"))

    line = lines.scaled(points.join(only, "route_id", "left_semi"))
    rows = winners.join(own, "route_id", "left").join(near, "route_id", "left").join(line, "route_id").join(trends, "route_id", "left").crossJoin(F.broadcast(composition))
    rows = rows.withColumn("stops", F.coalesce("stops", F.array().cast(own.schema["stops"].dataType))).withColumn("near", F.coalesce("near", F.array().cast(near.schema["near"].dataType)))

    bare = lambda name, pos, amount, cost: F.struct(name.cast("string").alias("name"), pos.cast("long").alias("pos"), amount.cast("long").alias("amount"), cost.cast("long").alias("cost"))
    inner = F.transform("stops", lambda s: bare(s["node"]["name"], s["node"]["pos"], s["node"]["amount"], s["node"]["cost"]))
    nodes = F.concat(F.array(bare(F.lit("START"), F.lit(0), F.lit(0), F.lit(0))), inner, F.array(bare(F.lit("FINISH"), c("total_milli_mi"), F.lit(0), F.lit(0))))
    rows = rows.withColumn("nodes", nodes)

    def leg(a: Column, b: Column) -> Column:
        return F.struct(
            a["name"].alias("from"), b["name"].alias("to"), miles(b["pos"] - a["pos"]).alias("distance_mi"), F.when(c("duration_s").isNotNull(), _seconds(elapsed(b["pos"]) - elapsed(a["pos"]))).alias("duration_s"),
            gallons(a["amount"], mpg).alias("gallons"), money(a["cost"], mpg).alias("cost"),
        )

    legs = F.zip_with(F.slice("nodes", F.lit(1), F.size("nodes") - 1), F.slice("nodes", F.lit(2), F.size("nodes") - 1), leg)
    point = lambda at: F.get(c("line"), at)
    last = F.size("line") - 1
    middle = F.floor(last / 2).cast("int")
    spot = lambda p: place(p["y"], p["x"])
    text_of = lambda p: F.concat(degrees(p["x"]), F.lit(","), degrees(p["y"]))

    def marker(label: str, name: str, p: Column, at: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(name).alias("name"), degrees(p["y"]).alias("lat"), degrees(p["x"]).alias("lng"), miles(at).alias("distance_from_start_mi"), F.when(c("duration_s").isNotNull(), _seconds(elapsed(at))).alias("duration_s"))

    waypoints = F.array(marker("A", "Start", point(F.lit(0)), F.lit(0)), marker("B", "Waypoint 1", point(middle), F.floor(c("total_milli_mi") / 2)), marker("C", "Finish", point(last), c("total_milli_mi")))
    saved = c("naive_cost") - c("cost")
    savings = F.struct(
        money(saved, mpg).alias("amount"), _when_known(F.nullif(c("naive_cost"), F.lit(0)), search.percent(saved, c("naive_cost")).cast("string")).alias("percent"), money(c("naive_cost"), mpg).alias("naive_total_cost"),
        gallons(c("naive_bought"), mpg).alias("naive_total_gallons"), c("naive_n_stops").cast("long").alias("naive_stop_count"),
    )
    pins = F.filter(F.transform("stops", lambda s: s["pin"]), lambda p: p.isNotNull())
    address = lines.map_address(maps, token, c("line"), text_of(point(F.lit(0))), text_of(point(last)), pins)
    status = F.when(c("delta_cents").isNotNull(), "current").otherwise("frozen")
    week = F.to_date("week")
    vehicle = F.struct(F.lit(str(mpg)).alias("mpg"), miles(c("tank_milli_mi")).alias("tank_range_mi"), tenths(c("on_board_milli_mi") / c("tank_milli_mi") / 100).alias("starting_fuel"), miles(c("on_board_milli_mi")).alias("starting_fuel_mi"))
    answer = F.struct(
        spot(point(F.lit(0))).alias("start"),
        spot(point(last)).alias("finish"),
        F.transform(lines.kept(c("line"), lines.GEOMETRY_TOLERANCE * 1e6), lambda p: F.array(degrees(p["x"]), degrees(p["y"]))).alias("route_geometry"),
        miles(c("total_milli_mi")).alias("total_route_mi"),
        F.transform("stops", lambda s: s["j"]).alias("fuel_stops"),
        money(c("cost"), mpg).alias("total_cost"),
        gallons(c("bought"), mpg).alias("total_gallons"),
        address["address"].alias("map_url"),
        vehicle.alias("vehicle"),
        legs.alias("legs"),
        c("duration_s").alias("total_duration_s"),
        F.size("stops").cast("long").alias("fuel_stop_count"),
        F.when(c("naive_cost").isNotNull(), savings).alias("savings"),
        F.when(c("naive_cost").isNull(), "naive_plan_infeasible").alias("savings_note"),
        F.size("alternatives").cast("long").alias("alternatives_considered"),
        c("alternatives"),
        F.transform("near", lambda s: s["j"]).alias("candidate_stations"),
        waypoints.alias("waypoints"),
        F.when(status == "current", F.date_format(week, "MMM d, yyyy")).otherwise(SNAPSHOT[0]).alias("price_as_of"),
        F.when(status == "current", text.freshness_note(status, week)).otherwise(SNAPSHOT[1]).alias("price_data_note"),
        c("note").alias("station_data_note"),
        status.alias("price_index_status"),
        c("week").alias("eia_week"),
        c("region").alias("trend_region"),
        c("delta_cents").alias("trend_delta_cents"),
        c("strategy").alias("solver_strategy"),
    )
    return rows.select("trip", F.to_json(answer, {"ignoreNullFields": "false"}).alias("answer"))
