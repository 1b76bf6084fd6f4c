"""Queries over sources of the real shapes, estimates, ladders, notes, payloads and time windows, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import geo, text
from .operators import cleaning, corridor, measure, pricing, rules
from .plans import answers, arcs, search, trips
from .registry import _CORRIDOR, _EFFORT, _INCOMING, _existing, _FACTORS, _incoming, query
from .registry_plans import _CONTEXT, _NAIVE, _PLAN_LEGS, _TRIPS, _WALK, _context, _plans, _stops, _trips, _usd
from .sources import adapters as src
from .sources import files
from .streaming import counters

# --- sources


def _write_csv(df, label):
    path = files.fresh_path(df.sparkSession, label)
    df.write.csv(path, header=True, escape='"', nullValue="", emptyValue="")
    return path


@query("""SELECT count(*) FILTER (ok) AS parsed, count(*) FILTER (NOT ok) AS skipped, sum(CASE WHEN ok THEN (price_milli / 1000.0)::DECIMAL(11,3) END)::DECIMAL(18,3) AS total, count(*) FILTER (ok AND obs_ord % 3 = 0) AS quoted, count(DISTINCT CASE WHEN ok THEN rack_id END) AS racks
FROM (SELECT *, obs_ord % 50 <> 7 AND obs_ord % 70 <> 3 AS ok FROM v_price_obs)""")
def src1_price_scan(spark, d):
    """A written price list, names with commas and quotes among them, read back with its header; what does not parse is counted."""
    obs = src.price_observations(spark, d)
    ident = F.when(F.col("obs_ord") % 50 == 7, "bad").otherwise(F.col("opis_id").cast("string"))
    price = F.when(F.col("obs_ord") % 70 == 3, "n/a").otherwise((F.col("price_milli") / F.lit(1000).cast("decimal(5,0)")).cast("decimal(11,3)").cast("string"))
    name = F.when(F.col("obs_ord") % 3 == 0, F.concat(F.lit('STOP "A", EXIT '), "opis_id")).otherwise(F.col("name"))
    columns = (ident, name, F.lit("I-80, EXIT 4"), F.lit("City"), F.lit("TX"), F.col("rack_id"), price)
    rows = files.price_rows(spark, _write_csv(obs.select(*[c.alias(n) for c, n in zip(columns, files.PRICE_COLUMNS)]), "prices"))
    good = F.col("ok")
    return rows.agg(
        F.count_if(good).alias("parsed"), F.count_if(~good).alias("skipped"), F.sum(F.when(good, F.col("retail_price"))).cast("decimal(18,3)").alias("total"),
        F.count_if(good & (F.col("name") == F.concat(F.lit('STOP "A", EXIT '), "opis_id"))).alias("quoted"), F.count_distinct(F.when(good, F.col("rack_id"))).alias("racks"),
    )


@query("""SELECT CASE WHEN opis_id % 17 <> 5 AND opis_id % 23 <> 3 THEN state END AS state, count(*) AS n, count(*) FILTER (opis_id % 17 = 5 OR opis_id % 23 = 3) AS malformed FROM v_station GROUP BY 1""")
def src3_extract_rows(spark, d):
    k = F.col("opis_id")
    degrees = lambda c: (F.col(c) / 1_000_000).cast("string")
    values = {
        "gers_id": F.when(k % 23 != 3, F.concat(F.lit("g-"), k)), "name": F.col("name"), "address_region": F.concat(F.lit(" "), F.lower("state")), "category": F.lit("truck_stop"), "confidence": (k % 100 / 100).cast("string"),
        "longitude": degrees("lng_u"), "latitude": F.when(k % 17 == 5, "north").otherwise(degrees("lat_u")),
    }
    raw = src.stations(spark, d).select(*[values.get(c, F.lit("x")).alias(c) for c in files.EXTRACT_COLUMNS])
    rows = files.extract_rows(spark, _write_csv(raw, "raw-extract"))
    return rows.groupBy(F.when(F.col("ok"), F.col("address_region")).alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("malformed"))


@query("SELECT opis_id, CASE WHEN opis_id % 9 <> 0 THEN lat_u / 1e6 END AS lat, CASE WHEN opis_id % 9 <> 0 THEN lng_u / 1e6 END AS lng FROM v_station")
def src8_geocode_json(spark, d):
    point = lambda lng, lat: F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates")).alias("geometry"))
    features = F.array(point(F.col("lng_u") / F.lit(1e6), F.col("lat_u") / F.lit(1e6)), point(F.lit(0.0), F.lit(0.0)))
    body = F.when(F.col("opis_id") % 9 == 0, F.lit('{"type":"FeatureCollection","features":[]}')).otherwise(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), features.alias("features"))))
    return src.stations(spark, d).select("opis_id", files.first_feature(body).alias("p")).select("opis_id", "p.lat", "p.lng")


@query("SELECT opis_id, opis_id % 5 > 1 AS matched, CASE WHEN opis_id % 5 > 1 THEN lat_u / 1e6 END AS lat, CASE WHEN opis_id % 5 > 1 THEN lng_u / 1e6 END AS lng FROM v_station WHERE opis_id % 5 <> 0")
def src10_batch_geocodes(spark, d):
    k = F.col("opis_id")
    quoted = lambda *c: F.concat(F.lit('"'), *c, F.lit('"'))
    address = quoted(F.lit("1 Main St, "), "city", F.lit(', ""TX""'))
    pair = quoted((F.col("lng_u") / F.lit(1e6)).cast("string"), F.lit(","), (F.col("lat_u") / F.lit(1e6)).cast("string"))
    full = F.concat_ws(",", quoted(k.cast("string")), address, F.lit('"Match"'), F.lit('"Exact"'), address, pair, F.lit('"7"'), F.lit('"L"'))
    line = F.when(k % 5 == 0, F.concat_ws(",", k, "city")).when(k % 5 == 1, F.concat_ws(",", k, address, F.lit('"No_Match"'))).otherwise(full)
    return files.batch_answers(src.stations(spark, d).select(line.alias("line")))


@query("""o AS (SELECT o_orderkey AS route_id, count(*) AS n, sum(l_quantity)::BIGINT AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT route_id, 0 AS alternative_index, NULL::VARCHAR AS error, (q * 100)::DOUBLE AS metres, (q * 3)::DOUBLE AS duration_s, 2 AS legs, n AS segments, (q * 100)::DOUBLE AS segment_metres FROM o WHERE route_id % 6 <> 0
UNION ALL SELECT route_id, 1, NULL, (q * 200)::DOUBLE, NULL, 0, 0, 0 FROM o WHERE route_id % 6 <> 0 UNION ALL SELECT route_id, NULL, 'NoRoute', NULL, NULL, NULL, 0, 0 FROM o WHERE route_id % 6 = 0""")
def src7_directions(spark, d):
    """Directions answers as JSON, two alternatives each (one without legs), parsed back to routes; some answers have no route."""
    items = src.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("route_id")).agg(F.sort_array(F.collect_list("l_quantity")).alias("v"))
    first, rest = F.slice("v", 1, 1), F.when(F.size("v") > 1, F.slice("v", 2, F.size("v") - 1)).otherwise(F.array().cast("array<double>"))
    metres = lambda v, by: F.transform(v, lambda x: x * by)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    leg = lambda v: F.struct((total(v) * 100).alias("distance"), F.struct(metres(v, 100).alias("distance"), metres(v, 3).alias("duration")).alias("annotation"))
    line = F.struct(F.array(F.array(F.lit(-118.5), F.lit(34.0)), F.array(F.lit(-87.5), F.lit(41.5))).alias("coordinates"))
    one = F.struct(line.alias("geometry"), (total(F.col("v")) * 100).alias("distance"), (total(F.col("v")) * 3).alias("duration"), F.array(leg(first), leg(rest)).alias("legs"))
    two = F.struct(line.alias("geometry"), (total(F.col("v")) * 200).alias("distance"), F.lit(None).cast("double").alias("duration"), F.lit(None).cast(f"array<{_leg_type()}>").alias("legs"))
    good = F.to_json(F.struct(F.lit("Ok").alias("code"), F.array(one, two).alias("routes")))
    answers = items.select("route_id", F.when(F.col("route_id") % 6 == 0, F.lit('{"code":"NoRoute","routes":[]}')).otherwise(good).alias("body"))
    found = files.direction_routes(answers)
    return found.select(
        "route_id", "alternative_index", "error", F.round(F.col("total_mi") * files.METRES, 3).alias("metres"), "duration_s", F.when(F.col("error").isNull(), F.size("leg_distances_mi")).alias("legs"),
        F.size("annotation_mi").cast("long").alias("segments"), F.round(F.aggregate("annotation_mi", F.lit(0.0), lambda a, x: a + x) * files.METRES, 3).alias("segment_metres"),
    )


def _leg_type():
    return "struct<distance:double,annotation:struct<distance:array<double>,duration:array<double>>>"


@query(_FACTORS + " SELECT region, current_milli, prior_milli, factor, delta_cents, week FROM f")
def src9_series_factors(spark, d):
    """The weekly series as JSON answers, one a week and another product among the rows, read back and reduced to factors."""
    r = src.regions(spark)
    rows = src.weekly_prices(spark, d).join(F.broadcast(r.select("region_no", "duoarea", "product")), "region_no")
    value = (F.col("value_milli") / F.lit(1000).cast("decimal(5,0)")).cast("decimal(10,3)").cast("string")
    point = lambda product, v: F.struct(F.col("period").cast("string").alias("period"), F.col("duoarea"), product.alias("product"), v.alias("value"), F.lit("$/GAL").alias("units"))
    both = F.array(point(F.col("product"), value), point(F.lit("OTHER"), F.lit("9.999")))
    answers = rows.groupBy("period").agg(F.flatten(F.collect_list(both)).alias("data")).select(F.to_json(F.struct(F.struct("data").alias("response"))).alias("body"))
    read = files.series_rows(answers).join(F.broadcast(r.select("region_no", "duoarea", "product")), ["duoarea", "product"])
    weekly = read.select(F.col("period").cast("date").alias("period"), "region_no", (F.col("value") * 1000).cast("long").alias("value_milli"))
    return pricing.latest_factors(weekly, r)


@query("SELECT opis_id, (lat_u / 1000000.0)::DECIMAL(12,8)::VARCHAR AS lat, (lng_u / 1000000.0)::DECIMAL(12,8)::VARCHAR AS lng, CASE WHEN opis_id % 2 = 0 THEN 'keep' ELSE 'drop' END AS decision FROM v_station")
def snk2_decision_rows(spark, d):
    """Decisions with coordinates to eight places, written as CSV and read back."""
    degrees = lambda c: (F.col(c).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(12,8)").cast("string").alias(c[:3])
    rows = src.stations(spark, d).select("opis_id", degrees("lat_u"), degrees("lng_u"), F.when(F.col("opis_id") % 2 == 0, "keep").otherwise("drop").alias("decision"))
    return files.scan_csv(spark, files.export_csv(rows, "opis_id", "decisions"), rows.columns).withColumn("opis_id", F.col("opis_id").cast("int"))


@query("SELECT decision, reason, count(*) AS n FROM (" + _INCOMING.replace("i AS", "WITH i AS", 1) + """, c AS (SELECT lower(city) AS city, state, min(opis_id) AS m2 FROM v_station WHERE geocode_precision = 'city' AND opis_id % 2 = 0 GROUP BY ALL)
SELECT CASE WHEN dist_mi <= 0.25 OR m2 IS NOT NULL THEN 'drop' ELSE 'keep' END AS decision, CASE WHEN dist_mi <= 0.25 THEN 'rooftop_within_threshold' WHEN m2 IS NOT NULL THEN 'same_chain_city_state' WHEN i.in_id % 3 <> 0 THEN 'no_chain' ELSE 'no_match' END AS reason
FROM i LEFT JOIN n USING (in_id) LEFT JOIN c ON i.in_id % 3 = 0 AND lower(i.city) = c.city AND i.state = c.state) GROUP BY ALL""")
def snk3_report_counts(spark, d):
    """The figures of an import report."""
    return cleaning.entity_match(_incoming(spark, d), _existing(spark, d)).groupBy("decision", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(_INCOMING + """, p AS (SELECT floor(lat_u / 500000.0::DOUBLE)::BIGINT AS cy, floor(lng_u / 500000.0::DOUBLE)::BIGINT AS cx, dist_mi FROM i LEFT JOIN n USING (in_id)), g AS (SELECT cy, cx, count(*) AS places, coalesce(max((dist_mi BETWEEN 0.2 AND 0.3)::INT), 0) = 1 AS edge, row_number() OVER (ORDER BY count(*) DESC, cy, cx) AS k FROM p GROUP BY cy, cx)
SELECT cy, cx, places, CASE WHEN k <= 8 THEN 'dense' ELSE 'boundary' END AS why FROM g WHERE k <= 8 OR edge""")
def top3_spot_clusters(spark, d):
    """The eight densest cells, and every cell with a match within a fifth of the threshold."""
    incoming = _incoming(spark, d)
    near = cleaning.nearest_rooftop(incoming, src.stations(spark, d)).select("in_id", "dist_mi")
    return cleaning.spot_clusters(incoming.join(near, "in_id", "left"), 500_000, 8, 0.2, 0.3)


@query("SELECT opis_id, region, baseline_milli AS price_milli, baseline_milli AS least_milli, baseline_milli AS most_milli, 0 AS observation_count, 'eia_regional_estimate' AS price_source FROM v_station JOIN v_state USING (state) WHERE opis_id % 4 = 1")
def mat11_estimated_prices(spark, d):
    """Stations without an observed price take their region's baseline, with no observation; a state of no region gives none."""
    return pricing.estimated(src.stations(spark, d).where("price_source = 'eia_regional_estimate'"), src.state_regions(spark))


@query("SELECT opis_id, printf('%.3f', floor(dist_mi * 1000 + 0.5000001::DOUBLE) / 1000) AS distance FROM (" + _INCOMING.replace("i AS", "WITH i AS", 1) + " SELECT in_id AS opis_id, dist_mi FROM n)")
def str10_distance_text(spark, d):
    n = cleaning.nearest_rooftop(_incoming(spark, d), src.stations(spark, d))
    return n.select(F.col("in_id").alias("opis_id"), F.format_string("%.3f", geo.half_up(F.col("dist_mi"), 3)).alias("distance"))


@query("""c AS (SELECT state, count(*) AS total, count(*) FILTER (price_source = 'opis_indexed') AS recorded, count(*) FILTER (price_source = 'eia_regional_estimate') AS estimates FROM (SELECT CASE WHEN opis_id % 50 = 0 THEN 'only' WHEN opis_id % 3 = 0 THEN 'most' ELSE state END AS state, CASE WHEN opis_id % 3 = 0 AND opis_id % 50 <> 0 THEN 'opis_indexed' WHEN opis_id % 50 = 0 AND opis_id % 100 = 0 THEN 'other' ELSE price_source END AS price_source FROM v_station) GROUP BY state)
SELECT state, CASE WHEN total = 0 THEN '' WHEN recorded = total THEN t || ' — all with recorded prices.' WHEN recorded + estimates = total THEN t || ' — ' || format('{:,}', recorded) || ' recorded, ' || format('{:,}', estimates) || CASE WHEN estimates = 1 THEN ' regional estimate.' ELSE ' regional estimates.' END ELSE t || '.' END AS note
FROM (SELECT *, format('{:,}', total) || CASE WHEN total = 1 THEN ' station' ELSE ' stations' END AS t FROM c)""")
def str9_station_notes(spark, d):
    k = F.col("opis_id")
    state = F.when(k % 50 == 0, "only").when(k % 3 == 0, "most").otherwise(F.col("state"))
    source = F.when((k % 3 == 0) & (k % 50 != 0), "opis_indexed").when((k % 50 == 0) & (k % 100 == 0), "other").otherwise(F.col("price_source"))
    c = src.stations(spark, d).select(state.alias("state"), source.alias("s")).groupBy("state").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("s") == "opis_indexed").alias("recorded"), F.count_if(F.col("s") == "eia_regional_estimate").alias("estimates"))
    return c.select("state", text.station_note(F.col("total"), F.col("recorded"), F.col("estimates")).alias("note"))


@query("""SELECT region_no, period::VARCHAR AS period, CASE WHEN period IS NOT NULL AND r <= 10 THEN 'Station prices indexed to the EIA week of ' || strftime(period, '%b %-d, %Y') || CASE WHEN r = 1 THEN '.' ELSE ' (latest available).' END ELSE '""" + answers.SNAPSHOT[1] + """' END AS note FROM (SELECT *, row_number() OVER (PARTITION BY region_no ORDER BY period DESC) AS r FROM v_weekly)""")
def str9_freshness_notes(spark, d):
    r = F.row_number().over(Window.partitionBy("region_no").orderBy(F.col("period").desc()))
    state = F.when(F.col("r") == 1, "current").when(F.col("r") <= 10, "stale").otherwise("frozen")
    return src.weekly_prices(spark, d).withColumn("r", r).select("region_no", F.col("period").cast("string").alias("period"), text.freshness_note(state, F.col("period"), answers.SNAPSHOT[1]).alias("note"))


@query("""x AS (SELECT route_id, total_milli_mi AS m, (m + 30 * 17) // (60 * 17) AS dur, m // 7 AS units FROM v_route)
SELECT route_id, CASE WHEN s // 60 // 60 > 0 THEN s // 60 // 60 || 'h ' || s // 60 % 60 || 'm' ELSE s // 60 || 'm' END AS duration, strftime(DATE '2024-01-05' + (route_id % 300)::INT, '%b %-d, %Y') AS shown, format('{:,}', (m + 500) // 1000) || ' mi' AS miles,
  m // 100 // 100 || '.' || lpad((m // 100 % 100)::VARCHAR, 2, '0') || ' gal' AS gallons, '$' || format('{:,}', m // 100) || '.' || lpad((m % 100)::VARCHAR, 2, '0') AS money, route_id % 1000 // 10 || '.' || route_id % 10 || '%' AS percent
FROM (SELECT *, m // 17 + 30 AS s FROM x)""")
def str15_display_formats(spark, d):
    m, k = F.col("total_milli_mi"), F.col("route_id")
    exact = lambda c, by, places: (c.cast("decimal(20,0)") / F.lit(by).cast("decimal(6,0)")).cast(f"decimal(20,{places})")
    return src.routes(spark, d).select(
        "route_id", text.duration(F.floor(m / 17).cast("long")).alias("duration"), F.date_format(F.date_add(F.lit("2024-01-05").cast("date"), (k % 300).cast("int")), "MMM d, yyyy").alias("shown"),
        F.concat(text.grouped(F.floor((m + 500) / 1000), 0), F.lit(" mi")).alias("miles"), F.concat(exact(F.floor(m / 100), 100, 2).cast("string"), F.lit(" gal")).alias("gallons"),
        F.concat(F.lit("$"), text.grouped(exact(m, 100, 2), 2)).alias("money"), F.concat(exact(k % 1000, 10, 1).cast("string"), F.lit("%")).alias("percent"),
    )


@query("SELECT s.route_id, i, floor((lng0 + (lng1 - lng0) * i / 200) * 1000000 + 0.5000001::DOUBLE)::BIGINT AS lng_u, floor((lat0 + (lat1 - lat0) * i / 200 + 0.3 * sin(i / 200.0::DOUBLE * 30) + 0.05 * sin(i / 200.0::DOUBLE * 137)) * 1000000 + 0.5000001::DOUBLE)::BIGINT AS lat_u FROM (SELECT route_id, -119 + route_id % 20 AS lng0, -97.0::DOUBLE + route_id % 17 AS lng1, 31 + route_id % 13 AS lat0, 31.0::DOUBLE + route_id % 11 AS lat1 FROM v_route) s, range(201) t(i)")
def mat18_sine_routes(spark, d):
    """Synthetic lines: straight, with two sines across."""
    k = F.col("route_id")
    rows = src.routes(spark, d).select("route_id", F.explode(F.sequence(F.lit(0), F.lit(200))).alias("i"))
    line = geo.sine_line(F.col("i"), 200, (-119 + k % 20).cast("double"), (31 + k % 13).cast("double"), (-97 + k % 17).cast("double"), (31 + k % 11).cast("double"))
    return rows.select("route_id", F.col("i").cast("long").alias("i"), *line)


# --- payloads


@query("""SELECT route_id, '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"LineString","coordinates":[' || string_agg('[' || (lng_u * 0.000001::DECIMAL(7,6))::DECIMAL(10,6) || ',' || (lat_u * 0.000001::DECIMAL(7,6))::DECIMAL(10,6) || ']', ',' ORDER BY seq) || ']}}' || coalesce(any_value(points), '') || ']}' AS trip
FROM v_point LEFT JOIN (SELECT route_id, string_agg(',{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (lng_u * 0.000001::DECIMAL(7,6))::DECIMAL(10,6) || ',' || (lat_u * 0.000001::DECIMAL(7,6))::DECIMAL(10,6) || ']},"properties":{"opis_id":' || id || ',"price_milli":' || price || '}}', '' ORDER BY stop_no) AS points FROM hw_s JOIN v_station ON id = opis_id WHERE geocode_status = 'ok' GROUP BY route_id) USING (route_id) GROUP BY route_id""".join((_WALK + " ", "")), recursive=True)
def snk8_trip_geojson(spark, d):
    """A trip's line and its chosen stops as GeoJSON; stops without coordinates are left out."""
    degrees = lambda c: (F.col(c).cast("decimal(12,0)") * F.lit(0.000001).cast("decimal(7,6)")).cast("decimal(10,6)")
    at = F.array(degrees("lng_u"), degrees("lat_u"))
    line = src.route_points(spark, d).groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("seq", at.alias("p")))).alias("v"))
    known = src.stations(spark, d).where("geocode_status = 'ok'").select(F.col("opis_id").cast("long").alias("id"), "lat_u", "lng_u")
    stops = _plans(spark, d, "heuristic").select("route_id", F.posexplode("stops").alias("stop_no", "s")).select("route_id", "stop_no", "s.id", "s.price").join(known, "id")
    point = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), at.alias("coordinates")).alias("geometry"), F.struct(F.col("id").alias("opis_id"), F.col("price").alias("price_milli")).alias("properties"))
    points = stops.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("stop_no", F.to_json(point).alias("j")))).alias("w"))
    whole = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.col("v.p").alias("coordinates")).alias("geometry")))
    listed = F.array_join(F.concat(F.array(whole), F.coalesce(F.col("w.j"), F.array().cast("array<string>"))), ",")
    return line.join(points, "route_id", "left").select("route_id", F.concat(F.lit('{"type":"FeatureCollection","features":['), listed, F.lit("]}")).alias("trip"))


@query("""SELECT route_id, opis_id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (lng_u * 0.000001::DECIMAL(7,6))::DECIMAL(10,6) || ',' || (lat_u * 0.000001::DECIMAL(7,6))::DECIMAL(10,6) || ']},"properties":{"price":' || (price_milli * 0.001::DECIMAL(4,3))::DECIMAL(8,3) || '}}' AS feature FROM v_candidate JOIN (SELECT opis_id, lat_u, lng_u FROM v_station) USING (opis_id)""")
def snk9_candidate_features(spark, d):
    degrees = lambda c: (F.col(c).cast("decimal(12,0)") * F.lit(0.000001).cast("decimal(7,6)")).cast("decimal(10,6)")
    at = src.stations(spark, d).select("opis_id", F.struct(F.lit("Point").alias("type"), F.array(degrees("lng_u"), degrees("lat_u")).alias("coordinates")).alias("geometry"))
    price = (F.col("price_milli").cast("decimal(8,0)") * F.lit(0.001).cast("decimal(4,3)")).cast("decimal(8,3)")
    feature = F.struct(F.lit("Feature").alias("type"), "geometry", F.struct(price.alias("price")).alias("properties"))
    return src.candidates(spark, d).join(at, "opis_id").select("route_id", "opis_id", F.to_json(feature).alias("feature"))


_PAYLOAD = _CONTEXT + ", " + _NAIVE + """, st AS (SELECT route_id, '[' || string_agg('{"opis_id":' || opis_id || ',"purchase_reason":"' || reason || '","skipped_count":' || skipped_count || ',"bypassed_cheaper_count":' || bypassed_count || '}', ',' ORDER BY stop_no) || ']' AS stops FROM sc GROUP BY route_id),
cd AS (SELECT route_id, '[' || string_agg('{"opis_id":' || opis_id || ',"price":' || price_milli || '}', ',' ORDER BY pos_milli_mi, price_milli, opis_id) || ']' AS cands FROM v_candidate GROUP BY route_id)
SELECT p.route_id, '{"start":null,"finish":null,"route_geometry":null,"total_route_milli":' || total_milli_mi || ',"fuel_stops":' || coalesce(stops, '[]') || ',"total_cost_units":' || p.cost || ',"total_bought_milli":' || p.bought || ',"map_url":null,"vehicle":{"tank_milli":' || tank_milli_mi || ',"starting_milli":' || on_board_milli_mi || '},"total_duration_s":' || total_milli_mi // 17
  || ',"fuel_stop_count":' || p.n_stops || ',"savings":' || CASE WHEN n.feasible THEN '{"amount_units":' || (n.cost - p.cost) || ',"naive_stop_count":' || n.n_stops || '}' ELSE 'null' END || ',"savings_note":' || CASE WHEN n.feasible THEN 'null' ELSE '"naive_plan_infeasible"' END || ',"candidate_stations":' || coalesce(cands, '[]') || ',"price_index_status":"frozen","solver_strategy":"heuristic"}' AS payload
FROM hw_p p JOIN v_route USING (route_id) JOIN nw_p n USING (route_id) LEFT JOIN st USING (route_id) LEFT JOIN cd USING (route_id) WHERE p.feasible"""


@query(_PAYLOAD, recursive=True)
def jsn1_trip_payload(spark, d):
    """A planned trip as one JSON object: route, vehicle, stops with their reasons, savings and candidates; units are whole, unknown parts null."""
    stop = F.struct("stop_no", F.struct(F.col("opis_id"), F.col("reason").alias("purchase_reason"), "skipped_count", F.col("bypassed_count").alias("bypassed_cheaper_count")).alias("j"))
    stops = _context(spark, d).groupBy("route_id").agg(F.sort_array(F.collect_list(stop)).alias("s"))
    cand = F.struct("pos_milli_mi", "price_milli", "opis_id", F.struct("opis_id", F.col("price_milli").alias("price")).alias("j"))
    cands = src.candidates(spark, d).groupBy("route_id").agg(F.sort_array(F.collect_list(cand)).alias("c"))
    plans = _plans(spark, d, "heuristic", "naive").drop("stops")
    of = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    both = plans.groupBy("route_id").agg(of("heuristic", "feasible").alias("good"), of("naive", "feasible").alias("blind"), *[of(m, c).alias(f"{m}_{c}") for m in ("heuristic", "naive") for c in ("cost", "n_stops", "bought")])
    rows = both.where("good").join(src.routes(spark, d), "route_id").join(stops, "route_id", "left").join(cands, "route_id", "left")
    null = F.lit(None).cast("string")
    listed = lambda c: F.coalesce(F.to_json(F.transform(c, lambda x: x["j"])), F.lit("[]"))
    head = F.to_json(F.struct(null.alias("start"), null.alias("finish"), null.alias("route_geometry"), F.col("total_milli_mi").alias("total_route_milli")), {"ignoreNullFields": "false"})
    mid = F.to_json(
        F.struct(
            F.col("heuristic_cost").alias("total_cost_units"), F.col("heuristic_bought").alias("total_bought_milli"), null.alias("map_url"), F.struct(F.col("tank_milli_mi").alias("tank_milli"), F.col("on_board_milli_mi").alias("starting_milli")).alias("vehicle"),
            F.floor(F.col("total_milli_mi") / 17).cast("long").alias("total_duration_s"), F.col("heuristic_n_stops").alias("fuel_stop_count"),
            F.when(F.col("blind"), F.struct((F.col("naive_cost") - F.col("heuristic_cost")).alias("amount_units"), F.col("naive_n_stops").alias("naive_stop_count"))).alias("savings"),
            F.when(~F.col("blind"), "naive_plan_infeasible").alias("savings_note"),
        ),
        {"ignoreNullFields": "false"},
    )
    tail = F.lit('"price_index_status":"frozen","solver_strategy":"heuristic"}')
    inner = lambda j: F.regexp_replace(j, "^\\{|\\}$", "")
    return rows.select("route_id", F.concat(F.lit("{"), inner(head), F.lit(',"fuel_stops":'), listed("s"), F.lit(","), inner(mid), F.lit(',"candidate_stations":'), listed("c"), F.lit(","), tail).alias("payload"))


@query(_TRIPS + """ SELECT trip, '[' || string_agg('{"total_route_milli":' || total_milli_mi || ',"duration_s":' || coalesce(duration_s::VARCHAR, 'null') || ',"total_cost_units":' || coalesce(cost::VARCHAR, 'null') || ',"feasible":' || feasible || '}', ',' ORDER BY alternative_index, route_id) || ']' AS alternatives FROM x GROUP BY trip""", recursive=True)
def jsn3_alternatives(spark, d):
    """The alternatives of a trip as JSON, infeasible ones with a null cost."""
    one = F.struct(F.col("total_milli_mi").alias("total_route_milli"), "duration_s", F.col("cost").alias("total_cost_units"), "feasible")
    listed = _trips(spark, d).groupBy("trip").agg(F.sort_array(F.collect_list(F.struct("alternative_index", "route_id", one.alias("j")))).alias("v"))
    return listed.select("trip", F.to_json(F.transform("v", lambda x: x["j"]), {"ignoreNullFields": "false"}).alias("alternatives"))


@query("""SELECT route_id, opis_id, chr((64 + n)::INT) AS letter, (pos_milli_mi + 500) // 1000 AS at_mi, total_milli_mi // 17 * pos_milli_mi // total_milli_mi AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY pos_milli_mi, price_milli, opis_id) AS n FROM v_candidate) WHERE n <= 8""")
def win6_waypoint_markers(spark, d):
    n = F.row_number().over(Window.partitionBy("route_id").orderBy("pos_milli_mi", "price_milli", "opis_id"))
    rows = src.candidates(spark, d).withColumn("n", n).where("n <= 8")  # a trip takes eight waypoints
    return rows.selectExpr("route_id", "opis_id", "char(64 + n) AS letter", "(pos_milli_mi + 500) div 1000 AS at_mi", "total_milli_mi div 17 * pos_milli_mi div total_milli_mi AS seconds")


# --- measures and ladders


@query("""x AS (SELECT route_id, price_milli AS a, pos_milli_mi AS b, opis_id FROM v_candidate) SELECT p.route_id, count(*) AS discordant FROM x p JOIN x q ON p.route_id = q.route_id AND p.opis_id < q.opis_id AND sign(p.a - q.a) * sign(p.b - q.b) < 0 GROUP BY p.route_id""")
def agg22_discordant_pairs(spark, d):
    return arcs.discordant_pairs(spark, d)


@query("""h AS (SELECT sha256(concat(length(opis_id::VARCHAR), ':', opis_id, length(name), ':', name, length(state), ':', state, length(price_milli::VARCHAR), ':', price_milli, coalesce(length(geocode_precision) || ':' || geocode_precision, '-'))) AS x FROM v_station) SELECT count(*) AS n_rows, substr(sha256(sum(('0x' || substr(x, 1, 12))::BIGINT)::VARCHAR || '|' || sum(('0x' || substr(x, 13, 12))::BIGINT)::VARCHAR), 1, 12) AS digest FROM h""")
def agg26_content_digest(spark, d):
    return measure.content_digest(src.stations(spark, d), ["opis_id", "name", "state", "price_milli", "geocode_precision"])


LADDER = (50_000, 70_000, 130_000, 200_000, 400_000)
_LADDER = "ld(rung, prev) AS (VALUES " + ", ".join(f"({r}::BIGINT, {p}::BIGINT)" for r, p in zip(LADDER, (0, *LADDER))) + ")"


def _cells(spark, d):
    return arcs.efforts(spark, d)


@query(_EFFORT + f""", {_LADDER}, w AS (SELECT rung, (SELECT max(estimate) FROM ef WHERE estimate <= rung AND estimate > prev) AS worst, (SELECT count(*) FILTER (estimate % 5 <> 0) FROM ef WHERE estimate <= rung AND estimate > prev) AS unbroken FROM ld)
SELECT rung, worst, unbroken, bool_and(coalesce(worst <= 150000 AND unbroken > 0, false)) OVER (ORDER BY rung) AS adopted FROM w""")
def agg30_adopted_budget(spark, d):
    """The budget ladder: a rung counts if what it newly admits stays under the bar and not all of it breaks off, and if all rungs before count."""
    rungs = [F.struct(F.lit(r).cast("long").alias("rung"), F.max(F.when((F.col("estimate") <= r) & (F.col("estimate") > p), F.col("estimate"))).alias("worst"), F.count_if((F.col("estimate") <= r) & (F.col("estimate") > p) & (F.col("estimate") % 5 != 0)).alias("unbroken")) for r, p in zip(LADDER, (0, *LADDER))]
    rows = _cells(spark, d).agg(F.array(*rungs).alias("v")).select(F.explode("v").alias("x")).select("x.*")
    return measure.ladder_walk(rows, "rung", (F.col("worst") <= 150_000) & (F.col("unbroken") > 0))


@query(_EFFORT + f""", un AS (SELECT a.route_id, count(b.opis_id) + (a.pos_milli_mi + a.tank_milli_mi >= a.total_milli_mi)::INT AS reach FROM v_candidate a LEFT JOIN v_candidate b ON a.route_id = b.route_id AND (b.pos_milli_mi, b.price_milli, b.opis_id) > (a.pos_milli_mi, a.price_milli, a.opis_id) AND b.pos_milli_mi <= a.pos_milli_mi + a.tank_milli_mi GROUP BY a.route_id, a.opis_id, a.pos_milli_mi, a.tank_milli_mi, a.total_milli_mi),
ur AS (SELECT r.route_id, coalesce(w, 0) + coalesce(f, 0) + (total_milli_mi <= on_board_milli_mi)::INT AS raw FROM v_route r LEFT JOIN (SELECT route_id, sum(reach * (reach + 1)) AS w FROM un GROUP BY route_id) USING (route_id) LEFT JOIN (SELECT route_id, count(*) AS f FROM v_candidate WHERE pos_milli_mi <= on_board_milli_mi GROUP BY route_id) USING (route_id)),
c AS (SELECT count(*) FILTER (raw > 50000) AS demoted, count(*) FILTER (raw > 50000 AND estimate <= 50000) AS recovered FROM ur JOIN ef USING (route_id))
SELECT demoted, recovered, CASE WHEN recovered >= 3 THEN 'RECOVERED' ELSE 'NOT RECOVERED' END AS recovery, CASE WHEN recovered < 5 THEN 'PLATEAU' ELSE 'NO_PLATEAU' END AS plateau FROM c""")
def agg30_recovery_verdicts(spark, d):
    """Of the routes that the full list demotes, how many the pruned list admits; enough is a recovery, too few a plateau."""
    both = arcs.efforts(spark, d, unpruned=True).where(F.col("raw") > search.EXACT_BUDGET)
    n = both.agg(F.count(F.lit(1)).alias("demoted"), F.count_if(F.col("estimate") <= search.EXACT_BUDGET).alias("recovered"))
    return n.select("demoted", "recovered", F.when(F.col("recovered") >= 3, "RECOVERED").otherwise("NOT RECOVERED").alias("recovery"), F.when(F.col("recovered") < 5, "PLATEAU").otherwise("NO_PLATEAU").alias("plateau"))


@query(_EFFORT + " SELECT CASE WHEN estimate <= 50000 THEN 'exact_direct' WHEN estimate <= 200000 THEN 'exact_attempt' ELSE 'heuristic' END AS band, count(*) AS routes FROM ef GROUP BY 1")
def agg30_bands(spark, d):
    return _cells(spark, d).groupBy(measure.band(F.col("estimate"), 50_000, 200_000).alias("band")).agg(F.count(F.lit(1)).alias("routes"))


@query("SELECT event_id, CASE WHEN 140000 - up >= 3000 THEN (floor((140000 - up) / 3000.0::DOUBLE) * 0.1::DECIMAL(2,1))::DECIMAL(6,1) END AS deadline_s FROM (SELECT event_id, (event_id * 37 % 200) * 1000 AS up FROM events)")
def mat14_deadlines(spark, d):
    upstream = (F.col("event_id") * 37 % 200).cast("decimal(10,0)") / F.lit(10).cast("decimal(2,0)")
    return src.read(spark, d, "events").select("event_id", measure.deadline_seconds(upstream).alias("deadline_s"))


# --- time windows


_CAPS = """m AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 3 AS by_day FROM events), a AS (SELECT *, by_day AND sum(by_day::INT) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) <= 20 AS by_both FROM m)"""


@query(_CAPS + " SELECT 'day' AS caps, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, count(*) FILTER (by_day) AS admitted FROM a GROUP BY ALL UNION ALL SELECT 'day and month', strftime(ts, '%Y-%m-%d'), count(*), count(*) FILTER (by_both) FROM a GROUP BY ALL UNION ALL SELECT 'none', strftime(ts, '%Y-%m-%d'), count(*), count(*) FROM a GROUP BY ALL")
def stm1_capped_calls(spark, d):
    """Three calls a day; the same with twenty a month; and caps of 0, which switch their windows off."""
    events = src.read(spark, d, "events")
    told = lambda name, *caps: counters.capped_calls(events, *caps).select(F.lit(name).alias("caps"), "*")
    return told("day", 3).union(told("day and month", 3, 20)).union(told("none", 0, 0))


@query("""e AS (SELECT event_id, user_id, epoch_us(ts) AS stamp, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
t AS (SELECT event_id, user_id, k, true AS admitted, [stamp] AS log FROM e WHERE k = 1
  UNION ALL SELECT event_id, user_id, k, good, CASE WHEN good THEN list_append(kept, stamp) ELSE kept END FROM (SELECT e.*, list_filter(t.log, lambda x: x > e.stamp - 86400000000) AS kept, len(list_filter(t.log, lambda x: x > e.stamp - 3600000000)) < 3 AND len(list_filter(t.log, lambda x: x > e.stamp - 86400000000)) < 8 AS good FROM t JOIN e ON e.user_id = t.user_id AND e.k = t.k + 1))
SELECT event_id, user_id, admitted FROM t""", recursive=True)
def stm2_throttled(spark, d):
    """Three calls an hour and eight a day; refused calls do not count."""
    return rules.throttled(src.read(spark, d, "events"), 3, 3600, 8, 86_400)


@query("""w AS (SELECT event_id, user_id, event_type, ts, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER l AS ok, max(CASE WHEN event_type = 'error' THEN ts END) OVER l AS bad FROM events WINDOW l AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CASE WHEN ok IS NULL THEN 'missing' WHEN epoch_us(ts) - epoch_us(ok) <= 86400000000 THEN 'current' WHEN epoch_us(ts) - epoch_us(ok) <= 604800000000 THEN 'stale' ELSE 'frozen' END AS state FROM w WHERE event_type = 'view')
SELECT event_id, state, state <> 'current' AND coalesce(epoch_us(ts) - epoch_us(bad) >= 3600000000, true) AS fetches FROM s""")
def stm3_table_state(spark, d):
    return counters.as_of_state(src.read(spark, d, "events"), "purchase", "error", "view", 86_400, 604_800, 3600).select("event_id", "state", "fetches")


@query("""SELECT opis_id, CASE WHEN opis_id % 3 = 0 THEN 'created' WHEN opis_id % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS change, price_milli + CASE WHEN opis_id % 3 <> 0 AND opis_id % 5 = 0 THEN 7 ELSE 0 END AS price_milli FROM v_station""")
def stm5_refreshed(spark, d):
    """One turn of the refresh loop: two releases land as files, the newest is found, read and held against the stations of the one before."""
    k = F.col("opis_id")
    s = src.stations(spark, d)
    old = s.where(k % 3 != 0).select("opis_id", "price_milli", F.lit("2025-01-15.0").alias("release"))
    new = s.select("opis_id", (F.col("price_milli") + F.when((k % 3 != 0) & (k % 5 == 0), 7).otherwise(0)).alias("price_milli"), F.lit("2025-02-19.0").alias("release"))
    path = files.write_extract(old.union(new))
    newest = files.releases(spark, path).agg(F.max("release")).first()[0]
    seen = spark.read.parquet(path)
    before, after = seen.where(F.col("release") < newest), seen.where(F.col("release") == newest)
    landed = after.select("opis_id", F.lit(1).alias("file_no"), "price_milli", k.alias("line_no"))
    return cleaning.upsert_plan(before.select("opis_id", "price_milli"), landed, "price_milli").select("opis_id", "change", "price_milli")


@query("SELECT user_id, count(*) AS bursts, sum(n)::BIGINT AS events FROM (SELECT user_id, b, count(*) AS n FROM (SELECT user_id, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM (SELECT *, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 3600000000)::INT AS starts FROM events)) GROUP BY ALL) GROUP BY user_id")
def stm6_bursts(spark, d):
    """Bursts by session windows, as the stream counts them, over the table at once."""
    return counters.stream_bursts(src.read(spark, d, "events"), "1 hour").groupBy("user_id").agg(F.count(F.lit(1)).alias("bursts"), F.sum("events").alias("events"))


# --- checks and details


@query("""s AS (SELECT CASE WHEN opis_id % 4 = 1 THEN 1000000000 + CASE WHEN opis_id % 80 = 1 THEN -5 ELSE opis_id END ELSE opis_id END::BIGINT AS id, CASE WHEN opis_id % 4 = 1 THEN 'overture' WHEN opis_id % 90 = 2 THEN 'odd' ELSE 'opis' END AS source, opis_id % 4 = 1 AND opis_id % 120 <> 5 AS has_key, price_source, baseline_milli,
  CASE WHEN opis_id % 4 = 1 AND opis_id % 100 <> 9 THEN baseline_milli ELSE price_milli END AS price_milli FROM v_station LEFT JOIN v_state USING (state))
SELECT count(*) FILTER (source = 'odd') AS unknown_source, count(*) FILTER (source = 'overture' AND (NOT has_key OR id < 1000000000)) AS bad_minted, count(*) FILTER (source <> 'overture' AND id BETWEEN 1000000000 AND 1999999999) AS in_reserved_span, max(CASE WHEN source <> 'overture' THEN id END) AS max_other_id,
  count(*) FILTER (price_source = 'eia_regional_estimate' AND price_milli IS DISTINCT FROM baseline_milli) AS estimate_off_baseline FROM s""")
def agg10_invariants(spark, d):
    """Counts of broken invariants, over stations some of which were spoilt."""
    k, minted = F.col("opis_id").cast("long"), F.col("opis_id") % 4 == 1
    s = src.stations(spark, d).join(F.broadcast(src.state_regions(spark)), "state", "left")
    rows = s.select(
        F.when(minted, cleaning.ID_BASE + F.when(k % 80 == 1, -5).otherwise(k)).otherwise(k).alias("opis_id"), F.when(minted, "overture").when(k % 90 == 2, "odd").otherwise("opis").alias("source"), F.when(minted & (k % 120 != 5), F.concat(F.lit("g-"), k)).alias("gers_id"),
        "price_source", "baseline_milli", F.when(minted & (k % 100 != 9), F.col("baseline_milli")).otherwise(F.col("price_milli")).alias("price_milli"),
    )
    return rules.invariant_violations(rows, cleaning.ID_BASE, 1_000_000_000)


@query("""f AS (SELECT opis_id, 1 AS file_no, price_milli + CASE WHEN opis_id % 3 = 0 THEN 5 ELSE 0 END AS p FROM v_station WHERE opis_id % 2 = 0 UNION ALL SELECT opis_id + 1000000, 1, price_milli FROM v_station WHERE opis_id % 11 = 0 UNION ALL SELECT opis_id, 2, price_milli FROM v_station WHERE opis_id % 9 = 0)
SELECT file_no, CASE WHEN s.opis_id IS NULL THEN 'created' WHEN s.price_milli = p THEN 'unchanged' ELSE 'updated' END AS change, count(*) AS n FROM f LEFT JOIN v_station s USING (opis_id) GROUP BY ALL""")
def snk4_file_counts(spark, d):
    """What each file's own rows would change, against the one snapshot taken before."""
    s = src.stations(spark, d).select("opis_id", "price_milli")
    row = lambda rows, key, no, price: rows.select(key.alias("opis_id"), F.lit(no).alias("file_no"), price.alias("price_milli"))
    k, price = F.col("opis_id"), F.col("price_milli")
    landed = row(s.where(k % 2 == 0), k, 1, price + F.when(k % 3 == 0, 5).otherwise(0)).union(row(s.where(k % 11 == 0), k + 1_000_000, 1, price)).union(row(s.where(k % 9 == 0), k, 2, price))
    return cleaning.file_changes(s, landed, "price_milli").groupBy("file_no", "change").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT opis_id, CASE WHEN opis_id % 5 <> 0 THEN '2025-0' || (1 + opis_id % 9) || '-15.' || opis_id % 3 END AS release, opis_id % 5 <> 0 AS valid FROM v_station")
def str8_release_names(spark, d):
    k = F.col("opis_id")
    name = F.format_string("2025-0%d-15.%d", 1 + k % 9, k % 3)
    path = F.concat(F.lit("/places/release="), F.when(k % 5 == 0, F.lit("latest")).otherwise(name), F.lit("/part-0.parquet"))
    return src.stations(spark, d).select("opis_id", files.release_of(path).alias("release"), files.is_release(files.release_of(path)).alias("valid"))


@query("SELECT ['id', 'name', 'city', 'state'][opis_id % 4 + 1] AS missing, count(*) AS files FROM v_station GROUP BY 1")
def set5_missing_columns(spark, d):
    """Headers that lack one required column each, among columns nobody asked for."""
    required, k = ["id", "name", "city", "state"], F.col("opis_id")
    kept = F.filter(F.array(*map(F.lit, required)), lambda c: c != F.element_at(F.array(*map(F.lit, required)), (k % 4 + 1).cast("int")))
    header = F.concat(F.array_join(kept, ","), F.lit(",extra"))
    return src.stations(spark, d).select(F.array_join(files.missing_columns(header, required), ",").alias("missing")).groupBy("missing").agg(F.count(F.lit(1)).alias("files"))


@query(_CORRIDOR + " WHERE route_id % 50 = 0")
def join3_range_corridor(spark, d):
    """The range join of the segments' padded boxes, for the stated query set of routes whose id is divisible by 50, with all stations."""
    return corridor.corridor_referee(src.route_lines(spark, d).where("route_id % 50 = 0"), src.stations(spark, d))


@query(_WALK + f""" SELECT s.route_id, stop_no::INT AS stop_no, id AS opis_id, (amount * 0.0001::DECIMAL(5,4))::DECIMAL(12,4) AS gallons, {_usd('(price * amount)')} AS cost_usd, on_board_milli_mi AS starting_milli FROM hw_s s JOIN v_route USING (route_id)""", recursive=True)
def mat9_stop_costs(spark, d):
    """Gallons and cost of each stop, and the miles that the fuel aboard lasts at the start."""
    stops = _stops(spark, d)
    gallons = (F.col("amount").cast("decimal(14,0)") * F.lit(0.0001).cast("decimal(5,4)")).cast("decimal(12,4)")
    return stops.select("route_id", "stop_no", F.col("id").alias("opis_id"), gallons.alias("gallons"), search.dollars(F.col("price") * F.col("amount")).alias("cost_usd"), F.col("on_board_milli_mi").alias("starting_milli"))


@query(_PLAN_LEGS + """ SELECT route_id, '[' || string_agg('{"from_milli":' || from_milli || ',"to_milli":' || to_milli || ',"bought_milli":' || bought_milli || ',"cost_units":' || cost || '}', ',' ORDER BY leg) || ']' AS legs FROM lg WHERE leg >= 0 GROUP BY route_id""", recursive=True)
def jsn3_legs(spark, d):
    leg = F.struct("from_milli", "to_milli", "bought_milli", F.col("cost").alias("cost_units"))
    rows = trips.plan_legs(_plans(spark, d, "heuristic"), src.routes(spark, d)).groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("leg", leg.alias("j")))).alias("v"))
    return rows.select("route_id", F.to_json(F.transform("v", lambda x: x["j"])).alias("legs"))
