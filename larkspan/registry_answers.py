"""The whole answer to a trip, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text
from .operators import lines
from .plans import answers, trips
from .registry import _FACTORS, _factors, query
from .registry_geometry import _LETTERS, MAPS, SPLIT, STEPS, TOKEN
from .registry_plans import _CONTEXT, _NAIVE, _percent, _plans
from .sources import adapters as src


def _money(x: str) -> str:
    return f"(floor(({x} + 50000) / 100000::DOUBLE)::BIGINT * 0.01::DECIMAL(3,2))::DECIMAL(18,2)::VARCHAR"


def _price(x: str) -> str:
    return f"(floor({x} / 10::DOUBLE + 0.5000001::DOUBLE)::BIGINT * 0.01::DECIMAL(3,2))::DECIMAL(18,2)::VARCHAR"


def _gallons(x: str) -> str:
    return f"(floor(({x} + 50) / 100::DOUBLE)::BIGINT * 0.01::DECIMAL(3,2))::DECIMAL(18,2)::VARCHAR"


def _miles(x: str) -> str:
    return f"(({x} + 500) // 1000)::VARCHAR"


def _tenths(x: str) -> str:
    return f"(floor({x} * 1000 + 0.5000001::DOUBLE)::BIGINT * 0.1::DECIMAL(2,1))::DECIMAL(8,1)::VARCHAR"


def _deg(x: str) -> str:
    return f"({x}::BIGINT * 0.000001::DECIMAL(7,6))::DECIMAL(10,6)::VARCHAR"


def _elapsed(m: str) -> str:
    """The time at mile ``m`` on an axis of eight segments, the later the slower."""
    i = f"len([k FOR k IN range(1, 8) IF k * w.total_milli_mi // 8 <= {m}])"
    d = lambda j: f"(({j}) * w.total_milli_mi // 8)"
    s = lambda j: f"(w.duration_s * ({j}) * ({j}) // 64)"
    return f"({s(i)} + ({m} - {d(i)}) * ({s(i + ' + 1')} - {s(i)})::DOUBLE / ({d(i + ' + 1')} - {d(i)}))"


def _sec(x: str) -> str:
    return f"CASE WHEN w.duration_s IS NOT NULL THEN floor({x} + 0.5000001::DOUBLE)::BIGINT END"


_KNOWN = "CASE WHEN {0} IS NOT NULL THEN {1} END"
_TWIN = ", ".join((_CONTEXT, _NAIVE, "ln AS (SELECT route_id, seq, lng_u::DOUBLE AS x, lat_u::DOUBLE AS y FROM v_point)", SPLIT, _FACTORS)) + f""",
tp AS MATERIALIZED (SELECT r.route_id // 3 AS trip, r.*, h.feasible, h.cost, h.bought, n.cost AS naive_cost, n.bought AS naive_bought, n.n_stops AS naive_n_stops, CASE WHEN r.route_id % 5 <> 0 THEN total_milli_mi // 17 END AS duration_s FROM v_route r JOIN hw_p h USING (route_id) JOIN nw_p n USING (route_id)),
wl AS (SELECT trip, arg_min(route_id, {{'c': cost, 'm': total_milli_mi, 'd': coalesce(duration_s, 4611686018427387904), 'i': alternative_index, 'r': route_id}}) FILTER (feasible) AS best,
  list({{'r': route_id, 'm': {_miles('total_milli_mi')}, 'd': duration_s, 'c': CASE WHEN cost IS NOT NULL THEN {_money('cost')} END, 'f': feasible}} ORDER BY alternative_index, route_id) AS listed FROM tp GROUP BY trip),
wr AS MATERIALIZED (SELECT tp.*, [{{'total_route_mi': a.m, 'duration_s': a.d, 'total_cost': a.c, 'chosen': a.r = best, 'feasible': a.f}} FOR a IN listed] AS alternatives FROM wl JOIN tp ON tp.route_id = best),
ws AS (SELECT s.route_id, s.stop_no, s.pos, s.amount, s.price, c.*  EXCLUDE (route_id, stop_no), v.name, v.price_source, t.name AS target_name, CASE WHEN v.geocode_status = 'ok' THEN v.lat_u END AS lat_u, CASE WHEN v.geocode_status = 'ok' THEN v.lng_u END AS lng_u
  FROM hw_s s JOIN wr USING (route_id) JOIN sc c ON c.route_id = s.route_id AND c.stop_no = s.stop_no JOIN v_station v ON v.opis_id = s.id LEFT JOIN v_station t ON t.opis_id = c.target_id),
wj AS (SELECT route_id, list({{'name': name, 'station_id': opis_id, 'location': CASE WHEN lat_u IS NOT NULL THEN {{'lat': {_deg('lat_u')}, 'lng': {_deg('lng_u')}}} END, 'distance_from_start_mi': {_miles('pos')}, 'price_per_gallon': {_price('price')}, 'gallons': {_gallons('amount')}, 'cost': {_money('amount * price')}, 'price_source': price_source,
    'rationale': {{'purchase_reason': reason, 'reason_target_station_id': target_id, 'reason_target_name': target_name, 'skipped_count': skipped_count, 'skipped_avg_price': {_KNOWN.format('skipped_avg_milli', _price('skipped_avg_milli'))}, 'corridor_avg_price': {_price('corridor_avg_milli')},
      'price_percentile': {_tenths('price_percentile')}, 'bypassed_cheaper_count': bypassed_count, 'bypassed_saving_forgone': {_KNOWN.format('bypassed_saving', _money('bypassed_saving'))}, 'bypassed_estimate_count': bypassed_estimate_count, 'bypassed_estimate_saving_forgone': {_KNOWN.format('bypassed_estimate_saving', _money('bypassed_estimate_saving'))}}}}} ORDER BY stop_no) AS stops,
  string_agg('pin-s-' || k || '+{lines.STOP_PIN}(' || {_deg('lng_u')} || ',' || {_deg('lat_u')} || ')', ',' ORDER BY stop_no) FILTER (lat_u IS NOT NULL) AS pins FROM (SELECT *, count(lat_u) OVER (PARTITION BY route_id ORDER BY stop_no) AS k FROM ws) GROUP BY route_id),
wn2 AS (SELECT route_id, stop_no, name, pos, amount, amount * price AS cost FROM ws UNION ALL SELECT route_id, -1, 'START', 0, 0, 0 FROM wr UNION ALL SELECT route_id, 1000000, 'FINISH', total_milli_mi, 0, 0 FROM wr),
we AS (SELECT w.route_id, list({{'from': name, 'to': nn, 'distance_mi': {_miles('np - pos')}, 'duration_s': {_sec(_elapsed('np') + ' - ' + _elapsed('pos'))}, 'gallons': {_gallons('amount')}, 'cost': {_money('n.cost')}}} ORDER BY stop_no) AS legs
  FROM (SELECT *, lead(name) OVER l AS nn, lead(pos) OVER l AS np FROM wn2 WINDOW l AS (PARTITION BY route_id ORDER BY stop_no)) n JOIN wr w USING (route_id) WHERE np IS NOT NULL GROUP BY w.route_id),
wc AS (SELECT route_id, list({{'station_id': opis_id::BIGINT, 'lat': {_deg('lat_u')}, 'lng': {_deg('lng_u')}, 'price_per_gallon': {_price('price_milli')}, 'distance_from_start_mi': {_miles('pos_milli_mi')}}} ORDER BY pos_milli_mi, price_milli, opis_id) AS near
  FROM (SELECT route_id, opis_id, price_milli, pos_milli_mi FROM v_candidate) JOIN (SELECT route_id FROM wr) USING (route_id) JOIN (SELECT opis_id, lat_u, lng_u FROM v_station WHERE geocode_status = 'ok') USING (opis_id) GROUP BY route_id),
wg AS (SELECT route_id, list([{_deg('x')}, {_deg('y')}] ORDER BY seq) FILTER (scale > 5000) AS geometry, {", ".join(f"any_value({_deg(c)}) FILTER (seq = {n}) AS {c}{n}" for n in (0, STEPS // 2, STEPS) for c in "xy")} FROM sl JOIN (SELECT route_id FROM wr) USING (route_id) GROUP BY route_id),
dl AS (SELECT route_id, seq, v - coalesce(lag(v) OVER l, 0) AS dv, u - coalesce(lag(u) OVER l, 0) AS du FROM (SELECT *, (sign(y) * ((abs(y)::BIGINT + 5) // 10))::BIGINT AS v, (sign(x) * ((abs(x)::BIGINT + 5) // 10))::BIGINT AS u FROM sl JOIN (SELECT route_id FROM wr) USING (route_id) WHERE scale > 100) WINDOW l AS (PARTITION BY route_id ORDER BY seq)),
zz AS (SELECT route_id, seq, CASE WHEN dv < 0 THEN -2 * dv - 1 ELSE 2 * dv END AS zv, CASE WHEN du < 0 THEN -2 * du - 1 ELSE 2 * du END AS zu FROM dl),
wt AS (SELECT route_id, url_encode(string_agg({_LETTERS.replace('V', 'zv')} || {_LETTERS.replace('V', 'zu')}, '' ORDER BY seq)) AS path FROM zz GROUP BY route_id),
wd AS (SELECT route_id, arg_max(region, {{'n': n, 'f': -first}}) AS region FROM (SELECT route_id, region, count(*) AS n, min(pos) AS first FROM hw_s JOIN (SELECT opis_id AS id, state FROM v_station) USING (id) JOIN v_state USING (state) GROUP BY ALL) GROUP BY route_id),
wm AS (SELECT route_id, arg_min(region, {{'p': pos_milli_mi, 'i': opis_id}}) AS region FROM v_candidate LEFT JOIN v_state USING (state) GROUP BY route_id),
wk AS (SELECT w.route_id, CASE WHEN wd.route_id IS NOT NULL THEN wd.region ELSE wm.region END AS region FROM wr w LEFT JOIN wd USING (route_id) LEFT JOIN wm USING (route_id)),
wf AS (SELECT wk.route_id, wk.region, f.delta_cents, f.week FROM wk LEFT JOIN f ON f.region = wk.region AND f.factor IS NOT NULL),
co AS (SELECT format('{{:,}}', count(*)) || ' stations — ' || format('{{:,}}', count(*) FILTER (price_source = 'opis_indexed')) || ' recorded, ' || format('{{:,}}', count(*) FILTER (price_source <> 'opis_indexed')) || ' regional estimates.' AS note FROM v_station WHERE geocode_status = 'ok')
SELECT w.trip, to_json({{'start': {{'lat': y0, 'lng': x0}}, 'finish': {{'lat': y{STEPS}, 'lng': x{STEPS}}}, 'route_geometry': geometry, 'total_route_mi': {_miles('w.total_milli_mi')}, 'fuel_stops': coalesce(stops, []), 'total_cost': {_money('w.cost')}, 'total_gallons': {_gallons('w.bought')},
  'map_url': '{MAPS}/' || concat_ws(',', 'pin-s-a+{lines.START_PIN}(' || x0 || ',' || y0 || ')', pins, 'pin-s-b+{lines.FINISH_PIN}(' || x{STEPS} || ',' || y{STEPS} || ')') || ',{lines.PATH}(' || path || ')/auto/{lines.IMAGE}?access_token={TOKEN}',
  'vehicle': {{'mpg': '10', 'tank_range_mi': {_miles('w.tank_milli_mi')}, 'starting_fuel': {_tenths('w.on_board_milli_mi / w.tank_milli_mi::DOUBLE / 100')}, 'starting_fuel_mi': {_miles('w.on_board_milli_mi')}}}, 'legs': legs, 'total_duration_s': w.duration_s, 'fuel_stop_count': len(coalesce(stops, [])),
  'savings': CASE WHEN w.naive_cost IS NOT NULL THEN {{'amount': {_money('(w.naive_cost - w.cost)')}, 'percent': {_percent('(w.naive_cost - w.cost)', 'w.naive_cost')}::VARCHAR, 'naive_total_cost': {_money('w.naive_cost')}, 'naive_total_gallons': {_gallons('w.naive_bought')}, 'naive_stop_count': w.naive_n_stops::BIGINT}} END,
  'savings_note': CASE WHEN w.naive_cost IS NULL THEN 'naive_plan_infeasible' END, 'alternatives_considered': len(alternatives), 'alternatives': alternatives, 'candidate_stations': coalesce(near, []),
  'waypoints': [{{'label': 'A', 'name': 'Start', 'lat': y0, 'lng': x0, 'distance_from_start_mi': {_miles('0')}, 'duration_s': {_sec(_elapsed('0'))}}}, {{'label': 'B', 'name': 'Waypoint 1', 'lat': y{STEPS // 2}, 'lng': x{STEPS // 2}, 'distance_from_start_mi': {_miles('w.total_milli_mi // 2')}, 'duration_s': {_sec(_elapsed('(w.total_milli_mi // 2)'))}}},
    {{'label': 'C', 'name': 'Finish', 'lat': y{STEPS}, 'lng': x{STEPS}, 'distance_from_start_mi': {_miles('w.total_milli_mi')}, 'duration_s': {_sec(_elapsed('w.total_milli_mi'))}}}],
  'price_as_of': CASE WHEN delta_cents IS NULL THEN '{answers.SNAPSHOT[0]}' ELSE strftime(week::DATE, '%b %-d, %Y') END, 'price_data_note': CASE WHEN delta_cents IS NULL THEN '{answers.SNAPSHOT[1]}' ELSE 'Station prices indexed to the EIA week of ' || strftime(week::DATE, '%b %-d, %Y') || '.' END,
  'station_data_note': note, 'price_index_status': CASE WHEN delta_cents IS NULL THEN 'frozen' ELSE 'current' END, 'eia_week': week, 'trend_region': region, 'trend_delta_cents': delta_cents, 'solver_strategy': 'heuristic'}})::VARCHAR AS answer
FROM wr w JOIN we USING (route_id) JOIN wg USING (route_id) JOIN wt USING (route_id) JOIN wf USING (route_id) LEFT JOIN wj USING (route_id) LEFT JOIN wc USING (route_id), co"""


@query(_TWIN, recursive=True)
def jsn1_whole_answer(spark, d):
    """Every trip's winning alternative as one JSON object of 26 keys: geometry, plan and reasons, legs, savings, alternatives, candidates, waypoints, freshness and trend."""
    routes, c, stations = src.routes(spark, d), src.candidates(spark, d), src.stations(spark, d)
    plans = _plans(spark, d, "heuristic", "naive")
    of = lambda m, x, name: F.max(F.when(F.col("asked") == m, F.col(x))).alias(name)
    figures = plans.groupBy("route_id").agg(
        of("heuristic", "feasible", "feasible"), of("heuristic", "method", "strategy"), *[of("heuristic", x, x) for x in ("cost", "bought")], *[of("naive", x, f"naive_{x}") for x in ("cost", "bought", "n_stops")]
    )
    duration = F.when(F.col("route_id") % 5 != 0, F.floor(F.col("total_milli_mi") / 17).cast("long"))
    every = figures.join(routes, "route_id").withColumn("trip", F.floor(F.col("route_id") / 3)).withColumn("duration_s", duration)
    stops = trips.stop_context(trips.numbered_stops(plans.where("asked = 'heuristic'"), routes), c).withColumnRenamed("id", "opis_id")

    regional = c.join(F.broadcast(src.state_regions(spark)), "state", "left")
    per = stops.select("route_id", F.col("opis_id").cast("int").alias("opis_id"), "pos").join(regional.select("route_id", "opis_id", "region"), ["route_id", "opis_id"]).where("region IS NOT NULL")
    most = per.groupBy("route_id", "region").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).groupBy("route_id").agg(F.max(F.struct("n", -F.col("first"), "region")).alias("b"))
    nearest = regional.groupBy("route_id").agg(F.min(F.struct("pos_milli_mi", "opis_id", "region")).alias("m"))
    region = nearest.join(most, "route_id", "left").select("route_id", F.when(F.col("b").isNotNull(), F.col("b.region")).otherwise(F.col("m.region")).alias("region"))
    trends = region.join(F.broadcast(_factors(spark, d).where("factor IS NOT NULL").select("region", "delta_cents", "week")), "region", "left")

    ok = stations.where("geocode_status = 'ok'")
    recorded = F.count_if(F.col("price_source") == "opis_indexed")
    composition = ok.agg(F.count(F.lit(1)).alias("n"), recorded.alias("r"), F.count_if(F.col("price_source") == "eia_regional_estimate").alias("e")).select(text.station_note(F.col("n"), F.col("r"), F.col("e")).alias("note"))

    def elapsed(m):
        total, whole = F.col("total_milli_mi"), F.col("duration_s")
        i = F.size(F.filter(F.sequence(F.lit(1), F.lit(7)), lambda k: F.floor(k * total / 8) <= m))
        at = lambda j: F.floor(j * total / 8)
        by = lambda j: F.floor(whole * j * j / 64)
        return by(i) + (m - at(i)) * (by(i + 1) - by(i)).cast("double") / (at(i + 1) - at(i))

    return answers.whole_answers(every, stops, stations, c, src.route_points(spark, d), trends, composition, elapsed, MAPS, TOKEN)
