"""All registered queries of the engine's own operators, by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import plan_sql
from .adapter_sql import sql
from .functions import text
from .operators import cleaning, corridor, measure, pricing
from .plans import arcs, search
from .sources import adapters as src
from .sources import files
from .streaming import counters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(body: str | None = None, recursive: bool = False):
    """Register a query under its function's name, with its SQL twin if SQL can express it."""

    def mark(f):
        QUERIES[f.__name__] = f
        if body:
            ORACLE_SQL[f.__name__] = sql(body, recursive)
        return f

    return mark


# --- sources and cleaning


@query("""SELECT geocode_precision, count(*) AS stations, min(opis_id) AS least_id FROM v_station WHERE geocode_status = 'ok' AND lat_u BETWEEN 24400000 AND 49400000 AND lng_u BETWEEN -125000000 AND -66900000 GROUP BY ALL""")
def fil1_routable_in_bounds(spark, d):
    rows = src.stations(spark, d).where((F.col("geocode_status") == "ok") & F.col("lat_u").between(24_400_000, 49_400_000) & F.col("lng_u").between(-125_000_000, -66_900_000))
    return rows.groupBy("geocode_precision").agg(F.count(F.lit(1)).alias("stations"), F.min("opis_id").alias("least_id"))


_DIRTY = """dirty AS (SELECT opis_id, CASE opis_id % 7 WHEN 0 THEN 'Pilot � stop' WHEN 1 THEN 'Loves EV Charging' WHEN 2 THEN 'Love''s Travel Stop' WHEN 3 THEN 'TA Petro Atlanta' WHEN 4 THEN 'Atlanta Fuel' WHEN 5 THEN 'Flying-J Travel Center' ELSE 'H2 Hub' END AS name,
  CASE opis_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN NULL WHEN 2 THEN ' Permanently_Closed ' ELSE '' END AS status, (opis_id % 100) / 100.0 AS confidence FROM v_station)"""


def _dirty(spark, d):
    names = ("Pilot � stop", "Loves EV Charging", "Love's Travel Stop", "TA Petro Atlanta", "Atlanta Fuel", "Flying-J Travel Center", "H2 Hub")
    status = F.when(F.col("opis_id") % 5 == 0, "open").when(F.col("opis_id") % 5 == 1, None).when(F.col("opis_id") % 5 == 2, " Permanently_Closed ").otherwise("")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("opis_id") % 7 + 1).cast("int"))
    return src.stations(spark, d).select("opis_id", name.alias("name"), status.alias("status"), (F.col("opis_id") % 100 / 100).alias("confidence"))


@query(_DIRTY + """ SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN contains(name, '�') THEN 'mojibake' WHEN opis_id % 7 IN (1, 6) THEN 'alt_fuel' WHEN lower(trim(status)) IN ('permanently_closed', 'temporarily_closed') THEN 'closed' WHEN confidence < 0.5 THEN 'below_floor' ELSE 'kept' END AS bucket FROM dirty) GROUP BY bucket""")
def fil7_hygiene_cascade(spark, d):
    return cleaning.hygiene(_dirty(spark, d), "name", "status", "confidence").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(_DIRTY + """ SELECT opis_id, CASE opis_id % 7 WHEN 0 THEN 'PILOT' WHEN 1 THEN 'LOVES' WHEN 2 THEN 'LOVES' WHEN 3 THEN 'TA' WHEN 5 THEN 'FLYING J' END AS chain FROM dirty""")
def str3_chain_alias(spark, d):
    return _dirty(spark, d).select("opis_id", text.chain_of(F.col("name")).alias("chain"))


_PLACES = """CASE opis_id % 4 WHEN 0 THEN 'St. ' || city || ' city' WHEN 1 THEN 'Ft ' || city || ' Town' WHEN 2 THEN 'N. ' || city ELSE city || ' CDP' END"""


def _place():
    c, k = F.col("city"), F.col("opis_id") % 4
    return F.when(k == 0, F.concat(F.lit("St. "), c, F.lit(" city"))).when(k == 1, F.concat(F.lit("Ft "), c, F.lit(" Town"))).when(k == 2, F.concat(F.lit("N. "), c)).otherwise(F.concat(c, F.lit(" CDP")))


@query("""SELECT opis_id, CASE opis_id % 4 WHEN 0 THEN 'SAINT ' WHEN 1 THEN 'FORT ' WHEN 2 THEN 'NORTH ' ELSE '' END || upper(city) AS place FROM v_station""")
def str1_place_key(spark, d):
    return src.stations(spark, d).select("opis_id", text.place_key(_place()).alias("place"))


@query("""g AS (SELECT upper(city) AS place, state, max_by(lat_u, opis_id) AS lat_u FROM v_station WHERE opis_id % 3 = 0 GROUP BY ALL)
SELECT s.opis_id, CASE WHEN s.geocode_precision = 'rooftop' THEN 'rooftop' WHEN g.place IS NOT NULL THEN 'city' ELSE 'failed' END AS result, CASE WHEN s.geocode_precision = 'rooftop' THEN s.lat_u ELSE g.lat_u END AS lat_u
FROM v_station s LEFT JOIN g ON upper(s.city) = g.place AND s.state = g.state""")
def join7_geocode_fallback(spark, d):
    s = src.stations(spark, d)
    g = s.where("opis_id % 3 = 0").groupBy(text.place_key(F.col("city")).alias("place"), "state").agg(F.max_by("lat_u", "opis_id").alias("g_lat"))
    j = s.withColumn("place", text.place_key(F.col("city"))).join(g, ["place", "state"], "left")
    roof = F.col("geocode_precision") == "rooftop"
    return j.select("opis_id", F.when(roof, "rooftop").when(F.col("g_lat").isNotNull(), "city").otherwise("failed").alias("result"), F.when(roof, F.col("lat_u")).otherwise(F.col("g_lat")).alias("lat_u"))


_COLLAPSED = """c AS (SELECT opis_id, quantile_disc(price_milli, 0.5)::BIGINT AS median_low_milli, min(price_milli) AS min_milli, max(price_milli) AS max_milli, count(*) AS observation_count, arg_max(name, {'l': length(name), 'o': -obs_ord}) AS name, arg_min(rack_id, {'o': obs_ord, 'r': rack_id}) AS rack_id FROM v_price_obs GROUP BY opis_id)"""


@query(_COLLAPSED + " SELECT * FROM c")
def agg1_duplicate_collapse(spark, d):
    return cleaning.collapse(src.price_observations(spark, d), "rack_id")


@query(_COLLAPSED + """ SELECT count(*) AS groups, count(*) FILTER (observation_count > 1) AS duplicated, count(*) FILTER (observation_count > 1 AND max_milli = min_milli) AS equal_price, count(*) FILTER (observation_count > 1 AND max_milli > min_milli) AS conflicting,
quantile_disc(CASE WHEN observation_count > 1 THEN max_milli - min_milli END, 0.5)::BIGINT AS median_spread_milli, max(CASE WHEN observation_count > 1 THEN max_milli - min_milli END) AS max_spread_milli FROM c""")
def agg2_duplicate_report(spark, d):
    return cleaning.duplicate_report(files.written(cleaning.collapse(src.price_observations(spark, d)), "station-groups"))


_INCOMING = """i AS (SELECT opis_id AS in_id, CASE opis_id % 3 WHEN 0 THEN 'Pilot ' || name ELSE name END AS name, city, state, lat_u + (opis_id % 9 - 4) * 1000 AS lat_u, lng_u + (opis_id % 7 - 3) * 1000 AS lng_u FROM v_station),
r AS (SELECT opis_id, lat_u, lng_u, floor(lat_u / (1000000 // 69.172)) AS cy, floor(lng_u / (1000000 // 41.5032)) AS cx FROM v_station WHERE geocode_precision = 'rooftop'),
n AS (SELECT in_id, arg_min(opis_id, {'d': dist, 'i': opis_id}) AS match_id, min(dist) AS dist_mi FROM (
  SELECT i.in_id, r.opis_id, round(sqrt(power((i.lat_u - r.lat_u) / 1e6 * 69.172, 2) + power((i.lng_u - r.lng_u) / 1e6 * 69.172 * cos(radians((i.lat_u + r.lat_u) / 2e6)), 2)), 4) AS dist
  FROM i JOIN r ON abs(floor(i.lat_u / (1000000 // 69.172)) - cy) <= 1 AND abs(floor(i.lng_u / (1000000 // 41.5032)) - cx) <= 1) GROUP BY in_id)"""


def _incoming(spark, d):
    k = F.col("opis_id")
    name = F.when(k % 3 == 0, F.concat(F.lit("Pilot "), "name")).otherwise(F.col("name"))
    return src.stations(spark, d).select(
        k.alias("in_id"), name.alias("name"), "city", "state", (F.col("lat_u") + (k % 9 - 4) * 1000).alias("lat_u"), (F.col("lng_u") + (k % 7 - 3) * 1000).alias("lng_u")
    )


def _existing(spark, d):
    return src.stations(spark, d).withColumn("name", F.when(F.col("opis_id") % 2 == 0, F.concat(F.lit("PILOT #"), "opis_id")).otherwise(F.col("name")))


@query(_INCOMING + " SELECT in_id, match_id, dist_mi FROM n")
def join4_nearest_rooftop(spark, d):
    return cleaning.nearest_rooftop(_incoming(spark, d), src.stations(spark, d))


@query(_INCOMING + """, c AS (SELECT lower(city) AS city, state, min(opis_id) AS m2 FROM v_station WHERE geocode_precision = 'city' AND opis_id % 2 = 0 GROUP BY ALL)
SELECT i.in_id, CASE WHEN dist_mi <= 0.25 THEN 1 WHEN m2 IS NOT NULL THEN 2 END AS tier, CASE WHEN dist_mi <= 0.25 THEN match_id ELSE m2 END AS match_id, dist_mi, CASE WHEN dist_mi <= 0.25 OR m2 IS NOT NULL THEN 'drop' ELSE 'keep' END AS decision,
  CASE WHEN dist_mi <= 0.25 THEN 'rooftop_within_threshold' WHEN m2 IS NOT NULL THEN 'same_chain_city_state' WHEN i.in_id % 3 <> 0 THEN 'no_chain' ELSE 'no_match' END AS reason
FROM i LEFT JOIN n USING (in_id) LEFT JOIN c ON i.in_id % 3 = 0 AND lower(i.city) = c.city AND i.state = c.state""")
def join5_entity_match(spark, d):
    return cleaning.entity_match(_incoming(spark, d), _existing(spark, d))


@query(_INCOMING + " SELECT t AS threshold_mi, count(*) FILTER (dist_mi <= t) AS matches FROM n, (VALUES (0.15), (0.25), (0.40)) v(t) GROUP BY t")
def agg28_match_sensitivity(spark, d):
    n = cleaning.nearest_rooftop(_incoming(spark, d), src.stations(spark, d))
    ladder = F.explode(F.array(*[F.lit(x).cast("decimal(3,2)") for x in ("0.15", "0.25", "0.40")]))
    return n.withColumn("threshold_mi", ladder).groupBy("threshold_mi").agg(F.count_if(F.col("dist_mi") <= F.col("threshold_mi")).alias("matches"))


@query("""SELECT opis_id, 1000000000 + cast('0x' || substr(sha256('gers-' || opis_id), 1, 12) AS BIGINT) % 1000000000 AS minted_id FROM v_station""")
def mat12_minted_ids(spark, d):
    return src.stations(spark, d).select("opis_id", cleaning.minted(F.concat(F.lit("gers-"), F.col("opis_id").cast("string"))).alias("minted_id"))


@query("""SELECT minted % 5000 AS id, count(DISTINCT k) AS keys FROM (SELECT 'gers-' || opis_id AS k, 1000000000 + cast('0x' || substr(sha256('gers-' || opis_id), 1, 12) AS BIGINT) % 1000000000 AS minted FROM v_station) GROUP BY ALL HAVING count(DISTINCT k) > 1""")
def mat13_collisions(spark, d):
    key = F.concat(F.lit("gers-"), F.col("opis_id").cast("string"))
    return src.stations(spark, d).groupBy((cleaning.minted(key) % 5000).alias("id")).agg(F.countDistinct(key).alias("keys")).where("keys > 1")


@query("""f AS (SELECT opis_id, 1 AS file_no, price_milli + CASE WHEN opis_id % 3 = 0 THEN 5 ELSE 0 END AS price_milli FROM v_station WHERE opis_id % 2 = 0 UNION ALL SELECT opis_id + 1000000, 1, price_milli FROM v_station WHERE opis_id % 11 = 0 UNION ALL SELECT opis_id, 2, price_milli FROM v_station WHERE opis_id % 9 = 0),
n AS (SELECT opis_id, arg_max(price_milli, file_no) AS p FROM f GROUP BY opis_id)
SELECT change, count(*) AS n, sum(price_milli)::BIGINT AS total_milli FROM (SELECT CASE WHEN s.opis_id IS NULL THEN 'created' WHEN n.opis_id IS NULL THEN 'untouched' WHEN s.price_milli = n.p THEN 'unchanged' ELSE 'updated' END AS change, coalesce(n.p, s.price_milli) AS price_milli FROM v_station s FULL JOIN n ON s.opis_id = n.opis_id) GROUP BY change""")
def snk4_upsert_plan(spark, d):
    s = src.stations(spark, d).select("opis_id", "price_milli")
    one = s.where("opis_id % 2 = 0").select("opis_id", F.lit(1).alias("file_no"), (F.col("price_milli") + F.when(F.col("opis_id") % 3 == 0, 5).otherwise(0)).alias("price_milli"))
    new = s.where("opis_id % 11 = 0").select((F.col("opis_id") + 1_000_000).alias("opis_id"), F.lit(1).alias("file_no"), "price_milli")
    two = s.where("opis_id % 9 = 0").select("opis_id", F.lit(2).alias("file_no"), "price_milli")
    files = one.union(new).union(two).withColumn("line_no", F.col("opis_id"))
    return cleaning.upsert_plan(s, files, "price_milli").groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.sum("price_milli").alias("total_milli"))


@query("""x AS (SELECT state, CASE WHEN opis_id % 13 = 0 THEN 'out_of_scope' ELSE geocode_status END AS status FROM v_station)
SELECT state, count(*) AS stations, count(*) FILTER (status <> 'out_of_scope') AS in_scope, count(*) FILTER (status = 'ok') AS routable, coalesce(round(count(*) FILTER (status = 'ok') / nullif(count(*) FILTER (status <> 'out_of_scope'), 0)::DOUBLE, 6), 0) AS coverage FROM x GROUP BY state""")
def agg8_coverage(spark, d):
    """Routable stations as a share of those in scope; 0 where none is."""
    status = F.when(F.col("opis_id") % 13 == 0, "out_of_scope").otherwise(F.col("geocode_status"))
    good, scope = F.count_if(F.col("status") == "ok"), F.count_if(F.col("status") != "out_of_scope")
    rows = src.stations(spark, d).withColumn("status", status)
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("stations"), scope.alias("in_scope"), good.alias("routable"), F.coalesce(F.round(good / F.nullif(scope, F.lit(0)), 6), F.lit(0.0)).alias("coverage"))


# --- prices

_FACTORS = """w AS (SELECT *, row_number() OVER (PARTITION BY region_no ORDER BY period DESC) AS r FROM v_weekly),
p AS (SELECT region_no, max(CASE WHEN r = 1 THEN period END) AS period, max(CASE WHEN r = 1 THEN value_milli END) AS cur, max(CASE WHEN r = 2 THEN value_milli END) AS prior FROM w WHERE r <= 2 GROUP BY region_no),
f AS (SELECT region, cur AS current_milli, prior AS prior_milli, CASE WHEN round(cur / baseline_milli::DOUBLE, 6) BETWEEN 0.5 AND 2 THEN round(cur / baseline_milli::DOUBLE, 6) END AS factor, round_even((cur - prior) / 10.0::DOUBLE, 0)::BIGINT AS delta_cents, (max(period) OVER ())::VARCHAR AS week FROM p JOIN v_region USING (region_no))"""


def _factors(spark, d):
    return pricing.latest_factors(src.weekly_prices(spark, d), src.regions(spark))


def _indexed(spark, d):
    return pricing.indexed(src.stations(spark, d), src.state_regions(spark), _factors(spark, d))


@query(_FACTORS + " SELECT * FROM f")
def agg4_latest_factors(spark, d):
    return _factors(spark, d)


@query(_FACTORS + " SELECT opis_id, region, round(price_milli * coalesce(factor, 1), 3) AS indexed_milli FROM v_station LEFT JOIN v_state USING (state) LEFT JOIN f USING (region)")
def join8_indexed_prices(spark, d):
    return _indexed(spark, d).select("opis_id", "region", "indexed_milli")


@query("SELECT coalesce(region, 'unmapped') AS region, count(*) AS stations, round(avg(price_milli), 4) AS mean_milli FROM v_station LEFT JOIN v_state USING (state) GROUP BY ALL")
def agg3_region_means(spark, d):
    return pricing.region_means(src.stations(spark, d).join(F.broadcast(src.state_regions(spark)), "state", "left"))


@query("""m AS (SELECT round(median(abs(price_milli - a)), 4) AS mad_milli FROM (SELECT price_milli, avg(price_milli) OVER (PARTITION BY region) AS a FROM v_station JOIN v_state USING (state)))
SELECT mad_milli, round(mad_milli / 1000 * 56.63 * 0.5, 2) AS rung_half, round(mad_milli / 1000 * 56.63, 2) AS rung_one, round(mad_milli / 1000 * 56.63 * 2, 2) AS rung_two FROM m""")
def agg5_pooled_deviation(spark, d):
    return pricing.pooled_deviation(src.stations(spark, d).join(F.broadcast(src.state_regions(spark)), "state", "left"))


# --- corridors


_CORRIDOR_AT = """q AS (SELECT *, cos(radians(sum(lat_u) OVER (PARTITION BY route_id) / 65.0::DOUBLE / 1e6)) AS k FROM v_point),
g AS (SELECT route_id, total_milli_mi, seq, k, lng_u / 1e6 * 69.172 * k AS a_x, lat_u / 1e6 * 69.172 AS a_y, lead(lng_u) OVER l / 1e6 * 69.172 * k AS b_x, lead(lat_u) OVER l / 1e6 * 69.172 AS b_y FROM q WINDOW l AS (PARTITION BY route_id ORDER BY seq)),
h AS (SELECT *, sqrt(power(b_x - a_x, 2) + power(b_y - a_y, 2)) AS len FROM g WHERE b_x IS NOT NULL),
u AS (SELECT *, sum(len) OVER (PARTITION BY route_id ORDER BY seq) - len AS start, sum(len) OVER (PARTITION BY route_id) AS planar FROM h),
st AS (SELECT opis_id, lat_u, lng_u, CASE WHEN geocode_precision = 'rooftop' THEN 5 ELSE 20 END AS tier FROM v_station WHERE geocode_status = 'ok'),
bb AS (SELECT route_id, min(lat_u) - 600000 AS y0, max(lat_u) + 600000 AS y1, min(lng_u) - 600000 AS x0, max(lng_u) + 600000 AS x1 FROM v_point GROUP BY route_id),
z AS (SELECT u.*, opis_id, tier, lng_u / 1e6 * 69.172 * k AS px, lat_u / 1e6 * 69.172 AS py FROM bb JOIN st ON lat_u BETWEEN y0 AND y1 AND lng_u BETWEEN x0 AND x1 JOIN u USING (route_id)),
tt AS (SELECT *, greatest(0, least(1, ((px - a_x) * (b_x - a_x) + (py - a_y) * (b_y - a_y)) / (len * len))) AS t FROM z),
o AS (SELECT *, sqrt(power(px - (a_x + t * (b_x - a_x)), 2) + power(py - (a_y + t * (b_y - a_y)), 2)) AS off FROM tt),
wn AS (SELECT *, row_number() OVER (PARTITION BY route_id, opis_id ORDER BY off, seq) AS r FROM o WHERE off <= tier),
near AS MATERIALIZED (SELECT route_id, opis_id, off, (start + t * len) / planar * total_milli_mi / 1000 AS at_mi FROM wn WHERE r = 1)"""
_CORRIDOR = _CORRIDOR_AT + " SELECT route_id, opis_id, floor(off * 1000 + 0.5000001::DOUBLE) / 1000 AS off_mi, floor(at_mi * 100 + 0.5000001::DOUBLE) / 100 AS at_mi FROM near"


@query(_CORRIDOR)
def join1_corridor(spark, d):
    return corridor.corridor_join(src.route_lines(spark, d), src.stations(spark, d))


@query(f"SELECT count(*) AS pairs, 0::BIGINT AS differing FROM ({_CORRIDOR.replace('q AS', 'WITH q AS', 1)}) WHERE route_id % 50 = 0")
def set7_corridor_referee(spark, d):
    """The banded join against plain ranges of all segments, for the stated query set of routes whose id is divisible by 50, with all stations."""
    told = corridor.corridor_differences(src.route_lines(spark, d).where("route_id % 50 = 0"), src.stations(spark, d))
    return told.agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("pairs"), F.coalesce(F.sum("differing"), F.lit(0)).cast("long").alias("differing"))


# --- windows over candidates and legs


@query("SELECT l_orderkey AS route_id, l_linenumber AS seg, sum(l_quantity) OVER w AS miles, round(sum(l_extendedprice) OVER w, 2) AS seconds FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING)")
def win1_cumulative_axes(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return src.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("route_id"), F.col("l_linenumber").alias("seg"), F.sum("l_quantity").over(w).alias("miles"), F.round(F.sum("l_extendedprice").over(w), 2).alias("seconds"))


@query("""a AS (SELECT route_id, total_milli_mi, i AS k, i * total_milli_mi // 8 AS d0, (i + 1) * total_milli_mi // 8 AS d1, i * i * 1000 AS s0, (i + 1) * (i + 1) * 1000 AS s1 FROM v_route, range(8) t(i))
SELECT c.route_id, opis_id, round(s0 + (s1 - s0) * (pos_milli_mi - d0)::DOUBLE / (d1 - d0), 3) AS seconds FROM v_candidate c JOIN a ON c.route_id = a.route_id AND (pos_milli_mi >= d0 AND (pos_milli_mi < d1 OR (k = 7 AND pos_milli_mi <= c.total_milli_mi)))""")
def win3_interpolated_time(spark, d):
    i = F.col("i").cast("long")
    axis = src.routes(spark, d).select("route_id", "total_milli_mi", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    axis = axis.select("route_id", "i", F.floor(i * F.col("total_milli_mi") / 8).alias("at"), (i * i * 1000).alias("s0"), F.floor((i + 1) * F.col("total_milli_mi") / 8).alias("d1"), ((i + 1) * (i + 1) * 1000).alias("s1"))
    marks = axis.select("route_id", "at", F.lit(0).alias("kind"), F.struct("at", "d1", "s0", "s1").alias("seg"), F.lit(None).cast("int").alias("opis_id"))
    seg = F.last("seg", ignorenulls=True).over(Window.partitionBy("route_id").orderBy("at", "kind"))
    points = src.candidates(spark, d).select("route_id", F.col("pos_milli_mi").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["seg"].dataType).alias("seg"), "opis_id")
    rows = marks.union(points).withColumn("seg", seg).where("kind = 1")
    value = F.col("seg.s0") + (F.col("seg.s1") - F.col("seg.s0")) * (F.col("at") - F.col("seg.at")) / (F.col("seg.d1") - F.col("seg.at"))
    return rows.select("route_id", "opis_id", F.round(value, 3).alias("seconds"))


_PREFLIGHT, _PRUNED, _EFFORT = plan_sql.preflight(), plan_sql.pruned(), plan_sql.effort()


@query(_PREFLIGHT + " SELECT * FROM pf")
def pln1_preflight(spark, d):
    return search.preflight(src.routes(spark, d), src.candidates(spark, d))


@query(_PRUNED + " SELECT route_id, opis_id, pos_milli_mi, price_milli FROM pr")
def pln2_domination_prune(spark, d):
    return search.pruned(src.dealt_candidates(spark, d)).select("route_id", "opis_id", "pos_milli_mi", "price_milli")


@query(_EFFORT + " SELECT * FROM ef")
def pln3_transition_estimate(spark, d):
    return search.effort(src.routes(spark, d), search.pruned(src.dealt_candidates(spark, d)))


@query(_EFFORT + " SELECT CASE WHEN estimate <= 50000 THEN 'exact' ELSE 'heuristic' END AS method, count(*) AS routes, sum(estimate)::BIGINT AS total FROM ef GROUP BY ALL")
def pln4_dispatch(spark, d):
    e = search.effort(src.routes(spark, d), search.pruned(src.dealt_candidates(spark, d)))
    return e.groupBy(F.when(F.col("estimate") <= search.EXACT_BUDGET, "exact").otherwise("heuristic").alias("method")).agg(F.count(F.lit(1)).alias("routes"), F.sum("estimate").alias("total"))


@query("""a AS (SELECT a.*, a.price_source = 'eia_regional_estimate' AS est, EXISTS (SELECT 1 FROM v_candidate b WHERE b.route_id = a.route_id AND b.pos_milli_mi = a.pos_milli_mi AND (b.price_milli, b.opis_id) < (a.price_milli, a.opis_id) AND (a.price_source = 'eia_regional_estimate' OR b.price_source <> 'eia_regional_estimate')) AS same,
EXISTS (SELECT 1 FROM v_candidate b WHERE b.route_id = a.route_id AND b.pos_milli_mi + b.tank_milli_mi >= b.total_milli_mi AND b.price_milli <= a.price_milli AND (b.pos_milli_mi, b.price_milli, b.opis_id) < (a.pos_milli_mi, a.price_milli, a.opis_id) AND (a.price_source = 'eia_regional_estimate' OR b.price_source <> 'eia_regional_estimate')) AS tail,
EXISTS (SELECT 1 FROM v_candidate b WHERE b.route_id = a.route_id AND b.price_milli <= a.price_milli AND (b.pos_milli_mi, b.price_milli, b.opis_id) < (a.pos_milli_mi, a.price_milli, a.opis_id) AND (b.pos_milli_mi = a.pos_milli_mi OR b.pos_milli_mi + b.tank_milli_mi >= b.total_milli_mi)) AS price_only FROM v_candidate a)
SELECT route_id, count(*) AS before, count(*) FILTER (same) AS co_located, count(*) FILTER (NOT same AND tail) AS tail, count(*) FILTER (NOT same AND NOT tail AND price_only) AS margin_blocked, count(*) FILTER (price_only) AS price_only, true AS closed FROM a GROUP BY route_id""")
def agg27_removal_tallies(spark, d):
    """Removals by their first reason, and stations that stay for their provenance alone; ``closed``: the tallies add up."""
    closed = F.col("blocked") == F.col("price_only") - F.col("co_located") - F.col("tail")
    return arcs.tallies(spark, d).select("route_id", "before", "co_located", "tail", F.col("blocked").alias("margin_blocked"), "price_only", closed.alias("closed"))


@query("SELECT route_id, opis_id, round(avg(price_milli) OVER p, 4) AS mean_milli, round((rank() OVER (PARTITION BY route_id ORDER BY price_milli) - 1) / count(*) OVER p::DOUBLE, 6) AS percentile FROM v_candidate WINDOW p AS (PARTITION BY route_id)")
def agg13_price_percentile(spark, d):
    return arcs.price_percentiles(spark, d)


@query("SELECT route_id, opis_id, coalesce(price_milli <= min(price_milli) OVER (PARTITION BY route_id ORDER BY pos_milli_mi, price_milli, opis_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), true) AS cheapest_ahead FROM v_candidate")
def win13_cheapest_ahead(spark, d):
    w = Window.partitionBy("route_id").orderBy("pos_milli_mi", "price_milli", "opis_id").rowsBetween(1, Window.unboundedFollowing)
    return src.candidates(spark, d).select("route_id", "opis_id", F.coalesce(F.col("price_milli") <= F.min("price_milli").over(w), F.lit(True)).alias("cheapest_ahead"))


@query("""v AS (SELECT route_id, list_sort(list(price_milli)) AS v FROM v_candidate GROUP BY route_id) SELECT route_id, i AS bin, v[len(v) * i // 5 + 1] AS edge_milli FROM v, range(1, 5) t(i)""")
def agg17_quantile_edges(spark, d):
    return arcs.quantile_edges(spark, d, 5)


@query("""e AS (SELECT l_orderkey AS route_id, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS dz, l_quantity FROM lineitem) SELECT route_id, min(l_quantity) AS low, max(l_quantity) AS high, coalesce(sum(dz) FILTER (dz > 0), 0) AS ascent, coalesce(-sum(dz) FILTER (dz < 0), 0) AS descent, coalesce(sum(dz) FILTER (dz > 0), 0) < 50 AS flat FROM e GROUP BY route_id""")
def agg18_elevation(spark, d):
    dz = F.col("l_quantity") - F.lag("l_quantity").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    e = src.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("route_id"), dz.alias("dz"), "l_quantity")
    up, down = F.coalesce(F.sum(F.when(F.col("dz") > 0, F.col("dz"))), F.lit(0.0)), F.coalesce(-F.sum(F.when(F.col("dz") < 0, F.col("dz"))), F.lit(0.0))
    return e.groupBy("route_id").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), up.alias("ascent"), down.alias("descent"), (up < 50).alias("flat"))


@query("""a AS (SELECT route_id, tank_milli_mi, total_milli_mi AS cost, route_id % 13 = 0 AS cens FROM v_route WHERE route_id % 3 <> 0), b AS (SELECT route_id, tank_milli_mi, total_milli_mi + CASE WHEN route_id % 4 = 0 THEN 1 ELSE 0 END AS cost, route_id % 26 = 0 AS cens FROM v_route WHERE route_id % 7 <> 0)
SELECT route_id, kind, CASE WHEN kind = 'changed' THEN 'cost' END AS fields FROM (SELECT coalesce(a.route_id, b.route_id) AS route_id, CASE WHEN a.route_id IS NULL THEN 'appeared' WHEN b.route_id IS NULL THEN 'vanished' WHEN a.cens AND b.cens THEN NULL WHEN a.cens <> b.cens THEN 'censor_flip' WHEN a.cost <> b.cost THEN 'changed' END AS kind FROM a FULL JOIN b ON a.route_id = b.route_id) WHERE kind IS NOT NULL""")
def join9_world_diff(spark, d):
    r = src.routes(spark, d).withColumn("cost", F.col("total_milli_mi"))
    a = r.where("route_id % 3 <> 0").withColumn("cens", F.col("route_id") % 13 == 0)
    b = r.where("route_id % 7 <> 0").withColumn("cost", F.col("cost") + F.when(F.col("route_id") % 4 == 0, 1).otherwise(0)).withColumn("cens", F.col("route_id") % 26 == 0)
    return measure.world_diff(a, b, ["route_id"], ["cost", "tank_milli_mi"], "cens")


@query("""SELECT m AS multiplier, count(*) AS candidates, sum((price_milli * m)::BIGINT)::BIGINT AS total_milli FROM v_candidate, (VALUES (1), (2), (3)) t(m) GROUP BY m""")
def join13_price_sweep(spark, d):
    per = src.candidate_sums(spark, d, F.col("total_milli_mi"), n=F.lit(1), price=F.col("price_milli"))
    swept = per.agg(F.sum("n").alias("n"), F.sum("price").alias("price")).where("n > 0").withColumn("multiplier", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return swept.select("multiplier", F.col("n").alias("candidates"), (F.col("price") * F.col("multiplier")).alias("total_milli"))


@query(_PREFLIGHT + """ SELECT route_id % 10 AS batch, arg_min(route_id, {'g': gap_milli, 'r': route_id}) AS route_id, min(gap_milli) AS gap_milli FROM pf WHERE NOT feasible GROUP BY ALL""")
def top2_smallest_gap(spark, d):
    bad = search.preflight(src.routes(spark, d), src.candidates(spark, d)).where("NOT feasible")
    least = F.min(F.struct("gap_milli", "route_id")).alias("b")
    return bad.groupBy((F.col("route_id") % 10).alias("batch")).agg(least).select("batch", "b.route_id", "b.gap_milli")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM (SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events GROUP BY ALL)) WHERE r <= 5")
def top7_recent_distinct(spark, d):
    per = src.read(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "m.ts", "m.event_id")
    order = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return per.withColumn("r", F.row_number().over(order)).where("r <= 5").select("user_id", "event_id")


@query("""SELECT route_id, '[' || string_agg('{"opis_id":' || opis_id || ',"price":' || price_milli || '}', ',' ORDER BY pos_milli_mi, price_milli, opis_id) || ']' AS payload FROM v_candidate GROUP BY route_id""")
def jsn3_candidate_payload(spark, d):
    sortable = F.struct("pos_milli_mi", "price_milli", "opis_id", F.struct("opis_id", F.col("price_milli").alias("price")).alias("j"))
    listed = src.candidates(spark, d).groupBy("route_id").agg(F.sort_array(F.collect_list(sortable)).alias("v"))
    return listed.select("route_id", F.to_json(F.transform("v", lambda x: x["j"])).alias("payload"))


# --- plans


# --- time-keyed counters


@query("""SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NULL OR epoch_us(nx) - epoch_us(ts) > 3600000000""")
def stm6_debounced(spark, d):
    return counters.debounced(src.read(spark, d, "events"), 3600).select("event_id", "user_id")


# --- legs of a trip


_LEGS = """lp AS (SELECT route_id, 0 AS leg, 0::BIGINT AS offset_milli_mi, total_milli_mi * 2 // 5 AS total_milli_mi, seq, lat_u, lng_u FROM v_point WHERE seq <= 24
  UNION ALL SELECT route_id, 1, total_milli_mi * 2 // 5, total_milli_mi - total_milli_mi * 2 // 5, seq, lat_u, lng_u FROM v_point WHERE seq >= 24)"""


def _legs(spark, d):
    """The two legs of each route in its row; the boundary point belongs to both."""
    whole, cut = F.col("total_milli_mi"), F.floor(F.col("total_milli_mi") * 2 / 5).cast("long")
    leg = lambda no, n, offset, total: F.struct(F.lit(no).alias("leg"), F.lit(n).alias("points"), offset.cast("long").alias("offset_milli_mi"), total.alias("total_milli_mi"))
    line = F.concat(F.slice("line", 1, 25), F.slice("line", 25, 41))
    return src.route_lines(spark, d).select("route_id", "total_milli_mi", line.alias("line"), F.array(leg(0, 25, F.lit(0), cut), leg(1, 41, cut, whole - cut)).alias("legs"))


@query(_LEGS + """, q AS (SELECT *, cos(radians(avg(lat_u) OVER (PARTITION BY route_id, leg) / 1e6)) AS k FROM lp),
g AS (SELECT route_id, leg, offset_milli_mi, total_milli_mi, seq, k, lng_u / 1e6 * 69.172 * k AS a_x, lat_u / 1e6 * 69.172 AS a_y, lead(lng_u) OVER l / 1e6 * 69.172 * k AS b_x, lead(lat_u) OVER l / 1e6 * 69.172 AS b_y FROM q WINDOW l AS (PARTITION BY route_id, leg ORDER BY seq)),
h AS (SELECT *, sqrt(power(b_x - a_x, 2) + power(b_y - a_y, 2)) AS len FROM g WHERE b_x IS NOT NULL),
u AS (SELECT *, sum(len) OVER (PARTITION BY route_id, leg ORDER BY seq) - len AS start, sum(len) OVER (PARTITION BY route_id, leg) AS planar FROM h),
st AS (SELECT opis_id, lat_u, lng_u, CASE WHEN geocode_precision = 'rooftop' THEN 5 ELSE 20 END AS tier FROM v_station WHERE geocode_status = 'ok'),
bb AS (SELECT route_id, leg, min(lat_u) - 600000 AS y0, max(lat_u) + 600000 AS y1, min(lng_u) - 600000 AS x0, max(lng_u) + 600000 AS x1 FROM lp GROUP BY ALL),
z AS (SELECT u.*, opis_id, tier, lng_u / 1e6 * 69.172 * k AS px, lat_u / 1e6 * 69.172 AS py FROM bb JOIN st ON lat_u BETWEEN y0 AND y1 AND lng_u BETWEEN x0 AND x1 JOIN u USING (route_id, leg)),
tt AS (SELECT *, greatest(0, least(1, ((px - a_x) * (b_x - a_x) + (py - a_y) * (b_y - a_y)) / (len * len))) AS t FROM z),
o AS (SELECT *, sqrt(power(px - (a_x + t * (b_x - a_x)), 2) + power(py - (a_y + t * (b_y - a_y)), 2)) AS off FROM tt),
w AS (SELECT *, row_number() OVER (PARTITION BY route_id, opis_id ORDER BY off, leg, seq) AS r FROM o WHERE off <= tier)
SELECT route_id, opis_id, leg, floor(off * 1000 + 0.5000001::DOUBLE) / 1000 AS off_mi, floor((offset_milli_mi / 1000 + (start + t * len) / planar * total_milli_mi / 1000) * 100 + 0.5000001::DOUBLE) / 100 AS at_mi FROM w WHERE r = 1""")
def join2_multi_leg_corridor(spark, d):
    return corridor.multi_leg_join(_legs(spark, d), src.stations(spark, d))


@query("""q AS (SELECT *, cos(radians(sum(lat_u) OVER (PARTITION BY route_id) / 65.0::DOUBLE / 1e6)) AS k, lead(lat_u) OVER l AS lat2, lead(lng_u) OVER l AS lng2 FROM v_point WINDOW l AS (PARTITION BY route_id ORDER BY seq)),
h AS (SELECT *, sqrt(power((lng2 - lng_u) / 1e6 * 69.172 * k, 2) + power((lat2 - lat_u) / 1e6 * 69.172, 2)) AS len FROM q WHERE lat2 IS NOT NULL),
u AS (SELECT *, sum(len) OVER (PARTITION BY route_id ORDER BY seq) - len AS start FROM h),
n AS (SELECT route_id, i, planar * i / 200 AS want FROM (SELECT route_id, sum(len) AS planar FROM u GROUP BY route_id), range(201) t(i))
SELECT n.route_id, i, floor((lat_u + least(1, (want - start) / len) * (lat2 - lat_u)) / 1e6 * 10000 + 0.5000001::DOUBLE) / 10000 AS lat, floor((lng_u + least(1, (want - start) / len) * (lng2 - lng_u)) / 1e6 * 10000 + 0.5000001::DOUBLE) / 10000 AS lng FROM n ASOF JOIN u ON n.route_id = u.route_id AND n.want >= u.start""")
def mat16_even_samples(spark, d):
    return corridor.even_samples(src.route_lines(spark, d), 200)


@query(_PREFLIGHT + """ SELECT route_id, from_milli, to_milli, CASE WHEN from_milli >= total_milli_mi * 2 // 5 THEN 1 ELSE 0 END AS leg FROM pf JOIN v_route USING (route_id) WHERE NOT feasible""")
def pln16_infeasible_leg(spark, d):
    bad = search.preflight(src.routes(spark, d), src.candidates(spark, d)).where("NOT feasible")
    starts = src.routes(spark, d).select("route_id", F.array(F.lit(0).cast("long"), F.floor(F.col("total_milli_mi") * 2 / 5)).alias("starts"))
    reached = F.size(F.filter("starts", lambda s: s <= F.col("from_milli"))) - 1
    return bad.join(starts, "route_id").select("route_id", "from_milli", "to_milli", reached.alias("leg"))


@query("SELECT l_orderkey AS route_id, l_linenumber AS seg, sum(l_quantity) OVER w - l_quantity AS starts FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING)")
def win2_leg_starts(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return src.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("route_id"), F.col("l_linenumber").alias("seg"), (F.sum("l_quantity").over(w) - F.col("l_quantity")).alias("starts"))


@query("""x AS (SELECT l_orderkey AS route_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS i, CASE WHEN l_partkey % 3 <> 0 THEN l_quantity END AS v FROM lineitem),
y AS (SELECT *, (SELECT max(i) FROM x a WHERE a.route_id = x.route_id AND a.i <= x.i AND a.v IS NOT NULL) AS p, (SELECT min(i) FROM x a WHERE a.route_id = x.route_id AND a.i >= x.i AND a.v IS NOT NULL) AS q FROM x)
SELECT y.route_id, y.i, round(coalesce(a.v + (y.i - p) * (b.v - a.v)::DOUBLE / nullif(q - p, 0), a.v, b.v), 6) AS filled FROM y LEFT JOIN x a ON a.route_id = y.route_id AND a.i = p LEFT JOIN x b ON b.route_id = y.route_id AND b.i = q""")
def win10_filled_profile(spark, d):
    rows = src.read(spark, d, "lineitem").withColumn("v", F.when(F.col("l_partkey") % 3 != 0, F.col("l_quantity")))
    filled = measure.filled_linear(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"], "v")
    return filled.select(F.col("l_orderkey").alias("route_id"), F.col("i").cast("long").alias("i"), F.round("filled", 6).alias("filled"))


# --- measurement ladders

LADDER = (100, 300, 500, 1000, 2000, 4000)
_RUNGS = "ld(rung) AS (VALUES " + ", ".join(f"({r}::BIGINT)" for r in LADDER) + ")"


def _effort(spark, d):
    return arcs.efforts(spark, d)


@query(_EFFORT + " SELECT alternative_index, count(*) AS cells, count(*) FILTER (estimate > 1000) AS demoted, round(100.0::DOUBLE * count(*) FILTER (estimate > 1000) / count(*), 1) AS percent, count(DISTINCT CASE WHEN estimate > 1000 THEN tank_milli_mi END) AS tanks FROM ef JOIN v_route USING (route_id) GROUP BY ALL")
def agg19_demoted_summary(spark, d):
    over = F.col("estimate") > 1000
    cells = _effort(spark, d).join(src.routes(spark, d), "route_id")
    return cells.groupBy("alternative_index").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(over).alias("demoted"), F.round(F.lit(100.0) * F.count_if(over) / F.count(F.lit(1)), 1).alias("percent"), F.count_distinct(F.when(over, F.col("tank_milli_mi"))).alias("tanks")
    )


@query(_EFFORT + f", {_RUNGS} SELECT (SELECT min(rung) FROM ld WHERE estimate <= rung) AS rung, count(*) AS newly_admitted FROM ef GROUP BY ALL")
def agg20_newly_admitted(spark, d):
    return measure.by_rung(_effort(spark, d), LADDER)


@query(_EFFORT + ", c AS (SELECT tank_milli_mi, nodes, estimate > 1000 AS cens FROM ef JOIN v_route USING (route_id)), l AS (SELECT *, min(CASE WHEN cens THEN nodes END) OVER (PARTITION BY tank_milli_mi) AS m FROM c) SELECT tank_milli_mi, max(CASE WHEN NOT cens AND (m IS NULL OR nodes < m) THEN nodes END) AS threshold, count(*) FILTER (NOT cens AND (m IS NULL OR nodes < m)) AS retained, count(*) AS cells FROM l GROUP BY ALL")
def agg23_induced_threshold(spark, d):
    cells = _effort(spark, d).withColumn("cens", F.col("estimate") > 1000).join(src.routes(spark, d), "route_id")
    return measure.induced_threshold(cells, "tank_milli_mi", "nodes", "cens")


@query(_EFFORT + """, rp AS (SELECT route_id, sum(reach + 1) AS levels FROM rc GROUP BY route_id) SELECT route_id, nodes, total_milli_mi * 1000000 // tank_milli_mi AS tanks_micro, estimate * total_milli_mi // tank_milli_mi AS scaled, (coalesce(from_start, 0) + (total_milli_mi <= on_board_milli_mi)::INT + coalesce(levels, 0))::BIGINT AS fill_levels, nodes * estimate AS nodes_x_estimate,
  (coalesce(from_start, 0) + (total_milli_mi <= on_board_milli_mi)::INT + coalesce(levels, 0))::BIGINT * estimate AS levels_x_estimate FROM ef JOIN v_route USING (route_id) LEFT JOIN rp USING (route_id) LEFT JOIN fs USING (route_id)""")
def pln18_effort_predictors(spark, d):
    """Predictors of a search's effort: nodes, tanks a route, the useful fill levels (reach + 1 of each node), and their products with the estimate."""
    cells = search.effort(src.routes(spark, d), search.pruned(src.dealt_candidates(spark, d)), levels=True).join(src.routes(spark, d), "route_id")
    return cells.selectExpr(
        "route_id", "nodes", "total_milli_mi * 1000000 div tank_milli_mi AS tanks_micro", "estimate * total_milli_mi div tank_milli_mi AS scaled", "fill_levels", "nodes * estimate AS nodes_x_estimate", "fill_levels * estimate AS levels_x_estimate",
    )


@query("""g AS (SELECT region, round(avg(price_milli), 0)::BIGINT AS mean FROM v_station JOIN v_state USING (state) GROUP BY region) SELECT route_id, sum(CASE WHEN (opis_id + route_id) % 4 = 0 THEN coalesce(mean, price_milli) ELSE price_milli END)::BIGINT AS total_milli, count(*) FILTER ((opis_id + route_id) % 4 = 0) AS tagged FROM v_candidate LEFT JOIN v_state USING (state) LEFT JOIN g USING (region) GROUP BY route_id""")
def pln19_average_price_substitution(spark, d):
    regions = src.state_regions(spark)
    means = src.stations(spark, d).join(F.broadcast(regions), "state").groupBy("region").agg(F.round(F.avg("price_milli"), 0).cast("long").alias("mean"))  # eight rows
    c = src.candidates(spark, d).join(F.broadcast(regions), "state", "left").join(F.broadcast(means), "region", "left")
    tagged = (F.col("opis_id") + F.col("route_id")) % 4 == 0
    return c.groupBy("route_id").agg(F.sum(F.when(tagged, F.coalesce("mean", "price_milli")).otherwise(F.col("price_milli"))).alias("total_milli"), F.count_if(tagged).alias("tagged"))


# --- requests and exports


@query("SELECT state, count(*) AS failed FROM v_station WHERE geocode_status = 'failed' GROUP BY state")
def agg9_failed_by_state(spark, d):
    return src.stations(spark, d).where("geocode_status = 'failed'").groupBy("state").agg(F.count(F.lit(1)).alias("failed"))


@query("SELECT city, state, min(opis_id) AS first_id FROM v_station WHERE geocode_status = 'failed' GROUP BY ALL ORDER BY first_id LIMIT 20")
def top5_unmatched_sample(spark, d):
    return src.stations(spark, d).where("geocode_status = 'failed'").groupBy("city", "state").agg(F.min("opis_id").alias("first_id")).orderBy("first_id").limit(20)


@query("SELECT opis_id FROM v_station WHERE (lat_u + 2000 >= 32000000 AND lat_u - 2000 <= 36000000 AND lng_u + 2000 >= -110000000 AND lng_u - 2000 <= -100000000) OR (lat_u + 2000 >= 40000000 AND lat_u - 2000 <= 43000000 AND lng_u + 2000 >= -90000000 AND lng_u - 2000 <= -80000000)")
def fil5_box_overlap(spark, d):
    box = F.struct((F.col("lng_u") - 2000).alias("xmin"), (F.col("lng_u") + 2000).alias("xmax"), (F.col("lat_u") - 2000).alias("ymin"), (F.col("lat_u") + 2000).alias("ymax"))
    return cleaning.overlapping(src.stations(spark, d).withColumn("bbox", box), ((32_000_000, 36_000_000, -110_000_000, -100_000_000), (40_000_000, 43_000_000, -90_000_000, -80_000_000))).select("opis_id")


@query("SELECT opis_id FROM v_station WHERE ('0x' || substr(sha256('s1:' || opis_id), 1, 12))::BIGINT % 10000 < 2500")
def fil14_hash_sample(spark, d):
    return cleaning.hash_sample(src.stations(spark, d), "opis_id", "s1", 0.25).select("opis_id")


@query("""x AS (SELECT opis_id, CASE opis_id % 5 WHEN 0 THEN (lat_u / 1000) || ',' || opis_id WHEN 1 THEN (30 + opis_id % 9) || '.5, -' || (80 + opis_id % 40) WHEN 2 THEN ' ' || city || ', ' || state || ' ' WHEN 3 THEN '' ELSE '45,-' || (opis_id % 90) END AS s FROM v_station),
y AS (SELECT *, CASE WHEN regexp_full_match(trim(s), '-?[0-9.]+ *, *-?[0-9.]+') THEN try_cast(trim(split_part(trim(s), ',', 1)) AS DOUBLE) END AS a, CASE WHEN regexp_full_match(trim(s), '-?[0-9.]+ *, *-?[0-9.]+') THEN try_cast(trim(split_part(trim(s), ',', 2)) AS DOUBLE) END AS b FROM x)
SELECT opis_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a BETWEEN 24.4 AND 49.4 AND b BETWEEN -125 AND -66.9 THEN 'point' ELSE 'out_of_bounds' END WHEN length(trim(s)) BETWEEN 1 AND 256 THEN 'address' ELSE 'invalid' END AS kind FROM y""")
def fil17_location_kind(spark, d):
    k = F.col("opis_id")
    s = (
        F.when(k % 5 == 0, F.concat_ws(",", F.col("lat_u") / 1000, k)).when(k % 5 == 1, F.format_string("%d.5, -%d", 30 + k % 9, 80 + k % 40))
        .when(k % 5 == 2, F.concat(F.lit(" "), "city", F.lit(", "), "state", F.lit(" "))).when(k % 5 == 3, "").otherwise(F.concat(F.lit("45,-"), k % 90))
    )
    return src.stations(spark, d).select("opis_id", cleaning.location_kind(s).alias("kind"))


@query("""SELECT route_id, 'start=' || route_id % 90 || '&finish=' || total_milli_mi % 90 || '&mpg=' || tank_milli_mi // 50000 AS state_text, route_id % 90 AS start, total_milli_mi % 90 AS finish, (tank_milli_mi // 50000)::BIGINT AS mpg FROM v_route""")
def str13_trip_state(spark, d):
    """Trip state to a query string and back."""
    pairs = [F.concat(F.lit(f"{n}="), F.url_encode(v.cast("string"))) for n, v in (("start", F.col("route_id") % 90), ("finish", F.col("total_milli_mi") % 90), ("mpg", F.floor(F.col("tank_milli_mi") / 50_000)))]
    coded = src.routes(spark, d).select("route_id", F.concat_ws("&", *pairs).alias("state_text"))
    back = lambda n: F.url_decode(F.parse_url(F.concat(F.lit("http://x/?"), "state_text"), F.lit("QUERY"), F.lit(n))).cast("long").alias(n)
    return coded.select("route_id", "state_text", back("start"), back("finish"), back("mpg"))


@query("""SELECT stage, count(*) AS n, sum(ms)::BIGINT AS total_ms, max(ms) AS worst_ms FROM (SELECT 'corridor' AS stage, event_id % 97 AS ms FROM events UNION ALL SELECT 'solve', event_id * 7 % 313 FROM events WHERE event_id % 3 <> 0) GROUP BY stage""")
def str12_stage_timings(spark, d):
    e = F.col("event_id")
    header = F.concat(F.lit("corridor;dur="), e % 97, F.when(e % 3 != 0, F.concat(F.lit(", solve;dur="), e * 7 % 313)).otherwise(""))
    part = src.read(spark, d, "events").select(F.explode(F.split(header, ", *")).alias("p"))
    ms = F.regexp_extract("p", "dur=([0-9.]+)", 1).try_cast("double").cast("long")
    return part.groupBy(F.substring_index("p", ";", 1).alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.sum(ms).alias("total_ms"), F.max(ms).alias("worst_ms"))


@query("""SELECT route_id, opis_id, CASE WHEN regexp_matches(n, '[",]') THEN '"' || replace(n, '"', '""') || '"' ELSE n END || ',' || pos_milli_mi || ',' || price_milli AS line FROM (SELECT *, CASE opis_id % 3 WHEN 0 THEN name || ', "' || state || '"' WHEN 1 THEN name || ', ' || state ELSE name END AS n FROM v_candidate)""")
def snk7_stop_lines(spark, d):
    k = F.col("opis_id")
    n = F.when(k % 3 == 0, F.concat("name", F.lit(', "'), "state", F.lit('"'))).when(k % 3 == 1, F.concat("name", F.lit(", "), "state")).otherwise(F.col("name"))
    return src.candidates(spark, d).select("route_id", "opis_id", F.concat_ws(",", text.csv_field(n), "pos_milli_mi", "price_milli").alias("line"))


from . import registry_answers, registry_geometry, registry_more, registry_plans, registry_reports, registry_streams  # noqa: E402, F401  they register their queries, which use the tables above
