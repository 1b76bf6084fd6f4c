"""The adapter tables as DuckDB common table expressions, for the SQL twins of the queries."""

from .sources.adapters import REGIONS, STATES, STEPS

ADAPTERS = f"""
v_station AS (
  SELECT p_partkey::INT AS opis_id, p_name AS name, 'City' || (p_partkey % 97) AS city,
         substring('{STATES}', (2 * (p_partkey % 48) + 1)::INT, 2) AS state,
         30000000 + (p_partkey * 7919 % 15000) * 1000 AS lat_u, -120000000 + (p_partkey * 104729 % 45000) * 1000 AS lng_u,
         2687 + (p_partkey * 613) % 3713 AS price_milli,
         CASE WHEN p_partkey % 12 = 0 THEN 'rooftop' WHEN p_partkey % 19 = 0 THEN NULL ELSE 'city' END AS geocode_precision,
         CASE WHEN p_partkey % 12 <> 0 AND p_partkey % 19 = 0 THEN 'failed' ELSE 'ok' END AS geocode_status,
         CASE WHEN p_partkey % 4 = 1 THEN 'eia_regional_estimate' ELSE 'opis_indexed' END AS price_source
  FROM part
), v_price_obs AS (
  SELECT l_partkey::INT AS opis_id, l_orderkey * 10 + l_linenumber AS obs_ord,
         'STOP ' || repeat('X', ((l_orderkey + l_linenumber) % 4)::INT) || l_partkey AS name,
         2687 + (l_orderkey * 31 + l_linenumber::BIGINT * 977 + l_partkey * 613) % 3713 AS price_milli, 'R' || (l_orderkey + l_partkey) % 41 AS rack_id
  FROM lineitem
), v_route AS (
  SELECT o_orderkey AS route_id, (o_orderkey % 3)::INT AS alternative_index, 900000 + o_orderkey * 37717 % 1900000 AS total_milli_mi,
         400000 + (o_orderkey % 7) * 100000 AS tank_milli_mi,
         (400000 + (o_orderkey % 7) * 100000) // CASE WHEN o_orderkey % 4 = 1 THEN 2 ELSE 1 END AS on_board_milli_mi
  FROM orders
), v_candidate AS MATERIALIZED (
  SELECT route_id, alternative_index, total_milli_mi, tank_milli_mi, on_board_milli_mi, opis_id, name, state, price_milli, price_source,
         (opis_id::BIGINT * 15485863 + route_id * 32452843) % 2800000 AS pos_milli_mi
  FROM (SELECT *, [{", ".join(map(str, STEPS))}][(route_id % {len(STEPS)})::INT + 1] AS step FROM v_route) r
  JOIN (SELECT *, unnest([{", ".join(map(str, sorted(set(STEPS))))}]) AS s_step FROM v_station) s ON r.step = s.s_step AND (r.step - route_id % r.step) % r.step = opis_id % s.s_step
  WHERE (opis_id::BIGINT * 15485863 + route_id * 32452843) % 2800000 <= total_milli_mi
), v_weekly AS (
  SELECT date_trunc('week', o_orderdate)::DATE AS period, c_nationkey % 8 AS region_no, (3000 + sum(o_orderkey % 1000) % 1500)::BIGINT AS value_milli
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
), v_region(region_no, region, baseline_milli) AS (VALUES {", ".join(f"({i}, '{r[0]}', {r[5]})" for i, r in enumerate(REGIONS))}),
v_state(state, region, baseline_milli) AS (VALUES {", ".join(f"('{s}', '{r[0]}', {r[5]})" for r in REGIONS for s in r[1].split())}),
v_point AS (
  SELECT route_id, total_milli_mi, i AS seq,
         31000000 + k1 * 1000 + floor((k2 - k1) * 1000 * i / 64)::BIGINT + CASE i % 4 WHEN 1 THEN 150000 WHEN 3 THEN -150000 ELSE 0 END AS lat_u,
         -119000000 + k3 * 1000 + floor((22000000 + (k4 - k3) * 1000) * i / 64)::BIGINT AS lng_u
  FROM (SELECT *, route_id * 7919 % 13000 AS k1, route_id * 6101 % 13000 AS k2, route_id * 104729 % 20000 AS k3, route_id * 15013 % 20000 AS k4 FROM v_route), range(65) t(i)
)
"""


def sql(body: str, recursive: bool = False) -> str:
    """``body`` after the adapter tables; it may open with further tables of its own (``name AS (...), ... SELECT``)."""
    comma = "" if body.lstrip().upper().startswith("SELECT") else ","
    return f"WITH {'RECURSIVE ' * recursive}{ADAPTERS.strip()}{comma} {body}"
