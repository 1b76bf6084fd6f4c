"""Plan search as recursive DuckDB tables: twins of the walks and of the exact search."""

STOP, MARGIN = 350_000_000, 54_700_000

PREFLIGHT = """nd AS (SELECT route_id, tank_milli_mi, on_board_milli_mi, pos_milli_mi AS pos, opis_id::BIGINT AS id FROM {c} UNION ALL SELECT route_id, tank_milli_mi, on_board_milli_mi, total_milli_mi, 1099511627776 FROM v_route),
ng AS (SELECT *, coalesce(lag(pos) OVER w, 0) AS before, CASE WHEN lag(pos) OVER w IS NULL THEN on_board_milli_mi ELSE tank_milli_mi END AS within FROM nd WINDOW w AS (PARTITION BY route_id ORDER BY pos, id)),
pf AS (SELECT route_id, count(*) FILTER (pos - before > within) = 0 AS feasible, arg_min(before, pos) FILTER (pos - before > within) AS from_milli, min(pos) FILTER (pos - before > within) AS to_milli, arg_min(pos - before, pos) FILTER (pos - before > within) AS gap_milli FROM ng GROUP BY route_id)"""

PRUNED = """dd AS (SELECT * FROM {c} c WHERE NOT EXISTS (SELECT 1 FROM {c} b WHERE b.route_id = c.route_id AND b.pos_milli_mi = c.pos_milli_mi AND (b.price_milli < c.price_milli OR (b.price_milli = c.price_milli AND b.opis_id < c.opis_id)) AND (c.price_source = 'eia_regional_estimate' OR b.price_source <> 'eia_regional_estimate'))),
pr AS MATERIALIZED (SELECT * FROM dd c WHERE pos_milli_mi + tank_milli_mi < total_milli_mi OR NOT EXISTS (SELECT 1 FROM dd b WHERE b.route_id = c.route_id AND b.pos_milli_mi + b.tank_milli_mi >= b.total_milli_mi AND b.price_milli <= c.price_milli AND (b.pos_milli_mi, b.price_milli, b.opis_id) < (c.pos_milli_mi, c.price_milli, c.opis_id) AND (c.price_source = 'eia_regional_estimate' OR b.price_source <> 'eia_regional_estimate')))"""

EFFORT = PRUNED + """, rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY pos_milli_mi, price_milli, opis_id) AS k FROM pr),
rc AS (SELECT a.route_id, a.k, count(b.k) + (a.pos_milli_mi + a.tank_milli_mi >= a.total_milli_mi)::INT AS reach FROM rk a LEFT JOIN rk b ON a.route_id = b.route_id AND b.k > a.k AND b.pos_milli_mi <= a.pos_milli_mi + a.tank_milli_mi GROUP BY a.route_id, a.k, a.pos_milli_mi, a.tank_milli_mi, a.total_milli_mi),
rs AS (SELECT route_id, count(*) AS nodes, sum(reach * (reach + 1)) AS work FROM rc GROUP BY route_id), fs AS (SELECT route_id, count(*) AS from_start FROM pr WHERE pos_milli_mi <= on_board_milli_mi GROUP BY route_id),
ef AS MATERIALIZED (SELECT r.route_id, coalesce(nodes, 0) AS nodes, (coalesce(work, 0) + coalesce(from_start, 0) + (total_milli_mi <= on_board_milli_mi)::INT)::BIGINT AS estimate FROM v_route r LEFT JOIN rs USING (route_id) LEFT JOIN fs USING (route_id))"""


def preflight(c: str = "v_candidate") -> str:
    return PREFLIGHT.format(c=c)


def pruned(c: str = "v_candidate") -> str:
    return PRUNED.format(c=c)


def effort(c: str = "v_candidate") -> str:
    return EFFORT.format(c=c)


_PICKS = """count(*) AS n, count(*) FILTER (c.price < w.price) AS n_low, min({'p': c.price, 'pos': c.pos, 'id': c.id, 'est': c.est, 'ahead': c.ahead}) AS cheap,
      min({'pos': c.pos, 'p': c.price, 'id': c.id, 'est': c.est, 'ahead': c.ahead}) FILTER (c.price < w.price) AS near, max(FAR) AS far"""

_MOVE = """m.*, CASE WHEN act = 'far' THEN (far).pos WHEN act = 'near' THEN (near).pos WHEN act IN ('cheap', 'first', 'fill') THEN (cheap).pos END AS to_pos,
    CASE WHEN act = 'far' THEN -(far).np WHEN act = 'near' THEN (near).p ELSE (cheap).p END AS to_price, CASE WHEN act = 'far' THEN -(far).ni WHEN act = 'near' THEN (near).id ELSE (cheap).id END AS to_id,
    CASE WHEN act = 'far' THEN (far).est WHEN act = 'near' THEN (near).est ELSE (cheap).est END AS to_est, CASE WHEN act = 'far' THEN (far).ahead WHEN act = 'near' THEN (near).ahead ELSE (cheap).ahead END AS to_ahead"""


def walk(kind: str, name: str = "hw", c: str = "v_candidate") -> str:
    """Tables ``{name}_s`` (stops of the plans, numbered) and ``{name}_p`` (plans) of the naive, the greedy or the heuristic walk."""
    far = "{'pos': c.pos, 'ni': -c.id, 'np': -c.price, 'est': c.est, 'ahead': c.ahead}" if kind == "naive" else "{'pos': c.pos, 'np': -c.price, 'ni': -c.id, 'est': c.est, 'ahead': c.ahead}"
    fill = "CASE WHEN ahead IS NULL OR price <= ahead THEN 'top_up_at_cheapest' ELSE 'fill_to_continue' END"
    if kind == "naive":
        act, reason, saved = "CASE WHEN done THEN 'finish' WHEN n = 0 THEN 'stuck' ELSE 'far' END", "'price_blind'", ""
    elif kind == "greedy":
        act = "CASE WHEN id IS NULL THEN CASE WHEN done THEN 'finish' WHEN n = 0 THEN 'stuck' ELSE 'first' END WHEN n_low > 0 THEN 'near' WHEN done THEN 'finish' WHEN n = 0 THEN 'stuck' ELSE 'fill' END"
        reason = f"CASE act WHEN 'near' THEN 'reach_cheaper_stop' WHEN 'finish' THEN 'reach_finish' ELSE {fill} END"
        saved = ""
    else:
        skip = f"(passed > 0 AND {STOP} + est::INT * {MARGIN} > saved)"
        act = f"""CASE WHEN id IS NULL THEN CASE WHEN done THEN 'finish' WHEN n = 0 THEN 'stuck' ELSE 'first' END
      WHEN n_low = 0 THEN CASE WHEN done THEN 'finish' WHEN n = 0 THEN 'stuck' ELSE 'far' END
      WHEN NOT done AND -(far).np < price THEN 'far' WHEN {skip} THEN CASE WHEN done THEN 'finish' ELSE 'far' END ELSE 'cheap' END"""
        reason = f"CASE act WHEN 'finish' THEN 'reach_finish' WHEN 'cheap' THEN 'reach_cheaper_stop' ELSE CASE WHEN n_low = 0 THEN {fill} WHEN -(far).np < price THEN 'reach_cheaper_stop' ELSE 'bypass_cheaper_not_worth_stop' END END"
        saved = f""", LATERAL (SELECT count(*) AS passed, coalesce(sum(greatest(0, c.pos - w.pos - w.fuel) * (w.price - c.price)), 0) AS saved FROM {name}_c c
      WHERE c.route_id = w.route_id AND c.pos > w.pos AND c.price < w.price AND c.pos < CASE WHEN w.l - w.pos <= w.t THEN w.l ELSE (a.far).pos END) z"""
    picks = _PICKS.replace("FAR", far)
    return f"""{name}_c AS MATERIALIZED (SELECT route_id, pos_milli_mi AS pos, price_milli AS price, opis_id::BIGINT AS id, price_source = 'eia_regional_estimate' AS est,
  min(price_milli) OVER (PARTITION BY route_id ORDER BY pos_milli_mi RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead FROM {c}),
{name} AS (
  SELECT route_id, total_milli_mi AS l, tank_milli_mi AS t, 0::BIGINT AS pos, on_board_milli_mi AS fuel, 0::BIGINT AS price, NULL::BIGINT AS id, false AS est, NULL::BIGINT AS ahead, 0 AS step,
         0::BIGINT AS b_pos, NULL::BIGINT AS b_id, 0::BIGINT AS b_price, false AS b_est, 0::BIGINT AS amount, NULL::VARCHAR AS reason, NULL::BIGINT AS target, 'go' AS state FROM v_route
  UNION ALL
  SELECT route_id, l, t, coalesce(to_pos, l), fuel + buy - (coalesce(to_pos, l) - pos), coalesce(to_price, 0), to_id, coalesce(to_est, false), to_ahead, step + 1,
         pos, id, price, est, buy, why, CASE WHEN act <> 'finish' THEN to_id END, CASE WHEN act IN ('finish', 'stuck') THEN act ELSE 'go' END
  FROM (SELECT *, {reason} AS why, CASE WHEN id IS NULL OR act = 'stuck' THEN 0 ELSE greatest(0, CASE WHEN act = 'finish' THEN l - pos WHEN act IN ('far', 'fill') THEN t ELSE to_pos - pos END - fuel) END AS buy
  FROM (SELECT {_MOVE}
  FROM (SELECT *, {act} AS act
  FROM (SELECT w.*, a.*, w.l - w.pos <= CASE WHEN w.id IS NULL THEN w.fuel ELSE w.t END AS done{', z.*' if saved else ''} FROM {name} w, LATERAL (SELECT {picks} FROM {name}_c c
      WHERE c.route_id = w.route_id AND c.pos > w.pos AND c.pos <= w.pos + CASE WHEN w.id IS NULL THEN w.fuel ELSE w.t END) a{saved} WHERE w.state = 'go')) m))),
{name}_b AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY step) - 1 AS stop_no, count(*) OVER (PARTITION BY route_id) AS n_stops FROM {name} WHERE amount > 0 AND route_id IN (SELECT route_id FROM {name} WHERE state = 'finish')),
{name}_s AS MATERIALIZED (SELECT b.route_id, b.l, b.t, b.stop_no, b.b_pos AS pos, b.b_id AS id, b.b_price AS price, b.b_est AS est, b.amount,
  CASE WHEN {kind == 'heuristic'} AND stop_no = n_stops - 1 AND reason = 'reach_cheaper_stop' AND NOT EXISTS (SELECT 1 FROM {name}_b x WHERE x.route_id = b.route_id AND x.b_id = b.target) THEN NULL ELSE target END AS target,
  CASE WHEN {kind == 'heuristic'} AND stop_no = n_stops - 1 AND reason = 'reach_cheaper_stop' AND NOT EXISTS (SELECT 1 FROM {name}_b x WHERE x.route_id = b.route_id AND x.b_id = b.target) THEN 'reach_finish' ELSE reason END AS reason FROM {name}_b b),
{name}_p AS MATERIALIZED (SELECT r.route_id, f.route_id IS NOT NULL AS feasible, CASE WHEN f.route_id IS NOT NULL THEN coalesce(n_stops, 0) END::INT AS n_stops, CASE WHEN f.route_id IS NOT NULL THEN coalesce(cost, 0) END::BIGINT AS cost,
  CASE WHEN f.route_id IS NOT NULL THEN coalesce(cost + flat, 0) END::BIGINT AS objective, CASE WHEN f.route_id IS NOT NULL THEN coalesce(bought, 0) END::BIGINT AS bought
  FROM v_route r LEFT JOIN (SELECT DISTINCT route_id FROM {name} WHERE state = 'finish') f USING (route_id)
  LEFT JOIN (SELECT route_id, count(*) AS n_stops, sum(price * amount) AS cost, sum({STOP} + est::INT * {MARGIN}) AS flat, sum(amount) AS bought FROM {name}_s GROUP BY route_id) USING (route_id))"""


def exact(c: str = "v_candidate", budget: int = 50_000, lists: bool = True) -> str:
    """Table ``xp``: objective, stops, their ids and what they buy (lists) of the best plan of each feasible route within the budget; without ``lists`` the first two.

    Labels (station, fuel on arrival) advance one purchase a round; within a round those with less fuel that are no cheaper go,
    and so do those that even the cheapest fuel ahead makes dearer than the heuristic's plan.
    """
    begin = ", 'p': []::BIGINT[], 'i': []::BIGINT[], 'a': []::BIGINT[]" if lists else ""
    further = ", 'p': list_append((lab.v).p, s.pos), 'i': list_append((lab.v).i, s.id), 'a': list_append((lab.v).a, CASE WHEN m = 1 THEN j.pos - s.pos ELSE s.t END - lab.fuel)" if lists else ""
    told = ", coalesce((min(v)).p, []) AS places, coalesce((min(v)).i, []) AS ids, coalesce((min(v)).a, []) AS amounts" if lists else ""
    return f"""{preflight(c)}, {effort(c)}, {walk("heuristic", "hb", "pr")}, ad AS (SELECT r.route_id, total_milli_mi AS l, tank_milli_mi AS t, on_board_milli_mi AS f0 FROM v_route r JOIN ef USING (route_id) JOIN pf USING (route_id) WHERE feasible AND estimate <= {budget}),
xst AS MATERIALIZED (SELECT route_id, k, opis_id::BIGINT AS id, pos_milli_mi AS pos, price_milli AS price, l, t, f0, objective AS most, min(price_milli) OVER (PARTITION BY route_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least, {STOP} + CASE WHEN price_source = 'eia_regional_estimate' THEN {MARGIN} ELSE 0 END AS flat FROM rk JOIN ad USING (route_id) JOIN hb_p USING (route_id)),
goal AS MATERIALIZED (SELECT route_id, k, pos, l - pos AS need, least, most FROM xst UNION ALL SELECT route_id, NULL, l, 0, 0, NULL FROM ad),
lab AS (
  SELECT route_id, k, f0 - pos AS fuel, {{'o': 0::BIGINT, 'n': 0{begin}}} AS v FROM xst WHERE pos <= f0 AND l > f0
  UNION ALL
  SELECT route_id, k, fuel, v FROM (SELECT *, min(v) OVER (PARTITION BY route_id, k ORDER BY fuel DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS richer FROM (SELECT route_id, k, fuel, min(v) AS v FROM (
    SELECT j.need, j.least, j.most, s.route_id, coalesce(j.k, -1) AS k, CASE WHEN j.k IS NULL OR m = 1 THEN 0 ELSE s.t - (j.pos - s.pos) END AS fuel,
           {{'o': (lab.v).o + s.flat + s.price * (CASE WHEN m = 1 THEN j.pos - s.pos ELSE s.t END - lab.fuel), 'n': (lab.v).n + 1{further}}} AS v
    FROM lab JOIN xst s ON lab.route_id = s.route_id AND lab.k = s.k JOIN goal j ON j.route_id = s.route_id AND j.pos <= s.pos + s.t AND (j.k > s.k OR j.k IS NULL) CROSS JOIN (VALUES (1), (2)) w(m)
    WHERE (m = 1 AND lab.fuel < j.pos - s.pos) OR (m = 2 AND j.k IS NOT NULL AND s.t > lab.fuel AND s.t > j.pos - s.pos)
  ) WHERE most IS NULL OR (v).o + CASE WHEN need > fuel THEN (need - fuel) * least + {STOP} ELSE 0 END <= most GROUP BY route_id, k, fuel)) WHERE richer IS NULL OR v < richer),
xp AS (SELECT ad.route_id, coalesce((min(v)).o, 0) AS objective, coalesce((min(v)).n, 0) AS n_stops{told} FROM ad LEFT JOIN (SELECT * FROM lab WHERE k = -1) x USING (route_id) GROUP BY ad.route_id)"""
