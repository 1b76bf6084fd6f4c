"""Plan search against brute force on at most six stations."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspan.plans import solvers
from larkspan.plans.solvers import Problem, Rates, Station


def brute(p, rates):
    best = None
    for k in range(len(p.stations) + 1):
        for chosen in itertools.combinations(sorted(p.stations), k):
            nodes = [s.pos for s in chosen] + [p.length]

            def walk(i, fuel, at, cost):
                nonlocal best
                fuel -= nodes[i] - at
                if fuel < 0:
                    return
                if i == k:
                    best = cost if best is None else min(best, cost)
                    return
                s = chosen[i]
                for level in {p.tank, *[x - s.pos for x in nodes[i + 1 :]]}:
                    if fuel < level <= p.tank:
                        walk(i + 1, level, s.pos, cost + s.price * (level - fuel) + rates.stop + rates.estimate * s.estimated)

            walk(0, p.on_board, 0, 0)
    return best


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(25, 50), st.booleans()), max_size=6), st.integers(6, 20), st.integers(3, 8), st.sampled_from([0, 5, 35]), st.sampled_from([0, 5]), st.sampled_from([1, 2]))
def test_exact_equals_brute_force(raw, length, tank, stop, margin, part):
    stations = [Station(pos * 100_000, price * 100, i, est) for i, (pos, price, est) in enumerate(raw) if pos <= length]
    p, rates = Problem(length * 100_000, tank * 100_000, tank * 100_000 // part, stations), Rates(stop * 10**7, margin * 10**7)
    plan = solvers.exact(p, rates)
    assert (plan is None) == (solvers.first_gap(p) is not None)
    if plan is not None:
        assert solvers.objective(plan, stations, rates) == brute(p, rates)
        for other in (solvers.heuristic(p, rates), solvers.greedy(p)):
            assert solvers.objective(other, stations, rates) >= solvers.objective(plan, stations, rates)
            assert min(level for _, _, level in solvers.legs_of(p, other)) >= 0


def test_price_blind_stops_at_the_farthest_in_reach():
    p = Problem(900_000, 500_000, 500_000, [Station(100_000, 3000, 1, False), Station(400_000, 1000, 2, False), Station(480_000, 4000, 3, False)])
    assert [(b.pos, b.amount) for b in solvers.price_blind(p)] == [(480_000, 400_000)]


def test_price_blind_with_half_a_tank():
    p = Problem(900_000, 500_000, 250_000, [Station(100_000, 3000, 1, False), Station(240_000, 1000, 2, False), Station(600_000, 4000, 3, False)])
    assert [(b.id, b.amount) for b in solvers.price_blind(p)] == [(2, 490_000), (3, 160_000)]


def test_a_search_over_its_labels_gives_way_to_the_heuristic(spark):
    from larkspan.plans import search

    rows = [(1, 0, 2_000_000, 700_000, 350_000, i, "s", "TX", 2500 + i * 613 % 900, "opis_indexed", i * 90_000 + 50_000) for i in range(22)]
    c = spark.createDataFrame(rows, CANDIDATES)
    routes = c.select("route_id", "total_milli_mi", "tank_milli_mi", "on_board_milli_mi").distinct()
    ready = search.dispatched(routes, c)
    (full,), (cut,) = (search.solve(ready, ("planned",), most_labels=n).collect() for n in (None, 3))
    assert (full["method"], cut["method"]) == ("exact", "heuristic") and full["objective"] <= cut["objective"]


def test_half_a_tank_shortens_the_first_stretch(spark):
    from larkspan.plans import search

    row = lambda r, on_board: (r, 0, 900_000, 500_000, on_board, 1, "s", "TX", 3000, "opis_indexed", 400_000)
    c = spark.createDataFrame([row(1, 500_000), row(2, 250_000)], CANDIDATES)
    got = {r["route_id"]: (r["feasible"], r["from_milli"], r["to_milli"], r["gap_milli"]) for r in search.preflight(c.select("route_id", "total_milli_mi", "tank_milli_mi", "on_board_milli_mi"), c).collect()}
    assert got == {1: (True, None, None, None), 2: (False, 0, 400_000, 400_000)}


CANDIDATES = "route_id long, alternative_index int, total_milli_mi long, tank_milli_mi long, on_board_milli_mi long, opis_id int, name string, state string, price_milli long, price_source string, pos_milli_mi long"


def test_pruning_keeps_the_optimum(spark):
    from larkspan.plans import search

    rng = random.Random(11)
    rows = [(r, 0, 2_000_000, 700_000, 700_000 - 50_000 * (r % 3), i, f"s{i}", "TX", rng.randint(2500, 4000), rng.choice(["opis_indexed", "eia_regional_estimate"]), rng.randint(1, 19) * 100_000) for r in range(12) for i in range(14)]
    c = spark.createDataFrame(rows, CANDIDATES)
    routes = c.select("route_id", "total_milli_mi", "tank_milli_mi", "on_board_milli_mi").distinct()
    rates = dict(margin_cents=0)
    full = {r["route_id"]: r["objective"] for r in search.solve(search.problems(routes, c), ("exact",), **rates).collect()}
    cut = {r["route_id"]: r["objective"] for r in search.solve(search.problems(routes, search.marked(c)), ("exact",), **rates).collect()}
    assert full == cut


@pytest.mark.parametrize("name,chain", [("Pilot Travel Center #4", "PILOT"), ("Atlanta Fuel", None), ("Love's Travel Stop", "LOVES"), (None, None)])
def test_chain_names_are_whole_tokens(spark, name, chain):
    from pyspark.sql import functions as F

    from larkspan.functions import text

    assert spark.createDataFrame([(name,)], "n string").select(text.chain_of(F.col("n"))).first()[0] == chain


def test_core_stands_without_the_other_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "larkspan"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]
