"""Routes as arcs of rings, against the same rules route by route."""

import numpy as np
import pytest

from larkspan.plans import arcs, search, solvers

DATA = "/root/testdata/sf0.001"
RATES = search.rates()


def worlds():
    """Rings of few and many stations, many of them at one place or at one price, and routes on them."""
    rng = np.random.default_rng(11)
    for n, places, prices in ((0, 1, 1), (1, 50, 3), (7, 40, 3), (40, 2_800_000, 4000), (60, 50, 900), (300, 2_800_000, 4000), (400, 90, 40)):
        at = rng.integers(0, places, n) * (2_800_000 // places)
        stations = at, 2687 + rng.integers(0, prices, n), rng.permutation(5 * n)[:n], rng.random(n) < 0.3
        m = 120
        tank = 400_000 + rng.integers(0, 7, m) * 100_000
        start = rng.integers(0, 2_800_000, m)
        start[::5] = rng.choice(at, len(start[::5])) if n else 0
        total = rng.integers(900_000, 2_800_000, m)
        total[::7] = 900_000  # some within a tank
        yield stations, arcs.Arcs(np.arange(m), start, total, tank, np.where(rng.random(m) < 0.25, tank // 2, tank))


def lists(stations, a):
    """Each route's stations as the solvers take them, and which of them pruning keeps."""
    at, price, ids, est = stations
    for start, total, tank, on_board in zip(*a[1:]):
        pos = (at - start) % 2_800_000
        own = sorted(solvers.Station(int(p), int(c), int(i), bool(e)) for p, c, i, e in zip(pos, price, ids, est) if p <= total)
        pos, price_, est_ = (np.array([getattr(s, c) for s in own]) for c in ("pos", "price", "estimated"))
        kept = search.kept_flags(np.zeros(len(own), np.int64), pos, price_, est_.astype(bool), pos + tank >= total) if own else []
        yield solvers.Problem(int(total), int(tank), int(on_board), own), [s for s, k in zip(own, kept) if k]


def plain_effort(p, stations):
    places = np.array([s.pos for s in stations], np.int64)
    reach = [int(np.searchsorted(places, at + p.tank, side="right")) - i - 1 + (at + p.tank >= p.length) for i, at in enumerate(places)]
    return len(places), sum(r * (r + 1) for r in reach) + int((places <= p.on_board).sum()) + (p.length <= p.on_board)


def test_efforts_are_those_of_every_station():
    for stations, a in worlds():
        ring = arcs.Ring(*stations)
        assert list(ring.kept_lists(a)) == [kept for _, kept in lists(stations, a)]
        pruned, raw = (list(zip(*(c.tolist() for c in ring.efforts(a, prunes)))) for prunes in (True, False))
        for k, (p, kept) in enumerate(lists(stations, a)):
            assert pruned[k] == plain_effort(p, kept) and raw[k] == plain_effort(p, p.stations)


@pytest.mark.parametrize("method", ["naive", "greedy", "heuristic"])
@pytest.mark.parametrize("prunes", [False, True])
def test_walks_are_the_solvers(method, prunes):
    if prunes and method != "heuristic":
        pytest.skip("only the heuristic is fed the pruned list")
    solve = {"naive": solvers.price_blind, "greedy": solvers.greedy, "heuristic": lambda p: solvers.heuristic(p, RATES)}[method]
    for stations, a in worlds():
        w = arcs.Ring(*stations).walk(method, a, RATES, prunes)
        rows = arcs.plan_batch(method, method, a, np.zeros(len(a.route)), w, RATES).to_pylist()
        for row, (p, kept) in zip(rows, lists(stations, a), strict=True):
            own = kept if prunes else p.stations
            plan = solve(p._replace(stations=own))
            assert row["feasible"] == (plan is not None)
            if plan is None:
                assert row["stops"] is None and row["cost"] is None and row["n_stops"] is None
                continue
            assert row["stops"] == [b._asdict() for b in plan]
            assert (row["n_stops"], row["cost"], row["objective"], row["bought"]) == (len(plan), solvers.plan_cost(plan), solvers.objective(plan, own, RATES), sum(b.amount for b in plan))


def test_inversions_and_ranks_are_those_of_every_pair(monkeypatch):
    for cells in (arcs.MOST_CELLS, 5000):  # narrow blocks, and wide ones
        monkeypatch.setattr(arcs, "MOST_CELLS", cells)
        for stations, a in worlds():
            ring = arcs.Ring(*stations)
            low, high = ring.bounds(a)
            got = ring.inversions(low, high)
            for k, (p, _) in enumerate(lists(stations, a)):
                pos, price = (np.array([getattr(s, c) for s in p.stations], np.int64) for c in ("pos", "price"))
                assert got[k] == ((pos[:, None] < pos) & (price[:, None] > price)).sum()
                if len(price):
                    i = k % len(price)
                    assert ring.ranked(low[k : k + 1], high[k : k + 1], np.array([i]))[0] == np.sort(price)[i]


@pytest.mark.parametrize("at_once", [1, 700, 500_000])
def test_pairs_come_whole_and_once(at_once):
    for stations, a in worlds():
        ring = arcs.Ring(*stations)
        low, high = ring.bounds(a)
        want = [(k, s.id) for k, (p, _) in enumerate(lists(stations, a)) for s in p.stations]
        assert sorted((own.start + int(r), int(ring.id[x])) for own, of, place in ring.spans(low, high, at_once) for r, x in zip(of, place)) == sorted(want)
        cheaper = {(k, s.id): sum(t.price < s.price for t in p.stations) for k, (p, _) in enumerate(lists(stations, a)) for s in p.stations}
        assert {(own.start + int(r), int(ring.id[x])): int(c) for own, of, place, n in ring.dearer_than(low, high, at_once) for r, x, c in zip(of, place, n)} == cheaper


def test_tallies_are_the_windows(spark):
    from pyspark.sql import functions as F

    from larkspan.sources import adapters

    rows = search.marked(adapters.candidates(spark, DATA))
    n = lambda c, name: F.count_if(c).alias(name)
    want = rows.groupBy("route_id").agg(F.count(F.lit(1)).alias("before"), n(F.col("removed") == "co_located", "co_located"), n(F.col("removed") == "tail", "tail"), n(F.col("removed").isNull(), "stay"), n(F.col("margin_blocked"), "blocked"), n(F.col("price_only"), "price_only"))
    got = arcs.tallies(spark, DATA).drop("penalty")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


#: Queries that form no candidate in the JVM, by their findings.
ARCS = {
    "F2": "agg22_discordant_pairs", "F4": "agg12_dominant_region", "F5": "agg17_quantile_edges", "F6": "agg19_demoted_summary", "F7": "agg13_price_percentile", "F8": "agg15_fleet_savings", "F9": "agg20_newly_admitted",
    "F10": "agg23_induced_threshold", "F11": "agg27_penalty_tallies", "F12": "agg25_disagreement_rate", "F13": "agg27_removal_tallies", "F14": "agg24_pruned_list_verdict", "F15": "agg30_adopted_budget",
    "F16": "agg29_stop_set_change", "F17": "agg30_bands", "F18": "agg30_recovery_verdicts", "F19": "fil13_validated_plans", "F20": "agg6_median_fill", "F21": "fil15_stop_coordinates", "F23": "join10_world_pairs",
}


@pytest.mark.parametrize("name", sorted(set(ARCS.values())))
def test_no_candidate_is_formed_or_moved(spark, monkeypatch, name):
    """With the tables of candidates out of reach the query still runs: routes and stations are all that is moved."""
    from larkspan import registry
    from larkspan.sources import adapters, files

    def refuse(*_, **__):
        raise AssertionError("candidates are formed")

    monkeypatch.setattr(adapters, "candidates", refuse)
    monkeypatch.setattr(adapters, "dealt_candidates", refuse)
    monkeypatch.setattr(files, "_SHARED", {})
    assert registry.QUERIES[name](spark, DATA).count() > 0
