"""Plan search on one route, in exact integers and without Spark.

A problem is (length, tank, on_board, stations) in milli-miles; a station is (pos, price, id, estimated) with its price
in milli-dollars a gallon.  Costs are price times milli-miles, so dollars are cost / (1e6 × mpg).  A plan lists
purchases (pos, id, price, milli-miles bought, reason, id of the station driven to, None for the end); None in place of a
plan means that none reaches the end.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple


class Station(NamedTuple):
    pos: int
    price: int
    id: int
    estimated: bool


class Buy(NamedTuple):
    pos: int
    id: int
    price: int
    amount: int
    reason: str
    target: int | None = None


class OverBudget(Exception):
    """The exact search met more labels than allowed."""


class Problem(NamedTuple):
    length: int
    tank: int
    on_board: int
    stations: list[Station]


class Rates(NamedTuple):
    """Flat charges in cost units: per stop, and per purchase at an estimated price."""

    stop: int
    estimate: int


def plan_cost(plan: list[Buy]) -> int:
    return sum(b.price * b.amount for b in plan)


def objective(plan: list[Buy], stations: list[Station], rates: Rates) -> int:
    estimated = {s.id for s in stations if s.estimated}
    return plan_cost(plan) + sum(rates.stop + rates.estimate * (b.id in estimated) for b in plan)


def first_gap(p: Problem) -> tuple[int, int] | None:
    """(from, to) of the first stretch longer than its reach."""
    at, reach = 0, p.on_board
    for pos in [*sorted(s.pos for s in p.stations), p.length]:
        if pos - at > reach:
            return at, pos
        at, reach = pos, p.tank
    return None


def effort(p: Problem) -> int:
    """Transitions that an exact search is estimated to make; 0 for a route beyond reach, which is not searched."""
    if first_gap(p) is not None:
        return 0
    stops = sorted(p.stations)
    places = [s.pos for s in stops]
    total = bisect_right(places, p.on_board) + (p.length <= p.on_board)
    for i, at in enumerate(places):
        reach = bisect_right(places, at + p.tank) - i - 1 + (at + p.tank >= p.length)
        total += reach * (reach + 1)
    return total


def price_blind(p: Problem) -> list[Buy] | None:
    """Drive on to the farthest station that the fuel aboard reaches and fill up; the last stop buys only the rest."""
    stops = sorted(p.stations, key=lambda s: (s.pos, -s.id))
    places = [s.pos for s in stops]
    at, fuel, plan = 0, p.on_board, []
    while p.length - at > fuel:
        k = bisect_right(places, at + fuel) - 1
        if k < 0 or places[k] <= at:
            return None
        here = stops[k]
        fuel -= here.pos - at
        at = here.pos
        plan.append(Buy(at, here.id, here.price, min(p.tank, p.length - at) - fuel, "price_blind"))
        fuel = p.tank
    return plan


class _Drive:
    """A vehicle under way: where it is, its fuel, and what it has bought."""

    def __init__(self, p: Problem):
        self.p, self.here, self.at, self.fuel, self.plan = p, None, 0, p.on_board, []
        self.stops = sorted(p.stations)
        self.places = [s.pos for s in self.stops]

    def window(self) -> list[Station]:
        """Stations strictly ahead, within a full tank (at the start: within the fuel aboard)."""
        reach = self.p.tank if self.here else self.fuel
        return self.stops[bisect_right(self.places, self.at) : bisect_right(self.places, self.at + reach)]

    def ends_within(self) -> bool:
        return self.p.length - self.at <= (self.p.tank if self.here else self.fuel)

    def buy(self, level: int, reason: str, to: Station | None = None) -> None:
        if self.here and level > self.fuel:
            self.plan.append(Buy(self.at, self.here.id, self.here.price, level - self.fuel, reason, to.id if to else None))
            self.fuel = level

    def go(self, to: Station) -> None:
        self.fuel -= to.pos - self.at
        self.at, self.here = to.pos, to

    def fill_reason(self) -> str:
        ahead = [s.price for s in self.stops if s.pos > self.at]
        return "top_up_at_cheapest" if not ahead or self.here.price <= min(ahead) else "fill_to_continue"


def _by_price(s: Station) -> tuple[int, int, int]:
    return s.price, s.pos, s.id


def greedy(p: Problem) -> list[Buy] | None:
    """To the nearest cheaper station if there is one, else to the end, else fill up and go to the cheapest in reach."""
    d = _Drive(p)
    while True:
        seen = d.window()
        lower = [s for s in seen if d.here and s.price < d.here.price]
        if lower:
            to = min(lower)
            d.buy(to.pos - d.at, "reach_cheaper_stop", to)
        elif d.ends_within():
            d.buy(p.length - d.at, "reach_finish")
            return d.plan
        elif not seen:
            return None
        else:
            to = min(seen, key=_by_price)
            if d.here:
                d.buy(p.tank, d.fill_reason(), to)
        d.go(to)


def heuristic(p: Problem, rates: Rates) -> list[Buy] | None:
    """One pass that weighs the flat charge of a stop against what the cheaper stations passed by would save."""
    d = _Drive(p)
    while True:
        seen, done = d.window(), d.ends_within()
        if d.here is None:
            if done:
                return []
            if not seen:
                return None
            d.go(min(seen, key=_by_price))
            continue
        lower = [s for s in seen if s.price < d.here.price]
        if not seen and not done:
            return None
        far = None if done else max(seen, key=lambda s: (s.pos, -s.price, -s.id))
        if not lower:
            action = ("finish" if done else "far", "reach_finish" if done else d.fill_reason())
        elif far and far.price < d.here.price:
            action = ("far", "reach_cheaper_stop")
        else:
            passed = [s for s in lower if s.pos < (far.pos if far else p.length)]
            saved = sum(max(0, s.pos - d.at - d.fuel) * (d.here.price - s.price) for s in passed)
            charge = rates.stop + rates.estimate * d.here.estimated
            skip = bool(passed) and charge > saved
            action = (("finish", "reach_finish") if done else ("far", "bypass_cheaper_not_worth_stop")) if skip else ("near", "reach_cheaper_stop")
        move, reason = action
        if move == "finish":
            d.buy(p.length - d.at, reason)
            break
        to = far if move == "far" else min(lower, key=_by_price)
        d.buy(p.tank if move == "far" else to.pos - d.at, reason, to)
        d.go(to)
    if d.plan and d.plan[-1].reason == "reach_cheaper_stop" and d.plan[-1].target not in {b.id for b in d.plan}:
        d.plan[-1] = d.plan[-1]._replace(reason="reach_finish", target=None)  # the station it was bought for needed no purchase
    return d.plan


def exact(p: Problem, rates: Rates, most_labels: int | None = None) -> list[Buy] | None:
    """Least fuel cost plus flat charges; ties by fewer stops, then earlier positions, lower ids, smaller purchases.

    Between two successive purchases an optimal plan either fills the tank or arrives empty (shifting fuel between the
    two purchases changes cost linearly), so each label (station, fuel on arrival) has two moves per station ahead.
    Labels at a station are cut to their Pareto frontier of key and fuel.  A label is dropped if even the cheapest fuel
    ahead makes it dearer than the heuristic's plan.  More than ``most_labels`` labels raise OverBudget.

    Labels that stay lie in flat lists (station, label before, bought there); a path is followed back only for ties.
    """
    if p.length <= p.on_board:
        return []
    if first_gap(p) is not None:
        return None
    stops = sorted(p.stations)
    n = len(stops)
    known = heuristic(p, rates)
    limit = objective(known, stops, rates) if known is not None else None
    cheapest = [s.price for s in stops]
    for i in range(n - 2, -1, -1):
        cheapest[i] = min(cheapest[i], cheapest[i + 1])
    station: list[int] = []
    before: list[int] = []
    bought: list[int] = []
    waiting: list[list[tuple[int, int, int, int, int]]] = [[] for _ in range(n + 1)]  # cost, stops, -fuel, label before, bought there
    made = 0

    def path(label: tuple[int, int, int, int, int]) -> tuple[list[int], list[int], list[int]]:
        at, ids, amounts, parent, amount = [], [], [], label[3], label[4]
        while parent >= 0:
            s = stops[station[parent]]
            at.append(s.pos)
            ids.append(s.id)
            amounts.append(amount)
            parent, amount = before[parent], bought[parent]
        return at[::-1], ids[::-1], amounts[::-1]

    def in_order(labels: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        labels.sort()
        k = 0
        while k < len(labels):
            same = k + 1
            while same < len(labels) and labels[same][:2] == labels[k][:2]:
                same += 1
            if same > k + 1:
                labels[k:same] = sorted(labels[k:same], key=lambda x: (*path(x)[:2], x[2], path(x)[2]))
            k = same
        return labels

    def add(j: int, cost: int, count: int, fuel: int, parent: int, amount: int) -> None:
        nonlocal made
        need = p.length - stops[j].pos - fuel
        if limit is None or cost + (cheapest[j] * need + rates.stop if need > 0 else 0) <= limit:
            waiting[j].append((cost, count, -fuel, parent, amount))
            made += 1
            if most_labels is not None and made > most_labels:
                raise OverBudget

    for j, s in enumerate(stops):
        if s.pos <= p.on_board:
            add(j, 0, 0, p.on_board - s.pos, -1, 0)
    for i, s in enumerate(stops):
        flat, most = rates.stop + rates.estimate * s.estimated, -1
        labels, waiting[i] = in_order(waiting[i]), []
        for cost, count, less, parent, amount in labels:
            if -less <= most:
                continue
            fuel = most = -less
            me = len(station)
            station.append(i)
            before.append(parent)
            bought.append(amount)
            need = p.length - s.pos
            if fuel < need <= p.tank:
                waiting[n].append((cost + flat + s.price * (need - fuel), count + 1, 0, me, need - fuel))
            full = cost + flat + s.price * (p.tank - fuel)
            for j in range(i + 1, n):
                gap = stops[j].pos - s.pos
                if gap > p.tank:
                    break
                if gap > fuel:
                    add(j, cost + flat + s.price * (gap - fuel), count + 1, 0, me, gap - fuel)
                if p.tank > fuel and p.tank > gap:
                    add(j, full, count + 1, p.tank - gap, me, p.tank - fuel)
    if not waiting[n]:
        return None
    least = min(x[:2] for x in waiting[n])
    at, ids, amounts = min(path(x) for x in waiting[n] if x[:2] == least)
    price = {(s.pos, s.id): s.price for s in stops}
    return explained(p, [Buy(pos, key, price[pos, key], amount, "") for pos, key, amount in zip(at, ids, amounts)], rates)


def explained(p: Problem, plan: list[Buy], rates: Rates) -> list[Buy]:
    """The plan with a reason for each purchase."""
    out, fuel, at = [], p.on_board, 0
    for k, b in enumerate(plan):
        fuel += b.amount - (b.pos - at)
        at = b.pos
        goal = plan[k + 1].pos if k + 1 < len(plan) else p.length
        lower = [s for s in p.stations if b.pos < s.pos <= b.pos + p.tank and s.price < b.price]
        if k + 1 == len(plan):
            reason = "reach_finish"
        elif fuel < p.tank or plan[k + 1].price < b.price:
            reason = "reach_cheaper_stop"
        else:
            passed = [s for s in lower if s.pos < goal]
            before = fuel - b.amount
            saved = sum(max(0, s.pos - b.pos - before) * (b.price - s.price) for s in passed)
            if passed and rates.stop > saved:
                reason = "bypass_cheaper_not_worth_stop"
            else:
                reason = "fill_to_continue" if any(s.price < b.price for s in p.stations if s.pos > b.pos) else "top_up_at_cheapest"
        out.append(b._replace(reason=reason, target=plan[k + 1].id if k + 1 < len(plan) else None))
    return out


def legs_of(p: Problem, plan: list[Buy]) -> list[tuple[int, int, int]]:
    """(from, to, fuel on arrival) between the start, the purchases and the end."""
    out, at, fuel = [], 0, p.on_board
    for b in plan:
        fuel -= b.pos - at
        out.append((at, b.pos, fuel))
        at, fuel = b.pos, fuel + b.amount
    out.append((at, p.length, fuel - (p.length - at)))
    return out
