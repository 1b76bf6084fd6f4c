"""Plan search over many routes: reachability, pruning and effort in windows and joins, the sequential search per route
in batches of whole routes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written
from . import solvers

MPG = 10
STOP_CENTS = 3500
MARGIN_CENTS = 547
#: Estimated transitions up to which a route is searched exactly, and the labels that such a search may make.
EXACT_BUDGET = 50_000
EXACT_LABELS = 2_000_000
_ORDER = ("pos_milli_mi", "price_milli", "opis_id")


def _keys(candidates: DataFrame) -> list[str]:
    """What groups candidates by route: with their deal, where they lie in their routes' tasks already."""
    return ["deal", "route_id"] if "deal" in candidates.columns else ["route_id"]


def preflight(routes: DataFrame, candidates: DataFrame) -> DataFrame:
    """(route_id, feasible, from_milli, to_milli, gap_milli): the first stretch beyond reach, null where none is.

    The first stretch is driven on the fuel aboard, every other on a full tank.
    """
    nodes = candidates.select("route_id", "tank_milli_mi", "on_board_milli_mi", F.col("pos_milli_mi").alias("pos"), F.col("opis_id").cast("long").alias("id"))
    ends = routes.select("route_id", "tank_milli_mi", "on_board_milli_mi", F.col("total_milli_mi").alias("pos"), F.lit(2**40).cast("long").alias("id"))
    last = F.lag("pos").over(Window.partitionBy("route_id").orderBy("pos", "id"))
    gaps = nodes.unionByName(ends).withColumn("last", last).withColumn("before", F.coalesce("last", F.lit(0))).withColumn("gap", F.col("pos") - F.col("before"))
    within = F.when(F.col("last").isNull(), F.col("on_board_milli_mi")).otherwise(F.col("tank_milli_mi"))
    first = gaps.groupBy("route_id").agg(F.min(F.when(F.col("gap") > within, F.struct("pos", "before", "gap"))).alias("bad"))
    return first.select("route_id", F.col("bad").isNull().alias("feasible"), F.col("bad.before").alias("from_milli"), F.col("bad.pos").alias("to_milli"), F.col("bad.gap").alias("gap_milli"))


def dealt(candidates: DataFrame) -> DataFrame:
    """Candidates dealt by route, so that the windows, the grouping and the search after it move nothing again.

    Into several times as many tasks as there are cores at least, since routes' efforts differ widely.
    """
    if "deal" in candidates.columns:
        return candidates
    spark = candidates.sparkSession
    return candidates.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "route_id")


def marked(candidates: DataFrame) -> DataFrame:
    """All candidates, dealt by route, with ``removed``, ``margin_blocked`` and ``price_only``.

    ``removed`` is co_located or tail where a cheaper one dominates, null for those that stay: a candidate is dominated
    by one at the same position, then within a tank of the end by one before it.  An estimated price never dominates a
    real one; ``margin_blocked`` tells those that stay for that reason alone.  A removed candidate is never cheaper than
    what removed it, so plain running minima over all of them give the sequential rule's result.
    """
    keys = _keys(candidates)
    same = Window.partitionBy(*keys, "pos_milli_mi").orderBy("price_milli", "opis_id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)  # one sort serves both
    rows = dealt(candidates).withColumn("_tail", F.col("pos_milli_mi") + F.col("tank_milli_mi") >= F.col("total_milli_mi")).withColumn("_est", F.col("price_source") == "eia_regional_estimate")
    estimated = F.col("_est")
    for name, w, counts in (("same", same, F.lit(True)), ("before", before, F.col("_tail"))):
        rows = rows.withColumn(f"_any_{name}", F.min(F.when(counts, F.col("price_milli"))).over(w)).withColumn(f"_real_{name}", F.min(F.when(counts & ~estimated, F.col("price_milli"))).over(w))
    beats = lambda name, kind: F.coalesce(F.col("price_milli") >= F.col(f"_{kind}_{name}"), F.lit(False))
    by = lambda name: F.when(estimated, beats(name, "any")).otherwise(beats(name, "real"))
    removed = F.when(by("same"), "co_located").when(F.col("_tail") & by("before"), "tail")
    rows = rows.withColumn("removed", removed).withColumn("_price_only", beats("same", "any") | (F.col("_tail") & beats("before", "any")))
    rows = rows.withColumn("margin_blocked", F.col("removed").isNull() & F.col("_price_only"))
    return rows.select(*candidates.columns, "removed", "margin_blocked", F.col("_price_only").alias("price_only"))


def pruned(candidates: DataFrame) -> DataFrame:
    """Candidates that no cheaper one dominates."""
    return marked(candidates).where("removed IS NULL").select(*candidates.columns)


def penalty_pruned(candidates: DataFrame, mpg: int = MPG, stop_cents: int = STOP_CENTS) -> DataFrame:
    """The kept candidates of a stronger rule, with ``penalty_dominated`` per route: near the end also those go whose price beats the cheapest one kept so far by less than the stop charge over a full tank.

    What goes does not lower the prices kept so far, so each route's stations are folded in order, within the JVM.
    """
    return penalty_kept(pruned(candidates), mpg, stop_cents)


def penalty_kept(candidates: DataFrame, mpg: int = MPG, stop_cents: int = STOP_CENTS) -> DataFrame:
    """The stronger rule alone, over candidates that are pruned already."""
    kept = candidates.withColumn("_tail", F.col("pos_milli_mi") + F.col("tank_milli_mi") >= F.col("total_milli_mi"))
    listed = kept.where("_tail").groupBy("route_id").agg(F.collect_list(penalty_station()).alias("v"))
    gone = listed.select("route_id", F.explode(penalty_gone(F.col("v"), mpg, stop_cents)).alias("opis_id"))
    return kept.join(gone, ["route_id", "opis_id"], "left_anti").select(*candidates.columns)


def penalty_station() -> Column:
    """What the stronger rule asks of a kept station near the end."""
    return F.struct("pos_milli_mi", "price_milli", "opis_id", (F.col("price_source") == "eia_regional_estimate").alias("est"), "tank_milli_mi")


def penalty_gone(tail: Column, mpg: int = MPG, stop_cents: int = STOP_CENTS) -> Column:
    """The ids that the stronger rule removes of a route's kept stations near its end."""
    least = stop_cents * 10_000 * mpg
    none = F.lit(None).cast("long")
    begin = F.struct(none.alias("any"), none.alias("real"), F.array().cast("array<int>").alias("gone"))

    def step(state: Column, s: Column) -> Column:
        witness = F.when(s["est"], state["any"]).otherwise(state["real"])
        goes = F.coalesce((witness - s["price_milli"]) * s["tank_milli_mi"] < least, F.lit(False))
        lower = lambda old: F.least(F.coalesce(old, s["price_milli"]), s["price_milli"])
        return F.struct(
            F.when(goes, state["any"]).otherwise(lower(state["any"])).alias("any"), F.when(goes | s["est"], state["real"]).otherwise(lower(state["real"])).alias("real"),
            F.when(goes, F.concat(state["gone"], F.array(s["opis_id"]))).otherwise(state["gone"]).alias("gone"),
        )

    return F.aggregate(F.sort_array(tail), begin, step)["gone"]


def _reached(kept: DataFrame) -> DataFrame:
    """``kept``'s keys, opis_id, pos and reach: the later-ranked nodes within a tank of each station; the end is a node.

    With ranks and positions in step that is a count of rows up to a position, so two windows replace a self-join: the
    last rank at or before pos + tank, minus one's own.
    """
    keys, mark = _keys(kept), lambda at, kind: F.struct(at.alias("at"), F.lit(kind).alias("kind"))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*_ORDER)))
    facts = [*keys, "opis_id", F.col("pos_milli_mi").alias("pos"), "rank", "total_milli_mi", "on_board_milli_mi"]
    marks = ranked.select(*facts, F.explode(F.array(mark(F.col("pos_milli_mi"), 0), mark(F.col("pos_milli_mi") + F.col("tank_milli_mi"), 1))).alias("m")).select("*", "m.at", "m.kind").drop("m")
    upto = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marks.withColumn("seen", F.count_if(F.col("kind") == 0).over(upto)).where("kind = 1")
    ahead = F.col("seen") - F.col("rank") + (F.col("at") >= F.col("total_milli_mi")).cast("long")
    return counted.select(*keys, "opis_id", "pos", "on_board_milli_mi", ahead.alias("reach"))


def reach(kept: DataFrame) -> DataFrame:
    """(route_id, opis_id, reach): the later-ranked nodes within a tank of each station; the end is a node."""
    return _reached(kept).select("route_id", "opis_id", "reach")


def effort(routes: DataFrame, kept: DataFrame, levels: bool = False) -> DataFrame:
    """(route_id, nodes, estimate): reach of the start plus reach × (reach + 1) of each station; with ``levels`` also fill_levels, plus reach + 1 of each."""
    work = F.sum(F.col("reach") * (F.col("reach") + 1)).alias("work")
    known = _reached(kept).groupBy(*_keys(kept)).agg(F.count(F.lit(1)).alias("nodes"), work, F.sum(F.col("reach") + 1).alias("levels"), F.count_if(F.col("pos") <= F.col("on_board_milli_mi")).alias("from_start")).drop("deal")
    joined = routes.join(known, "route_id", "left").fillna(0, ["nodes", "work", "levels", "from_start"])
    start = F.col("from_start") + (F.col("total_milli_mi") <= F.col("on_board_milli_mi")).cast("long")
    return joined.select("route_id", "nodes", (start + F.col("work")).alias("estimate"), *[(start + F.col("levels")).alias("fill_levels")] * levels)


def problems(routes: DataFrame, stations: DataFrame) -> DataFrame:
    """One row per route with its stations as an array, each with ``kept`` (all, unless ``stations`` is marked by pruning).

    ``stations`` that lie in their routes' tasks have a row for every route, also for one without stations.
    """
    is_marked = "removed" in stations.columns
    kept = F.col("removed").isNull() if is_marked else F.lit(True)
    station = F.struct(F.col("pos_milli_mi").alias("pos"), F.col("price_milli").alias("price"), F.col("opis_id").cast("long").alias("id"), (F.col("price_source") == "eia_regional_estimate").alias("estimated"), kept.alias("kept"))
    facts = ["route_id", "total_milli_mi", "tank_milli_mi", "on_board_milli_mi"]
    if "deal" in stations.columns:  # every route is there, in its task
        return stations.groupBy("deal", *facts).agg(F.collect_list(F.when(F.col("opis_id").isNotNull(), station)).alias("stations")).drop("deal")
    gathered = (stations if is_marked else dealt(stations)).groupBy("route_id").agg(F.collect_list(station).alias("stations"))
    return routes.select(*facts).join(gathered, "route_id", "left")


PLANS = (
    "route_id long, asked string, method string, feasible boolean, stations int, estimate long, n_stops int, cost long, objective long, bought long, "
    "stops array<struct<pos:long,id:long,price:long,amount:long,reason:string,target:long>>"
)
_STOPS = pa.list_(pa.struct([("pos", pa.int64()), ("id", pa.int64()), ("price", pa.int64()), ("amount", pa.int64()), ("reason", pa.string()), ("target", pa.int64())]))
_PLAN_TYPES = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), _STOPS)


def _planned(name: str, whole: solvers.Problem, kept: list[solvers.Station], rates: solvers.Rates, most_labels: int | None) -> tuple[str, list[solvers.Buy] | None]:
    """The method used and its plan; an exact search over its budget gives way to the heuristic."""
    if name == "exact":
        try:
            return name, solvers.exact(whole._replace(stations=kept), rates, most_labels)
        except solvers.OverBudget:
            name = "heuristic"
    if name == "naive":
        return name, solvers.price_blind(whole)
    return name, solvers.greedy(whole) if name == "greedy" else solvers.heuristic(whole, rates)


def solve(problem_rows: DataFrame, methods: tuple[str, ...], **options) -> DataFrame:
    """A plan per route and method: naive, greedy, heuristic (on all stations) and exact (on the kept ones).

    ``planned`` takes the column ``method`` of each row, or without one exact where the kept stations' estimated effort
    is at most ``budget``, else heuristic; ``estimate`` tells it.  Costs are in price milli-dollars × milli-miles.
    """
    return problem_rows.mapInArrow(solver(methods, **options), PLANS)


def rates(mpg: int = MPG, stop_cents: int = STOP_CENTS, margin_cents: int = MARGIN_CENTS) -> solvers.Rates:
    return solvers.Rates(stop_cents * 10_000 * mpg, margin_cents * 10_000 * mpg)


def plan_row(route: int, asked: str, method: str, plan: list[solvers.Buy] | None, n: int, estimate: int | None, stations: list[solvers.Station], charges: solvers.Rates) -> tuple:
    """A plan among ``stations``, or that there is none, as a row of ``PLANS``."""
    if plan is None:
        return route, asked, method, False, n, estimate, None, None, None, None, None
    return route, asked, method, True, n, estimate, len(plan), solvers.plan_cost(plan), solvers.objective(plan, stations, charges), sum(b.amount for b in plan), [b._asdict() for b in plan]


def plan_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_PLAN_TYPES)], names=[x.split()[0] for x in PLANS.split(", ")])


def solver(methods: tuple[str, ...], mpg: int = MPG, stop_cents: int = STOP_CENTS, margin_cents: int = MARGIN_CENTS, most_labels: int | None = EXACT_LABELS, budget: int = EXACT_BUDGET) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``solve`` does with the batches of a task."""
    charges = rates(mpg, stop_cents, margin_cents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for begin in range(0, whole_batch.num_rows, 500):
                batch = whole_batch.slice(begin, 500)
                column = {c: batch.column(c) for c in batch.schema.names}
                lists = column["stations"]
                flat = lists.flatten()
                counts = [len(x) if x.is_valid else 0 for x in lists]
                fields = [flat.field(c).to_pylist() for c in ("pos", "price", "id", "estimated")]
                every, flags = [solvers.Station(*x) for x in zip(*fields)], flat.field("kept").to_pylist()
                routes = zip(*(column[c].to_pylist() for c in ("route_id", "total_milli_mi", "tank_milli_mi", "on_board_milli_mi")))
                chosen = column["method"].to_pylist() if "method" in column else [None] * batch.num_rows
                rows, at = [], 0
                for (route, total, tank, on_board), n, own in zip(routes, counts, chosen):
                    stations, kept = every[at : at + n], [s for s, good in zip(every[at : at + n], flags[at : at + n]) if good]
                    at += n
                    whole = solvers.Problem(total, tank, on_board, stations)
                    for name in methods:
                        kind, estimate = name, None
                        if name == "planned":
                            estimate = solvers.effort(whole._replace(stations=kept)) if own is None else None
                            kind = own or ("exact" if estimate <= budget else "heuristic")
                        kind, plan = _planned(kind, whole, kept, charges, most_labels)
                        rows.append(plan_row(route, name, kind, plan, n, estimate, stations, charges))
                yield plan_rows(rows)

    return run


def _least_before(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The least value before each place in its group; groups are numbered in order, values lie below 2**39, which stands for none."""
    none, apart = 2**39, group * 2**40
    before = np.concatenate(([none], values[:-1]))
    before[np.concatenate(([True], group[1:] != group[:-1]))] = none
    return np.minimum.accumulate(before - apart) + apart


def kept_flags(route: np.ndarray, pos: np.ndarray, price: np.ndarray, estimated: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The rule of ``marked`` on arrays in order of route, position, price and id: whether no cheaper station dominates."""
    if not len(route):
        return np.zeros(0, bool)
    place = np.cumsum(np.concatenate(([False], (route[1:] != route[:-1]) | (pos[1:] != pos[:-1]))))
    beaten = np.zeros(len(route), bool)
    for group, counts in ((place, np.ones(len(route), bool)), (route, tail)):
        every, real = (_least_before(np.where(c, price, 2**39), group) for c in (counts, counts & ~estimated))
        beaten |= counts & (price >= np.where(estimated, every, real))
    return ~beaten


def brute_force(routes: DataFrame, kept: DataFrame, most: int = 6, mpg: int = MPG, stop_cents: int = STOP_CENTS, margin_cents: int = MARGIN_CENTS) -> DataFrame:
    """(route_id, objective, n_stops, stops, bought, is_unique): the best of all plans of the routes with at most ``most`` kept stations.

    A plan is a number to base three with a digit a station: pass by, buy just what reaches the next stop, or fill up.
    Each is folded along its route; those that run dry, or buy nothing where they stop, are none.  Ties as in the search.
    """
    station = F.struct("pos_milli_mi", "price_milli", F.col("opis_id").cast("long").alias("id"), (F.col("price_source") == "eia_regional_estimate").alias("estimated"))
    few = kept.groupBy("route_id").agg(F.sort_array(F.collect_list(station)).alias("v")).where(F.size("v") <= most)
    rows = routes.join(few, "route_id").withColumn("code", F.explode(F.sequence(F.lit(0), F.pow(F.lit(3), F.size("v")).cast("int") - 1)))
    digit = F.transform("v", lambda s, i: F.struct(s.alias("s"), F.pmod(F.floor(F.col("code") / F.pow(F.lit(3), i)).cast("int"), F.lit(3)).alias("mode")))
    long = lambda c: c.cast("long")
    tank, none = F.col("tank_milli_mi"), F.array().cast("array<bigint>")
    begin = F.struct(
        F.lit(True).alias("ok"), long(F.lit(0)).alias("pos"), long(F.col("on_board_milli_mi")).alias("fuel"), long(F.lit(0)).alias("price"), F.lit(0).alias("mode"), long(F.lit(0)).alias("objective"), long(F.lit(0)).alias("flat"),
        none.alias("places"), none.alias("ids"), none.alias("amounts"),
    )

    def hop(a: Column, pos: Column, price: Column, mode: Column, flat: Column, places: Column, ids: Column) -> Column:
        gap = pos - a["pos"]
        amount = F.when(a["mode"] == 1, gap - a["fuel"]).otherwise(tank - a["fuel"])
        fits = F.when(a["mode"] == 0, gap <= a["fuel"]).otherwise((amount > 0) & (gap <= tank))
        fuel = F.when(a["mode"] == 0, a["fuel"] - gap).when(a["mode"] == 1, 0).otherwise(tank - gap)
        spent = F.when(a["mode"] == 0, 0).otherwise(a["price"] * amount + a["flat"])
        amounts = F.when(a["mode"] == 0, a["amounts"]).otherwise(F.concat(a["amounts"], F.array(long(amount))))
        return F.struct(
            (a["ok"] & fits).alias("ok"), long(pos).alias("pos"), long(fuel).alias("fuel"), long(price).alias("price"), mode.cast("int").alias("mode"), long(a["objective"] + spent).alias("objective"), long(flat).alias("flat"),
            places.alias("places"), ids.alias("ids"), amounts.alias("amounts"),
        )

    def step(a: Column, x: Column) -> Column:
        s = x["s"]
        flat = stop_cents * 10_000 * mpg + F.when(s["estimated"], margin_cents * 10_000 * mpg).otherwise(0)
        bought = hop(a, s["pos_milli_mi"], s["price_milli"], x["mode"], flat, F.concat(a["places"], F.array(s["pos_milli_mi"])), F.concat(a["ids"], F.array(s["id"])))
        return F.when((x["mode"] == 0) | ~a["ok"], a).otherwise(bought)

    end = lambda a: hop(a, F.col("total_milli_mi"), F.lit(0), F.lit(0), F.lit(0), a["places"], a["ids"])
    plans = rows.select("route_id", F.aggregate(digit, begin, step, end).alias("a")).where("a.ok").select("route_id", "a.*")
    key = F.struct("objective", F.size("ids").alias("n_stops"), "places", "ids", "amounts")
    each = plans.groupBy("route_id", "objective").agg(F.min(key).alias("best"), F.countDistinct("ids", "amounts").alias("ties"))
    least = each.groupBy("route_id").agg(F.min(F.struct("objective", "best", "ties")).alias("m"))
    listed = lambda c: F.array_join(F.col(f"m.best.{c}").cast("array<string>"), ",")
    return least.select("route_id", "m.objective", F.col("m.best.n_stops").alias("n_stops"), listed("ids").alias("stops"), listed("amounts").alias("bought"), (F.col("m.ties") == 1).alias("is_unique"))


def dispatched(routes: DataFrame, candidates: DataFrame, budget: int = EXACT_BUDGET) -> DataFrame:
    """Problems of feasible routes with ``method``, ``estimate`` and ``nodes``: exact up to ``budget`` estimated transitions, else heuristic.

    The marked candidates are written to the shared folder once, since reachability, effort and problems all read them.
    """
    known = written(marked(candidates), "marked-candidates")
    chosen = effort(routes, known.where("removed IS NULL")).withColumn("method", F.when(F.col("estimate") <= budget, "exact").otherwise("heuristic"))
    good = preflight(routes, known).where("feasible").select("route_id")
    return problems(routes, dealt(known)).join(chosen, "route_id").join(good, "route_id", "left_semi")


def dollars(cost: Column, mpg: int = MPG) -> Column:
    return F.round(cost.cast("decimal(28,0)") / F.lit(1_000_000 * mpg).cast("decimal(12,0)"), 2).cast("decimal(18,2)")


def percent(part: Column, whole: Column) -> Column:
    """A share in percent to one place, half up on decimals; null of nothing."""
    return F.round(part.cast("decimal(28,0)") * 100 / F.nullif(whole.cast("decimal(24,0)"), F.lit(0)), 1).cast("decimal(8,1)")
