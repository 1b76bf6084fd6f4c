"""World against world, dominance and rank measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def world_diff(a: DataFrame, b: DataFrame, key: list[str], fields: list[str], censored: str) -> DataFrame:
    """Cells that differ between two worlds: presence, censoring, else the changed fields.  Both censored is no change."""
    left = a.select(*key, F.lit(True).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in (*fields, censored)])
    right = b.select(*key, F.lit(True).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in (*fields, censored)])
    ca, cb = F.col(f"a_{censored}"), F.col(f"b_{censored}")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in fields]))
    kind = (
        F.when(F.col("_a").isNull(), "appeared").when(F.col("_b").isNull(), "vanished").when(ca & cb, None).when(ca != cb, "censor_flip").when(F.size(changed) > 0, "changed")
    )
    out = left.join(right, key, "full").withColumn("kind", kind).withColumn("fields", F.when(F.col("kind") == "changed", F.array_join(changed, ",")))
    return out.where("kind IS NOT NULL").select(*key, "kind", "fields")


def picked(df: DataFrame, value: str, width: float, share: float = 0.5) -> DataFrame:
    """(lower, upper), one row: the values at the ranks floor and ceil of ``share`` of the way through the sorted column.

    Values are counted by range of ``width`` first.  Only the ranges that hold one of the two ranks are then counted value
    by value, so nothing is sorted but the counts of ranges and of those few values.  Nulls are left out; no value gives
    two nulls.
    """
    rows = df.select(F.col(value).alias("v")).where("v IS NOT NULL")
    ranged = rows.withColumn("range", F.floor(F.col("v") / width))
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumns({"after": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy(F.lit(1)))})
    first, second = F.floor((F.col("total") - 1) * share) + 1, F.ceil((F.col("total") - 1) * share) + 1
    holding = counts.withColumns({"before": F.col("after") - F.col("n"), "low": first, "high": second})
    holding = holding.where("(before < low AND low <= after) OR (before < high AND high <= after)").select("range", "before", "low", "high")
    few = ranged.join(F.broadcast(holding), "range").groupBy("range", "v", "before", "low", "high").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = few.withColumn("to", F.col("before") + F.sum("n").over(within)).withColumn("from", F.col("to") - F.col("n"))
    at = lambda rank: F.max(F.when((F.col("from") < F.col(rank)) & (F.col(rank) <= F.col("to")), F.col("v")))
    return few.agg(at("low").alias("lower"), at("high").alias("upper"))


def quantile_edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Inner bin edges: the sorted value at floor(n × i / bins)."""
    listed = df.where(F.col(value).isNotNull()).groupBy("route_id").agg(F.sort_array(F.collect_list(value)).alias("v"))
    edge = lambda i: F.get("v", F.floor(F.size("v") * i / bins).cast("int"))
    return listed.select("route_id", F.posexplode(F.array(*[edge(i) for i in range(1, bins)])).alias("i", "edge_milli")).select("route_id", (F.col("i") + 1).cast("long").alias("bin"), "edge_milli")


def by_rung(effort: DataFrame, ladder: tuple[int, ...]) -> DataFrame:
    """Cells that each rung admits for the first time, those in (previous rung, rung]; null is beyond the ladder."""
    rung = F.coalesce(*[F.when(F.col("estimate") <= r, F.lit(r).cast("long")) for r in ladder])
    return effort.groupBy(rung.alias("rung")).agg(F.count(F.lit(1)).alias("newly_admitted"))


def induced_threshold(cells: DataFrame, group: str, value: str, censored: str) -> DataFrame:
    """Per group the largest uncensored value below the least censored one, and how many cells lie up to it."""
    least = cells.groupBy(group).agg(F.min(F.when(F.col(censored), F.col(value))).alias("least_censored"))
    below = ~F.col(censored) & (F.col("least_censored").isNull() | (F.col(value) < F.col("least_censored")))
    return cells.join(least, group).groupBy(group).agg(F.max(F.when(below, F.col(value))).alias("threshold"), F.count_if(below).alias("retained"), F.count(F.lit(1)).alias("cells"))


def filled_linear(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Nulls of an ordered series on the straight line between their neighbours, the nearest value at the ends; all null stays null."""
    line = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("i", F.row_number().over(line))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("i"), F.col(value).alias("v")))
    by_i = Window.partitionBy(key).orderBy("i")
    rows = rows.withColumn("k", known).withColumn("p", F.last("k", ignorenulls=True).over(by_i)).withColumn("q", F.first("k", ignorenulls=True).over(by_i.rowsBetween(0, Window.unboundedFollowing)))
    share = (F.col("i") - F.col("p.i")) / F.nullif(F.col("q.i") - F.col("p.i"), F.lit(0))
    return rows.withColumn("filled", F.coalesce(F.col("p.v") + share * (F.col("q.v") - F.col("p.v")), "p.v", "q.v")).drop("k", "p", "q")


def content_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Twelve hex digits that name a table's rows, in whatever order: row digests are summed, so no row set meets in one task.  Fields go with their lengths, and null is none."""
    text = lambda c: F.col(c).cast("string")
    row = F.sha2(F.concat(*[F.coalesce(F.concat(F.char_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns]), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")) for i in range(2)]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.substring(F.sha2(F.concat_ws("|", *[p.cast("decimal(38,0)").cast("string") for p in parts]), 256), 1, 12).alias("digest"))


def inversions(ranks: np.ndarray) -> int:
    """Pairs of a sequence of ranks of which the earlier is the larger.

    Of two different ranks the highest bit in which they differ is unique: among members that share the bits above one,
    those with the bit that stand before one without it.  The members are parted by that bit, level by level.
    """
    found = 0
    for bit in range(int(ranks.max()).bit_length() - 1, -1, -1):
        above, one = ranks >> (bit + 1), (ranks >> bit) & 1
        before = np.cumsum(one) - one
        first = np.flatnonzero(np.concatenate(([True], above[1:] != above[:-1])))
        before -= np.repeat(before[first], np.diff(np.concatenate((first, [len(ranks)]))))
        found += int(before[one == 0].sum())
        ranks = ranks[np.argsort(ranks >> bit, kind="stable")]
    return found


def discordant_pairs(df: DataFrame, group: str, a: str, b: str, dealt: str | None = None) -> DataFrame:
    """(group, discordant): pairs that ``a`` and ``b`` order oppositely, ties in either left out.

    A group is the unit of work: its values are gathered, ordered by ``a`` (ties by ``b``, so that they do not count), and
    the inversions of ``b`` counted without forming pairs.  ``dealt`` names a column that keeps groups in their tasks.
    Rows with a null take part in no pair.
    """
    kind = df.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, bounds = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            x, y = (np.asarray(flat.field(c)) for c in ("x", "y"))
            told = []
            for low, high in zip(bounds[:-1], bounds[1:]):
                ranks = np.unique(y[low:high], return_inverse=True)[1]
                told.append(inversions(ranks[np.lexsort((ranks, x[low:high]))]) if high > low else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.int64())], names=[group, "discordant"])

    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    gathered = rows.groupBy(*[dealt] * bool(dealt), group).agg(F.collect_list(F.struct(F.col(a).alias("x"), F.col(b).alias("y"))).alias("v"))
    return gathered.select(group, "v").mapInArrow(run, f"{group} {kind}, discordant long").where("discordant > 0")


def ladder_walk(rungs: DataFrame, rung: str, good: Column) -> DataFrame:
    """Add ``adopted``: whether this rung and all before it pass; a rung never counts after one that fails."""
    return rungs.withColumn("adopted", F.every(F.coalesce(good, F.lit(False))).over(Window.partitionBy(F.lit(1)).orderBy(rung)))


def band(estimate: Column, budget: int, ceiling: int) -> Column:
    """How a cell is dispatched between a budget and a hard ceiling."""
    if ceiling < budget:
        raise ValueError("the ceiling lies below the budget")
    return F.when(estimate <= budget, "exact_direct").when(estimate <= ceiling, "exact_attempt").otherwise("heuristic")


def deadline_seconds(upstream: Column, bar: float = 15.0, overshoot: float = 0.5, allowance: float = 0.5, fanout: int = 3) -> Column:
    """What a response bar leaves for each of ``fanout`` searches, down to a tenth of a second; null where nothing is left."""
    left = F.floor((F.lit(bar - overshoot - allowance).cast("decimal(10,3)") - upstream) * 10 / F.lit(fanout))
    return F.when(left > 0, (left / F.lit(10)).cast("decimal(6,1)"))
