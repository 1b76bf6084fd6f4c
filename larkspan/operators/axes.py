"""Times along a route, from measured axes whose length differs from the route's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def times_at(marks: DataFrame, axes: DataFrame) -> DataFrame:
    """``marks`` (route_id, at, total, ...) with ``seconds``: the time at each mark, linear within the axis's segment.

    ``axes`` (route_id, seq, length, seconds) are consecutive segments.  A mark is first scaled by the axis's length over
    the route's ``total``, since the two are measured apart; before the start and beyond the end it takes the ends'
    times.  Of segments without length the last one's start counts.  A route without an axis, or with a null in it, gives
    null; an axis or a route without length gives 0.

    Two ordered sequences per route merge in one window, so a mark meets no segment but its own.
    """
    line = Window.partitionBy("route_id").orderBy("seq")
    ends = axes.withColumns({"d1": F.sum("length").over(line), "s1": F.sum("seconds").over(line)})
    segments = ends.withColumns({"d0": F.coalesce(F.lag("d1").over(line), F.lit(0.0)), "s0": F.coalesce(F.lag("s1").over(line), F.lit(0.0))})
    whole = ends.groupBy("route_id").agg(F.max("d1").alias("_axis"), F.max("s1").alias("_most"), F.count_if(F.col("length").isNull() | F.col("seconds").isNull()).alias("_gaps"))
    placed = marks.join(whole, "route_id", "left")
    scaled = F.when((F.col("total") > 0) & (F.col("_axis") > 0) & (F.col("_gaps") == 0), F.col("at") * F.col("_axis") / F.col("total"))
    placed = placed.withColumn("_scaled", scaled)

    seg = F.struct("d0", "d1", "s0", "s1")
    told = F.struct(*[c for c in placed.columns if c != "route_id"])
    none = F.lit(None)
    rows = segments.select("route_id", F.col("d0").alias("pos"), F.lit(0).alias("kind"), "seq", seg.alias("seg"), none.cast(placed.select(told.alias("m")).schema["m"].dataType).alias("m"))
    rows = rows.unionByName(placed.select("route_id", F.col("_scaled").alias("pos"), F.lit(1).alias("kind"), none.cast(dict(segments.dtypes)["seq"]).alias("seq"), none.cast(segments.select(seg.alias("s")).schema["s"].dataType).alias("seg"), told.alias("m")))
    merged = rows.withColumn("seg", F.last("seg", ignorenulls=True).over(Window.partitionBy("route_id").orderBy("pos", "kind", "seq"))).where("kind = 1")
    return merged.select("route_id", *[F.col(f"m.{c}").alias(c) for c in marks.columns if c != "route_id"], _time().alias("seconds"))


def _time() -> Column:
    at, axis, most, s = F.col("m._scaled"), F.col("m._axis"), F.col("m._most"), F.col("seg")
    inside = F.when(s["d1"] > s["d0"], s["s0"] + (at - s["d0"]) / (s["d1"] - s["d0"]) * (s["s1"] - s["s0"])).otherwise(s["s0"])
    known = F.col("m._gaps") == 0
    return F.when(known & ((axis <= 0) | (F.col("m.total") <= 0)), 0.0).when(at <= 0, 0.0).when(at >= axis, most).otherwise(inside)
