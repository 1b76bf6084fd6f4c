"""Station ETL: scans, hygiene, duplicate collapse, entity matching, ids and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from . import measure

ID_BASE = 1_000_000_000
TIER1_MI = 0.25


def collapse(observations: DataFrame, *first: str) -> DataFrame:
    """One row per station: lower median, least and greatest price, count, the longest name (first on ties), and the first values of further columns."""
    return observations.groupBy("opis_id").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY price_milli)").cast("long").alias("median_low_milli"),
        F.min("price_milli").alias("min_milli"),
        F.max("price_milli").alias("max_milli"),
        F.count(F.lit(1)).alias("observation_count"),
        F.max_by("name", F.struct(F.char_length("name"), -F.col("obs_ord"))).alias("name"),
        *[F.min_by(c, F.struct("obs_ord", c)).alias(c) for c in first],
    )


def duplicate_report(groups: DataFrame) -> DataFrame:
    many = F.col("observation_count") > 1
    spread = F.when(many, F.col("max_milli") - F.col("min_milli"))
    counts = groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(many).alias("duplicated"),
        F.count_if(many & (spread == 0)).alias("equal_price"),
        F.count_if(many & (spread > 0)).alias("conflicting"),
        F.max(spread).alias("max_spread_milli"),
    )
    middle = measure.picked(groups.withColumn("_spread", spread), "_spread", 16).select(F.col("lower").cast("long").alias("median_spread_milli"))
    return counts.crossJoin(F.broadcast(middle))


def hygiene(rows: DataFrame, name: str, status: str, confidence: str) -> DataFrame:
    """Add ``bucket``: the first rule that a row breaks, or kept."""
    n = F.col(name)
    bucket = (
        F.when(text.has_mojibake(n), "mojibake").when(text.is_alt_fuel(n), "alt_fuel").when(text.is_closed(F.col(status)), "closed").when(F.col(confidence) < 0.5, "below_floor").otherwise("kept")
    )
    return rows.withColumn("bucket", bucket)


def nearest_rooftop(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(in_id, match_id, dist_mi) of the nearest rooftop station in the 3 × 3 cells around each point, ties by id.

    The rooftops, the fewer, are dealt to the cells around theirs.  Spark takes rows for no more than they were before an
    explode and would broadcast them through the driver, so the join is told to sort and merge.
    """
    lat, lng = int(1e6 / geo.MILES), int(1e6 / (geo.MILES * 0.6))
    own = existing.where("geocode_precision = 'rooftop'").select(F.col("opis_id").alias("match_id"), F.col("lat_u").alias("m_lat"), F.col("lng_u").alias("m_lng"))
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    own = own.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    own = own.withColumn("cy", geo.cell(F.col("m_lat"), lat) + F.col("dy")).withColumn("cx", geo.cell(F.col("m_lng"), lng) + F.col("dx")).drop("dy", "dx")
    near = incoming.select("in_id", "lat_u", "lng_u", geo.cell(F.col("lat_u"), lat).alias("cy"), geo.cell(F.col("lng_u"), lng).alias("cx"))
    dist = F.round(geo.planar_miles(F.col("lat_u"), F.col("lng_u"), F.col("m_lat"), F.col("m_lng")), 4)
    return near.join(own.hint("merge"), ["cy", "cx"]).withColumn("dist", dist).groupBy("in_id").agg(F.min(F.struct("dist", "match_id")).alias("b")).select("in_id", "b.match_id", F.col("b.dist").alias("dist_mi"))


def entity_match(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(in_id, tier, match_id, dist_mi, decision, reason): tier 1 a rooftop within 0.25 miles, tier 2 the chain's first city-precision row; ``dist_mi`` is the nearest rooftop's, whatever the decision."""
    close = nearest_rooftop(incoming, existing).select("in_id", F.col("match_id").alias("near_id"), "dist_mi")
    city = existing.where("geocode_precision = 'city'").withColumn("chain", text.chain_of(F.col("name"))).where("chain IS NOT NULL")
    city = city.groupBy("chain", F.lower("city").alias("city"), F.upper("state").alias("state")).agg(F.min("opis_id").alias("m2"))
    mine = incoming.withColumn("chain", text.chain_of(F.col("name"))).withColumn("city", F.lower("city")).withColumn("state", F.upper("state"))
    out = mine.join(close, "in_id", "left").join(city, ["chain", "city", "state"], "left")
    tier = F.when(F.col("dist_mi") <= TIER1_MI, 1).when(F.col("m2").isNotNull(), 2)
    reason = F.when(tier == 1, "rooftop_within_threshold").when(tier == 2, "same_chain_city_state").when(F.col("chain").isNull(), "no_chain").otherwise("no_match")
    return out.select("in_id", tier.alias("tier"), F.when(tier == 1, F.col("near_id")).otherwise(F.col("m2")).alias("match_id"), "dist_mi", F.when(tier.isNull(), "keep").otherwise("drop").alias("decision"), reason.alias("reason"))


def spot_clusters(places: DataFrame, size: int, most: int, low: float, high: float) -> DataFrame:
    """(cy, cx, places, why): the ``most`` densest grid cells, and every other cell with a place whose ``dist_mi`` lies between ``low`` and ``high``."""
    cells = places.groupBy(geo.cell(F.col("lat_u"), size).alias("cy"), geo.cell(F.col("lng_u"), size).alias("cx")).agg(F.count(F.lit(1)).alias("places"), F.max(F.coalesce(F.col("dist_mi").between(low, high), F.lit(False))).alias("edge"))
    dense = cells.orderBy(F.col("places").desc(), "cy", "cx").limit(most).select("cy", "cx", F.lit("dense").alias("why"))  # a top-k report
    return cells.join(F.broadcast(dense), ["cy", "cx"], "left").where("why IS NOT NULL OR edge").select("cy", "cx", "places", F.coalesce("why", F.lit("boundary")).alias("why"))


def minted(key: Column) -> Column:
    """A station id from a source key: base plus the first 12 digits of its SHA-256, modulo 10^9."""
    return F.lit(ID_BASE) + F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("long") % 1_000_000_000


def upsert_plan(snapshot: DataFrame, files: DataFrame, value: str) -> DataFrame:
    """(opis_id, value, change): the later file wins per id; change is against one snapshot taken before."""
    last = Window.partitionBy("opis_id").orderBy(F.col("file_no").desc(), F.col("line_no").desc())
    new = files.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("opis_id", F.col(value).alias("_new"), F.lit(True).alias("_in"))
    old = snapshot.select("opis_id", F.col(value).alias("_old"), F.lit(True).alias("_had"))
    change = F.when(F.col("_had").isNull(), "created").when(F.col("_in").isNull(), "untouched").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return old.join(new, "opis_id", "full").select("opis_id", F.when(F.col("_in"), F.col("_new")).otherwise(F.col("_old")).alias(value), change.alias("change"))


def file_changes(snapshot: DataFrame, files: DataFrame, value: str) -> DataFrame:
    """Each file row with ``change`` against the snapshot: created, unchanged or updated."""
    old = snapshot.select("opis_id", F.col(value).alias("_old"), F.lit(True).alias("_had"))
    change = F.when(F.col("_had").isNull(), "created").when(F.col("_old").eqNullSafe(F.col(value)), "unchanged").otherwise("updated")
    return files.join(old, "opis_id", "left").withColumn("change", change).drop("_old", "_had")


def overlapping(places: DataFrame, boxes: tuple[tuple[int, int, int, int], ...]) -> DataFrame:
    """Rows whose ``bbox`` struct meets one of the (south, north, west, east) boxes; plain field ranges, so scans can use them."""
    b = lambda f: F.col(f"bbox.{f}")
    hits = [(b("ymax") >= s) & (b("ymin") <= n) & (b("xmax") >= w) & (b("xmin") <= e) for s, n, w, e in boxes]
    return places.where(reduce(Column.__or__, hits))


def hash_sample(df: DataFrame, key: str, seed: str, share: float) -> DataFrame:
    """Rows whose seeded key digest falls in the lowest ``share`` of 10,000 bins: the same rows in every run."""
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 12)
    return df.where(F.conv(digest, 16, 10).cast("long") % 10_000 < round(share * 10_000))


def location_kind(s: Column) -> Column:
    """``point`` for a coordinate pair inside the bounds, ``out_of_bounds`` for one outside, ``address`` up to 256 characters, else ``invalid``."""
    s = F.trim(s)
    pair = F.when(s.rlike(r"^-?[0-9.]+ *, *-?[0-9.]+$"), F.split(s, ","))
    lat, lng = (F.trim(F.get(pair, i)).try_cast("double") for i in (0, 1))
    inside = lat.between(24.4, 49.4) & lng.between(-125.0, -66.9)
    point = F.when(inside, "point").otherwise("out_of_bounds")
    return F.when(lat.isNotNull() & lng.isNotNull(), point).when(F.char_length(s).between(1, 256), "address").otherwise("invalid")
