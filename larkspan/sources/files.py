"""Files that queries write and read back: delimited exports, nested partitioned extracts, release listings.

Everything goes to a fresh folder below the one that ``spark.checkpoint.dir`` names, which all executors share.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}
_SHARED: dict[tuple[str, ...], DataFrame] = {}
#: Pattern of a release folder: date and counter.
RELEASE = r"/release=(\d{4}-\d{2}-\d{2}\.\d+)/"


def release_of(path: Column) -> Column:
    """The release that a path's folder names, null without one."""
    return F.nullif(F.regexp_extract(path, RELEASE, 1), F.lit(""))


def is_release(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^\d{4}-\d{2}-\d{2}\.\d+$"), F.lit(False))


def missing_columns(header: Column, required: list[str]) -> Column:
    """Required names that a comma-separated header lacks, in their order."""
    return F.array_except(F.array(*map(F.lit, required)), F.split(header, ","))


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; a folder of this machine stands in only in local mode without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _FALLBACK:
            _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="spark-files-", dir="/tmp")
        named = _FALLBACK[app]
    path = f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def shared(spark: SparkSession, label: str, of: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``, written once for all who ask for ``label`` of the same inputs, until ``drop_written``."""
    key = (spark.sparkContext.applicationId, label, *of)
    if key not in _SHARED:
        _SHARED[key] = written(make(), label)
    return _SHARED[key]


def drop_written(spark: SparkSession) -> None:
    """Delete what this session wrote into the shared folder; what reads it lazily must be done."""
    for key in [k for k in _SHARED if k[0] == spark.sparkContext.applicationId]:
        del _SHARED[key]
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as written to the shared folder and read back: its lineage ends there."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_csv(df: DataFrame, order: str, label: str) -> str:
    """Write ``df`` as CSV with a header, null as nothing, ordered by ``order`` across and within the part files."""
    path = fresh_path(df.sparkSession, label)
    df.repartitionByRange(order).sortWithinPartitions(order).write.csv(path, header=True, nullValue="", emptyValue="", escape='"')
    return path


def scan_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """The required columns as strings, blanks as null; a column that the header lacks stops the scan by its name."""
    rows = spark.read.csv(path, header=True, escape='"')
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"columns missing from {path}: {', '.join(missing)}")
    return rows.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in required])


#: The columns of a price list, and of a raw extract of places.
PRICE_COLUMNS = ("OPIS Truckstop ID", "Truckstop Name", "Address", "City", "State", "Rack ID", "Retail Price")
EXTRACT_COLUMNS = (
    "gers_id", "name", "brand_name", "address_freeform", "address_locality", "address_region", "address_postcode", "category", "confidence", "operating_status", "longitude", "latitude",
)


def price_rows(spark: SparkSession, path: str) -> DataFrame:
    """A price list's rows; ``ok`` is false where the id or the price does not parse.  Quoted fields may hold commas and quotes."""
    rows = scan_csv(spark, path, list(PRICE_COLUMNS)).toDF("id", "name", "address", "city", "state", "rack_id", "price")
    rows = rows.select(F.col("id").try_cast("int").alias("opis_id"), "name", "address", "city", "state", "rack_id", F.col("price").try_cast("decimal(11,8)").alias("retail_price"))
    return rows.withColumn("ok", F.col("opis_id").isNotNull() & F.col("retail_price").isNotNull())


def extract_rows(spark: SparkSession, path: str) -> DataFrame:
    """A raw extract's rows, state trimmed and upper-cased; ``ok`` is false where a number does not parse or the id is blank.  A header that lacks a column stops the scan."""
    rows = scan_csv(spark, path, list(EXTRACT_COLUMNS)).withColumn("address_region", F.upper("address_region"))
    for c, kind in (("confidence", "double"), ("longitude", "decimal(11,8)"), ("latitude", "decimal(11,8)")):
        rows = rows.withColumn(c, F.col(c).try_cast(kind))
    return rows.withColumn("ok", F.col("gers_id").isNotNull() & F.col("confidence").isNotNull() & F.col("longitude").isNotNull() & F.col("latitude").isNotNull())


def write_extract(places: DataFrame) -> str:
    """Places as Parquet with nested columns, one folder a release."""
    path = fresh_path(places.sparkSession, "extract")
    places.write.partitionBy("release").parquet(path)
    return path


def wanted_places(spark: SparkSession, path: str, release: str, categories: list[str], floor: float) -> DataFrame:
    """Places of one release by category and confidence: partition and field predicates reach the Parquet scan."""
    return spark.read.parquet(path).where((F.col("release") == release) & F.col("categories.primary").isin(*categories) & (F.col("confidence") >= floor))


def place_columns(places: DataFrame) -> DataFrame:
    """The twelve columns of a raw extract, out of the structs and arrays of a nested one; a place's point is the middle of its box, given in micro-degrees."""
    first = F.get("addresses", 0)
    middle = lambda a: (F.floor((F.col(f"bbox.{a}min") + F.col(f"bbox.{a}max")) / 2).cast("decimal(12,0)") * F.lit(0.000001).cast("decimal(7,6)")).cast("decimal(10,6)")
    return places.select(
        F.col("id").alias("gers_id"), F.col("names.primary").alias("name"), F.col("brand.names.primary").alias("brand_name"), *[first[c].alias(f"address_{c}") for c in ("freeform", "locality", "region", "postcode")],
        F.col("taxonomy.primary").alias("category"), "confidence", "operating_status", middle("x").alias("longitude"), middle("y").alias("latitude"),
    )


def releases(spark: SparkSession, path: str) -> DataFrame:
    """(release,) folders below ``path``, each once, from the file listing alone; none at all is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", RELEASE, 1).alias("release"))
    found = files.where("release <> ''").distinct()
    if found.isEmpty():
        raise ValueError(f"no release below {path}")
    return found


def first_feature(body: Column) -> Column:
    """(lat, lng) of a geocoder answer's first feature, whose point is given as [lng, lat]; null without features."""
    shape = "features array<struct<geometry:struct<type:string,coordinates:array<double>>>>"
    point = F.get(F.from_json(body, shape)["features"], 0)["geometry"]["coordinates"]
    return F.when(F.size(point) >= 2, F.struct(F.get(point, 1).alias("lat"), F.get(point, 0).alias("lng")))


def batch_answers(lines: DataFrame) -> DataFrame:
    """Geocoder batch answers, CSV with quoted fields: under three fields a line is dropped; eight with ``Match`` carry "lng,lat" as the sixth."""
    shape = ", ".join(f"f{i} string" for i in range(8))
    f = F.from_csv("line", shape, {"escape": '"'})
    rows = lines.select(f.alias("f")).where("f.f2 IS NOT NULL")
    matched = F.coalesce((F.col("f.f2") == "Match") & F.col("f.f7").isNotNull(), F.lit(False))
    pair = F.split(F.col("f.f5"), ",")
    return rows.select(
        F.col("f.f0").try_cast("int").alias("opis_id"), matched.alias("matched"),
        F.when(matched, F.get(pair, 1).try_cast("double")).alias("lat"), F.when(matched, F.get(pair, 0).try_cast("double")).alias("lng"),
    )


METRES = 1609.344
_LEG = "struct<distance:double,duration:double,annotation:struct<distance:array<double>,duration:array<double>>>"
DIRECTIONS = f"code string, routes array<struct<geometry:struct<coordinates:array<array<double>>>,distance:double,duration:double,legs:array<{_LEG}>>>"


def direction_routes(answers: DataFrame, body: str = "body") -> DataFrame:
    """One row per alternative of each directions answer, with its line, legs and the annotations of all legs in order.

    An answer without a route (or with another code than Ok) gives one row whose ``error`` names the code.  Legs,
    annotations or parts of them that are missing count as empty.
    """
    told = answers.withColumn("_d", F.from_json(body, DIRECTIONS))
    good = (F.col("_d.code") == "Ok") & (F.size("_d.routes") > 0)
    rows = told.select(*[c for c in answers.columns if c != body], F.posexplode_outer(F.when(good, F.col("_d.routes"))).alias("alternative_index", "r"), F.when(~F.coalesce(good, F.lit(False)), F.coalesce("_d.code", F.lit("unreadable"))).alias("error"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    legs = F.coalesce(F.col("r.legs"), none(_LEG))
    of = lambda leg, name: F.coalesce(leg["annotation"][name], none("double"))
    miles = lambda x: x / F.lit(METRES)
    return rows.withColumn("legs", legs).select(
        *[c for c in rows.columns if c != "r"], F.col("r.geometry.coordinates").alias("coordinates"), miles(F.col("r.distance")).alias("total_mi"), F.col("r.duration").alias("duration_s"),
        F.transform("legs", lambda x: miles(F.coalesce(x["distance"], F.lit(0.0)))).alias("leg_distances_mi"), F.transform("legs", lambda x: F.size(of(x, "distance"))).alias("leg_lengths"),
        F.transform(F.flatten(F.transform("legs", lambda x: of(x, "distance"))), miles).alias("annotation_mi"), F.flatten(F.transform("legs", lambda x: of(x, "duration"))).alias("annotation_s"),
    )


SERIES = "response struct<data:array<struct<period:string,duoarea:string,product:string,value:string>>>"


def series_rows(answers: DataFrame, body: str = "body") -> DataFrame:
    """(period, duoarea, product, value) of weekly series answers; a value that is no number is null."""
    row = F.explode(F.from_json(body, SERIES)["response"]["data"]).alias("d")
    return answers.select(row).select("d.period", "d.duoarea", "d.product", F.col("d.value").try_cast("decimal(10,3)").alias("value"))
