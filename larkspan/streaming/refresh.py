"""The refresh of a station table as a standing loop over releases that land as folders.

A file-source stream finds what has landed since its last turn.  A turn applies the newest release of its batch to the
state that the turn before left, and writes the new state and the difference under the batch's number.  A batch that is
run again after a failure overwrites just these, so nothing is applied twice; a release that lands again finds all its
rows unchanged.  Releases older than the one applied last are told as outdated and change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning
from .ordered import settings

SHAPE = "opis_id int, price_milli long, release string"
STATE = "opis_id int, price_milli long, applied string"
DIFF = "opis_id int, price_milli long, change string, release string, turn long"


def _turns(spark: SparkSession, home: str) -> list[int]:
    """Numbers of the turns whose state is complete."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{home}/state")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    names = [f.getPath() for f in system.listStatus(place)]
    return sorted(int(p.getName().split("=")[1]) for p in names if system.exists(jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")))


def turn(batch: DataFrame, number: int, home: str) -> None:
    """Apply one batch; see the module's text."""
    spark = batch.sparkSession
    done = [n for n in _turns(spark, home) if n < number]
    before = spark.read.schema(STATE).parquet(f"{home}/state/turn={done[-1]}") if done else spark.createDataFrame([], STATE)
    applied = before.agg(F.max("applied")).first()[0]
    newest = batch.agg(F.max("release")).first()[0]
    if newest is None:
        return
    if applied is not None and newest < applied:
        diff = batch.select("opis_id", "price_milli", F.lit("outdated").alias("change"), "release")
        after = before
    else:
        landed = batch.where(F.col("release") == newest).select("opis_id", F.lit(1).alias("file_no"), "price_milli", F.monotonically_increasing_id().alias("line_no"))
        plan = cleaning.upsert_plan(before.select("opis_id", "price_milli"), landed, "price_milli")
        diff = plan.select("opis_id", "price_milli", "change", F.lit(newest).alias("release"))
        after = plan.select("opis_id", "price_milli", F.lit(newest).alias("applied"))
    diff.withColumn("turn", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{home}/diff/turn={number}")
    after.write.mode("overwrite").parquet(f"{home}/state/turn={number}")


def work_off(spark: SparkSession, landing: str, home: str) -> None:
    """Take the turns for what has landed since the last call, and stop; releases are folders ``release=<name>``."""
    stream = spark.readStream.schema(SHAPE).parquet(landing)
    with settings(spark):
        run = stream.writeStream.foreachBatch(lambda batch, number: turn(batch, number, home)).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()


def differences(spark: SparkSession, home: str) -> DataFrame:
    """(opis_id, price_milli, change, release, turn) of all turns."""
    return spark.read.schema(DIFF).parquet(f"{home}/diff")
