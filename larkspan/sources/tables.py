"""A station table on disk that upserts and purges rewrite only where rows change.

Rows lie in folders by a residue of their id.  A change is planned against one snapshot and written aside; then only the
folders that hold created, updated or deleted rows are overwritten (dynamic partition overwrite), the files of the rest
stay.  The plan is keyed by id, so a job that broke off half-way is repaired by running it again: what was written already
counts as unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning
from .files import written

#: Folders of a table; more make smaller rewrites.
FOLDERS = 16


def _placed(rows: DataFrame, folders: int) -> DataFrame:
    return rows.withColumn("folder", F.pmod(F.col("opis_id").cast("long"), F.lit(folders)).cast("int"))


def create(rows: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """Write ``rows`` (keyed by opis_id) as a new table."""
    _placed(rows, folders).repartition("folder").write.partitionBy("folder").parquet(path)


def read(spark: SparkSession, path: str, shape: str) -> DataFrame:
    return spark.read.schema(f"{shape}, folder int").parquet(path)


def file_times(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """(file, modified, folder) of the table's files."""
    return read(spark, path, shape).select("_metadata.file_path", "_metadata.file_modification_time", "folder").distinct().toDF("file", "modified", "folder")


def _rewrite(spark: SparkSession, path: str, after: DataFrame, touched: DataFrame) -> None:
    """Overwrite the folders named by ``touched`` with their rows of ``after``; a folder that has none left goes."""
    names = [r["folder"] for r in touched.select("folder").distinct().collect()]  # at most as many as there are folders
    if not names:
        return
    rows = written(after.where(F.col("folder").isin(names)), "table-rows")
    rows.repartition("folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(path)
    left = {r["folder"] for r in rows.select("folder").distinct().collect()}
    for name in set(names) - left:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/folder={name}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def upsert(spark: SparkSession, path: str, shape: str, files: DataFrame, value: str, folders: int = FOLDERS) -> DataFrame:
    """Apply ``files`` (opis_id, file_no, line_no, value; the later file wins) and return (opis_id, change, folder).

    The answer is the plan as written aside before, so it tells what this run changed.
    """
    plan = cleaning.upsert_plan(read(spark, path, shape).drop("folder"), files, value)
    plan = written(_placed(plan, folders), "upsert-plan")
    _rewrite(spark, path, plan.drop("change"), plan.where("change IN ('created', 'updated')"))
    return plan.select("opis_id", "change", "folder")


def purge(spark: SparkSession, path: str, shape: str, source: str, dry_run: bool = True) -> DataFrame:
    """One row (before, deleted, after): rows of a source are deleted, unless it is a dry run."""
    rows = written(read(spark, path, shape), "purge-snapshot")
    gone = F.coalesce(F.col("price_source") == source, F.lit(False))
    if not dry_run:
        _rewrite(spark, path, rows.where(~gone), rows.where(gone))
    return rows.agg(F.count(F.lit(1)).alias("before"), F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("after"))
