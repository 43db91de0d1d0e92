"""Sinks and scans of edition tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.shared import park, unpark


def write_editions(items: DataFrame, path: str) -> None:
    """Partition by edition; only the editions written are replaced."""
    items.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("edition_id").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def insert_editions(items: DataFrame, path: str) -> int:
    """Add editions that are not there yet; those that are stay as they are. Returns the number of rows added; the rows are made once."""
    spark = items.sparkSession
    if _exists(spark, path):
        there = spark.read.parquet(path).select(F.col("edition_id").cast("string")).distinct()
        items = items.join(there, "edition_id", "left_anti")
    new = park(items, "editions")
    n = new.count()
    if n:
        new.write.mode("append").partitionBy("edition_id").parquet(path)
    unpark(new)
    return n


def read_editions(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Editions of a range of days, by partition pruning."""
    df = spark.read.option("basePath", path).parquet(path).withColumn("edition_id", F.col("edition_id").cast("string"))
    if start:
        df = df.where(F.col("edition_id") >= start)
    if end:
        df = df.where(F.col("edition_id") <= end)
    return df


def read_edition_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per edition file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def upsert(rows: DataFrame, path: str, key: list[str]) -> None:
    """Replace the rows of a keyed table that come again.

    The table is a folder of versions, of which the one with the highest number holds: a new version is written whole under a
    name of its own and then renamed, so that a write that fails leaves the table as it was. The version before is kept.
    """
    spark = rows.sparkSession
    now = current(spark, path)
    merged = rows if now is None else spark.read.parquet(now).join(rows.select(*key), key, "left_anti").unionByName(rows, allowMissingColumns=True)
    n = 0 if now is None else int(now.rsplit("=", 1)[1]) + 1
    merged.write.mode("overwrite").parquet(f"{path}/_writing")
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.rename(path_of(f"{path}/_writing"), path_of(f"{path}/version={n}")):
        raise RuntimeError(f"version {n} of {path} could not be put in place")
    if n > 1:
        fs.delete(path_of(f"{path}/version={n - 2}"), True)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that holds, None if there is no table yet."""
    if not _exists(spark, path):
        return None
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    versions = [int(x.removeprefix("version=")) for x in names if x.startswith("version=")]
    return f"{path}/version={max(versions)}" if versions else None


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current(spark, path))
