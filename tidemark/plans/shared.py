"""Where intermediate tables go, how a lineage is cut, and joins on values that many rows share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if the session names one, else, on one machine (tests), a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def park(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives the loss of executors.

    Written with zstd, as compressed columns take a fraction of a checkpoint's room. The table goes when the
    application ends, or with ``unpark``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._parked = path
    return out


def unpark(df: DataFrame) -> None:
    """Delete a parked table that nothing will read again."""
    fs, p = _file_system(df.sparkSession, df._parked)
    fs.delete(p, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def join_by_value(rows: DataFrame, table: DataFrame, on: list[str], counts: DataFrame, spread: Column, how: str = "inner", most: int = 1 << 17) -> DataFrame:
    """``rows`` joined with ``table`` on values, of which ``counts`` (``on``, ``n``) tells how many rows have each.

    A value of more than ``most`` rows is cut into parts by the hash of ``spread``, and its rows of ``table`` are repeated for
    each, so that no task gets all rows of a value. Values are told apart by their hash, so that what is joined first is small.
    """
    part = lambda k: F.pmod(F.xxhash64(spread), F.coalesce(k, F.lit(1)))
    hot = park(counts.where(F.col("n") > most).groupBy(F.xxhash64(*on).alias("__hash")).agg(F.ceil(F.max("n") / most).cast("bigint").alias("__k")), "hot-values")
    if hot.isEmpty():
        return rows.join(table, on, how)
    left = rows.withColumn("__hash", F.xxhash64(*on)).join(hot, "__hash", "left").withColumn("__part", part(F.col("__k"))).drop("__hash", "__k")
    right = table.withColumn("__hash", F.xxhash64(*on)).join(hot, "__hash", "left")
    right = right.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("__k", F.lit(1)) - 1))).drop("__hash", "__k")
    return left.join(right, [*on, "__part"], how).drop("__part")


def partitions(spark: SparkSession) -> int:
    """Parts for an explicit repartition: as many as a shuffle has, but no fewer than there are cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
