"""Session helpers shared by all operators: work folders, skew-safe joins, order-preserving slices."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share. A cluster names it in ``spark.checkpoint.dir``; only where
    that is unset and all tasks run on this machine (tests) is a temporary folder made and set; it goes when
    Python ends."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lakekit-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt_on: list[Column | str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join whose hot keys are split: rows of ``big`` spread over ``salts`` tasks by a hash of
    ``salt_on``, rows of ``small`` are repeated once per salt. ``small`` must be unique per key (or far
    smaller than ``big``). ``how``: inner, left, left_semi, left_anti. Null keys never match."""
    b = big.withColumn("__salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int"))
    s = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    extra = [] if how in ("left_semi", "left_anti") else [c for c in small.columns if c not in keys]
    return b.join(s, [*keys, "__salt"], how).select(*[F.col(f"`{c}`") for c in (*big.columns, *extra)])


def hot_slices(df: DataFrame, keys: list[str], order: str, max_rows: int = 200_000, slices: int = 64, name: str = "__slice") -> DataFrame:
    """Add an int column that is 0 for ordinary keys and, for keys of more than ``max_rows`` rows, the
    number of that key's quantile bounds at or below ``order``: slices follow one another in order, equal
    values of ``order`` share a slice, and no task needs all rows of a hot key. There are at most
    rows/``max_rows`` hot keys; their bounds are joined by key, broadcast only if Spark finds them small."""
    hot = df.groupBy(*keys).count().filter(F.col("count") > max_rows).drop("count")
    is_time = isinstance(df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    num = F.unix_micros(F.col(order).cast("timestamp")) if is_time else F.col(order)
    bounds = df.join(hot, keys, "left_semi").groupBy(*keys).agg(F.percentile_approx(num, [i / slices for i in range(1, slices)], 5_000).alias("__bounds"))
    with_bounds = df.join(bounds, keys, "left")
    sliced = F.when(F.col("__bounds").isNull(), 0).otherwise(F.size(F.filter("__bounds", lambda b: b <= num)))
    return with_bounds.withColumn(name, sliced.cast("int")).drop("__bounds")
