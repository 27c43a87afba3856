"""Distributions of file sizes and record counts, from the log alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import NUM_RECORDS_COLUMNS, PERCENTAGES, SIZE_COLUMNS

ACCURACY = 2**31 - 1  # the greatest that percentile_approx takes


def distribution(files: DataFrame, value: str, names: list[str]) -> DataFrame:
    """Per partition: number of values, mean, sample deviation (null for one value), minimum, maximum and
    percentiles. Aggregated on the map side; nulls don't count."""
    c = F.col(value)
    # the sketch keeps as many values as it may: exact for any partition with fewer files than that
    out = files.groupBy(F.map_entries("partitionValues").alias("p")).agg(F.count(c), F.mean(c), F.stddev(c), F.min(c), F.max(c), F.percentile_approx(c, PERCENTAGES, ACCURACY))
    return out.toDF(*names)


def size_distribution(files: DataFrame) -> DataFrame:
    return distribution(files, "size", SIZE_COLUMNS)


def size_distribution_mb(files: DataFrame) -> DataFrame:
    return distribution(files.withColumn("size", F.col("size") / (1024 * 1024)), "size", SIZE_COLUMNS)


def record_distribution(files: DataFrame) -> DataFrame:
    return distribution(files, "stats.numRecords", NUM_RECORDS_COLUMNS)


def file_sizes(files: DataFrame) -> DataFrame:
    """One row: size_in_bytes, number_of_files, average_file_size_in_bytes (floored, 0 without files)."""
    sums = files.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("s"), F.count("*").alias("n"))
    average = F.when(F.col("n") == 0, 0).otherwise(F.expr("s div n"))
    return sums.select(F.col("s").cast("double").alias("size_in_bytes"), F.col("n").cast("double").alias("number_of_files"), average.cast("double").alias("average_file_size_in_bytes"))


def in_partitions(files: DataFrame, partition_columns: list[str], schema: T.StructType, condition: str | None) -> DataFrame:
    """Files whose partition fits a condition on partition columns, evaluated on typed values."""
    if not condition:
        return files
    # the condition sees the partition's columns only, whatever the columns of files are called
    typed = [F.col("__f.partitionValues")[p].cast(schema[p].dataType).alias(p) for p in partition_columns]
    held = files.select(F.struct(*files.columns).alias("__f"))
    return held.select("__f", *typed).filter(condition).select("__f.*")
