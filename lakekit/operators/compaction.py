"""Planning the consolidation of small files, per table and partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import materialize, salted_join

SMALL = 16 * 1024 * 1024
TARGET = 128 * 1024 * 1024


def small_files(live: DataFrame, below: int = SMALL, at_least: int = 2) -> DataFrame:
    """Live files of known size below ``below`` in partitions that have ``at_least`` such files. Counting
    is combined on the map side; files are joined back to the counts in salted tasks, so a partition with
    most of all files is not one task."""
    small = materialize(live.filter(F.col("size").isNotNull() & (F.col("size") < below)), "small-files")  # read twice below
    crowded = small.groupBy("table_path", "part").agg(F.count("*").alias("n")).filter(F.col("n") >= at_least).drop("n")
    return salted_join(small, crowded, ["table_path", "part"], ["path"], "inner")


def plan_bins(files: DataFrame, target: int = TARGET, spread: int = 64, max_files: int = 20_000) -> DataFrame:
    """Assign each file to a ``bin`` (rewritten into one file) of about ``target`` bytes.

    A partition's files are dealt to ``ceil(files / max_files)`` (at most ``spread``) lanes by a hash of
    their path, and bins fill along each lane in order of size: bounded tasks whatever the skew, and at
    most one underfilled bin per lane. A bin is named ``lane-number``.
    """
    sizes = files.groupBy("table_path", "part").agg(F.least(F.ceil(F.count("*") / max_files), F.lit(spread)).cast("int").alias("lanes"))
    laned = salted_join(files, sizes, ["table_path", "part"], ["path"]).withColumn("lane", F.pmod(F.xxhash64("path"), F.col("lanes")).cast("int"))
    along = Window.partitionBy("table_path", "part", "lane").orderBy("size", "path").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum("size").over(along), F.lit(0))
    return laned.withColumn("bin", F.concat_ws("-", F.col("lane"), F.floor(filled / target).cast("long"))).drop("lanes", "lane")


def bin_report(bins: DataFrame) -> DataFrame:
    """Per table and partition: files and average size before and after the rewrite, bytes and known
    records, which the rewrite keeps. Counted in two steps: per bin, then per partition."""
    per_bin = bins.groupBy("table_path", "part", "bin").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.sum("numRecords").alias("r"))
    out = per_bin.groupBy("table_path", "part").agg(F.sum("n").alias("files_before"), F.count("*").alias("files_after"), F.sum("b").alias("size_in_bytes"), F.sum("r").alias("num_records"))
    return out.withColumns({"average_before": F.expr("size_in_bytes div files_before"), "average_after": F.expr("size_in_bytes div files_after")})
