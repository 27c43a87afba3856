"""Version ranges and change-feed status from the log's actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CHANGE_FEED_PROPERTY


def version_ranges(versions: DataFrame, column: str = "version", group: list[str] | None = None) -> DataFrame:
    """(group, first, last) of consecutive versions; a lone version is a range of one. One row per commit
    is what a window holds here, not one per record."""
    keys = [F.col(g) for g in group or []]
    w = Window.partitionBy(*keys).orderBy(column) if keys else Window.partitionBy(F.lit(0)).orderBy(column)
    island = versions.select(*keys, F.col(column).alias("v")).distinct().withColumnRenamed("v", column).withColumn("__g", F.col(column) - F.row_number().over(w))
    return island.groupBy(*keys, "__g").agg(F.min(column).alias("first"), F.max(column).alias("last")).drop("__g")


def change_feed_status(actions: DataFrame) -> DataFrame:
    """(version, enabled): the property as the last metadata at or before the version has it, which also
    covers appends and merges without effect."""
    flag = F.when(F.col("metaData").isNotNull(), F.coalesce(F.col("metaData.configuration")[CHANGE_FEED_PROPERTY], F.lit("false")) == "true")
    cdc = F.max(F.col("cdc").isNotNull())
    per = actions.groupBy("version").agg(F.max(flag).alias("flag"), cdc.alias("cdc"))
    seen = F.last(F.coalesce("flag", F.when(F.col("cdc"), F.lit(True))), ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("version"))
    return per.select("version", F.coalesce(seen, F.lit(False)).alias("enabled"))
