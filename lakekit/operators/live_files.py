"""The live files of a log of file actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partition_text(values: Column) -> Column:
    """``key=value`` joined by ``/`` with keys in alphabetical order; null values written ``null``; the
    empty (or null) map is the empty string. Spellings that differ in case stay different."""
    entries = F.array_sort(F.map_entries(values))
    return F.coalesce(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), "/"), F.lit(""))


def live_files(actions: DataFrame) -> DataFrame:
    """(table_path, part, path, size, numRecords) of files whose action of the highest version is an add.

    Repeated rows count once; if one version of a path both adds and removes it, it is removed. Missing
    (null) and unknown (negative) sizes and counts come out as null. Rows without path or version don't
    count. One shuffle by path, combined on the map side, so copies of one row cost nothing.
    """
    known = lambda c: F.when(F.col(c) >= 0, F.col(c))
    newest = actions.dropna(subset=["path", "version"]).select(
        "path",
        F.struct("version", (F.lower("action") == "remove").alias("gone"), F.coalesce("table_path", F.lit("")).alias("table_path"), partition_text(F.col("partitionValues")).alias("part"), known("size").alias("size"), known("numRecords").alias("numRecords")).alias("a"),
    )
    best = newest.groupBy("path").agg(F.max("a").alias("a")).filter(~F.col("a.gone"))
    return best.select("a.table_path", "a.part", "path", "a.size", "a.numRecords")
