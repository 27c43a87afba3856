"""Queries of the training-data operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..common import read
from ..operators.live_files import live_files
from . import leaks, mixture, multiselect, name_index, sentences


def _percentiles(spark: SparkSession, d: str) -> DataFrame:
    return multiselect.file_percentiles(live_files(read(spark, d, "file_actions")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return multiselect.skewed_groups(_percentiles(spark, d))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _percentiles(spark, d)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return name_index.dedup_batches(read(spark, d, "people"), read(spark, d, "people_batches"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_sources(read(spark, d, "documents"), read(spark, d, "source_weights")).documents


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_sources(read(spark, d, "documents"), read(spark, d, "source_weights")).shares


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.found_sentences(read(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_percentiles, p7_found, p8_mix, p8_shares, p9_found)}

_P3 = """
WITH act AS (SELECT DISTINCT path, version, lower(action) AS action, table_path, size, numRecords,
    coalesce(array_to_string(list_transform(list_sort(map_keys(partitionValues)),
      lambda k: k || '=' || coalesce(partitionValues[k], 'null')), '/'), '') AS part FROM file_actions),
live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY version DESC, action DESC, size DESC NULLS LAST, numRecords DESC NULLS LAST) rn FROM act)
    WHERE rn = 1 AND action = 'add'),
v AS (SELECT table_path, part, 'size' AS metric, size AS value FROM live WHERE size >= 0
      UNION ALL SELECT table_path, part, 'numRecords', numRecords FROM live WHERE numRecords >= 0),
r AS (SELECT *, row_number() OVER (PARTITION BY table_path, part, metric ORDER BY value) AS rk,
      count(*) OVER (PARTITION BY table_path, part, metric) AS n FROM v),
p AS (SELECT table_path, part, metric, n, {cols} FROM r GROUP BY ALL)
""".format(cols=", ".join(f"max(CASE WHEN rk = (n * {p} + 99) // 100 THEN value END) AS p{p}" for p in multiselect.PERCENTS))
SQL = {
    "p3_found": _P3 + "SELECT table_path, part, metric FROM p WHERE n >= 20 AND p95 >= 10 * p50",
    "p3_percentiles": _P3 + "SELECT * FROM p",
}
