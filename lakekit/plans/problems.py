"""Queries over the test tables for the general record-processing problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import read
from ..operators.compaction import bin_report, plan_bins, small_files
from ..operators.history import full_history
from ..operators.live_files import live_files
from ..operators.merkle import due_changes
from ..operators.replay import current_records


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return due_changes(read(spark, d, "cdf_people"), read(spark, d, "cdf_runs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_current_records(spark, d).select("table_path", "id", "_commit_version")


def p4_current_records(spark: SparkSession, d: str) -> DataFrame:
    return current_records(read(spark, d, "cdf_people"))


def _history(spark: SparkSession, d: str) -> DataFrame:
    return full_history(read(spark, d, "scd_ts"), read(spark, d, "scd_updates"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    secs = lambda c: F.unix_seconds(c).cast("long")
    return _history(spark, d).select("pkey", secs("effective_time").alias("effective_s"), F.coalesce(secs("end_time"), F.lit(-1).cast("long")).alias("end_s"))


def p5_history(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return small_files(live_files(read(spark, d, "file_actions"))).select("table_path", "path")


def p6_plan(spark: SparkSession, d: str) -> DataFrame:
    return bin_report(plan_bins(small_files(live_files(read(spark, d, "file_actions")))))


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p4_current_records, p5_found, p5_history, p6_found, p6_plan)}

_LIVE = """
WITH act AS (SELECT DISTINCT path, version, lower(action) AS action, table_path, size,
    coalesce(array_to_string(list_transform(list_sort(map_keys(partitionValues)),
      lambda k: k || '=' || coalesce(partitionValues[k], 'null')), '/'), '') AS part FROM file_actions),
live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY version DESC, action DESC, size DESC NULLS LAST) rn FROM act)
    WHERE rn = 1 AND action = 'add'),
small AS (SELECT *, count(*) OVER (PARTITION BY table_path, part) n FROM live WHERE size >= 0 AND size < 16777216)
"""
_ST = """
WITH st AS (
  SELECT pkey, effective_time AS t, 1 AS rank, 0 AS no, attr FROM scd_ts
  UNION ALL SELECT pkey, end_time, 0, 0, NULL FROM scd_ts WHERE end_time IS NOT NULL
  UNION ALL SELECT pkey, effective_time, 2, update_no, attr FROM scd_updates),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pkey, t ORDER BY rank DESC, no DESC, attr DESC NULLS LAST) rn
      FROM st WHERE pkey IS NOT NULL AND t IS NOT NULL) WHERE rn = 1),
f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR (rank > 0) <> lag(rank > 0) OVER w OR attr IS DISTINCT FROM lag(attr) OVER w
      THEN 1 ELSE 0 END AS c FROM b WINDOW w AS (PARTITION BY pkey ORDER BY t)),
v AS (SELECT *, lead(t) OVER (PARTITION BY pkey ORDER BY t) AS e FROM f WHERE c = 1)
"""
_CUR = """
SELECT table_path, id, {cols}_commit_version FROM (
  SELECT *, row_number() OVER (PARTITION BY table_path, id ORDER BY _commit_version DESC) rn FROM (
    SELECT DISTINCT table_path, id, gender, age, _commit_version, lower(trim(_change_type)) k FROM cdf_people
    WHERE id IS NOT NULL AND table_path IS NOT NULL AND _commit_version IS NOT NULL
      AND lower(trim(_change_type)) IN ('insert', 'update_postimage', 'delete')))
WHERE rn = 1 AND k <> 'delete'
"""
SQL = {
    "p2_found": """
SELECT table_path, id, _commit_version FROM cdf_people c
WHERE id IS NOT NULL AND table_path IS NOT NULL AND _commit_version IS NOT NULL
GROUP BY ALL
HAVING NOT bool_or(EXISTS (SELECT 1 FROM cdf_runs r WHERE r.table_path = c.table_path AND lower(trim(r.status)) = 'succeeded'
  AND c._commit_version BETWEEN r.startingVersion AND r.endingVersion AND c.landed_at <= r.started_at))""",
    "p4_found": _CUR.format(cols=""),
    "p4_current_records": _CUR.format(cols="gender, age, "),
    "p5_found": _ST + "SELECT pkey, epoch(t)::BIGINT AS effective_s, coalesce(epoch(e)::BIGINT, -1) AS end_s FROM v WHERE rank > 0",
    "p5_history": _ST + "SELECT pkey, attr, t AS effective_time, e AS end_time, e IS NULL AS is_current FROM v WHERE rank > 0",
    "p6_found": _LIVE + "SELECT table_path, path FROM small WHERE n >= 2",
}
