"""Queries over the test tables for the table operations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..common import read, shared_dir
from ..constants import CHANGE_FEED_PROPERTY
from ..functions.humanize import humanize_bytes_column
from ..operators import append, dedupe, file_stats, hashing, keys, scd2, versions
from ..sources.change_feed import ChangeFeed, read_changes
from ..storage.table import LakeTable


def _fresh(spark: SparkSession, df: DataFrame, **kw) -> LakeTable:
    return LakeTable.write(df, shared_dir(spark, "table"), **kw)


# ---------------------------------------------------------------- duplicates, keys, hashes


def kill_duplicates(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return dedupe.kill_duplicates(df, ["l_orderkey", "l_partkey"])


def kill_duplicates_null_keys(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "events").select("event_id", "user_id", F.expr("nullif(event_type, 'error')").alias("k"))
    return dedupe.kill_duplicates(df, ["user_id", "k"])


def kill_duplicates_table(spark: SparkSession, d: str) -> DataFrame:
    t = _fresh(spark, read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    api.kill_duplicate_records(t, ["l_orderkey", "l_partkey"])
    return t.to_df()


def remove_duplicates_pk(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.remove_duplicates_by(read(spark, d, "orders"), "o_orderkey", ["o_custkey", "o_orderdate"])


def remove_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.drop_duplicates(read(spark, d, "events").select("user_id", "event_type"), ["user_id", "event_type"])


def is_composite_key(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(keys.is_composite_key(read(spark, d, "lineitem"), ["l_orderkey", "l_partkey"]),)], "is_key boolean")


def find_composite_key(spark: SparkSession, d: str) -> DataFrame:
    found = keys.find_composite_key(read(spark, d, "orders"))
    some = keys.find_composite_key(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"))
    return spark.createDataFrame([("orders", ",".join(found)), ("lineitem", ",".join(some))], "of string, columns string")


def composite_key_counts(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    return keys.key_counts(df, 2)


def md5_columns(spark: SparkSession, d: str) -> DataFrame:
    return hashing.with_md5(read(spark, d, "customer"), ["c_name", "c_mktsegment"], "unique_id").select("c_custkey", "unique_id")


def humanize_bytes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey") * F.col("p_partkey") * 1009
    return read(spark, d, "part").select("p_partkey", humanize_bytes_column(n.cast("double")).alias("size"))


# ---------------------------------------------------------------- appending, copying


def append_without_duplicates(spark: SparkSession, d: str) -> DataFrame:
    names = ["firstname", "lastname"]
    return append.append_without_duplicates(read(spark, d, "people").select(*names), read(spark, d, "people_batches").select(*names), names)


def append_without_duplicates_table(spark: SparkSession, d: str) -> DataFrame:
    names = ["firstname", "lastname"]
    t = _fresh(spark, read(spark, d, "people").select(*names))
    api.append_without_duplicates(t, read(spark, d, "people_batches").select(*names), names)
    return t.to_df()


def validate_append(spark: SparkSession, d: str) -> DataFrame:
    t = _fresh(spark, read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    new = read(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.lit("gold").alias("tier"))
    api.validate_append(t, new, ["c_custkey", "c_name"], ["tier"])
    return t.to_df()


def copy_table(spark: SparkSession, d: str) -> DataFrame:
    return api.copy_table(_fresh(spark, read(spark, d, "supplier"), partition_by=["s_nationkey"]), path=shared_dir(spark, "copy")).to_df()


# ---------------------------------------------------------------- type-2 history


def _scd_tables(spark: SparkSession, d: str, clock=lambda c: c, null: bool = False, current: bool = True) -> tuple[DataFrame, DataFrame]:
    """The type-2 table and the last update of every key, with another clock for the validity columns."""
    base = read(spark, d, "scd_ts").select("pkey", "attr", (F.col("is_current") if current else F.lit(False)).alias("is_current"), clock(F.col("effective_time")).alias("effective_time"), clock(F.col("end_time")).alias("end_time"))
    last = read(spark, d, "scd_updates").groupBy("pkey").agg(F.max(F.struct("update_no", "attr", "effective_time")).alias("u"))
    return base, last.select("pkey", (F.lit(None).cast("string") if null else F.col("u.attr")).alias("attr"), clock(F.col("u.effective_time")).alias("effective_time"))


def _scd(spark: SparkSession, d: str, **kw) -> DataFrame:
    base, ups = _scd_tables(spark, d, **kw)
    return scd2.scd2_upsert(base, ups, "pkey", ["attr"])


def scd2_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _scd(spark, d)


def scd2_null_change(spark: SparkSession, d: str) -> DataFrame:
    return _scd(spark, d, null=True)


def scd2_historical_only(spark: SparkSession, d: str) -> DataFrame:
    return _scd(spark, d, current=False)


def scd2_date(spark: SparkSession, d: str) -> DataFrame:
    return _scd(spark, d, clock=lambda c: c.cast("date"))


def scd2_version(spark: SparkSession, d: str) -> DataFrame:
    return _scd(spark, d, clock=lambda c: F.unix_date(c.cast("date")))


def scd2_table(spark: SparkSession, d: str) -> DataFrame:
    base, ups = _scd_tables(spark, d)
    t = _fresh(spark, base)
    api.scd2_upsert(t, ups, "pkey", ["attr"])
    return t.to_df()


# ---------------------------------------------------------------- layout


def _one_file_per(df: DataFrame, number: str) -> DataFrame:
    """Rows of each number in a task of their own."""
    n = df.agg(F.max(F.expr(number))).first()[0] or 0
    return df.repartitionById(n + 1, F.expr(number).cast("int"))


def _by_status(spark: SparkSession, d: str) -> LakeTable:
    return _fresh(spark, _one_file_per(read(spark, d, "orders"), "o_orderkey div 5000"), partition_by=["o_orderstatus"])


def num_record_distribution(spark: SparkSession, d: str) -> DataFrame:
    df = api.num_record_distribution(_by_status(spark, d).path)
    p = F.col("`Percentile[10th, 25th, Median, 75th, 90th, 95th]`")
    return df.select(F.col("partitionValues")[0]["value"].alias("part"), "num_of_parquet_files", F.round("mean_num_records_in_files", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "min_num_records", "max_num_records", *[p[i].alias(f"p{i}") for i in range(6)])


def num_record_distribution_where(spark: SparkSession, d: str) -> DataFrame:
    return api.num_record_distribution(_by_status(spark, d).path, "o_orderstatus <> 'F'").select(F.col("partitionValues")[0]["value"].alias("part"), "num_of_parquet_files", "max_num_records")


def _logged(spark: SparkSession, d: str) -> DataFrame:
    """Files as a log has them."""
    return read(spark, d, "file_actions").filter("action = 'add' AND size >= 0").select("partitionValues", "size")


def file_size_distribution(spark: SparkSession, d: str) -> DataFrame:
    df = file_stats.size_distribution(_logged(spark, d))
    p = F.col("`Percentile[10th, 25th, Median, 75th, 90th, 95th]`")
    part = F.array_join(F.transform("partitionValues", lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), "/")
    return df.select(part.alias("part"), "num_of_parquet_files", F.round("mean_size_of_files", 2).alias("mean"), F.round("stddev", 2).alias("stddev"), "min_file_size", "max_file_size", *[p[i].alias(f"p{i}") for i in range(6)])


def file_size_distribution_mb(spark: SparkSession, d: str) -> DataFrame:
    df = file_stats.size_distribution_mb(_logged(spark, d))
    part = F.array_join(F.transform("partitionValues", lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), "/")
    return df.select(part.alias("part"), "num_of_parquet_files", F.round("mean_size_of_files", 4).alias("mean"), F.round("min_file_size", 4).alias("min"), F.round("max_file_size", 4).alias("max"))


def file_sizes(spark: SparkSession, d: str) -> DataFrame:
    return file_stats.file_sizes(_logged(spark, d))


def shuffle_files(spark: SparkSession, d: str) -> DataFrame:
    t = _fresh(spark, _one_file_per(read(spark, d, "orders"), "o_orderkey div 2000"))
    n = list(api.num_shuffle_files(t.path, "o_orderkey >= 3000 and o_orderkey <= 9000 and o_custkey = 7 and o_orderstatus like '%x%' and src.k = o_orderkey").values())
    return spark.createDataFrame([(*n[:6], ",".join(n[6]))], "overall long, min_max long, equal long, left_over long, unresolved long, total long, unresolved_columns string")


def shuffle_file_metadata(spark: SparkSession, d: str) -> DataFrame:
    t = _fresh(spark, _one_file_per(read(spark, d, "orders"), "o_orderkey div 2000"))
    files, every, _ = api.shuffle_file_metadata(t.path, "o_orderkey < 5000")
    return files["min_max"].select(F.col("stats.numRecords").alias("rows"), F.lit("needed").alias("kind")).unionByName(every.select(F.col("stats.numRecords").alias("rows"), F.lit("all").alias("kind")))


def detail(spark: SparkSession, d: str) -> DataFrame:
    return _by_status(spark, d).detail().select("numFiles", F.element_at("partitionColumns", 1).alias("part"))


def compaction(spark: SparkSession, d: str) -> DataFrame:
    t = _fresh(spark, read(spark, d, "orders").repartition(4).select("o_orderkey", "o_custkey", "o_orderstatus"), partition_by=["o_orderstatus"])
    t.compact()
    return t.to_df()


def compaction_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of each partition after a compaction whose target holds them all."""
    t = _fresh(spark, read(spark, d, "orders").repartition(8).select("o_orderkey", "o_custkey", "o_orderstatus"), partition_by=["o_orderstatus"])
    t.compact()
    return t.files().select(F.col("partitionValues")["o_orderstatus"].alias("part"), F.col("stats.numRecords").alias("rows"))


# ---------------------------------------------------------------- versions, change feed, metrics


def version_ranges(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "cdf_people").select("table_path", F.col("_commit_version").alias("version"))
    return versions.version_ranges(v, "version", ["table_path"])


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    t = _feed(spark, d)
    return spark.createDataFrame([(api.latest_version(t.path),)], "version long")


def _feed(spark: SparkSession, d: str) -> LakeTable:
    t = _fresh(spark, read(spark, d, "events").select("event_id", "user_id", "event_type", "value"), properties={CHANGE_FEED_PROPERTY: "true"})
    t.update({"value": "value + 1"}, "event_type = 'error'")
    return t


def cdf_read(spark: SparkSession, d: str) -> DataFrame:
    return read_changes(spark, _feed(spark, d).path, 0, 1).select("event_id", "_change_type", "_commit_version")


def cdf_read_ranges(spark: SparkSession, d: str) -> DataFrame:
    t = _feed(spark, d)
    t.set_properties({CHANGE_FEED_PROPERTY: "false"})
    t.delete("event_type = 'click'")
    t.set_properties({CHANGE_FEED_PROPERTY: "true"})
    t.delete("event_type = 'error'")
    return ChangeFeed(t.path, 0, 5).read_enabled_ranges().select("event_id", "_change_type", "_commit_version")


def cdf_available(spark: SparkSession, d: str) -> DataFrame:
    """What each probe of a change feed finds in a range of three commits, and after it was switched off."""
    t = _feed(spark, d)
    t.delete("event_type = 'click'")
    f = ChangeFeed(t.path, 0, 2)
    found = {"earliest_commits": f.earliest_commit_versions(), "available_log": f.available_log_versions(), "available_changes": f.available_change_versions(), "dry_run": (f.dry_run().start, f.end)}
    t.set_properties({CHANGE_FEED_PROPERTY: "false"})
    t.delete("event_type = 'error'")
    g = ChangeFeed(t.path, 0, 4)
    found |= {"enabled": g.enabled_ranges()[0], "disabled": g.disabled_ranges()[0]}
    return spark.createDataFrame([(k, *v) for k, v in found.items()], "what string, first long, last long")


def cdf_read_available(spark: SparkSession, d: str) -> DataFrame:
    t = _feed(spark, d)
    t.delete("event_type = 'click'")
    f = ChangeFeed(t.path, 0, 2)
    tag = lambda df, k: df.select(F.lit(k).alias("of"), "event_id", "_change_type", "_commit_version")
    return tag(f.read_available_log(), "log").unionByName(tag(f.read_available_changes(), "changes"))


def op_metrics_all(spark: SparkSession, d: str) -> DataFrame:
    """A write, a delete, a merge with updates and inserts, and an append."""
    events = read(spark, d, "events").select("event_id", "event_type", "value")
    t = _fresh(spark, events, partition_by=["event_type"])
    t.delete("event_type = 'click'")
    src = events.filter("event_type IN ('click', 'error')").withColumn("value", F.lit(0.0))
    t.merge(src, "source.event_id = target.event_id").when_matched_update_all().when_not_matched_insert_all().execute()
    LakeTable.write(events.filter("event_type = 'error'"), t.path, mode="append")
    return api.OperationMetrics(t.path).as_df()


def written_rows(spark: SparkSession, d: str) -> DataFrame:
    t = _fresh(spark, read(spark, d, "events").select("event_id", "event_type", "value"), partition_by=["event_type"])
    return spark.createDataFrame([(api.OperationMetrics(t.path).written_rows("event_type = 'error'", 0),)], "rows long")


def merge_without_effect(spark: SparkSession, d: str) -> DataFrame:
    """It is a commit, but changes nothing."""
    t = _fresh(spark, read(spark, d, "nation").select("n_nationkey", "n_name"))
    t.merge(read(spark, d, "nation").select(F.col("n_nationkey") + 1000, "n_name").toDF("n_nationkey", "n_name"), "source.n_nationkey = target.n_nationkey").when_matched_update_all().execute()
    return t.to_df().withColumn("version", F.lit(t.version()).cast("long"))


def cdf_status(spark: SparkSession, d: str) -> DataFrame:
    t = _fresh(spark, read(spark, d, "nation"), properties={CHANGE_FEED_PROPERTY: "true"})
    t.set_properties({CHANGE_FEED_PROPERTY: "false"})
    t.delete("n_nationkey = 3")
    return spark.createDataFrame(ChangeFeed(t.path, 0, 2).status(), "version long, enabled boolean")


def op_metrics_df(spark: SparkSession, d: str) -> DataFrame:
    return api.OperationMetrics(_feed(spark, d).path).as_df()


def op_metrics_partition(spark: SparkSession, d: str) -> DataFrame:
    t = _fresh(spark, read(spark, d, "events").select("event_id", "event_type", "value"), partition_by=["event_type"])
    t.update({"value": "0"}, "event_type = 'error'")
    t.update({"value": "0"}, "event_type = 'click'")
    return api.OperationMetrics(t.path).as_df("event_type = 'error'")


def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    t = _fresh(spark, read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    src = read(spark, d, "part").select(F.col("p_partkey").alias("c_custkey"), F.col("p_name").alias("c_name"), F.lit("merged").alias("c_mktsegment"), "p_size")
    m = t.merge(src, "source.c_custkey = target.c_custkey").when_matched_delete("source.p_size > 40").when_matched_update_all()
    m.when_not_matched_insert_all("source.p_size > 5").execute()
    return t.to_df()


QUERIES = {
    f.__name__: f
    for f in (
        kill_duplicates, kill_duplicates_null_keys, kill_duplicates_table, remove_duplicates_pk, remove_duplicates, is_composite_key, find_composite_key, md5_columns, humanize_bytes,
        composite_key_counts, num_record_distribution_where, shuffle_file_metadata, compaction_files, cdf_available, cdf_read_available, op_metrics_all, written_rows, merge_without_effect,
        append_without_duplicates, append_without_duplicates_table, validate_append, copy_table, scd2_upsert, scd2_null_change, scd2_historical_only, scd2_date, scd2_version, scd2_table, num_record_distribution,
        file_size_distribution, file_size_distribution_mb, file_sizes, shuffle_files, detail, compaction, version_ranges, latest_version, cdf_read, cdf_read_ranges, cdf_status, op_metrics_df, op_metrics_partition, merge_upsert,
    )
}

_SCD = """
WITH base AS (SELECT pkey, attr, {cur} AS is_current, {e} AS effective_time, {n} AS end_time FROM scd_ts),
upd AS (SELECT DISTINCT pkey, {a} AS attr, {e} AS effective_time FROM scd_updates
  QUALIFY row_number() OVER (PARTITION BY pkey ORDER BY update_no DESC, attr DESC NULLS LAST, effective_time DESC) = 1)
SELECT b.pkey, b.attr, b.is_current AND NOT coalesce(u.attr <> b.attr, false) AS is_current, b.effective_time,
  CASE WHEN b.is_current AND coalesce(u.attr <> b.attr, false) THEN u.effective_time ELSE b.end_time END AS end_time
FROM base b LEFT JOIN upd u ON b.pkey = u.pkey
UNION ALL SELECT u.pkey, u.attr, true, u.effective_time, NULL FROM upd u JOIN base b ON b.pkey = u.pkey WHERE b.is_current AND u.attr <> b.attr
UNION ALL SELECT u.pkey, u.attr, true, u.effective_time, NULL FROM upd u WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.pkey = u.pkey)"""


def _scd_sql(clock: str = "{}", a: str = "attr", cur: str = "is_current") -> str:
    return _SCD.format(cur=cur, a=a, e=clock.format("effective_time"), n=clock.format("end_time"))


_APPEND = "SELECT firstname, lastname FROM people UNION ALL SELECT DISTINCT firstname, lastname FROM people_batches b WHERE NOT EXISTS (SELECT 1 FROM people p WHERE p.firstname = b.firstname AND p.lastname = b.lastname)"
_UNITS = " ".join(f"WHEN n >= 0.9 * {s} THEN printf('%.2f {u}', round(CAST(n AS DECIMAL(38,6)) / {s}, 2))" for u, s in (("PB", 10**15), ("TB", 10**12), ("GB", 10**9), ("MB", 10**6), ("kB", 10**3)))
_PAIRS = [("o_custkey", "o_orderdate"), ("o_custkey", "o_orderstatus"), ("o_custkey", "o_orderpriority"), ("o_orderdate", "o_orderstatus"), ("o_orderdate", "o_orderpriority"), ("o_orderstatus", "o_orderpriority")]

_LOGGED = "SELECT array_to_string(list_transform(map_keys(partitionValues), lambda k: k || '=' || coalesce(partitionValues[k], 'null')), '/') AS part, size AS v FROM file_actions WHERE action = 'add' AND size >= 0"
_DISTRIBUTION = "r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY v) AS rk, count(*) OVER (PARTITION BY part) AS n FROM f) SELECT part, {}, " + ", ".join(f"max(CASE WHEN rk = (n * {p} + 99) // 100 THEN v END) AS p{i}" for i, p in enumerate((10, 25, 50, 75, 90, 95))) + " FROM r GROUP BY part"

SQL = {
    "kill_duplicates": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_partkey) = 1",
    "kill_duplicates_null_keys": "SELECT event_id, user_id, k FROM (SELECT event_id, user_id, nullif(event_type, 'error') AS k FROM events) QUALIFY k IS NULL OR user_id IS NULL OR count(*) OVER (PARTITION BY user_id, k) = 1",
    "kill_duplicates_table": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_partkey) = 1",
    "remove_duplicates_pk": "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) = 1",
    "remove_duplicates": "SELECT DISTINCT user_id, event_type FROM events",
    "is_composite_key": "SELECT NOT EXISTS (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1) AS is_key",
    "find_composite_key": "SELECT 'orders' AS of, CASE WHEN (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders) THEN 'o_orderkey' ELSE '' END AS columns UNION ALL SELECT 'lineitem', CASE WHEN NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) THEN 'l_orderkey,l_linenumber' ELSE '' END",
    "composite_key_counts": " UNION ALL ".join(f"SELECT '{a},{b}' AS columns, (SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM orders)) AS n_distinct, (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderdate, o_orderstatus, o_orderpriority FROM orders)) AS n_rows_distinct" for a, b in _PAIRS),
    "md5_columns": "SELECT c_custkey, md5(concat_ws('||', c_name, c_mktsegment)) AS unique_id FROM customer",
    "humanize_bytes": f"SELECT p_partkey, CASE {_UNITS} ELSE printf('%.0f B', CAST(n AS DOUBLE)) END AS size FROM (SELECT p_partkey, p_partkey * p_partkey * 1009 AS n FROM part)",
    "append_without_duplicates": _APPEND,
    "append_without_duplicates_table": _APPEND,
    "validate_append": "SELECT c_custkey, c_name, c_mktsegment, CAST(NULL AS VARCHAR) AS tier FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'gold' FROM supplier",
    "copy_table": "SELECT * FROM supplier",
    "scd2_upsert": _scd_sql(),
    "scd2_null_change": _scd_sql(a="CAST(NULL AS VARCHAR)"),
    "scd2_historical_only": _scd_sql(cur="false"),
    "scd2_date": _scd_sql("CAST({} AS DATE)"),
    "scd2_version": _scd_sql("CAST(date_diff('day', DATE '1970-01-01', CAST({} AS DATE)) AS INTEGER)"),
    "scd2_table": _scd_sql(),
    "num_record_distribution": "WITH f AS (SELECT o_orderstatus AS part, o_orderkey // 5000 AS file, count(*) AS v FROM orders GROUP BY 1, 2), " + _DISTRIBUTION.format("count(*) AS num_of_parquet_files, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS stddev, min(v) AS min_num_records, max(v) AS max_num_records"),
    "num_record_distribution_where": "SELECT o_orderstatus AS part, count(*) AS num_of_parquet_files, max(v) AS max_num_records FROM (SELECT o_orderstatus, o_orderkey // 5000 AS file, count(*) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2) GROUP BY 1",
    "file_size_distribution": f"WITH f AS ({_LOGGED}), " + _DISTRIBUTION.format("count(*) AS num_of_parquet_files, round(avg(v), 2) AS mean, round(stddev_samp(v), 2) AS stddev, min(v) AS min_file_size, max(v) AS max_file_size"),
    "file_size_distribution_mb": f"SELECT part, count(*) AS num_of_parquet_files, round(avg(v / 1048576), 4) AS mean, round(min(v / 1048576), 4) AS min, round(max(v / 1048576), 4) AS max FROM ({_LOGGED}) GROUP BY 1",
    "file_sizes": f"SELECT sum(v)::DOUBLE AS size_in_bytes, count(*)::DOUBLE AS number_of_files, floor(sum(v) / count(*))::DOUBLE AS average_file_size_in_bytes FROM ({_LOGGED})",
    "shuffle_files": "WITH s AS (SELECT min(o_orderkey) AS mn, max(o_orderkey) AS mx, min(o_custkey) AS cn, max(o_custkey) AS cx FROM orders GROUP BY o_orderkey // 2000) SELECT count(*) FILTER (WHERE mx >= 3000 AND mn <= 9000 AND cn <= 7 AND cx >= 7) AS overall, count(*) FILTER (WHERE mx >= 3000 AND mn <= 9000) AS min_max, count(*) FILTER (WHERE cn <= 7 AND cx >= 7) AS equal, count(*) AS left_over, count(*) AS unresolved, count(*) AS total, 'src.k' AS unresolved_columns FROM s",
    "shuffle_file_metadata": "WITH s AS (SELECT min(o_orderkey) AS mn, count(*) AS n FROM orders GROUP BY o_orderkey // 2000) SELECT n AS rows, 'needed' AS kind FROM s WHERE mn < 5000 UNION ALL SELECT n, 'all' FROM s",
    "compaction_files": "SELECT o_orderstatus AS part, count(*) AS rows FROM orders GROUP BY 1",
    "cdf_available": "SELECT * FROM (VALUES ('earliest_commits', CAST(0 AS BIGINT), CAST(2 AS BIGINT)), ('available_log', 0, 2), ('available_changes', 1, 2), ('dry_run', 0, 2), ('enabled', 0, 2), ('disabled', 3, 4)) t(what, first, last)",
    "cdf_read_available": "WITH u AS (SELECT event_id, x._change_type, CAST(1 AS BIGINT) AS _commit_version FROM events, (VALUES ('update_preimage'), ('update_postimage')) x(_change_type) WHERE event_type = 'error' UNION ALL SELECT event_id, 'delete', 2 FROM events WHERE event_type = 'click') SELECT 'log' AS of, event_id, 'insert' AS _change_type, CAST(0 AS BIGINT) AS _commit_version FROM events UNION ALL SELECT 'log', * FROM u UNION ALL SELECT 'changes', * FROM u",
    "op_metrics_all": "WITH n AS (SELECT count(*) AS a, count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE event_type = 'error') AS e FROM events) SELECT CAST(3 AS BIGINT) AS version, CAST(0 AS BIGINT) AS deleted, e AS inserted, CAST(0 AS BIGINT) AS updated, e AS source_rows FROM n UNION ALL SELECT 2, 0, c, e, c + e FROM n UNION ALL SELECT 1, c, 0, 0, 0 FROM n UNION ALL SELECT 0, 0, a, 0, a FROM n",
    "written_rows": "SELECT count(*) AS rows FROM events WHERE event_type = 'error'",
    "merge_without_effect": "SELECT n_nationkey, n_name, CAST(1 AS BIGINT) AS version FROM nation",
    "detail": "SELECT count(DISTINCT o_orderstatus || (o_orderkey // 5000)) AS \"numFiles\", 'o_orderstatus' AS part FROM orders",
    "compaction": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "version_ranges": "SELECT table_path, min(v) AS first, max(v) AS last FROM (SELECT table_path, v, v - row_number() OVER (PARTITION BY table_path ORDER BY v) AS g FROM (SELECT DISTINCT table_path, _commit_version AS v FROM cdf_people)) GROUP BY table_path, g",
    "latest_version": "SELECT CAST(1 AS BIGINT) AS version",
    "cdf_read": "SELECT event_id, 'insert' AS _change_type, CAST(0 AS BIGINT) AS _commit_version FROM events UNION ALL SELECT event_id, 'update_preimage', 1 FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'update_postimage', 1 FROM events WHERE event_type = 'error'",
    "cdf_read_ranges": "SELECT event_id, 'insert' AS _change_type, CAST(0 AS BIGINT) AS _commit_version FROM events UNION ALL SELECT event_id, 'update_preimage', 1 FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'update_postimage', 1 FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'delete', 5 FROM events WHERE event_type = 'error'",
    "cdf_status": "SELECT * FROM (VALUES (CAST(0 AS BIGINT), true), (1, false), (2, false)) t(version, enabled)",
    "op_metrics_df": "SELECT CAST(1 AS BIGINT) AS version, CAST(0 AS BIGINT) AS deleted, CAST(0 AS BIGINT) AS inserted, count(*) AS updated, CAST(0 AS BIGINT) AS source_rows FROM events WHERE event_type = 'error' UNION ALL SELECT 0, 0, count(*), 0, count(*) FROM events",
    "op_metrics_partition": "SELECT CAST(1 AS BIGINT) AS version, CAST(0 AS BIGINT) AS deleted, CAST(0 AS BIGINT) AS inserted, count(*) AS updated, CAST(0 AS BIGINT) AS source_rows FROM events WHERE event_type = 'error' UNION ALL SELECT 0, 0, count(*), 0, count(*) FROM events WHERE event_type = 'error'",
    "merge_upsert": "SELECT c_custkey, coalesce(p_name, c_name) AS c_name, CASE WHEN p_partkey IS NULL THEN c_mktsegment ELSE 'merged' END AS c_mktsegment FROM customer LEFT JOIN part ON p_partkey = c_custkey WHERE coalesce(p_size, 0) <= 40 UNION ALL SELECT p_partkey, p_name, 'merged' FROM part WHERE p_size > 5 AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = p_partkey)",
}
