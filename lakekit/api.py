"""The library's operations on tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .constants import EQUALS, LEFT_OVER, MIN_MAX, OVERALL, TOTAL_NUM_FILES, UNRESOLVED, UNRESOLVED_COLS, format_sql
from .errors import ValidationError
from .functions.humanize import humanize_bytes
from .operators import append as _append
from .operators import dedupe, file_stats, hashing, keys, op_metrics, scd2, skipping
from .sources.change_feed import ChangeFeed, _spark, read_changes
from .storage.log import STATS
from .storage.table import FILE, ROW, LakeTable, merge_metrics
from .validation import require_columns, validate_columns_exist

__all__ = ["ChangeFeed", "LakeTable", "OperationMetrics", "read_changes"]

# ---------------------------------------------------------------- type-2 history


def scd2_upsert(table: LakeTable, updates: DataFrame, primary_key: str, attrs: list[str]) -> int:
    """Type-2 upsert with the columns is_current, effective_time and end_time."""
    return scd2_generic_upsert(table, updates, primary_key, attrs, "is_current", "effective_time", "end_time")


def scd2_generic_upsert(table: LakeTable, updates: DataFrame, primary_key: str, attrs: list[str], current: str, effective: str, end: str) -> int:
    return scd2.upsert_table(table, updates, primary_key, attrs, current, effective, end)


# ---------------------------------------------------------------- layout


def latest_version(path: str) -> int:
    return LakeTable.for_path(_spark(), path).version()


def _files(path: str, condition: str | None) -> DataFrame:
    table = LakeTable.for_path(_spark(), path)
    return file_stats.in_partitions(table.files(), table.partition_columns, table.schema, condition)


def file_size_distribution(path: str, condition: str | None = None) -> DataFrame:
    """Distribution of file sizes per partition, optionally of partitions that fit a condition."""
    return file_stats.size_distribution(_files(path, condition))


def file_size_distribution_mb(path: str, condition: str | None = None) -> DataFrame:
    return file_stats.size_distribution_mb(_files(path, condition))


def num_record_distribution(path: str, condition: str | None = None) -> DataFrame:
    return file_stats.record_distribution(_files(path, condition))


def file_sizes(table: LakeTable) -> dict[str, float]:
    return file_stats.file_sizes(table.files()).first().asDict()


def show_file_sizes(table: LakeTable) -> None:
    s = file_sizes(table)
    print(f"The delta table contains {int(s['number_of_files'])} files with a size of {humanize_bytes(s['size_in_bytes'])}. The average file size is {humanize_bytes(s['average_file_size_in_bytes'])}")


def shuffle_file_metadata(path: str, condition: str) -> tuple[dict[str, DataFrame], DataFrame, list[str]]:
    """Files that each class of conjuncts needs, all files, and unresolved columns."""
    table = LakeTable.for_path(_spark(), path)
    classes = skipping.classify(_spark(), condition, table.schema.names)
    files = table.files()
    tests = skipping.class_tests(classes, table.schema, table.partition_columns)
    return {k: files.filter(t) for k, t in tests.items()}, files, classes.unresolved_columns


def num_shuffle_files(path: str, condition: str) -> dict[str, int | list[str]]:
    """How many files a filter or merge condition needs, by class of conjuncts."""
    table = LakeTable.for_path(_spark(), path)
    classes = skipping.classify(_spark(), condition, table.schema.names)
    n = skipping.count_files(table.files(), classes, table.schema, table.partition_columns).first()
    label = lambda prefix, *kinds: f"{prefix} [ {format_sql([c.sql for c in classes.of(*kinds)])} ]"
    return {
        label(OVERALL, "min_max", "equal", "left_over"): n["overall"], label(MIN_MAX, "min_max"): n["min_max"], label(EQUALS, "equal"): n["equal"],
        label(LEFT_OVER, "left_over"): n["left_over"], label(UNRESOLVED, "unresolved"): n["unresolved"], TOTAL_NUM_FILES: n["total"], UNRESOLVED_COLS: classes.unresolved_columns,
    }


# ---------------------------------------------------------------- duplicates


def _delete_rows(table: LakeTable, rows: DataFrame, version: int, predicate: str) -> int:
    marks = rows.select(FILE, ROW, F.lit("delete").alias("__action"), F.lit(None).cast(table.schema).alias("__new"))
    return table.rewrite("MERGE", materialize(marks, "duplicates"), merge_metrics, {"predicate": predicate}, version=version)


def kill_duplicate_records(table: LakeTable, columns: list[str]) -> int:
    """Delete every row whose key occurs more than once."""
    require_columns(columns)
    version = table.version()
    df = table.to_df(version, identity=True)
    validate_columns_exist(columns, df)
    return _delete_rows(table, dedupe.duplicated_rows(df, columns), version, f"duplicates of {columns}")


def remove_duplicate_records(table: LakeTable, columns: list[str], primary_key: str | None = None) -> int:
    """Keep one row of every key: that of the lowest primary key, or, without one, any (the table is then
    overwritten)."""
    version = table.version()
    if primary_key is None:
        LakeTable.write(dedupe.drop_duplicates(table.to_df(version), columns), table.path, mode="overwrite", read_version=version)
        return version + 1
    require_columns([primary_key] if primary_key else [], "the input parameter primaryKey must not be empty")
    require_columns(columns)
    df = table.to_df(version, identity=True)
    validate_columns_exist(columns, df)
    return _delete_rows(table, dedupe.superfluous_rows(df, primary_key, columns), version, f"duplicates of {columns}")


# ---------------------------------------------------------------- appending and copying


def validate_append(table: LakeTable, new: DataFrame, required: list[str], optional: list[str]) -> int:
    """Append after checking columns; optional ones may be new to the table."""
    _append.check_append(table.schema.names, new.columns, required, optional)
    LakeTable.write(new, table.path, mode="append", merge_schema=True)
    return table.version()


def append_without_duplicates(table: LakeTable, new: DataFrame, composite_key: list[str]) -> int:
    """Insert-only merge of one row of every key that the table doesn't have."""
    require_columns(composite_key, "The attribute compositeKey must not be empty")
    once = new.dropDuplicates(composite_key)
    same = " AND ".join(f"old.`{c}` = new.`{c}`" for c in composite_key)
    return table.merge(once, same, "new", "old").when_not_matched_insert_all().execute()


def storage_location(table: LakeTable) -> str:
    return table.detail().first()["location"]


def copy_table(table: LakeTable, path: str | None = None, name: str | None = None) -> LakeTable:
    """Copy rows, partitioning and properties, not the history."""
    if (path is None) == (name is None):
        raise ValidationError("Either a target path or a target table name must be given, and not both")
    meta = table.log.metadata()
    return LakeTable.write(table.to_df(), path, "error", meta["partitionColumns"], meta["configuration"], name)


# ---------------------------------------------------------------- keys


def find_composite_key_candidate(table: LakeTable, exclude: list[str] | None = None) -> list[str]:
    return keys.find_composite_key(table.to_df(), exclude)


def is_composite_key_candidate(table: LakeTable, columns: list[str]) -> bool:
    return keys.is_composite_key(table.to_df(), columns)


def with_md5_columns(data: DataFrame | LakeTable, columns: list[str], name: str = "") -> DataFrame:
    return hashing.with_md5(data.to_df() if isinstance(data, LakeTable) else data, columns, name)


# ---------------------------------------------------------------- operation metrics


@dataclass(frozen=True)
class OperationMetrics:
    """Counts of deleted, inserted, updated and source rows per version."""

    path: str
    start: int = 0
    end: int | None = None

    def as_df(self, partition_condition: str | None = None) -> DataFrame:
        log = LakeTable.for_path(_spark(), self.path).log
        acts = log.actions(self.start, self.end)
        stats = F.from_json("add.stats", STATS)
        adds = acts.filter(F.col("add").isNotNull()).select("version", F.col("add.partitionValues").alias("partitionValues"), stats["numRecords"].alias("numRecords"))
        return op_metrics.count_metrics(log.history(self.start, self.end), adds, partition_condition)

    def as_list(self, partition_condition: str | None = None) -> list[tuple]:
        return [tuple(r) for r in self.as_df(partition_condition).collect()]

    def written_rows(self, partition_condition: str, version: int) -> int:
        """Rows that one commit wrote to a partition."""
        acts = LakeTable.for_path(_spark(), self.path).log.actions(version, version)
        test = F.lit(True)
        for k, v in op_metrics.equalities(partition_condition, strict=True).items():
            test = test & F.coalesce(F.col("add.partitionValues")[k] == v, F.lit(False))
        return acts.filter(F.col("add").isNotNull() & test).agg(F.sum(F.from_json("add.stats", STATS)["numRecords"])).first()[0] or 0


