"""Type-2 upserts: close the current version of a changed entity and open a new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import materialize, salted_join
from ..errors import MultipleMatchError, ValidationError
from ..storage.table import FILE, ROW, LakeTable, merge_metrics


def check_columns(base: list[str], updates: list[str], key: str, attrs: list[str], current: str, effective: str, end: str) -> None:
    required = [key, *attrs, current, effective, end]
    if sorted(base) != sorted(required):
        raise ValidationError(f"The base table has these columns '{base}', but these columns are required '{required}'")
    required = [key, *attrs, effective]
    if sorted(updates) != sorted(required):
        raise ValidationError(f"The updates DataFrame has these columns '{updates}', but these columns are required '{required}'")


def _parts(base: DataFrame, updates: DataFrame, key: str, attrs: list[str], current: str, effective: str, end: str, columns: list[str]) -> tuple[DataFrame, dict[str, Column], DataFrame]:
    """(base rows with their update ``__u`` and whether it closes them, the values of a closed row, the rows
    of newly opened versions)."""
    check_columns(columns, updates.columns, key, attrs, current, effective, end)
    k = F.col(f"`{key}`")
    if not updates.filter(k.isNotNull()).groupBy(k).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise MultipleMatchError(f"more than one update for the same {key}")
    named = updates.select(k, F.struct(*[F.col(f"`{a}`").alias(f"a{i}") for i, a in enumerate(attrs)], F.col(f"`{effective}`").alias("at")).alias("__u"))
    differs = F.lit(False)
    for i, a in enumerate(attrs):
        differs = differs | (F.col("__u")[f"a{i}"] != F.col(f"`{a}`"))
    joined = salted_join(base, named, [key], [F.col(f"`{effective}`"), F.col(f"`{end}`")], "left").withColumn("__changed", F.coalesce(F.col(f"`{current}`") & differs, F.lit(False)))
    closed = {c: F.col(f"`{c}`") for c in columns} | {current: F.lit(False), end: F.col("__u.at").cast(base.schema[end].dataType)}
    value = {current: F.lit(True), effective: F.col("__u.at"), end: F.lit(None), key: k} | {a: F.col("__u")[f"a{i}"] for i, a in enumerate(attrs)}
    row = [value[c].cast(base.schema[c].dataType).alias(c) for c in columns]
    unknown = named.join(base.select(k).distinct(), key, "left_anti")
    return joined, closed, joined.filter("__changed").select(*row).unionByName(unknown.select(*row))


def scd2_upsert(base: DataFrame, updates: DataFrame, key: str, attrs: list[str], current: str = "is_current", effective: str = "effective_time", end: str = "end_time") -> DataFrame:
    """The table after the upsert.

    An update changes an entity if an attribute differs by ``<>``, so a value that only becomes null, or
    stops being null, is no change. Changed: the current version is closed at the update's time and a
    current one opened. Unchanged updates and updates of keys without a current version do nothing; new
    keys, and every update without key, open a version. Validity columns may be of any orderable type.
    More than one update of a key raises ``MultipleMatchError``. Base rows of a hot key spread over tasks.
    """
    joined, closed, opened = _parts(base, updates, key, attrs, current, effective, end, base.columns)
    kept = joined.select(*[F.when(F.col("__changed"), v).otherwise(F.col(f"`{c}`")).alias(c) for c, v in closed.items()])
    return kept.unionByName(opened)


def upsert_table(table: LakeTable, updates: DataFrame, key: str, attrs: list[str], current: str = "is_current", effective: str = "effective_time", end: str = "end_time") -> int:
    """The same as one commit of a table: versions to close are marked by file and row, so only their files
    are written again, next to a file of the opened versions."""
    version, schema = table.version(), table.schema
    updates = materialize(updates, "scd-updates")
    joined, closed, opened = _parts(table.to_df(version, identity=True), updates, key, attrs, current, effective, end, schema.names)
    new = F.struct(*[v.alias(c) for c, v in closed.items()])
    marks = materialize(joined.filter("__changed").select(FILE, ROW, F.lit("update").alias("__action"), new.alias("__new")), "scd-closed")
    opened = materialize(opened, "scd-opened")
    return table.rewrite("MERGE", marks, merge_metrics, {"predicate": f"type-2 upsert by {key}"}, None if opened.isEmpty() else opened, version, updates.count())
