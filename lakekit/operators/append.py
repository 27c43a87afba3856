"""Appending with checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..validation import require_columns


def check_append(table_columns: list[str], append_columns: list[str], required: list[str], optional: list[str]) -> None:
    """Required columns must be there, others only if the table has them or they are optional."""
    missing = [c for c in required if c not in append_columns]
    if missing:
        raise ValidationError(f"The base Delta table has these columns {append_columns}, but these columns are required {required}")
    extra = [c for c in append_columns if c not in table_columns and c not in optional]
    if extra:
        raise ValidationError(f"The following columns are not part of the current Delta table. If you want to add these columns to the table, you must set the optionalCols parameter: {extra}")


def validated_append(base: DataFrame, new: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """Base and new rows; columns missing on either side are null."""
    check_append(base.columns, new.columns, required, optional)
    return base.unionByName(new, allowMissingColumns=True)


def rows_to_append(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One new row of every key that the base doesn't have. A null in the key equals nothing in the base,
    so one row of every such key is always new. The base's keys are made distinct before they move."""
    require_columns(keys, "The attribute compositeKey must not be empty")
    once = new.dropDuplicates(keys)
    return once.join(base.select(*[F.col(f"`{k}`") for k in keys]).distinct(), keys, "left_anti").select(*[F.col(f"`{c}`") for c in new.columns])


def append_without_duplicates(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(rows_to_append(base, new, keys), allowMissingColumns=True)
