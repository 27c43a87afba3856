"""Checks of arguments, made before any plan is built. Names are compared exactly, with case."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame

from .errors import NoColumnsError, ValidationError


def validate_columns_exist(columns: list[str], df: DataFrame) -> None:
    missing = list((Counter(columns) - Counter(df.columns)).elements())
    if missing:
        raise ValidationError(f"these columns: {missing} do not exists in the dataframe: {df.columns}")


def require_columns(columns: list[str], message: str = "the input parameter duplicateColumns must not be empty") -> None:
    if not columns:
        raise NoColumnsError(message)
