"""Removing duplicate rows by key: pure transforms and the marks that a table commit needs.

Instead of windows over a key (which put all rows of a hot key into one task) keys are counted with
map-side aggregation and rows joined back in salted tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import salted_join
from ..validation import require_columns, validate_columns_exist

_N = "__copies"


def _known(keys: list[str]) -> Column:
    c = F.lit(True)
    for k in keys:
        c = c & F.col(f"`{k}`").isNotNull()
    return c


def _spread(df: DataFrame) -> list[Column]:
    """What rows of a hot key are dealt by: anything cheap that differs within the key."""
    return [F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns[:8]])] if df.columns else [F.lit(0)]


def duplicated_rows(df: DataFrame, keys: list[str], null_safe: bool = False) -> DataFrame:
    """All rows whose key occurs more than once. Keys with a null are no duplicates of each other, unless
    ``null_safe``."""
    counts = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias(_N)).filter(F.col(_N) > 1).drop(_N)
    return _join_keys(df, counts, keys, null_safe, "left_semi")


def _join_keys(df: DataFrame, keyed: DataFrame, keys: list[str], null_safe: bool, how: str) -> DataFrame:
    if not null_safe:
        return salted_join(df, keyed, keys, _spread(df), how)
    named = {k: f"__k{i}" for i, k in enumerate(keys)}
    flat = lambda x: x.withColumns({v: F.to_json(F.struct(F.col(f"`{k}`").alias("v"))) for k, v in named.items()})
    return salted_join(flat(df), flat(keyed).drop(*keys), list(named.values()), _spread(df), how).drop(*named.values())


def kill_duplicates(df: DataFrame, keys: list[str], null_safe: bool = False) -> DataFrame:
    """Rows whose key occurs once; every copy of a repeated key goes. Rows with a null in the key stay
    (null equals nothing), unless ``null_safe``. An empty table stays empty."""
    require_columns(keys)
    validate_columns_exist(keys, df)
    counts = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias(_N)).filter(F.col(_N) > 1).drop(_N)
    return _join_keys(df, counts, keys, null_safe, "left_anti")


def superfluous_rows(df: DataFrame, primary_key: str, keys: list[str]) -> DataFrame:
    """The rows that ``remove_duplicates_by`` drops."""
    pk = F.col(f"`{primary_key}`")
    known = df.filter(_known(keys))
    per_pk = known.groupBy(*[F.col(f"`{k}`") for k in keys], pk.alias("__pk")).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("__pk").isNotNull(), F.struct("__pk", "n")))
    per_key = per_pk.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.sum("n").alias(_N), F.max(F.col("__pk").isNull()).alias("__null"), first.alias("__first")).filter(F.col(_N) > 1).drop(_N)
    keeps = ~F.col("__null") & (pk == F.col("__first.__pk")) & (F.col("__first.n") == 1)
    joined = salted_join(known.filter(pk.isNotNull()), per_key, keys, _spread(df))
    return joined.filter(~keeps).select(*[F.col(f"`{c}`") for c in df.columns])


def remove_duplicates_by(df: DataFrame, primary_key: str, keys: list[str]) -> DataFrame:
    """Keep the row with the lowest primary key of every key.

    Defined on ties and nulls as a delete by equality would act: rows with a null in key or primary key
    stay; if the lowest primary key is itself repeated within a key, all its rows go; a null primary key
    counts as lowest, so the others of its key go.
    """
    require_columns([primary_key] if primary_key else [], "the input parameter primaryKey must not be empty")
    require_columns(keys)
    validate_columns_exist(keys, df)
    pk = F.col(f"`{primary_key}`")
    known = df.filter(_known(keys))
    per_pk = known.groupBy(*[F.col(f"`{k}`") for k in keys], pk.alias("__pk")).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("__pk").isNotNull(), F.struct("__pk", "n")))
    per_key = per_pk.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.sum("n").alias(_N), F.max(F.col("__pk").isNull()).alias("__null"), first.alias("__first")).filter(F.col(_N) > 1)
    joined = salted_join(df, per_key, keys, _spread(df), "left")
    keeps = F.col(_N).isNull() | pk.isNull() | (~F.col("__null") & (pk == F.col("__first.__pk")) & (F.col("__first.n") == 1))
    return joined.filter(keeps).select(*[F.col(f"`{c}`") for c in df.columns])


def drop_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of every key, which one is not defined; null keys are equal here."""
    require_columns(keys)
    validate_columns_exist(keys, df)
    return df.dropDuplicates(keys)
