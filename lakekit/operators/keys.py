"""Composite keys."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NoColumnsError


def is_composite_key(df: DataFrame, columns: list[str]) -> bool:
    """Whether no two rows agree in the columns (null equals null). True for an empty table."""
    if not columns:
        raise NoColumnsError("At least one column must be specified.")
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise NoColumnsError(f"The base table has these columns {df.columns}, but these columns are required {columns}")
    return df.groupBy(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(columns)]).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def _whole(columns) -> Column:
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])


def key_counts(df: DataFrame, size: int, exclude: list[str] | None = None) -> DataFrame:
    """(columns, n_distinct, n_rows_distinct) of all column combinations of a size, in one job. Nulls
    count as values."""
    columns = [c for c in df.columns if c not in (exclude or [])]
    sets = list(combinations(columns, size))
    if not sets:
        return df.sparkSession.createDataFrame([], "columns string, n_distinct long, n_rows_distinct long")
    one = df.agg(F.count_distinct(_whole(df.columns)).alias("all"), *[F.count_distinct(_whole(s)).alias(f"n{i}") for i, s in enumerate(sets)])
    listed = F.explode(F.array(*[F.struct(F.lit(",".join(s)).alias("columns"), F.col(f"n{i}").alias("n_distinct"), F.col("all").alias("n_rows_distinct")) for i, s in enumerate(sets)]))
    return one.select(listed.alias("x")).select("x.*")


def find_composite_key(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """The smallest combination of columns that aren't excluded, first in column order, with as many
    distinct values as the whole table has distinct rows; never all columns of the table; empty if there
    is none. Null counts as a value; in an empty table the first column will do. One job per size, ending
    with the first size that has a key: a sketch (relative error about 2 %) rules out most combinations,
    the others are counted exactly."""
    columns = [c for c in df.columns if c not in (exclude or [])]
    rest, rows = df, _whole(df.columns)
    for size in range(1, min(len(columns), len(df.columns) - 1) + 1):
        sets = list(combinations(columns, size))
        sketch = rest.agg(F.approx_count_distinct(rows, 0.02).alias("all"), *[F.approx_count_distinct(_whole(s), 0.02).alias(f"n{i}") for i, s in enumerate(sets)]).first()
        likely = [s for i, s in enumerate(sets) if sketch[f"n{i}"] >= 0.8 * sketch["all"]]
        for at in range(0, len(likely), 8):
            some = likely[at : at + 8]
            exact = rest.agg(F.count_distinct(rows).alias("all"), *[F.count_distinct(_whole(s)).alias(f"n{i}") for i, s in enumerate(some)]).first()
            for i, s in enumerate(some):
                if exact[f"n{i}"] == exact["all"]:
                    return list(s)
    return []
