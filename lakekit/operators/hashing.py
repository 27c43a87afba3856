"""Hash columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_md5(df: DataFrame, columns: list[str], name: str = "") -> DataFrame:
    """Add the MD5 of the columns joined by ``||``; nulls are left out of the join. Without a name the
    column is called ``_md5`` and the joined column names."""
    return df.withColumn(name or "_md5" + "".join(columns), F.md5(F.concat_ws("||", *[F.col(f"`{c}`") for c in columns])))
