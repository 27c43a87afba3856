"""Count metrics of operations, from the history alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError

_AND = re.compile(r"\s+and\s+", re.I)
_OR = re.compile(r"\s+or\s+", re.I)
_EQUALITY = re.compile(r"^\s*(?:[\w`]+\.)?`?([\w]+)`?(?:#\d+L?)?\s*(?:={1,2}|<=>)\s*(.+?)\s*$")


def equalities(condition: str, strict: bool = False) -> dict[str, str]:
    """Column to value of the equalities in a conjunction. Aliases, quotes, parentheses and expression
    ids are dropped; other conjuncts are left out. ``OR`` is an error if ``strict``."""
    if strict and _OR.search(condition):
        raise ValidationError(f"OR is not supported in a partition condition: {condition}")
    found = {}
    for part in _AND.split(condition.strip().strip("[]")):
        m = _EQUALITY.match(part.strip().strip("\"").strip("()"))
        if m and not re.search(r"[<>!]", m[2]):
            found[m[1]] = m[2].strip("\"'() ")
    return found


def covers(predicate: str | None, condition: str) -> bool:
    """Whether a commit's predicate has all equalities of the condition, whatever their case."""
    low = lambda d: {k.lower(): v.lower() for k, v in d.items()}
    want, have = low(equalities(condition)), low(equalities(predicate or ""))
    return bool(want) and want.items() <= have.items()


def _covers_column(predicate: Column, condition: str) -> Column:
    """``covers`` as an expression over the predicate's text."""
    want = equalities(condition)
    if not want:
        return F.lit(False)
    test = F.lit(True)
    for k, v in want.items():
        name, value = re.escape(k.lower()), re.escape(v.lower())
        test = test & F.lower(predicate).rlike(rf"(^|[^\w]){name}(#\d+l?)?`?\s*(=|==|<=>)\s*[\"'\\(]*{value}[\"'\\)]*\s*($|\)|\]|\"|\sand\s)")
    return F.coalesce(test, F.lit(False))


def count_metrics(history: DataFrame, adds: DataFrame | None = None, condition: str | None = None) -> DataFrame:
    """(version, deleted, inserted, updated, source_rows), newest first, of merges, writes, deletes and
    updates. With a partition condition writes count only rows of files of the partition (their values
    compared with case) and stay even at 0; others stay only if their predicate has the condition.
    ``adds``: (version, partitionValues, numRecords) of added files. One plan, whatever the history."""
    n = lambda k: F.coalesce(F.expr(f"try_cast(operationMetrics['{k}'] AS bigint)"), F.lit(0).cast("long"))
    op, zero = F.col("operation"), F.lit(0).cast("long")
    rows = history.filter(op.isin("MERGE", "WRITE", "DELETE", "UPDATE"))
    written = n("numOutputRows")
    if condition is not None:
        want = equalities(condition, strict=True)
        test = F.lit(True)
        for k, v in want.items():
            test = test & F.coalesce(F.col("partitionValues")[k] == v, F.lit(False))
        per = adds.filter(test).groupBy("version").agg(F.sum("numRecords").alias("__n"))
        rows = rows.join(per, "version", "left").filter((op == "WRITE") | _covers_column(F.col("operationParameters")["predicate"], condition))
        written = F.coalesce("__n", zero)
    pick = lambda **by: F.coalesce(*[F.when(op == k.upper(), v) for k, v in by.items()], zero)
    return rows.select(
        "version",
        pick(merge=n("numTargetRowsDeleted"), delete=n("numDeletedRows")).alias("deleted"),
        pick(merge=n("numTargetRowsInserted"), write=written).alias("inserted"),
        pick(merge=n("numTargetRowsUpdated"), update=n("numUpdatedRows")).alias("updated"),
        pick(merge=n("numSourceRows"), write=written).alias("source_rows"),
    ).orderBy(F.desc("version"))
