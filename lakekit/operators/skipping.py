"""Which files a condition needs: conjuncts by class, and pruning by partition values and min/max.

Works on the log alone. A conjunct that can't be decided from statistics keeps every file; so do files
without statistics, and unresolved conjuncts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RANGE = {"GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<="}
_EQUAL = {"EqualTo": "=", "EqualNullSafe": "<=>"}
_FLIP = {">": "<", ">=": "<=", "<": ">", "<=": ">=", "=": "=", "<=>": "<=>"}


@dataclass
class Conjunct:
    sql: str
    kind: str  # min_max, equal, left_over, unresolved
    column: str | None = None
    op: str | None = None
    value: str | None = None  # SQL of the other side, free of columns


@dataclass
class Classes:
    """Conjuncts of a condition by class, and the names that the table doesn't have."""

    conjuncts: list[Conjunct] = field(default_factory=list)
    unresolved_columns: list[str] = field(default_factory=list)

    def of(self, *kinds: str) -> list[Conjunct]:
        return [c for c in self.conjuncts if c.kind in kinds]


def _kids(e) -> list:
    seq = e.children()
    return [seq.apply(i) for i in range(seq.size())]


def _name(e) -> str:
    return e.getClass().getSimpleName()


def _attribute(e) -> str | None:
    """Name of a column reference, its parts joined by dots."""
    if _name(e) == "UnresolvedAttribute":
        parts = e.nameParts()
        return ".".join(parts.apply(i) for i in range(parts.size()))
    return None


def _attributes(e) -> list[str]:
    a = _attribute(e)
    return [a] if a is not None else [x for k in _kids(e) for x in _attributes(k)]


def classify(spark: SparkSession, condition: str, columns: list[str]) -> Classes:
    """Split a condition at its top-level ANDs and classify each part. ``BETWEEN`` counts as two
    comparisons; names are resolved without case, as Spark does."""
    known = {c.lower(): c for c in columns}
    tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(condition)
    parts: list = []

    def split(e) -> None:
        if _name(e) == "And":
            for k in _kids(e):
                split(k)
        else:
            parts.append(e)

    split(tree)
    out = Classes()
    for e in parts:
        names = _attributes(e)
        missing = [n for n in names if n.strip("`").lower() not in known]
        if missing:
            out.conjuncts.append(Conjunct(e.sql(), "unresolved"))
            out.unresolved_columns += [n for n in missing if n not in out.unresolved_columns]
            continue
        kids = _kids(e)
        if _is_between(e) and len(kids) == 3 and (c := _attribute(kids[0])) is not None and not _attributes(kids[1]) and not _attributes(kids[2]):
            for op, v in ((">=", kids[1]), ("<=", kids[2])):
                out.conjuncts.append(Conjunct(f"({c} {op} {v.sql()})", "min_max", known[c.strip('`').lower()], op, v.sql()))
            continue
        op = _RANGE.get(_name(e)) or _EQUAL.get(_name(e))
        if op is None:
            out.conjuncts.append(Conjunct(e.sql(), "left_over"))
            continue
        kind = "equal" if _name(e) in _EQUAL else "min_max"
        a, b = kids
        c = Conjunct(e.sql(), kind)
        if _attribute(a) is not None and not _attributes(b):
            c.column, c.op, c.value = known[_attribute(a).strip("`").lower()], op, b.sql()
        elif _attribute(b) is not None and not _attributes(a):
            c.column, c.op, c.value = known[_attribute(b).strip("`").lower()], _FLIP[op], a.sql()
        out.conjuncts.append(c)
    return out


def _is_between(e) -> bool:
    if _name(e) == "Between":
        return True
    if _name(e) == "UnresolvedFunction":
        parts = e.nameParts()
        return parts.size() == 1 and parts.apply(0).lower() == "between"
    return False


def may_match(c: Conjunct, schema: T.StructType, partition_columns: list[str]) -> Column:
    """Whether a file can hold a row for which the conjunct is true."""
    if c.column is None or c.kind not in ("min_max", "equal"):
        return F.lit(True)
    kind, value = schema[c.column].dataType, F.expr(c.value)
    if c.column in partition_columns:
        here = F.col("partitionValues")[c.column].cast(kind)
        test = {"=": here == value, "<=>": here.eqNullSafe(value), "<": here < value, "<=": here <= value, ">": here > value, ">=": here >= value}[c.op]
        return F.coalesce(test, F.lit(False))
    low, high = F.col("stats.minValues")[c.column].cast(kind), F.col("stats.maxValues")[c.column].cast(kind)
    all_null = F.try_element_at("stats.nullCount", F.lit(c.column)).cast("long") == F.col("stats.numRecords")
    test = {"=": (low <= value) & (high >= value), "<=>": (low <= value) & (high >= value), "<": low < value, "<=": low <= value, ">": high > value, ">=": high >= value}[c.op]
    if c.op == "<=>":  # null matches null
        return F.when(value.isNull(), True).otherwise(F.coalesce(test, ~F.coalesce(all_null, F.lit(False))))
    # unknown (no statistics, or a null literal): keep, but for files that hold only nulls
    return F.coalesce(test, ~F.coalesce(all_null, F.lit(False)))


def _all(conjuncts: list[Conjunct], schema: T.StructType, partition_columns: list[str]) -> Column:
    test = F.lit(True)
    for c in conjuncts:
        test = test & may_match(c, schema, partition_columns)
    return test


def class_tests(classes: Classes, schema: T.StructType, partition_columns: list[str]) -> dict[str, Column]:
    """A file test for each class; classes without conjuncts keep all files."""
    groups = {"overall": ("min_max", "equal", "left_over"), "min_max": ("min_max",), "equal": ("equal",), "left_over": ("left_over",), "unresolved": ("unresolved",)}
    return {k: _all(classes.of(*v), schema, partition_columns) for k, v in groups.items()}


def count_files(files: DataFrame, classes: Classes, schema: T.StructType, partition_columns: list[str]) -> DataFrame:
    """One row: how many files each class needs, and how many there are. One pass over the log."""
    tests = class_tests(classes, schema, partition_columns)
    return files.agg(*[F.count_if(t).alias(k) for k, t in tests.items()], F.count("*").alias("total"))
