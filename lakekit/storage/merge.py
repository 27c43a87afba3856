"""MERGE: one source, a condition, and clauses of which the first that fits a row applies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import materialize
from ..errors import MultipleMatchError, ValidationError
from .table import FILE, ROW, LakeTable, merge_metrics

_SID = "__sid"


@dataclass
class _Clause:
    kind: str  # update, delete, insert
    condition: str | Column | None
    values: dict[str, str | Column] | None  # None: all columns of the source


class Merge:
    def __init__(self, table: LakeTable, source: DataFrame, condition: str | Column, source_alias: str, target_alias: str):
        self.table, self.source, self.condition = table, source, condition
        self.s, self.t = source_alias, target_alias
        self.matched: list[_Clause] = []
        self.unmatched: list[_Clause] = []

    def when_matched_update(self, values: dict[str, str | Column], condition: str | Column | None = None) -> Merge:
        self.matched.append(_Clause("update", condition, values))
        return self

    def when_matched_update_all(self, condition: str | Column | None = None) -> Merge:
        self.matched.append(_Clause("update", condition, None))
        return self

    def when_matched_delete(self, condition: str | Column | None = None) -> Merge:
        self.matched.append(_Clause("delete", condition, None))
        return self

    def when_not_matched_insert(self, values: dict[str, str | Column], condition: str | Column | None = None) -> Merge:
        self.unmatched.append(_Clause("insert", condition, values))
        return self

    def when_not_matched_insert_all(self, condition: str | Column | None = None) -> Merge:
        self.unmatched.append(_Clause("insert", condition, None))
        return self

    def _col(self, x: str | Column) -> Column:
        return F.expr(x) if isinstance(x, str) else x

    def _row(self, clause: _Clause, schema: T.StructType, keep: bool) -> Column:
        """All columns of the table after the clause; unset ones keep their value, or are null."""
        unknown = [c for c in clause.values or {} if c not in schema.names]
        if unknown:
            raise ValidationError(f"columns {unknown} are not in the table")
        out = []
        for f in schema:
            if clause.values is None:
                value = F.col(f"{self.s}.`{f.name}`") if f.name in self.source.columns else None
            else:
                value = self._col(clause.values[f.name]) if f.name in clause.values else None
            if value is None:
                value = F.col(f"{self.t}.`{f.name}`") if keep else F.lit(None)
            out.append(value.cast(f.dataType).alias(f.name))
        return F.struct(*out)

    def _first(self, clauses: list[_Clause], result) -> Column:
        """The result of the first clause whose condition is true."""
        value = None
        for c in clauses:
            holds = F.coalesce(self._col(c.condition), F.lit(False)) if c.condition is not None else F.lit(True)
            value = F.when(holds, result(c)) if value is None else value.when(holds, result(c))
        return value

    def execute(self) -> int:
        """Run and commit; returns the new version. A merge without effect commits its counters only."""
        table, version = self.table, self.table.version()
        schema = table.schema
        # the source is read once: numbered and written, so that a changing source can't differ later
        src = materialize(self.source.withColumn(_SID, F.monotonically_increasing_id()), "merge-source").alias(self.s)
        target = table.to_df(version, identity=True).alias(self.t)
        condition = self._col(self.condition)
        null_row = F.lit(None).cast(schema)
        if self.matched:
            action = self._first(self.matched, lambda c: F.lit(c.kind))
            new = self._first(self.matched, lambda c: self._row(c, schema, True) if c.kind == "update" else null_row)
        else:
            action, new = F.lit(None).cast("string"), null_row
        pairs = materialize(target.join(src, condition).select(FILE, ROW, F.col(_SID), action.alias("__action"), new.alias("__new")), "merge-pairs")
        acting = pairs.filter(F.col("__action").isNotNull())
        sole_delete = len(self.matched) == 1 and self.matched[0].kind == "delete" and self.matched[0].condition is None
        if sole_delete:
            acting = acting.dropDuplicates([FILE, ROW])
        elif not acting.groupBy(FILE, ROW).count().filter("count > 1").isEmpty():
            raise MultipleMatchError("more than one source row would change the same target row")
        inserted = None
        if self.unmatched:
            free = src.join(pairs.select(_SID).distinct(), _SID, "left_anti").alias(self.s)
            rows = free.select(self._first(self.unmatched, lambda c: self._row(c, schema, False)).alias("r")).filter(F.col("r").isNotNull()).select("r.*")
            inserted = materialize(rows, "merge-insert")
            if inserted.isEmpty():
                inserted = None
        parameters = {"predicate": self.condition if isinstance(self.condition, str) else str(self.condition)}
        return table.rewrite("MERGE", acting, merge_metrics, parameters, inserted, version, src.count())
