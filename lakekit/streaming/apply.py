"""Keeping a table current from a stream of change rows.

Each micro-batch is replayed on the records it touches and merged into the table in one commit. The table
keeps a row for deleted records too (``_deleted``), with the sequence last applied, so changes that come
late or again, in the same batch or a later one, are skipped. With partial changes it also keeps the
sequence of each column (``_sequences``): a late change sets the columns whose value is older, and is
skipped for the others. A batch that is run again after a failure therefore changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..common import materialize
from ..errors import ValidationError
from ..operators.replay import DELETED, SEQUENCES, replay, replay_state
from ..storage.table import LakeTable


class ChangeApplier:
    """Applies change rows to the table at ``path``, which is made by the first batch."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sequence: str, change_type: str, values: list[str], partial: bool = False):
        self.spark, self.path, self.keys, self.sequence, self.change_type, self.values, self.partial = spark, path, keys, sequence, change_type, values, partial

    def _state(self) -> DataFrame | None:
        table = LakeTable(self.spark, self.path)
        return table.to_df() if table.log.exists() else None

    def records(self) -> DataFrame:
        """The records that exist now."""
        return LakeTable.for_path(self.spark, self.path).to_df().filter(~F.col(DELETED)).drop(DELETED, SEQUENCES)

    def apply(self, batch: DataFrame) -> None:
        """Apply one batch, in any order, repeated rows and all."""
        keys, seq = self.keys, self.sequence
        rows = materialize(batch.select(*keys, seq, self.change_type, *self.values).dropna(subset=[*keys, seq]), "batch")
        last = rows.filter(F.lower(F.trim(F.col(self.change_type))).isin("insert", "update_postimage", "delete")).groupBy(*keys).agg(F.max(seq).alias(seq))
        state = self._state()
        if state is not None and (SEQUENCES in state.columns) != self.partial:
            raise ValidationError(f"{self.path} was not made {'with' if self.partial else 'without'} partial changes")
        touched = state.join(last.select(*keys), keys, "left_semi") if state is not None else None
        if self.partial:
            self._merge(state, materialize(replay_state(rows, keys, seq, self.change_type, self.values, touched), "applied"))
            return
        base = touched.filter(~F.col(DELETED)).drop(DELETED) if touched is not None else None
        alive = replay(rows, keys, seq, self.change_type, self.values, False, base, touched).withColumn(DELETED, F.lit(False))
        known = last if touched is None else last.unionByName(touched.select(*keys, seq)).groupBy(*keys).agg(F.max(seq).alias(seq))
        gone = known.join(alive.select(*keys), keys, "left_anti").select(*keys, *[F.lit(None).cast(rows.schema[v].dataType).alias(v) for v in self.values], seq, F.lit(True).alias(DELETED))
        self._merge(state, materialize(alive.unionByName(gone), "applied"))

    def _merge(self, state: DataFrame | None, new: DataFrame) -> None:
        if state is None:
            LakeTable.write(new, self.path)
            return
        same = " AND ".join(f"source.`{k}` = target.`{k}`" for k in self.keys)
        if self.partial:  # a late change leaves the record's last sequence as it is
            newer = " OR ".join(f"NOT (source.`{c}` <=> target.`{c}`)" for c in new.columns if c not in self.keys)
        else:
            newer = f"source.`{self.sequence}` > target.`{self.sequence}`"
        LakeTable.for_path(self.spark, self.path).merge(new, same).when_matched_update_all(newer).when_not_matched_insert_all().execute()

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """Apply a streaming DataFrame of change rows, batch by batch."""
        writer = stream.writeStream.foreachBatch(lambda b, _: self.apply(b)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
