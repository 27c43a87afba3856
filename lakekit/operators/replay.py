"""Applying change rows in order: the current state of a table from its change feed.

Rows are range-partitioned by (key, sequence) and sorted, so a key with a third of all rows is cut into
many tasks. In each task a state machine runs over runs of rows of one key and leaves one partial state
per run; partial states of a key are folded in order of sequence. Folding is exact because a state is a
function of the last reset (insert or delete) and of the last value of every column after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESET, PATCH, REMOVE = 1, 2, 3
DELETED, SEQUENCES = "_deleted", "_sequences"


def _kind(change_type):
    t = F.lower(F.trim(change_type))
    return F.when(t == "insert", RESET).when(t == "update_postimage", PATCH).when(t == "delete", REMOVE)


def _rows(changes: DataFrame, keys: list[str], sequence: str, change_type: str, values: list[str]) -> DataFrame:
    kind = _kind(F.col(change_type))
    return changes.select(*keys, F.col(sequence).alias("__seq"), kind.alias("__kind"), *values).dropna(subset=[*keys, "__seq", "__kind"])


def replay(changes: DataFrame, keys: list[str], sequence: str, change_type: str, values: list[str], partial: bool = False, base: DataFrame | None = None, applied: DataFrame | None = None) -> DataFrame:
    """Current records: keys, ``values`` and ``sequence`` of the change that gave the current values.

    An insert or a postimage sets the record (a postimage of an unknown record creates it), a delete
    removes it, preimages and unknown types change nothing; types are read without case and padding.
    With ``partial`` a postimage carries only the columns it changes, null meaning "as before"; else
    nulls are values. Rows with a null key or sequence don't count. Repeated rows count once; of
    contradicting rows with equal key and sequence a delete wins, then a postimage, then the greatest
    values. ``base`` (keys, values, sequence) is an earlier state to go on from, and rows at or below a
    key's sequence in ``applied`` (keys, sequence; deleted keys included, by default ``base``) are
    skipped as already applied: ``base`` holds all changes up to its sequences. Partial changes that may
    come late are for ``replay_state``. Empty input gives an empty result.
    """
    rows = _rows(changes, keys, sequence, change_type, values)
    if base is not None:
        done = (applied if applied is not None else base).groupBy(*keys).agg(F.max(sequence).alias("__done"))
        rows = rows.join(done, keys, "left").filter(F.col("__done").isNull() | (F.col("__seq") > F.col("__done"))).drop("__done")
        rows = rows.unionByName(base.select(*keys, F.col(sequence).alias("__seq"), F.lit(RESET).alias("__kind"), *values))
    return _replayed(rows, keys, sequence, values, partial)


def replay_state(changes: DataFrame, keys: list[str], sequence: str, change_type: str, values: list[str], state: DataFrame | None = None) -> DataFrame:
    """Replay of partial changes that can be gone on with, whatever the order in which changes come: keys,
    ``values``, ``sequence`` of the last change, ``_deleted`` and ``_sequences``, with a row for deleted
    records too. ``_sequences`` holds the sequence of the last insert or delete and of each column's value,
    so a late change still sets the columns whose value is older. ``state`` is an earlier result.

    Any split of changes into batches gives the state of one replay of all of them; only of contradicting
    rows with equal key and sequence in different batches another one may win.
    """
    rows = _rows(changes, keys, sequence, change_type, values)
    if state is not None:
        rows = rows.unionByName(_as_changes(state, keys, sequence, values))
    # every value goes with its sequence; null (a patch without the column) stays null
    stamped = [F.when((F.col("__kind") == RESET) | F.col(v).isNotNull(), F.struct(F.col(v).alias("value"), F.col("__seq").alias("seq"))).alias(v) for v in values]
    alive = _replayed(rows.select(*keys, "__seq", "__kind", *stamped), keys, "__alive", values, True)
    reset = F.max(F.when(F.col("__kind") != PATCH, F.struct("__seq", "__kind")))
    facts = rows.groupBy(*keys).agg(F.max("__seq").alias(sequence), reset.alias("__reset"))
    sequences = F.struct(
        F.col("__reset.__seq").alias("reset"),
        F.coalesce(F.col("__reset.__kind") == REMOVE, F.lit(False)).alias("removed"),
        F.struct(*[F.col(v)["seq"].alias(v) for v in values]).alias("columns"),
    )
    return facts.join(alive, keys, "left").select(*keys, *[F.col(v)["value"].alias(v) for v in values], sequence, F.col("__alive").isNull().alias(DELETED), sequences.alias(SEQUENCES))


def _as_changes(state: DataFrame, keys: list[str], sequence: str, values: list[str]) -> DataFrame:
    """Changes whose replay gives the state: the last insert or delete, and a patch for each sequence that
    a column's value, or the record, has beyond it."""
    s, last = F.col(SEQUENCES), F.col(sequence)
    with_reset = lambda v: ~s["removed"] & s["columns"][v].eqNullSafe(s["reset"])
    kind = F.when(s["removed"], REMOVE).otherwise(RESET)
    resets = state.filter(s["reset"].isNotNull()).select(*keys, s["reset"].alias("__seq"), kind.alias("__kind"), *[F.when(with_reset(v), F.col(v)).alias(v) for v in values])
    at = [F.when(~with_reset(v), s["columns"][v]) for v in values] + [F.when(s["reset"].isNull() | (last > s["reset"]), last)]
    patches = state.withColumn("__seq", F.explode(F.array_distinct(F.array_compact(F.array(*at)))))
    patches = patches.select(*keys, "__seq", F.lit(PATCH).alias("__kind"), *[F.when(s["columns"][v] == F.col("__seq"), F.col(v)).alias(v) for v in values])
    return resets.unionByName(patches)


def _replayed(rows: DataFrame, keys: list[str], sequence: str, values: list[str], partial: bool) -> DataFrame:
    rows = rows.distinct()  # repeated rows go before the sort, combined on the map side
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("__first", rows.schema["__seq"].dataType), T.StructField("__last", rows.schema["__seq"].dataType), T.StructField("__reset", T.IntegerType()), *[rows.schema[v] for v in values], *[T.StructField(f"__has_{i}", T.BooleanType()) for i in range(len(values))]])

    names = schema.names

    def machine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            col = dict(zip(b.schema.names, b.columns, strict=True))
            new = np.zeros(n, dtype=bool)
            new[0] = True
            for k in keys:
                new[1:] |= pc.not_equal(col[k][1:], col[k][:-1]).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(new)
            end = np.append(start[1:], n) - 1
            kind_, at = col["__kind"].to_numpy(), np.arange(n)
            # position of the last reset or removal in each run (-1: none)
            reset_at = np.maximum.reduceat(np.where(kind_ != PATCH, at, -1), start)
            out = [col[k].take(pa.array(start)) for k in keys]
            out += [col["__seq"].take(pa.array(start)), col["__seq"].take(pa.array(end))]
            known = np.where(reset_at >= 0, kind_[np.maximum(reset_at, 0)], 0)
            # a removal followed by a postimage is a new record
            out.append(pa.array(np.where((known == REMOVE) & (reset_at < end), RESET, known).astype(np.int32)))
            since, flags = np.maximum(reset_at, start), []
            for v in values:
                if partial:
                    usable = (col[v].is_valid().to_numpy(zero_copy_only=False) & (kind_ == PATCH)) | (kind_ == RESET)
                    last = np.maximum.reduceat(np.where(usable, at, -1), start)
                    has = last >= since
                    take = np.where(has, last, start)
                else:
                    has, take = kind_[end] != REMOVE, end
                flags.append(pa.array(has))
                picked = col[v].take(pa.array(take))
                out.append(pc.if_else(flags[-1], picked, pa.nulls(len(picked), picked.type)))
            yield pa.RecordBatch.from_arrays(out + flags, names)

    ordered = rows.repartitionByRange(*keys, "__seq").sortWithinPartitions(*keys, "__seq", "__kind", *values)
    parts = ordered.mapInArrow(machine, schema)
    state = F.struct("__first", "__last", "__reset", *values, *[f"__has_{i}" for i in range(len(values))])
    listed = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(state)).alias("__parts"))

    def fold(acc, x):
        fresh = x["__reset"] != 0
        cols = [x["__first"].alias("__first"), x["__last"].alias("__last"), F.when(fresh, x["__reset"]).otherwise(F.when((acc["__reset"] == REMOVE) | (acc["__reset"] == 0), RESET).otherwise(acc["__reset"])).cast("int").alias("__reset")]
        gone = acc["__reset"] == REMOVE
        for i, v in enumerate(values):
            cols.append(F.when(fresh | x[f"__has_{i}"], x[v]).when(gone, F.lit(None)).otherwise(acc[v]).alias(v))
        for i in range(len(values)):
            cols.append((fresh | x[f"__has_{i}"] | acc[f"__has_{i}"]).alias(f"__has_{i}"))
        return F.struct(*cols)

    folded = listed.withColumn("__s", F.when(F.size("__parts") == 1, F.element_at("__parts", 1)).otherwise(F.aggregate(F.slice("__parts", 2, F.size("__parts")), F.element_at("__parts", 1), fold)))
    alive = folded.filter(F.col("__s.__reset") != REMOVE)
    return alive.select(*keys, *[F.col("__s")[v].alias(v) for v in values], F.col("__s.__last").alias(sequence))


def current_records(changes: DataFrame) -> DataFrame:
    """(table_path, id, gender, age, _commit_version) of every record that exists after all changes."""
    return replay(changes, ["table_path", "id"], "_commit_version", "_change_type", ["gender", "age"])
