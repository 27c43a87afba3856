"""Full validity history of entity attributes from statements (snapshots and updates): gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import hot_slices, materialize


def statements(snapshot: DataFrame, updates: DataFrame, key: str = "pkey", attr: str = "attr") -> DataFrame:
    """(key, t, has_value, attr): what holds for a key from time t on, one row per key and time.

    Of several statements for a key and time the highest ``update_no`` counts, any update before the
    snapshot; of contradicting snapshot rows the greatest attribute. ``end_time`` states "no value" and
    yields to any row that starts at that time. Rows without key or time don't count.
    """
    snap = snapshot.select(key, F.col("effective_time").alias("t"), F.lit(1).alias("rank"), F.lit(0).cast("long").alias("no"), F.col(attr).cast("string").alias("attr"))
    ends = snapshot.filter(F.col("end_time").isNotNull()).select(key, F.col("end_time").alias("t"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("no"), F.lit(None).cast("string").alias("attr"))
    ups = updates.select(key, F.col("effective_time").alias("t"), F.lit(2).alias("rank"), F.coalesce(F.col("update_no"), F.lit(-1)).cast("long").alias("no"), F.col(attr).cast("string").alias("attr"))
    every = snap.unionByName(ends).unionByName(ups).dropna(subset=[key, "t"])
    best = every.groupBy(key, "t").agg(F.max(F.struct("rank", "no", "attr")).alias("b"))
    return best.select(key, "t", (F.col("b.rank") > 0).alias("has_value"), F.col("b.attr").alias("attr"))


def islands(st: DataFrame, key: str = "pkey", max_rows: int = 200_000) -> DataFrame:
    """(key, attr, effective_time, end_time, is_current) from statements.

    Neighbouring statements with the same attribute (null equals null) are one island. Keys with very
    more than ``max_rows`` statements are cut into time slices; the last hash before a slice and the first change after it
    are carried over in a small table of slices, so no task sees all rows of a hot key.
    """
    h = F.xxhash64(F.when(F.col("has_value"), 1).otherwise(0), F.col("attr").isNull(), F.col("attr"))
    s = hot_slices(st.withColumn("h", h), [key], "t", max_rows)
    s = materialize(s, "statements")
    per_slice = s.groupBy(key, "__slice").agg(F.max(F.struct("t", "h"))["h"].alias("last_h"))
    along = Window.partitionBy(key).orderBy("__slice")
    before = per_slice.select(key, "__slice", F.lag("last_h").over(along).alias("before_h"))
    within = Window.partitionBy(key, "__slice").orderBy("t")
    flagged = s.withColumn("prev", F.lag("h").over(within)).join(before, [key, "__slice"])
    prev = F.coalesce("prev", "before_h")
    flagged = flagged.withColumn("changed", (prev.isNull() | (prev != F.col("h"))).cast("int"))
    island = flagged.withColumn("island", F.sum("changed").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    # island 0 goes on from the slice before: its start is there
    spans = island.filter(F.col("island") > 0).groupBy(key, "__slice", "island").agg(F.min("t").alias("start"), F.first("has_value").alias("has_value"), F.first("attr").alias("attr"))
    spans = materialize(spans, "islands")
    firsts = spans.groupBy(key, "__slice").agg(F.min("start").alias("first_start"))
    after = firsts.select(key, "__slice", F.lead("first_start").over(along).alias("after_start"))
    nxt = F.coalesce(F.lead("start").over(Window.partitionBy(key, "__slice").orderBy("start")), F.col("after_start"))
    out = spans.join(after, [key, "__slice"]).withColumn("end_time", nxt).filter("has_value")
    return out.select(key, "attr", F.col("start").alias("effective_time"), "end_time", F.col("end_time").isNull().alias("is_current"))


def full_history(snapshot: DataFrame, updates: DataFrame, key: str = "pkey", attr: str = "attr") -> DataFrame:
    """History of ``attr`` of every key: each version with its validity. Empty inputs give no versions."""
    return islands(statements(snapshot, updates, key, attr), key)
