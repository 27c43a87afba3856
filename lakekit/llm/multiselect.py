"""Exact percentiles per group by distributed multi-select over mergeable sorted runs.

Values are brought together by group once (a group too large for a task is dealt to several) and each task
sorts what it holds of a group into runs. A table of runs is the summary that pieces of a log, versions or days are put together with: their runs are simply united.
Every run proposes the median of its remaining values, the median weighted by their number is the pivot,
every run counts values below and at the pivot, ruled-out ranges are dropped, and so on for all groups and
percentiles at once until none is left. Whole values never leave their run for that, only proposals and
counts do, combined on the map side, so a group with most of all rows costs no more than others. A range
that is down to ``last`` values after a round is read out instead of being halved on. The result has no
error at all, hence meets any bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import materialize

PERCENTS = (10, 25, 50, 75, 90, 95)
FLUSH = 1_000_000
BROADCAST_ROWS = 10_000  # groups, each with a few numbers for each percentile (about 700 bytes), that are broadcast at most
PARTS = 16  # tasks that the runs of a group are dealt to at most where they are joined


def sorted_runs(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, run): per task and group the sorted non-null values, at most ``FLUSH`` rows at a time.
    Null keys are groups of their own; text keys only. Values scattered over many tasks would give runs of
    one value each, so they are shuffled by group before, partitions of hot groups split by size."""
    schema = T.StructType([*[T.StructField(k, T.StringType()) for k in keys], T.StructField("run", T.ArrayType(T.LongType()))])
    arrow = pa.schema([*[(k, pa.string()) for k in keys], ("run", pa.list_(pa.int64()))])

    def one(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        coded = [t[k].combine_chunks().dictionary_encode(null_encoding="encode") for k in keys]
        code = np.zeros(len(t), dtype=np.int64)
        for c in coded:
            code = code * max(1, len(c.dictionary)) + c.indices.to_numpy()
        v = t[value].to_numpy()
        order = np.lexsort((v, code))
        code, v = code[order], v[order]
        start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        first = pa.array(order[start])
        run = pa.ListArray.from_arrays(pa.array(np.append(start, len(v)), type=pa.int32()), pa.array(v))
        table = pa.Table.from_arrays([*[t[k].take(first) for k in keys], run], schema=arrow)
        yield from table.combine_chunks().to_batches(max_chunksize=4096)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= FLUSH:
                yield from one(held)
                held, n = [], 0
        if held:
            yield from one(held)

    known = values.select(*keys, F.col(value).cast("long").alias(value)).filter(F.col(value).isNotNull())
    return known.hint("rebalance", *[F.col(k) for k in keys]).mapInArrow(cut, schema)


def _join(big: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Equi-join without broadcast: Spark would judge by the size of compressed files, which says little
    about rows of repeated names in the driver's memory."""
    return big.join(small.hint("merge"), on)


def _beside(runs: DataFrame, small: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Runs with what ``small`` has for their group: broadcast if that is at most ``BROADCAST_ROWS`` rows,
    else joined with the runs of each group dealt to several tasks; a row is repeated only for those of the
    ``parts`` that have runs of its group."""
    if rows <= BROADCAST_ROWS:
        return runs.join(F.broadcast(small.drop("parts")), keys)
    return _join(runs, small.withColumn("part", F.explode("parts")).drop("parts"), [*keys, "part"])


def _per_run(runs: DataFrame, targets: DataFrame, keys: list[str], pivots: bool, rows: int) -> DataFrame:
    """For each run and open target: without pivots (weight, median) of the remaining values, else the
    numbers of them below and at the pivot."""
    schema = T.StructType([*[T.StructField(k, T.StringType()) for k in keys], T.StructField("p", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    arrow = pa.schema([*[(k, pa.string()) for k in keys], ("p", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
    grouped = targets.groupBy(*keys).agg(F.first("parts").alias("parts"), F.collect_list(F.struct("p", "lo", "hi", "pivot")).alias("__t"))  # one for each percentile
    joined = _beside(runs, grouped, keys, rows)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in arrow]
            names = b.schema.names
            runs_, ts = b.column(names.index("run")), b.column(names.index("__t"))
            values, offsets = runs_.values.to_numpy(), runs_.offsets.to_numpy()
            ks = [b.column(names.index(k)).to_pylist() for k in keys]
            for i, targets_ in enumerate(ts.to_pylist()):
                v = values[offsets[i] : offsets[i + 1]]
                for t in targets_:
                    lo = 0 if t["lo"] is None else int(np.searchsorted(v, t["lo"], "right"))
                    hi = len(v) if t["hi"] is None else int(np.searchsorted(v, t["hi"], "left"))
                    if hi <= lo:
                        continue
                    if pivots:
                        l, r = (int(np.searchsorted(v, t["pivot"], s)) for s in ("left", "right"))
                        a, c = max(l - lo, 0), max(r - max(l, lo), 0)
                    else:
                        a, c = hi - lo, int(v[(lo + hi - 1) // 2])
                    for o, x in zip(out, [*[k[i] for k in ks], t["p"], a, c], strict=True):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, type=f.type) for o, f in zip(out, arrow, strict=True)], schema=arrow)

    return joined.select(*keys, "run", "__t").mapInArrow(go, schema)


def _weighted_median(proposed: DataFrame, keys: list[str], parts: int = 64) -> DataFrame:
    """(keys, p, pivot): the weighted median of the proposals of each target. They are dealt to ``parts``
    first and the parts' weighted medians give the pivot, so no row holds all proposals of a target, however
    many runs there are; a quarter of the values at least lies on either side of it, or it is hit."""
    target = [*keys, "p"]
    half = lambda l: F.aggregate(l, F.struct(F.lit(0).cast("long").alias("s"), F.lit(None).cast("long").alias("m")), lambda a, x: F.struct((a["s"] + x["w"]).alias("s"), F.when(a["m"].isNull() & ((a["s"] + x["w"]) * 2 >= F.col("all")), x["m"]).otherwise(a["m"]).alias("m")))["m"]
    one = lambda t, by: t.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("m", "w"))).alias("l"), F.sum("w").alias("all"))
    dealt = one(proposed.withColumn("part", F.pmod(F.xxhash64("m", "w"), F.lit(parts))), [*target, "part"])
    return one(dealt.select(*target, half(F.col("l")).alias("m"), F.col("all").alias("w")), target).select(*target, half(F.col("l")).alias("pivot"))


def percentiles(runs: DataFrame, keys: list[str], percents: tuple[int, ...] = PERCENTS, last: int = 256) -> DataFrame:
    """(keys, n, p10, ...): the value at position ceil(p*n/100) of each group in ascending order.

    ``last``: what is left of a target's range after a round of selection is read out once it has so few
    values. Empty input gives no groups; equal values are no special case.
    """
    names, keys = keys, [f"__k{i}" for i in range(len(keys))]  # the names may be any, also those used below
    runs = runs.select(*[F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`")), F.lit("")).alias(k) for k, c in zip(keys, names, strict=True)], "run", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS)).cast("int").alias("part"))
    runs = materialize(runs, "runs")
    counts = materialize(runs.groupBy(*keys).agg(F.sum(F.size("run")).cast("long").alias("n"), F.collect_set("part").alias("parts")), "counts")
    rank = lambda p: ((F.col("n") * p + 99) / 100).cast("long")
    ps = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), rank(p).alias("k")) for p in percents])).alias("__x")
    null = F.lit(None).cast("long")
    targets = counts.select(*keys, "parts", "n", ps).select(*keys, "parts", F.col("__x.p").alias("p"), F.col("__x.k").alias("k"), null.alias("lo"), null.alias("hi"), F.col("n").alias("left"))
    done, few, open_ = [], [], counts.count()
    while open_:
        proposed = _per_run(runs, targets.withColumn("pivot", null), keys, False, open_).withColumnsRenamed({"a": "w", "b": "m"})
        pivoted = materialize(_join(targets, _weighted_median(proposed, keys), [*keys, "p"]), "pivots")
        counted = _per_run(runs, pivoted, keys, True, open_).groupBy(*keys, "p").agg(F.sum("a").alias("lt"), F.sum("b").alias("eq"))
        below, above = F.col("k") <= F.col("lt"), F.col("k") > F.col("lt") + F.col("eq")
        step = materialize(_join(pivoted, counted, [*keys, "p"]).select(
            *keys, "p", "parts", "pivot", (~below & ~above).alias("hit"),
            F.when(below, F.col("k")).otherwise(F.col("k") - F.col("lt") - F.col("eq")).alias("k"),
            F.when(below, F.col("lt")).otherwise(F.col("left") - F.col("lt") - F.col("eq")).alias("left"),
            F.when(below, F.col("lo")).otherwise(F.col("pivot")).alias("lo"),
            F.when(below, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
        ), "step")
        done.append(step.filter("hit").select(*keys, "p", F.col("pivot").alias("value")))
        rest = step.filter("NOT hit").drop("hit", "pivot")
        few.append(rest.filter(F.col("left") <= last))
        targets = rest.filter(F.col("left") > last)
        open_ = targets.count()
    if not done:
        return counts.select(*[F.col(k).alias(c) for k, c in zip(keys, names, strict=True)], "n", *[null.alias(f"p{p}") for p in percents])
    # what is left of all ranges is read out in one go
    small = reduce(DataFrame.unionByName, few).groupBy(*keys).agg(F.first("parts").alias("parts"), F.collect_list(F.struct("p", "k", "lo", "hi")).alias("__t"))
    small = materialize(small, "few")
    inside = lambda t: F.filter("run", lambda x: (t["lo"].isNull() | (x > t["lo"])) & (t["hi"].isNull() | (x < t["hi"])))
    read = _beside(runs, small, keys, small.count()).select(*keys, "run", F.explode("__t").alias("t")).select(*keys, F.col("t.p").alias("p"), F.col("t.k").alias("k"), F.explode(inside(F.col("t"))).alias("x"))
    ends = read.groupBy(*keys, "p").agg(F.first("k").alias("k"), F.array_sort(F.collect_list("x")).alias("v"))  # at most ``last`` values
    done.append(ends.select(*keys, "p", F.element_at("v", F.col("k").cast("int")).alias("value")))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    wide = every.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{p}") for p in percents])
    plain = [F.when(F.col(k) != "", F.substring(k, 2, 2147483647)).alias(c) for k, c in zip(keys, names, strict=True)]
    return _join(counts, wide, keys).select(*plain, "n", *[f"p{p}" for p in percents])


def file_metrics(live: DataFrame) -> DataFrame:
    """(table_path, part, metric, value) of the known sizes and record counts of live files."""
    pair = F.explode(F.array(F.struct(F.lit("size").alias("metric"), F.col("size").alias("value")), F.struct(F.lit("numRecords").alias("metric"), F.col("numRecords").alias("value")))).alias("x")
    return live.select("table_path", "part", pair).select("table_path", "part", "x.metric", "x.value").filter(F.col("value").isNotNull())


KEYS = ["table_path", "part", "metric"]


def file_percentiles(live: DataFrame) -> DataFrame:
    return percentiles(sorted_runs(file_metrics(live), KEYS), KEYS)


def skewed_groups(p: DataFrame, at_least: int = 20, times: int = 10) -> DataFrame:
    """Groups with a 95th percentile of at least ``times`` the median."""
    return p.filter((F.col("n") >= at_least) & (F.col("p95") >= times * F.col("p50"))).select(*KEYS)
