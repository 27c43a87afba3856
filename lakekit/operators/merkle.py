"""Incremental processing with Merkle trees over key ranges.

A tree holds one digest per leaf (one key range of one tree key) and one per inner node. Comparing the
tree of the data as it is now with the tree saved by the last successful run, only nodes whose digests
differ are opened; saved records are read again only for leaves that changed. Output and tree are
published together, so a run that fails half-way leaves the saved state as it was.

Null handling: rows whose tree key or range column is null belong to no leaf and are left out; nulls in
any other hashed column are part of the digest. Empty input gives an empty tree.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import materialize, salted_join, shared_dir
from ..errors import ConcurrentCommitError
from ..sources.files import FileStore

FANOUT = 64
PRUNING_NODES = 64  # nodes that are turned into a filter on saved records, at most
MERGE_AFTER = 16  # folders of saved records, at most


def _digest(n: Column, x: Column, s: Column) -> list[Column]:
    return [F.sum(n).alias("n"), F.expr("bit_xor(__x)").alias("x"), F.sum(s).alias("s")]


def row_hash(columns: list[str]) -> Column:
    """128-bit hash of a row, as two longs. Which columns are null is hashed too, as a null alone leaves the
    hash as it was."""
    nulls = F.concat(F.lit(""), *[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in columns])
    texts = [F.col(f"`{c}`").cast("string") for c in columns]
    return F.struct(F.xxhash64(*texts, nulls).alias("a"), F.xxhash64(F.lit("second"), nulls, *texts).alias("b"))


def leaf_digests(hashed: DataFrame, tree_key: list[str]) -> DataFrame:
    """(tree key, block, n, x, s): row count, xor and bounded sum of the hashes ``__row`` of each leaf.
    Combined on the map side, so a leaf that holds most rows costs no more than any other."""
    one = hashed.select(*tree_key, "block", F.col("__row.a").alias("__x"), F.pmod("__row.b", F.lit(1 << 40)).alias("__s"))
    return one.groupBy(*tree_key, "block").agg(*_digest(F.lit(1), F.col("__x"), F.col("__s")))


def build_nodes(leaves: DataFrame, tree_key: list[str], height: int, fanout: int = FANOUT) -> DataFrame:
    """(tree key, level, block, n, x, s) of all nodes. Level 0 are the leaves; a node of level k covers
    ``fanout`` neighbouring nodes of level k-1 and its digest is made of those of the leaves below it, so
    one shuffle, combined on the map side, gives all levels."""
    h = F.xxhash64("block", "n", "x", "s")
    inner = leaves.select(*tree_key, F.explode(F.sequence(F.lit(1), F.lit(height))).alias("level"), "block", "n", h.alias("__x"), F.pmod(F.xxhash64("x", "block", "s"), F.lit(1 << 40)).alias("__s"))
    inner = inner.withColumn("block", F.floor(F.col("block") / F.pow(F.lit(float(fanout)), F.col("level"))).cast("long"))
    nodes = inner.groupBy(*tree_key, "level", "block").agg(*_digest(F.col("n"), F.col("__x"), F.col("__s")))
    return nodes.unionByName(leaves.select(*tree_key, F.lit(0).alias("level"), "block", "n", "x", "s"))


def changed_leaves(current: DataFrame, saved: DataFrame, tree_key: list[str], height: int, fanout: int = FANOUT) -> DataFrame:
    """(tree key, block) of the leaves that differ or are in one tree only. Goes down from the top; below a
    node whose digests agree nothing is compared."""
    tag = lambda t, k: t.select(*tree_key, "level", "block", F.struct("n", "x", "s").alias("d"), F.lit(k).alias("k"))
    both = materialize(tag(current, 1).unionByName(tag(saved, 2)), "nodes", ["level"])
    wanted = None
    for level in range(height, -1, -1):
        here = both.filter(F.col("level") == level)
        if wanted is not None:
            here = here.withColumn("__up", F.floor(F.col("block") / fanout).cast("long")).join(wanted.withColumnRenamed("block", "__up"), [*tree_key, "__up"], "left_semi")
        sides = here.groupBy(*tree_key, "block").agg(F.count("*").alias("__n"), F.min("d").alias("__a"), F.max("d").alias("__b"))
        wanted = sides.filter((F.col("__n") < 2) | (F.col("__a") != F.col("__b"))).select(*tree_key, "block")
    return wanted


def tree_height(*leaves: DataFrame, fanout: int = FANOUT) -> int:
    """Levels above the leaves, so that few nodes are at the top."""
    top = reduce(DataFrame.unionByName, [t.select("block") for t in leaves]).agg(F.max(F.abs("block"))).first()[0] or 0
    height = 1
    while top >= fanout:
        top, height = top // fanout, height + 1
    return height


# ---------------------------------------------------------------- a saved tree as the state


@dataclass
class Pending:
    """What a run would take: ``due`` (added or changed records), ``removed`` (hashes of records that went,
    with their leaf), and the state that publishing brings about."""

    due: DataFrame
    removed: DataFrame
    leaves: DataFrame
    rows: DataFrame
    folders: list[str]
    attempt: str
    generation: int  # the one it was compared with


class MerkleTracker:
    """Takes exactly the records added or changed since the last published run.

    Records of changed leaves are compared with the records of the same leaves in the last published run.
    With ``copies`` a value that comes back or one more copy of a record is due; without, a record is due
    if no copy of it was there. Records that went are reported apart.

    State under ``path``: ``attempt=<id>/{output,removed,leaves,rows}`` of every run and ``commits/N.json``,
    which names the attempt that became generation N and the folders that hold its records; a changed
    leaf's records are written anew, others stay where they are until there are ``MERGE_AFTER`` folders.
    An attempt counts only once its commit file exists, which is created exclusively after all its data:
    output, tree and records appear together or not at all, and of two runs that race one fails with
    ``ConcurrentCommitError`` without having touched anything of the other.
    """

    def __init__(self, spark: SparkSession, path: str, tree_key: list[str], range_col: str, width: int = 1, copies: bool = True):
        self.spark, self.path, self.tree_key, self.range_col, self.width, self.copies = spark, path.rstrip("/"), tree_key, range_col, width, copies
        self.files = FileStore(spark)

    def generation(self) -> int:
        """The last published generation, -1 before the first."""
        names = self.files.names(f"{self.path}/commits")
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=-1)

    def _commit(self, generation: int) -> dict:
        return json.loads(self.files.read_text(f"{self.path}/commits/{generation}.json"))

    def output(self, generation: int) -> DataFrame:
        """What a published run took."""
        return self.spark.read.parquet(f"{self.path}/attempt={self._commit(generation)['attempt']}/output")

    def removed(self, generation: int) -> DataFrame:
        """Hashes of the records that were gone in a published run."""
        return self.spark.read.parquet(f"{self.path}/attempt={self._commit(generation)['attempt']}/removed")

    def _hashed(self, df: DataFrame) -> DataFrame:
        block = F.floor(F.col(f"`{self.range_col}`") / self.width).cast("long")
        return df.withColumns({"block": block, "__row": row_hash(sorted(df.columns))}).dropna(subset=[*self.tree_key, "block"])

    def _saved_rows(self, folders: list[str], changed: DataFrame, height: int) -> DataFrame:
        """Saved records, of their files only those that can hold one of the changed leaves: the lowest level
        with at most ``PRUNING_NODES`` changed nodes becomes a filter on what is read."""
        rows = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/attempt={f}/rows") for f in folders])
        up = [F.floor(F.col("block") / FANOUT**k).cast("long") for k in range(height + 1)]
        sizes = changed.agg(*[F.count_distinct(*self.tree_key, u) for u in up]).first()
        level = next((k for k, n in enumerate(sizes) if n <= PRUNING_NODES), None)
        if level is None:  # the filter only saves reading; the join with the leaves decides
            return rows
        span = FANOUT**level
        found = changed.select(*self.tree_key, up[level].alias("block")).distinct().collect()
        here = F.lit(False)
        for r in found:
            one = F.col("block").between(r["block"] * span, (r["block"] + 1) * span - 1)
            for k in self.tree_key:
                one = one & (F.col(f"`{k}`") == F.lit(r[k]))
            here = here | one
        return rows.filter(here)

    def pending(self, df: DataFrame) -> Pending:
        gen, leaf, attempt = self.generation(), [*self.tree_key, "block"], uuid.uuid4().hex
        hashed = self._hashed(df)
        leaves = materialize(leaf_digests(hashed, self.tree_key), "tree")
        folders: list[str] = []
        old = None
        if gen >= 0:
            commit = self._commit(gen)
            folders = commit["folders"]
            saved = self.spark.read.parquet(f"{self.path}/attempt={commit['attempt']}/leaves")
            height = tree_height(leaves, saved)
            now, then = (build_nodes(t.select(*leaf, "n", "x", "s"), self.tree_key, height) for t in (leaves, saved))
            changed = materialize(changed_leaves(now, then, self.tree_key, height), "changed")
            merge = len(folders) >= MERGE_AFTER
            kept = saved.join(changed, leaf, "left_anti") if not merge else saved.limit(0)
            hashed = hashed.join(changed, leaf, "left_semi") if not merge else hashed
            leaves = leaves.join(kept.select(*leaf, "kept"), leaf, "left").withColumn("kept", F.coalesce("kept", F.lit(attempt)))
            where = saved.join(changed, leaf, "left_semi").select(*leaf, "kept")
            old = self._saved_rows(folders, changed, height).join(where, [*leaf, "kept"], "left_semi").select(*leaf, "__row", F.col("copies").alias("__old"))
            folders = [attempt] if merge else [*folders, attempt]
        else:
            leaves, folders = leaves.withColumn("kept", F.lit(attempt)), [attempt]
        # copies are counted on the map side, so a row repeated very often costs no more than others
        counted = hashed.groupBy(*leaf, "__row").agg(F.count("*").alias("copies"), F.first(F.struct(*[f"`{c}`" for c in df.columns])).alias("__record"))
        counted = materialize(counted, "counted")
        rows = counted.select(*leaf, "__row", "copies", F.lit(attempt).alias("kept"))
        gone = rows.limit(0).select(*leaf, "__row", "copies")
        if old is None:
            due = counted.withColumn("__more", F.col("copies"))
        else:
            if merge:  # what did not change is not due
                counted = counted.join(changed, leaf, "left_semi")
            both = (counted.select(*leaf, "__row", "copies", "__record").join(old, [*leaf, "__row"], "full"))
            due = both.withColumn("__more", F.coalesce("copies", F.lit(0)) - F.coalesce("__old", F.lit(0)))
            less = -F.col("__more") if self.copies else F.when(F.col("copies").isNull(), F.col("__old")).otherwise(0)
            gone = due.withColumn("__less", less).filter("__less > 0").select(*leaf, "__row", F.col("__less").alias("copies"))
            if not self.copies:
                due = due.filter(F.col("__old").isNull())
        times = F.sequence(F.lit(1), F.col("__more").cast("int")) if self.copies else F.array(F.lit(1))
        due = due.filter("__more > 0").select("__record", F.explode(times)).select("__record.*")
        return Pending(due, gone, leaves, rows, folders, attempt, gen)

    def seed(self, df: DataFrame) -> None:
        """Publish records that were taken before there was a tracker: a first run without output."""
        p = self.pending(df)
        p.due = p.due.limit(0)
        self.publish(p)

    def publish(self, p: Pending) -> DataFrame:
        """Publish a run's output with the state it brings about; returns the output as published."""
        root = f"{self.path}/attempt={p.attempt}"
        p.due.write.parquet(f"{root}/output")
        p.removed.write.parquet(f"{root}/removed")
        # in order of leaves, so that a filter on them skips files and row groups
        p.rows.repartitionByRange(*self.tree_key, "block", "__row.a").sortWithinPartitions(*self.tree_key, "block").write.parquet(f"{root}/rows")
        p.leaves.write.parquet(f"{root}/leaves")
        try:
            self.files.create(f"{self.path}/commits/{p.generation + 1}.json", json.dumps({"attempt": p.attempt, "folders": p.folders}))
        except ConcurrentCommitError:
            self.files.delete_folder(root)
            raise
        return self.spark.read.schema(p.due.schema).parquet(f"{root}/output")

    def run(self, df: DataFrame) -> DataFrame:
        """One run: what is due is published and returned."""
        return self.publish(self.pending(df))


# ---------------------------------------------------------------- a log of runs as the saved state


def run_coverage(runs: DataFrame, points: DataFrame) -> DataFrame:
    """(table_path, _commit_version, covered_at): the latest start of a successful run that covers the
    version; null where none does.

    Each run's inclusive range is cut into aligned power-of-two blocks (at most two per level), each
    version looks up its own block of every level. The work grows with rows times the logarithm of the
    range, whatever the overlap; there is no join of versions with runs of the same table. Runs with a
    missing bound, start or table, or with reversed bounds, cover nothing.
    """
    good = runs.filter(F.lower(F.trim("status")) == "succeeded").select("table_path", F.col("startingVersion").alias("s"), (F.col("endingVersion") + 1).alias("e"), "started_at")
    good = good.dropna().filter(F.col("s") < F.col("e"))
    # highest level that a range can use
    top = F.ceil(F.log2((F.col("e") - F.col("s")).cast("double"))).cast("int")
    levels = good.withColumn("level", F.explode(F.sequence(F.lit(0), top)))
    lo = F.expr("shiftright(s + shiftleft(1L, level) - 1, level)")
    hi = F.expr("shiftright(e, level)")
    blocks = levels.select("table_path", "level", "started_at", lo.alias("lo"), hi.alias("hi")).filter("lo < hi")
    picked = F.array_compact(F.array(F.when(F.col("lo") % 2 != 0, F.col("lo")), F.when(F.col("hi") % 2 != 0, F.col("hi") - 1)))
    cover = blocks.select("table_path", "level", "started_at", F.explode(picked).alias("block")).groupBy("table_path", "level", "block").agg(F.max("started_at").alias("covered_at"))
    most = good.agg(F.max(top)).first()[0]
    versions = points.select("table_path", "_commit_version").dropna().distinct()
    up = versions.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(int(most or 0)))))
    up = up.withColumn("block", F.expr("shiftright(_commit_version, level)"))
    found = up.join(cover, ["table_path", "level", "block"], "left")
    return found.groupBy("table_path", "_commit_version").agg(F.max("covered_at").alias("covered_at"))


def due_changes(changes: DataFrame, runs: DataFrame, id_col: str = "id", path: str | None = None) -> DataFrame:
    """Changes that no successful run has taken: (table_path, id, _commit_version), one row each.

    A row is taken if it had landed (``landed_at``) when a successful run covering its version started. The
    state that those runs left, their rows and the tree over them (a leaf is one commit of a table), is
    published as the first generation of a tracker under ``path``; the run over all rows is the next one:
    it opens the nodes that differ, compares the changes of the commits below them with the saved ones and
    publishes what is due together with the tree. A tracker that is there already goes on from its own
    state. A change counts as due if none of its rows was taken. Rows without table, id or version don't
    count; a row without ``landed_at`` was never taken. Repeated rows are one change.
    """
    spark = changes.sparkSession
    keys, columns = ["table_path", "_commit_version"], ["table_path", id_col, "_commit_version"]
    rows = changes.select(*columns, "landed_at").dropna(subset=columns)
    tracker = MerkleTracker(spark, path or shared_dir(spark, "runs"), ["table_path"], "_commit_version", copies=False)
    if tracker.generation() < 0:
        cover = materialize(run_coverage(runs, rows), "coverage").filter(F.col("covered_at").isNotNull())
        taken = salted_join(rows, cover, keys, [id_col], "inner").filter(F.col("landed_at") <= F.col("covered_at"))
        tracker.seed(taken.select(*columns))
    return tracker.run(rows.select(*columns))
