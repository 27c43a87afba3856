"""Reading a table's change feed, and finding out what of it can be read."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ChangeFeedError, VersionNotFoundError
from ..operators.versions import change_feed_status, version_ranges
from ..storage.table import LakeTable

FEED = [("_change_type", T.StringType()), ("_commit_version", T.LongType()), ("_commit_timestamp", T.TimestampType())]


def read_changes(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """All changes of the inclusive version range: the table's columns with ``_change_type``,
    ``_commit_version`` and ``_commit_timestamp``.

    Commits that only add files are inserts, others have change files. Fails if a commit file is gone, if
    the feed was off anywhere in the range, or if a change file is gone.
    """
    table = LakeTable.for_path(spark, path)
    log = table.log
    commits = set(log.commits())
    if end > log.latest():
        raise VersionNotFoundError(end, log.earliest(), log.latest())
    gone = [v for v in range(start, end + 1) if v not in commits]
    if gone:
        raise VersionNotFoundError(gone[0], log.earliest(), log.latest())
    off = [r["version"] for r in _status(table, start, end).filter(~F.col("enabled")).collect()]
    if off:
        raise ChangeFeedError(f"the change feed was not enabled at versions {off[:10]}")
    acts = log.actions(start, end)
    per = acts.groupBy("version").agg(F.max(F.col("cdc").isNotNull()).alias("has_cdc"), F.max("commitInfo.timestamp").alias("ts"))
    files = acts.join(per, "version").filter(F.when(F.col("has_cdc"), F.col("cdc").isNotNull()).otherwise(F.col("add.dataChange") | F.col("remove.dataChange")))
    rows = files.select("version", "ts", "has_cdc", F.coalesce("cdc.path", "add.path", "remove.path").alias("path"), F.col("remove").isNotNull().alias("removed")).collect()
    meta = log.metadata(end)
    schema, parts = table._schema(meta), meta["partitionColumns"]
    missing = [r["path"] for r in rows if r["has_cdc"] and not log.files.exists(f"{table.path}/{r['path']}")]
    if missing:
        raise ChangeFeedError(f"change files are gone: {missing[:5]}")
    # version and time come from a small table of files, so there is one scan however many commits
    out = []
    for kind, base in (("cdc", "_change_data"), ("add", ""), ("remove", "")):
        some = [r for r in rows if (r["has_cdc"] if kind == "cdc" else not r["has_cdc"] and r["removed"] == (kind == "remove"))]
        if not some:
            continue
        full = T.StructType([*schema.fields, *([T.StructField("_change_type", T.StringType())] if kind == "cdc" else [])])
        data = table.read_files([r["path"] for r in some], full, parts, identity=True, base=base)
        if kind != "cdc":
            data = data.withColumn("_change_type", F.lit("insert" if kind == "add" else "delete"))
        index = spark.createDataFrame([(r["path"], r["version"], r["ts"]) for r in some], "path string, version long, ts long")
        stem = F.element_at(F.split("path", "/"), -1)
        index = index.select(stem.alias("__name"), F.col("version").alias("_commit_version"), F.timestamp_millis("ts").alias("_commit_timestamp")).distinct()  # files of one write share a name in each partition
        named = data.withColumn("__name", F.element_at(F.split("__file", "/"), -1))
        out.append(named.join(index, "__name").select(*schema.names, *[n for n, _ in FEED]))
    if not out:
        return spark.createDataFrame([], T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in FEED]]))
    return reduce(DataFrame.unionByName, out)


def _status(table: LakeTable, start: int, end: int) -> DataFrame:
    """(version, enabled) within a range; metadata before the range counts."""
    acts = table.log.actions(0, end)
    status = change_feed_status(acts)
    first = table.log.commits()[0]
    if first > 0:
        base = table.log._state_base(end)
        before = table.change_feed_on(base) if base >= 0 else True
        # versions before any metadata that is left take the oldest known status
        known = acts.filter(F.col("metaData").isNotNull()).agg(F.min("version")).first()[0]
        status = status.withColumn("enabled", F.when((F.col("version") < known) if known is not None else F.lit(True), F.lit(before)).otherwise(F.col("enabled")))
    return status.filter(F.col("version").between(start, end))


@dataclass(frozen=True)
class ChangeFeed:
    """The change feed of a version range (both ends inclusive) of a table, and what is left of it."""

    path: str
    start: int
    end: int

    @classmethod
    def of(cls, path: str, start: int, end: int | None = None) -> ChangeFeed:
        """Up to the latest version unless an end is given."""
        return cls(path, start, LakeTable.for_path(_spark(), path).version() if end is None else end)

    @property
    def _table(self) -> LakeTable:
        return LakeTable.for_path(_spark(), self.path)

    # ------------------------------------------------------------ reading

    def read(self) -> DataFrame:
        return read_changes(_spark(), self.path, self.start, self.end)

    def read_enabled_ranges(self) -> DataFrame | None:
        """The changes of all ranges in which the feed was on."""
        ranges = self.enabled_ranges()
        if ranges is None:
            return None
        parts = [read_changes(_spark(), self.path, a, b) for a, b in ranges]
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)

    def read_available_log(self) -> DataFrame | None:
        """The changes of the versions whose commits are left."""
        found = self.available_log_versions()
        return read_changes(_spark(), self.path, *found) if found else None

    def read_available_changes(self) -> DataFrame | None:
        """The changes of the versions whose change files are left."""
        found = self.available_change_versions()
        return read_changes(_spark(), self.path, *found) if found else None

    # ------------------------------------------------------------ what is there

    def dry_run(self) -> ChangeFeed:
        """Itself, if commits, change files and the feed's status all allow the whole range."""
        log, cdc, ranges = self.available_log_versions(), self.available_change_versions(), self.enabled_ranges()
        if log is None or cdc is None or ranges is None:
            raise ChangeFeedError(f"the range cannot be read: commits {log}, change files {cdc}, enabled ranges {ranges}")
        want = (self.start, self.end)
        wanted_cdc = {want, (1, self.end)} if self.start == 0 else {want}
        assert log == want, f"commits are left for {log}, not for {want}"
        assert cdc in wanted_cdc, f"change files are left for {cdc}, not for {want}"
        assert ranges == [want], f"the feed was enabled in {ranges}, not in {want}"
        return self

    def earliest_commit_versions(self) -> tuple[int, int] | None:
        """The requested range if its first commit file is there, else earliest and latest commit."""
        return self._log_versions(False)

    def available_log_versions(self) -> tuple[int, int] | None:
        """The same for versions whose state can be recreated."""
        return self._log_versions(True)

    def _log_versions(self, recreatable: bool) -> tuple[int, int] | None:
        table = self._table
        try:
            table.log.check_version(self.start, recreatable)
            if not recreatable and self.start not in table.log.commits():
                raise VersionNotFoundError(self.start, table.log.earliest(), table.log.latest())
        except VersionNotFoundError as e:
            return (e.earliest, e.latest)
        on = {r["version"]: r["enabled"] for r in _status(table, self.start, self.end).collect()}
        return (self.start, self.end) if on.get(self.start) and on.get(self.end) else None

    def status(self) -> list[tuple[int, bool]]:
        """(version, whether the feed was on) of each version."""
        return [(r["version"], r["enabled"]) for r in _status(self._table, self.start, self.end).orderBy("version").collect()]

    def enabled_versions(self) -> list[int]:
        return [v for v, on in self.status() if on]

    def disabled_versions(self) -> list[int]:
        return [v for v, on in self.status() if not on]

    def _ranges(self, on: bool) -> list[tuple[int, int]] | None:
        some = _status(self._table, self.start, self.end).filter(F.col("enabled") == on)
        found = [(r["first"], r["last"]) for r in version_ranges(some).orderBy("first").collect()]
        return found if sum(b - a + 1 for a, b in found) > 1 else None

    def enabled_ranges(self) -> list[tuple[int, int]] | None:
        """Ranges of versions with the feed on; None for fewer than two versions."""
        return self._ranges(True)

    def disabled_ranges(self) -> list[tuple[int, int]] | None:
        return self._ranges(False)

    def available_change_versions(self) -> tuple[int, int] | None:
        """The range from the first version whose change files are there. Commits that need none (plain
        inserts, merges without effect, changed properties) are passed over; a commit that changed rows
        without change files, because the feed was off, is an ``AssertionError``."""
        table = self._table
        first = 1 if self.start == 0 and self.end > 1 else self.start
        last = max(self.end - 1, first)  # the end itself is not probed
        acts = table.log.actions(first, last)
        per = acts.groupBy("version").agg(
            F.first("cdc.path", ignorenulls=True).alias("cdc"), F.max(F.col("add").isNotNull()).alias("adds"), F.max(F.col("remove").isNotNull()).alias("removes"),
            F.max(F.coalesce(F.col("add.dataChange"), F.col("remove.dataChange"))).alias("data"),
        )
        for r in per.orderBy("version").toLocalIterator():
            if r["cdc"] is None:
                assert not (r["removes"] and r["data"]), "Insert/Update/Delete has happened but cdc column is not present"
                if r["adds"] and not r["removes"] and r["data"]:
                    return (r["version"], self.end)  # inserts are read from the data files
                continue
            if table.log.files.exists(f"{table.path}/{r['cdc']}"):
                return (r["version"], self.end)
        return None

    def between(self, start: int, end: int) -> ChangeFeed:
        return replace(self, start=start, end=end)


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
