"""The commit log of a table: one JSON file of actions per version, Parquet checkpoints of the replayed
state, all read as DataFrames with one explicit schema."""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableNotFoundError, VersionNotFoundError
from ..sources.files import FileStore

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()
_MAP = T.MapType(_S, _S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ADD = _struct(path=_S, partitionValues=_MAP, size=_L, modificationTime=_L, dataChange=_B, stats=_S)
REMOVE = _struct(path=_S, deletionTimestamp=_L, dataChange=_B)
CDC = _struct(path=_S, partitionValues=_MAP, size=_L, dataChange=_B)
META = _struct(id=_S, schemaString=_S, partitionColumns=T.ArrayType(_S), configuration=_MAP, createdTime=_L)
INFO = _struct(timestamp=_L, operation=_S, operationParameters=_MAP, operationMetrics=_MAP, readVersion=_L)
ACTION = _struct(commitInfo=INFO, metaData=META, add=ADD, remove=REMOVE, cdc=CDC)
STATS = _struct(numRecords=_L, minValues=_MAP, maxValues=_MAP, nullCount=_MAP)
LIVE = _struct(path=_S, partitionValues=_MAP, size=_L, modificationTime=_L, dataChange=_B, stats=_S)

CHECKPOINT_EVERY = 10
_COMMIT = re.compile(r"^(\d{20})\.json$")
_CHECKPOINT = re.compile(r"^(\d{20})\.checkpoint\.parquet$")


class Log:
    """Reads and writes the log below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), FileStore(spark)
        self.dir = f"{self.path}/_delta_log"

    # ------------------------------------------------------------ versions

    def _numbers(self, pattern: re.Pattern) -> list[int]:
        return sorted(int(m[1]) for n in self.files.names(self.dir) if (m := pattern.match(n)))

    def commits(self) -> list[int]:
        return self._numbers(_COMMIT)

    def checkpoints(self) -> list[int]:
        return [v for v in self._numbers(_CHECKPOINT) if self.files.exists(f"{self.dir}/{v:020d}.checkpoint.parquet/_SUCCESS")]

    def exists(self) -> bool:
        return bool(self.commits() or self.checkpoints())

    def latest(self) -> int:
        """The newest version."""
        found = self.commits()[-1:] + self.checkpoints()[-1:]
        if not found:
            raise TableNotFoundError(f"There is no table at {self.path}")
        return max(found)

    def earliest(self, recreatable: bool = False) -> int:
        """The oldest version with a commit file, or whose state can be recreated."""
        commits, marks = self.commits(), self.checkpoints()
        if not commits and not marks:
            raise TableNotFoundError(f"There is no table at {self.path}")
        if not recreatable:
            return commits[0] if commits else marks[0]
        if commits and commits[0] == 0:
            return 0
        if not marks:
            raise VersionNotFoundError(0, commits[0], commits[-1])
        return marks[0]

    def check_version(self, version: int, recreatable: bool = True) -> None:
        first, last = self.earliest(recreatable), self.latest()
        if not first <= version <= last:
            raise VersionNotFoundError(version, first, last)

    # ------------------------------------------------------------ actions

    def actions(self, start: int = 0, end: int | None = None) -> DataFrame:
        """(version, commitInfo, metaData, add, remove, cdc) of the commit files in the inclusive range,
        one row per action. One scan, whatever the number of versions; files that are gone are skipped."""
        names = [v for v in self.commits() if v >= start and (end is None or v <= end)]
        if not names:
            return self.spark.createDataFrame([], T.StructType([T.StructField("version", _L), *ACTION.fields]))
        paths = [f"{self.dir}/{v:020d}.json" for v in names]
        version = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long")
        return self.spark.read.schema(ACTION).json(paths).select(version.alias("version"), *ACTION.names)

    def _state_base(self, version: int) -> int:
        return max((c for c in self.checkpoints() if c <= version), default=-1)

    def live_files(self, version: int | None = None) -> DataFrame:
        """Live files at a version (path, partitionValues, size, modificationTime, dataChange, stats)."""
        version = self.latest() if version is None else version
        self.check_version(version)
        base = self._state_base(version)
        acts = self.actions(base + 1, version)
        # a commit never adds and removes the same path: every write makes a new file
        adds = acts.filter(F.col("add").isNotNull()).select("add.path", "version", F.lit(True).alias("live"), F.col("add").alias("f"))
        gone = acts.filter(F.col("remove").isNotNull()).select("remove.path", "version", F.lit(False).alias("live"), F.lit(None).cast(LIVE).alias("f"))
        every = adds.unionByName(gone)
        if base >= 0:
            saved = self.spark.read.schema(LIVE).parquet(f"{self.dir}/{base:020d}.checkpoint.parquet/files")
            every = every.unionByName(saved.select("path", F.lit(base).cast("long").alias("version"), F.lit(True).alias("live"), F.struct(*LIVE.names).alias("f")))
        newest = every.groupBy("path").agg(F.max_by(F.struct("live", "f"), "version").alias("x")).filter("x.live")
        return newest.select("x.f.*")

    def metadata(self, version: int | None = None) -> dict:
        """Schema, partition columns and properties at a version."""
        version = self.latest() if version is None else version
        self.check_version(version)
        base = self._state_base(version)
        found = self.actions(base + 1, version).filter(F.col("metaData").isNotNull()).agg(F.max_by("metaData", "version")).first()[0]
        if found is not None:
            meta = found.asDict(recursive=True)
        else:
            meta = json.loads(self.files.read_text(f"{self.dir}/{base:020d}.checkpoint.parquet/metadata.json"))
        return meta | {"configuration": meta.get("configuration") or {}, "partitionColumns": meta.get("partitionColumns") or []}

    def history(self, start: int = 0, end: int | None = None) -> DataFrame:
        """Commits, newest first."""
        info = self.actions(start, end).filter(F.col("commitInfo").isNotNull()).select("version", "commitInfo.*")
        return info.withColumn("timestamp", F.timestamp_millis("timestamp")).orderBy(F.desc("version"))

    # ------------------------------------------------------------ writing

    def commit(self, version: int, operation: str, actions: list[dict], parameters: dict | None = None, metrics: dict | None = None) -> int:
        """Publish a version. Fails with ``ConcurrentCommitError`` if it exists already."""
        info = {
            "timestamp": int(time.time() * 1000), "operation": operation, "readVersion": version - 1,
            "operationParameters": {k: str(v) for k, v in (parameters or {}).items()},
            "operationMetrics": {k: str(v) for k, v in (metrics or {}).items()},
        }
        lines = [{"commitInfo": info}, *actions]
        self.files.create(f"{self.dir}/{version:020d}.json", "\n".join(json.dumps(x) for x in lines) + "\n")
        if version and version % CHECKPOINT_EVERY == 0:
            self.checkpoint(version)
        return version

    def checkpoint(self, version: int) -> None:
        """Save the replayed state of a version."""
        where = f"{self.dir}/{version:020d}.checkpoint.parquet"
        if self.files.exists(f"{where}/_SUCCESS"):
            return
        self.live_files(version).write.mode("overwrite").parquet(f"{where}/files")
        meta = f"{where}/metadata.json"
        if not self.files.exists(meta):
            self.files.create(meta, json.dumps(self.metadata(version)))
        self.files.create(f"{where}/_SUCCESS", "")
