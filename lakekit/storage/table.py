"""Versioned tables of Parquet files: reading, writing, updating, properties and history.

A commit's data files go to ``<path>/__commit=<id>/[k=v/]part-*.parquet`` and become visible with the
commit file; nothing is ever overwritten in place. The log, not the path, says which file belongs to the
table and to which partition.
"""

from __future__ import annotations

import json
import time
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import materialize
from ..constants import CHANGE_FEED_PROPERTY
from ..errors import ConcurrentCommitError, TableExistsError, TableNotFoundError, ValidationError
from ..sources.files import FileStore
from .log import STATS, Log

STATS_COLUMNS = 32
FILE, ROW, COMMIT = "__file", "__row", "__commit"
_ORDERED = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)
SESSION_DEFAULT = "spark.lakekit.defaults.enableChangeDataFeed"


def _name_path(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name.split('.')[-1]}"


class LakeTable:
    """Handle on a table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(spark, self.path)

    # ------------------------------------------------------------ finding and making tables

    @classmethod
    def for_path(cls, spark: SparkSession, path: str) -> LakeTable:
        table = cls(spark, path)
        if not table.log.exists():
            raise TableNotFoundError(f"There is no table at {path}")
        return table

    @classmethod
    def for_name(cls, spark: SparkSession, name: str) -> LakeTable:
        """A table by its name: a folder of the warehouse, or the location it was registered with."""
        path, files = _name_path(spark, name), FileStore(spark)
        if files.exists(link := f"{path}.location"):
            path = files.read_text(link).strip()
        return cls.for_path(spark, path)

    @classmethod
    def register(cls, spark: SparkSession, name: str, path: str) -> LakeTable:
        """Give a table at a path a name."""
        table = cls.for_path(spark, path)
        FileStore(spark).create(f"{_name_path(spark, name)}.location", path)
        return table

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, schema: T.StructType | str = "", partition_by: list[str] | None = None, properties: dict | None = None, name: str | None = None) -> LakeTable:
        """An empty table: a commit of metadata only."""
        table = cls(spark, path or _name_path(spark, name))
        if table.log.exists():
            raise TableExistsError(f"There is a table at {table.path}")
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        table.log.commit(0, "CREATE TABLE", [table._metadata(schema, partition_by or [], properties or {})], {"isManaged": name is not None})
        return table

    @classmethod
    def write(cls, df: DataFrame, path: str | None = None, mode: str = "error", partition_by: list[str] | None = None, properties: dict | None = None, name: str | None = None, merge_schema: bool = False, max_records: int = 0, read_version: int | None = None) -> LakeTable:
        """Save a DataFrame. ``mode``: error (a table must not exist), append, overwrite. A DataFrame that was
        made from the table at ``read_version`` overwrites that version only: if there is a later one, the
        write fails with ``ConcurrentCommitError`` and nothing has changed."""
        if mode not in ("error", "append", "overwrite"):
            raise ValidationError(f"unknown mode {mode}")
        spark = df.sparkSession
        table = cls(spark, path or _name_path(spark, name))
        if not table.log.exists():
            if spark.conf.get(SESSION_DEFAULT, "false") == "true":
                properties = {CHANGE_FEED_PROPERTY: "true"} | (properties or {})
            schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
            meta = table._metadata(schema, partition_by or [], properties or {})
            adds, metrics = table._write_files(df, schema, partition_by or [], max_records)
            table.log.commit(0, "WRITE", [meta, *adds], {"mode": mode, "partitionBy": json.dumps(partition_by or [])}, metrics)
            return table
        if mode == "error":
            raise TableExistsError(f"There is a table at {table.path}")
        table._save(df, mode, merge_schema, max_records, read_version)
        return table

    def _metadata(self, schema: T.StructType, partition_by: list[str], properties: dict) -> dict:
        unknown = [c for c in partition_by if c not in schema.names]
        if unknown:
            raise ValidationError(f"partition columns {unknown} are not in {schema.names}")
        return {"metaData": {"id": str(uuid.uuid4()), "schemaString": schema.json(), "partitionColumns": partition_by, "configuration": {k: str(v) for k, v in properties.items()}, "createdTime": int(time.time() * 1000)}}

    def _save(self, df: DataFrame, mode: str, merge_schema: bool, max_records: int, read_version: int | None = None) -> int:
        for attempt in range(5):
            version = self.log.latest() if read_version is None else read_version
            if version != self.log.latest():
                raise ConcurrentCommitError(f"{self.path} has changed since version {version} was read")
            meta = self.log.metadata(version)
            schema, parts, actions = self._schema(meta), meta["partitionColumns"], []
            new = [f for f in df.schema if f.name not in schema.names]
            if new and not merge_schema:
                raise ValidationError(f"columns {[f.name for f in new]} are not in the table")
            if new:
                schema = T.StructType([*schema.fields, *[T.StructField(f.name, f.dataType, True) for f in new]])
                actions.append(self._metadata(schema, parts, meta["configuration"]))
            full = df.select(*[F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
            adds, metrics = self._write_files(full, schema, parts, max_records)
            removes = []
            if mode == "overwrite":
                removes = [_remove(r[0]) for r in self.files(version).select("path").toLocalIterator()]
            try:
                return self.log.commit(version + 1, "WRITE", [*actions, *removes, *adds], {"mode": mode, "partitionBy": json.dumps(parts)}, metrics)
            except ConcurrentCommitError:
                # an append of known columns reads nothing that others could have changed
                if mode != "append" or new or attempt == 4:
                    raise
        raise AssertionError

    # ------------------------------------------------------------ files

    def _write_files(self, df: DataFrame, schema: T.StructType, partition_by: list[str], max_records: int = 0, folder: str = "") -> tuple[list[dict], dict]:
        """Write data files with their statistics; returns add actions and write metrics."""
        root = f"{self.path}/{folder}{COMMIT}={uuid.uuid4().hex}"
        writer = df.write.option("maxRecordsPerFile", max_records) if max_records else df.write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(root)
        stats = [f.name for f in schema if f.name not in partition_by and isinstance(f.dataType, _ORDERED)][:STATS_COLUMNS] if not folder else []
        back = self.spark.read.schema(df.schema).option("basePath", root).parquet(root)
        # one row per file, gathered where the file is read
        measured = back.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), *[F.col(f"`{p}`").cast("string").alias(f"__p{i}") for i, p in enumerate(partition_by)]).agg(
            F.count("*").alias("n"), *[g(F.col(f"`{c}`")).cast("string").alias(f"__{k}{i}") for i, c in enumerate(stats) for k, g in (("min", F.min), ("max", F.max), ("cnt", F.count))]
        )
        now, out, rows, size = int(time.time() * 1000), [], 0, 0
        for r in measured.toLocalIterator():
            values = {p: r[f"__p{i}"] for i, p in enumerate(partition_by)}
            file = {"path": _relative(self.path, r["path"]), "partitionValues": values, "size": r["size"], "modificationTime": now, "dataChange": True}
            if not folder:
                file["stats"] = json.dumps({
                    "numRecords": r["n"],
                    "minValues": {c: r[f"__min{i}"] for i, c in enumerate(stats) if r[f"__min{i}"] is not None},
                    "maxValues": {c: r[f"__max{i}"] for i, c in enumerate(stats) if r[f"__max{i}"] is not None},
                    "nullCount": {c: str(r["n"] - int(r[f"__cnt{i}"])) for i, c in enumerate(stats)},
                })
            out.append({"add": file})
            rows, size = rows + r["n"], size + r["size"]
        return out, {"numFiles": len(out), "numOutputRows": rows, "numOutputBytes": size}

    def files(self, version: int | None = None) -> DataFrame:
        """Live files with parsed statistics."""
        return self.log.live_files(version).withColumn("stats", F.from_json("stats", STATS))

    def read_files(self, paths: list[str], schema: T.StructType, partition_by: list[str], identity: bool = False, base: str = "") -> DataFrame:
        """Rows of some data files. With ``identity`` each row carries its file and position."""
        if not paths:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumns({FILE: F.lit("").cast("string"), ROW: F.lit(0).cast("long")}) if identity else empty
        full = T.StructType([*schema.fields, T.StructField(COMMIT, T.StringType())])
        df = self.spark.read.schema(full).option("basePath", f"{self.path}/{base}").parquet(*[f"{self.path}/{p}" for p in paths])
        if identity:
            df = df.withColumns({FILE: F.col("_metadata.file_path"), ROW: F.col("_metadata.row_index")})
        return df.select(*[F.col(f"`{f.name}`") for f in schema], *([FILE, ROW] if identity else []))

    def _schema(self, meta: dict) -> T.StructType:
        return T.StructType.fromJson(json.loads(meta["schemaString"]))

    # ------------------------------------------------------------ reading

    @property
    def schema(self) -> T.StructType:
        return self._schema(self.log.metadata())

    @property
    def partition_columns(self) -> list[str]:
        return self.log.metadata()["partitionColumns"]

    @property
    def properties(self) -> dict:
        return self.log.metadata()["configuration"]

    def version(self) -> int:
        return self.log.latest()

    def to_df(self, version: int | None = None, identity: bool = False) -> DataFrame:
        """The rows at a version (default: the newest)."""
        version = self.version() if version is None else version
        meta = self.log.metadata(version)
        paths = [r[0] for r in self.log.live_files(version).select("path").toLocalIterator()]
        return self.read_files(paths, self._schema(meta), meta["partitionColumns"], identity)

    def detail(self) -> DataFrame:
        """One row: location, numFiles, sizeInBytes, partitionColumns, properties."""
        meta = self.log.metadata()
        sums = self.log.live_files().agg(F.count("*").alias("numFiles"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("sizeInBytes"))
        location = self.path if ":" in self.path.split("/")[0] else f"file:{self.path}"
        parts = F.array(*[F.lit(c) for c in meta["partitionColumns"]]).cast("array<string>")
        props = F.from_json(F.lit(json.dumps(meta["configuration"])), "map<string,string>")
        return sums.select(F.lit(location).alias("location"), "numFiles", "sizeInBytes", parts.alias("partitionColumns"), props.alias("properties"))

    def history(self) -> DataFrame:
        return self.log.history()

    # ------------------------------------------------------------ changing

    def set_properties(self, properties: dict) -> int:
        """Change properties: a commit of its own."""
        version = self.log.latest()
        meta = self.log.metadata(version)
        new = self._metadata(self._schema(meta), meta["partitionColumns"], meta["configuration"] | properties)
        return self.log.commit(version + 1, "SET TBLPROPERTIES", [new], {"properties": json.dumps({k: str(v) for k, v in properties.items()})})

    def change_feed_on(self, version: int | None = None) -> bool:
        return self.log.metadata(version)["configuration"].get(CHANGE_FEED_PROPERTY, "false") == "true"

    def rewrite(self, operation: str, changed: DataFrame, metrics, parameters: dict | None = None, inserted: DataFrame | None = None, version: int | None = None, source_rows: int = 0) -> int:
        """Copy-on-write commit. ``changed``: (file, row, ``__action`` update or delete, and for updates a
        struct ``__new`` of all columns), at most one row per target row, materialized by the caller.
        ``inserted``: new rows. Only files with a changed row are written again."""
        began = time.time()
        version = self.log.latest() if version is None else version
        meta = self.log.metadata(version)
        schema, parts = self._schema(meta), meta["partitionColumns"]
        touched = [_relative(self.path, r[0]) for r in changed.select(FILE).distinct().toLocalIterator()]
        counts = {r["__action"]: r["count"] for r in changed.groupBy("__action").count().collect()}
        updated, deleted = counts.get("update", 0), counts.get("delete", 0)
        out, old = inserted, None
        if touched:
            old = self.read_files(touched, schema, parts, identity=True)
            marks = changed.select(FILE, ROW, "__action", "__new")
            kept = old.join(marks, [FILE, ROW], "left").filter(F.col("__action").isNull() | (F.col("__action") == "update"))
            kept = kept.select(*[F.when(F.col("__action") == "update", F.col("__new")[f.name]).otherwise(F.col(f"`{f.name}`")).alias(f.name) for f in schema])
            out = kept if out is None else kept.unionByName(out)
        scan_ms = int((time.time() - began) * 1000)
        adds, wrote = self._write_files(out, schema, parts) if out is not None else ([], {"numFiles": 0, "numOutputRows": 0, "numOutputBytes": 0})
        some = self.spark.createDataFrame([(p,) for p in touched], "path string")
        before = self.files(version).join(some, "path", "left_semi").agg(F.sum("stats.numRecords"), F.sum("size")).first()
        copied = (before[0] or 0) - updated - deleted
        new_rows = wrote["numOutputRows"] - copied - updated
        feed: list[dict] = []
        if self.change_feed_on(version) and (updated or deleted):
            columns = [f.name for f in schema]
            marks = changed.select(FILE, ROW, "__action", "__new")
            pre = old.join(marks, [FILE, ROW])
            images = [pre.select(*columns, F.when(F.col("__action") == "update", "update_preimage").otherwise("delete").alias("_change_type")), pre.filter("__action = 'update'").select("__new.*", F.lit("update_postimage").alias("_change_type"))]
            if inserted is not None:
                images.append(inserted.withColumn("_change_type", F.lit("insert")))
            feed_df = images[0]
            for i in images[1:]:
                feed_df = feed_df.unionByName(i)
            feed, _ = self._write_files(feed_df, schema.add("_change_type", "string"), [], folder="_change_data/")
            feed = [{"cdc": {k: a["add"][k] for k in ("path", "partitionValues", "size")} | {"dataChange": False}} for a in feed]
        total_ms = int((time.time() - began) * 1000)
        facts = {"updated": updated, "deleted": deleted, "inserted": new_rows, "copied": copied, "added": len(adds), "removed": len(touched), "feed": len(feed), "removed_bytes": before[1] or 0, "added_bytes": wrote["numOutputBytes"], "output": wrote["numOutputRows"], "source": source_rows, "ms": total_ms, "scan": scan_ms, "write": total_ms - scan_ms}
        return self.log.commit(version + 1, operation, [*[_remove(p) for p in touched], *adds, *feed], parameters, metrics(facts))

    def _matching(self, condition: str | Column | None) -> DataFrame:
        df = self.to_df(identity=True)
        return df if condition is None else df.filter(condition)

    def delete(self, condition: str | None = None) -> int:
        """Delete the rows for which the condition is true."""
        version = self.version()
        hit = self._matching(condition).select(FILE, ROW, F.lit("delete").alias("__action"), F.lit(None).cast(self.schema).alias("__new"))
        return self.rewrite("DELETE", materialize(hit, "delete"), delete_metrics, {"predicate": json.dumps([condition or "true"])}, version=version)

    def update(self, assignments: dict[str, str | Column], condition: str | None = None) -> int:
        """Set columns of the rows for which the condition is true."""
        version, schema = self.version(), self.schema
        unknown = [c for c in assignments if c not in schema.names]
        if unknown:
            raise ValidationError(f"columns {unknown} are not in the table")
        value = lambda c: F.expr(assignments[c]) if isinstance(assignments[c], str) else assignments[c]
        new = F.struct(*[(value(f.name) if f.name in assignments else F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in schema])
        hit = self._matching(condition).select(FILE, ROW, F.lit("update").alias("__action"), new.alias("__new"))
        return self.rewrite("UPDATE", materialize(hit, "update"), update_metrics, {"predicate": condition or "true"}, version=version)

    def merge(self, source: DataFrame, condition: str | Column, source_alias: str = "source", target_alias: str = "target"):
        """Begin a merge; add clauses and call ``execute``."""
        from .merge import Merge

        return Merge(self, source, condition, source_alias, target_alias)

    def compact(self, where: str | None = None, target: int = 128 * 1024 * 1024, small: int | None = None, z_order: list[str] | None = None) -> int | None:
        """Consolidate small files of partitions that have at least two, or cluster files by columns.

        Only such partitions are written again. The commit removes exactly the files that were read at the
        start; if another commit came between that removed or rewrote one of them, it fails with
        ``ConcurrentCommitError`` and nothing has changed; commits that only added files are no conflict.
        No row is lost or doubled: the number of rows written is compared before the commit.
        """
        from ..operators.compaction import plan_bins, small_files
        from ..operators.live_files import partition_text

        version = self.version()
        meta = self.log.metadata(version)
        schema, parts = self._schema(meta), meta["partitionColumns"]
        live = self.files(version)
        if where:
            typed = [F.col("partitionValues")[p].cast(schema[p].dataType).alias(p) for p in parts]
            live = live.select("*", *typed).filter(where).drop(*parts)
        listed = live.select(F.lit("").alias("table_path"), partition_text(F.col("partitionValues")).alias("part"), "path", "size", F.col("stats.numRecords").alias("numRecords"))
        chosen = materialize(listed.withColumn("bin", F.lit("0")) if z_order else plan_bins(small_files(listed, small or target), target), "bins")
        paths = [r[0] for r in chosen.select("path").toLocalIterator()]
        if not paths:
            return None
        rows = self.read_files(paths, schema, parts, identity=True)
        expected = chosen.agg(F.sum("numRecords"), F.sum("size")).first()
        if z_order:
            n = max(1, int((expected[1] or 0) // target))
            out = rows.select(*schema.names).repartitionByRange(n, *[f"`{p}`" for p in parts], *_interleaved(rows, z_order))
        else:
            # bins are numbered without holes and every number is a task of its own, hence one file
            named = chosen.select(F.col("path").alias("__name"), F.struct("part", "bin").alias("__bin"))
            numbers = named.select("__bin").distinct().orderBy("__bin").select("__bin", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("__bin")) - 1).alias("__task"))  # one row per new file
            bins = materialize(named.join(numbers, "__bin").select("__name", "__task"), "bin-tasks")
            n = bins.agg(F.max("__task")).first()[0] + 1
            placed = rows.withColumn("__name", _stored_path(F.col(FILE))).join(bins, "__name")
            out = placed.repartitionById(n, F.col("__task").cast("int")).select(*schema.names)
        adds, wrote = self._write_files(out, schema, parts)
        if expected[0] is not None and wrote["numOutputRows"] != expected[0]:
            raise ValidationError(f"{wrote['numOutputRows']} rows were written of {expected[0]}; nothing was committed")
        for a in adds:
            a["add"]["dataChange"] = False
        removes = [_remove(p) | {"remove": _remove(p)["remove"] | {"dataChange": False}} for p in paths]
        metrics = {"numAddedFiles": len(adds), "numRemovedFiles": len(paths), "numRemovedBytes": expected[1], "numAddedBytes": wrote["numOutputBytes"]}
        at = version
        while True:
            try:
                return self.log.commit(at + 1, "OPTIMIZE", [*removes, *adds], {"predicate": json.dumps([where] if where else []), "zOrderBy": json.dumps(z_order or [])}, metrics)
            except ConcurrentCommitError:
                at = self.log.latest()
                between = self.log.actions(version + 1, at)
                gone = between.filter(F.col("remove").isNotNull()).select(F.col("remove.path").alias("path"))
                if not between.filter(F.col("metaData").isNotNull()).isEmpty() or not gone.join(chosen, "path", "left_semi").isEmpty():
                    raise


def _at_most(value: Column):
    return lambda bound: bound <= value


def _interleaved(df: DataFrame, columns: list[str]) -> list[Column]:
    """Sort keys that cluster by several columns at once: the bits of their quantile ranks, interleaved."""
    if len(columns) == 1:
        return [F.col(f"`{columns[0]}`")]
    num = {c: F.col(f"`{c}`") if isinstance(df.schema[c].dataType, T.NumericType) else F.xxhash64(F.col(f"`{c}`")) for c in columns}
    cuts = df.agg(*[F.percentile_approx(num[c], [i / 256 for i in range(1, 256)], 2000).alias(c) for c in columns]).first()
    ranks = [F.size(F.filter(F.array(*[F.lit(x) for x in cuts[c]]), _at_most(num[c]))) for c in columns]
    bits = [F.shiftleft(F.shiftright(r, b).bitwiseAND(F.lit(1)), b * len(columns) + i) for i, r in enumerate(ranks) for b in range(8) if b * len(columns) + i < 31]
    z = bits[0]
    for b in bits[1:]:
        z = z.bitwiseOR(b)
    return [z]


def _relative(root: str, url: str) -> str:
    """Path of a file below the table, as plain text, from the URL that Spark gives."""
    plain, base = unquote(url), root.split(":", 1)[-1] if "://" not in root else root
    base = "/" + base.lstrip("/") if "://" not in root else base
    at = plain.find(base + "/")
    return plain[at + len(base) + 1 :] if at >= 0 else plain


def _stored_path(url: Column) -> Column:
    """Path of a data file below the table, as the log has it, from the URL that Spark gives."""
    plain = F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(plain, rf"({COMMIT}=[0-9a-f]{{32}}/.*)$", 1)


def _remove(path: str) -> dict:
    return {"remove": {"path": path, "deletionTimestamp": int(time.time() * 1000), "dataChange": True}}


def delete_metrics(f: dict) -> dict:
    return {"numDeletedRows": f["deleted"], "numAddedFiles": f["added"], "numCopiedRows": f["copied"], "numRemovedFiles": f["removed"], "numAddedChangeFiles": f["feed"], "numRemovedBytes": f["removed_bytes"], "numAddedBytes": f["added_bytes"], "executionTimeMs": f["ms"], "scanTimeMs": f["scan"], "rewriteTimeMs": f["write"]}


def update_metrics(f: dict) -> dict:
    return {"numRemovedFiles": f["removed"], "numCopiedRows": f["copied"], "numAddedChangeFiles": f["feed"], "executionTimeMs": f["ms"], "scanTimeMs": f["scan"], "numAddedFiles": f["added"], "numUpdatedRows": f["updated"], "rewriteTimeMs": f["write"]}


def merge_metrics(f: dict) -> dict:
    return {"numTargetRowsCopied": f["copied"], "numTargetRowsDeleted": f["deleted"], "numTargetFilesAdded": f["added"], "executionTimeMs": f["ms"], "numTargetRowsInserted": f["inserted"], "scanTimeMs": f["scan"], "numTargetRowsUpdated": f["updated"], "numOutputRows": f["output"], "numTargetChangeFilesAdded": f["feed"], "numSourceRows": f["source"], "numTargetFilesRemoved": f["removed"], "rewriteTimeMs": f["write"]}
