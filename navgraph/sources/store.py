"""The fact store: one row for each file, its facts nested by table, in versioned Parquet folders.

A build lists the tree, reads and scans files on the executors and writes rows to buckets of a
hash of the path. A refresh compares what the tree holds with what the store holds (one full outer join over paths),
scans changed files only and writes a new version of the buckets they fall into. ``current`` names the version that
readers use; it is written last, so a reader never meets half a build.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navgraph.config import AnalysisConfig
from navgraph.functions.paths import matches, module_of, within
from navgraph.operators.tables import drift
from navgraph.schema import FACTS, fact_arrow, fact_ddl
from navgraph.shared import checkpointed
from navgraph.sources.extract import scan

#: Least number of buckets, and files of a bucket beyond which a build makes more of them.
BUCKETS, BUCKET_FILES = 64, 5_000
#: Files about which a question asks the file system one by one.
DRIFT_CAP = 1000
FILE_COLUMNS = "file string, module string, mtime timestamp, length long, sha string, parse_ok boolean, profile string"


class StaleConfig(RuntimeError):
    """The store was built under a configuration that would give other facts."""


def listing(root: str) -> list[tuple[str, int, int]]:
    """(path below the root, modification time in microseconds, bytes) of every Python file.

    Spark's file sources pass over names that start with an underscore, ``__init__.py`` among them, so the tree is
    listed through Arrow's file systems (local, HDFS, S3, GCS); that moves names only.
    """
    system, base = fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))
    base = base.rstrip("/")
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    return [(x.path[len(base) + 1 :], int((x.mtime_ns or 0) // 1000), int(x.size)) for x in found if x.type == fs.FileType.File and x.path.endswith(".py")]


def source_files(spark: SparkSession, config: AnalysisConfig) -> DataFrame:
    """``file, mtime, length`` of the Python files in the configured scope.

    Excluded folders and files are left out unless an include path is the file or one of its folders. Include paths
    also add files outside the targets.
    """
    rows = spark.createDataFrame(listing(config.root), "file string, micros long, length long")
    found = rows.select("file", F.timestamp_micros("micros").alias("mtime"), "length")
    included = F.lit(False)
    for path in config.include_paths:
        included = included | within(F.col("file"), path)
    in_target = F.lit(not config.targets)
    for path in config.targets:
        in_target = in_target | within(F.col("file"), path)
    folders = F.slice(F.split("file", "/"), 1, F.size(F.split("file", "/")) - 1)
    excluded = matches(F.col("file"), config.exclude_files)
    if config.exclude_dirs:
        excluded = excluded | F.arrays_overlap(folders, F.array(*map(F.lit, config.exclude_dirs)))
    kept = found.where(included | (in_target & ~excluded))
    return kept.select("file", "mtime", "length")


def profile_of(config: AnalysisConfig) -> F.Column:
    """The profile of the first rule whose shell pattern the whole path fits, else full."""
    import fnmatch

    out = None
    for pattern, profile in config.profiles:
        rule = F.col("file").rlike("^" + fnmatch.translate(pattern).replace(r"\Z", "$").replace("(?s:", "(?:").replace(r"\z", "$"))
        out = F.when(rule, profile) if out is None else out.when(rule, profile)
    return F.lit("full") if out is None else out.otherwise("full")


def scan_files(files: DataFrame, config: AnalysisConfig) -> DataFrame:
    """File rows with nested facts; each file is read and scanned in one task, largest and smallest files mixed."""
    hooks, prefixes = config.hooks, tuple(config.downsample_prefixes)
    root = config.root if "://" in config.root else os.path.abspath(config.root)

    own = sys.modules.get(type(hooks).__module__)
    if own is not None and not own.__name__.startswith("navgraph."):
        cloudpickle.register_pickle_by_value(own)  # a project's plug-in need not be installed on the executors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                sound, shas, facts = [], [], {t: [] for t in FACTS}
                for path, profile in zip(part.column(0).to_pylist(), part.column(3).to_pylist(), strict=True):
                    with system.open_input_stream(f"{base.rstrip('/')}/{path}") as stream:
                        raw = stream.readall()
                    ok, rows = scan(path, raw, hooks, profile, path.startswith(prefixes) if prefixes else False)
                    sound.append(ok)
                    shas.append(hashlib.sha256(raw).hexdigest())
                    for table, columns in FACTS.items():
                        facts[table].append([dict(zip(columns, row, strict=True)) for row in rows[table]])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(shas), pa.array(sound), part.column(3), *(pa.array(facts[t], fact_arrow(t)) for t in FACTS)],
                    ["file", "mtime", "length", "sha", "parse_ok", "profile", *FACTS],
                )

    source = files.select("file", "mtime", "length", profile_of(config).alias("profile"))
    source = source.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("file"))
    return source.mapInArrow(run, f"file string, mtime timestamp, length long, sha string, parse_ok boolean, profile string, {fact_ddl()}")


class FactStore:
    """Facts under ``path``; tables are DataFrames: ``store.table("defs")`` and ``store.files()``."""

    def __init__(self, spark: SparkSession, path: str, before: bool = False):
        self.spark, self.path, self.before = spark, path.rstrip("/"), before
        self._read: tuple[str, DataFrame] | None = None  # facts as last read, and the versions that they were read by

    def previous(self) -> FactStore | None:
        """The facts as they were before the last refresh (until ``compact``); None if there was none."""
        return FactStore(self.spark, self.path, True) if (self.meta() or {}).get("previous") else None

    # -- versions -------------------------------------------------------------------------------------------------
    def _hadoop(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def meta(self) -> dict | None:
        system, where = self._hadoop(f"{self.path}/current")
        if not system.exists(where):
            return None
        said = ""
        for entry in system.listStatus(where):  # one small file; read without a job
            if entry.getPath().getName().startswith("part-"):
                stream = system.open(entry.getPath())
                said += self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
        return json.loads(said)

    def _publish(self, meta: dict) -> None:
        row = self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1)
        row.write.mode("overwrite").text(f"{self.path}/current")

    def _buckets(self) -> DataFrame:
        meta = self.meta()
        if meta is None:
            raise FileNotFoundError(f"no facts in {self.path}")
        versions = meta["previous" if self.before else "versions"]
        key = json.dumps(versions, sort_keys=True)
        if self._read is None or self._read[0] != key:  # files are listed once for a version
            shape = f"{FILE_COLUMNS}, {fact_ddl()}, bucket int, version int"
            current = F.create_map(*(F.lit(int(x)) for pair in versions.items() for x in pair))
            self._read = key, self.spark.read.schema(shape).parquet(f"{self.path}/facts").where(F.col("version") == current[F.col("bucket")])
        return self._read[1]

    # -- tables made from the facts --------------------------------------------------------------------------------
    def keeps(self) -> bool:
        """Whether tables made from the facts can stay beside them: of the current version only."""
        return not self.before and self.meta() is not None

    def derived(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table ``name`` of the current version of the facts: read where it is, else made and written. A write that
        broke off has no success mark and is made again."""
        path = f"{self.path}/derived/{self.meta()['version']}/{name}"
        system, where = self._hadoop(f"{path}/_SUCCESS")
        if not system.exists(where):
            make().write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
        return self.spark.read.parquet(path)

    def by_name(self, table: str) -> DataFrame:
        """A fact table sorted by ``name`` over files, so that a question about one name reads few row groups."""
        if not self.keeps():
            return self.table(table)
        return self.derived(f"by-name/{table}", lambda: self.table(table).repartitionByRange("name").sortWithinPartitions("name", "file", "line"))

    def state(self) -> dict:
        """What the store knows of itself: version, configuration and profiles."""
        meta = self.meta() or {}
        return {"version": meta.get("version"), "fingerprint": meta.get("fingerprint"), "profiles": {r["profile"]: r["n"] for r in self.by_profile().collect()}}

    # -- writing --------------------------------------------------------------------------------------------------
    def _write(self, rows: DataFrame, version: int, buckets: int) -> None:
        bucket = F.pmod(F.xxhash64("file"), F.lit(buckets)).cast("int")
        out = rows.withColumns({"module": module_of(F.col("file")), "bucket": bucket, "version": F.lit(version)})
        out = out.repartition("bucket").sortWithinPartitions("bucket", "file")
        out.write.mode("append").partitionBy("bucket", "version").parquet(f"{self.path}/facts")

    def build(self, config: AnalysisConfig) -> dict:
        """Scan everything in scope into a new version; older versions stay readable until ``compact``."""
        old = self.meta()
        version = old["version"] + 1 if old else 1
        found = source_files(self.spark, config)
        buckets = max(BUCKETS, found.count() // BUCKET_FILES)
        self._write(scan_files(found, config), version, buckets)
        meta = {"version": version, "versions": {str(b): version for b in range(buckets)}, "fingerprint": config.fingerprint(), "targets": config.targets, "root": config.root}
        self._publish(meta)
        return self._finish(config, {"mode": "rebuild", "version": version})

    def drift(self, config: AnalysisConfig) -> DataFrame:
        """``file, change`` between the tree and the store, within the configured scope (time, length and profile)."""
        found = source_files(self.spark, config).select("file", "mtime", "length", profile_of(config).alias("profile"))
        known = self.files().select("file", "mtime", "length", "profile")
        scope = F.lit(not config.targets)
        for path in [*config.targets, *config.include_paths]:
            scope = scope | within(F.col("file"), path)
        return drift(known.where(scope), found, "file", ["mtime", "length", "profile"])

    def drift_check(self, config: AnalysisConfig, files: list[str], cap: int = DRIFT_CAP) -> list[str] | None:
        """Which of some files differ from the store: changed, gone from the tree, or not in the index (where the tree
        has them). None above ``cap`` files: then ``drift`` compares everything at once."""
        wanted = list(dict.fromkeys(f.replace("\\", "/") for f in files if f))
        if len(wanted) > cap:
            return None
        if not wanted:
            return []
        system, base = fs.FileSystem.from_uri(config.root if "://" in config.root else os.path.abspath(config.root))
        found = system.get_file_info([f"{base.rstrip('/')}/{f}" for f in wanted])
        disk = {f: int((x.mtime_ns or 0) // 1000) for f, x in zip(wanted, found, strict=True) if x.type == fs.FileType.File}
        known = {r["file"]: r["at"] for r in self.files().where(F.col("file").isin(wanted)).select("file", F.unix_micros("mtime").alias("at")).collect()}
        return [f for f in wanted if disk.get(f) != known.get(f)]

    def refresh(self, config: AnalysisConfig, mode: str = "auto") -> dict:
        """Bring the store up to date. ``auto`` scans what changed, ``check`` only counts it, ``off`` looks at nothing."""
        meta = self.meta()
        if meta is None:
            if config.targets:
                raise FileNotFoundError("a partial build needs a whole one first")
            return self.build(config)
        if mode != "off" and meta["fingerprint"] != config.fingerprint() and not config.targets:
            raise StaleConfig("the store was built under another configuration; build it anew")
        if mode == "off":
            return {"mode": "off", "version": meta["version"], "changed": None, "stale": None}
        changes = checkpointed(self.drift(config))
        n = changes.count()
        if mode == "check" or not n:
            return {"mode": mode, "version": meta["version"], "changed": n, "stale": bool(n)}
        version, n_buckets = meta["version"] + 1, len(meta["versions"])
        fresh = source_files(self.spark, config).join(changes.where("change <> 'removed'").select("file"), "file", "left_semi")
        hit = changes.select(F.pmod(F.xxhash64("file"), F.lit(n_buckets)).cast("int").alias("bucket")).distinct()
        buckets = sorted(r["bucket"] for r in hit.collect())
        kept = self._buckets().where(F.col("bucket").isin(buckets)).join(changes.select("file"), "file", "left_anti")
        both = kept.drop("bucket", "version", "module").unionByName(scan_files(fresh, config))
        self._write(both, version, n_buckets)
        self._publish(meta | {"version": version, "versions": meta["versions"] | {str(b): version for b in buckets}, "previous": meta["versions"]})
        return self._finish(config, {"mode": mode, "version": version, "changed": n, "stale": False})

    def _finish(self, config: AnalysisConfig, stats: dict) -> dict:
        try:
            config.hooks.built(self, config)
        except Exception as error:  # noqa: BLE001  a plug-in's failure is told, it does not undo the build
            stats["hook_error"] = repr(error)
        return stats | {"files": self.files().count(), "parse_failed": self.files().where("NOT parse_ok").count()}

    def compact(self) -> None:
        """Delete versions of buckets that no reader of the current version uses."""
        meta = {k: v for k, v in self.meta().items() if k != "previous"}
        self._publish(meta)
        self._read = None
        system, where = self._hadoop(f"{self.path}/derived")
        if system.exists(where):
            for entry in system.listStatus(where):
                if entry.getPath().getName() != str(meta["version"]):
                    system.delete(entry.getPath(), True)
        for row in self.spark.read.parquet(f"{self.path}/facts").select("bucket", "version").distinct().collect():
            if meta["versions"][str(row["bucket"])] != row["version"]:
                system, where = self._hadoop(f"{self.path}/facts/bucket={row['bucket']}/version={row['version']}")
                system.delete(where, True)

    # -- reading --------------------------------------------------------------------------------------------------
    def files(self) -> DataFrame:
        return self._buckets().select("file", "module", "mtime", "length", "sha", "parse_ok", "profile")

    def table(self, name: str) -> DataFrame:
        """One fact table; the scan reads that table's nested columns only."""
        return self._buckets().select("file", F.inline(name))

    def coverage(self, scope: str | None = None) -> DataFrame:
        """One row: files, failed files, ``complete`` or ``partial``, and the first ten files that failed."""
        files = self.files() if scope is None else self.files().where(within(F.col("file"), scope))
        failed = F.col("parse_ok") == F.lit(False)
        return files.agg(F.count("*").alias("files"), F.count_if(failed).alias("failed"), F.slice(F.array_sort(F.collect_list(F.when(failed, F.col("file")))), 1, 10).alias("issues")).withColumn(
            "coverage", F.when(F.col("failed") == 0, "complete").otherwise("partial")
        )

    def by_profile(self) -> DataFrame:
        return self.files().groupBy("profile").agg(F.count("*").alias("n"))


class FrameStore(FactStore):
    """Facts given as DataFrames (``tables`` by name, ``file`` and the columns of ``schema.FACTS``), for facts that
    another system keeps; tables that are not given are empty, and one given as a function is made when it is first
    asked for. ``files`` has the columns of ``FactStore.files``."""

    def __init__(self, spark: SparkSession, files: DataFrame, tables: dict[str, DataFrame | Callable[[], DataFrame]]):
        super().__init__(spark, "")
        self._files, self._tables = files, dict(tables)

    def previous(self) -> FactStore | None:
        return None

    def meta(self) -> dict | None:
        return None

    def keeps(self) -> bool:
        return False

    def files(self) -> DataFrame:
        return self._files

    def table(self, name: str) -> DataFrame:
        columns = {"file": "string", **FACTS[name]}
        if name not in self._tables:
            return self.spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in columns.items()))
        if callable(self._tables[name]):
            self._tables[name] = self._tables[name]()
        return self._tables[name].select(*(F.col(c).cast(t).alias(c) for c, t in columns.items()))
