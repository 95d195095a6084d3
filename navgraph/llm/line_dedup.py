"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys are counted by document
in runs: tables of (128-bit hash, documents, frequent) in buckets of the hash, sorted by it, in the shared folder. A
batch of counts, in the same buckets, is merge-anti-joined with the keys that the runs already know as frequent
(nothing is left to count for those), merge-joined with the runs' counts of the rest, and added as a new run of level
0; when a level has ``fanout`` runs they are merged into one run of the next level. Batch and runs share their buckets,
so nothing of a run is ever shuffled again. A key that reaches ``min_docs`` documents is frequent, and all its lines
go, in every document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from navgraph.llm.common import SLICE_ROWS, checkpointed, delete_path, new_path, slices, text_bytes

#: What is stripped at a line's ends: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = b" \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]
OWN = "__navgraph_"
#: Tasks over which the documents of one frequent line are dealt.
SALTS = 8


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def _line_rows(docs: DataFrame, min_chars: int, text_col: str, positions: bool, id_cols: list[str]) -> DataFrame:
    """A row for each row of ``docs`` and key: its hash, the id columns, and with ``positions`` where its lines stand."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            owner, hashes, where = [], [], []
            for k, raw in enumerate(part.column(0)):
                found: dict[bytes, list[int]] = {}
                for at, line in enumerate(raw.as_py().split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                        found.setdefault(key, []).append(at)
                for key, at in found.items():
                    hashes.append(xxhash.xxh3_128_digest(key))
                    owner.append(k)
                    where.append(at)
            halves = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            columns, names = [pa.array(halves[:, 0]), pa.array(halves[:, 1])], list(HASH)
            if positions:
                columns.append(pa.array(where, pa.list_(pa.int32())))
                names.append("lines")
            rows = pa.array(owner, pa.int64())
            columns += [part.column(1 + j).take(rows) for j in range(len(id_cols))]
            names += id_cols
            yield pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(text_bytes(text_col).alias("text"), *id_cols)
    shape = "h1 long, h2 long" + (", lines array<int>" if positions else "")
    shape += "".join(f", {c} {source.schema[c].dataType.simpleString()}" for c in id_cols)
    return source.mapInArrow(scan, shape)


class LineRuns:
    """The runs of one corpus; batches may come one by one (``stage`` one batch, ``add`` it, and so on)."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_chars: int = 1, fanout: int = 3):
        self.spark, self.min_docs, self.min_chars, self.fanout = spark, min_docs, min_chars, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        """``rows`` (partitioned by hash) as a table in buckets of the hash, sorted by it."""
        name, path = f"navgraph_run_{uuid.uuid4().hex}", new_path(self.spark, "line-run")
        rows.write.format("parquet").bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).saveAsTable(name)
        self.paths[name] = path
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_path(self.spark, self.paths.pop(name))

    def _read(self, names: list[str]) -> DataFrame | None:
        """The rows of several runs; a union of tables in the same buckets keeps them."""
        return reduce(DataFrame.union, map(self.spark.table, names)) if names else None

    def _runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def stage(self, docs: DataFrame, batches: int = 1, text_col: str = "text", id_col: str = "doc_id") -> tuple[str, list[DataFrame]]:
        """A table of the documents of each key by batch, from one pass over ``docs``, and the batches' counts.

        All rows of one id are one document: each (id, key) counts once, and an id's batch follows its hash. Keys go
        through one shuffle by (key, id), which deals out a hot line's documents, and partial counts through a second.
        """
        owned = docs.select(text_col, F.col(id_col).alias(f"{OWN}doc"))
        keys = _line_rows(owned, self.min_chars, text_col, False, [f"{OWN}doc"]).distinct()
        batch = F.pmod(F.xxhash64(f"{OWN}doc"), F.lit(batches))
        staged = self._write(keys.groupBy(*HASH).agg(*(F.count_if(batch == k).alias(f"n{k}") for k in range(batches))))
        table = self.spark.table(staged)
        return staged, [table.where(F.col(f"n{k}") > 0).select(*HASH, F.col(f"n{k}").alias("n_docs")) for k in range(batches)]

    def _fresh(self, counts: DataFrame) -> DataFrame:
        """The run that a batch of counts becomes: its keys but for those known as frequent, by merge joins."""
        runs = self._read(self._runs())
        if runs is None:
            return counts.withColumn("frequent", F.col("n_docs") >= self.min_docs)
        fresh = counts.hint("merge").join(runs.where("frequent").select(*HASH), HASH, "left_anti")
        before = runs.where("NOT frequent").groupBy(*HASH).agg(F.sum("n_docs").alias("n_before"))
        total = F.col("n_docs") + F.coalesce("n_before", F.lit(0))
        return fresh.hint("merge").join(before, HASH, "left").select(*HASH, "n_docs", (total >= self.min_docs).alias("frequent"))

    def add(self, counts: DataFrame) -> None:
        """Add a batch of counts (``h1, h2, n_docs``, in the runs' buckets) as a run, and compact full levels."""
        name, level = self._write(self._fresh(counts)), 0
        while True:
            while len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return
            merged, self.levels[level] = self.levels[level], []
            name = self._write(self._read(merged).groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("frequent").alias("frequent")))
            self._drop(merged)
            level += 1

    def frequent(self) -> DataFrame:
        """Hashes of the keys that at least ``min_docs`` documents hold (each stands in one run)."""
        return self._read(self._runs()).where("frequent").select(*HASH)

    def clear(self) -> None:
        self._drop(list(self.paths))
        self.levels = []


def without_lines(text: Column, dropped: Column) -> Column:
    """``text`` (null: empty) without the lines at the positions in ``dropped`` (null: none)."""

    @F.arrow_udf("string")
    def rebuild(texts: pa.Array, drops: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.string())]
        for at in range(0, len(texts), SLICE_ROWS):  # few texts are Python objects at once
            some, gone = texts.slice(at, SLICE_ROWS), drops.slice(at, SLICE_ROWS)
            if gone.null_count < len(gone):
                lines = [set(d or ()) for d in gone.to_pylist()]
                some = pa.array(["\n".join([x for k, x in enumerate(t.as_py().split("\n")) if k not in d]) if d else t.as_py() for t, d in zip(some, lines, strict=True)], pa.string())
            parts.append(some.cast(pa.string()))
        return pa.concat_arrays(parts)

    return rebuild(F.coalesce(text, F.lit("")), dropped)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text without frequent lines, and ``n_lines`` and ``n_dropped``.

    The table is counted in ``batches`` batches (by a hash of the id), all staged in one pass over it, then every
    document loses the lines that the runs know as frequent. A null text is one empty line and stays null; an empty key is never frequent. Rows that
    repeat an id count as one document (rows without an id too) and lose the same lines. Other columns pass unchanged,
    columns named ``n_lines`` or ``n_dropped`` are replaced.
    """
    runs = LineRuns(docs.sparkSession, min_docs, min_chars)
    staged, parts = runs.stage(docs, batches, text_col, id_col)
    for counts in parts:
        runs.add(counts)
    frequent = checkpointed(runs.frequent())
    runs.clear()

    doc, mark, salt = f"{OWN}doc", f"{OWN}text", f"{OWN}salt"
    keyed = docs.withColumns({doc: F.col(id_col), mark: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    lines = _line_rows(keyed, min_chars, text_col, True, [doc, mark])
    # A line that a third of all documents hold is dealt over SALTS tasks; frequent keys are the small side.
    salted = frequent.withColumn(salt, F.explode(F.array(*map(F.lit, range(SALTS)))))
    met = lines.withColumn(salt, F.pmod(F.xxhash64(doc, mark), F.lit(SALTS)).cast("int")).join(salted, [*HASH, salt])
    drops = met.groupBy(doc, mark).agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias(f"{OWN}drop"))
    right = drops.withColumnsRenamed({doc: f"{OWN}doc2", mark: f"{OWN}text2"})
    joined = keyed.join(right, F.col(doc).eqNullSafe(F.col(f"{OWN}doc2")) & (F.col(mark) == F.col(f"{OWN}text2")), "left")
    text, drop = F.col(text_col), F.col(f"{OWN}drop")
    n_lines = F.length(F.coalesce(text, F.lit(""))) - F.length(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(""))) + 1
    n_dropped = F.when(drop.isNull(), 0).otherwise(F.size(drop))
    done = joined.withColumns({"n_lines": n_lines.cast("long"), "n_dropped": n_dropped.cast("long")})
    done = done.withColumn(text_col, F.when(text.isNotNull(), without_lines(text, drop)))
    return done.drop(doc, mark, f"{OWN}doc2", f"{OWN}text2", f"{OWN}drop")
