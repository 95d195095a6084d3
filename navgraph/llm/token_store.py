"""Content-addressed store of token ids.

A rolling hash over the ids cuts each document's id stream where the stream itself says so, hence shared passages give
the same chunks wherever they stand. A chunk is stored once under its hash. A document is a recipe: its chunks' hashes
in order, with its place in the whole stream in ascending ``doc_id`` order. A document's digest is the Merkle root of
its chunk hashes, a shard's the root of its documents', and the manifest holds the shards' roots: reading checks
payloads against hashes, recipes against roots, and the shards' roots, counts and places against the manifest.

Files (Parquet folders under one root, in the file system of ``spark.checkpoint.dir`` or any that Spark can write):
``parts`` (kind c: hash, n_ids, payload, the little-endian ids; kind r: the documents' chunk hashes as they were
cut), ``recipes`` (shard, no, doc_id, start, n_tokens, chunks, root: a shard's documents in order), ``manifest`` (shard,
start, n_docs, n_tokens, width of an id in bytes, root).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navgraph.llm.common import text_bytes
from navgraph.llm.token_ids import encoder, text_slices

#: Ids under the rolling hash's window; a cut follows where the hash's top bits are zero (once in 2**CUT_BITS ids).
WINDOW_BITS, CUT_BITS, LEAST_IDS, MOST_IDS = 4, 9, 64, 4096
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Nodes under one node of a shard's tree while it is folded, a power of two: what one row collects.
FOLD = 1024


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """At each id a hash of the last 2**WINDOW_BITS ids (fewer at the start), by doubling the window."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
        h ^= h >> np.uint64(29)
        factor = MULTIPLIER
        for k in range(WINDOW_BITS):
            step = 1 << k
            if step < len(h):
                h[step:] = h[step:] + h[:-step] * factor  # the right side is a new array before it is stored
            factor = factor * factor
    return h


def cuts(ids: np.ndarray, borders: np.ndarray | None = None) -> list[int]:
    """Chunk borders of the streams that stand in ``ids`` between ``borders`` (one stream without them), ends included.

    Chunks have at least LEAST_IDS ids but for a stream's last, MOST_IDS at most. The streams are hashed in a row: a
    window that reaches into the stream before is over an id that LEAST_IDS rules out as a cut.
    """
    ends = [0, len(ids)] if borders is None else borders.tolist()
    found = (np.flatnonzero(rolling_hash(ids) >> np.uint64(64 - CUT_BITS) == 0) + 1).tolist() if len(ids) > LEAST_IDS else []
    out, k = [ends[0]], 0
    for end in ends[1:]:
        at = out[-1]
        while k < len(found) and found[k] < end:
            if found[k] - at >= LEAST_IDS:
                while found[k] - at > MOST_IDS:
                    at += MOST_IDS
                    out.append(at)
                at = found[k]
                out.append(at)
            k += 1
        while end - at > MOST_IDS:
            at += MOST_IDS
            out.append(at)
        out.append(end)
    return out


def digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def merkle_root(leaves: list[bytes]) -> bytes:
    """Binary Merkle root; an odd node moves up as it is. No leaf: the digest of nothing."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        pairs = [digest(b"\x01" + a + b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = pairs + leaves[len(pairs) * 2 :]
    return leaves[0]


def _zero_tables(powers: int = 40) -> list[list[list[int]]]:
    """For each k the change that 2**k zero bytes make to a crc, as four tables of 256 (the change is linear)."""

    def tables(columns: list[int]) -> list[list[int]]:
        out = []
        for i in range(4):
            t = [0] * 256
            for v in range(1, 256):
                low = v & -v
                t[v] = t[v ^ low] ^ columns[8 * i + low.bit_length() - 1]
            out.append(t)
        return out

    def through(t: list[list[int]], v: int) -> int:
        return t[0][v & 255] ^ t[1][v >> 8 & 255] ^ t[2][v >> 16 & 255] ^ t[3][v >> 24]

    # One zero byte takes the crc register c to (c >> 8) ^ T[c & 255]; T comes from zlib's own answer.
    def one(c: int) -> int:
        return zlib.crc32(b"\0", c ^ 0xFFFFFFFF) ^ 0xFFFFFFFF

    columns = [one(1 << i) ^ one(0) for i in range(32)]
    found = [tables(columns)]
    for _ in range(powers - 1):
        columns = [through(found[-1], c) for c in columns]
        found.append(tables(columns))
    return found


_ZEROS = _zero_tables()
_TABLES = np.array(_ZEROS, np.uint32)


def joined_crcs(crc: np.ndarray, size: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """crc32 of every owner's pieces in a row, from the pieces' crcs and bytes, ordered by owner: neighbours join in
    pairs until each owner has one."""
    crc, size = crc.astype(np.uint32), size.astype(np.int64)
    while True:
        first = np.append(True, owner[1:] != owner[:-1])
        start = np.flatnonzero(first)
        if len(start) == len(owner):
            return crc
        rank = np.arange(len(owner)) - start[np.cumsum(first) - 1]
        left = np.flatnonzero(rank % 2 == 0)
        a = left[np.append(owner, owner[-1:] ^ -1)[left + 1] == owner[left]]  # those with a neighbour to the right
        value, length = crc[a], size[a + 1]
        for k in range(int(length.max()).bit_length()):
            at = np.flatnonzero(length >> k & 1)
            v, table = value[at], _TABLES[k]
            value[at] = table[0][v & 255] ^ table[1][v >> 8 & 255] ^ table[2][v >> 16 & 255] ^ table[3][v >> 24]
        crc[a] = value ^ crc[a + 1]
        size[a] += length
        crc, size, owner = crc[left], size[left], owner[left]


def chunk_rows(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Recipe rows (``kind`` r) and chunk rows (c); a task gives each chunk once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, given = encoder(tokenizer_path), set()
        size, kinds = own.dtype.itemsize, pa.list_(pa.binary())
        for part in text_slices(batches):
            ids, borders = own.batch(part.column(1), end_id)
            edges = np.array(cuts(ids, borders), np.int64)
            raw = memoryview(ids).cast("B")
            names = [digest(raw[a:b]) for a, b in zip((size * edges[:-1]).tolist(), (size * edges[1:]).tolist(), strict=True)]
            new = []
            for k, name in enumerate(names):
                if name not in given:
                    given.add(name)
                    new.append(k)
            hashes, at = pa.array(names, pa.binary()), np.array(new, np.int64)
            lengths = np.diff(edges)
            payloads = pa.array([bytes(raw[size * a : size * b]) for a, b in zip(edges[at].tolist(), edges[at + 1].tolist(), strict=True)], pa.binary())
            chunks = [pa.array(["c"] * len(new)), hashes.take(pa.array(at)), pa.nulls(len(new), part.schema.field(0).type), pa.array(lengths[at]), pa.nulls(len(new), kinds), payloads]
            own_names = pa.array([digest(repr(doc).encode()) for doc in part.column(0).to_pylist()], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(edges, borders), pa.int32()), hashes)
            n = part.num_rows
            recipes = [pa.array(["r"] * n), own_names, part.column(0), pa.array(np.diff(borders)), lists, pa.nulls(n, pa.binary())]
            for columns in (chunks, recipes):
                yield pa.RecordBatch.from_arrays(columns, ["kind", "hash", "doc_id", "n_ids", "chunks", "payload"])

    source = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(encode, f"kind string, hash binary, doc_id {kind}, n_ids long, chunks array<binary>, payload binary")


NODE = "shard int, no long, start long, n_tokens long, n_docs long, root binary, whole boolean"


def folded(recipes: DataFrame) -> DataFrame:
    """``NODE`` for each shard, from its documents: places must follow each other (``whole``).

    A binary tree over FOLD leaves at a time, level by level, so that no row collects more than FOLD nodes; that gives
    the root of one tree over all leaves, as FOLD is a power of two.
    """
    nodes = recipes.select("shard", "no", "start", "n_tokens", F.lit(1).cast("long").alias("n_docs"), "root", F.lit(True).alias("whole"))
    last = recipes.agg(F.max("no")).first()[0] or 0

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for shard, no, nodes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, whole = nodes[0]["start"], True
                for x in nodes:
                    whole = whole and x["whole"] and x["start"] == at and x["n_tokens"] is not None
                    at += x["n_tokens"] or 0
                rows.append((shard, no, nodes[0]["start"], at - nodes[0]["start"], sum(x["n_docs"] for x in nodes), merkle_root([x["root"] for x in nodes]), whole))
            kinds = (pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split(" ")[0] for x in NODE.split(", ")])

    while True:
        above = nodes.groupBy("shard", F.floor(F.col("no") / FOLD).cast("long").alias("no")).agg(F.array_sort(F.collect_list(F.struct("no", "start", "n_tokens", "n_docs", "root", "whole"))).alias("nodes"))
        nodes = above.mapInArrow(join, NODE)
        last //= FOLD
        if not last:
            return nodes


def write_store(docs: DataFrame, root: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts of any length and write the store.

    A null text is an empty one; documents with equal ids stand together, null ids first; other columns, whatever their
    names, are not read; an empty table gives an empty store.
    """
    spark = docs.sparkSession
    rows = chunk_rows(docs, tokenizer_path, end_id, id_col, text_col)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Of the rows of a chunk (one a task at most) the first stays; the window's order is the one that the writer needs.
    alike = F.row_number().over(Window.partitionBy("kind", "hash").orderBy("n_ids"))
    dealt = rows.repartition(n, "hash").withColumn("no", alike).where("kind = 'r' OR no = 1").drop("no")
    dealt.write.partitionBy("kind").option("compression", "zstd").parquet(f"{root}/parts")
    parts = spark.read.schema(f"{dealt.drop('kind').schema.simpleString()[7:-1].replace(':', ' ')}, kind string").parquet(f"{root}/parts")

    recipes = parts.where("kind = 'r'").select("doc_id", F.col("n_ids").alias("n_tokens"), "chunks")
    ordered = recipes.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered = ordered.withColumn("shard", F.spark_partition_id())

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document's number and place in its shard, and its Merkle root."""
        before = met = 0
        for b in batches:
            tokens = b.column(1).to_numpy()
            at = before + np.cumsum(tokens) - tokens
            before += int(tokens.sum())
            roots = [merkle_root(x) for x in b.column(2).to_pylist()]
            no = np.arange(met, met + b.num_rows)
            met += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(no), pa.array(at, pa.int64()), pa.array(roots, pa.binary())], [*b.schema.names, "no", "start", "root"])

    doc_kind = recipes.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {doc_kind}, n_tokens long, chunks array<binary>, shard int, no long, start long, root binary"
    ordered.mapInArrow(rooted, shape).write.option("compression", "zstd").parquet(f"{root}/recipes")

    width = encoder(tokenizer_path).dtype.itemsize
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    told = folded(spark.read.parquet(f"{root}/recipes")).select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"), "n_docs", "n_tokens", F.lit(width).alias("width"), "root")
    told.coalesce(1).write.parquet(f"{root}/manifest")


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("hash binary, payload binary, kind string").parquet(f"{root}/parts").where("kind = 'c'").select("hash", "payload")


def _verify(spark: SparkSession, root: str) -> None:
    """Hold the manifest against the recipes: each shard's root, documents, tokens and places, and the shards' own places."""
    manifest = spark.read.parquet(f"{root}/manifest").select("shard", "n_docs", "n_tokens", "root", F.col("start").alias("at"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    told = manifest.withColumn("placed", F.col("at") == F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    held = folded(spark.read.parquet(f"{root}/recipes")).withColumnsRenamed({c: f"own_{c}" for c in ("n_docs", "n_tokens", "root", "start")})
    same = F.col("placed") & F.col("whole") & (F.col("own_start") == 0)
    for c in ("n_docs", "n_tokens", "root"):
        same = same & (F.col(c) == F.col(f"own_{c}"))
    if wrong := told.join(held, "shard", "full_outer").where(~F.coalesce(same, F.lit(False))).select("shard").take(1):
        raise ValueError(f"the recipes of shard {wrong[0]['shard']} do not match the manifest")


def _recipes(spark: SparkSession, root: str) -> DataFrame:
    """Recipes with ``start`` in the whole stream."""
    shards = spark.read.parquet(f"{root}/manifest").select("shard", F.col("start").alias("shard_start"))
    found = spark.read.parquet(f"{root}/recipes").join(shards, "shard")
    return found.withColumn("start", F.col("start") + F.col("shard_start")).drop("shard", "shard_start", "no")


def read_digests(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    Every chunk's payload is read and held against its hash; its crc32 over 32-bit ids is combined along the recipes,
    whose hashes are held against the documents' Merkle roots, and those against the manifest. Payloads do not move
    between machines. A chunk or a recipe that is missing or altered raises an error.
    """
    _verify(spark, root)
    width = int(spark.read.parquet(f"{root}/manifest").select("width").first()["width"]) if _any(spark, root) else 2

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads = b.column(1)
            if any(digest(p.as_buffer()) != h for h, p in zip(b.column(0).to_pylist(), payloads, strict=True)):
                raise ValueError("a chunk's payload does not match its hash")
            ids = np.frombuffer(b"".join(payloads.to_pylist()), f"<u{width}").astype("<u4")
            sizes = pc.binary_length(payloads).to_numpy() // width
            edges = np.append(0, np.cumsum(sizes, dtype=np.int64)) * 4
            raw = memoryview(ids).cast("B")
            crcs = [zlib.crc32(raw[x:y]) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int32())], ["hash", "crc", "n"])

    chunks = _chunks(spark, root).mapInArrow(weigh, "hash binary, crc long, n int")
    recipes = _recipes(spark, root)
    used = recipes.select("doc_id", "start", "n_tokens", "root", F.size("chunks").alias("size"), F.posexplode_outer("chunks").alias("pos", "hash"))
    met = used.join(chunks, "hash", "left").groupBy("doc_id", "start", "n_tokens", "root", "size").agg(F.collect_list(F.struct("pos", "crc", "n", "hash")).alias("list"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(5)
            edges = lists.offsets.to_numpy()
            flat = lists.flatten()
            pos, crc, n, name = (flat.field(k) for k in range(4))
            owner = np.repeat(np.arange(b.num_rows), np.diff(edges))
            size = pc.fill_null(n, 0).to_numpy()
            order = np.lexsort((pc.fill_null(pos, 0).to_numpy(), owner))
            tokens = np.bincount(owner, size, minlength=b.num_rows).astype(np.int64)
            names = name.take(pa.array(order)).to_pylist()
            edges = edges - edges[0]
            roots = [merkle_root(names[x:y]) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)] if None not in names else []
            if crc.null_count or not (tokens == b.column(2).to_numpy()).all() or not (np.diff(edges) == b.column(4).to_numpy()).all() or roots != b.column(3).to_pylist():
                raise ValueError("a document's chunks do not match its recipe")
            crcs = joined_crcs(crc.to_numpy()[order], 4 * size[order].astype(np.int64), owner)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crcs.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = recipes.schema["doc_id"].dataType.simpleString()
    return met.mapInArrow(combine, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def _any(spark: SparkSession, root: str) -> bool:
    return bool(spark.read.parquet(f"{root}/manifest").take(1))


def read_ids(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, start, ids`` (array of int) of every document, put together again from recipes and chunks; with the
    checks of ``read_digests``."""
    _verify(spark, root)
    width = int(spark.read.parquet(f"{root}/manifest").select("width").first()["width"]) if _any(spark, root) else 2
    chunks = _chunks(spark, root)
    used = _recipes(spark, root).select("doc_id", "start", "n_tokens", "root", F.size("chunks").alias("size"), F.posexplode_outer("chunks").alias("pos", "hash"))
    met = used.join(chunks, "hash", "left").groupBy("doc_id", "start", "n_tokens", "root", "size").agg(F.array_sort(F.collect_list(F.struct("pos", "hash", "payload"))).alias("list"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for n, root_, size, pieces in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                if len(pieces) != size or any(x["payload"] is None for x in pieces) or merkle_root([x["hash"] for x in pieces]) != root_:
                    raise ValueError("a document's chunks do not match its recipe")
                if any(digest(x["payload"]) != x["hash"] for x in pieces):
                    raise ValueError("a chunk's payload does not match its hash")
                ids.append(np.frombuffer(b"".join(x["payload"] for x in pieces), f"<u{width}").astype(np.int32))
                if len(ids[-1]) != n:
                    raise ValueError("a document's chunks do not match its recipe")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    kind = _recipes(spark, root).schema["doc_id"].dataType.simpleString()
    return met.mapInArrow(join, f"doc_id {kind}, start long, ids array<int>")
