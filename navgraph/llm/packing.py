"""Best-fit packing of token pieces into sequences of one length (large-item matching).

The plan needs lengths only, and there are at most ``capacity`` of them, so it is made from the histogram of lengths:
a table of bounded size whatever the corpus. Pieces above a third of the capacity can stand at most two in a sequence;
the largest of them takes the largest partner that still fits. Smaller pieces then go, longest first, into the tightest
gap that holds them. Whole classes of equal sequences are filled at once, so planning takes time by lengths, not by
documents. Each piece then gets its place from its rank among the pieces of its length; ranks are counted inside
buckets of a hash, so that a length that a third of all pieces share is dealt over all tasks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navgraph.llm.common import checkpointed, text_bytes
from navgraph.llm.token_ids import encoder, text_slices

#: Pieces of one length are ranked inside buckets of a hash: 256 at least, and so many that one holds no more than about
#: RANK_ROWS pieces; they follow from the table, so that places do not depend on the cluster.
RANK_BUCKETS, RANK_ROWS = 256, 500_000


class Bins:
    """Classes of equal sequences by the room that is left: gap -> [(lengths, how many)]."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def add(self, lengths: tuple[int, ...], times: int) -> None:
        if times:
            gap = self.capacity - sum(lengths)
            self.by_gap[gap].append((lengths, times))

    def tightest(self, length: int) -> int | None:
        return min((g for g, have in self.by_gap.items() if g >= length and have), default=None)

    def all(self) -> list[tuple[tuple[int, ...], int]]:
        return [x for gap in sorted(self.by_gap) for x in self.by_gap[gap]]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in order, how many such sequences)."""
    left = {length: n for length, n in histogram.items() if n > 0}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError("a length is not between 1 and the capacity")
    bins = Bins(capacity)
    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for length in large:
        while left[length]:
            room = capacity - length
            mate = next((x for x in large if x <= room and left[x] > (x == length)), None)
            if mate is None:
                bins.add((length,), left[length])
                left[length] = 0
            elif mate == length:
                bins.add((length, length), left[length] // 2)
                left[length] %= 2
            else:
                times = min(left[length], left[mate])
                bins.add((length, mate), times)
                left[length] -= times
                left[mate] -= times
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[length]
        while n:
            gap = bins.tightest(length)
            if gap is None:
                each = capacity // length
                bins.add((length,) * each, n // each)
                bins.add((length,) * (n % each), 1 if n % each else 0)
                break
            lengths, times = bins.by_gap[gap].pop()
            each = gap // length  # a sequence that got one piece is the tightest for the next one
            full = min(times, n // each)
            bins.add(lengths + (length,) * each, full)
            n -= full * each
            if full < times:
                bins.add(lengths, times - full - (n > 0))
                bins.add(lengths + (length,) * n, 1 if n else 0)
                n = 0
    return bins.all()


def places(sequences: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For runs of ranks of a length: the first sequence they go to and their offset there, sorted by (length, rank)."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, times in sequences:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "sequence", "offset"), columns, strict=True))


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``. A null text counts as empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for part in text_slices(batches):
            ids, borders = own.batch(part.column(1), end_id)
            ids = ids.astype("<u4")
            size = np.diff(borders)
            n = -(-size // capacity)
            last = np.cumsum(n)
            owner = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(owner)) - (last - n)[owner]
            first = (size - (n - 1) * capacity)[owner]  # the first piece takes what whole pieces leave over
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            length = np.where(piece == 0, first, capacity)
            at = borders[owner] + start
            raw = memoryview(ids).cast("B")
            crcs = [zlib.crc32(raw[a:b]) for a, b in zip((4 * at).tolist(), (4 * (at + length)).tolist(), strict=True)]
            columns = [part.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id, offset`` to rows with a ``length`` from 1 to ``capacity``; ``doc_id, piece`` order equal lengths.

    Each row gets a place of its own, repeated rows too. Which of several equally long pieces takes which of their
    places follows the hash of ``doc_id`` and ``piece`` (null ids too). Other columns pass unchanged, whatever their
    names. An empty table gives an empty table.
    """
    names = pieces.columns
    own = {c: f"__navgraph_{c}" for c in names if c not in ("doc_id", "piece", "length")}  # no clash with rank, bucket, ...
    kept = checkpointed(pieces.withColumnsRenamed(own))
    histogram = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(plan(histogram, capacity))
    buckets = max(RANK_BUCKETS, 1 << (max(histogram.values(), default=0) // RANK_ROWS).bit_length())
    ranked = kept.withColumn("rank_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    by_bucket = ranked.groupBy("length", "rank_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("rank_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_bucket.select("length", "rank_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_base"))

    inside = Window.partitionBy("length", "rank_bucket").orderBy("doc_id", "piece")
    numbered = ranked.withColumn("rank_here", F.row_number().over(inside) - 1)
    numbered = numbered.join(bases, ["length", "rank_bucket"]).withColumn("rank", F.col("rank_base") + F.col("rank_here"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (where["length"] << 44) + where["rank"]  # ranks below 2**44, lengths below 2**19
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            keep = [b.column(b.schema.get_field_index(own.get(c, c))) for c in names]
            sequence = where["sequence"][at] + rank - where["rank"][at]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(where["offset"][at])], [*names, "sequence_id", "offset"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return numbered.mapInArrow(place, f"{shape}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize whole texts, cut those over ``capacity`` (the first piece takes the remainder) and pack all pieces.

    Null and empty texts are documents of the end id alone. Other columns of ``docs`` are not read.
    """
    return pack_pieces(tokenize_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), capacity)
