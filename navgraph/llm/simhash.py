"""SimHash near-dedup with pigeonring filtering.

Fingerprints of 64 bits link at ``radius`` (4) or fewer differing bits. They are cut into five segments on a ring. By
the pigeonring principle two fingerprints within the radius have a segment from which every chain of l segments differs
in at most l * radius / 5 bits: the first segment is equal, the first two differ in at most one bit, the first three in
at most two. So the 26 bits after an equal segment, in four pieces, hold two equal pieces: fingerprints are looked up
by an equal segment with two of the four pieces (30 keys of about 26 bits), and pairs that share a key must pass the
chain's budgets for two, three and four segments before the whole distance is counted.

Only distinct fingerprints are compared. Inside a key, fingerprints are linked to components without listing pairs;
a key with more members than ``BLOCK`` is dealt over tasks as pairs of blocks. Links are joined to components by
repeated hooking to the smallest neighbour and pointer jumping, all in tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navgraph.llm.common import checkpointed, slices, text_bytes

SEGMENTS = 5
#: Members of a key that one task compares at once.
BLOCK = 2048
#: Shifts with which short runs of a key are compared as whole columns; longer runs are searched one by one.
SHORT_RUN = 12


def fingerprints(raws: list[bytes], words: int = 4, seed: int = 42) -> np.ndarray:
    """A 64-bit SimHash for each text: bit is 1 if set in over half the shingles' XXH64."""
    hashes: list[int] = []
    ends = []
    digest = xxhash.xxh64_intdigest
    for raw in raws:
        tokens = raw.lower().split()
        if 0 < len(tokens) <= words:
            hashes.append(digest(b" ".join(tokens), seed))
        elif tokens:
            hashes += [digest(b" ".join(x), seed) for x in zip(*(tokens[k:] for k in range(words)), strict=False)]
        ends.append(len(hashes))
    out = np.zeros(len(raws), np.uint64)
    if hashes:
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = [0, *ends[:-1]]
        for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
            if b > a:
                most = 2 * bits[a:b].sum(axis=0, dtype=np.int64) > b - a
                out[k] = np.packbits(most).view(">u8")[0]
    return out


def segment_bounds() -> list[tuple[int, int]]:
    """(lowest bit, width) of the five segments of 64 bits: widths 13, 13, 13, 13, 12."""
    widths = [64 // SEGMENTS + (k < 64 % SEGMENTS) for k in range(SEGMENTS)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def ring(fp: np.ndarray, start: int) -> np.ndarray:
    """Fingerprints turned so that segment ``start`` stands at bit 0 and its followers above it."""
    low = segment_bounds()[start][0]
    return fp if low == 0 else (fp >> np.uint64(low)) | (fp << np.uint64(64 - low))


def masks(start: int, radius: int) -> list[tuple[np.uint64, int]]:
    """For chains of 1 to 5 segments from ``start``: the bits they cover in the turned fingerprint, and their budget."""
    out, width = [], 0
    for k in range(SEGMENTS):
        width += segment_bounds()[(start + k) % SEGMENTS][1]
        out.append((np.uint64((1 << width) - 1), (k + 1) * radius // SEGMENTS))
    return out


def chained(x: np.ndarray, chain: list[tuple[np.uint64, int]]) -> np.ndarray:
    """Which differences keep every budget of the chain; the last budget is the radius over all 64 bits."""
    good = np.ones(len(x), bool)
    for mask, budget in chain[:-1]:
        good &= np.bitwise_count(x & mask) <= budget
    live = np.flatnonzero(good)
    good[live] = np.bitwise_count(x[live]) <= chain[-1][1]
    return good


def keys(fp: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number, key) for each ring position and each set of pieces that must be equal."""
    pieces = radius  # budget of three segments plus two: at least two of the pieces are equal
    spare = 3 * radius // SEGMENTS
    for start in range(SEGMENTS):
        turned = ring(fp, start)
        chain = masks(start, radius)
        first, third = int(chain[0][0]).bit_length(), int(chain[2][0]).bit_length()
        borders = [first + (third - first) * k // pieces for k in range(pieces + 1)]
        cut = [np.uint64(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(borders, borders[1:], strict=False)]
        for j, chosen in enumerate(combinations(range(pieces), pieces - spare)):
            mask = chain[0][0]
            for c in chosen:
                mask |= cut[c]
            yield start * 64 + j, turned & mask


def components(fp: np.ndarray, chain: list[tuple[np.uint64, int]], start: int) -> list[tuple[int, int]]:
    """Links that hold together what is linked inside one key: breadth first, each link to a member not met before."""
    turned, left, out = ring(fp, start), np.arange(len(fp)), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            here = front.pop()
            near = chained(turned[left] ^ turned[here], chain)
            met = left[near]
            out += [(here, int(x)) for x in met]
            front += met.tolist()
            left = left[~near]
    return out


def _signed(fp: np.ndarray) -> np.ndarray:
    return fp.view(np.int64)


def link(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links ``a, b`` (signed 64-bit fingerprints) whose components are those of all pairs within ``radius`` bits."""
    if radius != 4:
        raise ValueError("the pieces are laid out for a radius of 4")
    spark = distinct.sparkSession

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for number, key in keys(fp, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), number, np.int16)), pa.array(_signed(key)), b.column(0)], ["no", "key", "fp"])

    spread_rows = distinct.select("fp").mapInArrow(spread, "no short, key long, fp long")
    sizes = spread_rows.groupBy("no", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    sizes = checkpointed(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    shared = spread_rows.join(sizes, ["no", "key"])
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # Block x of y blocks goes to the y pairs of blocks that it belongs to; with one block that is one row.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = shared.select("no", "key", "fp", own.alias("own"), "blocks", other)
    dealt = dealt.select("no", "key", "fp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["no", "key", "low", "high"]
    dealt = dealt.repartition(n, *by).sortWithinPartitions(*by)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def found(t: pa.Table) -> pa.RecordBatch:
            no, key, fp, low, high = (t.column(k).to_numpy() for k in range(5))
            fp = fp.view(np.uint64)
            new = np.ones(len(fp), bool)
            new[1:] = (no[1:] != no[:-1]) | (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            begin = np.flatnonzero(new)
            length = np.diff(np.append(begin, len(fp)))
            run = np.repeat(np.arange(len(begin)), length)
            a, b = [], []
            start = no // 64
            short = length[run] <= SHORT_RUN
            for shift in range(1, min(SHORT_RUN, len(fp))):
                at = np.flatnonzero(short[:-shift] & (run[shift:] == run[:-shift]))
                if not len(at):
                    break
                for s in range(SEGMENTS):
                    of = at[start[at] == s]
                    if len(of):
                        good = of[chained(ring(fp[of], s) ^ ring(fp[of + shift], s), masks(s, radius))]
                        a.append(fp[good])
                        b.append(fp[good + shift])
            for k in np.flatnonzero(length > SHORT_RUN):
                members = fp[begin[k] : begin[k] + length[k]]
                s = int(start[begin[k]])
                if links := components(members, masks(s, radius), s):
                    i, j = np.array(links).T
                    a.append(members[i])
                    b.append(members[j])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(_signed(pairs[:, k].copy())) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            last = [held.column(k)[held.num_rows - 1].as_py() for k in (0, 1, 3, 4)]
            same = np.ones(held.num_rows, bool)
            for k, v in zip((0, 1, 3, 4), last, strict=True):
                same &= held.column(k).to_numpy() == v
            whole = int(np.argmax(same))  # rows of the last key wait for the next batch
            if whole:
                yield found(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield found(held)

    return dealt.mapInArrow(pair, "a long, b long").distinct()


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``): the smallest node of its component.

    Each round every node takes the smallest root among its neighbours' (combined map-side, so a hub's neighbours do
    not meet in one task), then the root's own root. Rounds follow the logarithm of the components' width.
    """
    both = checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    state = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        seen = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        hooked = state.join(seen.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "near").alias("low"))
        # what a node learns, the node that it pointed to learns too
        lifted = hooked.groupBy("root").agg(F.min("low").alias("low")).select(F.col("root").alias("node"), F.col("low").alias("lift"))
        step = hooked.join(lifted, "node", "left").select("node", F.col("root").alias("was"), F.least("low", F.coalesce("lift", "low")).alias("to"))
        step = checkpointed(step)
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        new = checkpointed(step.join(jump, "to", "left").select("node", "was", F.least("to", F.coalesce("next", "to")).alias("root")))
        if not new.where(F.col("was") != F.col("root")).take(1):
            return new.select("node", "root")
        state = new.select("node", "root")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable over links, its own included).

    Null, empty and blank texts have fingerprint zero and link like any other. Rows with a null id link too, but give
    no component its id (it is null only where all its ids are). An empty table gives an empty table; other columns are
    not read.
    """

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fp = fingerprints(part.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_signed(fp))], ["doc_id", "fp"])

    source = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    hashed = checkpointed(source.mapInArrow(hash_texts, f"doc_id {kind}, fp long"))
    distinct = checkpointed(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = smallest_reachable(link(distinct, radius))
    rooted = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = checkpointed(rooted)
    named = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = rooted.join(named, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return hashed.join(named, "fp").select("doc_id", digits, "component_id")
