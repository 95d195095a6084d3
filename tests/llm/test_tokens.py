"""Token ids, packing and the content-addressed store against direct use of the tokenizers library."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from navgraph.llm import packing, token_store
from navgraph.llm.common import new_path
from navgraph.llm.queries import QUERIES, tokenizer_file
from navgraph.llm.token_ids import Encoder

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
PARTS = st.sampled_from(["the", " the", "Öl", "é", "é", "日本", "²", "½", "'s", "'", "a1b2", "<|endoftext|>", "  ", "\n", "\n\n", "\t", "\x1c", "\u0085", " ", "...", "!?", "İ", " ", "x"])


@pytest.mark.parametrize("file", FILES)
def test_memo_equals_library(file):
    own, plain = Encoder(tokenizer_file(file)), Tokenizer.from_file(tokenizer_file(file))

    @settings(max_examples=400, deadline=None)
    @given(st.one_of(st.lists(PARTS, max_size=12).map("".join), st.text(max_size=30)))
    def check(text):
        assert own.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids

    check()


def ids_of(file, text, end):
    return np.array(Tokenizer.from_file(tokenizer_file(file)).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def expected_pieces(rows, capacity):
    out = []
    for doc, text in rows:
        ids = ids_of(FILES[0], text, 2)
        first = len(ids) % capacity or capacity
        at = [0, *range(first, len(ids) + 1, capacity)]
        out += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]
    return sorted(out)


def check_places(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_odd_rows(odd_docs):
    got = packing.pack_documents(odd_docs, tokenizer_file(FILES[0])).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected_pieces([(r.doc_id, r.text) for r in odd_docs.collect()], 1024)
    total = sum(r.length for r in got)
    assert -(-total // 1024) <= check_places(got, 1024) <= -(-total // 1024) + 1


def test_packing_table(spark, sf_dir):
    got = QUERIES["op3_best_fit_packing"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected_pieces([tuple(r) for r in docs], 1024)
    assert check_places(got, 1024) <= 1.02 * sum(r.length for r in got) / 1024 + 1


def test_pieces_with_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 1)  # many buckets
    rows = [(k % 5, 0, 1 + k % 9, "x", k, 7) for k in range(400)]
    got = packing.pack_pieces(spark.createDataFrame(rows, "doc_id long, piece int, length long, rank string, rank_bucket int, n int"), 20).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.rank, r.rank_bucket, r.n) for r in got) == sorted(rows)
    assert check_places(got, 20) == -(-sum(r[2] for r in rows) // 20)


def test_store_query_on_a_table(spark, sf_dir):
    """The whole query against direct encoding of the whole table."""
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    start, expected = 0, []
    for doc, text in docs:
        ids = ids_of(FILES[1], text, 1)
        expected.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op9_token_store"](spark, sf_dir).collect()) == expected


def test_empty_table(no_docs):
    assert packing.pack_documents(no_docs, tokenizer_file(FILES[0])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 9), max_size=12))
def test_plan_places_each_piece_once(histogram):
    sequences = packing.plan(histogram, 40)
    used = Counter()
    for lengths, times in sequences:
        assert sum(lengths) <= 40 and times > 0
        assert sum(3 * x > 40 for x in lengths) <= 2
        for x in lengths:
            used[x] += times
    assert used == Counter({k: v for k, v in histogram.items() if v})


def test_store_round_trip(spark, odd_docs):
    root = new_path(spark, "store-test")
    token_store.write_store(odd_docs, root, tokenizer_file(FILES[1]))
    rows = sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=lambda x: x[0])
    at, expected = 0, []
    for doc, text in rows:
        ids = ids_of(FILES[1], text, 1)
        expected.append((doc, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted(token_store.read_digests(spark, root).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(expected)
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert start == at
    ids = {(r.start): r.ids for r in token_store.read_ids(spark, root).collect()}
    assert all(zlib.crc32(np.array(ids[r.start], "<u4").tobytes()) == r.ids_crc32 for r in got)
    chunks = spark.read.parquet(f"{root}/parts").where("kind = 'c'")
    assert chunks.count() == chunks.select("hash").distinct().count()


def test_store_finds_damage(spark, odd_docs):
    root = new_path(spark, "store-damage")
    token_store.write_store(odd_docs, root, tokenizer_file(FILES[1]))
    parts = spark.read.parquet(f"{root}/parts")
    hurt = new_path(spark, "store-hurt")
    one = parts.where("kind = 'c'").first()["hash"]
    parts.where((parts["kind"] == "r") | (parts["hash"] != one)).write.partitionBy("kind").parquet(f"{hurt}/parts")
    for table in ("recipes", "manifest"):
        spark.read.parquet(f"{root}/{table}").write.parquet(f"{hurt}/{table}")
    with pytest.raises(Exception, match="do not match"):
        token_store.read_digests(spark, hurt).collect()


def test_store_finds_lost_and_changed_recipes(spark, odd_docs):
    root = new_path(spark, "store-recipes")
    token_store.write_store(odd_docs, root, tokenizer_file(FILES[1]))
    tables = {name: spark.read.parquet(f"{root}/{name}") for name in ("recipes", "manifest", "parts")}
    one, other = tables["recipes"].orderBy("shard", "start").collect()[:2]
    here = (F.col("shard") == one["shard"]) & (F.col("start") == one["start"])
    swap = lambda column, value: F.when(here, F.lit(value)).otherwise(F.col(column))
    lost = tables["recipes"].where(~here)
    forged = tables["recipes"].withColumns({"root": swap("root", token_store.digest(b"else")), "n_tokens": swap("n_tokens", other["n_tokens"])})
    emptied = tables["recipes"].withColumn("chunks", F.when(here, F.array().cast("array<binary>")).otherwise(F.col("chunks")))
    unlisted = tables["manifest"].where(F.col("shard") != one["shard"])
    altered = tables["parts"].withColumn("payload", F.when(F.col("kind") == "c", F.concat("payload", F.lit(b"\0\0"))))
    for k, change in enumerate(({"recipes": lost}, {"recipes": forged}, {"recipes": emptied}, {"manifest": unlisted}, {"parts": altered})):
        hurt = new_path(spark, f"store-hurt-{k}")
        for name, table in (tables | change).items():
            (table.write.partitionBy("kind") if name == "parts" else table.write).parquet(f"{hurt}/{name}")
        for read in (token_store.read_digests, token_store.read_ids):
            with pytest.raises(Exception, match="not match"):
                read(spark, hurt).collect()


def test_store_of_nothing(spark, no_docs):
    root = new_path(spark, "store-empty")
    token_store.write_store(no_docs, root, tokenizer_file(FILES[1]))
    assert token_store.read_digests(spark, root).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=90), min_size=1, max_size=9), min_size=1, max_size=5))
def test_crc_of_joined_parts(owners):
    parts = [(k, p) for k, own in enumerate(owners) for p in own]
    crc, size, owner = (np.array(x) for x in ([zlib.crc32(p) for _, p in parts], [len(p) for _, p in parts], [k for k, _ in parts]))
    assert token_store.joined_crcs(crc, size, owner).tolist() == [zlib.crc32(b"".join(own)) for own in owners]


def test_folding_equals_one_tree(spark, monkeypatch):
    monkeypatch.setattr(token_store, "FOLD", 4)
    roots = [token_store.digest(str(k).encode()) for k in range(37)]
    rows = [(7, k, 10 * k, 10, r) for k, r in enumerate(roots)] + [(8, 0, 0, 3, roots[0]), (9, 0, 0, 3, roots[0]), (9, 1, 4, 1, roots[1])]
    got = {r.shard: r for r in token_store.folded(spark.createDataFrame(rows, "shard int, no long, start long, n_tokens long, root binary")).collect()}
    assert bytes(got[7].root) == token_store.merkle_root(roots) and (got[7].n_tokens, got[7].n_docs, got[7].whole) == (370, 37, True)
    assert bytes(got[8].root) == roots[0] and not got[9].whole


def test_cuts_follow_content():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 49_000, 20_000).astype("<u2")
    a, b = np.concatenate([rng.integers(0, 49_000, 777).astype("<u2"), common]), np.concatenate([rng.integers(0, 49_000, 3_001).astype("<u2"), common])

    def chunks(ids):
        at = token_store.cuts(ids)
        assert at[0] == 0 and at[-1] == len(ids) and all(0 < y - x <= token_store.MOST_IDS for x, y in zip(at, at[1:], strict=False))
        return {ids[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)}

    assert sum(len(c) for c in chunks(a) & chunks(b)) > 0.8 * 2 * len(common)
