"""The pipeline against the stages' brute-force versions, one after the other; those use nothing of the library."""

import hashlib
import re

from test_dedup import brute_components, brute_kept, brute_lines
from test_scoring import distance
from test_tokens import check_places, expected_pieces

import corpus_pipeline


def brute_clean_text(rows, min_docs=10):
    """Texts after line dedup, by the same rule as ``brute_lines`` and held against its digests."""
    from collections import Counter

    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for _, text in rows for k in {key(x) for x in (text or "").split("\n")} if k)
    out = [(doc, "\n".join(x for x in (text or "").split("\n") if not key(x) or seen[key(x)] < min_docs)) for doc, text in rows]
    assert sorted((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in out) == sorted((d, s) for d, _, _, s in brute_lines(rows, min_docs))
    return out


def brute(rows, items):
    rows = [(d, t) for d, t in rows if brute_kept(t)]
    rows = brute_clean_text(rows)
    keep = {d for d, _, c in brute_components(rows) if d == c}
    rows = [(d, t) for d, t in rows if d in keep]
    plain = lambda text: " ".join(re.findall(r"[^\W_]+", text.lower()))
    norm = [x for x in map(plain, items) if len(x) >= 24]

    def leaks(text):
        body = plain(text)
        for x in norm:
            most = int(len(x) * 0.10)
            cut = [len(x) * k // (most + 1) for k in range(most + 2)]
            # a necessary condition first: one of the pieces that the edits leave whole stands in the text
            if any(x[a:b] in body for a, b in zip(cut, cut[1:], strict=False)) and distance(x, body) <= most:
                return True
        return False

    return [(d, t) for d, t in rows if not leaks(t)]


def test_pipeline(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    short = [(d, t) for d, t in brute(rows, items)]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected_pieces(short, 1024)
    check_places(got, 1024)


def test_stages_keep_the_columns(spark, odd_docs, sf_dir):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns and after.count() <= docs.count()
        docs = after


def test_near_duplicates_leave_one_row_a_group(spark, odd_docs):
    kept = corpus_pipeline.near_duplicates(spark, odd_docs, "").collect()
    groups = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in odd_docs.collect()])}
    assert sorted(r.doc_id for r in kept) == sorted(groups)
    a, b, c = (" ".join(f"{x}{k * k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (2, b), (3, c), (4, a), (4, c), (None, a), (None, "d e f g h"), (None, "d e f g h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(((r.doc_id or 0, r.text) for r in kept)) == sorted([(1, a), (1, b), (3, c), (0, "d e f g h")])


def test_stages_with_clashing_columns(spark, odd_docs, sf_dir):
    docs = odd_docs.withColumnsRenamed({"h1": "n_lines", "n": "n_dropped", "key": "item_id"})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "item_id", "n_lines", "n_dropped"]
        assert {(r.n_lines, r.n_dropped) for r in docs.collect()} == {(1, 2)}


def test_stages_on_nothing(spark, no_docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0
