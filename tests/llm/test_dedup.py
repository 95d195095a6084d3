"""Line dedup, quality rules and SimHash against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from compare import assert_same
from pyspark.sql import functions as F

from navgraph.llm import line_dedup, quality_rules, simhash
from navgraph.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def brute_lines(rows, min_docs):
    keys = lambda text: [lower(x.strip(" \t\n\x0b\x0c\r")) for x in (text or "").split("\n")]
    seen = Counter(k for _, text in rows for k in set(keys(text)) if k)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x, k in zip(lines, keys(text), strict=True) if seen[k] < min_docs or not k]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def digest(df):
    kept = df.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256))
    return sorted(tuple(r) for r in kept.collect())


def test_line_dedup_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = line_dedup.dedup_lines(odd_docs, min_docs=10)
    assert digest(got) == brute_lines(rows, 10)
    assert set(odd_docs.columns) | {"n_lines", "n_dropped"} == set(got.columns)
    assert got.where("text IS NULL").count() == 2


def test_line_dedup_counts_an_id_once(spark):
    rows = [(1, "own line\nshared")] * 10 + [(1, "shared\nanother text")] + [(k, f"shared\nown {k}") for k in range(2, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.n_dropped for r in line_dedup.dedup_lines(docs, min_docs=10).collect()) == [0] * len(rows)
    more = docs.unionByName(spark.createDataFrame([(10, "Shared ")], docs.schema))
    assert sorted(r.n_dropped for r in line_dedup.dedup_lines(more, min_docs=10).collect()) == [1] * (len(rows) + 1)


def test_line_dedup_levels(spark):
    rows = [(k, f"line {k % 7}\nown {k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(line_dedup.dedup_lines(docs, min_docs=9, batches=9)) == brute_lines(rows, 9)


def test_line_runs_are_merged_without_exchange(spark):
    """A batch meets the runs by merge joins over tables in the same buckets; neither the runs nor the batch move."""
    docs = spark.createDataFrame([(k, f"line {k % 7}\nown {k}") for k in range(60)], "doc_id long, text string")
    runs = line_dedup.LineRuns(spark, min_docs=9)
    _, parts = runs.stage(docs, batches=4)
    for counts in parts[:3]:
        runs.add(counts)
    plan = runs._fresh(parts[3])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "LeftAnti" in plan and "Exchange" not in plan
    merged = runs._read(runs._runs() + [runs._write(parts[3].withColumn("frequent", F.lit(False)))]).groupBy(*line_dedup.HASH).agg(F.sum("n_docs"))
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    runs.add(parts[3])
    assert runs.frequent().count() == 4  # of the seven, four stand in nine documents or more
    runs.clear()


def test_line_dedup_without_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        got = line_dedup.dedup_lines(spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string"))
        assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in got.collect()) == [(1, 2, 0), (2, 1, 0)]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_line_dedup_empty(no_docs):
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_line_dedup_sql(spark, sf_dir):
    assert_same(QUERIES["op2_line_dedup"](spark, sf_dir), ORACLES["op2_line_dedup"], sf_dir)


def brute_rules(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    inside = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside), n < 10 or 100 * len(inside) > 20 * n


def brute_kept(text):
    """The verdict in plain Python: base rules, characters in repeated windows of 5 to 10 words, repeated lines, symbols."""
    n, whole, symbols, _, _, failed = brute_rules(text)
    words, limits = WORD.findall(text or ""), {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
    for size, share in limits.items():
        windows = Counter(tuple(words[k : k + size]) for k in range(n - size + 1))
        inside = {j for k in range(n - size + 1) if windows[tuple(words[k : k + size])] > 1 for j in range(k, k + size)}
        failed = failed or sum(len(words[j]) for j in inside) > share * max(whole, 1)
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if line in seen:
            again += len("".join(WORD.findall(line)))
        elif WORD.search(line):
            seen.add(line)
    return not (failed or again > 0.2 * max(whole, 1) or symbols > 0.3 * max(n, 1))


def test_quality_rules_sql(spark, sf_dir):
    assert_same(QUERIES["op5_quality_rules"](spark, sf_dir), ORACLES["op5_quality_rules"], sf_dir)


@pytest.mark.parametrize("which", ["odd", "table"])
def test_quality_rules(spark, sf_dir, odd_docs, which):
    docs = odd_docs if which == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = sorted((r.doc_id, *brute_rules(r.text)) for r in docs.collect())
    got = quality_rules.judge(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == expected
    assert sorted((r.doc_id, r.kept) for r in got) == sorted((r.doc_id, brute_kept(r.text)) for r in docs.collect())
    assert sorted(r.doc_id for r in quality_rules.keep_good(docs).collect()) == sorted(r.doc_id for r in got if r.kept)


def test_quality_rules_verdicts():
    rules, rng = quality_rules.RepetitionLimits(), random.Random(2)
    clean = " ".join(f"w{rng.randrange(10_000)}" for _ in range(400))
    assert quality_rules.measure(clean.encode(), rules)[6]
    tail = " ".join(f"w{rng.randrange(10_000)}" for _ in range(60))
    repeated = clean + " " + tail + " " + tail  # under a fifth of the words, over a tenth of the characters in ten-grams
    assert not quality_rules.measure(repeated.encode(), rules)[6]
    assert not quality_rules.measure(b"one two three four five six seven\n" * 2 + b"a b c", rules)[6]


def test_quality_rules_empty(no_docs):
    assert quality_rules.judge(no_docs).count() == 0 and quality_rules.keep_good(no_docs).count() == 0


def brute_simhash(text):
    words = WORD.findall(lower(text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_simhash(t) for _, t in rows]
    least = {}
    for (doc, _), fp in zip(rows, prints, strict=True):
        least[fp] = min(doc, least.get(fp, doc))
    nodes = sorted(least)
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(nodes, np.uint64)
    for x in nodes:
        for y in values[np.bitwise_count(values ^ np.uint64(x)) <= 4].tolist():
            parent[root(x)] = root(y)
    name = defaultdict(lambda: float("inf"))
    for x in nodes:
        name[root(x)] = min(name[root(x)], least[x])
    return sorted((doc, f"{fp:016x}", name[root(fp)]) for (doc, _), fp in zip(rows, prints, strict=True))


@pytest.mark.parametrize("which", ["odd", "table"])
def test_simhash(spark, sf_dir, odd_docs, which):
    docs = odd_docs if which == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_simhash_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("block", [16, 2048])
def test_links_of_dense_and_spread_fingerprints(spark, monkeypatch, block):
    """Chains, dense balls (more members than a block) and pairs at exactly four and five bits."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(11)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(3):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(120)}
    for _ in range(150):
        x = rng.getrandbits(64)
        prints |= {x, x ^ sum(1 << b for b in rng.sample(range(64), rng.choice([3, 4, 5])))}
    values = np.array(sorted(prints), np.uint64)
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values ^ v) <= 4):
            parent[root(int(j))] = root(k)
    groups = defaultdict(set)
    for k, v in enumerate(values.view(np.int64).tolist()):
        groups[root(k)].add(v)
    expected = sorted(sorted(g) for g in groups.values() if len(g) > 1)
    df = spark.createDataFrame([(v,) for v in values.view(np.int64).tolist()], "fp long")
    links = simhash.link(df)
    found = defaultdict(set)
    for r in simhash.smallest_reachable(links).collect():
        found[r.root].add(r.node)
    assert sorted(sorted(g) for g in found.values()) == expected


def test_smallest_reachable_on_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in simhash.smallest_reachable(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
