"""The corpus operators as queries over whole tables: ``QUERIES`` and, where SQL can express them, ``ORACLES``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navgraph.llm import decontaminate, language_id, line_dedup, packing, quality_classifier, quality_rules, secret_scan, simhash, token_store, toxicity
from navgraph.llm.common import checkpointed, crc_mod, delete_path, new_path, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a test item with edits up to a tenth of its length, with the item and the edits."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), budget=0.10)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents share: counts of lines and the digest of what stays."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 1,024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; labels are learnt from rows whose crc32(doc_id) is not divisible by 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(crc_mod("doc_id", 5) != 0)
    model = toxicity.fit(docs, labels, fit_rows=20_000)
    scored = toxicity.score(docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))), model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, symbol and repetition figures of every document, and the verdict."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text by the scorer that weak labels trained; no given label is read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, fit_rows=6_000), ["doc_id"])
    return scored.select("doc_id", "score", "predicted", (F.col("predicted") == 1).alias("kept"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; learnt from rows whose crc32(doc_id) modulo 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(crc_mod("doc_id", 4) != 2), fit_rows=4_000)
    return language_id.predict(docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))), model, ["doc_id", "held_out"])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints over four-word shingles, linked at four bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids to a content-addressed store and read their digests back from its files, which go then."""
    root = new_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), root, tokenizer_file("word_bpe_49k.json"), end_id=1)
    digests = checkpointed(token_store.read_digests(spark, root))
    delete_path(spark, root)
    return digests


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's score."""
    model = secret_scan.fit(secret_scan.labelled_findings(spark))
    return secret_scan.scan(table(spark, sf_dir, "documents"), model)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_line_dedup, op3_best_fit_packing, op4_toxicity, op5_quality_rules,
        op6_quality_classifier, op7_language_id, op8_simhash, op9_token_store, op10_secret_scan,
    )
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": r"""
        WITH lines AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
          FROM documents),
        keyed AS (
          SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
        frequent AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
               sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
        FROM keyed LEFT JOIN frequent f ON f.k = keyed.k GROUP BY doc_id""",
    "op5_quality_rules": r"""
        WITH texts AS (
          SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        sizes AS (
          SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                 length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM texts),
        spots AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts),
        ahead AS (
          SELECT doc_id, pos, concat_ws(' ', word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w) AS five,
                 lead(word, 4) OVER w AS w4, lead(word, 5) OVER w AS w5, lead(word, 6) OVER w AS w6, lead(word, 7) OVER w AS w7, lead(word, 8) OVER w AS w8, lead(word, 9) OVER w AS w9
          FROM spots WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        windows AS (
          SELECT doc_id, 5 AS n, pos, five AS key FROM ahead WHERE w4 IS NOT NULL
          UNION ALL SELECT doc_id, 6, pos, concat_ws(' ', five, w5) FROM ahead WHERE w5 IS NOT NULL
          UNION ALL SELECT doc_id, 7, pos, concat_ws(' ', five, w5, w6) FROM ahead WHERE w6 IS NOT NULL
          UNION ALL SELECT doc_id, 8, pos, concat_ws(' ', five, w5, w6, w7) FROM ahead WHERE w7 IS NOT NULL
          UNION ALL SELECT doc_id, 9, pos, concat_ws(' ', five, w5, w6, w7, w8) FROM ahead WHERE w8 IS NOT NULL
          UNION ALL SELECT doc_id, 10, pos, concat_ws(' ', five, w5, w6, w7, w8, w9) FROM ahead WHERE w9 IS NOT NULL),
        twice AS (SELECT doc_id, n, unnest(list(pos)) AS pos FROM windows GROUP BY doc_id, n, key HAVING count(*) > 1),
        inside AS (SELECT DISTINCT doc_id, n, unnest(range(pos, pos + n)) AS pos FROM twice),
        covered AS (
          SELECT i.doc_id, n, count(*) AS n_inside, sum(length(word)) AS chars FROM inside i JOIN spots s ON s.doc_id = i.doc_id AND s.pos = i.pos GROUP BY ALL),
        repeats AS (
          SELECT c.doc_id, coalesce(max(n_inside) FILTER (n = 5), 0) AS n_repeat_words, max(chars) AS most,
                 bool_or(chars > (CASE n WHEN 5 THEN 0.15 WHEN 6 THEN 0.14 WHEN 7 THEN 0.13 WHEN 8 THEN 0.12 WHEN 9 THEN 0.11 ELSE 0.10 END)::DOUBLE * greatest(word_chars, 1)) AS over_limit
          FROM covered c JOIN sizes s ON s.doc_id = c.doc_id GROUP BY c.doc_id),
        lines AS (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM texts),
        again AS (
          SELECT doc_id, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS k
          FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        dups AS (SELECT doc_id, count(*) AS n_dup_lines, sum(chars) AS chars FROM again WHERE k > 1 GROUP BY doc_id),
        told AS (
          SELECT s.*, coalesce(d.n_dup_lines, 0) AS n_dup_lines, coalesce(d.chars, 0) AS dup_chars, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
                 coalesce(r.most, 0) AS most, coalesce(r.over_limit, false) AS over_limit, greatest(word_chars, 1) AS whole,
                 n_words < 10 OR 100 * coalesce(r.n_repeat_words, 0) > 20 * n_words AS base_failed
          FROM sizes s LEFT JOIN dups d ON d.doc_id = s.doc_id LEFT JOIN repeats r ON r.doc_id = s.doc_id)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT over_limit AND dup_chars <= 0.2::DOUBLE * whole AND n_symbols <= 0.3::DOUBLE * greatest(n_words, 1) AS kept,
               most / whole AS ngram_cover, dup_chars / whole AS line_cover FROM told""",
}
