"""From raw documents to packed training sequences: five stages, each written and read again.

Every stage works on all rows that its predecessor kept and returns the columns of ``documents``, but for the last,
which returns the places of the documents' pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navgraph.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from navgraph.llm.common import delete_path, new_path, table
from navgraph.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep; columns unchanged. Null, empty and blank texts go (no words)."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that ten documents share; ``n_chars`` follows the text.

    Null texts stay null, an empty table stays empty, columns named like the operator's own pass through.
    """
    # Columns that the operator would replace go through under names of their own.
    names = {c: f"__navgraph_own_{c}" for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}
    kept = line_dedup.dedup_lines(docs.withColumnsRenamed(names), min_docs=10, min_chars=1).drop("n_lines", "n_dropped")
    kept = kept.withColumnsRenamed({v: k for k, v in names.items()})
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, without an id only where no row has one.

    Rows are told apart by id and text, so rows that share an id each belong to their own text's group; of rows equal in
    both one stays.
    """
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = docs.withColumn("__key", F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), text.alias("text")))
    groups = simhash.near_duplicates(keyed, words=4, radius=4, id_col="__key")
    keep = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(keep, "__key", "left_semi").dropDuplicates(["__key"]).select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; columns unchanged. Null and empty texts hold none and stay."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"), budget=0.10)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the remaining documents' pieces in sequences of 1,024 tokens.

    Null and empty texts are a piece of the end id alone; rows that repeat an id get places of their own.
    """
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("packing", packed),
]

#: Fingerprints, edit matching and tokens are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table; intermediate tables are Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:  # its successor is written: nothing reads it any more
            delete_path(spark, before)
        before = path
    places = STAGES[-1][1](spark, docs, sf_dir)  # holds its pieces in a table of its own
    delete_path(spark, before)
    return places
