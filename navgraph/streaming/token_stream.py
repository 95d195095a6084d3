"""The inverted index over a growing folder of documents, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from navgraph.operators.index import token_index


def start_index(spark: SparkSession, source: str, schema: str, index: str, state: str, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Append every new document's tokens to the Parquet folder ``index``; ``state`` keeps what was read.

    Each micro-batch is a folder of its own (``batch``), so that a batch that is run again replaces its earlier try.
    """

    def write(batch: DataFrame, number: int) -> None:
        tokens = token_index(batch, id_col, text_col).withColumn("batch", F.lit(number))
        tokens.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(index)

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
