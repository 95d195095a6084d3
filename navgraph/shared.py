"""What jobs keep between rounds: tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where a local session has none a temporary folder that ends with the process; a
    cluster must name one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        configured = tempfile.mkdtemp(prefix="navgraph-")
        atexit.register(shutil.rmtree, configured, True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def checkpointed(df: DataFrame, plain: bool = False) -> DataFrame:
    """``df`` computed once and kept in the shared folder.

    ``plain`` keeps no constraints between its columns: the optimizer fails on a union of kept tables if those of one
    name columns that the other calls differently (closures that start with a column copied).
    """
    shared_dir(df.sparkSession)
    if not plain:
        return df.checkpoint()
    conf, key = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(key, "true")
    conf.set(key, "false")
    try:
        return df.checkpoint()
    finally:
        conf.set(key, before)
