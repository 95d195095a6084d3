"""Every kernel query against DuckDB."""

import pytest
from compare import assert_same

from navgraph.plans import codebase, kernels


@pytest.mark.parametrize("name", sorted(kernels.QUERIES))
def test_query_matches_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    assert_same(kernels.QUERIES[name](spark, sf_dir), kernels.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(codebase.QUERIES))
def test_code_query_matches_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    assert_same(codebase.QUERIES[name](spark, sf_dir), codebase.ORACLES[name], sf_dir)


def test_edges_cover_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert kernels.QUERIES["deps"](spark, sf_dir).count() == 51_731
    targets = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey").distinct().count()
    assert kernels.QUERIES["importers"](spark, sf_dir).count() == targets
