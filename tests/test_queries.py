"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    if name in entry.oracle_sql():
        assert differences(df, con, entry.oracle_sql()[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "verdict", "chunks", "raw", "mean_bits"] and df.count() > 0


def test_code_frequencies_add_up(spark):
    from pyspark.sql import functions as F

    rows = entry.queries()["code_frequencies"](spark, SF).groupBy("source").agg(F.sum("freq").alias("f"), F.min("freq").alias("low")).collect()
    assert rows and all(r.f == 4096 and r.low > 0 for r in rows)


def test_tally_counts_all_bytes(spark):
    from pyspark.sql import functions as F

    got = entry.queries()["method_tally"](spark, SF).agg(F.sum("raw")).first()[0]
    want = spark.read.parquet(f"{SF}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert got == want
