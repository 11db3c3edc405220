"""Every registered archive query against its SQL on the smallest tables."""

import duckdb
import pytest

import tools_compare
from larder.plans import registry

SF = "/root/testdata/sf0.001"
ALL = registry.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in tools_compare.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, con, name):
    said = tools_compare.compare(spark, con, SF, name, ALL[name], registry.oracle_sql()[name])
    assert said.startswith("ok") and "types" not in said, said


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_crc_layout_matches_zlib(spark):
    import zlib

    assert ALL["q_crc_layout"](spark, SF).count() > 0
    from pyspark.sql import functions as F

    from larder.functions.scalars import crc_layout

    assert spark.createDataFrame([("k",)], ["k"]).select(crc_layout(F.col("k"), 8)).first()[0] == zlib.crc32(b"k") & 255
