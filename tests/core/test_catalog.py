import duckdb
import pytest
from pyspark.sql import SparkSession

import __spark_entry__ as e
from parcelflow.plans import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    want = con.sql(e.oracle_sql()[name])
    got = e.queries()[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda it: sorted(map(str, (tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in it)))
    assert rows(map(tuple, got.select(*cols).collect())) == rows(want.select(*(f'"{c}"' for c in cols)).fetchall())
