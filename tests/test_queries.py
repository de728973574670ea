import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import DATA
from kerbline.plans import registry

NAMES = ["geo-01", "geo-05", "geo-16", "geo-27", "snk-03", "snk-06", "flt-10", "flt-16", "jon-06", "jon-10", "jon-12", "agg-01", "agg-09", "win-03", "win-04", "win-06", "top-02", "gra-09", "gra-17", "etl-13", "rte-05", "rte-08", "rte-10", "rte-13", "rte-14", "rte-16", "rte-19", "gra-07", "gra-13", "gra-18", "rte-02", "rte-03", "etl-05", "etl-09", "etl-14", "etl-16", "swk-02", "swk-09", "rmp-04", "snk-02", "snk-07", "snp-04", "snp-05", "win-08", "rte-04", "rte-17", "gra-09-strong", "gra-11-strong", "cmb-02", "rte-10-journeys"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in os.listdir(DATA):
        connection.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return connection


def _rows(frame: pd.DataFrame) -> list:
    plain = lambda v: None if pd.isna(v) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(plain(v) for v in row) for row in frame[sorted(frame)].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    assert _rows(registry.queries()[name](spark, DATA).toPandas()) == _rows(duck.sql(registry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) <= set(entry.queries())


def test_hops_end_where_the_sql_ends(spark, tmp_path):
    """A street of 200 rows of blocks, longer than the hops that the SQL of gra-14 goes."""
    spark.range(8000).selectExpr("id as c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    connection = duckdb.connect()
    connection.sql(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    found = _rows(registry.queries()["gra-14"](spark, str(tmp_path)).toPandas())
    assert found == _rows(connection.sql(registry.oracle_sql()["gra-14"]).df()) and len(found) < 8000
