"""Rounding as the SQL of the queries does it, to the last decimal."""

import duckdb
import pytest

from pyspark.sql import functions as F

from tidemark.functions.exprs import rounded
from tidemark.plans import catalogue


def test_ties_go_where_sql_takes_them(spark):
    values = [None, 0.0, -0.0, 1.00005, -1.00005, 2.5e-5, 5e-5, -5e-5, 1e300, float("inf"), *[901.01 * 1.1 * t for t in (0.01, 0.03, 0.07)], *[(90_000 + k) / 100 * 1.1 * (k % 9) / 100 for k in range(3000)]]
    got = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", rounded(F.col("x"), 4).alias("x")).collect()
    assert {r["i"]: r["x"] for r in got} == {i: duckdb.execute("SELECT round(?::DOUBLE, 4)", [x]).fetchone()[0] for i, x in enumerate(values)}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_position_records_equal_their_sql(spark, scale):
    sf = f"/root/testdata/{scale}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    want = con.sql(catalogue.SQL["position_records"])
    got = catalogue.QUERIES["position_records"](spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
