"""Queries of measures on values that the small tables lack."""

import datetime

import duckdb

import __spark_entry__ as entry


def test_metric_parse_rounds_as_its_sql(spark, tmp_path):
    prices = [289450.0, 327950.0, 300650.0, 250.0, 50.0, 150.0, 12350.0, 949.999, 1_234_567_890.0, 0.0, None]
    rows = [(6 * i, p, datetime.date(2000, 1, 1)) for i, p in enumerate(prices)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: (r.value, r.approximate) for r in entry.queries()["metric_parse"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert got == {k: (value, near) for k, value, near in con.execute(entry.oracle_sql()["metric_parse"]).fetchall()}
