"""Odd rows and larger shapes that earlier rounds' queries got wrong or slow."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tracemill.operators import search_index, structured, tables
from tracemill.queries import relational


def test_lateral_top_takes_an_order_with_a_key_before_one_without(spark, tmp_path):
    orders = [(1, 1, 5.0), (2, 1, 5.0), (None, 1, 5.0), (3, 2, float("nan")), (4, 2, 9.0), (5, 3, None), (6, 3, 2.0), (7, 4, None), (8, None, 3.0), (9, 5, -0.0), (8, 5, 0.0), (10, 6, 1.0), (10, 6, 1.0), (None, 7, 1.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k,) for k in (1, 1, 2, 3, 4, 5, 6, 7, 8, None)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    f, sql = relational.QUERIES["lateral_top"]
    assert sorted(map(tuple, f(spark, str(tmp_path)).collect()), key=repr) == sorted(con.execute(sql).fetchall(), key=repr)


def test_blocks_beyond_the_folders_share_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "FOLDERS", 3)
    df = spark.range(1000).selectExpr("id", "concat('line ', id * 7919, if(id = 777, ' Needle-42 é€\U0001f600x', '')) as line")
    for order in ("id", None):
        path = f"{tmp_path}/{order}"
        search_index.write(df, path, order, 50)
        rows = spark.read.parquet(f"{path}/rows")
        assert rows.select(search_index.FOLDER).distinct().count() == 3
        assert 20 <= rows.select(search_index.BLOCK).distinct().count() <= 23
        assert rows.groupBy(search_index.FOLDER, search_index.BLOCK).count().agg(F.max("count")).first()[0] <= 50
        for text in ("needle-42", "é€\U0001f600x", "79", "line 7919", "nothing"):
            assert sorted(r.id for r in search_index.search(spark, path, text).collect()) == sorted(r.id for r in tables.search(df, text).collect())
        assert search_index.blocks(spark, path, "needle-42").count() <= 2


def test_a_filter_on_fields_repeats_no_parsing(spark):
    lines = spark.createDataFrame([('{"a": {"b": {"c": 1}}, "x": "y"}',), ('{"not": 1}',)], "line string")
    told = structured.json_map(lines, "line").where(~F.map_contains_key("fields", F.lit("not")))
    assert [r.fields for r in told.collect()] == [{"a_b_c": "1", "x": "y"}]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert max(x.lower().count("from_json") for x in plan.splitlines() if "Filter" in x) <= 2
