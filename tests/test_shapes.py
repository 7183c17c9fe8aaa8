import datetime as dt

from tidewheel.operators import shapes


def test_recursive_loses_no_order(spark, tmp_path):
    days = [dt.datetime(1993, 11, 5), dt.datetime(1995, 1, 1), dt.datetime(2005, 2, 3), dt.datetime(2005, 2, 9)]
    spark.createDataFrame([(d,) for d in days], "o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    found = {r["month"]: r["orders"] for r in shapes.recursive(spark, str(tmp_path)).collect()}
    assert sorted(found) == list(range(-14, 122))
    assert {m: n for m, n in found.items() if n} == {-14: 1, 0: 1, 121: 2}
