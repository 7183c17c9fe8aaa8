import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewheel.sources import committed
from tidewheel.sources.committed import Group, GroupReader
from tidewheel.streaming.events import follow


@pytest.fixture
def numbers(spark, tmp_path):
    """A table of four files with two row groups each, of 0 to 799 by hundreds; the last file has nulls."""
    committed.register(spark)
    path = str(tmp_path / "numbers")
    os.mkdir(path)
    for k in range(4):
        rows = spark.range(200 * k, 200 * k + 200).selectExpr("id", "if(id >= 700, null, concat('n', lpad(id, 3, '0'))) AS name", "if(id = 5, double('nan'), double(id)) AS x", "timestamp_ntz '2024-01-01' + make_dt_interval(cast(id as int)) AS at")
        pq.write_table(rows.toArrow(), f"{path}/{k}.parquet", row_group_size=100)
    return path


def read(spark, path):
    return spark.read.format("committed").option("path", path).load()


@pytest.mark.parametrize(
    "condition, groups",
    [
        ("id > 650", 2),
        ("id >= 699 AND id < 701", 2),
        ("id = 150", 1),
        ("id IN (150, 350, 9999)", 2),
        ("id = 150 OR name = 'n350'", 8),
        ("name LIKE 'n2%'", 1),
        ("name IS NULL", 1),
        ("name <=> 'n000'", 1),
        ("x > 650", 8),  # NaN is greater and in no statistics
        ("x < 50", 1),
        ("x = 350", 1),
        ("at < timestamp_ntz '2024-01-11'", 1),
        ("id > 5000", 0),
        ("abs(id) = 3", 8),
    ],
)
def test_filters_leave_out_row_groups(spark, numbers, condition, groups):
    whole = spark.createDataFrame(spark.read.parquet(f"{numbers}/*.parquet").collect(), read(spark, numbers).schema).where(condition)
    found = read(spark, numbers).where(condition)
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))
    assert found.rdd.getNumPartitions() == max(groups, 1)


def test_many_files_are_planned_by_file(spark, numbers, monkeypatch):
    monkeypatch.setattr(committed, "PLANNED", 3)
    assert [p.groups for p in GroupReader(numbers).partitions()] == [None] * 4
    reader = GroupReader(numbers, [committed.GreaterThan(("id",), 350)])
    assert [sum(b.num_rows for b in reader.read(Group(f, None))) for f in committed.files(numbers)] == [0, 100, 200, 200]


def test_commits_and_overwrites(spark, tmp_path):
    committed.register(spark)
    path = str(tmp_path / "t")
    rows = spark.range(0, 100, 1, 4).withColumn("s", F.col("id").cast("string"))
    write = lambda df, mode: df.write.format("committed").option("path", path).mode(mode).save()
    write(rows, "append")
    write(rows.where("id < 10"), "append")
    assert read(spark, path).count() == 110
    write(rows.where("id < 7"), "overwrite")
    assert sorted(r["id"] for r in read(spark, path).collect()) == list(range(7))
    assert len(glob.glob(f"{path}/*.parquet")) == len(committed.files(path))
    write(rows.where("id < 0"), "append")
    assert read(spark, path).count() == 7
    write(rows.where("id < 0"), "overwrite")
    assert read(spark, path).count() == 0 and read(spark, path).columns == ["id", "s"]
    assert not [f for f in os.listdir(path) if f.startswith("_") and f != committed.MANIFEST]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    committed.register(spark)
    path = str(tmp_path / "t")
    rows = spark.range(0, 100, 1, 4)
    bad = rows.select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).alias("id"))
    for before in (0, 100):
        with pytest.raises(Exception, match="broken row"):
            bad.write.format("committed").option("path", path).mode("append").save()
        assert not glob.glob(f"{path}/**/*staging*") and len(glob.glob(f"{path}/*.parquet")) == (len(committed.files(path)) if before else 0)
        if before:
            assert read(spark, path).count() == before
        else:
            rows.write.format("committed").option("path", path).mode("append").save()


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    committed.register(spark)
    path, place = str(tmp_path / "t"), str(tmp_path / "followed")
    seen = []
    for part in range(3):
        spark.range(10 * part, 10 * part + 10, 1, 2).write.format("committed").option("path", path).mode("append").save()
        for _ in range(2):  # the second run has nothing new
            rows = follow(spark.readStream.format("committed").option("path", path).load(), place)
            seen.append(sorted(r["id"] for r in rows.collect()))
    assert seen == [list(range(10 * k + 10)) for k in range(3) for _ in range(2)]
