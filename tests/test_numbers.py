"""Columns that the numbers' query must keep."""

from tidewheel.functions import scalars


def test_seeded_draws_are_part_of_the_job(spark, sf_dir):
    rows = scalars.more_numbers(spark, sf_dir)
    assert rows.where("drawn").count() == rows.count() > 0
    assert "drawn" in scalars.ORACLE_SQL["fn_more_numbers"]
