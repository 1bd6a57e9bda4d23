"""Every query of the surveyed operators against its SQL twin."""

import pytest

from tests.conftest import SF, as_rows
from fathomline import queries as base


@pytest.mark.parametrize("name", sorted(base.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = as_rows(base.QUERIES[name](spark, SF).toPandas())
    want = as_rows(duck.execute(base.SQL[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_results_hang_on_no_partitioning(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    names = ["flagship_segment_codes", "w10_splat", "w03_merged_segments", "w09_filled_gaps"]
    many = [as_rows(base.QUERIES[n](spark, SF).toPandas()) for n in names]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert many == [as_rows(base.QUERIES[n](spark, SF).toPandas()) for n in names]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def equals_sql_on(spark, path, name, events):
    """Whether a query equals its SQL on events of one user: (event_id, value)."""
    import datetime as dt

    import duckdb

    rows = [(e, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), 7, "view", v, "{}") for i, (e, v) in enumerate(events)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet/*.parquet')")
    return as_rows(base.QUERIES[name](spark, str(path)).toPandas()) == as_rows(con.execute(base.SQL[name]).df())


def test_a_code_that_is_the_midpoint_by_itself_counts(spark, tmp_path):
    assert equals_sql_on(spark, tmp_path, "a10_shot_scan", [(e, 1.0) for e in (32766, 32767, 32768, 32769, 32768 + 65536, 5, None)])


def test_quality_of_a_truth_of_zero(spark, tmp_path):
    assert equals_sql_on(spark, tmp_path, "a12_depth_quality", [(1, 10.0), (2, 0.0), (3, 30.0), (4, None), (5, 20.0)])


def test_codes_right_between_two(spark, tmp_path):
    halves = [23.83, 22.84, 26.58]
    assert equals_sql_on(spark, tmp_path / "a", "flagship_segment_codes", list(enumerate(halves)))
    assert equals_sql_on(spark, tmp_path / "b", "flagship_segment_codes", [(i, v) for i, v in enumerate([16.16, 61.16, 23.17, 103.06, 21.13, 30.05, 8.73, 62.17, 39.33, 42.13, 500.0, 900.0])])
    assert equals_sql_on(spark, tmp_path / "c", "flagship_segment_codes", [(1, None), (2, None)])
