"""What the finding of the fourth round asked for."""

import pytest
from pyspark.sql import functions as F

from tempofact import registry
from tempofact.operators import intervals

registry.load()


def test_pairs_of_few_rows_are_dealt_to_all_tasks(spark, monkeypatch):
    """Two sides that lie in one partition each, and are small enough to be broadcast, still pair in every task."""
    monkeypatch.setattr(intervals, "HOT", 10)
    span = [F.expr("id % 1").alias("k"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'").alias("start"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:30:00'").alias("end")]
    side = spark.range(0, 300, 1, 1).select("id", *span)
    shares = [r[1] for r in intervals.overlap_join(side, side, ["k"]).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 300 * 300 and len(shares) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(shares) < 300 * 300 / 2


def test_bounds_are_written_once_a_row(spark):
    """No text of a time is made above the join, where there are as many rows as pairs."""
    plan = registry.QUERIES["jn16_overlaps"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner", 1)
    assert "date_format" not in above and "date_format" in below


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_shown_bounds_are_those_of_the_pair(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = lambda *x: spark.createDataFrame(x, "id int, k string, start string, end string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
        left = rows((1, "k", "2024-06-01 00:00:00", "2024-06-02 00:00:00"), (2, "k", "2024-06-01 12:00:00", "2024-06-01 13:00:00"), (3, "k", "2024-06-05 00:00:00", None))
        right = rows((4, "k", "2024-06-01 06:00:00", None), (5, "k", "2024-06-02 00:00:00", "2024-06-05 00:00:00"))
        shown = intervals.overlap_join(left, right, ["k"], lambda at: F.date_format(at, "MM-dd HH"))
        want = [(1, 4, "06-01 06", "06-02 00"), (2, 4, "06-01 12", "06-01 13"), (3, 4, "06-05 00", "12-31 00")]
        assert sorted(map(tuple, shown.collect())) == want
        plain = intervals.overlap_join(left, right, ["k"])
        assert dict(plain.dtypes)["since"] == "timestamp_ntz"
        assert sorted((r.left_id, r.right_id, f"{r.since:%m-%d %H}", f"{r.until:%m-%d %H}") for r in plain.collect()) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
