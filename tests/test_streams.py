"""Streams over several files: late rows, state that goes, keyed state and timers."""

import glob
import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tempofact.streaming import jobs

DAY = datetime(2024, 1, 1)


def stream_of(spark, folder, parts, schema):
    """A stream that reads one file a micro-batch."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/rows.parquet")
        for p in glob.glob(f"{folder}/rows.parquet/*.parquet"):
            if os.path.getmtime(p) > 2_000_000_000 or not getattr(stream_of, "seen", set()) >= {p}:
                os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
                stream_of.seen = getattr(stream_of, "seen", set()) | {p}
    return jobs.source(spark, str(folder), "rows", 1)


def test_chains_take_late_facts_between_their_neighbours(spark, tmp_path):
    random.seed(3)
    rows = [(k, i, DAY + timedelta(hours=random.randrange(900))) for i, k in enumerate(random.choices(["a", "b", None], k=60))]
    parts = [rows[:20], rows[20:40], rows[40:]]
    facts = stream_of(spark, tmp_path, parts, "entity string, id bigint, at timestamp")
    got = jobs.run_available(jobs.chained(facts, ["entity"], "3650 days")).collect()
    first = {}
    for r in got:
        first[r.id] = min(first.get(r.id, (r.closed, r.by)), (r.closed, r.by))
    want = {}
    for k in ("a", "b", None):
        line = sorted((at, i) for e, i, at in rows if e == k)
        want |= {i: n for (_, i), n in zip(line, line[1:])}
    assert first == want
    assert len(got) > len(want)  # late facts closed some again


def test_chains_forget_what_the_watermark_has_passed(spark, tmp_path):
    parts = [[("a", i, DAY + timedelta(hours=i)) for i in range(10)], [("b", 100, DAY + timedelta(days=20))], [("a", 10, DAY + timedelta(days=21))], [("b", 101, DAY + timedelta(days=22))]]
    facts = stream_of(spark, tmp_path, parts, "entity string, id bigint, at timestamp")
    stream = jobs.chained(facts, ["entity"], "1 day", keep=3600)
    out = []
    q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, n: out.extend(df.collect())).start()
    q.awaitTermination()
    assert {r.id: r.by for r in out} == {**{i: i + 1 for i in range(10)}, 100: 101}  # the last fact of a key stays
    state = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "facts").load()
    left = {(r.key.entity if hasattr(r.key, "entity") else r.key[0]): r.n for r in state.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert left["a"] <= 2


def test_leases(spark, tmp_path):
    t = lambda m: DAY + timedelta(minutes=m)
    parts = [
        [(1, t(0), "enqueue"), (1, t(1), "claim"), (2, t(2), "claim"), (3, t(30), "claim")],
        [(2, t(5), "done"), (1, t(300), "enqueue"), (3, t(33), "release")],  # late, within the hour
        [(1, t(310), "claim"), (1, t(325), "claim"), (4, t(900), "enqueue")],
    ]
    events = stream_of(spark, tmp_path, parts, "item bigint, at timestamp, event string")
    got = {(r.item, r.claimed, r.reclaimed) for r in jobs.run_available(jobs.reclaimed(events)).collect()}
    assert got == {(1, t(1), t(11)), (1, t(310), t(320)), (1, t(325), t(335))}


def test_append_mode_gives_closed_windows_and_late_rows_go_aside(spark, tmp_path):
    at = lambda d, h=0: DAY + timedelta(days=d, hours=h)
    parts = [[(1, at(0)), (1, at(0, 5)), (2, at(1))], [(1, at(5)), (2, at(5, 1))], [(2, at(5, 2))], [(1, at(0, 7)), (1, at(9))]]
    events = stream_of(spark, tmp_path, parts, "user_id bigint, ts timestamp")
    counted = {(r.user_id, r.day): r.writes for r in jobs.run_available(jobs.daily_counts(events)).collect()}
    assert counted == {(1, "2024-01-01"): 2, (2, "2024-01-02"): 1, (1, "2024-01-06"): 1, (2, "2024-01-06"): 2}
    jobs.late_rows(events, str(tmp_path / "side"), F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")).awaitTermination()
    late = spark.read.parquet(str(tmp_path / "side/late"))
    assert [(r.user_id, r.ts) for r in late.collect()] == [(1, at(0, 7))]


@pytest.mark.parametrize("aggregate", [jobs.daily_counts, jobs.sliding_counts, jobs.sessions])
def test_state_rows_fall(spark, tmp_path, aggregate):
    parts = [[(i, "x", DAY + timedelta(hours=i)) for i in range(48)], [(1, "x", DAY + timedelta(days=30))], [(1, "x", DAY + timedelta(days=60))]]
    events = stream_of(spark, tmp_path, parts, "user_id bigint, event_type string, ts timestamp")
    q = aggregate(events).writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in map(lambda p: json.loads(p.json), q.recentProgress)]
    assert max(rows) > rows[-1] and rows[-1] <= 24
