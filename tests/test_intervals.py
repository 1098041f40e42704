"""Interval joins, facts cut in both times, selection of ranks and pointer doubling, against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tempofact.operators import bitemporal as b
from tempofact.operators import intervals, metrics

DAY = datetime(2024, 1, 1)
NEVER = datetime(9999, 12, 31)


def spans(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        start = DAY + timedelta(minutes=rnd.randrange(60 * 24 * 40))
        length = rnd.choice([0, 1, 59, 60, 61, 600, 60 * 24 * 3, 60 * 24 * 300])
        out.append((i, rnd.choice(["a", "a", "a", "b", None]), start, None if rnd.random() < 0.1 else start + timedelta(minutes=length)))
    return out + [(n, "a", None, DAY), (n + 1, "a", DAY, DAY - timedelta(days=1))]


@pytest.mark.parametrize("hot", [100_000, 3])
def test_overlaps_are_found_once(spark, monkeypatch, hot):
    monkeypatch.setattr(intervals, "HOT", hot)
    left, right = spans(1, 120), spans(2, 150)
    schema = "id bigint, k string, start timestamp_ntz, end timestamp_ntz"
    got = [tuple(r) for r in intervals.overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"]).collect()]
    valid = lambda x: x[1] is not None and x[2] is not None and x[2] < (x[3] or NEVER)
    want = sorted((x[0], y[0], max(x[2], y[2]), min(x[3] or NEVER, y[3] or NEVER)) for x in left for y in right if valid(x) and valid(y) and x[1] == y[1] and x[2] < (y[3] or NEVER) and y[2] < (x[3] or NEVER))
    assert sorted(got) == want and len(want) > 1000


def test_sequenced_facts_replay(spark):
    rnd = random.Random(5)
    facts = []
    for i in range(90):
        since = DAY + timedelta(days=rnd.randrange(20))
        facts.append((rnd.choice(["a", "b", None]), i, since, None if rnd.random() < 0.3 else since + timedelta(days=rnd.randrange(0, 8)), DAY + timedelta(days=rnd.randrange(15))))
    rows = [tuple(r) for r in intervals.sequenced(spark.createDataFrame(facts, "k string, id bigint, valid_from timestamp_ntz, valid_until timestamp_ntz, t_created timestamp_ntz"), ["k"]).collect()]
    for known in range(-1, 16):
        for day in range(-1, 30):
            t, v = DAY + timedelta(days=known), DAY + timedelta(days=day)
            for k in ("a", "b", None):
                seen = [r[1] for r in rows if r[0] == k and r[4] <= t and (r[5] or NEVER) > t and r[2] <= v and (r[3] or NEVER) > v]
                held = [(f[4], f[1]) for f in facts if f[0] == k and f[4] <= t and f[2] <= v < (f[3] or NEVER)]
                assert seen == ([max(held)[1]] if held else [])


def test_backdated_fact_reopens_the_pieces(spark):
    at = lambda d: DAY + timedelta(days=d)
    facts = spark.createDataFrame([("a", 1, at(0), None, at(0)), ("a", 2, at(3), at(5), at(9))], "k string, id bigint, valid_from timestamp_ntz, valid_until timestamp_ntz, t_created timestamp_ntz")
    got = sorted((tuple(r)[1:] for r in intervals.sequenced(facts, ["k"]).collect()), key=str)
    assert got == sorted([(1, at(0), at(3), at(0), None), (1, at(3), at(5), at(0), at(9)), (1, at(5), None, at(0), None), (2, at(3), at(5), at(9), None)], key=str)


def test_as_of_join_over_range_borders(spark):
    rnd = random.Random(7)
    facts = [(rnd.choice(["a", "b", None]), DAY + timedelta(minutes=i * 7 + rnd.randrange(5)), i) for i in range(300)]
    points = [(k, DAY + timedelta(minutes=rnd.randrange(-50, 2500))) for k in ("a", "b", "c", None) for _ in range(80)]
    got = b.as_of_join(spark.createDataFrame(points, "k string, at timestamp_ntz").repartition(3), spark.createDataFrame(facts, "k string, valid_from timestamp_ntz, v int").repartition(5), ["k"])
    want = sorted(str((k, t, max(((f, v) for q, f, v in facts if q == k and f <= t), default=(None, None))[1])) for k, t in points)
    assert sorted(str((r.k, r.at, r.fact_v)) for r in got.collect()) == want


@pytest.mark.parametrize("few", [1000, 2])
def test_ranks_by_selection(spark, few):
    rnd = random.Random(9)
    rows = [(g, rnd.choice([rnd.gauss(0, 1), rnd.randrange(3) * 1.0, 10 ** rnd.uniform(-9, 9)])) for g in ("a", "b", None) for _ in range(400)] + [("c", 1.5), ("d", None), ("e", 2.0), ("e", 2.0)]
    at = {"low": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "top": lambda n: n - 1, "none": lambda n: n}
    got = {r.g: (r.low, r.mid, r.top, r.none) for r in metrics.ranked_values(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", at, bins=16, few=few).collect()}
    assert set(got) == {"a", "b", None, "c", "e"}
    for g, found in got.items():
        line = sorted(v for k, v in rows if k == g)
        assert found[:3] == (round(line[0], 6), round(line[len(line) // 2], 6), round(line[-1], 6)) and found[3] is None


@pytest.mark.parametrize("depth", [0, 1, 7, 20, 64])
def test_chains_by_doubling(spark, depth):
    nxt = {i: i + 1 for i in range(40)} | {100: 101, 101: 102, 102: 100, 200: 200, 300: 999, 103: 101}
    ids = [*range(41), 100, 101, 102, 103, 200, 300, 400]
    df = spark.createDataFrame([(i, nxt.get(i)) for i in ids], "id bigint, superseded_by bigint")
    got = sorted((r.start, r.step, r.id) for r in b.chain(df, df, depth).collect())
    want = []
    for i in ids:
        seen, now = [], i
        while now in ids and now not in seen and len(seen) <= depth:
            seen.append(now)
            now = nxt.get(now)
        want += [(i, k, x) for k, x in enumerate(seen)]
    assert got == sorted(want)
