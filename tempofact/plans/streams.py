"""Streams, run over what is there and checked against batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tempofact.operators import intervals
from tempofact.operators.bitemporal import open_end
from tempofact.registry import query
from tempofact.session import shared_dir
from tempofact.sources.fixtures import M, memories, table, ts
from tempofact.streaming import jobs


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS writes FROM events GROUP BY 1, 2")
def sm3_daily(spark, sf_dir):
    """All days, open ones too."""
    return jobs.run_available(jobs.daily_counts(jobs.source(spark, sf_dir, "events")), "complete")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sm4_sessions(spark, sf_dir):
    """All sessions, open ones too."""
    return jobs.run_available(jobs.sessions(jobs.source(spark, sf_dir, "events")), "complete")


@query("SELECT event_type, strftime(time_bucket(INTERVAL 5 MINUTES, ts) - to_minutes(5 * k), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events, range(0, 12) r(k) GROUP BY 1, 2")
def sm5_sliding(spark, sf_dir):
    """All hours, open ones too, every five minutes."""
    return jobs.run_available(jobs.sliding_counts(jobs.source(spark, sf_dir, "events")), "complete")


@query("""WITH d AS (SELECT user_id, day FROM (SELECT DISTINCT user_id FROM events), (SELECT CAST(TIMESTAMP '2024-01-17' + to_days(CAST(i AS INTEGER)) AS DATE) AS day FROM range(0, 14) r(i)))
  SELECT d.user_id AS user_id, strftime(d.day, '%Y-%m-%d') AS day, count(event_id) AS n FROM d LEFT JOIN events e ON e.user_id = d.user_id AND CAST(e.ts AS DATE) = d.day GROUP BY 1, 2""")
def sm6_histogram(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    days = F.explode(F.sequence(F.lit("2024-01-17").cast("date"), F.lit("2024-01-30").cast("date")))
    grid = e.select("user_id").distinct().withColumn("day", days)
    n = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["user_id", "day"], "left").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT count(DISTINCT sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS texts, count(DISTINCT sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS rows FROM documents")
def sm7_dedup(spark, sf_dir):
    docs = jobs.source(spark, sf_dir, "documents").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    got = jobs.run_available(jobs.deduplicated(docs))
    return got.agg(F.count_distinct(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("texts"), F.count(F.lit(1)).alias("rows"))


@query(f"WITH {M} SELECT id, strftime(t_created, '%Y-%m-%d') AS recorded, strftime(t_created - to_days(CAST(id % 30 AS INTEGER)), '%Y-%m-%d') AS valid_from FROM m WHERE id % 3 = 0")
def sm8_backdated(spark, sf_dir):
    """Late facts change event time alone; none is dropped and transaction time stays."""
    late = memories(spark, sf_dir).where("id % 3 = 0").withColumn("valid_from", F.col("t_created") - F.make_dt_interval((F.col("id") % 30).cast("int")))
    return late.select("id", F.date_format("t_created", "yyyy-MM-dd").alias("recorded"), F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"))


@query(f"""WITH {M}, f AS (SELECT id, entity, namespace, t_created, t_created - to_days(CAST(id % 30 AS INTEGER)) AS valid_from, CASE WHEN id % 4 > 0 THEN t_created - to_days(CAST(id % 30 AS INTEGER)) + to_days(CAST(id % 9 + 1 AS INTEGER)) END AS valid_until FROM m),
  p AS (SELECT TIMESTAMP '2024-01-02' + to_days(CAST(3 * a AS INTEGER)) AS t, TIMESTAMP '2023-12-20' + to_days(CAST(4 * b AS INTEGER)) AS v FROM range(0, 4) x(a), range(0, 6) y(b))
  SELECT strftime(t, '%Y-%m-%d') AS known, strftime(v, '%Y-%m-%d') AS day, entity, namespace, max_by(id, (t_created, id)) AS id FROM p JOIN f ON t_created <= t AND valid_from <= v AND (valid_until IS NULL OR valid_until > v) GROUP BY t, v, entity, namespace""")
def sm8_rectangles(spark, sf_dir):
    """Backdated facts cut what was known in both times; replays of several days see one fact of each key."""
    m = memories(spark, sf_dir)
    since = F.col("t_created") - F.make_dt_interval((F.col("id") % 30).cast("int"))
    facts = m.select("id", "entity", "namespace", "t_created", since.alias("valid_from"), F.when(F.col("id") % 4 > 0, since + F.make_dt_interval((F.col("id") % 9 + 1).cast("int"))).alias("valid_until"))
    r = intervals.sequenced(facts, ["entity", "namespace"])
    days = lambda first, step, n: F.array(*[ts(f"{first} 00:00:00") + F.make_dt_interval(F.lit(step * i)) for i in range(n)])
    seen = r.withColumn("t", F.explode(days("2024-01-02", 3, 4))).withColumn("v", F.explode(days("2023-12-20", 4, 6)))
    seen = seen.where((F.col("t_created") <= F.col("t")) & (open_end("t_expired") > F.col("t")) & (F.col("valid_from") <= F.col("v")) & (open_end("valid_until") > F.col("v")))
    return seen.select(F.date_format("t", "yyyy-MM-dd").alias("known"), F.date_format("v", "yyyy-MM-dd").alias("day"), "entity", "namespace", "id")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS seq FROM events")
def sm9_trace(spark, sf_dir):
    w = W.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(w).cast("long").alias("seq"))


@query("""SELECT o_orderkey AS id, o_custkey AS entity, o_orderpriority AS category, o_orderstatus AS namespace, strftime(lead(o_orderdate) OVER w, '%Y-%m-%d') AS closed FROM orders
  WINDOW w AS (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY o_orderdate, o_orderkey) QUALIFY lead(o_orderdate) OVER w IS NOT NULL""")
def sm10_supersession(spark, sf_dir):
    o = jobs.source(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("namespace"), F.col("o_orderdate").alias("valid_from"))
    files = f"{shared_dir(spark)}/supersession-{uuid.uuid4().hex}"
    jobs.supersessions(o, files).awaitTermination()
    return jobs.closed_facts(spark, files, o.schema).select("id", "entity", "category", "namespace", F.date_format("closed", "yyyy-MM-dd").alias("closed"))


@query("""SELECT user_id, event_type, event_id AS id, strftime(lead(ts) OVER w, '%Y-%m-%d %H:%M:%S') AS closed, lead(event_id) OVER w AS by FROM events
  WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id) QUALIFY lead(ts) OVER w IS NOT NULL""")
def sm10_chains(spark, sf_dir):
    """As sm10 with the facts of a key in keyed state, without files."""
    e = jobs.source(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("id"), F.col("ts").alias("at"))
    got = jobs.run_available(jobs.chained(e, ["user_id", "event_type"], "3650 days"))
    first = got.groupBy("k0", "k1", "id").agg(F.min(F.struct("closed", "by")).alias("x"))  # a fact in between only ever closes earlier
    return first.select(F.col("k0").alias("user_id"), F.col("k1").alias("event_type"), "id", F.date_format("x.closed", "yyyy-MM-dd HH:mm:ss").alias("closed"), "x.by")


LEASE_EVENTS = "CASE event_type WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'enqueue' END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS item, ts, {LEASE_EVENTS} AS event, (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS mark FROM events),
  r AS (SELECT item, ts, event, mark, row_number() OVER (PARTITION BY item ORDER BY ts, event) AS n FROM e WHERE ts < mark),
  s(item, n, since, gone) AS (SELECT item, 1, CASE WHEN event = 'claim' THEN ts END, CAST(NULL AS TIMESTAMP) FROM r WHERE n = 1
    UNION ALL SELECT r.item, r.n, CASE WHEN r.event = 'claim' THEN CASE WHEN s.since IS NOT NULL AND s.since + to_seconds(86400) >= r.ts THEN s.since ELSE r.ts END WHEN r.event IN ('done', 'failed') THEN NULL WHEN s.since + to_seconds(86400) < r.ts THEN NULL ELSE s.since END,
      CASE WHEN s.since + to_seconds(86400) < r.ts THEN s.since END FROM s JOIN r ON r.item = s.item AND r.n = s.n + 1),
  g AS (SELECT item, gone AS claimed FROM s WHERE gone IS NOT NULL UNION ALL SELECT s.item, since FROM s JOIN (SELECT item, max(n) AS n, any_value(mark) AS mark FROM r GROUP BY 1) l ON l.item = s.item AND l.n = s.n WHERE since + to_seconds(86400) < mark)
  SELECT item, strftime(claimed, '%Y-%m-%d %H:%M:%S') AS claimed, strftime(claimed + to_seconds(86400), '%Y-%m-%d %H:%M:%S') AS reclaimed FROM g""")
def sm2_reclaimed(spark, sf_dir):
    """Leases of a day that ran out, found by timers over keyed state."""
    e = jobs.source(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("ts").alias("at"), F.expr(LEASE_EVENTS).alias("event"))
    got = jobs.run_available(jobs.reclaimed(e, 86_400))
    return got.select("item", F.date_format("claimed", "yyyy-MM-dd HH:mm:ss").alias("claimed"), F.date_format("reclaimed", "yyyy-MM-dd HH:mm:ss").alias("reclaimed"))


@query(f"WITH {M} SELECT category, count(*) AS n FROM m WHERE t_created <= TIMESTAMP '2024-01-04 10:00:00' GROUP BY 1")
def sm11_snapshot(spark, sf_dir):
    return memories(spark, sf_dir).where(F.col("t_created") <= ts("2024-01-04 10:00:00")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
