"""Store statistics, quotas, evaluation metrics, gates and trends."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tempofact.operators import governance, metrics
from tempofact.registry import query
from tempofact.sources.fixtures import M, memories, table

def n_rows() -> F.Column:
    return F.count(F.lit(1))


@query(f"WITH {M} SELECT coalesce(status, '*') AS status, coalesce(category, '*') AS category, n FROM (SELECT status, category, count(*) AS n FROM m GROUP BY GROUPING SETS ((status), (category), ()))")
def ag1_store_stats(spark, sf_dir):
    m = memories(spark, sf_dir)
    g = m.groupingSets([["status"], ["category"], []], "status", "category").agg(n_rows().alias("n"))
    return g.select(F.coalesce("status", F.lit("*")).alias("status"), F.coalesce("category", F.lit("*")).alias("category"), "n")


@query("""WITH q AS (SELECT CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'pending' WHEN 'view' THEN 'done' END AS state FROM events)
  SELECT s.state AS state, count(q.state) AS n FROM (VALUES ('pending'), ('processing'), ('done'), ('failed')) s(state) LEFT JOIN q USING (state) GROUP BY 1""")
def ag2_queue_stats(spark, sf_dir):
    return metrics.zero_filled(queue_states(spark, sf_dir), "state", ["pending", "processing", "done", "failed"])


def queue_states(spark, sf_dir):
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "view", "done")
    return table(spark, sf_dir, "events").select(state.alias("state")).where("state IS NOT NULL")


USED = "u AS (SELECT user_id, count(*) AS memory_count, count(*) FILTER (CAST(t_created AS DATE) = DATE '2024-01-04') AS writes_today FROM m GROUP BY user_id)"


@query(f"WITH {M}, {USED} SELECT * FROM u")
def ag4_usage(spark, sf_dir):
    return governance.usage(memories(spark, sf_dir), F.lit("2024-01-04").cast("date"))


@query(f"""WITH {M}, l AS (SELECT user_id, count(*) AS n FROM m WHERE user_id NOT IN ('u3', 'u7') GROUP BY 1),
  d AS (SELECT user_id, max(CAST(t_created AS DATE)) AS day FROM m GROUP BY 1),
  w AS (SELECT m.user_id, count(*) AS writes_today FROM m JOIN d ON d.user_id = m.user_id AND d.day = CAST(t_created AS DATE) GROUP BY 1)
  SELECT d.user_id AS user_id, coalesce(n, 0) AS memory_count, writes_today, strftime(d.day, '%Y-%m-%d') AS day FROM d JOIN w USING (user_id) LEFT JOIN l USING (user_id)""")
def ux8_counters(spark, sf_dir):
    """Counters kept by the deltas of two batches of inserts, supersessions and a purge of two users, equal to a count of what is left."""
    m = memories(spark, sf_dir).select("id", "user_id", F.col("t_created").alias("at"))
    none = spark.createDataFrame([], "user_id string, memory_count bigint, writes_today bigint, day date")
    inserts = lambda p: m.where(p).select("user_id", F.lit("insert").alias("op"), "at")
    first = governance.maintained(none, inserts("id % 3 = 0"))
    second = governance.maintained(first, inserts("id % 3 > 0").unionByName(m.where("id % 5 = 0").select("user_id", F.lit("update").alias("op"), "at")))
    gone = m.where("user_id IN ('u3', 'u7')").select("user_id", F.lit("delete").alias("op"), "at")
    return governance.maintained(second, gone).select("user_id", "memory_count", "writes_today", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("""WITH s AS (SELECT user_id * 100 + day(ts) AS q, event_id AS pos, event_type AS a FROM events),
  c AS (SELECT q, a, count(*) AS n, min(pos) AS pos FROM s GROUP BY 1, 2),
  maj AS (SELECT q, a FROM c QUALIFY row_number() OVER (PARTITION BY q ORDER BY n DESC, pos) = 1),
  lng AS (SELECT q, a FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY length(a) DESC, pos) = 1)
  SELECT CAST(q AS VARCHAR) AS question, CASE WHEN q % 7 = 0 THEN maj.a ELSE lng.a END AS chosen, CASE WHEN q % 7 = 0 THEN 'majority' ELSE 'judge_pick' END AS voter FROM maj JOIN lng USING (q)""")
def ux4_judge_pick(spark, sf_dir):
    """Each user's samples of a day: a judge takes the longest; where it fails, the majority decides."""
    def longest(question: str, answers: list[str]) -> int:
        if int(question) % 7 == 0:
            raise ValueError("no answer")
        return max(range(len(answers)), key=lambda i: (len(answers[i]), -i))

    e = table(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("question"), F.col("event_id").alias("pos"), F.col("event_type").alias("answer"))
    return metrics.judge_pick(e, longest)


LIMITS = "lim AS (SELECT 'u' || i AS user_id, CASE WHEN i % 3 = 0 THEN NULL ELSE 40 + i END AS max_memories, CASE WHEN i % 2 = 0 THEN 5 END AS max_writes_per_day FROM range(0, 20) r(i))"


@query(f"""WITH {M}, {USED}, {LIMITS} SELECT user_id, CASE WHEN memory_count >= max_memories THEN 'max_memories' WHEN writes_today >= max_writes_per_day THEN 'max_writes_per_day' END AS exceeded,
  CASE WHEN max_writes_per_day IS NULL THEN NULL ELSE greatest(max_writes_per_day - writes_today, 0) END AS remaining FROM u LEFT JOIN lim USING (user_id)""")
def ag5_quota(spark, sf_dir):
    lim = spark.range(20).selectExpr("concat('u', id) AS user_id", "CASE WHEN id % 3 = 0 THEN NULL ELSE 40 + id END AS max_memories", "CASE WHEN id % 2 = 0 THEN 5L END AS max_writes_per_day")
    used = governance.usage(memories(spark, sf_dir), F.lit("2024-01-04").cast("date"))
    got = governance.quota_check(used, lim)
    return got.select("user_id", "exceeded", "remaining")


@query(f"""WITH {M}, n AS (SELECT namespace, count(*) AS n, strftime(max(t_created), '%Y-%m-%d') AS last_day FROM m GROUP BY 1),
  e AS (SELECT namespace, entity, count(*) AS c, row_number() OVER (PARTITION BY namespace ORDER BY count(*) DESC, entity) AS rn FROM m WHERE entity IS NOT NULL GROUP BY 1, 2)
  SELECT namespace, any_value(n) AS n, any_value(last_day) AS last_day, string_agg(entity || ':' || c, ',' ORDER BY rn) AS top FROM n LEFT JOIN e USING (namespace) WHERE rn <= 5 OR rn IS NULL GROUP BY namespace""")
def ag6_overview(spark, sf_dir):
    m = memories(spark, sf_dir)
    n = m.groupBy("namespace").agg(n_rows().alias("n"), F.date_format(F.max("t_created"), "yyyy-MM-dd").alias("last_day"))
    e = m.where("entity IS NOT NULL").groupBy("namespace", "entity").agg(n_rows().alias("c"))
    e = e.withColumn("rn", F.row_number().over(W.partitionBy("namespace").orderBy(F.desc("c"), "entity"))).where("rn <= 5")
    top = e.groupBy("namespace").agg(F.array_sort(F.collect_list(F.struct("rn", F.concat_ws(":", "entity", "c").alias("t")))).alias("t"))
    return n.join(top, "namespace", "left").select("namespace", "n", "last_day", F.array_join("t.t", ",").alias("top"))


@query(f"WITH {M} SELECT entity, count(*) AS n FROM m WHERE namespace = 'en' AND entity IS NOT NULL GROUP BY 1 ORDER BY n DESC, entity LIMIT 30")
def ag7_detail(spark, sf_dir):
    return memories(spark, sf_dir).where("namespace = 'en' AND entity IS NOT NULL").groupBy("entity").agg(n_rows().alias("n")).orderBy(F.desc("n"), "entity").limit(30)


@query(f"""WITH {M}, c AS (SELECT user_id, category, count(*) AS n FROM m GROUP BY 1, 2) SELECT user_id, 'Session: ' || string_agg(category || '=' || n, ', ' ORDER BY category) AS summary FROM c GROUP BY 1""")
def ag8_summary(spark, sf_dir):
    c = memories(spark, sf_dir).groupBy("user_id", "category").agg(n_rows().alias("n"))
    by = F.array_sort(F.collect_list(F.struct("category", F.concat_ws("=", "category", "n").alias("t"))))
    return c.groupBy("user_id").agg(by.alias("b")).select("user_id", F.concat(F.lit("Session: "), F.array_join("b.t", ", ")).alias("summary"))


PRED = "p AS (SELECT doc_id, quality = 0 AS truth, toxic = 1 OR doc_id % 9 = 0 AS guess, CASE WHEN doc_id % 4 = 0 THEN 'a' ELSE 'b' END AS cat FROM labels)"


def predictions(spark, sf_dir):
    return table(spark, sf_dir, "labels").selectExpr("doc_id", "quality = 0 AS truth", "toxic = 1 OR doc_id % 9 = 0 AS guess", "CASE WHEN doc_id % 4 = 0 THEN 'a' ELSE 'b' END AS cat")


CONF = "c AS (SELECT count(*) FILTER (truth AND guess) AS tp, count(*) FILTER (NOT truth AND guess) AS fp, count(*) FILTER (NOT truth AND NOT guess) AS tn, count(*) FILTER (truth AND NOT guess) AS fn FROM p)"


@query(f"WITH {PRED}, {CONF} SELECT * FROM c")
def ag9_confusion(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir), F.col("truth"), F.col("guess"))


@query(f"""WITH {PRED}, {CONF}, r AS (SELECT coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS p, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS r, coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0) AS o FROM c)
  SELECT round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1, round_even(o, 4) AS over_abstention FROM r""")
def ag10_f1(spark, sf_dir):
    return metrics.precision_recall(metrics.confusion(predictions(spark, sf_dir), F.col("truth"), F.col("guess")))


@query(f"WITH {PRED} SELECT round_even(coalesce(CAST(count(*) FILTER (NOT truth AND NOT guess AND doc_id % 2 = 0) AS DOUBLE) / nullif(count(*) FILTER (NOT truth AND NOT guess), 0), 0), 4) AS accuracy FROM p")
def ag11_answered(spark, sf_dir):
    p = predictions(spark, sf_dir).where("NOT truth AND NOT guess")
    return p.agg(F.bround(metrics.ratio(F.count_if(F.col("doc_id") % 2 == 0), n_rows()), 4).alias("accuracy"))


BUCKETS = "CASE WHEN n_chars < 500 THEN '1k' WHEN n_chars < 2000 THEN '8k' WHEN n_chars < 8000 THEN '32k' ELSE 'overflow' END"


@query(f"SELECT {BUCKETS} AS bucket, CAST(count(*) FILTER (doc_id % 3 = 0) AS BIGINT) AS correct, count(*) AS total, round_even(100.0 * count(*) FILTER (doc_id % 3 = 0) / count(*), 2) AS pct FROM documents GROUP BY 1")
def ag12_buckets(spark, sf_dir):
    bucket = metrics.bucket(F.col("n_chars"), [("1k", 0, 500), ("8k", 500, 2000), ("32k", 2000, 8000)])
    return metrics.accuracy(table(spark, sf_dir, "documents").withColumn("bucket", bucket), ["bucket"], F.col("doc_id") % 3 == 0)


JUDGED = "j AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'a' ELSE 'b' END AS cat, judge, CASE judge WHEN 'q' THEN quality ELSE 1 - toxic END = 1 AS correct FROM labels, (VALUES ('q'), ('t')) v(judge))"


def judged(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    each = F.explode(F.create_map(F.lit("q"), F.col("quality") == 1, F.lit("t"), F.col("toxic") == 0)).alias("judge", "correct")
    return lab.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "a").otherwise("b").alias("cat"), each)


@query(f"WITH {JUDGED} SELECT coalesce(cat, '*') AS cat, judge, count(*) FILTER (correct) AS correct, count(*) AS total, round_even(100.0 * count(*) FILTER (correct) / count(*), 2) AS pct FROM j GROUP BY GROUPING SETS ((cat, judge), (judge))")
def ag13_judges(spark, sf_dir):
    g = judged(spark, sf_dir).groupingSets([["cat", "judge"], ["judge"]], "cat", "judge").agg(F.count_if("correct").alias("correct"), n_rows().alias("total"))
    return g.select(F.coalesce("cat", F.lit("*")).alias("cat"), "judge", "correct", "total", F.bround(100 * F.col("correct") / F.col("total"), 2).alias("pct"))


@query(f"WITH {JUDGED} SELECT CASE WHEN doc_id % 5 = 0 THEN 'fact' WHEN doc_id % 5 = 1 THEN 'recommendation' ELSE 'unknown' END AS mode, count(*) AS n, count(*) FILTER (correct) AS correct FROM j WHERE judge = 'q' GROUP BY 1")
def ag14_modes(spark, sf_dir):
    mode = F.when(F.col("doc_id") % 5 == 0, "fact").when(F.col("doc_id") % 5 == 1, "recommendation").otherwise("unknown")
    return judged(spark, sf_dir).where("judge = 'q'").groupBy(mode.alias("mode")).agg(n_rows().alias("n"), F.count_if("correct").alias("correct"))


@query(f"WITH {JUDGED}, a AS (SELECT judge, CAST(count(*) FILTER (correct) AS DOUBLE) / count(*) AS acc FROM j GROUP BY 1) SELECT round(coalesce(avg(acc), 0), 6) AS mean FROM a")
def ag15_mean(spark, sf_dir):
    a = judged(spark, sf_dir).groupBy("judge").agg((F.count_if("correct") / n_rows()).alias("acc"))
    return a.agg(F.round(F.coalesce(F.avg("acc"), F.lit(0.0)), 6).alias("mean"))


VERDICT = "CASE event_id % 7 WHEN 0 THEN 'stale_wins' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'miss' ELSE 'new_wins' END"


@query(f"WITH v AS (SELECT event_type, {VERDICT} AS verdict FROM events) SELECT event_type, count(*) FILTER (verdict = 'new_wins') AS new_wins, count(*) FILTER (verdict = 'stale_wins') AS stale_wins, count(*) FILTER (verdict = 'ambiguous') AS ambiguous, count(*) FILTER (verdict = 'miss') AS miss, round_even(100.0 * count(*) FILTER (verdict = 'new_wins') / count(*), 1) AS score_pct FROM v GROUP BY 1")
def ag16_updates(spark, sf_dir):
    v = F.when(F.col("event_id") % 7 == 0, "stale_wins").when(F.col("event_id") % 7 == 1, "ambiguous").when(F.col("event_id") % 7 == 2, "miss").otherwise("new_wins")
    kinds = ["new_wins", "stale_wins", "ambiguous", "miss"]
    n = [F.count_if(v == k).alias(k) for k in kinds]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*n, F.bround(100 * F.count_if(v == "new_wins") / n_rows(), 1).alias("score_pct"))


@query("SELECT coalesce(event_type, '*') AS category, round(avg(value), 4) AS mean, count(*) FILTER (value >= 50) AS correct FROM events GROUP BY ROLLUP (event_type)")
def ag17_rollup(spark, sf_dir):
    g = table(spark, sf_dir, "events").rollup("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.count_if(F.col("value") >= 50).alias("correct"))
    return g.select(F.coalesce("event_type", F.lit("*")).alias("category"), "mean", "correct")


@query("SELECT coalesce(o_orderpriority, '*') AS category, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS correct, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())")
def ag18_rollup(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupingSets([["o_orderpriority"], []], "o_orderpriority").agg(n_rows().alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("correct"), F.round(F.avg("o_totalprice"), 2).alias("mean"))
    return g.select(F.coalesce("o_orderpriority", F.lit("*")).alias("category"), "n", "correct", "mean")


@query("SELECT event_type, round(list_sort(list(value))[count(*) // 2 + 1], 6) AS p50, round(list_sort(list(value))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1], 6) AS p95, round(list_sort(list(value))[CAST(floor(count(*) * 0.99) AS BIGINT) + 1], 6) AS p99 FROM events GROUP BY 1")
def ag19_percentiles(spark, sf_dir):
    at = {"p50": lambda n: F.floor(n / 2), "p95": lambda n: F.floor(n * 0.95), "p99": lambda n: F.floor(n * 0.99)}
    return metrics.ranked_values(table(spark, sf_dir, "events"), ["event_type"], "value", at)


@query("SELECT event_type, round(list_sort(list(value))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1], 6) AS p95, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY 1")
def ag20_latency(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p = metrics.ranked_values(e, ["event_type"], "value", {"p95": lambda n: F.bround(0.95 * (n - 1), 0).cast("long")})
    s = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))
    return p.join(s, "event_type")


@query("""WITH c AS (SELECT user_id, event_type AS fp, count(*) AS n, min(event_id) AS pos FROM events GROUP BY 1, 2) SELECT user_id, fp AS choice, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, pos) AS rn FROM c) WHERE rn = 1""")
def ag21_vote(spark, sf_dir):
    return metrics.majority(table(spark, sf_dir, "events"), "user_id", F.col("event_type"), "event_id").select("user_id", F.col("fp").alias("choice"), F.col("n").alias("votes"))


@query("SELECT CASE WHEN p = 1 THEN 'recall@1' WHEN p <= 5 THEN 'recall@k' ELSE 'miss' END AS outcome, count(*) AS n FROM (SELECT vec_id, label + 1 AS p FROM embeddings) GROUP BY 1")
def ag24_diagnostic(spark, sf_dir):
    p = F.col("label") + 1
    return table(spark, sf_dir, "embeddings").groupBy(F.when(p == 1, "recall@1").when(p <= 5, "recall@k").otherwise("miss").alias("outcome")).agg(n_rows().alias("n"))


@query("SELECT count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality <> 1) AS failed, round(coalesce(CAST(count(*) FILTER (quality = 1) AS DOUBLE) / nullif(count(*), 0), 1.0), 6) AS pass_rate FROM labels")
def ag26_regression(spark, sf_dir):
    ok = F.count_if(F.col("quality") == 1)
    return table(spark, sf_dir, "labels").agg(ok.alias("passed"), (n_rows() - ok).alias("failed"), F.round(F.coalesce(F.try_divide(ok, n_rows()), F.lit(1.0)), 6).alias("pass_rate"))


@query(f"WITH {JUDGED}, c AS (SELECT judge AS benchmark, cat, round(100.0 * count(*) FILTER (correct) / count(*), 2) AS pct, count(*) AS n FROM j GROUP BY 1, 2) SELECT benchmark, string_agg(cat || '=' || printf('%.2f', pct), ';' ORDER BY cat) AS per_category, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1")
def ag27_summaries(spark, sf_dir):
    c = judged(spark, sf_dir).groupBy(F.col("judge").alias("benchmark"), "cat").agg(F.round(100 * F.count_if("correct") / n_rows(), 2).alias("pct"), n_rows().alias("n"))
    part = F.array_sort(F.collect_list(F.struct("cat", F.format_string("%s=%.2f", "cat", "pct").alias("t"))))
    return c.groupBy("benchmark").agg(part.alias("p"), F.sum("n").alias("total")).select("benchmark", F.array_join("p.t", ";").alias("per_category"), "total")


@query(f"WITH {M} SELECT min(id) AS id, count(*) AS copies FROM m GROUP BY sha256(regexp_replace(content, '^\\s+|\\s+$', '', 'g'))")
def ag28_distinct(spark, sf_dir):
    from tempofact.operators.bitemporal import content_hash

    return memories(spark, sf_dir).groupBy(content_hash("content").alias("h")).agg(F.min("id").alias("id"), n_rows().alias("copies")).drop("h")


@query(f"WITH {JUDGED} SELECT a.judge AS a, b.judge AS b, count(*) FILTER (a.correct AND b.correct) AS both_correct, count(*) FILTER (NOT a.correct AND NOT b.correct) AS both_wrong, round_even(100.0 * count(*) FILTER (a.correct = b.correct) / count(*), 2) AS pct FROM j a JOIN j b ON a.doc_id = b.doc_id AND a.judge < b.judge GROUP BY 1, 2")
def ag29_agreement(spark, sf_dir):
    return metrics.agreement(judged(spark, sf_dir), "doc_id", "judge", "correct")


RUNS = "r AS (SELECT event_type AS metric, avg(value) FILTER (ts < TIMESTAMP '2024-01-15') AS base, avg(value) FILTER (ts >= TIMESTAMP '2024-01-15') AS now FROM events GROUP BY 1)"


def two_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    half = F.expr("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    return e.groupBy(F.col("event_type").alias("metric")).agg(F.avg(F.when(half, F.col("value"))).alias("base"), F.avg(F.when(~half, F.col("value"))).alias("now"))


@query(f"WITH {RUNS} SELECT metric, round(now - base, 4) AS delta, now - base >= -0.5 AS passed FROM r WHERE base IS NOT NULL AND now IS NOT NULL")
def ag30_gate(spark, sf_dir):
    return two_runs(spark, sf_dir).where("base IS NOT NULL AND now IS NOT NULL").select("metric", F.round(F.col("now") - F.col("base"), 4).alias("delta"), (F.col("now") - F.col("base") >= -0.5).alias("passed"))


@query(f"WITH {RUNS} SELECT metric, CASE WHEN metric = 'view' THEN NULL ELSE round(now - base, 4) END AS delta, metric <> 'view' AND now - base < -2.0 AS regressed FROM r")
def jn14_baseline(spark, sf_dir):
    r = two_runs(spark, sf_dir)
    now, base = r.select("metric", F.col("now").alias("score")), r.where("metric <> 'view'").select("metric", F.col("base").alias("score"))
    return metrics.against_baseline(now, base, 2.0).select("metric", F.round("delta", 4).alias("delta"), "regressed")


@query("WITH s AS (SELECT doc_id FROM documents), j AS (SELECT s.doc_id AS doc_id, v.judge AS judge FROM s, (VALUES ('q'), ('t')) v(judge)) SELECT j.doc_id AS doc_id, judge, CASE WHEN l.doc_id IS NULL THEN 'WRONG' WHEN (judge = 'q' AND quality = 1) OR (judge = 't' AND toxic = 0) THEN 'CORRECT' ELSE 'WRONG' END AS label FROM j LEFT JOIN labels l ON l.doc_id = j.doc_id")
def ag32_fill(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit("q"), F.lit("t"))).alias("judge"))
    j = s.join(judged(spark, sf_dir).select("doc_id", "judge", "correct"), ["doc_id", "judge"], "left")
    return j.select("doc_id", "judge", F.when(F.coalesce("correct", F.lit(False)), "CORRECT").otherwise("WRONG").alias("label"))


@query("SELECT d.doc_id AS doc_id, coalesce(quality, 0) AS correct, CASE WHEN l.doc_id IS NULL THEN 'missing prediction' ELSE '' END AS error FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def jn9_predictions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", F.coalesce("quality", F.lit(0)).alias("correct"), F.when(F.col("quality").isNull(), "missing prediction").otherwise("").alias("error"))


@query("""WITH f AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role = 'user'), d AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role = 'assistant'),
  n AS (SELECT conv_id, (SELECT count(*) FROM f WHERE f.conv_id = c.conv_id) = (SELECT count(*) FROM d WHERE d.conv_id = c.conv_id) AS same FROM (SELECT DISTINCT conv_id FROM f) c)
  SELECT f.conv_id AS conv_id, f.turn AS turn, CASE WHEN same THEN d.turn END AS decision, CASE WHEN same AND d.turn IS NOT NULL THEN 'BOUND' ELSE 'ADD' END AS op FROM f JOIN n USING (conv_id) LEFT JOIN d ON d.conv_id = f.conv_id AND d.pos = f.pos""")
def jn10_binding(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    nth = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    f, d = c.where("role = 'user'").select("conv_id", "turn", nth.alias("pos")), c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("dturn"), nth.alias("pos"))
    nf, nd = f.groupBy("conv_id").agg(n_rows().alias("nf")), d.groupBy("conv_id").agg(n_rows().alias("nd"))
    j = f.join(nf, "conv_id").join(nd, "conv_id", "left").join(d, ["conv_id", "pos"], "left")
    same = F.col("nf") == F.coalesce("nd", F.lit(0))
    return j.select("conv_id", "turn", F.when(same, F.col("dturn")).alias("decision"), F.when(same & F.col("dturn").isNotNull(), "BOUND").otherwise("ADD").alias("op"))


@query("SELECT conv_id, bool_or(contains(lower(text), 'idiot') OR contains(lower(text), 'the th')) AS found, NOT bool_or(contains(lower(text), 'xyzzy')) AS absent FROM conversations GROUP BY 1")
def jn11_contains(spark, sf_dir):
    return metrics.pack_contains(table(spark, sf_dir, "conversations"), ["conv_id"], ["idiot", "the th"], ["xyzzy"])


@query("SELECT user_id, CAST(count(*) FILTER (event_id % 10 = user_id % 10) AS BIGINT) AS overlap, bool_or(event_id % 10 = user_id % 10) AS hit FROM events GROUP BY 1")
def jn12_gold(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 10).alias("session"))
    gold = e.select("user_id", (F.col("user_id") % 10).alias("session")).distinct().withColumn("gold", F.lit(True))
    j = e.join(gold, ["user_id", "session"], "left")
    return j.groupBy("user_id").agg(F.count_if(F.col("gold")).alias("overlap"), F.coalesce(F.bool_or("gold"), F.lit(False)).alias("hit"))


@query("SELECT d.doc_id AS id, CASE WHEN toxic = 1 THEN 'DISCARD' WHEN quality = 1 THEN 'PROMOTE_USER' ELSE 'KEEP_SESSION' END AS decision FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def jn15_promotion(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id"), "id", "left")
    return d.select("id", F.when(F.col("toxic") == 1, "DISCARD").when(F.col("quality") == 1, "PROMOTE_USER").otherwise("KEEP_SESSION").alias("decision"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 <> 0 AND o_custkey < 100")
def flt12_inbox(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_custkey < 100")
    meta = F.when(F.col("o_orderkey") % 7 == 0, F.create_map(F.lit("is_inbox"), F.lit("true"))).when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("is_inbox"), F.lit("false")))
    return o.withColumn("metadata", meta).where(F.coalesce(F.col("metadata")["is_inbox"], F.lit("false")) == "false").select(F.col("o_orderkey").alias("id"))


@query("SELECT n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(n_name), '1') OR contains(lower(r_name), '2')")
def flt13_cells(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.where(F.contains(F.lower("n_name"), F.lit("1")) | F.contains(F.lower("r_name"), F.lit("2"))).select(F.col("n_nationkey").alias("id"))


@query(f"WITH {M} SELECT agent_id, CAST(sum(n_chars // 4) AS BIGINT) AS spent, count(*) FILTER (status = 'active') AS written, count(*) FILTER (access_count > 0) AS recalled FROM m GROUP BY 1")
def ag22_session(spark, sf_dir):
    m = memories(spark, sf_dir)
    return m.groupBy("agent_id").agg(F.expr("sum(n_chars div 4)").alias("spent"), F.count_if(F.col("status") == "active").alias("written"), F.count_if(F.col("access_count") > 0).alias("recalled"))


@query("SELECT p_brand AS variant, round(sum(p_retailprice), 2) AS cost, CAST(sum(p_size) AS BIGINT) AS minutes FROM part GROUP BY 1")
def ag25_plan(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("variant")).agg(F.round(F.sum("p_retailprice"), 2).alias("cost"), F.sum("p_size").alias("minutes"))


@query("SELECT event_type AS role, 'm' || (user_id % 3) AS model, count(*) AS calls, CAST(sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS tokens, round(max(value), 6) AS latency FROM events GROUP BY 1, 2")
def ag31_usage(spark, sf_dir):
    tokens = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("role"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model")).agg(n_rows().alias("calls"), F.sum(tokens).alias("tokens"), F.round(F.max("value"), 6).alias("latency"))


@query("SELECT p_partkey AS id, coalesce(TRY_CAST(split_part(p_name, ' ', 2) AS DOUBLE), 0) AS score FROM part")
def src14_trend(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.coalesce(F.split_part("p_name", F.lit(" "), F.lit(2)).try_cast("double"), F.lit(0.0)).alias("score"))
