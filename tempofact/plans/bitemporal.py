"""Scans, filters, projections, joins and windows over facts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tempofact.operators import bitemporal as b
from tempofact.operators import intervals
from tempofact.registry import query
from tempofact.sources.fixtures import AS_OF, M, NOW, TURNS, memories, table, ts, turns

ACTIVE_OPEN = "status = 'active' AND valid_until IS NULL"


def day(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query(f"WITH {M} SELECT id, category, status, strftime(t_created, '%Y-%m-%d %H:%M:%S') AS t_created FROM m WHERE id = 42 AND (visibility <> 'private' OR agent_id = 'a0')")
def src1_get(spark, sf_dir):
    return memories(spark, sf_dir).where((F.col("id") == 42) & b.visible_to("a0")).select("id", "category", "status", day("t_created"))


@query(f"""WITH {M} SELECT id, strftime(t_created, '%Y-%m-%d %H:%M:%S') AS t_created FROM m WHERE status = 'active' AND namespace = 'en'
  AND t_created >= TIMESTAMP '2024-01-02' AND t_created <= TIMESTAMP '2024-01-05' AND (visibility <> 'private' OR agent_id = 'a1') ORDER BY m.t_created DESC, id LIMIT 100""")
def src2_list(spark, sf_dir):
    got = b.scan(memories(spark, sf_dir), status="active", namespace="en", after=ts("2024-01-02 00:00:00"), before=ts("2024-01-05 00:00:00"), agent="a1")
    return got.select("id", day("t_created"))


@query(f"WITH {M} SELECT id, status, category FROM m WHERE namespace = 'de'")
def src3_namespace(spark, sf_dir):
    return b.scan(memories(spark, sf_dir), namespace="de", limit=None).select("id", "status", "category")


@query(f"WITH {M} SELECT id FROM m WHERE {ACTIVE_OPEN} AND list_has_any(tags, ['fr', 'src3']) ORDER BY t_created DESC, id LIMIT 20")
def src4_tags(spark, sf_dir):
    return b.tagged(memories(spark, sf_dir), ["fr", "src3"]).select("id")


@query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_quantity < 10 GROUP BY 1")
def src5_sql(spark, sf_dir):
    return spark.sql("SELECT l_returnflag AS flag, count(*) AS n FROM {lineitem} WHERE l_quantity < :q GROUP BY 1", args={"q": 10}, lineitem=table(spark, sf_dir, "lineitem"))


@query(f"WITH {M} SELECT min(id) AS id FROM m WHERE status = 'active' AND sha256(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) IN (SELECT sha256(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) FROM m WHERE id = 1)")
def src6_hash(spark, sf_dir):
    m = memories(spark, sf_dir).withColumn("h", b.content_hash("content"))
    wanted = m.where("id = 1").select("h")
    return m.where("status = 'active'").join(wanted, "h", "left_semi").agg(F.min("id").alias("id"))


@query("SELECT count(*) AS n FROM embeddings WHERE embedding IS NOT NULL")
def src13_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, dense_rank() OVER (ORDER BY conv_id) AS c FROM conversations WHERE role = 'user')
  WHERE c <= 10 AND k <= 2 AND (conv_id % 3 <> 0)""")
def src16_flatten(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").where("role = 'user'")
    first = q.select("conv_id").distinct().orderBy("conv_id").limit(10)
    some = q.join(F.broadcast(first), "conv_id").withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))).where("k <= 2")
    keys = some.where("conv_id % 3 <> 0").select("conv_id", "turn")
    return some.join(keys, ["conv_id", "turn"], "left_semi").select("conv_id", "turn", "text")


@query(f"""WITH {M} SELECT id FROM m WHERE t_created <= TIMESTAMP '{AS_OF}' AND coalesce(t_expired, TIMESTAMP '9999-12-31') > TIMESTAMP '{AS_OF}'
  AND valid_from <= TIMESTAMP '{AS_OF}' AND TIMESTAMP '{AS_OF}' < coalesce(valid_until, TIMESTAMP '9999-12-31')""")
def flt1_as_of(spark, sf_dir):
    return memories(spark, sf_dir).where(b.as_of(ts(AS_OF))).select("id")


@query(f"""WITH {M} SELECT id FROM m WHERE valid_from < TIMESTAMP '2024-01-04' AND coalesce(valid_until, TIMESTAMP '9999-12-31') > TIMESTAMP '2024-01-02'
  AND valid_from < coalesce(valid_until, TIMESTAMP '9999-12-31')""")
def flt2_window(spark, sf_dir):
    return memories(spark, sf_dir).where(b.overlaps(ts("2024-01-02 00:00:00"), ts("2024-01-04 00:00:00"))).select("id")


@query(f"WITH {M} SELECT id FROM m WHERE t_created <= TIMESTAMP '2024-01-03 12:00:00'")
def flt3_ceiling(spark, sf_dir):
    return memories(spark, sf_dir).where(F.col("t_created") <= ts("2024-01-03 12:00:00")).select("id")


@query(f"WITH {M} SELECT id FROM m WHERE {ACTIVE_OPEN}")
def flt4_current(spark, sf_dir):
    return memories(spark, sf_dir).where(b.current()).select("id")


@query(f"WITH {M} SELECT id FROM m WHERE namespace = 'es'")
def flt5_namespace(spark, sf_dir):
    return memories(spark, sf_dir).where(b.in_namespace("es")).select("id")


@query(f"WITH {M} SELECT id FROM m WHERE visibility <> 'private' OR agent_id = 'a2'")
def flt6_visible(spark, sf_dir):
    return memories(spark, sf_dir).where(b.visible_to("a2")).select("id")


@query(f"WITH {M} SELECT id FROM m WHERE user_id = 'u7'")
def flt7_tenant(spark, sf_dir):
    m = memories(spark, sf_dir)
    return b.TenantView(m, "u7").rows().unionByName(b.TenantView(m, None).rows()).select("id")


@query(f"""WITH {M} SELECT id, strftime(valid_from, '%Y-%m-%d') AS day FROM m WHERE lower(entity) = 'entity4' AND strftime(valid_from, '%Y-%m-%d') >= '2024-01-02'
  AND strftime(valid_from, '%Y-%m-%d') <= '2024-01-06' AND (valid_until IS NULL OR strftime(valid_until, '%Y-%m-%dT%H:%M:%S') >= '2024-01-05T00:00:00')""")
def flt9_timeline(spark, sf_dir):
    d = F.date_format("valid_from", "yyyy-MM-dd")
    until = F.date_format("valid_until", "yyyy-MM-dd'T'HH:mm:ss")
    keep = (F.lower("entity") == "entity4") & (d >= "2024-01-02") & (d <= "2024-01-06") & (F.col("valid_until").isNull() | (until >= "2024-01-05T00:00:00"))
    return memories(spark, sf_dir).where(keep).select("id", d.alias("day"))


@query("SELECT u.role AS role, p.perm AS perm FROM (VALUES ('admin'), ('writer'), ('reader')) u(role) JOIN (VALUES ('admin','read'),('admin','write'),('admin','forget'),('writer','read'),('writer','write'),('reader','read')) p(role, perm) ON u.role = p.role WHERE NOT (u.role = 'writer' AND p.perm IN ('write', 'forget'))")
def flt11_rbac(spark, sf_dir):
    from tempofact.operators.governance import allowed

    return allowed(spark, {"admin": False, "writer": True, "reader": False})


@query(f"""WITH {M} SELECT id, coalesce(category, 'general') AS category, coalesce(namespace, 'default') AS namespace, coalesce(entity, '') AS entity, status,
  strftime(valid_from, '%Y-%m-%dT%H:%M:%S') AS valid_from, coalesce(strftime(valid_until, '%Y-%m-%dT%H:%M:%S'), '') AS valid_until, round(confidence, 4) AS confidence FROM m""")
def prj1_row(spark, sf_dir):
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return memories(spark, sf_dir).select(
        "id", F.coalesce("category", F.lit("general")).alias("category"), F.coalesce(F.col("metadata")["_namespace"], F.lit("default")).alias("namespace"), F.coalesce("entity", F.lit("")).alias("entity"),
        "status", F.date_format("valid_from", iso).alias("valid_from"), F.coalesce(F.date_format("valid_until", iso), F.lit("")).alias("valid_until"), F.round("confidence", 4).alias("confidence"),
    )


@query(f"""WITH {M} SELECT id, left(CAST(id AS VARCHAR), 8) AS short_id, CASE WHEN length(content) > 220 THEN left(content, 220) || '…' ELSE content END AS excerpt,
  strftime(t_created, '%Y-%m-%d') AS date, strftime(t_created, '%H:%M') AS time, CAST(round_even(confidence * 100, 0) AS BIGINT) AS confidence_pct FROM m""")
def prj2_ui(spark, sf_dir):
    text = F.when(F.length("content") > 220, F.concat(F.substring("content", 1, 220), F.lit("…"))).otherwise(F.col("content"))
    return memories(spark, sf_dir).select(
        "id", F.substring(F.col("id").cast("string"), 1, 8).alias("short_id"), text.alias("excerpt"), F.date_format("t_created", "yyyy-MM-dd").alias("date"),
        F.date_format("t_created", "HH:mm").alias("time"), F.bround(F.col("confidence") * 100, 0).cast("long").alias("confidence_pct"),
    )


@query(f"""WITH {M}, p AS (SELECT * FROM m WHERE {ACTIVE_OPEN} ORDER BY confidence DESC, id LIMIT 10)
  SELECT count(*) AS entries, CAST(sum(length(content)) // 4 AS BIGINT) AS token_count, string_agg(CAST(id AS VARCHAR), ',' ORDER BY confidence DESC, id) AS ids FROM p""")
def prj3_pack(spark, sf_dir):
    top = memories(spark, sf_dir).where(b.current()).orderBy(F.desc("confidence"), "id").limit(10)
    ids = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "id")))
    return top.agg(F.count(F.lit(1)).alias("entries"), F.expr("sum(length(content)) div 4").alias("token_count"), ids.alias("i")).select("entries", "token_count", F.array_join(F.transform("i.id", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"""WITH {M}, p AS (SELECT * FROM m WHERE {ACTIVE_OPEN} AND length(content) < 300 ORDER BY confidence DESC, id LIMIT 5)
  SELECT 'Relevant memories:' || chr(10) || string_agg('- [' || category || ':' || printf('%.2f', confidence) || '] ' || content, chr(10) ORDER BY confidence DESC, id) AS context FROM p""")
def prj4_context(spark, sf_dir):
    top = memories(spark, sf_dir).where(b.current() & (F.length("content") < 300)).orderBy(F.desc("confidence"), "id").limit(5)
    line = F.format_string("- [%s:%.2f] %s", "category", "confidence", "content")
    rows = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "id", line.alias("line"))))
    return top.agg(rows.alias("r")).select(F.concat(F.lit("Relevant memories:\n"), F.array_join("r.line", "\n")).alias("context"))


@query(f"""WITH {TURNS}, e AS (SELECT conv_id, turn, text AS u, lead(text) OVER w AS a, lead(role) OVER w AS r, role FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  ep AS (SELECT conv_id AS id, u, a FROM e WHERE role = 'user' AND r = 'assistant' AND turn = 0), {M}
  SELECT m.id AS id, concat_ws(chr(10) || '---' || chr(10), content, ep.u, ep.a, 'Tags: ' || array_to_string(tags, ', ')) AS embedding_text FROM m LEFT JOIN ep USING (id)""")
def prj5_embedding_text(spark, sf_dir):
    ep = rounds(spark, sf_dir).where("turn = 0").select(F.col("conv_id").alias("id"), "user_text", "assistant_text")
    tags = F.concat(F.lit("Tags: "), F.array_join("tags", ", "))
    return memories(spark, sf_dir).join(ep, "id", "left").select("id", F.concat_ws("\n---\n", "content", "user_text", "assistant_text", tags).alias("embedding_text"))


def rounds(spark, sf_dir):
    """User turns with the assistant turn that follows."""
    w = W.partitionBy("conv_id").orderBy("turn")
    t = turns(spark, sf_dir).withColumns({"assistant_text": F.lead("text").over(w), "next_role": F.lead("role").over(w), "assistant_ts": F.lead("ts").over(w)})
    return t.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("user_text"), "assistant_text", F.col("ts").alias("user_ts"), "assistant_ts")


@query(f"WITH {M} SELECT id, 'user:' || user_id || CASE WHEN id % 2 = 0 THEN '/project:' || category ELSE '' END || CASE WHEN id % 4 = 0 THEN '/session:' || agent_id ELSE '' END AS ns FROM m")
def prj6_namespace(spark, sf_dir):
    part = lambda name, c, on: F.when(on, F.concat(F.lit(name), F.col(c)))
    ns = F.concat_ws("/", F.concat(F.lit("user:"), "user_id"), part("project:", "category", F.col("id") % 2 == 0), part("session:", "agent_id", F.col("id") % 4 == 0))
    return memories(spark, sf_dir).select("id", ns.alias("ns"))


@query(f"WITH {M} SELECT id, 'v1|' || id || '|' || coalesce(agent_id, '') || '|' || strftime(t_created, '%Y-%m-%dT%H:%M:%S') || '|' || sha256(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) AS payload FROM m")
def prj7_payload(spark, sf_dir):
    parts = [F.lit("v1"), F.col("id").cast("string"), F.coalesce("agent_id", F.lit("")), F.date_format("t_created", "yyyy-MM-dd'T'HH:mm:ss"), b.content_hash("content")]
    return memories(spark, sf_dir).select("id", F.concat_ws("|", *parts).alias("payload"))


@query(f"WITH {TURNS} SELECT conv_id, turn, '[' || strftime(ts, '%Y-%m-%d') || '] ' || upper(left(role, 1)) || substr(role, 2) || ': ' || text AS line FROM t")
def prj8_turn(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd"), F.lit("] "), F.initcap("role"), F.lit(": "), "text").alias("line"))


@query(f"WITH {M} SELECT id, content, category, entity, round_even(confidence / 3, 3) AS score, status, count(*) OVER () AS count FROM m WHERE {ACTIVE_OPEN} AND user_id = 'u3'")
def prj9_tool(spark, sf_dir):
    m = memories(spark, sf_dir).where(b.current() & (F.col("user_id") == "u3"))
    n = F.count(F.lit(1)).over(W.partitionBy("user_id"))
    return m.select("id", "content", "category", "entity", F.bround(F.col("confidence") / 3, 3).alias("score"), "status", n.alias("count"))


HITS = "h AS (SELECT vec_id AS id, row_number() OVER (ORDER BY label, vec_id) AS pos FROM embeddings)"


@query(f"""WITH {M}, {HITS} SELECT CAST(count(*) AS BIGINT) AS hits, count(*) FILTER (m.id IS NULL) AS missing, count(*) FILTER (m.id IS NOT NULL AND status <> 'active') AS inactive,
  count(*) FILTER (status = 'active' AND namespace <> 'en') AS other_namespace, count(*) FILTER (status = 'active' AND namespace = 'en') AS kept FROM h LEFT JOIN m USING (id)""")
def jn2_lookup(spark, sf_dir):
    h = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    j = h.join(memories(spark, sf_dir).select("id", "status", "namespace"), "id", "left")
    n = lambda p: F.count_if(F.expr(p))
    return j.agg(F.count(F.lit(1)).alias("hits"), n("status IS NULL").alias("missing"), n("status <> 'active'").alias("inactive"), n("status = 'active' AND namespace <> 'en'").alias("other_namespace"), n("status = 'active' AND namespace = 'en'").alias("kept"))


@query(f"""WITH RECURSIVE {M}, c(start, step, id) AS (SELECT id, 0, id FROM m UNION ALL
  SELECT c.start, c.step + 1, m.superseded_by FROM c JOIN m ON m.id = c.id JOIN m AS n ON n.id = m.superseded_by WHERE c.step < 20) SELECT start, CAST(step AS BIGINT) AS step, id FROM c""")
def jn4_chain(spark, sf_dir):
    m = memories(spark, sf_dir)
    return b.chain(m, m).select("start", F.col("step").cast("long").alias("step"), "id")


@query(f"WITH {M} SELECT superseded_by AS id, id AS predecessor FROM m WHERE superseded_by IN (SELECT id FROM m WHERE category = 'src1')")
def jn5_predecessor(spark, sf_dir):
    m = memories(spark, sf_dir)
    return b.predecessors(m, m.where("category = 'src1'")).select("id", "predecessor")


@query(f"""WITH {M} SELECT n.id AS new_id, count(*) AS links, min(o.id) AS old_id FROM m n JOIN m o ON n.entity = o.entity AND n.category = o.category AND n.namespace = o.namespace
  WHERE o.status = 'active' AND o.valid_until IS NULL AND n.id <> o.id AND trim(n.content, ' ' || chr(10) || chr(9) || chr(13)) <> trim(o.content, ' ' || chr(10) || chr(9) || chr(13)) GROUP BY n.id""")
def jn6_contradictions(spark, sf_dir):
    m = memories(spark, sf_dir)
    return b.contradictions_by_entity(m, m)


@query(f"""WITH {M}, pts AS (SELECT DISTINCT namespace, TIMESTAMP '2024-01-01' + to_days(CAST(d AS INTEGER)) AS at FROM m, range(0, 12) r(d)),
  f AS (SELECT namespace, valid_from, max(id) AS id FROM m GROUP BY 1, 2)
  SELECT p.namespace AS namespace, strftime(p.at, '%Y-%m-%d') AS day, (SELECT max_by(f.id, f.valid_from) FROM f WHERE f.namespace = p.namespace AND f.valid_from <= p.at) AS fact_id FROM pts p""")
def jn16_as_of_join(spark, sf_dir):
    m = memories(spark, sf_dir).select("namespace", "valid_from", "id")
    facts = m.groupBy("namespace", "valid_from").agg(F.max("id").alias("id"))
    points = m.select("namespace").distinct().withColumn("at", F.explode(F.expr("transform(sequence(0, 11), d -> TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(d))")))
    return b.as_of_join(points, facts, ["namespace"]).select("namespace", F.date_format("at", "yyyy-MM-dd").alias("day"), "fact_id")


@query(f"""WITH {M}, l AS (SELECT id, entity, namespace, valid_from AS a, coalesce(valid_until, valid_from + to_hours(CAST(id % 50 + 1 AS INTEGER))) AS z FROM m WHERE id % 3 = 1),
  r AS (SELECT id, entity, namespace, valid_from AS a, valid_until AS z FROM m WHERE id % 3 = 2)
  SELECT l.id AS left_id, r.id AS right_id, strftime(greatest(l.a, r.a), '%Y-%m-%d %H:%M:%S') AS since, strftime(least(l.z, coalesce(r.z, TIMESTAMP '9999-12-31')), '%Y-%m-%d %H:%M:%S') AS until
  FROM l JOIN r ON l.entity = r.entity AND l.namespace = r.namespace AND l.a < coalesce(r.z, TIMESTAMP '9999-12-31') AND r.a < l.z AND l.a < l.z AND r.a < coalesce(r.z, TIMESTAMP '9999-12-31')""")
def jn16_overlaps(spark, sf_dir):
    """Facts of the same entity and namespace whose valid times meet, open ends included."""
    m = memories(spark, sf_dir)
    ended = F.coalesce("valid_until", F.col("valid_from") + F.make_dt_interval(F.lit(0), (F.col("id") % 50 + 1).cast("int")))
    left = m.where("id % 3 = 1").select("id", "entity", "namespace", F.col("valid_from").alias("start"), ended.alias("end"))
    right = m.where("id % 3 = 2").select("id", "entity", "namespace", F.col("valid_from").alias("start"), F.col("valid_until").alias("end"))
    return intervals.overlap_join(left, right, ["entity", "namespace"], lambda at: F.date_format(at, "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {M} SELECT id, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from FROM m WHERE entity = 'Entity5' AND namespace = 'en' ORDER BY m.valid_from, id")
def tk6_timeline(spark, sf_dir):
    return b.timeline(memories(spark, sf_dir).where("entity = 'Entity5' AND namespace = 'en'")).select("id", day("valid_from"))


@query(f"WITH {M} SELECT id FROM m WHERE {ACTIVE_OPEN} AND category = 'src2' ORDER BY t_created DESC")
def tk7_current(spark, sf_dir):
    return memories(spark, sf_dir).where(b.current() & (F.col("category") == "src2")).orderBy(F.desc("t_created")).select("id")


@query(f"WITH {M}, p AS (SELECT id FROM m ORDER BY t_created DESC, id LIMIT 61 OFFSET 60) SELECT id, (SELECT count(*) FROM p) > 60 AS has_next FROM (SELECT id FROM m ORDER BY t_created DESC, id LIMIT 60 OFFSET 60)")
def tk8_page(spark, sf_dir):
    page = memories(spark, sf_dir).orderBy(F.desc("t_created"), "id").offset(60).limit(61).select("id", "t_created")
    more = F.count(F.lit(1)).over(W.partitionBy(F.lit(0))) > 60  # over at most 61 rows
    return page.withColumn("has_next", more).orderBy(F.desc("t_created"), "id").limit(60).select("id", "has_next")


@query(f"WITH {M} SELECT user_id, max(strftime(t_created, '%Y-%m-%d')) AS last_day, count(*) AS n FROM m GROUP BY user_id ORDER BY last_day DESC, user_id LIMIT 10")
def tk10_recent(spark, sf_dir):
    return memories(spark, sf_dir).groupBy("user_id").agg(F.date_format(F.max("t_created"), "yyyy-MM-dd").alias("last_day"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("last_day"), "user_id").limit(10)


@query("""SELECT part, k FROM (SELECT p_partkey AS part, coalesce(TRY_CAST(regexp_extract(p_name, '([0-9]+)$', 1) AS BIGINT), 999999) AS k FROM part) ORDER BY k, part LIMIT 50""")
def tk12_chunk_order(spark, sf_dir):
    k = F.coalesce(F.expr(r"try_cast(regexp_extract(p_name, '([0-9]+)$', 1) AS bigint)"), F.lit(999999).cast("long"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), k.alias("k")).orderBy("k", "part").limit(50)


@query("SELECT event_id, rn FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 20")
def wn1_lane_rank(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))).where("rn <= 20").select("event_id", F.col("rn").cast("long").alias("rn"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1")
def wn2_keep_max(spark, sf_dir):
    from tempofact.operators.scoring import keep_best

    return keep_best(table(spark, sf_dir, "events"), "user_id", "value", "event_id").select("user_id", "event_id", "value")


DAILY = "d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS score FROM events GROUP BY 1, 2)"


@query(f"WITH {DAILY} SELECT event_type, strftime(day, '%Y-%m-%d') AS day, round(score - lag(score) OVER (PARTITION BY event_type ORDER BY day), 6) AS delta FROM d")
def wn3_delta(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("score"))
    w = W.partitionBy("event_type").orderBy("day")
    return d.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(F.col("score") - F.lag("score").over(w), 6).alias("delta"))


@query("SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def wn4_latest(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT event_id, round(1 - CAST(rn - 1 AS DOUBLE) / n, 6) AS sim FROM (SELECT event_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def wn6_position(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    rn, n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")), F.count(F.lit(1)).over(W.partitionBy("user_id"))
    return e.select("event_id", F.round(1 - (rn - 1) / n, 6).alias("sim"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def wn7_sequence(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def wn8_ring(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id")


@query(f"""WITH {TURNS}, e AS (SELECT conv_id, turn, text AS user_text, lead(text) OVER w AS assistant_text, lead(role) OVER w AS r, role FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, user_text, assistant_text FROM e WHERE role = 'user' AND r = 'assistant'""")
def wn9_rounds(spark, sf_dir):
    return rounds(spark, sf_dir).select("conv_id", "turn", "user_text", "assistant_text")


ORDERS = "o AS (SELECT o_orderkey AS id, o_custkey AS entity, o_orderpriority AS category, o_totalprice AS value, CAST(o_orderdate AS TIMESTAMP) AS valid_from FROM orders)"


def order_facts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("valid_from"))


@query(f"""WITH {ORDERS} SELECT id, row_number() OVER w AS version, strftime(lead(valid_from) OVER w, '%Y-%m-%d') AS closed FROM o WINDOW w AS (PARTITION BY entity, category ORDER BY valid_from, id)""")
def wn10_versions(spark, sf_dir):
    v = b.versions(order_facts(spark, sf_dir), ["entity", "category"])
    return v.select("id", F.col("version").cast("long").alias("version"), F.date_format("next_from", "yyyy-MM-dd").alias("closed"))


@query(f"""WITH {M}, p AS (SELECT min(id) AS id, max(id) AS new_id FROM m WHERE entity IS NOT NULL AND {ACTIVE_OPEN} GROUP BY entity, category, namespace HAVING count(*) > 1)
  SELECT m.id AS id, CASE WHEN p.id IS NOT NULL THEN 'superseded' ELSE status END AS status, coalesce(p.new_id, superseded_by) AS superseded_by,
  strftime(CASE WHEN p.id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE valid_until END, '%Y-%m-%d') AS valid_until FROM m LEFT JOIN p USING (id)""")
def dm2_supersede(spark, sf_dir):
    m = memories(spark, sf_dir)
    pairs = m.where(b.current() & F.col("entity").isNotNull()).groupBy("entity", "category", "namespace").agg(F.min("id").alias("id"), F.max("id").alias("new_id")).where("id <> new_id")
    return b.supersede(m, pairs, ts(NOW)).select("id", "status", "superseded_by", F.date_format("valid_until", "yyyy-MM-dd").alias("valid_until"))
