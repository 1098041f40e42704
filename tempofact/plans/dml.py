"""State changes, checked by the state after."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tempofact.functions.text import CATEGORIES
from tempofact.operators import dml, governance, recall
from tempofact.registry import query
from tempofact.sources.fixtures import M, NOW, TURNS, memories, table, ts

HASH = "sha256(regexp_replace(content, '^\\s+|\\s+$', '', 'g'))"


@query(f"""WITH {M}, b AS (SELECT *, row_number() OVER (PARTITION BY {HASH}, namespace ORDER BY id) AS n FROM m WHERE id % 10 >= 7)
  SELECT id FROM b WHERE n = 1 AND ({HASH}, namespace) NOT IN (SELECT ({HASH}, namespace) FROM m WHERE id % 10 < 7 AND status = 'active')""")
def dm1_add(spark, sf_dir):
    m = memories(spark, sf_dir)
    return dml.new_rows(m.where("id % 10 < 7"), m.where("id % 10 >= 7")).select("id")


@query(f"WITH {M} SELECT id, CASE WHEN id % 4 = 0 THEN 'changed' ELSE category END AS category, CASE WHEN id % 8 = 0 THEN 0.9::DOUBLE ELSE round(confidence, 6) END AS confidence FROM m")
def dm3_update(spark, sf_dir):
    m = memories(spark, sf_dir)
    changes = m.where("id % 4 = 0").select("id", F.lit("changed").alias("category"), F.when(F.col("id") % 8 == 0, 0.9).alias("confidence"))
    return dml.update(m, changes).select("id", "category", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {M} SELECT count(*) FILTER (status = 'archived') AS deleted, count(*) FILTER (status <> 'archived') AS left FROM m")
def dm4_compact(spark, sf_dir):
    left, n = dml.delete(memories(spark, sf_dir), F.col("status") == "archived")
    return n.withColumn("k", F.lit(1)).join(left.agg(F.count(F.lit(1)).alias("left")).withColumn("k", F.lit(1)), "k").drop("k")


@query(f"WITH {M} SELECT id, CASE WHEN status = 'active' AND t_created < TIMESTAMP '2024-01-03' THEN 'archived' ELSE status END AS status FROM m")
def dm5_forget(spark, sf_dir):
    return dml.forget(memories(spark, sf_dir), F.col("t_created") < ts("2024-01-03 00:00:00")).select("id", "status")


def facts(spark, sf_dir):
    """New facts: every row again with an id beyond the table's, half of the texts unchanged."""
    m = memories(spark, sf_dir)
    return m.select((F.col("id") + 10_000_000).alias("id"), F.when(F.col("id") % 2 == 1, F.col("content")).otherwise(F.concat(F.lit("new "), "content")).alias("content"), "category", "entity", "confidence")


NEWF = "f AS (SELECT id + 10000000 AS id, CASE WHEN id % 2 = 1 THEN content ELSE 'new ' || content END AS content, category, entity, confidence FROM m)"
DEC = f"""cur AS (SELECT entity, category, arg_max(id, (t_created, id)) AS target, arg_max({HASH}, (t_created, id)) AS h FROM m WHERE status = 'active' AND valid_until IS NULL AND entity IS NOT NULL GROUP BY 1, 2),
  d AS (SELECT f.id AS new_id, CASE WHEN target IS NULL THEN 'ADD' WHEN h = {HASH} THEN 'NOOP' ELSE 'INVALIDATE' END AS op, target, content FROM f LEFT JOIN cur USING (entity, category))"""


@query(f"WITH {M}, {NEWF}, {DEC} SELECT new_id, op, target FROM d")
def dm9_resolve(spark, sf_dir):
    return dml.resolve(facts(spark, sf_dir), memories(spark, sf_dir)).select("new_id", "op", "target")


@query(f"""WITH {M}, {NEWF}, {DEC}, last AS (SELECT target, max(new_id) AS new_id FROM d WHERE op = 'INVALIDATE' GROUP BY 1)
  SELECT m.id AS id, CASE WHEN last.target IS NOT NULL THEN 'superseded' ELSE status END AS status, coalesce(last.new_id, superseded_by) AS superseded_by FROM m LEFT JOIN last ON last.target = m.id
  UNION ALL SELECT new_id, 'active', NULL FROM d WHERE op IN ('ADD', 'INVALIDATE')""")
def dm6_apply(spark, sf_dir):
    m = memories(spark, sf_dir)
    after, _ = dml.apply_decisions(m, dml.resolve(facts(spark, sf_dir), m), ts(NOW))
    return after.select("id", "status", "superseded_by")


@query()
def dm7_round(spark, sf_dir):
    """Rounds of conversations to facts by rule, resolved against the table and applied."""
    from tempofact.functions.text import infer_category
    from tempofact.plans.bitemporal import rounds

    r = rounds(spark, sf_dir)
    new = r.select((F.col("conv_id") * 100 + F.col("turn") + 20_000_000).alias("id"), F.col("user_text").alias("content"), infer_category(F.col("user_text")).alias("category"), F.concat(F.lit("Entity"), F.col("conv_id") % 11).alias("entity"), F.lit(0.7).alias("confidence"))
    m = memories(spark, sf_dir)
    return dml.apply_decisions(m, dml.resolve(new, m), ts(NOW))[1]


@query(f"""WITH {M}, {NEWF}, live AS (SELECT * FROM m WHERE status = 'active'),
  near AS (SELECT q.vec_id + 10000000 AS id, e.vec_id AS known, row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) AS n
    FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND q.vec_id IN (SELECT id FROM m) AND e.vec_id IN (SELECT id FROM live) QUALIFY n <= 5),
  rest AS (SELECT * FROM f WHERE id NOT IN (SELECT id FROM near)), a AS (SELECT category, entity, id AS known, row_number() OVER (PARTITION BY category, entity ORDER BY t_created DESC, id) AS n FROM live QUALIFY n <= 5),
  b AS (SELECT category, id AS known, row_number() OVER (PARTITION BY category ORDER BY t_created DESC, id) AS n FROM live QUALIFY n <= 5)
  SELECT id, known, n FROM near UNION ALL SELECT rest.id, known, n FROM rest JOIN a USING (category, entity) UNION ALL SELECT rest.id, known, n FROM rest JOIN b USING (category) WHERE entity IS NULL""")
def dm8_context(spark, sf_dir):
    """Five active facts for each new one: the most similar where it has a vector (ids divisible by 20), the newest of its subject otherwise."""
    new, e = facts(spark, sf_dir).select("id", "category", "entity"), table(spark, sf_dir, "embeddings")
    qs = e.where("vec_id % 20 = 0").select((F.col("vec_id") + 10_000_000).alias("query_id"), F.col("embedding").alias("query"))
    return recall.context(new, memories(spark, sf_dir), qs.join(new.select(F.col("id").alias("query_id")), "query_id", "left_semi"), e)


QUEUE = """q AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'done' END AS state, ts AS created_at,
  CASE WHEN event_type = 'view' THEN TIMESTAMP '2024-02-01' - to_seconds(event_id % 1200) END AS claimed_at FROM events)"""


def queue(spark, sf_dir):
    state = F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "error", "failed").otherwise("done")
    claimed = F.when(F.col("event_type") == "view", ts(NOW) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") % 1200).cast("decimal(18,6)")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), state.alias("state"), F.col("ts").alias("created_at"), claimed.alias("claimed_at"), F.lit(None).cast("string").alias("error"))


@query(f"WITH {QUEUE} SELECT id FROM q WHERE state = 'pending' OR (state = 'processing' AND claimed_at < TIMESTAMP '2024-02-01' - to_seconds(600)) ORDER BY created_at, id LIMIT 20")
def dm10_claim(spark, sf_dir):
    q = queue(spark, sf_dir)
    before = q.where((F.col("state") != "processing") | (F.col("claimed_at") != ts(NOW))).select("id")
    return dml.claim(q, ts(NOW)).where((F.col("state") == "processing") & (F.col("claimed_at") == ts(NOW))).select("id").join(before, "id", "left_semi")


@query(f"WITH {QUEUE} SELECT id FROM q WHERE state = 'processing' AND claimed_at < TIMESTAMP '2024-02-01' - to_seconds(600)")
def sm2_lease(spark, sf_dir):
    return queue(spark, sf_dir).where((F.col("state") == "processing") & (F.timestamp_diff("SECOND", F.col("claimed_at"), ts(NOW)) > 600)).select("id")


@query(f"""WITH {QUEUE}, e AS (SELECT *, ['enqueue', 'done', 'failed', 'release'][id % 4 + 1] AS event FROM q) SELECT id, CASE WHEN event = 'enqueue' AND state IN ('done', 'failed') THEN 'pending' WHEN state = 'processing' AND event IN ('done', 'failed') THEN event
  WHEN state = 'processing' AND event = 'release' THEN 'pending' ELSE state END AS state, CASE WHEN state = 'processing' AND event = 'failed' THEN repeat('x', 1000) END AS error FROM e""")
def dm11_transitions(spark, sf_dir):
    q = queue(spark, sf_dir)
    ev = q.select("id", F.element_at(F.array(*map(F.lit, ("enqueue", "done", "failed", "release"))), (F.col("id") % 4 + 1).cast("int")).alias("event"), F.repeat(F.lit("x"), 1500).alias("error"))
    return dml.transition(q, ev).select("id", "state", "error")


@query()
def dm12_consolidate(spark, sf_dir):
    """Claim a batch of queued rounds, turn them to facts by rule, resolve and apply."""
    from tempofact.functions.text import infer_category
    from tempofact.plans.bitemporal import rounds

    m = memories(spark, sf_dir)
    r = rounds(spark, sf_dir).withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    waiting = r.select("id", F.lit("pending").alias("state"), (ts(NOW) - F.make_dt_interval(F.lit(0), F.col("conv_id").cast("int"))).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("claimed_at"), F.lit(None).cast("string").alias("error"))
    claimed = dml.claim(waiting, ts(NOW)).where(F.col("claimed_at") == ts(NOW)).select("id")
    said = F.col("user_text")
    new = r.join(claimed, "id").select((F.col("id") + 30_000_000).alias("id"), said.alias("content"), infer_category(said).alias("category"), F.concat(F.lit("Entity"), F.col("conv_id") % 11).alias("entity"), F.lit(0.7).alias("confidence"))
    return dml.apply_decisions(m, dml.resolve(new, m), ts(NOW))[1]


ROUNDS = f"""{TURNS}, u AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM t),
  r AS (SELECT conv_id * 100 + turn AS id, conv_id, ts, text AS content, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS h, CASE WHEN conv_id % 7 <> 0 THEN 'Entity' || (conv_id % 5) END AS entity,
    CASE {" ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, words in CATEGORIES)} ELSE 'general' END AS category FROM u WHERE role = 'user' AND next_role = 'assistant')"""


def known_rounds(spark, sf_dir):
    """(memories, episodes' facts): rounds of even conversations are known already; every round is an episode with one fact."""
    from tempofact.functions.text import infer_category
    from tempofact.plans.bitemporal import rounds

    r = rounds(spark, sf_dir).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "conv_id", F.col("user_ts").alias("ts"), F.col("user_text").alias("content"), infer_category(F.col("user_text")).alias("category"),
        F.when(F.col("conv_id") % 7 != 0, F.concat(F.lit("Entity"), F.col("conv_id") % 5)).alias("entity"))
    memories = r.where("conv_id % 2 = 0").select(
        "id", "content", "category", "entity", F.lit(0.9).alias("confidence"), F.lit("active").alias("status"), F.col("ts").alias("valid_from"), F.col("ts").alias("t_created"), F.lit(None).cast("timestamp_ntz").alias("valid_until"),
        F.lit(None).cast("bigint").alias("superseded_by"), F.lit(None).cast("map<string,string>").alias("metadata"))
    facts = r.select((F.col("id") + 30_000_000).alias("id"), F.col("id").alias("episode"), "content", "category", "entity", F.lit(0.7).alias("confidence"), "conv_id")
    return memories, facts


@query(f"""WITH {ROUNDS}, b AS (SELECT * FROM r ORDER BY conv_id DESC, id LIMIT 20), m AS (SELECT * FROM r WHERE conv_id % 2 = 0),
  a1 AS (SELECT id, category, entity, h, row_number() OVER (PARTITION BY category, entity ORDER BY ts DESC, id) AS n FROM m WHERE entity IS NOT NULL QUALIFY n <= 5),
  a2 AS (SELECT id, category, h, row_number() OVER (PARTITION BY category ORDER BY ts DESC, id) AS n FROM m QUALIFY n <= 5),
  near AS (SELECT b.id, b.h = a1.h AS same, a1.id AS known, n FROM b JOIN a1 USING (category, entity) UNION ALL SELECT b.id, b.h = a2.h, a2.id, n FROM b JOIN a2 USING (category) WHERE b.entity IS NULL),
  d AS (SELECT b.id, CASE WHEN count(*) FILTER (same) > 0 THEN 'NOOP' WHEN count(known) > 0 THEN 'INVALIDATE' ELSE 'ADD' END AS op, min_by(known, n) AS target FROM b LEFT JOIN near USING (id) GROUP BY b.id),
  gone AS (SELECT target, max(id) + 30000000 AS by_id FROM d WHERE op = 'INVALIDATE' GROUP BY 1)
  SELECT 'memory' AS kind, m.id, CASE WHEN target IS NULL THEN 'active' ELSE 'superseded' END AS state, by_id AS superseded_by, NULL AS model FROM m LEFT JOIN gone ON target = m.id
  UNION ALL SELECT 'memory', id + 30000000, 'active', NULL, 'consolidation:rules' FROM d WHERE op <> 'NOOP'
  UNION ALL SELECT 'episode', id, CASE WHEN id IN (SELECT id FROM b) THEN 'done' ELSE 'pending' END, NULL, NULL FROM r""")
def dm12_episodes(spark, sf_dir):
    """A batch of the oldest episodes (here those of the last conversations) consolidated into the memories that there are."""
    memories, facts = known_rounds(spark, sf_dir)
    waiting = facts.select(F.col("episode").alias("id"), F.lit("pending").alias("state"), (ts(NOW) - F.make_dt_interval(F.lit(0), F.col("conv_id").cast("int"))).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("claimed_at"), F.lit(None).cast("string").alias("error"))
    after, queue = dml.consolidate(waiting, facts.drop("conv_id"), memories, ts(NOW))
    rows = after.select(F.lit("memory").alias("kind"), "id", F.col("status").alias("state"), "superseded_by", F.col("metadata").getItem("extraction_model").alias("model"))
    return rows.unionByName(queue.select(F.lit("episode").alias("kind"), "id", "state"), allowMissingColumns=True)


@query(f"WITH {QUEUE} SELECT q.id AS id, CASE WHEN user_id % 5 = 0 AND state IN ('done', 'failed') THEN 'pending' ELSE state END AS state FROM q JOIN events ON event_id = id")
def dm13_session_end(spark, sf_dir):
    ended = table(spark, sf_dir, "events").where("user_id % 5 = 0").select(F.col("event_id").alias("id"), F.lit("enqueue").alias("event"), F.lit(None).cast("string").alias("error"))
    return dml.transition(queue(spark, sf_dir), ended).select("id", "state")


@query(f"WITH {M} SELECT m.id AS id, CASE WHEN toxic = 1 THEN 'archived' ELSE status END AS status, CASE WHEN toxic = 1 THEN 'session' WHEN quality = 1 THEN 'user' ELSE 'session' END AS scope FROM m LEFT JOIN labels ON doc_id = id")
def dm15_promote(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "DISCARD").when(F.col("quality") == 1, "PROMOTE_USER").otherwise("KEEP_SESSION").alias("decision"))
    return dml.promote(memories(spark, sf_dir), d).select("id", "status", "scope")


@query("SELECT o_custkey AS user_id, o_orderpriority AS project FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1, 2 UNION SELECT c_custkey, 'Inbox' FROM customer")
def dm16_projects(spark, sf_dir):
    have = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("Inbox").alias("project"))
    wanted = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("project"))
    return dml.get_or_create(have, wanted, ["user_id", "project"])


@query(f"WITH {M} SELECT 'memories' AS \"table\", user_id, count(*) AS rows FROM m WHERE user_id IN ('u1', 'u2') GROUP BY user_id UNION ALL SELECT 'events', 'u' || (user_id % 20), count(*) FROM events WHERE user_id % 20 IN (1, 2) GROUP BY user_id % 20")
def dm18_purge(spark, sf_dir):
    tables = {"memories": memories(spark, sf_dir), "events": table(spark, sf_dir, "events").withColumn("user_id", F.concat(F.lit("u"), F.col("user_id") % 20))}
    return governance.purge(tables, spark.sql("SELECT * FROM VALUES ('u1'), ('u2') AS t(user_id)"))[1]


@query(f"WITH {M} SELECT count(*) AS n FROM m WHERE user_id NOT IN ('u1', 'u2')")
def ag23_after_purge(spark, sf_dir):
    kept, _ = governance.purge({"memories": memories(spark, sf_dir)}, spark.sql("SELECT * FROM VALUES ('u1'), ('u2') AS t(user_id)"))
    return kept["memories"].agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 7 ELSE 10 END AS max_memories, CASE WHEN c_custkey % 3 = 0 THEN 5 WHEN c_custkey % 2 = 0 THEN 3 END AS max_writes FROM customer")
def dm19_limits(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.selectExpr("c_custkey AS user_id", "10 AS max_memories", "CASE WHEN c_custkey % 2 = 0 THEN 3 END AS max_writes")
    new = c.where("c_custkey % 3 = 0").selectExpr("c_custkey AS user_id", "7 AS max_memories", "5 AS max_writes")
    return dml.set_limits(old, new)


@query("SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'explicit' WHEN conv_id % 3 = 1 THEN 'p' || (conv_id % 5) ELSE 'Inbox' END AS project FROM (SELECT DISTINCT conv_id FROM conversations)")
def dm20_identity(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    given = c.where("conv_id % 3 = 0").select("conv_id", F.lit("explicit").alias("explicit"))
    session = c.where("conv_id % 3 < 2").select("conv_id", F.concat(F.lit("p"), F.col("conv_id") % 5).alias("session_project"))
    return c.join(given, "conv_id", "left").join(session, "conv_id", "left").select("conv_id", F.coalesce("explicit", "session_project", F.lit("Inbox")).alias("project"))


@query()
def dm23_haystack(spark, sf_dir):
    """Sessions to memories: raw turns and turns by rule, with counters."""
    from tempofact.functions.text import rule_facts

    c = table(spark, sf_dir, "conversations")
    raw = c.select("conv_id", F.lit("raw").alias("strategy"))
    rule = c.select("conv_id", F.explode(rule_facts(F.col("text")))).select("conv_id", F.lit("extracted").alias("strategy"))
    return raw.unionByName(rule).groupBy("conv_id", "strategy").agg(F.count(F.lit(1)).alias("n"))


@query()
def dm25_dual(spark, sf_dir):
    """Path A: chunks; path B: entities of the same documents; counts of each kind."""
    from tempofact.operators.graph import question_entities
    from tempofact.plans.text import fn37_chunks

    a = fn37_chunks(spark, sf_dir).select("doc_id", F.lit("document_chunks").alias("kind"))
    b = table(spark, sf_dir, "documents").select("doc_id", F.explode(question_entities(F.col("text")))).select("doc_id", F.lit("entity").alias("kind"))
    return a.unionByName(b).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(f"WITH {M} SELECT id, content, category, array_to_string(tags, ';') AS tags, status FROM m WHERE user_id = 'u5' ORDER BY id LIMIT 5000")
def snk2_csv_rows(spark, sf_dir):
    m = memories(spark, sf_dir).where("user_id = 'u5'")
    return m.orderBy("id").limit(5000).select("id", "content", "category", F.concat_ws(";", "tags").alias("tags"), "status")


@query(f"WITH {M} SELECT 'memories' AS \"table\", count(*) AS n FROM m WHERE user_id = 'u4' UNION ALL SELECT 'events', count(*) FROM events WHERE user_id % 20 = 4")
def snk3_export(spark, sf_dir):
    tables = {"memories": memories(spark, sf_dir), "events": table(spark, sf_dir, "events").withColumn("user_id", F.concat(F.lit("u"), F.col("user_id") % 20))}
    return governance.export_user(tables, "u4").groupBy("table").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS benchmark, CASE WHEN event_type IN ('click', 'view') THEN 2 ELSE 1 END AS version FROM events GROUP BY 1 UNION ALL SELECT 'extra', 2")
def snk7_baseline(spark, sf_dir):
    old = table(spark, sf_dir, "events").select(F.col("event_type").alias("benchmark")).distinct().withColumn("version", F.lit(1))
    new = spark.sql("SELECT * FROM VALUES ('click', 2), ('view', 2), ('extra', 2) AS t(benchmark, version)")
    return dml.merge_latest(old, new, ["benchmark"])


@query("SELECT conv_id, count(*) AS messages, CAST(max(turn) AS BIGINT) AS last_turn, CASE WHEN conv_id % 4 = 0 THEN 'ended' ELSE 'active' END AS state FROM conversations GROUP BY conv_id")
def dm14_bump(spark, sf_dir):
    """Counters and last activity of sessions; only writable ones move from pending to active."""
    c = table(spark, sf_dir, "conversations")
    sessions = c.select("conv_id").distinct().withColumns({"state": F.when(F.col("conv_id") % 4 == 0, "ended").otherwise("pending"), "messages": F.lit(0)})
    seen = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last_turn"))
    j = sessions.join(seen, "conv_id", "left")
    return j.select("conv_id", (F.col("messages") + F.coalesce("n", F.lit(0))).cast("long").alias("messages"), "last_turn", F.when(F.col("state") == "pending", "active").otherwise(F.col("state")).alias("state"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 AND c_acctbal < 0 THEN 'deleted' ELSE 'active' END AS status FROM customer")
def dm17_soft_delete(spark, sf_dir):
    """The Inbox (every fifth project here) cannot be deleted."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5 == 0).alias("inbox"), "c_acctbal")
    return c.select("id", F.when(~F.col("inbox") & (F.col("c_acctbal") < 0), "deleted").otherwise("active").alias("status"))


@query()
def dm24_embed(spark, sf_dir):
    """Vectors of all active rows, by the hashing embedder, with the length guarded."""
    from tempofact.schemas import check_dimension
    from tempofact.sources.io import hashing_embedder

    m = memories(spark, sf_dir).where("status = 'active'")
    return check_dimension(m.select(F.col("id").alias("vec_id"), hashing_embedder(64)("content").alias("embedding")), "embedding", 64)


@query(f"WITH {M} SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN valid_from END, TIMESTAMP '{NOW}') = TIMESTAMP '{NOW}' AS stamped FROM m")
def snk4_insert(spark, sf_dir):
    m = memories(spark, sf_dir).withColumn("valid_from", F.when(F.col("id") % 2 == 0, F.col("valid_from")))
    return m.select("id", (F.coalesce("valid_from", ts(NOW)) == ts(NOW)).alias("stamped"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 99 ELSE label END AS label FROM embeddings UNION ALL SELECT max(vec_id) + 1, 99 FROM embeddings")
def snk5_upsert(spark, sf_dir):
    from tempofact.sources.io import upsert_vectors

    e = table(spark, sf_dir, "embeddings")
    fresh = e.groupBy().agg((F.max("vec_id") + 1).alias("vec_id")).withColumns({"embedding": F.array(F.lit(0.0)).cast("array<float>"), "label": F.lit(99)})
    return upsert_vectors(e, e.where("vec_id % 3 = 0").withColumn("label", F.lit(99)).unionByName(fresh)).select("vec_id", "label")


@query(r"""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, 'Authorization: Bearer [REDACTED] ' || props AS payload FROM events WHERE event_type = 'error'""")
def snk8_trace(spark, sf_dir):
    from tempofact.functions.text import redact

    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    raw = F.concat(F.lit("Authorization: Bearer abcdefgh"), "event_id", F.lit(" "), "props")
    return e.select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"), redact(raw).alias("payload"))


@query("""WITH t AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) SELECT conv_id * 100 + turn AS id, conv_id, turn FROM t WHERE role = 'user' AND r = 'assistant'""")
def snk9_episodes(spark, sf_dir):
    from tempofact.plans.bitemporal import rounds
    from tempofact.sources.io import checked_episodes

    return checked_episodes(rounds(spark, sf_dir).withColumn("id", F.col("conv_id") * 100 + F.col("turn"))).select("id", "conv_id", "turn")


@query(f"WITH {M} SELECT count(*) AS rows, count(q.id) AS with_queue FROM m LEFT JOIN (SELECT event_id AS id FROM events WHERE event_type = 'click') q ON q.id = m.id")
def jn1_left(spark, sf_dir):
    q = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("event_id").alias("id"), F.lit(1).alias("hit"))
    return memories(spark, sf_dir).select("id").join(q, "id", "left").agg(F.count(F.lit(1)).alias("rows"), F.count("hit").alias("with_queue"))
