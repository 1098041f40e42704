"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempofact.operators import graph as g
from tempofact.registry import query
from tempofact.sources.fixtures import EDGES, NODES, graph_edges, graph_nodes, table

BOTH = "both_ways AS (SELECT src, dst, rel, event_date FROM edges UNION ALL SELECT dst, src, rel, event_date FROM edges)"


def seeds(spark, sf_dir):
    return table(spark, sf_dir, "nation").where("n_nationkey IN (3, 7)").select(F.lower("n_name").alias("key"))


SEEDS = "seeds AS (SELECT lower(n_name) AS key FROM nation WHERE n_nationkey IN (3, 7))"


@query(f"WITH {NODES} SELECT entity_type, count(*) AS n FROM nodes GROUP BY 1")
def src12_entities(spark, sf_dir):
    return graph_nodes(spark, sf_dir).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NODES}, {EDGES} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, entity_type, count(*) AS n FROM nodes GROUP BY entity_type")
def ag3_graph_stats(spark, sf_dir):
    types = graph_nodes(spark, sf_dir).groupBy(F.coalesce("entity_type", F.lit("general")).alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))
    total = types.agg(F.sum("n").alias("nodes")).withColumn("k", F.lit(1))
    edges = graph_edges(spark, sf_dir).agg(F.count(F.lit(1)).alias("edges")).withColumn("k", F.lit(1))
    return types.withColumn("k", F.lit(1)).join(total, "k").join(edges, "k").select("nodes", "edges", "entity_type", "n")


@query(f"WITH {EDGES}, {NODES}, {BOTH} SELECT DISTINCT n.display_name AS name, rel, m.display_name AS other FROM both_ways b JOIN nodes n ON n.key = b.src JOIN nodes m ON m.key = b.dst")
def jn13_endpoints(spark, sf_dir):
    e = g.undirected(graph_edges(spark, sf_dir))
    n = graph_nodes(spark, sf_dir)
    a = n.select(F.col("key").alias("src"), F.col("display_name").alias("name"), "namespace")
    b = n.select(F.col("key").alias("dst"), F.col("display_name").alias("other"), "namespace")
    return e.join(a, ["src", "namespace"]).join(b, ["dst", "namespace"]).select("name", "rel", "other").distinct()


TEXTS = "x AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Customer works at ' || c_mktsegment || ' Corp, since 2020' WHEN 1 THEN 'lives in ' || c_mktsegment || '. uses Spark' WHEN 2 THEN 'prefers ' || lower(c_mktsegment) ELSE c_name END AS text FROM customer)"


def customer_texts(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        "CASE c_custkey % 4 WHEN 0 THEN concat('Customer works at ', c_mktsegment, ' Corp, since 2020') WHEN 1 THEN concat('lives in ', c_mktsegment, '. uses Spark') WHEN 2 THEN concat('prefers ', lower(c_mktsegment)) ELSE c_name END AS text",
    )


@query(f"""WITH {TEXTS}, p(pattern, rel) AS (VALUES ('(?i)\\bworks? (?:at|for) ([^.\\n]+)', 'WORKS_AT'), ('(?i)\\blives? in ([^.\\n]+)', 'LIVES_IN'), ('(?i)\\buses? ([^.\\n]+)', 'USES'), ('(?i)\\bprefers? ([^.\\n]+)', 'PREFERS')),
  y AS (SELECT id, rel, trim(split_part(regexp_extract(text, pattern, 1), ',', 1)) AS target FROM x, p) SELECT id, rel, target FROM y WHERE length(target) > 1 AND length(target) < 50""")
def gr1_relations(spark, sf_dir):
    return customer_texts(spark, sf_dir).select("id", F.explode(g.relations(F.col("text"))).alias("r")).select("id", "r.rel", "r.target")


@query("WITH n AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Spark' WHEN 1 THEN p_brand || ' Corp.' WHEN 2 THEN p_name || ' Incorporated' ELSE p_name END AS name FROM part) SELECT id, CASE WHEN lower(name) IN ('python', 'spark', 'docker', 'kafka', 'postgres', 'redis') THEN 'tool' WHEN regexp_matches(lower(name), '(corp|inc|ltd|gmbh|llc)\\.?$') THEN 'organization' ELSE 'concept' END AS kind FROM n")
def gr2_types(spark, sf_dir):
    nth = F.col("p_partkey") % 4
    name = F.when(nth == 0, "Spark").when(nth == 1, F.concat("p_brand", F.lit(" Corp."))).when(nth == 2, F.concat("p_name", F.lit(" Incorporated"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), g.guess_type(name).alias("kind"))


@query("""WITH o AS (SELECT lower(n_name) AS key, n_name AS display_name, CASE WHEN n_nationkey % 2 = 0 THEN 'general' ELSE 'location' END AS entity_type, 0 AS o FROM nation UNION ALL
  SELECT lower(n_name), upper(n_name), 'country', 1 FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT lower(r_name), r_name, NULL, 1 FROM region)
  SELECT key, arg_min(display_name, o) AS display_name, coalesce(arg_min(entity_type, o) FILTER (coalesce(entity_type, 'general') <> 'general'), 'general') AS entity_type FROM o GROUP BY key""")
def gr3_nodes(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    old = n.selectExpr("lower(n_name) AS key", "'g' AS namespace", "n_name AS display_name", "CASE WHEN n_nationkey % 2 = 0 THEN 'general' ELSE 'location' END AS entity_type")
    new = n.where("n_nationkey % 3 = 0").selectExpr("lower(n_name) AS key", "'g' AS namespace", "upper(n_name) AS display_name", "'country' AS entity_type")
    new = new.unionByName(r.selectExpr("lower(r_name) AS key", "'g' AS namespace", "r_name AS display_name", "cast(NULL AS string) AS entity_type"))
    return g.upsert_nodes(old, new).select("key", "display_name", "entity_type")


@query("SELECT l_suppkey AS src, l_partkey % 50 AS dst, 'SHIP_' || upper(l_linestatus) AS rel, strftime(l_shipdate, '%Y-%m') AS event_date, max(l_orderkey) AS orderkey FROM lineitem GROUP BY ALL")
def gr4_edges(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"), g.sanitize_rel(F.concat(F.lit("ship "), "l_linestatus")).alias("rel"),
        F.date_format("l_shipdate", "yyyy-MM").alias("event_date"), F.lit("g").alias("namespace"), F.col("l_orderkey").alias("orderkey"))
    return g.upsert_edges(e, "orderkey").drop("namespace")


REACH = f"""{BOTH}, near AS (SELECT DISTINCT src, dst FROM both_ways), h AS (SELECT key AS start, key AS node, 0 AS hop FROM seeds UNION ALL SELECT s.key, a.dst, 1 FROM seeds s JOIN near a ON a.src = s.key
  UNION ALL SELECT s.key, b.dst, 2 FROM seeds s JOIN near a ON a.src = s.key JOIN near b ON b.src = a.dst), hm AS (SELECT start, node, min(hop) AS hop FROM h GROUP BY 1, 2)"""


@query(f"WITH {EDGES}, {NODES}, {SEEDS}, {REACH} SELECT DISTINCT start, display_name AS name FROM hm JOIN nodes ON key = node WHERE hop > 0")
def gr5_bfs(spark, sf_dir):
    h = g.hops(graph_edges(spark, sf_dir), seeds(spark, sf_dir)).where("hop > 0")
    return h.join(graph_nodes(spark, sf_dir).withColumnRenamed("key", "node"), "node").select("start", F.col("display_name").alias("name")).distinct()


@query(f"WITH {EDGES}, {SEEDS}, {REACH} SELECT node, CAST(min(hop) AS BIGINT) AS hop FROM hm GROUP BY node")
def gr6_hop_map(spark, sf_dir):
    return g.hops(graph_edges(spark, sf_dir), seeds(spark, sf_dir)).groupBy("node").agg(F.min("hop").cast("long").alias("hop"))


TRIPLES = f"{BOTH}, tr AS (SELECT DISTINCT b.src AS subject, rel AS predicate, display_name AS object, event_date FROM both_ways b JOIN nodes ON key = b.dst WHERE b.src IN (SELECT key FROM seeds))"


@query(f"WITH {EDGES}, {NODES}, {SEEDS}, {TRIPLES} SELECT * FROM tr")
def gr7_incident(spark, sf_dir):
    return g.incident(graph_edges(spark, sf_dir), graph_nodes(spark, sf_dir), seeds(spark, sf_dir))


LINES = "ln AS (SELECT subject || ' ' || predicate || ' ' || object || ' (' || event_date || ')' AS line, row_number() OVER (PARTITION BY subject ORDER BY predicate, object, event_date) AS rn FROM tr)"


@query(f"WITH {EDGES}, {NODES}, {SEEDS}, {TRIPLES}, {LINES} SELECT min(line) AS line FROM ln WHERE rn <= 30 GROUP BY lower(line) ORDER BY lower(line) LIMIT 20")
def gr8_triples(spark, sf_dir):
    return g.context_triples(g.incident(graph_edges(spark, sf_dir), graph_nodes(spark, sf_dir), seeds(spark, sf_dir)))


@query(f"WITH {EDGES}, {NODES}, {SEEDS}, {TRIPLES}, {LINES} SELECT line AS content, CAST(0.6 AS DOUBLE) AS score, 'graph' AS match_source FROM (SELECT min(line) AS line FROM ln WHERE rn <= 30 GROUP BY lower(line) ORDER BY lower(line) LIMIT 20)")
def st9_triples(spark, sf_dir):
    return gr8_triples(spark, sf_dir).select(F.col("line").alias("content"), F.lit(0.6).alias("score"), F.lit("graph").alias("match_source"))


@query(f"WITH {EDGES}, {SEEDS}, {REACH} SELECT src, dst, rel FROM edges WHERE src IN (SELECT node FROM hm WHERE hop <= 1) AND dst IN (SELECT node FROM hm WHERE hop <= 1)")
def gr9_subgraph(spark, sf_dir):
    return g.subgraph(graph_edges(spark, sf_dir), graph_nodes(spark, sf_dir), seeds(spark, sf_dir), 1)[1].select("src", "dst", "rel")


# Ranks are settled after two rounds on this graph, whose paths have at most two edges.
PR = """deg AS (SELECT src, count(*) AS degree FROM edges GROUP BY src),
  r1 AS (SELECT key, 0.15 + 0.85 * coalesce(sum(0.15 / degree), 0) AS rank FROM nodes LEFT JOIN (SELECT dst, degree FROM edges JOIN deg USING (src)) e ON key = dst GROUP BY key),
  r2 AS (SELECT n.key AS key, 0.15 + 0.85 * coalesce(sum(rank / degree), 0) AS rank FROM nodes n LEFT JOIN (SELECT dst, src, degree FROM edges JOIN deg USING (src)) e ON n.key = dst LEFT JOIN r1 ON r1.key = e.src GROUP BY n.key)"""


@query(f"WITH {EDGES}, {NODES}, {PR} SELECT key, round(CAST(rank AS DOUBLE), 6) AS rank FROM r2")
def gr10_pagerank(spark, sf_dir):
    return g.pagerank(graph_edges(spark, sf_dir), graph_nodes(spark, sf_dir)).select("key", F.round("rank", 6).alias("rank"))


@query(f"WITH {EDGES}, {NODES}, {PR} SELECT n_nationkey AS id, round(CAST(0.5 + 0.3 * rank AS DOUBLE), 6) AS score FROM nation JOIN r2 ON key = lower(n_name)")
def sc6_pagerank_boost(spark, sf_dir):
    pr = g.pagerank(graph_edges(spark, sf_dir), graph_nodes(spark, sf_dir), rounds=5)
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("key"))
    return n.join(pr, "key", "left").select("id", F.round(0.5 + 0.3 * F.coalesce("rank", F.lit(0.0)), 6).alias("score"))


@query(f"WITH {EDGES}, {NODES}, {SEEDS}, {TRIPLES}, {LINES} SELECT line FROM ln WHERE rn <= 10 ORDER BY line LIMIT 30")
def gr11_context(spark, sf_dir):
    tr = g.incident(graph_edges(spark, sf_dir), graph_nodes(spark, sf_dir), seeds(spark, sf_dir))
    return g.context_triples(tr, each=10, most=30).orderBy("line")


@query(f"WITH {EDGES}, {NODES} SELECT src, rel, dst FROM edges WHERE src IN (SELECT key FROM nodes WHERE entity_type <> 'organization') AND dst IN (SELECT key FROM nodes WHERE entity_type <> 'organization')")
def gr12_dump(spark, sf_dir):
    keys = graph_nodes(spark, sf_dir).where("entity_type <> 'organization'").select("key")
    e = graph_edges(spark, sf_dir)
    return e.join(keys.withColumnRenamed("key", "src"), "src", "left_semi").join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi").select("src", "rel", "dst")


@query(f"""WITH {EDGES}, {NODES}, {PR}, kept AS (SELECT * FROM nodes WHERE entity_type <> 'region') SELECT 'node' AS kind, key, display_name AS other, entity_type AS label, round(CAST(rank AS DOUBLE), 6) AS rank FROM kept JOIN r2 USING (key)
  UNION ALL SELECT 'edge', src, dst, rel, NULL FROM edges WHERE src IN (SELECT key FROM kept) AND dst IN (SELECT key FROM kept)""")
def gr12_full(spark, sf_dir):
    """Nodes with their ranks in the whole graph, and the edges among them."""
    e, n = graph_edges(spark, sf_dir), graph_nodes(spark, sf_dir)
    return g.dump(e, n.where("entity_type <> 'region'"), g.pagerank(e, n)).withColumn("rank", F.round("rank", 6))


@query("SELECT item_id, array_to_string(list_distinct_ordered, ',') AS entities FROM (SELECT item_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (SELECT item_id, regexp_extract_all(text, '\\b([A-Z][\\p{L}\\p{N}]+)', 1) AS l FROM benchmark))")
def gr13_entities(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(g.question_entities(F.col("text")), ",").alias("entities"))
