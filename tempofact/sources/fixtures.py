"""Views of the test tables as the engine's own tables, and the same views in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempofact.functions.text import STOP_WORDS, SUFFIXES

EPOCH = "2024-01-01 00:00:00"
AS_OF = "2024-01-06 00:00:00"
NOW = "2024-02-01 00:00:00"


def ts(text: str) -> F.Column:
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as bi-temporal facts."""
    d = table(spark, sf_dir, "documents")
    return d.selectExpr(
        "doc_id AS id", "concat('u', doc_id % 20) AS user_id", "text AS content", "array(lang, source) AS tags", "source AS category",
        "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('Entity', doc_id % 11) END AS entity", "lang AS namespace", "0.5D + (doc_id % 50) / 100.0D AS confidence",
        "CASE WHEN doc_id % 5 = 0 THEN 'superseded' WHEN doc_id % 17 = 0 THEN 'archived' ELSE 'active' END AS status",
        f"TIMESTAMP_NTZ '{EPOCH}' + make_dt_interval(0, cast(doc_id % 240 AS int)) - make_dt_interval(cast(doc_id % 7 AS int)) AS valid_from",
        f"CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP_NTZ '{EPOCH}' + make_dt_interval(3, cast(doc_id % 240 AS int)) END AS valid_until",
        f"TIMESTAMP_NTZ '{EPOCH}' + make_dt_interval(0, cast(doc_id % 240 AS int)) AS t_created",
        f"CASE WHEN doc_id % 10 = 0 THEN TIMESTAMP_NTZ '{EPOCH}' + make_dt_interval(3, cast(doc_id % 240 AS int)) END AS t_expired",
        "CASE WHEN doc_id % 5 = 0 THEN doc_id + 1 WHEN doc_id % 5 = 1 AND doc_id % 3 = 0 THEN doc_id + 2 END AS superseded_by", "concat('a', doc_id % 3) AS agent_id",
        "CASE WHEN doc_id % 6 = 0 THEN 'private' ELSE 'team' END AS visibility", "cast(doc_id % 4 AS int) AS access_count",
        f"CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP_NTZ '{EPOCH}' + make_dt_interval(5, cast(doc_id % 100 AS int)) END AS last_accessed",
        "map('_namespace', lang, 'n', cast(n_chars AS string)) AS metadata", "n_chars",
    )


M = f"""m AS (SELECT doc_id AS id, 'u' || (doc_id % 20) AS user_id, text AS content, [lang, source] AS tags, source AS category,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Entity' || (doc_id % 11) END AS entity, lang AS namespace, 0.5 + CAST(doc_id % 50 AS DOUBLE) / 100 AS confidence,
  CASE WHEN doc_id % 5 = 0 THEN 'superseded' WHEN doc_id % 17 = 0 THEN 'archived' ELSE 'active' END AS status,
  TIMESTAMP '{EPOCH}' + to_hours(doc_id % 240) - to_days(CAST(doc_id % 7 AS INTEGER)) AS valid_from,
  CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '{EPOCH}' + to_hours(doc_id % 240) + to_days(3) END AS valid_until,
  TIMESTAMP '{EPOCH}' + to_hours(doc_id % 240) AS t_created,
  CASE WHEN doc_id % 10 = 0 THEN TIMESTAMP '{EPOCH}' + to_hours(doc_id % 240) + to_days(3) END AS t_expired,
  CASE WHEN doc_id % 5 = 0 THEN doc_id + 1 WHEN doc_id % 5 = 1 AND doc_id % 3 = 0 THEN doc_id + 2 END AS superseded_by, 'a' || (doc_id % 3) AS agent_id,
  CASE WHEN doc_id % 6 = 0 THEN 'private' ELSE 'team' END AS visibility, doc_id % 4 AS access_count,
  CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '{EPOCH}' + to_hours(doc_id % 100) + to_days(5) END AS last_accessed, n_chars
  FROM documents)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations with a time for each turn."""
    return table(spark, sf_dir, "conversations").withColumn("ts", F.expr(f"TIMESTAMP_NTZ '{EPOCH}' + make_dt_interval(0, cast(conv_id AS int), cast(turn AS int))"))


TURNS = f"t AS (SELECT conv_id, turn, role, text, TIMESTAMP '{EPOCH}' + to_hours(conv_id) + to_minutes(turn) AS ts FROM conversations)"


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nations, regions and suppliers as entities (namespace g)."""
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    parts = [
        n.selectExpr("lower(n_name) AS key", "n_name AS display_name", "'location' AS entity_type"),
        r.selectExpr("lower(r_name) AS key", "r_name AS display_name", "'region' AS entity_type"),
        s.selectExpr("lower(s_name) AS key", "s_name AS display_name", "'organization' AS entity_type"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("namespace", F.lit("g"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier LOCATED_IN nation PART_OF region."""
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    a = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("lower(s_name) AS src", "lower(n_name) AS dst", "'LOCATED_IN' AS rel", "cast(s_suppkey % 28 + 1 AS int) AS day")
    b = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("lower(n_name) AS src", "lower(r_name) AS dst", "'PART_OF' AS rel", "cast(n_nationkey % 28 + 1 AS int) AS day")
    return a.unionByName(b).select("src", "dst", "rel", F.lit("g").alias("namespace"), F.concat(F.lit("2024-01-"), F.lpad(F.col("day").cast("string"), 2, "0")).alias("event_date"))


NODES = """nodes AS (SELECT lower(n_name) AS key, n_name AS display_name, 'location' AS entity_type FROM nation
  UNION ALL SELECT lower(r_name), r_name, 'region' FROM region UNION ALL SELECT lower(s_name), s_name, 'organization' FROM supplier)"""
EDGES = """edges AS (SELECT lower(s_name) AS src, lower(n_name) AS dst, 'LOCATED_IN' AS rel, '2024-01-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') AS event_date FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT lower(n_name), lower(r_name), 'PART_OF', '2024-01-' || lpad(CAST(n_nationkey % 28 + 1 AS VARCHAR), 2, '0') FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def built_index(spark: SparkSession, sf_dir: str, *parts: str):  # noqa: ANN201
    """The index of the facts where the session has built these parts of it, else None: a few words are found sooner by a scan."""
    index, have = spark.__dict__.get("_tempofact_indexes", {}).get(sf_dir, (None, ()))
    return index if set(parts) <= {*have} else None


def keyword_index(spark: SparkSession, sf_dir: str, *parts: str):  # noqa: ANN201
    """The inverted index of the facts; each of its ``parts`` is built once a session and table: an index lives longer than a query."""
    from tempofact.operators import inverted

    index, have = spark.__dict__.setdefault("_tempofact_indexes", {}).get(sf_dir, (None, ()))
    if missing := [p for p in parts or inverted.PARTS if p not in have]:
        index = inverted.build(memories(spark, sf_dir).select("id", "content", "tags", "entity"), index and index.path, missing)
        spark._tempofact_indexes[sf_dir] = (index, (*have, *missing))
    return index


STEMS = "CASE " + " ".join(f"WHEN w LIKE '%{x}' AND length(w) - {len(x)} >= 4 THEN left(w, length(w) - {len(x)})" for x in SUFFIXES) + " ELSE w END"
LEXEMES = f"""lex AS (SELECT id, weight, pos, {STEMS} AS term FROM (SELECT id, unnest(range(1, len(x) + 1)) AS pos, unnest(x).weight AS weight, unnest(x).w AS w FROM (
  SELECT id, list_transform(list_filter(regexp_split_to_array(lower(coalesce(content, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: {{'weight': 'A', 'w': w}})
    || list_transform(list_filter(regexp_split_to_array(lower(array_to_string(tags, ' ')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: {{'weight': 'B', 'w': w}})
    || list_transform(list_filter(regexp_split_to_array(lower(coalesce(entity, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: {{'weight': 'C', 'w': w}}) AS x FROM m))
  WHERE w NOT IN ({', '.join(map(repr, STOP_WORDS))}))"""


def ann_index(spark: SparkSession, sf_dir: str):  # noqa: ANN201
    """The approximate index of all vectors, built once a session and table."""
    from tempofact.operators import ann

    built = spark.__dict__.setdefault("_tempofact_ann", {})
    if sf_dir not in built:
        built[sf_dir] = ann.build(table(spark, sf_dir, "embeddings"))
    return built[sf_dir]


def fact_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges entity SEEN_IN source of each namespace, dated by the first fact, and their nodes."""
    m = memories(spark, sf_dir).where("entity IS NOT NULL AND category IS NOT NULL AND namespace IS NOT NULL")
    edges = m.groupBy(F.lower("entity").alias("src"), F.lower("category").alias("dst"), "namespace").agg(F.date_format(F.min("t_created"), "yyyy-MM-dd").alias("event_date")).withColumn("rel", F.lit("SEEN_IN"))
    ends = m.select(F.col("entity").alias("display_name"), F.lit("concept").alias("entity_type"), "namespace").union(m.select("category", F.lit("source"), "namespace"))
    nodes = ends.groupBy(F.lower("display_name").alias("key"), "namespace").agg(F.min("display_name").alias("display_name"), F.min("entity_type").alias("entity_type"))
    return edges, nodes
