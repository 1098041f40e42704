"""Stores, files and loaders: each query writes what a given table holds, and reads it back by the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tempofact.operators import bitemporal as b
from tempofact.registry import query
from tempofact.schemas import MEMORY, struct
from tempofact.session import shared_dir
from tempofact.sources import io, store
from tempofact.sources.fixtures import AS_OF, EDGES, M, NODES, graph_edges, graph_nodes, memories, table, ts
from tempofact.streaming import jobs

#: Turns of a session, and sessions of a sample, in the files written here: no row grows with its conversation.
TURNS, SESSIONS = 64, 10


def folder(spark, name):
    return f"{shared_dir(spark)}/tempofact/{name}-{uuid.uuid4().hex}"


def facts(spark, sf_dir):
    """memories in the types of the store."""
    return memories(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in struct(MEMORY)])


@query(f"""WITH {M} SELECT id FROM m WHERE namespace IN ('en', 'de') AND t_created <= TIMESTAMP '{AS_OF}' AND coalesce(t_expired, TIMESTAMP '9999-12-31') > TIMESTAMP '{AS_OF}'
  AND valid_from <= TIMESTAMP '{AS_OF}' AND TIMESTAMP '{AS_OF}' < coalesce(valid_until, TIMESTAMP '9999-12-31')""")
def ux1_as_of(spark, sf_dir):
    """Facts of two namespaces as of a day, from the store: folders by namespace, row groups by time."""
    path = folder(spark, "facts")
    store.append(facts(spark, sf_dir), path)
    columns = ["id", "namespace", "t_created", "t_expired", "valid_from", "valid_until"]
    return store.read(spark, path, columns=columns).where(F.col("namespace").isin("en", "de") & b.as_of(ts(AS_OF))).select("id")


@query(f"WITH {M} SELECT namespace, status, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM m GROUP BY 1, 2")
def ux1_stream(spark, sf_dir):
    """Two commits as a stream."""
    path, every = folder(spark, "facts"), facts(spark, sf_dir)
    for part in ("id % 2 = 0", "id % 2 <> 0 OR id IS NULL"):
        store.append(every.where(part), path)
    got = jobs.run_available(store.read_stream(spark, path, columns=["id", "namespace", "status"]))
    return got.groupBy("namespace", "status").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(f"WITH {EDGES}, {NODES} SELECT e.src, rel, m.display_name AS other, m.entity_type AS kind FROM edges e JOIN nodes m ON m.key = e.dst WHERE event_date >= '2024-01-10'")
def ux1_graph(spark, sf_dir):
    nodes, edges = folder(spark, "nodes"), folder(spark, "edges")
    store.append(graph_nodes(spark, sf_dir), nodes, "nodes")
    store.append(graph_edges(spark, sf_dir), edges, "edges")
    e = store.read(spark, edges, "edges").where("namespace = 'g' AND event_date >= '2024-01-10'")
    n = store.read(spark, nodes, "nodes").select(F.col("key").alias("dst"), "namespace", F.col("display_name").alias("other"), F.col("entity_type").alias("kind"))
    return e.join(n, ["dst", "namespace"]).select("src", "rel", "other", "kind")


@query("SELECT vec_id, len(embedding) AS size FROM embeddings WHERE label IN (1, 3) AND vec_id >= 100")
def ux1_vectors(spark, sf_dir):
    path = folder(spark, "vectors")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("namespace"), "embedding")
    store.append(e, path, "vectors")
    return store.read(spark, path, "vectors").where("namespace IN ('1', '3') AND vec_id >= 100").select("vec_id", F.array_size("embedding").alias("size"))


@query(f"WITH {M} SELECT CAST(id AS VARCHAR) AS id, length(content) AS n, category, array_to_string(tags, ';') AS tags, entity FROM m")
def snk1_export(spark, sf_dir):
    """What a JSON export holds, read back."""
    path = folder(spark, "export")
    io.export_json(facts(spark, sf_dir).withColumn("embedding", F.array(F.lit(0.0))), path)
    return spark.read.schema(io.IMPORT).json(path).select("id", F.length("content").cast("long").alias("n"), "category", F.concat_ws(";", "tags").alias("tags"), "entity")


@query(f"""WITH {M}, h AS (SELECT *, sha256(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) AS h FROM m WHERE content IS NOT NULL), one AS (SELECT min(CAST(id AS VARCHAR)) AS id, h FROM h GROUP BY h)
  SELECT id FROM one WHERE h NOT IN (SELECT sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) FROM documents WHERE lang = 'en' AND text IS NOT NULL)""")
def src7_import(spark, sf_dir):
    """Import of an export beside a store that has the texts of one language."""
    path, every = folder(spark, "export"), facts(spark, sf_dir)
    io.export_json(every, path)
    return io.import_json(spark, path, every.where("namespace = 'en'").select("content"), lines=True).select("id")


def sessions(spark, sf_dir):
    """(conv_id, k, turns): ``TURNS`` turns of a conversation, in order."""
    c = table(spark, sf_dir, "conversations").withColumn("k", F.floor(F.col("turn") / TURNS).cast("long"))
    return c.groupBy("conv_id", "k").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def samples(spark, sf_dir):
    """(conv_id, part, parts): up to ``SESSIONS`` sessions of a conversation, in order."""
    s = sessions(spark, sf_dir).withColumn("part", F.floor(F.col("k") / SESSIONS).cast("long"))
    return s.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("k", "turns"))).alias("parts"))


PLACES = f"p AS (SELECT conv_id, turn // {TURNS} AS k, row_number() OVER (PARTITION BY conv_id, turn // {TURNS} ORDER BY turn) - 1 AS pos, role, text FROM conversations)"


@query(f"WITH {PLACES} SELECT 'q' || conv_id || '-' || (k // {SESSIONS}) AS question_id, 's' || k AS session_id, pos AS turn, role, text AS content FROM p")
def src8_long_qa(spark, sf_dir):
    """Conversations as long-memory samples, one key for the speaker in even conversations, another in odd ones."""
    path = folder(spark, "long-qa")
    even = F.col("conv_id") % 2 == 0

    def turn(t):  # noqa: ANN001, ANN202
        return F.struct(F.when(even, t["role"]).alias("role"), F.when(~even, t["role"]).alias("speaker"), F.when(even, t["text"]).alias("content"), F.when(~even, t["text"]).alias("text"))

    rows = samples(spark, sf_dir).select(
        F.concat(F.lit("q"), "conv_id", F.lit("-"), "part").alias("question_id"), F.lit("?").alias("question"), F.lit("!").alias("answer"),
        F.transform("parts", lambda s: F.concat(F.lit("s"), s["k"])).alias("haystack_session_ids"), F.transform("parts", lambda s: F.transform(s["turns"], turn)).alias("haystack_sessions"),
    )
    rows.write.json(path)
    return io.long_qa(spark, path, lines=True).select("question_id", "session_id", F.col("turn").cast("long").alias("turn"), "role", "content")


@query(f"WITH {PLACES} SELECT conv_id || '-' || (k // {SESSIONS}) AS sample_id, k % {SESSIONS} + 1 AS session, pos AS turn, role AS speaker, text FROM p")
def src9_dialogue(spark, sf_dir):
    """Conversations as dialogue samples, sessions under numbered keys."""
    path = folder(spark, "dialogue")
    said = lambda s: F.transform(s["turns"], lambda t: F.struct(t["role"].alias("speaker"), t["text"].alias("text")))
    conversation = F.map_from_entries(F.transform("parts", lambda s: F.struct(F.concat(F.lit("session_"), s["k"] % SESSIONS + 1), said(s))))
    rows = samples(spark, sf_dir).select(F.struct(F.concat_ws("-", "conv_id", "part").alias("sample_id"), conversation.alias("conversation")).alias("s"))
    rows.select(F.to_json(F.array("s")).alias("value")).write.text(path)
    turns, _ = io.dialogue_qa(spark, path, lines=True)
    return turns.select("sample_id", F.col("session").cast("long").alias("session"), F.col("turn").cast("long").alias("turn"), "speaker", "text")


@query("""WITH q AS (SELECT doc_id, lang AS category, 0 AS pos, 'source?' AS question, [source, upper(source)] AS accepted FROM documents WHERE lang IN ('en', 'de') UNION ALL SELECT doc_id, lang, 1, 'language?', [lang] FROM documents WHERE lang IN ('en', 'de'))
  SELECT category, pos, question, array_to_string(accepted, '|') AS accepted, count(*) AS n FROM q GROUP BY ALL""")
def src10_examples(spark, sf_dir):
    """Documents as benchmark examples in a folder for each language; one category has no folder."""
    root = folder(spark, "examples")
    d = table(spark, sf_dir, "documents")
    rows = d.select("lang", F.col("text").alias("context"), F.array(F.lit("source?"), F.lit("language?")).alias("questions"), F.array(F.array("source", F.upper("source")), F.array("lang")).alias("answers"))
    rows.write.partitionBy("lang").parquet(root)
    found = io.example_questions(io.examples(spark, root, {"en": "lang=en", "de": "lang=de", "xx": "lang=xx"}))
    return found.groupBy("category", F.col("pos").cast("int").alias("pos"), "question", F.array_join("accepted", "|").alias("accepted")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT item_id AS id, length(text) AS n FROM benchmark")
def src11_cases(spark, sf_dir):
    """Benchmark items as a strict catalogue of cases."""
    path = folder(spark, "cases")
    table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question")).write.json(path)
    return io.read_cases(spark, path, "id bigint not null, question string").select("id", F.length("question").cast("long").alias("n"))


@query("SELECT event_type AS benchmark, max(value) AS \"primary\", count(*) AS total, CAST(count(DISTINCT user_id % 3) AS BIGINT) AS categories FROM events GROUP BY 1")
def src15_summaries(spark, sf_dir):
    """Summaries of event types, an object a file, and a file that can't be read."""
    path = folder(spark, "summaries")
    e = table(spark, sf_dir, "events").withColumn("c", F.concat(F.lit("c"), F.col("user_id") % 3))
    each = e.groupBy("event_type", "c").agg(F.max("value").alias("best"), F.count(F.lit(1)).alias("n"))
    rows = each.groupBy(F.col("event_type").alias("benchmark")).agg(F.max("best").alias("primary"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("c", "best"))).alias("per_category"))
    rows.write.option("maxRecordsPerFile", 1).json(path)
    rows.limit(1).select(F.lit("{broken").alias("value")).write.mode("append").text(path)
    return io.read_summaries(spark, f"{path}/part-*").select("benchmark", "primary", "total", F.size("per_category").cast("long").alias("categories"))


@query("""WITH g AS (SELECT source AS variant, lang AS category, CAST(max(n_chars) AS DOUBLE) AS best, CAST(count(*) AS INTEGER) AS n FROM documents GROUP BY 1, 2)
  SELECT sha, variant, category, CASE sha WHEN 'b' THEN 0 ELSE best END AS score, n FROM g, (VALUES ('a'), ('b')) r(sha)""")
def snk6_trend(spark, sf_dir):
    """Two runs appended to a trend file and read back; the scores of the second can't be read."""
    path = folder(spark, "trend")
    rows = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("variant"), F.col("lang").alias("category")).agg(F.max("n_chars").cast("string").alias("score"), F.count(F.lit(1)).alias("n"))
    for sha, score in (("a", F.col("score")), ("b", F.lit("n/a"))):
        io.append_trend(rows.select(F.lit("2024-01-01").alias("timestamp"), F.lit(sha).alias("sha"), "variant", "category", score.alias("score"), "n"), path)
    return io.read_trend(spark, path).select("sha", "variant", "category", "score", "n")
