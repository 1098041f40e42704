"""Entity graph over nodes (key, namespace, display_name, entity_type) and edges (src, dst, rel, namespace, event_date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tempofact.session import cut


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by (key, namespace): a type is overwritten only where it is null or general."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    known = F.when(F.coalesce("entity_type", F.lit("general")) != "general", F.struct("_o", "entity_type"))
    return both.groupBy("key", "namespace").agg(F.min_by("display_name", "_o").alias("display_name"), F.coalesce(F.min(known)["entity_type"], F.lit("general")).alias("entity_type"))


def sanitize_rel(rel: Column) -> Column:
    clean = F.upper(F.regexp_replace(rel, r"[^A-Za-z0-9_]+", "_"))
    return F.when(F.coalesce(F.trim(rel), F.lit("")) == "", F.lit("RELATED_TO")).otherwise(clean)


def normalise_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s-]", " "), r"\s+", " "))


def upsert_edges(edges: DataFrame, keep: str) -> DataFrame:
    """One edge for each (src, dst, rel, event_date, namespace): the last by ``keep``."""
    keys = ["src", "dst", "rel", "event_date", "namespace"]
    rest = [c for c in edges.columns if c not in keys]
    return edges.groupBy(*keys).agg(*[F.max_by(c, keep).alias(c) for c in rest])


def undirected(edges: DataFrame) -> DataFrame:
    e = edges.select("namespace", "src", "dst", "rel", "event_date")
    return e.unionByName(e.select("namespace", F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "event_date"))


def hops(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(start, node, hop): the least number of undirected steps from each seed (key), up to ``depth``."""
    near = undirected(edges).select("src", "dst").distinct()
    front = seeds.select(F.col("key").alias("start"), F.col("key").alias("node"))
    out = front.withColumn("hop", F.lit(0))
    for k in range(1, depth + 1):
        front = front.join(near, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        out = out.unionByName(front.withColumn("hop", F.lit(k)))
    return out.groupBy("start", "node").agg(F.min("hop").alias("hop"))


def incident(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(subject, predicate, object, event_date): distinct triples at each seed, which is always the subject."""
    both = undirected(edges).join(seeds.select(F.col("key").alias("src")), "src", "left_semi")
    names = nodes.select(F.col("key").alias("dst"), F.col("display_name").alias("object"))
    return both.join(names, "dst").select(F.col("src").alias("subject"), F.col("rel").alias("predicate"), "object", "event_date").distinct()


def context_triples(triples: DataFrame, each: int = 30, most: int = 20) -> DataFrame:
    """The first ``each`` lines of a subject, distinct regardless of case, the first ``most`` overall."""
    line = F.concat_ws(" ", "subject", "predicate", "object", F.concat(F.lit("("), "event_date", F.lit(")")))
    w = W.partitionBy("subject").orderBy("predicate", "object", "event_date")
    some = triples.withColumns({"line": line, "rn": F.row_number().over(w)}).where(F.col("rn") <= each)
    return some.groupBy(F.lower("line").alias("k")).agg(F.min("line").alias("line")).orderBy("k").limit(most).select("line")


def known_edges(edges: DataFrame, front: DataFrame) -> DataFrame:
    """``front`` (query_id, namespace, day, node) beside the edges at its nodes, in both directions, of its namespace and known by its day.

    A null namespace or day is no bound; an edge without a date is always known.
    """
    e = undirected(edges).select(F.col("namespace").alias("_ns"), "src", "dst", "rel", "event_date")
    near = front.join(e, F.col("node") == F.col("src"))
    return near.where((F.col("namespace").isNull() | (F.col("_ns") == F.col("namespace"))) & (F.col("day").isNull() | F.col("event_date").isNull() | (F.col("event_date") <= F.col("day"))))


def hops_of(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(query_id, node, hop): the least steps from any seed (query_id, namespace, day, key) over the edges that its question may see."""
    front = seeds.select("query_id", "namespace", "day", F.col("key").alias("node"))
    out = front.select("query_id", "node", F.lit(0).alias("hop"))
    for k in range(1, depth + 1):
        front = known_edges(edges, front).select("query_id", "namespace", "day", F.col("dst").alias("node")).distinct()
        out = out.unionByName(front.select("query_id", "node", F.lit(k).alias("hop")))
    return out.groupBy("query_id", "node").agg(F.min("hop").alias("hop"))


def triples_of(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, subject, predicate, object, event_date): distinct triples at each seed; nodes are those of the edge's namespace."""
    at = known_edges(edges, seeds.select("query_id", "namespace", "day", F.col("key").alias("node"))).select("query_id", "_ns", "src", "dst", "rel", "event_date")
    names = nodes.select(F.col("key").alias("dst"), F.col("namespace").alias("_ns"), F.col("display_name").alias("object"))
    return at.join(names, ["dst", "_ns"]).select("query_id", F.col("src").alias("subject"), F.col("rel").alias("predicate"), "object", "event_date").distinct()


def context_lines(triples: DataFrame, each: int = 30, most: int = 20) -> DataFrame:
    """(query_id, line): as ``context_triples`` for each question."""
    line = F.concat_ws(" ", "subject", "predicate", "object", F.concat(F.lit("("), "event_date", F.lit(")")))
    w = W.partitionBy("query_id", "subject").orderBy("predicate", "object", "event_date")
    some = triples.withColumns({"line": line, "rn": F.row_number().over(w)}).where(F.col("rn") <= each)
    once = some.groupBy("query_id", F.lower("line").alias("k")).agg(F.min("line").alias("line"))
    return once.withColumn("rn", F.row_number().over(W.partitionBy("query_id").orderBy("k"))).where(F.col("rn") <= most).select("query_id", "line")


def subgraph(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` of a seed, and the directed edges among them."""
    near = hops(edges, seeds, depth).select(F.col("node").alias("key")).distinct()
    inside = edges.join(near.select(F.col("key").alias("src")), "src", "left_semi").join(near.select(F.col("key").alias("dst")), "dst", "left_semi")
    return nodes.join(near, "key", "left_semi"), inside


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 20, every: int = 5, still: float = 1e-12) -> DataFrame:
    """(key, rank) after ``rounds`` unnormalised rounds, or where a round moved no rank by more than ``still``.

    Lineage is cut to shared storage every few rounds, and there the last move is looked at.
    """
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    links = cut(edges.select("src", "dst").join(out, "src"), "pagerank-links")
    ranks = nodes.select("key", F.lit(1 - damping).alias("rank"), F.lit(None).cast("double").alias("before"))
    for i in range(rounds):
        gets = links.join(ranks.select(F.col("key").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("key")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        ranks = ranks.select("key", F.col("rank").alias("before")).join(gets, "key", "left").select("key", (F.lit(1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), "before")
        if (i + 1) % every == 0:
            ranks = cut(ranks, "pagerank")
            if (ranks.agg(F.max(F.abs(F.col("rank") - F.col("before")))).first()[0] or 0.0) <= still:
                break
    return ranks.select("key", "rank")


def dump(edges: DataFrame, nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    """(kind, key, other, label, rank): all ``nodes`` with their ranks, and the edges that have both ends among them.

    A node without a rank has a null one; ends are matched within their namespace.
    """
    n = nodes.join(ranks, "key", "left").select(F.lit("node").alias("kind"), "key", F.col("display_name").alias("other"), F.col("entity_type").alias("label"), "rank")
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("key").alias(end), "namespace"), [end, "namespace"], "left_semi")
    return n.unionAll(edges.select(F.lit("edge"), "src", "dst", "rel", F.lit(None).cast("double")))


TOOLS = ("python", "spark", "docker", "kafka", "postgres", "redis")
RELATIONS = (
    (r"(?i)\bworks? (?:at|for) ([^.\n]+)", "WORKS_AT"), (r"(?i)\blives? in ([^.\n]+)", "LIVES_IN"), (r"(?i)\buses? ([^.\n]+)", "USES"),
    (r"(?i)\bprefers? ([^.\n]+)", "PREFERS"), (r"(?i)\bknows? ([^.\n]+)", "KNOWS"), (r"(?i)\bdepends? on ([^.\n]+)", "DEPENDS_ON"),
)


def guess_type(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.isin(list(TOOLS)), "tool").when(low.rlike(r"(corp|inc|ltd|gmbh|llc)\.?$"), "organization").otherwise("concept")


def relations(text: Column) -> Column:
    """array of (rel, target): of each pattern the first match, up to a comma, 2 to 49 characters."""
    found = []
    for pattern, rel in RELATIONS:
        target = F.trim(F.substring_index(F.regexp_extract(text, pattern, 1), ",", 1))
        found.append(F.struct(F.lit(rel).alias("rel"), target.alias("target")))
    return F.filter(F.array(*found), lambda r: (F.length(r["target"]) > 1) & (F.length(r["target"]) < 50))


def question_entities(question: Column) -> Column:
    """Capitalised words, one possessive suffix off, in order, distinct."""
    raw = F.regexp_extract_all(question, F.lit(r"\b([A-Z][\p{L}\p{N}]+(?:'s)?)"), F.lit(1))
    return F.array_distinct(F.transform(raw, lambda w: F.regexp_replace(w, r"'s$", "")))
