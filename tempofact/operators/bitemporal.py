"""Predicates and joins over facts with event time [valid_from, valid_until) and transaction time [t_created, t_expired)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tempofact.operators.groups import beside, with_group
from tempofact.session import cut


def open_end(c: str) -> Column:
    return F.coalesce(F.col(c), F.expr("TIMESTAMP_NTZ '9999-12-31 00:00:00'"))


def as_of(at: Column) -> Column:
    """Known at ``at`` and true at ``at``; half-open in both times."""
    return (F.col("t_created") <= at) & (open_end("t_expired") > at) & (F.col("valid_from") <= at) & (open_end("valid_until") > at)


def overlaps(start: Column | None, end: Column | None) -> Column:
    """Event time meets [start, end); an absent bound is open; empty windows and rows with reversed bounds meet nothing."""
    p = F.col("valid_from") < open_end("valid_until")
    if end is not None:
        p = p & (F.col("valid_from") < end)
    if start is not None:
        p = p & (open_end("valid_until") > start)
    if start is not None and end is not None:
        p = p & (start < end)
    return p


def current() -> Column:
    return (F.col("status") == "active") & F.col("valid_until").isNull()


def visible_to(agent: str | None) -> Column:
    return F.lit(True) if agent is None else (F.col("visibility") != "private") | (F.col("agent_id") == agent)


def in_namespace(ns: str | None) -> Column:
    return F.lit(True) if ns is None else F.coalesce(F.col("metadata")["_namespace"], F.lit("default")) == ns


class TenantView:
    """Rows of one user; nothing at all without a user."""

    def __init__(self, df: DataFrame, user_id: str | None):
        self.df, self.user_id = df, user_id

    def rows(self) -> DataFrame:
        return self.df.where(F.lit(False) if self.user_id is None else F.col("user_id") == self.user_id)

    def checked(self, new: DataFrame) -> DataFrame:
        """``new`` for a write; the job fails at a row of another user."""
        mine = F.lit(self.user_id).cast("string")
        return new.withColumn("user_id", F.when(F.col("user_id") == mine, F.col("user_id")).otherwise(F.raise_error(F.lit("row of another user"))))


def scan(
    df: DataFrame, status: str | None = None, category: str | None = None, entity: str | None = None, namespace: str | None = None,
    after: Column | None = None, before: Column | None = None, agent: str | None = None, limit: int | None = 100,
) -> DataFrame:
    """Filtered list, newest first; both time bounds inclusive."""
    for name, value in (("status", status), ("category", category), ("entity", entity)):
        if value is not None:
            df = df.where(F.col(name) == value)
    df = df.where(in_namespace(namespace) & visible_to(agent))
    if after is not None:
        df = df.where(F.col("t_created") >= after)
    if before is not None:
        df = df.where(F.col("t_created") <= before)
    df = df.orderBy(F.desc("t_created"), "id")
    return df if limit is None else df.limit(limit)


def tagged(df: DataFrame, tags: list[str], limit: int = 20) -> DataFrame:
    """Current facts that share a tag."""
    return df.where(current() & F.arrays_overlap("tags", F.array(*map(F.lit, tags)))).orderBy(F.desc("t_created"), "id").limit(limit)


def content_hash(c: str) -> Column:
    return F.sha2(F.regexp_replace(F.col(c), r"^\s+|\s+$", "").cast("binary"), 256)


def timeline(df: DataFrame, event: str = "valid_from") -> DataFrame:
    return df.orderBy(F.coalesce(F.col(event), F.col("t_created")), "id")


def as_of_join(points: DataFrame, facts: DataFrame, keys: list[str], at: str = "at", since: str = "valid_from") -> DataFrame:
    """For each point the latest fact of its keys that began at or before it; points without one are kept.

    Both sides are dealt out in ranges of (keys, time) and written once. The last fact is carried forward within a range, and
    over a border by what the ranges before it end with: no pair is built, and no task needs all rows of a key.
    """
    body = [c for c in facts.columns if c not in keys]
    left = points.withColumns({"_t": F.col(at), "_p": F.lit(1), "_f": F.lit(None).cast(facts.select(F.struct(*body).alias("s")).schema["s"].dataType)})
    right = facts.select(*keys, *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c not in keys], F.col(since).alias("_t"), F.lit(0).alias("_p"), F.struct(*body).alias("_f"))
    both = cut(left.unionByName(right).repartitionByRange(*keys, "_t", "_p").withColumn("_r", F.spark_partition_id()), "as-of-ranges")
    inside = W.partitionBy(*keys, "_r").orderBy("_t", "_p").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = both.withColumn("_m", F.last("_f", ignorenulls=True).over(inside)).where("_p = 1")
    ends = both.groupBy(*keys, "_r").agg(F.max_by("_f", F.when(F.col("_p") == 0, F.col("_t"))).alias("_f"))  # a row a key and range
    before = F.last("_f", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_r").rowsBetween(W.unboundedPreceding, -1))
    carried = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_r").alias("_s"), before.alias("_c")).where("_c IS NOT NULL")
    on = reduce(lambda p, i: p & F.col(keys[i]).eqNullSafe(F.col(f"_k{i}")), range(len(keys)), F.col("_r") == F.col("_s"))
    known = F.coalesce("_m", "_c")
    return rows.join(carried, on, "left").select(*points.columns, *[known[c].alias(f"fact_{c}") for c in body])


def versions(df: DataFrame, keys: list[str], since: str = "valid_from", tie: str = "id") -> DataFrame:
    """Close each version where the next of its key begins."""
    w = W.partitionBy(*keys).orderBy(since, tie)
    return df.withColumns({"version": F.row_number().over(w), "next_from": F.lead(since).over(w)})


def supersede(df: DataFrame, pairs: DataFrame, at: Column, faithful: bool = False) -> DataFrame:
    """Mark ``pairs`` (id, new_id): status, valid_until, superseded_by, and t_expired unless ``faithful``."""
    j = df.join(pairs.select("id", "new_id"), "id", "left")
    hit = F.col("new_id").isNotNull()
    cols = {"status": F.when(hit, "superseded").otherwise(F.col("status")), "valid_until": F.when(hit, at).otherwise(F.col("valid_until")), "superseded_by": F.when(hit, F.col("new_id")).otherwise(F.col("superseded_by"))}
    if not faithful:
        cols["t_expired"] = F.when(hit, at).otherwise(F.col("t_expired"))
    return j.withColumns(cols).drop("new_id")


def chain(df: DataFrame, start: DataFrame, depth: int = 20) -> DataFrame:
    """(start, step, id): follow superseded_by until null, a missing row, a row seen before or ``depth`` steps.

    By pointer doubling: the rows of the first 2^k steps and the table of jumps over 2^k rows give twice as many, so a chain takes
    log(depth) joins. A row that comes again in a cycle keeps its first step.
    """
    ids = df.select("id")
    jump = cut(df.where("superseded_by IS NOT NULL").select("id", "superseded_by").join(ids.withColumnRenamed("id", "superseded_by"), "superseded_by", "left_semi").select("id", F.col("superseded_by").alias("to")).distinct(), "jumps")
    out = start.join(ids, "id", "left_semi").select(F.col("id").alias("start"), F.lit(0).alias("step"), "id")
    far = 1
    while far <= depth:
        on = out.join(jump, "id").where(F.col("step") + far <= depth).select("start", (F.col("step") + far).alias("step"), F.col("to").alias("id"))
        out = cut(out.unionByName(on), "chains")
        if 2 * far <= depth:
            jump = cut(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("then")), "to").select("id", F.col("then").alias("to")), "jumps")
            if jump.isEmpty():
                break
        far *= 2
    return out.groupBy("start", "id").agg(F.min("step").alias("step")).select("start", "step", "id")


def predecessors(df: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, predecessor) for rows that name ``id`` as their successor."""
    return df.select(F.col("id").alias("predecessor"), F.col("superseded_by").alias("id")).join(ids.select("id"), "id", "left_semi")


def contradictions_by_entity(new: DataFrame, old: DataFrame) -> DataFrame:
    """(new_id, links, old_id) for new facts that contradict current ones: how many, and the least of them.

    A contradiction has the same entity, category and namespace and another trimmed text, so no pair is built: the links
    are the group's facts less those of the same text, and the least is the group's least, or the least of another text
    than that one's. Counts of a group return to its rows by (key, salt).
    """
    key = ["entity", "category", "namespace"]
    text = F.sha2(F.regexp_replace("content", r"^\s+|\s+$", "").cast("binary"), 256)
    known = reduce(lambda p, k: p & F.col(k).isNotNull(), key[1:], F.col(key[0]).isNotNull())
    facts = old.where(current() & known).select(*key, "id", text.alias("h")).groupBy(*key, "h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    groups = with_group(facts, key, "h", F.sum("n").alias("all"), F.min(F.struct("id", "h")).alias("first"))
    groups = groups.groupBy(*key).agg(F.first("all").alias("all"), F.first("first").alias("first"), F.min(F.when(F.col("h") != F.col("first.h"), F.col("id"))).alias("second"))
    rows = new.where(known).select(*key, F.col("id").alias("new_id"), text.alias("h"))
    j = beside(rows, key, "new_id", groups).join(facts.select(*key, "h", "n"), [*key, "h"], "left")
    links = F.col("all") - F.coalesce("n", F.lit(0))
    return j.select("new_id", links.alias("links"), F.when(F.col("h") == F.col("first.h"), F.col("second")).otherwise(F.col("first.id")).alias("old_id")).where("links > 0")
