"""Roles, quotas, exports and erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PERMISSIONS = {"admin": ("read", "write", "forget"), "writer": ("read", "write"), "reader": ("read",)}


def allowed(spark: SparkSession, roles: dict[str, bool]) -> DataFrame:
    """(role, perm) for role -> read_only; a read-only context loses write and forget."""
    rows = [(r, p) for r, ro in roles.items() for p in PERMISSIONS.get(r, ()) if p == "read" or not ro]
    return spark.createDataFrame(rows, "role string, perm string")


def usage(df: DataFrame, day: Column, time: str = "t_created") -> DataFrame:
    """Rows of each user, and those written on ``day``."""
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("memory_count"), F.count_if(F.to_date(time) == day).alias("writes_today"))


def maintained(counters: DataFrame, changes: DataFrame) -> DataFrame:
    """Counters (user_id, memory_count, writes_today, day) after ``changes`` (user_id, op, at): kept by deltas, facts are not read.

    An insert counts a fact and a write of its day; writes of an earlier day than the last are forgotten, so the counter starts
    anew with a day. A delete takes a fact off, never below 0; other operations (a supersession is an update) change nothing.
    Changes without a user are left out; users that had no counters get some.
    """
    new = changes.where("user_id IS NOT NULL AND op IN ('insert', 'delete')").withColumn("_d", F.when(F.col("op") == "insert", F.to_date("at")))
    by_day = new.groupBy("user_id", "_d").agg(F.count_if(F.col("op") == "insert").alias("_in"), F.count_if(F.col("op") == "delete").alias("_out"))
    delta = by_day.groupBy("user_id").agg(F.sum("_in").alias("_in"), F.sum("_out").alias("_out"), F.max(F.when(F.col("_d").isNotNull(), F.struct("_d", F.col("_in").alias("n")))).alias("_last"))
    j = counters.join(delta, "user_id", "full_outer")
    day = F.greatest("day", "_last._d")
    kept = F.when(F.col("day") == day, F.col("writes_today")).otherwise(0) + F.when(F.col("_last._d") == day, F.col("_last.n")).otherwise(0)
    count = F.coalesce("memory_count", F.lit(0)) + F.coalesce("_in", F.lit(0)) - F.coalesce("_out", F.lit(0))
    return j.select("user_id", F.greatest(F.lit(0), count).cast("long").alias("memory_count"), F.coalesce(kept, F.lit(0)).cast("long").alias("writes_today"), day.alias("day"))


def quota_check(used: DataFrame, limits: DataFrame) -> DataFrame:
    """user_id and exceeded: the first limit that is reached, or null. An absent limit never is."""
    j = used.join(limits, "user_id", "left")
    over = F.when(F.col("memory_count") >= F.col("max_memories"), "max_memories").when(F.col("writes_today") >= F.col("max_writes_per_day"), "max_writes_per_day")
    return j.select("user_id", over.alias("exceeded"), F.when(F.col("max_writes_per_day").isNotNull(), F.greatest(F.col("max_writes_per_day") - F.col("writes_today"), F.lit(0))).alias("remaining"))


def purge(tables: dict[str, DataFrame], users: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the users' rows, and an audit (table, user_id, rows) of what went."""
    kept = {n: df.join(users.select("user_id"), "user_id", "left_anti") for n, df in tables.items()}
    audit = None
    for n, df in tables.items():
        part = df.join(users.select("user_id"), "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "user_id", "rows")
        audit = part if audit is None else audit.unionByName(part)
    return kept, audit


def export_user(tables: dict[str, DataFrame], user: str, drop: tuple[str, ...] = ("embedding",)) -> DataFrame:
    """(table, json) for every row of a user, without embeddings."""
    out = None
    for n, df in tables.items():
        rows = df.where(F.col("user_id") == user).drop(*drop)
        part = rows.select(F.lit(n).alias("table"), F.to_json(F.struct(*rows.columns)).alias("json"))
        out = part if out is None else out.unionByName(part)
    return out
