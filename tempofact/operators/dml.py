"""State changes as plans: each takes the current table and returns the next one. A single writer applies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tempofact.operators.bitemporal import content_hash
from tempofact.session import cut

UPDATABLE = ("content", "tags", "category", "entity", "valid_from", "valid_until", "superseded_by", "confidence", "status", "metadata")


def new_rows(df: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` whose trimmed text neither the active table nor an earlier row of the batch has."""
    have = df.where("status = 'active'").select(content_hash("content").alias("_h"), "namespace").distinct()
    once = batch.withColumn("_h", content_hash("content")).withColumn("_n", F.row_number().over(W.partitionBy("_h", "namespace").orderBy("id")))
    return once.where("_n = 1").join(have, ["_h", "namespace"], "left_anti").drop("_h", "_n").select(*batch.columns)


def update(df: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Overwrite the updatable columns that ``changes`` has, where they are not null there."""
    cols = [c for c in changes.columns if c in UPDATABLE]
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    j = df.join(new, key, "left")
    return j.select(*[F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in df.columns])


def delete(df: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """The rest, and how many rows went."""
    return df.where(~F.coalesce(gone, F.lit(False))), df.agg(F.count_if(gone).alias("deleted"))


def forget(df: DataFrame, which: Column) -> DataFrame:
    return df.withColumn("status", F.when(which & (F.col("status") == "active"), "archived").otherwise(F.col("status")))


def apply_decisions(df: DataFrame, decisions: DataFrame, at: Column, metadata: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """decisions (new_id, op, target, content, category, entity, confidence) to the next table and a log.

    ADD inserts; UPDATE overwrites its target and keeps the larger confidence; INVALIDATE inserts and supersedes its
    target; NOOP does nothing; an UPDATE or INVALIDATE without a living target is an ERROR in the log.
    """
    live = df.select(F.col("id").alias("target")).distinct().withColumn("_found", F.lit(True))
    d = decisions.join(live, "target", "left")
    op = F.when(F.col("op").isin("UPDATE", "INVALIDATE") & F.col("_found").isNull(), "ERROR").otherwise(F.col("op"))
    d = d.withColumn("op", op).drop("_found")
    change = d.where("op IN ('UPDATE', 'INVALIDATE')").withColumn("_n", F.row_number().over(W.partitionBy("target").orderBy(F.desc("new_id")))).where("_n = 1")
    c = change.select(F.col("target").alias("id"), F.col("op").alias("_op"), F.col("new_id").alias("_new"), F.col("content").alias("_content"), F.col("confidence").alias("_confidence"))
    upd, inv = F.col("_op") == "UPDATE", F.col("_op") == "INVALIDATE"
    next_df = df.join(c, "id", "left").withColumns({
        "content": F.when(upd, F.col("_content")).otherwise(F.col("content")), "confidence": F.when(upd, F.greatest("confidence", "_confidence")).otherwise(F.col("confidence")),
        "status": F.when(inv, "superseded").otherwise(F.col("status")), "superseded_by": F.when(inv, F.col("_new")).otherwise(F.col("superseded_by")),
        "valid_until": F.when(inv, at).otherwise(F.col("valid_until")),
    }).select(*df.columns)
    fresh = d.where("op IN ('ADD', 'INVALIDATE')").select(
        F.col("new_id").alias("id"), "content", "category", "entity", "confidence", F.lit("active").alias("status"), at.alias("valid_from"), at.alias("t_created"), F.lit(None).cast("timestamp_ntz").alias("valid_until"), F.lit(None).cast("bigint").alias("superseded_by"), *([] if metadata is None else [metadata.alias("metadata")]))
    return next_df.unionByName(fresh, allowMissingColumns=True), d.select("new_id", "op", "target")


def resolve(facts: DataFrame, existing: DataFrame) -> DataFrame:
    """Deterministic decisions: same text is NOOP, same entity and category with another text INVALIDATE, else ADD."""
    key = ["entity", "category"]
    cur = existing.where("status = 'active' AND valid_until IS NULL AND entity IS NOT NULL").groupBy(*key).agg(F.max(F.struct("t_created", "id", content_hash("content").alias("h"))).alias("cur"))
    j = facts.withColumn("_h", content_hash("content")).join(cur, key, "left")
    op = F.when(F.col("cur").isNull(), "ADD").when(F.col("cur.h") == F.col("_h"), "NOOP").otherwise("INVALIDATE")
    return j.select(F.col("id").alias("new_id"), op.alias("op"), F.col("cur.id").alias("target"), "content", "category", "entity", "confidence")


def similar(facts: DataFrame, existing: DataFrame, most: int = 5) -> DataFrame:
    """(new_id, known, n, h): of each fact's category and entity the ``most`` latest current facts, and the hash of their text.

    A fact without an entity meets the latest of its category. A group is cut to ``most`` before its rows are shuffled.
    """
    cur = existing.where("status = 'active' AND valid_until IS NULL").select("category", "entity", "t_created", F.col("id").alias("known"), content_hash("content").alias("h"))
    named, bare = facts.where("entity IS NOT NULL"), facts.where("entity IS NULL")
    found = []
    for some, key in ((named, ["category", "entity"]), (bare, ["category"])):
        first = cur.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("t_created"), "known"))).where(F.col("n") <= most)
        found.append(some.select(F.col("id").alias("new_id"), *key).join(first.select(*key, "known", "n", "h"), key).select("new_id", "known", "n", "h"))
    return found[0].unionByName(found[1])


def resolve_among(facts: DataFrame, near: DataFrame) -> DataFrame:
    """Decisions by what is ``similar``: NOOP where one of these has the text, else INVALIDATE of the nearest, else ADD."""
    f = facts.withColumn("_h", content_hash("content"))
    met = f.select(F.col("id").alias("new_id"), "_h").join(near, "new_id")
    best = met.groupBy("new_id").agg(F.min_by("known", F.when(F.col("h") == F.col("_h"), F.col("n"))).alias("same"), F.min_by("known", "n").alias("first"))
    j = f.withColumnRenamed("id", "new_id").join(best, "new_id", "left")
    op = F.when(F.col("same").isNotNull(), "NOOP").when(F.col("first").isNotNull(), "INVALIDATE").otherwise("ADD")
    return j.select("new_id", op.alias("op"), F.coalesce("same", "first").alias("target"), "content", "category", "entity", "confidence")


def consolidate(queue: DataFrame, facts: DataFrame, memories: DataFrame, now: Column, model: str = "rules", batch: int = 20) -> tuple[DataFrame, DataFrame]:
    """(memories, queue) after one batch: the oldest waiting episodes are claimed, their facts resolved and applied, and the episodes done.

    ``facts`` (id, episode, content, category, entity, confidence) are what was read out of all episodes; those of a batch are
    resolved against ``memories`` as they were before it. New memories name their origin. An episode without facts is done.
    """
    claimed = cut(claim(queue, now, batch), "claimed")
    held = claimed.where((F.col("state") == "processing") & F.col("claimed_at").eqNullSafe(now)).select(F.col("id").alias("episode"))
    new = facts.join(F.broadcast(held), "episode", "left_semi").drop("episode")  # at most ``batch`` episodes
    origin = F.create_map(F.lit("extraction_model"), F.lit(f"consolidation:{model}"))
    after, _ = apply_decisions(memories, cut(resolve_among(new, similar(new, memories)), "decisions"), now, origin)
    done = held.select(F.col("episode").alias("id"), F.lit("done").alias("event"), F.lit(None).cast("string").alias("error"))
    return after, transition(claimed, done)


def claim(queue: DataFrame, now: Column, batch: int = 20, lease: int = 600) -> DataFrame:
    """Mark the oldest pending or stale rows as processing. One writer; readers see whole versions."""
    stale = (F.col("state") == "processing") & (F.timestamp_diff("SECOND", F.col("claimed_at"), now) > lease)
    pick = queue.where((F.col("state") == "pending") | stale).orderBy("created_at", "id").limit(batch).select("id", F.lit(True).alias("_take"))
    j = queue.join(F.broadcast(pick), "id", "left")  # at most ``batch`` rows
    take = F.coalesce("_take", F.lit(False))
    return j.withColumns({"state": F.when(take, "processing").otherwise(F.col("state")), "claimed_at": F.when(take, now).otherwise(F.col("claimed_at"))}).drop("_take")


def transition(queue: DataFrame, events: DataFrame) -> DataFrame:
    """events (id, event, error): enqueue done or failed rows again, finish, fail (error cut to 1000), release.

    Only failures bring their error along. Rows are merged by id: events with long errors look small in statistics, so they must
    not be broadcast.
    """
    told = F.when(F.col("event") == "failed", F.substring("error", 1, 1000))
    j = queue.join(events.select("id", "event", told.alias("_error")).hint("merge"), "id", "left")
    e, s = F.col("event"), F.col("state")
    state = F.when((e == "enqueue") & s.isin("done", "failed"), "pending").when((e == "done") & (s == "processing"), "done").when((e == "failed") & (s == "processing"), "failed").when((e == "release") & (s == "processing"), "pending").otherwise(s)
    error = F.when((e == "failed") & (s == "processing"), F.col("_error")).when((e == "enqueue") & s.isin("done", "failed"), F.lit(None).cast("string")).otherwise(F.col("error"))
    return j.withColumns({"_s": state, "error": error}).drop("state", "event", "_error").withColumnRenamed("_s", "state")


def promote(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (id, decision): keep the scope, widen it, or archive."""
    j = df.join(decisions.select("id", "decision"), "id", "left")
    d = F.col("decision")
    scope = F.when(d == "PROMOTE_PROJECT", "project").when(d == "PROMOTE_USER", "user").otherwise(F.lit("session"))
    return j.withColumns({"scope": scope, "status": F.when(d == "DISCARD", "archived").otherwise(F.col("status"))}).drop("decision")


def get_or_create(have: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """``have`` and those of ``wanted`` that it lacks, once each."""
    return have.unionByName(wanted.dropDuplicates(key).join(have.select(*key), key, "left_anti"), allowMissingColumns=True)


def merge_latest(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows replace rows of the same key, others stay."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def set_limits(old: DataFrame, new: DataFrame, key: str = "user_id") -> DataFrame:
    """Upsert in which a null keeps the old value."""
    cols = [c for c in old.columns if c != key]
    j = old.alias("o").join(new.alias("n"), key, "full_outer")
    return j.select(key, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in cols])
