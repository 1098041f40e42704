"""Structured Streaming forms of the store's stream-shaped work."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tempofact.session import shared_dir, ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # state outside the heap


def source(spark: SparkSession, sf_dir: str, name: str, files: int | None = None) -> DataFrame:
    """A stream over the files of a table, one file or a folder (hence the pattern); the schema comes from their footers."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there, exactly once through a checkpoint, and read the result table back.

    In ``append`` mode a window's row comes when the watermark closes it; in ``complete`` mode all windows are there, open ones too.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={n if mode == 'append' else 0}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/batch=*")


def event_time(df: DataFrame, delay: str = "1 day") -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def daily_counts(events: DataFrame) -> DataFrame:
    """Writes of each user and day."""
    return event_time(events).groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("writes")).select("user_id", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "writes")


def sliding_counts(events: DataFrame) -> DataFrame:
    """Events of the last hour, every five minutes."""
    return event_time(events).groupBy(F.window("ts", "1 hour", "5 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    """Activity sessions of each user."""
    s = event_time(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def late_rows(events: DataFrame, files: str, closes: F.Column, delay: str = "1 day"):  # noqa: ANN201
    """The running query that writes rows which an append-mode aggregate drops to the folder ``files``/late.

    ``closes`` is the end of a row's window. A row is late, as Spark has it, where its window was closed by the watermark of the
    micro-batch before its own: the largest time of those before that, kept as a row a batch, less ``delay``. Batches replace
    themselves when repeated. Where a stream rests, Spark's watermark moves on by itself; such rows are not listed.
    """
    spark = events.sparkSession

    def put(batch: DataFrame, n: int) -> None:
        timed = batch.withColumn("ts", F.col("ts").cast("timestamp"))
        timed.agg(F.max("ts").alias("most")).write.mode("overwrite").parquet(f"{files}/marks/batch={n}")
        seen = spark.read.schema("most timestamp, batch bigint").parquet(f"{files}/marks").where(F.col("batch") < n - 1).agg(F.max("most").alias("most"))
        mark = F.col("_most") - F.expr(f"INTERVAL {delay}")
        late = timed.withColumn("_closes", closes.cast("timestamp")).crossJoin(F.broadcast(seen.select(F.col("most").alias("_most")))).where(F.col("_closes") <= mark)  # one row
        late.drop("_closes", "_most").write.mode("overwrite").parquet(f"{files}/late/batch={n}")

    return events.writeStream.option("checkpointLocation", f"{files}/late-state").trigger(availableNow=True).foreachBatch(put).start()


def stateful(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    """``rows`` by ``keys`` through ``processor``; state is kept by RocksDB, outside the heap."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def micros(t: pd.Timestamp) -> int:
    return int(pd.Timestamp(t).value // 1000)


class Chains(StatefulProcessor):
    """Facts (id, at) of one key in order of event time; each fact is closed by the next, late ones between their neighbours.

    State is a list of the key's facts. With ``keep`` (seconds) facts that the watermark has passed by so much leave it, all
    but the last of them, at an event-time timer: a key that rests costs one fact.
    """

    def __init__(self, keep: int | None = None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getListState("facts", "at bigint, id bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802
        known = sorted((int(a), int(i)) for a, i in self.facts.get()) if self.facts.exists() else []
        had = dict(zip(known, known[1:]))
        new = {(micros(a), int(i)) for df in rows for a, i in zip(df["at"], df["id"])}
        whole = sorted({*known, *new})
        self.facts.put(whole)
        if self.keep is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(whole[0][0] // 1000 + self.keep * 1000 + 1)
        closed = [(f, n) for f, n in zip(whole, whole[1:]) if had.get(f) != n]
        if closed:
            yield self.out(key, closed)

    def out(self, key, closed):  # noqa: ANN001, ANN201
        cols = {f"k{i}": pd.Series([k] * len(closed), dtype=object) for i, k in enumerate(key)}
        return pd.DataFrame(cols | {"id": [f[1] for f, _ in closed], "closed": pd.to_datetime([n[0] for _, n in closed], unit="us"), "by": [n[1] for _, n in closed]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802
        mark = timerValues.getCurrentWatermarkInMs() * 1000 - self.keep * 1_000_000
        known = sorted((int(a), int(i)) for a, i in self.facts.get())
        old = [f for f in known if f[0] < mark]
        left = known[len(old) - 1 :] if old else known
        self.facts.put(left)
        if len(left) > 1:
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs() + 1, left[1][0] // 1000 + self.keep * 1000 + 1))
        return iter(())

    def close(self) -> None:
        pass


def chained(facts: DataFrame, keys: list[str], delay: str = "30 days", keep: int | None = None) -> DataFrame:
    """The stream (k0, k1 ..., id, closed, by): a row whenever the next of a fact (keys, id bigint, at timestamp) is known or comes nearer."""
    kinds = dict(facts.dtypes)
    schema = ", ".join([*(f"k{i} {kinds[k]}" for i, k in enumerate(keys)), "id bigint, closed timestamp, by bigint"])
    timed = facts.select(*keys, F.col("id").cast("long").alias("id"), F.col("at").cast("timestamp").alias("at")).withWatermark("at", delay)
    return stateful(timed, keys, Chains(keep), schema)


class Leases(StatefulProcessor):
    """Queue events (at, event) of one item, in order of event time whatever order they come in within the delay.

    Rows wait in a list until the watermark passes them. A claim takes the item for ``lease`` seconds; without done, failed or
    release by then a timer gives it back: one row (item, claimed, reclaimed).
    """

    def __init__(self, lease: int = 600):
        self.lease = lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, event string")
        self.claimed = handle.getValueState("claimed", "at bigint")

    def arm(self, times: list[int], now: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if times:
            self.handle.registerTimer(max(now + 1, min(times) // 1000 + 1))

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802
        held = [(int(a), e) for a, e in self.waiting.get()] if self.waiting.exists() else []
        held += [(micros(a), e) for df in rows for a, e in zip(df["at"], df["event"])]
        self.waiting.put(sorted(held))
        ends = [self.claimed.get()[0] + self.lease * 1_000_000] if self.claimed.exists() else []
        self.arm([a for a, _ in held] + ends, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((int(a), e) for a, e in self.waiting.get()) if self.waiting.exists() else []
        since = int(self.claimed.get()[0]) if self.claimed.exists() else None
        back, length = [], self.lease * 1_000_000
        ready = [x for x in held if x[0] < mark]
        for at, event in ready:
            if since is not None and since + length < at:
                back.append((since, since + length))
                since = None
            if event == "claim":
                since = since if since is not None else at
            elif event in ("done", "failed", "release"):
                since = None
        if since is not None and since + length < mark:
            back.append((since, since + length))
            since = None
        left = held[len(ready) :]
        self.waiting.put(left) if left else self.waiting.clear()
        self.claimed.update((since,)) if since is not None else self.claimed.clear()
        self.arm([a for a, _ in left] + ([since + length] if since is not None else []), timerValues.getCurrentWatermarkInMs())
        if back:  # a frame a key is what costs
            yield self.out(key, back)

    def out(self, key, back):  # noqa: ANN001, ANN201
        return pd.DataFrame({"item": [key[0]] * len(back), "claimed": pd.to_datetime([a for a, _ in back], unit="us"), "reclaimed": pd.to_datetime([b for _, b in back], unit="us")})

    def close(self) -> None:
        pass


def reclaimed(events: DataFrame, lease: int = 600, delay: str = "1 hour") -> DataFrame:
    """The stream (item, claimed, reclaimed) of leases that ran out, of queue events (item bigint, at, event)."""
    timed = events.select(F.col("item").cast("long").alias("item"), F.col("at").cast("timestamp").alias("at"), "event").withWatermark("at", delay)
    return stateful(timed, ["item"], Leases(lease), "item bigint, claimed timestamp, reclaimed timestamp")


def deduplicated(docs: DataFrame, text: str = "text", time: str = "ts") -> DataFrame:
    """The first arrival of each trimmed text."""
    from tempofact.operators.bitemporal import content_hash

    hashed = docs.withColumn("h", content_hash(text))
    return hashed.withWatermark(time, "30 days").dropDuplicatesWithinWatermark(["h"]).drop("h")


KEYS = ("entity", "category", "namespace")
BUCKETS = 32


def supersessions(facts: DataFrame, files: str, available: bool = True, keys: tuple[str, ...] = KEYS):  # noqa: ANN201
    """The running query that closes each fact (keys, id, valid_from) by the next of its keys, whatever order they come in.

    The state is a Parquet history in the folder ``files``, in hashed buckets: a micro-batch reads only its own buckets'
    facts of its own keys, orders them by event time and writes what it closes. A late fact is put between its
    neighbours: its predecessor is closed again, earlier, and the fact by its successor. Batches write to folders of
    their own number, so a repeated one replaces itself.
    """
    spark = facts.sparkSession
    rows = facts.select(*keys, "id", "valid_from")
    store = T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])

    def put(batch: DataFrame, n: int) -> None:
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{files}/history/batch={n}")
        known = spark.read.schema(store).parquet(f"{files}/history").where(F.col("batch") <= n).withColumn("fresh", F.col("batch") == n)
        mine = spark.read.schema(store).parquet(f"{files}/history").where(F.col("batch") == n).select("bucket", *keys).distinct()
        same = reduce(lambda p, k: p & known[k].eqNullSafe(mine[k]), keys, known["bucket"] == mine["bucket"])
        w = W.partitionBy(*keys).orderBy("valid_from", "id")
        touched = known.join(mine, same, "left_semi").withColumns({"closed": F.lead("valid_from").over(w), "by": F.lead("id").over(w), "next_fresh": F.lead("fresh").over(w)})
        touched.where("closed IS NOT NULL AND (fresh OR next_fresh)").select(*keys, "id", "closed", "by").write.mode("overwrite").parquet(f"{files}/closed/batch={n}")

    writer = rows.writeStream.option("checkpointLocation", f"{files}/state").foreachBatch(put)
    return (writer.trigger(availableNow=True) if available else writer).start()


def closed_facts(spark: SparkSession, files: str, schema: T.StructType, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, id, closed, by): when each fact was closed and by which. A fact in between only ever closes earlier."""
    out = T.StructType([*[schema[k] for k in keys], schema["id"], T.StructField("closed", schema["valid_from"].dataType), T.StructField("by", schema["id"].dataType)])
    got = spark.read.schema(out).parquet(f"{files}/closed/batch=*").groupBy(*keys, "id").agg(F.min(F.struct("closed", "by")).alias("x"))
    return got.select(*keys, "id", "x.closed", "x.by")


def consolidate(stream: DataFrame, apply: Callable[[DataFrame, int], None], every: str | None = None, checkpoint: str | None = None):  # noqa: ANN201
    """The worker: each micro-batch of turns is applied once; ``every`` polls, None processes what is there."""
    where = checkpoint or f"{shared_dir(stream.sparkSession)}/worker-{uuid.uuid4().hex}"
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.option("checkpointLocation", where).trigger(**trigger).foreachBatch(apply).start()


ship(__name__)
