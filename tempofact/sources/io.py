"""Readers and writers: JSON import and export, trend files, benchmark catalogues, episodes."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tempofact.operators.bitemporal import content_hash
from tempofact.schemas import EPISODE, MEMORY, ROLES, struct

IMPORT = "id string, content string, tags array<string>, category string, entity string, namespace string, confidence double, status string, created_at string"
TREND = "timestamp string, sha string, variant string, category string, score string, n string"
EXAMPLE = "category string, context string, questions array<string>, answers array<array<string>>, metadata map<string,string>"
TURN = "struct<role:string,speaker:string,content:string,text:string>"
LONG_QA = f"question_id string, question_type string, question string, question_date string, answer string, answer_session_ids array<string>, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<{TURN}>>"


def import_json(spark: SparkSession, path: str, existing: DataFrame, lines: bool = False) -> DataFrame:
    """New memories of a JSON array: defaults filled in, an empty id replaced, texts that exist or repeat skipped.

    With ``lines`` a file has an object a line, as ``export_json`` writes them, and is split among tasks.
    """
    rows = spark.read.schema(IMPORT).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path).where("content IS NOT NULL")
    once = rows.groupBy(content_hash("content").alias("h")).agg(F.min(F.struct("id", *[c for c in rows.columns if c != "id"])).alias("r")).select("h", "r.*")
    fresh = once.join(existing.select(content_hash("content").alias("h")).distinct(), "h", "left_anti")
    new_id = F.when(F.coalesce(F.trim("id"), F.lit("")) == "", F.substring("h", 1, 12)).otherwise(F.col("id"))
    fill = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return fresh.select(new_id.alias("id"), "content", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), fill("category", "general"), "entity", fill("namespace", "default"), fill("confidence", 1.0), fill("status", "active"), "created_at")


def export_json(df: DataFrame, path: str) -> None:
    df.drop("embedding").write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str, limit: int = 5000) -> None:
    """At most ``limit`` rows by id; tags joined by a semicolon."""
    flat = df.orderBy("id").limit(limit)
    flat.select(*[F.concat_ws(";", c).alias(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c).cast("string").alias(c) for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]).write.mode("overwrite").option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_trend(spark: SparkSession, path: str) -> DataFrame:
    """Trend rows; numbers that can't be read are 0; a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], TREND).select("timestamp", "sha", "variant", "category", F.lit(0.0).alias("score"), F.lit(0).alias("n"))
    rows = spark.read.schema(TREND).option("header", True).csv(path)
    return rows.select("timestamp", "sha", "variant", "category", F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)).alias("score"), F.coalesce(F.col("n").try_cast("int"), F.lit(0)).alias("n"))


def append_trend(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def read_summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """All summaries of a folder, one object a file; malformed files are skipped."""
    return spark.read.schema("benchmark string, primary double, total bigint, per_category map<string,double>").option("multiLine", True).option("mode", "DROPMALFORMED").json(pattern).where("benchmark IS NOT NULL")


def long_qa(spark: SparkSession, path: str, limit: int | None = None, lines: bool = False) -> DataFrame:
    """(question_id, question, answer, session_id, session_date, turn, role, content) of a long-memory sample file."""
    s = spark.read.schema(LONG_QA).option("multiLine", not lines).json(path)
    s = s if limit is None else s.limit(limit)
    sessions = s.select("question_id", "question", "answer", F.posexplode("haystack_sessions").alias("k", "turns"), "haystack_session_ids", "haystack_dates")
    turns = sessions.select("question_id", "question", "answer", F.get("haystack_session_ids", F.col("k")).alias("session_id"), F.get("haystack_dates", F.col("k")).alias("session_date"), F.posexplode("turns").alias("turn", "t"))
    return turns.select("question_id", "question", "answer", "session_id", "session_date", "turn", F.coalesce("t.role", "t.speaker").alias("role"), F.coalesce("t.content", "t.text").alias("content"))


def dialogue_qa(spark: SparkSession, path: str, skip_category: int = 5, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Turns and questions of dialogue samples whose sessions are keys session_1, session_2, ...; one category is left out.

    A file is an array of samples; with ``lines`` each of its lines is one.
    """
    raw = spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", "array<string>")).alias("j"))
    doc = raw.select("j", F.get_json_object("j", "$.sample_id").alias("sample_id"))
    conv = F.from_json(F.get_json_object("j", "$.conversation"), "map<string,string>")
    sessions = doc.select("sample_id", F.explode(conv).alias("key", "body")).where(F.col("key").rlike(r"^session_\d+$"))
    turns = sessions.select("sample_id", F.regexp_extract("key", r"(\d+)", 1).cast("int").alias("session"), F.posexplode(F.from_json("body", "array<struct<speaker:string,text:string,dia_id:string>>")).alias("turn", "t")).select("sample_id", "session", "turn", "t.speaker", "t.text")
    qa = doc.select("sample_id", F.posexplode(F.from_json(F.get_json_object("j", "$.qa"), "array<struct<question:string,answer:string,category:int>>")).alias("pos", "q")).select("sample_id", "pos", "q.question", "q.answer", "q.category").where(F.col("category") != skip_category)
    return turns, qa


def capped_questions(qa: DataFrame, conversations: int, questions: int, only: DataFrame | None = None) -> DataFrame:
    """The first questions of the first conversations; an allow-list (sample_id, question) is applied after the cap."""
    first = qa.select("sample_id").distinct().orderBy("sample_id").limit(conversations)
    some = qa.join(F.broadcast(first), "sample_id").where(F.col("pos") < questions)
    return some if only is None else some.join(only.select("sample_id", "question"), ["sample_id", "question"], "left_semi")


def examples(spark: SparkSession, root: str, splits: dict[str, str], limit: int | None = None) -> DataFrame:
    """(category, context, questions, answers, metadata) of the Parquet folders ``root``/split, one a category.

    A category whose folder isn't there is skipped; absent metadata is an empty map; ``limit`` holds for each category.
    """
    out = spark.createDataFrame([], EXAMPLE)
    for category, split in splits.items():
        if exists(spark, f"{root}/{split}"):
            rows = spark.read.parquet(f"{root}/{split}")
            meta = F.col("metadata").cast("map<string,string>") if "metadata" in rows.columns else F.lit(None).cast("map<string,string>")
            some = rows.select(F.lit(category).alias("category"), "context", "questions", "answers", F.coalesce(meta, F.create_map().cast("map<string,string>")).alias("metadata"))
            out = out.unionAll(some if limit is None else some.limit(limit))
    return out


def example_questions(rows: DataFrame) -> DataFrame:
    """(category, context, pos, question, accepted): a row a question, with all answers that count as right."""
    pairs = F.posexplode(F.arrays_zip("questions", "answers")).alias("pos", "qa")
    return rows.select("category", "context", pairs).select("category", "context", "pos", F.col("qa.questions").alias("question"), F.col("qa.answers").alias("accepted"))


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A catalogue of cases, an object a line, with a strict shape: broken lines, unknown and missing fields fail the job."""
    kind = struct(schema)
    keys, names = F.json_object_keys("value"), F.array(*[F.lit(n) for n in kind.names])
    needed = F.array(*[F.lit(f.name) for f in kind if f.nullable is False]).cast("array<string>")
    case = F.from_json("value", kind, {"mode": "FAILFAST"})
    fits = F.coalesce((F.size(F.array_except(keys, names)) == 0) & (F.size(F.array_except(needed, keys)) == 0), F.lit(False))
    absent = [F.col(f"c.{f.name}").isNull() for f in kind if f.nullable is False]
    lines = spark.read.text(path).select("value", F.when(fits, case).otherwise(F.raise_error(F.concat(F.lit("case does not fit: "), F.substring("value", 1, 200)))).alias("c"))
    whole = F.col("c")
    for a in absent:
        whole = F.when(a, F.raise_error(F.lit("case lacks a value"))).otherwise(whole)
    return lines.select(whole.alias("c")).select("c.*")


def cases(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A catalogue of cases with a strict shape: unknown or missing fields fail."""
    kind = struct(schema)
    for r in rows:
        if set(r) - set(kind.names) or any(not f.nullable and r.get(f.name) is None for f in kind):
            raise ValueError(f"case does not fit {kind.simpleString()}: {sorted(r)}")
    return spark.createDataFrame([tuple(r.get(n) for n in kind.names) for r in rows], kind)


def memories_of(df: DataFrame) -> DataFrame:
    """Any older layout as memories: missing columns are null, defaults filled in."""
    have = set(df.columns)
    cols: list[Column] = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in struct(MEMORY)]
    return df.select(*cols).withColumns({"status": F.coalesce("status", F.lit("active")), "namespace": F.coalesce("namespace", F.lit("default")), "category": F.coalesce("category", F.lit("general")), "visibility": F.coalesce("visibility", F.lit("team"))})


def checked_episodes(df: DataFrame) -> DataFrame:
    """Episodes for a write; a round whose answer precedes its question fails the job."""
    ok = F.col("assistant_ts") >= F.col("user_ts")
    good = df.withColumn("assistant_ts", F.when(ok, F.col("assistant_ts")).otherwise(F.raise_error(F.lit("assistant_ts before user_ts"))))
    return good.select(*[f.name for f in struct(EPISODE)])


def checked_turns(df: DataFrame) -> DataFrame:
    """Turns with a known role and a text; others fail the job."""
    ok = F.col("role").isin(list(ROLES)) & (F.trim(F.coalesce("text", F.lit(""))) != "")
    return df.withColumn("role", F.when(ok, F.col("role")).otherwise(F.raise_error(F.lit("turn without a known role or a text"))))


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest vector of each id."""
    once = new.dropDuplicates(["vec_id"])
    return old.join(once.select("vec_id"), "vec_id", "left_anti").unionByName(once)


def trace_sink(df: DataFrame, path: str) -> None:
    """Append trace events as JSON lines, secrets redacted, numbered within a recall."""
    from tempofact.functions.text import redact

    seq = F.row_number().over(W.partitionBy("recall_id").orderBy("ts", "event_id"))
    df.withColumns({"seq": seq, "payload": redact(F.col("payload"))}).write.mode("append").json(path)


def hashing_embedder(size: int = 64):  # noqa: ANN201
    """A deterministic embedding of words by hashing, as a vectorised function."""
    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[float]:
            v = np.zeros(size)
            for w in (t or "").lower().split():
                h = crc32(w.encode())
                v[h % size] += 1 if h & 0x80000000 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).astype("float32").tolist()

        return text.map(one)

    return embed
