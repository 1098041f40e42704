"""What the operators of this subpackage share: text normal forms, row keys, sampling and salted joins."""

from __future__ import annotations

import pickle

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tempofact.session import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Salts of a hot key; a bit of a long each.
SALTS = 64


def send(spark: SparkSession, model: object) -> Broadcast:
    """Broadcast ``model`` with its class by value, so that executors need no installed package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def received(sent: Broadcast) -> object:
    return pickle.loads(sent.value)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame, *clash: str) -> list[Column]:
    """The columns of ``df`` whatever their names hold, without those that clash with a result's names."""
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in clash]


def packed(docs: DataFrame, *clash: str) -> tuple[Column, list[Column]]:
    """All columns but ``clash`` as one struct ``_row``, whatever their names hold, and the columns that unpack it."""
    kept = [c for c in docs.columns if c.lower() not in clash]
    row = F.struct(F.lit(0).alias("_"), *[F.col(quoted(c)) for c in kept]).alias("_row")
    return row, [F.col("_row").getField(c).alias(c) for c in kept]


def extended(rest: DataFrame, fields: str, *hidden: str) -> StructType:
    """The schema of ``rest`` without its ``hidden`` columns, and ``fields`` after it."""
    return StructType([f for f in rest.schema if f.name not in hidden] + StructType.fromDDL(fields).fields)


def tune(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the texts that one Arrow batch holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone. Texts without other bytes take the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def salt_of(key: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def salt_mask(salt: Column) -> Column:
    """Aggregate: which salts occur, as the bits of a long (no list of rows is gathered)."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt))


def spread(table: DataFrame, mask: str = "salts", salts: int = SALTS) -> DataFrame:
    """One row for each salt that occurs with a key, so that a join on (key, salt) splits hot keys."""
    on = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda i: F.getbit(F.col(mask), i) == 1)
    return table.withColumn("salt", F.explode(on)).drop(mask)


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, those with the least hash of ``key``: the same rows however the input is split."""
    return rows.orderBy(F.xxhash64(F.lit(17), F.col(key)), F.col(key)).limit(bound)


def labelled(docs: DataFrame, labels: DataFrame, label: str, n: int, held: int, bound: int) -> DataFrame:
    """Texts and label (0 or 1) of a bounded sample of the labelled documents outside the held-out fold.

    Rows with a null id or label are no training rows; of repeated labels the largest counts, of rows that repeat an id
    the one with the least text hash. The sample's ids are bounded, so they are broadcast.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold_of(F.col("doc_id"), n) != held))
    marks = marks.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    marks = marks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = docs.select("doc_id", "text").join(F.broadcast(bounded_sample(marks, "doc_id", bound)), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("label").alias("label"))


ship(__name__)
