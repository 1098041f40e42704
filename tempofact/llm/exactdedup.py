"""Exact deduplication through a persistent digest index, bucketed and sorted by digest.

New texts meet the index in a sort-merge anti-join that reads the index without a shuffle; digests that the index
lacks are appended, with the id that stays and the batch that brought them. Only ids and 32-byte digests are shuffled;
``kept_documents`` shuffles whole rows once, to leave those that go. Native DataFrame operations throughout.

A batch is named after its contents unless told otherwise. Entries of its own name count as its own, so that a batch that is
appended again after a failure has the same result and adds nothing.

Defined results: a null text counts as empty; texts are equal when equal after lower-casing A-Z; of equal texts the
row with the largest doc_id stays (null ids lose to any id); rows that repeat both doc_id and text are one document,
returned once; extra columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempofact.llm.common import columns, lower_ascii, salt_mask, salt_of, spread
from tempofact.session import cut, shared_dir

INDEX_SCHEMA = "digest binary, keep_id bigint, batch string"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(lower_ascii(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, SHA-256 of the normalised text and the number of rows, once for each distinct pair."""
    pairs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("text")).alias("digest"))
    return pairs.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("reps"))


class DigestIndex:
    """A table of digests seen so far, in as many buckets as shuffles have partitions unless told otherwise.

    It lies in ``path``, for later sessions (which name the same number of buckets), or in the shared folder.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None, path: str | None = None):
        self.spark = spark
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or f"{shared_dir(spark)}/tempofact/{self.table}"
        self.buckets = buckets or max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
        if not spark.catalog.tableExists(self.table):
            spark.sql(f"CREATE TABLE {self.table} ({INDEX_SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, rows: DataFrame, batch: str | None = None) -> str:
        """Append the digests of ``rows`` (as of ``digests``) that the index lacks; return the batch's name."""
        if batch is None:
            n, x = rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("digest", "doc_id"))).first()
            batch = f"{n}-{x or 0:x}"
        last = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        new = last.hint("merge").join(self.rows().select("digest").hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(batch))
        out = cut(new, "new").repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        out.option("path", self.path).saveAsTable(self.table)
        return batch

    def annotate(self, rows: DataFrame, batches: list[str]) -> DataFrame:
        """doc_id, digest, keep_id, group_size (within ``rows``), reps, and kept: it is the row that one of ``batches`` brought."""
        salted = rows.withColumn("salt", salt_of(F.col("doc_id")))
        groups = salted.groupBy("digest").agg(F.sum("reps").alias("group_size"), salt_mask(F.col("salt")).alias("salts"))
        found = spread(groups.hint("merge").join(self.rows().hint("merge"), "digest"))
        fresh = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("batch").isin(batches)
        return salted.join(found, ["digest", "salt"]).select("doc_id", "digest", "keep_id", "group_size", "reps", fresh.alias("kept"))

    def append(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Add the new texts of ``docs``; return its annotated rows.

        keep_id is the id under which the index holds the text: that of an earlier batch, if it had the text.
        """
        rows = cut(digests(docs), "digests")
        return self.annotate(rows, [self.add(rows, batch)])

    def compact(self) -> str:
        """Rewrite the index with one sorted file a bucket in a new folder, point the table there, return the folder.

        Each batch adds a file to a bucket, and a bucket of several files is sorted anew by every merge join. After this a join reads
        the index as it lies, until batches come again. The move is one change of the catalog: a job lost before it leaves the
        index as it was. The old files stay for readers that have begun; later sessions name the new folder.
        """
        made, path = f"{self.table}_{uuid.uuid4().hex}", f"{shared_dir(self.spark)}/tempofact/{self.table}-{uuid.uuid4().hex}"
        held = cut(self.rows(), "index")  # read from the table, its old files would pass for buckets dealt already
        out = held.repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        out.option("path", path).saveAsTable(made)
        self.spark.sql(f"ALTER TABLE {self.table} SET LOCATION '{path}'")
        self.spark.sql(f"DROP TABLE {made}")
        self.spark.catalog.refreshTable(self.table)
        self.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # trust the order of single files
        self.path = path
        return path

    def drop(self) -> None:
        """Forget the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, share: float = 0.5, delivery: str | None = None) -> DataFrame:
    """One row for each document with the id that stays for its text, under ``index`` or a new one.

    The documents come in two batches, the ``share`` with the larger ids first, so that these stay. group_size counts
    the rows of both. ``delivery`` names them: the same rows under another name are repeats of what the index has, under the
    same name a job run again. Without it the contents name them.
    """
    rows, own = cut(digests(docs), "digests"), index or DigestIndex(docs.sparkSession)
    pivot = rows.agg(F.percentile_approx("doc_id", 1 - share, F.lit(1000))).first()[0]
    late = F.coalesce(F.col("doc_id") > F.lit(pivot).cast("bigint"), F.lit(False))
    name = lambda part: None if delivery is None else f"{delivery}-{part}"
    out = own.annotate(rows, [own.add(rows.where(late), name("late")), own.add(rows.where(~late), name("early"))])
    if index is None:
        out = cut(out, "deduplicated")
        own.drop()
    return out


def kept_documents(docs: DataFrame, index: DigestIndex | None = None, delivery: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text one stays.

    Rows that repeat are reduced before the shuffle; others aren't grouped.
    """
    key = ["_none", "_id", "_digest"]
    keyed = lambda row, d: [row, F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("_id"), d.alias("_digest")]
    keep = cut(exact_dedup(docs, index, delivery=delivery).where("kept").select(*keyed(F.col("reps"), F.col("digest"))), "kept")
    rows = docs.select(*keyed(F.struct(*columns(docs)).alias("_row"), digest(F.col("text"))))
    out = rows.join(keep.where("reps = 1"), key, "left_semi").select("_row.*")
    if keep.where("reps > 1").isEmpty():
        return out
    repeated = rows.join(keep.where("reps > 1"), key, "left_semi").groupBy(*key).agg(F.first("_row").alias("_row"))
    return out.unionAll(repeated.select("_row.*"))
