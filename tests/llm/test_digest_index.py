"""The digest index over many batches: deliveries by name, compaction."""

import pytest
from pyspark.sql import functions as F

from tempofact.llm import exactdedup


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, f"text {i % 60}") for i in range(100)] + [(None, "text 3"), (None, None), (7, "")], "doc_id bigint, text string")


@pytest.fixture
def index(spark):
    before = spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering")
    made = exactdedup.DigestIndex(spark, buckets=4)
    yield made
    made.drop()
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", before)


def sorts_of_index(spark, index):
    """How many sorts a merge join of new digests with the index needs, and whether it shuffles the index."""
    new = spark.range(1000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    joined = new.hint("merge").join(index.rows().select("digest").hint("merge"), "digest", "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    return plan.count("Sort ["), plan.count("Exchange hashpartitioning")


def test_a_delivery_by_another_name_is_a_repeat(spark, docs, index):
    first = exactdedup.kept_documents(docs, index, "monday")
    assert first.count() == 61
    n = index.rows().count()
    assert exactdedup.kept_documents(docs, index, "tuesday").count() == 0
    assert sorted(map(str, exactdedup.kept_documents(docs, index, "monday").collect())) == sorted(map(str, first.collect()))
    assert index.rows().count() == n == 61


def test_compaction_after_three_appends(spark, docs, index):
    parts = [docs.where("doc_id < 30"), docs.where("doc_id >= 30 AND doc_id < 80"), docs.where("doc_id >= 80 OR doc_id IS NULL")]
    for k, part in enumerate(parts):
        index.append(part, f"b{k}").count()
    held = sorted(map(str, index.rows().collect()))
    assert index.rows().select(F.input_file_name()).distinct().count() > 4 and sorts_of_index(spark, index) == (2, 1)
    path = index.compact()
    assert index.rows().select(F.input_file_name()).distinct().count() == 4 and sorts_of_index(spark, index) == (1, 1)
    assert sorted(map(str, index.rows().collect())) == held
    again = index.append(parts[1], "b1").collect()
    assert sum(r.kept for r in again) == 30 and len(held) == index.rows().count()
    assert not any(r.kept for r in index.append(parts[1], "b3").collect())
    late = spark.createDataFrame([(500, "TEXT 5"), (501, "new"), (502, "New")], "doc_id bigint, text string")
    assert {r.doc_id: (r.keep_id, r.kept) for r in index.append(late, "b4").collect()} == {500: (5, False), 501: (502, False), 502: (502, True)}
    assert index.compact() != path and index.rows().count() == len(held) + 1
    other = exactdedup.DigestIndex(spark, buckets=4, path=index.path)
    assert other.rows().count() == len(held) + 1
    other.drop()


def test_empty_index_compacts(spark, index, docs):
    index.compact()
    assert index.rows().count() == 0 and index.append(docs.limit(0), "none").count() == 0
    assert exactdedup.exact_dedup(docs, index, delivery="d").where("kept").count() == 61
