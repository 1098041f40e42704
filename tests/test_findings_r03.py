"""What the findings of the third round asked for."""

import shutil
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempofact import registry
from tempofact.operators import ann, dml, intervals, inverted, lanes, recall
from tempofact.sources import fixtures
from tempofact.streaming import jobs

registry.load()
QUERIES, FOLDER = registry.QUERIES, "/root/testdata/sf0.001"


def test_long_errors_are_merged_not_broadcast(spark):
    queue = spark.range(50).select("id", F.lit("processing").alias("state"), F.lit(None).cast("string").alias("error"))
    kinds = F.array(*map(F.lit, ("done", "failed", "release")))
    events = spark.range(50).select("id", F.element_at(kinds, (F.col("id") % 3 + 1).cast("int")).alias("event"), F.repeat(F.lit("x"), 1500).alias("error"))
    got = dml.transition(queue, events)
    assert "Broadcast" not in got._jdf.queryExecution().optimizedPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    assert {(r.state, r.error and len(r.error)) for r in got.collect()} == {("done", None), ("failed", 1000), ("pending", None)}


@pytest.mark.parametrize(("name", "n", "times"), [("sm3_daily", "writes", 1), ("sm4_sessions", "n", 1), ("sm5_sliding", "n", 12)])
def test_windows_that_are_still_open_are_counted(spark, name, n, times):
    whole = spark.read.parquet(f"{FOLDER}/events.parquet").count()
    assert QUERIES[name](spark, FOLDER).agg(F.sum(n)).first()[0] == whole * times


def test_a_few_words_are_found_without_building_an_index(spark, tmp_path):
    """A query of a few words reads the texts once; it writes no index of all words."""
    folder = tmp_path / "tables"
    shutil.copytree(FOLDER, folder)
    for name in ("st2_rrf_hits", "st3_union", "jn3_outer", "tk4_keyword", "fn36_postings"):
        assert QUERIES[name](spark, str(folder)).count() > 0
    assert str(folder) not in spark.__dict__.get("_tempofact_indexes", {})


def test_texts_and_index_find_the_same(spark):
    m = fixtures.memories(spark, FOLDER).select("id", "content", "tags", "entity")
    index = inverted.build(m)
    ranks = [{r.id: round(r["rank"], 9) for r in inverted.ranked_top_k(x, ["Ther", "of", "tion"], 30).collect()} for x in (index, inverted.Texts(m))]
    assert ranks[0] and ranks[0] == ranks[1]
    counts = index.read("lexemes").groupBy("term", "weight").agg(F.count_if(F.col("nth") == 1).alias("docs"), F.count(F.lit(1)).alias("occurrences"), F.max("pos").alias("last"))
    assert counts.exceptAll(inverted.posting_counts(m)).isEmpty() and inverted.posting_counts(m).count() == counts.count()


def test_distances_are_held_by_tiles(spark, monkeypatch):
    """Several tiles of questions and rows give what one has, and no tile is larger than stated."""
    random = np.random.default_rng(4)
    v = np.vstack([random.normal(size=(300, 8)), np.zeros((1, 8))])
    v[250:300] = v[0:50]  # ties go by id
    rows = spark.createDataFrame([(i, i % 4, [float(x) for x in r]) for i, r in enumerate(v)], "id bigint, seen bigint, embedding array<double>").coalesce(1)
    queries = [(1000 + i, i % 2, v[i].tolist()) for i in range(120)]
    unit = v[:300] / np.linalg.norm(v[:300], axis=1)[:, None]
    want = set()
    for n, (q, bit, x) in enumerate(queries):
        near = sorted((round(1 - float(unit[n] @ unit[i]), 9), i) for i in range(300) if (i % 4) >> bit & 1)[:7]
        want |= {(q, i) for _, i in near}
    sizes = []
    take = lanes.Nearest.take
    monkeypatch.setattr(lanes, "TILE", (16, 32))
    assert {(r.query_id, r.id) for r in lanes.closest(rows, queries, 7).collect()} == want
    monkeypatch.setattr(lanes.Nearest, "take", lambda self, first, away, ids: (sizes.append(away.shape), take(self, first, away, ids)))
    best = lanes.Nearest(2, 3)
    best.take(0, np.array([[0.5, 0.25, 0.25, np.inf]] * 2), np.array([1, 9, 2, 3]))
    assert best.ids.tolist() == [[2, 9, 1]] * 2 and sizes == [(2, 4)]


def test_questions_of_one_filter_and_words_are_scored_once(spark, monkeypatch):
    q = recall.asked(spark.range(40).select(F.col("id").alias("query_id"), F.lit(None).cast("array<double>").alias("query"), F.array(F.lit("the"), F.lit("tion")).alias("terms")))
    asked = []
    spoken = recall.spoken
    monkeypatch.setattr(recall, "spoken", lambda seen, terms, *rest: (asked.append(terms.select("query_id").distinct().count()), spoken(seen, terms, *rest))[1])
    got = recall.candidates(q, fixtures.memories(spark, FOLDER), spark.read.parquet(f"{FOLDER}/embeddings.parquet")).groupBy("query_id").agg(F.sum("id").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert asked == [1] and len(got) == 40 and len({(r.s, r.n) for r in got}) == 1


@pytest.mark.parametrize("name", ["fn7_topics", "fn37_chunks", "fn38_overlap", "jn8_topics"])
def test_batches_of_texts_are_bounded(spark, name):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    QUERIES[name](spark, FOLDER)
    assert int(spark.conf.get(key)) <= 1000


def test_large_bins_are_dealt_on_both_sides(spark, monkeypatch):
    """Rows of one bin meet in cells of a grid, whichever side has many."""
    monkeypatch.setattr(intervals, "HOT", 10)
    span = [F.lit("k").alias("k"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'").alias("start"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:30:00'").alias("end")]
    for n, m in ((40, 3), (3, 40), (40, 40)):
        got = intervals.overlap_join(spark.range(n).select("id", *span), spark.range(m).select("id", *span), ["k"])
        assert "rows" in got._jdf.queryExecution().analyzed().toString() and got.select("left_id", "right_id").distinct().count() == got.count() == n * m


def test_keys_that_close_nothing_cost_no_frame():
    class Handle:
        exists = staticmethod(lambda: False)
        put = registerTimer = deleteTimer = staticmethod(lambda *x: None)
        listTimers = staticmethod(lambda: [])

        def getListState(self, *x):  # noqa: N802
            return self

        getValueState = getListState

    now = type("Now", (), {"getCurrentWatermarkInMs": staticmethod(lambda: 0)})
    at = pd.Timestamp("2024-01-01")
    for processor, rows in ((jobs.Chains(), pd.DataFrame({"at": [at], "id": [1]})), (jobs.Leases(), pd.DataFrame({"at": [at], "event": ["claim"]}))):
        processor.init(Handle())
        assert list(processor.handleInputRows(("k",), iter([rows]), now)) == []


def test_short_lists_are_asked_in_blocks(spark, monkeypatch):
    """No task holds the short lists of all questions, also where the recall of the index is measured."""
    asked = []
    lists = ann.short_lists
    monkeypatch.setattr(ann, "ASKED", 10)
    monkeypatch.setattr(ann, "short_lists", lambda index, queries, n: (asked.append(len(queries)), lists(index, queries, n))[1])
    whole = spark.read.parquet(f"{FOLDER}/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert QUERIES["tk2_recall"](spark, FOLDER).first().asDict() == {"queries": whole, "recall_over_90": True, "vectors_read": 40}
    assert sum(asked) == whole and max(asked) < whole


def test_short_lists_of_copies_go_by_id(spark):
    """Of more copies of a vector than a short list has rows, those with the least ids are listed."""
    v = np.random.default_rng(6).normal(size=(20, 16))
    table = spark.createDataFrame([(i, v[i % 20].tolist()) for i in np.random.default_rng(7).permutation(4000).tolist()], "vec_id bigint, embedding array<double>")
    few = table.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = ann.build(table)
    got = ann.short_lists(index, [(r.query_id, r.query) for r in few.collect()], 40)
    assert {(r.query_id, r.id) for r in got.collect()} == {(q, q + 20 * n) for q in range(20) for n in range(1, 41)}
    assert ann.recall_of(ann.search(index, few, 10), lanes.batch_top_k(table, few, 10)).first().recall == 1


@pytest.mark.parametrize("name", ["dm8_context", "sc8_mmr", "st4_multi_query"])
def test_a_query_holds_no_distances_beyond_a_tile(spark, monkeypatch, name):
    """The whole query gives the same rows by small tiles, and no task compares more at once."""
    want = sorted(map(tuple, QUERIES[name](spark, FOLDER).collect()))
    take = lanes.Nearest.take

    def held(self, first, away, ids, *tag):
        if away.shape[0] > 8 or away.shape[1] > 16:
            raise ValueError(away.shape)
        return take(self, first, away, ids, *tag)

    monkeypatch.setattr(lanes, "TILE", (8, 16))
    monkeypatch.setattr(lanes.Nearest, "take", held)
    assert want and sorted(map(tuple, QUERIES[name](spark, FOLDER).collect())) == want


@pytest.mark.parametrize("k", [6, 20, 31])
def test_memory_of_a_task_is_bounded(spark, k):
    """A whole block of questions and full Arrow batches meet in one task of dm8_context, st4_multi_query (20) and sc8_mmr (31) within 100 MB."""
    v = np.random.default_rng(8).normal(size=(10_000, 16))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(np.ones(10_000, dtype=np.int64)), pa.array(list(v), pa.list_(pa.float64()))], ["id", "seen", "embedding"])
    tasks = []
    rows = type("Rows", (), {"mapInArrow": lambda self, run, schema: (tasks.append(run), spark.createDataFrame([], schema))[1]})()
    lanes.closest(rows, [(i, 0, v[i].tolist()) for i in range(lanes.ASKED)], k)
    tracemalloc.start()
    found = sum(b.num_rows for b in tasks[0](iter([batch, batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == lanes.ASKED * k and peak < 100e6
