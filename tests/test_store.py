"""The store as a data source, and the loaders of files."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, StringStartsWith

from tempofact.schemas import MEMORY, struct
from tempofact.sources import io, store
from tempofact.streaming import jobs


def facts(spark, rows):
    """rows of (id, namespace, day)."""
    s = spark.createDataFrame(rows, "id bigint, namespace string, t_created timestamp_ntz")
    return s.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in s.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in struct(MEMORY)])


def day(n):
    import datetime

    return datetime.datetime(2024, 1, n)


ROWS = [(i, ("a", "b", "", None)[i % 4], day(i % 20 + 1)) for i in range(200)] + [(None, "a", None), (7, "b", day(8))]


@pytest.fixture
def path(spark, tmp_path):
    p = f"file://{tmp_path}/log"
    store.append(facts(spark, ROWS[:90]), p)
    store.append(facts(spark, ROWS[90:]), p)
    return p


def ids(df):
    return sorted((r[0] is None, r[0] or 0) for r in df.select("id").collect())


@pytest.mark.parametrize("rule", [
    "namespace = 'a'", "namespace IN ('a', 'b') AND t_created >= TIMESTAMP_NTZ '2024-01-08'", "namespace IS NULL", "namespace = ''", "namespace IS NOT NULL AND id > 50 AND id <= 120",
    "namespace = 'a' AND namespace = 'b'", "namespace LIKE 'a%'", "namespace <=> NULL", "namespace = 'none'", "id IN (3, 7, NULL)", "NOT id = 7", "user_id IS NULL", "id = 7 OR namespace = 'a'",
])
def test_filters_equal_plain_rows(spark, path, rule):
    assert ids(store.read(spark, path).where(rule)) == ids(facts(spark, ROWS).where(rule))


def test_filters_reach_the_files(spark, path, capsys):
    store.read(spark, path).where("namespace = 'a' AND t_created <= TIMESTAMP_NTZ '2024-01-06' AND confidence > 0.5").explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "EqualTo(namespace,a)" in pushed and "LessThanOrEqual(t_created" in pushed and "confidence" not in pushed.replace("IsNotNull(confidence)", "")


def test_partitions_by_namespace(path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("namespace", T.StringType()), T.StructField("id", T.LongType()), T.StructField("confidence", T.DoubleType())])
    every = store.StoreReader(path, schema)
    assert list(every.pushFilters([GreaterThan(("confidence",), 0.5), EqualTo(("namespace",), None), EqualTo(("tags", "x"), 1)])) and every.buckets is None
    some = store.StoreReader(path, schema)
    assert list(some.pushFilters([In(("namespace",), ("a", "b")), EqualTo(("namespace",), "a"), StringStartsWith(("namespace",), "a"), IsNull(("id",))])) == []
    assert some.buckets == {store.bucket_of("a")} and 0 < len(some.partitions()) < len(every.partitions())
    got = [r for p in some.partitions() for batch in some.read(p) for r in batch.to_pylist()]
    assert got == [{"namespace": "a", "id": None, "confidence": None}]


def test_slices_share_row_groups(spark, tmp_path, monkeypatch):
    p = f"file://{tmp_path}/log"
    rows = facts(spark, [(i, "a", day(1)) for i in range(30_000)])
    spark.conf.set("parquet.block.size", 1 << 14)
    try:
        store.append(rows.coalesce(1), p)
    finally:
        spark.conf.unset("parquet.block.size")
    monkeypatch.setattr(store, "SLICE", 1 << 12)
    reader = store.StoreReader(p, struct("id bigint"))
    parts = reader.partitions()
    got = [v for s in parts for batch in reader.read(s) for v in batch.column(0).to_pylist()]
    assert any(s.parts > 1 for s in parts) and sorted(got) == list(range(30_000))


def test_unfinished_commits_do_not_count(spark, path, tmp_path):
    store.append(facts(spark, [(999, "a", day(1))]), path)
    (tmp_path / "log" / "commit-00000002" / "_SUCCESS").unlink()
    assert len(store.committed(path)) == 2 and store.read(spark, path).where("id = 999").isEmpty()
    with pytest.raises(Exception, match="(?i)exist"):
        store.append(facts(spark, [(1000, "a", day(1))]), path)


def test_empty_and_foreign_tables(spark, tmp_path):
    p = f"file://{tmp_path}/empty"
    assert store.read(spark, p).count() == 0
    store.append(facts(spark, []), p)
    assert len(store.committed(p)) == 1 and store.read(spark, p).count() == 0
    with pytest.raises(ValueError, match="not a table of edges"):
        store.append(facts(spark, []), p, "edges")
    store.append(facts(spark, ROWS).withColumn("bucket", F.lit("mine")), p)
    assert store.read(spark, p).count() == len(ROWS)


def test_stream_takes_each_commit_once(spark, path, tmp_path):
    out, ck = f"{tmp_path}/out", f"{tmp_path}/ck"

    def run():
        q = store.read_stream(spark, path, columns=["id"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return ids(spark.read.parquet(out))

    assert run() == ids(facts(spark, ROWS))
    store.append(facts(spark, [(500, "a", day(1))]), path)
    assert run() == sorted([*ids(facts(spark, ROWS)), (False, 500)]) == run()
    assert jobs.run_available(store.read_stream(spark, path)).count() == len(ROWS) + 1


def test_strict_cases(spark, tmp_path):
    def lines(*rows):
        f = tmp_path / f"c{len(list(tmp_path.iterdir()))}.json"
        f.write_text("".join(r + "\n" for r in rows))
        return io.read_cases(spark, str(f), "id bigint not null, q string")

    assert [tuple(r) for r in lines('{"id": 1, "q": "x"}', '{"id": 2}').orderBy("id").collect()] == [(1, "x"), (2, None)]
    for bad in ('{"id": 1, "z": 2}', '{"q": "x"}', "{broken", "[1]", '{"id": null}', '{"id": "text"}', ""):
        with pytest.raises(Exception, match="(?i)case|malformed"):
            lines(bad).collect()


def test_trend_file(spark, tmp_path):
    p = f"{tmp_path}/trend"
    assert io.read_trend(spark, p).count() == 0
    row = lambda sha, score: spark.createDataFrame([("t", sha, "v", "c", score, "x" if sha == "b" else "2")], io.TREND)
    io.append_trend(row("a", "0.5"), p)
    io.append_trend(row("b", "n/a"), p)
    assert sorted((r.sha, r.score, r.n) for r in io.read_trend(spark, p).collect()) == [("a", 0.5, 2), ("b", 0.0, 0)]


def test_examples(spark, tmp_path):
    rows = spark.createDataFrame([("c1", ["q1", "q2"], [["a", "b"], ["c"]]), ("c2", [], [])], "context string, questions array<string>, answers array<array<string>>")
    rows.write.parquet(f"{tmp_path}/one")
    got = io.examples(spark, str(tmp_path), {"X": "one", "Y": "absent"})
    assert got.count() == 2 and got.where("size(metadata) > 0").isEmpty() and io.examples(spark, str(tmp_path), {"X": "one"}, 1).count() == 1
    flat = sorted((r.category, r.pos, r.question, r.accepted) for r in io.example_questions(got).collect())
    assert flat == [("X", 0, "q1", ["a", "b"]), ("X", 1, "q2", ["c"])]


def test_import_of_arrays_and_lines(spark, tmp_path):
    rows = [{"id": "2", "content": "x"}, {"id": "1", "content": " x "}, {"id": "", "content": "y", "tags": ["t"]}, {"id": "9", "content": "old"}, {"id": "4"}]
    (tmp_path / "array.json").write_text(json.dumps(rows))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    old = spark.createDataFrame([("old",)], "content string")
    for name, lines in (("array", False), ("lines", True)):
        got = {r.content.strip(): (r.id, r.category) for r in io.import_json(spark, f"{tmp_path}/{name}.json", old, lines).collect()}
        assert got["x"] == ("1", "general") and len(got["y"][0]) == 12 and set(got) == {"x", "y"}


def test_consolidation_of_a_batch(spark):
    """Copies are no news, the nearest of a subject gives way, a fact without a subject meets its category, episodes without facts are done."""
    from tempofact.operators import dml

    when = F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")
    memory = "id bigint, content string, category string, entity string, confidence double, status string, valid_from timestamp_ntz, t_created timestamp_ntz, valid_until timestamp_ntz, superseded_by bigint, metadata map<string,string>"
    old = spark.createDataFrame([(i, f"text {i}", "c", "E", 0.9, "active", day(i), day(i), None, None, None) for i in range(1, 9)], memory)
    queue = spark.createDataFrame([(i, "pending", day(i), None, None) for i in range(1, 6)], "id bigint, state string, created_at timestamp_ntz, claimed_at timestamp_ntz, error string")
    facts = spark.createDataFrame([(101, 1, " text 5 ", "c", "E", 0.7), (102, 1, "text 2", "c", "E", 0.7), (103, 2, "own", "c", None, 0.7), (104, 2, "other", "d", "E", 0.7), (105, 2, None, "c", "E", 0.7), (109, 5, "late", "c", "E", 0.7)], "id bigint, episode bigint, content string, category string, entity string, confidence double")
    after, states = dml.consolidate(queue, facts, old, when, "m", batch=3)
    rows = {r.id: r for r in after.collect()}
    assert set(rows) == {*range(1, 9), 102, 103, 104, 105}  # text 2 isn't among the five latest
    assert rows[8].status == "superseded" and rows[8].superseded_by == 105 and all(rows[i].status == "active" for i in range(1, 8))
    assert rows[104].metadata == {"extraction_model": "consolidation:m"} and rows[1].metadata is None
    assert {r.id: r.state for r in states.collect()} == {1: "done", 2: "done", 3: "done", 4: "pending", 5: "pending"}
    empty, none = dml.consolidate(queue.limit(0), facts, old, when)
    assert empty.count() == 8 and none.count() == 0
