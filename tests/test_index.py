"""The inverted and the vector index against brute force."""

import math
import re

import pytest
from pyspark.sql import functions as F

from tempofact.functions.text import STOP_WORDS, SUFFIXES
from tempofact.operators import ann, inverted, lanes

FOLDER = "/root/testdata/sf0.001"
TEXTS = [(1, "red house near the red river", ["home", "red"], "Ann"), (2, "a river of houses; red", None, "House"), (3, None, ["red", "house"], None), (4, "", [], ""), (5, "house " * 400 + "red", [], None), (6, "red " + "x " * 30 + "house", ["river"], None), (None, "red house", [], None)]


@pytest.fixture(scope="module")
def index(spark):
    return inverted.build(spark.createDataFrame(TEXTS, "id bigint, content string, tags array<string>, entity string"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.array("lang", "source").alias("tags"), F.col("source").alias("entity"))


@pytest.fixture(scope="module")
def built(docs):
    return inverted.build(docs)


def stemmed(w):
    return next((w[: -len(s)] for s in SUFFIXES if w.endswith(s) and len(w) - len(s) >= 4), w)


def by_hand(texts, query):
    """Cover density over plain lists."""
    wanted = {stemmed(w.lower()) for w in query if w.lower() not in STOP_WORDS}
    out = {}
    for i, content, tags, entity in texts:
        words = [(w, k) for k, t in (("A", content), ("B", " ".join(x for x in tags or [] if x)), ("C", entity)) for w in re.findall(r"[^\W_]+", (t or "").lower())]
        at = [(p, stemmed(w), inverted.WEIGHTS[k]) for p, (w, k) in enumerate(words, 1) if w not in STOP_WORDS and stemmed(w) in wanted]
        spans = [(a, b) for a in range(len(at)) for b in range(a, len(at)) if {x[1] for x in at[a : b + 1]} == wanted]
        least = [(a, b) for a, b in spans if not any(a <= c and d <= b and (a, b) != (c, d) for c, d in spans)]
        rank = sum((b - a + 1) / sum(1 / at[j][2] for j in range(a, b + 1)) / (1 + at[b][0] - at[a][0] - (b - a)) for a, b in least)
        if least and i is not None:
            out[i] = rank
    return out


@pytest.mark.parametrize("query", [["red", "house"], ["Houses", "the", "river"], ["red"], ["river", "red", "house"], ["absent", "red"]])
def test_cover_density(index, query):
    got = {r.id: r["rank"] for r in inverted.ranked_top_k(index, query).collect()}
    assert got == {i: pytest.approx(x, abs=1e-6) for i, x in by_hand(TEXTS, query).items()}


def test_empty_queries(index):
    assert inverted.ranked_top_k(index, []).count() == inverted.ranked_top_k(index, ["the", "of"]).count() == inverted.okapi_top_k(index, []).count() == inverted.okapi_top_k(index, ["absent"]).count() == 0


def test_cover_density_of_a_table(docs, built):
    rows = [tuple(r) for r in docs.collect()]
    want = by_hand(rows, ["the", "tion", "thing"])
    got = {r.id: r["rank"] for r in inverted.ranked_top_k(built, ["the", "tion", "thing"], k=10_000).collect()}
    assert got == {i: pytest.approx(x, abs=1e-5) for i, x in want.items()} and len(got) > 3


@pytest.mark.parametrize("k", [1, 7, 500])
def test_okapi_skips_blocks_and_loses_nothing(docs, built, k):
    for terms in (["the", "and"], ["tion"], ["the", "absent", "que", "die"]):
        want = [(r.id, pytest.approx(r.bm25, abs=1e-9)) for r in lanes.keyword_top_k(docs, terms, k, "id", "content").orderBy(F.round("bm25", 9).desc(), "id").collect()]
        got = [(r.id, r.bm25) for r in inverted.okapi_top_k(built, terms, k).orderBy(F.round("bm25", 9).desc(), "id").collect()]
        assert [b for _, b in got] == [b for _, b in want]
        seen = docs.where("id % 3 = 0").select("id")
        want = {r.id: pytest.approx(r.bm25, abs=1e-9) for r in lanes.keyword_top_k(docs.join(seen, "id", "left_semi"), terms, 500, "id", "content").collect()}
        assert {r.id: r.bm25 for r in inverted.okapi_top_k(built, terms, 500, seen).collect()} == want


def test_only_the_buckets_of_the_query_are_read(index):
    plan = index.read("words", ["red"])._jdf.queryExecution().executedPlan().toString()
    bucket = index.spark.range(1).select(inverted.bucket_of(F.lit("red"))).first()[0]
    assert "bucket#" in plan and f"= {bucket}" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "EqualTo(term,red)" in plan.split("PushedFilters")[1] or "In(term" in plan.split("PushedFilters")[1]


def test_ann_odd_rows(spark):
    rows = [(i, [math.cos(i), math.sin(i), 0.5]) for i in range(200)] + [(300, None), (301, [0.0, 0.0, 0.0]), (302, [1.0]), (303, [float("nan"), 1.0, 1.0]), (None, [1.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    built = ann.build(table, cells=16)
    assert built.read("rows").count() == 200
    asked = spark.createDataFrame([(0, [1.0, 0.0, 0.5]), (1000, None), (1001, [0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0])], "query_id bigint, query array<double>")
    got = ann.search(built, asked, 5).collect()
    exact = lanes.batch_top_k(table, asked, 5).collect()
    assert {r.query_id for r in got} == {0} and len({r.id for r in got} & {r.id for r in exact if r.query_id == 0}) >= 4
    none = ann.build(table.limit(0))
    assert ann.search(none, asked, 5).count() == 0


def test_batch_top_k_ties_and_odd_vectors(spark):
    table = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40, 0, -1)] + [(50, [0.0, 1.0]), (51, None), (52, [0.0, 0.0]), (53, [1.0, 2.0, 3.0])], "vec_id bigint, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id bigint, query array<double>")
    got = [tuple(r) for r in lanes.batch_top_k(table, asked, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2, 0.0, 1), (1, 3, 0.0, 2), (1, 4, 0.0, 3)]
