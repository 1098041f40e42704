"""Operators on small hand-made tables, and against plain Python."""

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tempofact.functions import chunks, dates, jsonfn
from tempofact.functions import text as t
from tempofact.operators import bitemporal as b
from tempofact.operators import ann, dml, fusion, governance, graph, lanes, matching, metrics, scoring
from tempofact.sources import io
from tempofact.sources.fixtures import ts

T0, T1 = datetime(2026, 1, 1, 12), datetime(2026, 4, 1, 12)


@pytest.fixture()
def pair(spark):
    schema = "id bigint, content string, status string, valid_from timestamp_ntz, valid_until timestamp_ntz, t_created timestamp_ntz, t_expired timestamp_ntz"
    return spark.createDataFrame([(1, "user lives in NYC", "superseded", T0, T1, T0, T1), (2, "user lives in SF", "active", T1, None, T1, None)], schema)


@pytest.mark.parametrize(("at", "want"), [("2025-12-31 00:00:00", []), ("2026-01-01 12:00:00", [1]), ("2026-03-31 00:00:00", [1]), ("2026-04-01 12:00:00", [2]), ("2027-01-01 00:00:00", [2])])
def test_as_of_is_half_open(pair, at, want):
    assert [r.id for r in pair.where(b.as_of(ts(at))).collect()] == want


def test_overlap_bounds(pair):
    ids = lambda p: sorted(r.id for r in pair.where(p).collect())
    assert ids(b.overlaps(None, None)) == [1, 2]
    assert ids(b.overlaps(ts("2026-04-01 12:00:00"), None)) == [2]
    assert ids(b.overlaps(None, ts("2026-04-01 12:00:00"))) == [1]
    assert ids(b.overlaps(ts("2026-02-01 00:00:00"), ts("2026-02-01 00:00:00"))) == []


def test_tenant_without_user_sees_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, user_id string")
    assert b.TenantView(df, None).rows().count() == 0
    assert [r.id for r in b.TenantView(df, "a").rows().collect()] == [1]
    with pytest.raises(Exception, match="another user"):
        b.TenantView(df, "a").checked(df).collect()


def test_rrf_of_lists(spark):
    lanes_df = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 1, 4), (1, 2, 2), (1, 3, 5), (1, 4, None)], "lane int, rank bigint, id bigint")
    got = fusion.rrf(lanes_df).orderBy(F.desc("rrf_score"), "first").collect()
    assert got[0].id == 2 and got[0].ranks == [2, 2] and len(got) == 5
    assert [r.id for r in fusion.union_merge(lanes_df).orderBy("pos").collect()] == [1, 2, 3, 4, 5]
    assert fusion.rrf(lanes_df, limit=2).count() == 2


def test_scores(spark):
    row = spark.createDataFrame([("Alice", "x", 0.5), ("other", "has Alice here", 0.5), ("Bob", "no", 0.5), (None, "Alice", 0.5)], "entity string, content string, score double")
    got = [r[0] for r in row.select(F.round(F.col("score") + F.coalesce(scoring.entity_boost(F.col("entity"), F.col("content"), ["Alice", "am"]), F.lit(0.0)), 4)).collect()]
    assert got == [0.8, 0.65, 0.5, 0.65]
    conf = spark.createDataFrame([(1.0, 10, T1, T1), (1.0, 0, T0, datetime(2026, 1, 22, 8)), (1.0, 0, T0, datetime(2027, 1, 1))], "c double, n int, last timestamp_ntz, now timestamp_ntz")
    got = [round(r[0], 2) for r in conf.select(scoring.decayed_confidence(F.col("c"), F.col("n"), F.col("last"), F.col("now"))).collect()]
    assert got == [1.0, 0.5, 0.1]


def test_pack_skips_and_always_takes_one(spark):
    df = spark.createDataFrame([([(1, 10, 50), (2, 11, 60), (3, 12, 40)],), ([(1, 10, 500)],)], "items array<struct<rn:int,id:int,cost:bigint>>")
    got = [[x.id for x in r[0]] for r in df.select(scoring.greedy_pack(F.col("items"), F.lit(100))).collect()]
    assert got == [[10, 12], [10]]


def test_mmr_prefers_other_words(spark):
    rows = [(1, 1, 0.9, ["a", "b"]), (1, 2, 0.89, ["a", "b"]), (1, 3, 0.7, ["c"])]
    got = scoring.mmr(spark.createDataFrame(rows, "query_id bigint, id bigint, score double, words array<string>"), lam=0.5, most=2).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 3]


def test_as_of_join(spark):
    facts = spark.createDataFrame([("k", 1, "a"), ("k", 5, "b"), ("j", 2, "c")], "k string, valid_from int, v string")
    points = spark.createDataFrame([("k", 0), ("k", 1), ("k", 4), ("k", 9), ("z", 1)], "k string, at int")
    got = {(r.k, r.at): r.fact_v for r in b.as_of_join(points, facts, ["k"]).collect()}
    assert got == {("k", 0): None, ("k", 1): "a", ("k", 4): "a", ("k", 9): "b", ("z", 1): None}


def test_chain_stops_at_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 9)], "id bigint, superseded_by bigint")
    got = sorted((r.start, r.step, r.id) for r in b.chain(df, df.where("id IN (1, 4)"), depth=10).collect())
    assert got == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (4, 0, 4)]


def test_ann_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    qs = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = {(r.query_id, r.id) for r in lanes.batch_top_k(e, qs, 10).collect()}
    near = {(r.query_id, r.id) for r in ann.search(ann.build(e), qs, 10).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_pagerank_of_a_chain(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    got = {r.key: round(r["rank"], 6) for r in graph.pagerank(edges, nodes, rounds=10).collect()}
    assert got == {"a": 0.15, "b": round(0.15 + 0.85 * 0.15, 6), "c": round(0.15 + 0.85 * (0.15 + 0.85 * 0.15), 6)}


def test_decisions_without_target_are_errors(spark):
    m = spark.createDataFrame([(1, "x", "c", "e", 0.5, "active", T0, T0, None, None)], "id bigint, content string, category string, entity string, confidence double, status string, valid_from timestamp_ntz, t_created timestamp_ntz, valid_until timestamp_ntz, superseded_by bigint")
    d = spark.createDataFrame([(10, "UPDATE", 1, "y", "c", "e", 0.9), (11, "INVALIDATE", 7, "z", "c", "e", 0.1), (12, "ADD", None, "w", "c", "e", 0.3), (13, "NOOP", 1, "x", "c", "e", 0.3)], "new_id bigint, op string, target bigint, content string, category string, entity string, confidence double")
    after, log = dml.apply_decisions(m, d, ts("2026-05-01 00:00:00"))
    assert {r.new_id: r.op for r in log.collect()} == {10: "UPDATE", 11: "ERROR", 12: "ADD", 13: "NOOP"}
    assert sorted((r.id, r.content, r.confidence) for r in after.collect()) == [(1, "y", 0.9), (12, "w", 0.3)]


def test_quota(spark):
    used = spark.createDataFrame([("a", 5, 1), ("b", 4, 9), ("c", 9, 9)], "user_id string, memory_count bigint, writes_today bigint")
    lim = spark.createDataFrame([("a", 5, None), ("b", 5, 3)], "user_id string, max_memories bigint, max_writes_per_day bigint")
    assert {r.user_id: (r.exceeded, r.remaining) for r in governance.quota_check(used, lim).collect()} == {"a": ("max_memories", None), "b": ("max_writes_per_day", 0), "c": (None, None)}


def test_chunks_hold_all_words():
    text = "First sentence here. Second one is longer than that. " * 20 + "word " * 300
    for overlap in (0, 10):
        parts = chunks.chunk(text, 40, overlap)
        assert all(chunks.tokens(p) <= 40 for p in parts)
        if not overlap:
            assert " ".join(parts).split() == text.split()
    assert chunks.chunk(None, 10) == []


def test_relative_dates():
    today = date(2024, 2, 1)
    assert dates.window_of("we met two weeks ago, or yesterday", today) == (date(2024, 1, 17), date(2024, 1, 20))
    assert dates.window_of("last thursday", today) == (date(2024, 1, 24), date(2024, 1, 27))
    assert dates.window_of("in the past 3 days", today) == (date(2024, 1, 29), date(2024, 2, 2))
    assert dates.window_of(None, today) is None


def test_redaction_and_labels(spark):
    df = spark.createDataFrame([("MY_API_KEY=abc123 and Bearer abcdefghijk and sk-abcdefghijklmnop",), ('token = "abc"',)], "x string")
    got = [r[0] for r in df.select(t.redact(F.col("x"))).collect()]
    assert got == ["MY_API_KEY=[REDACTED] and Bearer [REDACTED] and [REDACTED]", 'token = "[REDACTED]"']
    df = spark.createDataFrame([("CORRECT, no: wrong",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(t.judge_label(F.col("x"))).collect()] == ["WRONG", "WRONG", "WRONG"]


def test_tolerant_json(spark):
    df = spark.createDataFrame([('```json\n{"decisions":[{"op":"add","id":null}]}\n```',), ("[]",), ("oops",), (None,)], "x string")
    assert [len(r[0]) for r in df.select(jsonfn.parse_list(F.col("x"), jsonfn.DECISION)).collect()] == [1, 0, 0, 0]


def test_json_import_and_export(spark, tmp_path):
    src = tmp_path / "in.json"
    src.write_text(json.dumps([{"id": "a", "content": "one"}, {"content": " one "}, {"id": "", "content": "two"}, {"id": "c"}]))
    have = spark.createDataFrame([("zero",)], "content string")
    got = io.import_json(spark, str(src), have)
    assert sorted(r.content.strip() for r in got.collect()) == ["one", "two"]
    io.export_json(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    io.export_csv(got, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_trend_and_summaries(spark, tmp_path):
    assert io.read_trend(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "t.csv").write_text("timestamp,sha,variant,category,score,n\n1,a,v,c,7.5,3\n2,a,v,c,bad,\n")
    assert [(r.score, r.n) for r in io.read_trend(spark, str(tmp_path / "t.csv")).orderBy("timestamp").collect()] == [(7.5, 3), (0.0, 0)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a_summary.json").write_text('{"benchmark":"x","primary":1.5,"total":2,"per_category":{"k":1.0}}')
    (tmp_path / "s/b_summary.json").write_text("{oops")
    assert io.read_summaries(spark, str(tmp_path / "s")).count() == 1


def test_benchmark_loaders(spark, tmp_path):
    p = tmp_path / "l.json"
    p.write_text(json.dumps([{"question_id": "q", "question": "?", "answer": "a", "haystack_dates": ["d"], "haystack_session_ids": ["s"], "haystack_sessions": [[{"role": "user", "content": "hi"}, {"speaker": "bot", "text": "yo"}]]}]))
    assert [(r.session_id, r.role, r.content) for r in io.long_qa(spark, str(p)).orderBy("turn").collect()] == [("s", "user", "hi"), ("s", "bot", "yo")]
    p = tmp_path / "d.json"
    p.write_text(json.dumps([{"sample_id": "x", "conversation": {"session_1": [{"speaker": "A", "text": "t"}], "session_1_date": "d"}, "qa": [{"question": "q1", "answer": "a", "category": 1}, {"question": "q2", "answer": "a", "category": 5}]}]))
    turns, qa = io.dialogue_qa(spark, str(p))
    assert [(r.session, r.text) for r in turns.collect()] == [(1, "t")]
    assert [r.question for r in qa.collect()] == ["q1"]
    assert io.capped_questions(qa, 1, 1).count() == 1
    with pytest.raises(ValueError, match="does not fit"):
        io.cases(spark, [{"id": 1, "oops": 2}], "id int")


def test_embedder_and_trace(spark, tmp_path):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "x string").select(io.hashing_embedder(8)("x").alias("v"))
    assert [len(r.v) for r in df.collect()] == [8, 8, 8]
    ev = spark.createDataFrame([("r", 1, 1, "Bearer abcdefghijk"), ("r", 2, 2, "ok")], "recall_id string, ts int, event_id int, payload string")
    io.trace_sink(ev, str(tmp_path / "t"))
    got = spark.read.json(str(tmp_path / "t")).orderBy("seq").collect()
    assert [r.seq for r in got] == [1, 2] and "abcdefghijk" not in got[0].payload


def test_streams_equal_batches(spark):
    from tempofact.streaming import jobs

    seen = []
    jobs.consolidate(jobs.source(spark, "/root/testdata/sf0.001", "conversations"), lambda df, n: seen.append(df.count())).awaitTermination()
    assert sum(seen) == spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").count()


def test_groups_of_skeletons_and_orders_are_not_gathered(spark, tmp_path):
    from tempofact.plans import text

    rows = [(i, "The same text of a hot group", "en", "a") for i in range(1000, 1200)] + [(1, "Only one of its kind here", "en", "a"), (2, "The same text of a hot group", "de", "a"), (3, "short", "en", "a"), (4, "short", "en", "a")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "1996-01-03"), (1, "1995-12-31"), (2, "1996-01-01")], "o_custkey bigint, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    got, days = text.jn7_skeleton(spark, str(tmp_path)), text.dt7_durations(spark, str(tmp_path))
    assert {r.a: r.b for r in got.collect()} == {i: 1001 if i == 1000 else 1000 for i in range(1000, 1200)} and got.count() == 200
    assert {r.id: r.days for r in days.collect()} == {1: 3, 2: 0}
    for df in (got, days):
        assert "collect_" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_item_matches_finds_every_substring(spark):
    docs = ["The cat sat on the mat, purring loudly", "xa b c dy", "x  y", "", None, "ends with the cat sat", "AN answer"]
    items = ["cat sat on the mat, purr", "a b c d", "b c", "  ", "", None, "he cat sat", "sat cat", "answer", "on the mat, purring loudly!", "zz zz zz zz zz zz zz zz"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id bigint, gold string")
    got = {r.item_id: (r.exact, r.inside) for r in matching.item_matches(d, i).collect()}
    inside = [g is not None and any(g.lower() in x.lower() for x in docs if x is not None) for g in items]
    assert got == {k: (k in (3, 4, 8), inside[k]) for k in range(len(items))}


def test_shared_words(spark):
    w = spark.createDataFrame([(0, ["a", "b"]), (1, ["b", "c"]), (2, ["d"]), (20, ["a", "b"]), (21, [])], "id bigint, words array<string>")
    got = {(r.a, r.b): round(r.j, 4) for r in matching.shared_words(w.where("id % 20 = 0"), w).collect()}
    assert got == {(0, 1): 0.3333, (0, 20): 1.0, (20, 0): 1.0, (20, 1): 0.3333}


@pytest.mark.parametrize("block", [1, 3, 500])
def test_pack_equals_greedy_walk(spark, block):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), n, rng.choice([0, 1, 5, 30, 70, 200])) for n in range(120)]
    df = spark.createDataFrame(rows, "k string, n int, cost int")
    got = {(r.k, r.n) for r in scoring.pack(df, ["k"], [F.col("n")], F.col("cost"), F.lit(150), block=block).collect()}
    want, used = set(), {}
    for k, n, cost in rows:
        if k not in used or used[k] + cost <= 150:
            used[k] = used.get(k, 0) + cost
            want.add((k, n))
    assert got == want


def test_late_facts_are_put_between_their_neighbours(spark, tmp_path):
    from tempofact.streaming import jobs

    schema = "entity string, category string, namespace string, id bigint, valid_from timestamp_ntz"
    day = lambda m, d: datetime(2024, m, d)
    batches = [[("e", "c", "n", 1, day(1, 1)), ("e", "c", "other", 9, day(1, 5)), ("e", "c", None, 7, day(1, 1))], [("e", "c", "n", 2, day(3, 1)), ("e", "c", None, 8, day(1, 2))], [("e", "c", "n", 3, day(2, 1))], [("e", "c", "n", 4, day(1, 15)), ("f", "c", "n", 5, day(1, 1))]]
    source, files = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:  # one run a file: later facts come in later micro-batches
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.supersessions(spark.readStream.schema(schema).parquet(source), files).awaitTermination()
    got = {r.id: (r.closed, r.by) for r in jobs.closed_facts(spark, files, spark.read.parquet(source).schema).collect()}
    assert got == {1: (day(1, 15), 4), 4: (day(2, 1), 3), 3: (day(3, 1), 2), 7: (day(1, 2), 8)}


def test_contradiction_links_equal_all_pairs(spark):
    rows = [(n, "e" if n % 4 else None, f"c{n % 2}", "ns", f" t{n % 3} " if n % 5 else f"t{n % 3}", "active", None) for n in range(40)]
    df = spark.createDataFrame(rows, "id bigint, entity string, category string, namespace string, content string, status string, valid_until timestamp_ntz")
    got = {r.new_id: (r.links, r.old_id) for r in b.contradictions_by_entity(df, df).collect()}
    want = {}
    for x in rows:
        other = [y[0] for y in rows if x[1] and y[1] == x[1] and y[2] == x[2] and y[4].strip() != x[4].strip()]
        if other:
            want[x[0]] = (len(other), min(other))
    assert got == want


def test_topic_links_equal_all_pairs(spark):
    from tempofact.operators.matching import topic_links

    rng = random.Random(5)
    facts = []
    for n in range(60):
        topics = sorted(rng.sample(["loan", "house", "run", "bank", "tree", "city", "car"], rng.randint(0, 5)))
        text = f"{' '.join(topics)} {rng.choice(['', 'was', '  '])}"
        skeleton = rng.choice(["s1", "s2", text.strip().lower(), f"own {n}"])
        active = rng.random() < 0.8
        facts.append((n, rng.choice(["c", "d", None]), rng.choice(["n", None]), text, skeleton, topics, active, active and rng.random() < 0.8))
    df = spark.createDataFrame(facts, "id bigint, category string, namespace string, content string, skeleton string, topics array<string>, active boolean, open boolean")
    want = {}
    for a in facts:
        scope = [b for b in facts if b[0] != a[0] and b[1:3] == a[1:3]]
        twin = a[4] != a[3].strip().lower() and any(b[6] and b[4] == a[4] for b in scope)
        links = sum(b[7] and bool(set(a[5]) & set(b[5])) and b[3].strip() != a[3].strip() for b in scope)
        if links and not twin:
            want[a[0]] = links
    assert want and {r.id: r.links for r in topic_links(df).collect()} == want
    assert topic_links(df.limit(0)).count() == 0


def test_topics_are_near_values():
    assert chunks.topics("The bank approved my mortgage loan of $250k yesterday in town") == ["loan", "town", "mortgage", "approv", "bank"]
    assert chunks.topics("I ran the trail at 25:50 minutes") == ["minut", "trail"]
    assert chunks.topics("chapter 12 of the novel") == chunks.topics(None) == chunks.topics("") == []
    long = "word " * 200_000 + "cost $5"
    assert chunks.topics(long) == ["cost", "word"]


@pytest.mark.parametrize(
    "text, back",
    [("the day before yesterday", 2), ("a week ago", 7), ("An year  ago", 365), ("this morning", 0), ("five months after", -150), ("how many days since", 3), ("how long since then", 90), ("Last Tuesday", 2), ("last month or yesterday", 30)],
)
def test_phrases_that_are_understood(text, back):
    today, day = date(2024, 2, 1), timedelta(days=1)
    assert dates.window_of(text, today, 0) == (today - back * day, today - back * day + day)


def test_phrases_that_are_not():
    assert all(dates.window_of(x, date(2024, 2, 1)) is None for x in ("", "ago", "lastly monday", "99999999999 years ago", "many days"))


def test_skeleton_forms(spark):
    x = spark.createDataFrame([("Paid $5,000 and [2024-01-02 x] ran  3.5 KM",), ("fact 1",), ("5 mägde, 5 m",)], "t string")
    assert [r[0] for r in x.select(t.skeleton(F.col("t"))).collect()] == ["paid NUMand ran NUM", "fact 1", "5 mägde, NUM"]
    words = spark.createDataFrame([("Approval'",), ("-Stations-",), ("goes",), (None,)], "w string")
    assert [r[0] for r in words.select(t.stem(F.col("w"))).collect()] == ["approv", "station", "goes", None]


def test_counters_by_deltas(spark):
    at = lambda d, h=0: datetime(2024, 1, d, h)
    now = spark.createDataFrame([("a", 5, 2, date(2024, 1, 3)), ("b", 1, 1, date(2024, 1, 3)), ("c", 0, 0, None)], "user_id string, memory_count bigint, writes_today bigint, day date")
    rows = [("a", "insert", at(3, 5)), ("a", "delete", at(4)), ("b", "insert", at(4)), ("b", "insert", at(4, 2)), ("b", "insert", at(2)), ("b", "delete", None), ("c", "delete", at(1)), ("d", "insert", at(1)), ("e", "update", at(9)), (None, "insert", at(1))]
    got = {r.user_id: (r.memory_count, r.writes_today, r.day) for r in governance.maintained(now, spark.createDataFrame(rows, "user_id string, op string, at timestamp_ntz")).collect()}
    assert got == {"a": (5, 3, date(2024, 1, 3)), "b": (3, 2, date(2024, 1, 4)), "c": (0, 0, None), "d": (1, 1, date(2024, 1, 1))}


def test_judge_pick_falls_back_to_the_majority(spark):
    rows = [("q", 2, "Yes"), ("q", 1, "no"), ("q", 3, " yes "), ("far", 1, "x"), ("bad", 1, "b"), ("bad", 0, "a"), ("none", 1, None), ("none", 2, " ")]
    judge = lambda q, answers: {"q": 0, "far": 5}.get(q) if q != "bad" else 1 / 0
    df = spark.createDataFrame(rows, "question string, pos int, answer string")
    got = {r.question: (r.chosen, r.voter) for r in metrics.judge_pick(df, judge).collect()}
    assert got == {"q": ("no", "judge_pick"), "far": ("x", "majority"), "bad": ("a", "majority")}
    assert {r.question: r.chosen for r in metrics.judge_pick(df, lambda q, a: -1).collect()}["q"] == "Yes"


def test_pagerank_on_a_cycle_and_a_tail(spark):
    """Equal to rounds by hand, whether or not ranks come to rest."""
    from tempofact.operators import graph

    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("e", "a"), ("e", "a")]
    edges, nodes = spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([(k,) for k in "abcdef"], "key string")
    for rounds, every in ((4, 5), (20, 5)):
        ranks = dict.fromkeys("abcdef", 0.15)
        for _ in range(rounds):
            got = dict.fromkeys("abcdef", 0.0)
            for s, d in pairs:
                got[d] += ranks[s] / sum(1 for x, _ in pairs if x == s)
            ranks = {k: 0.15 + 0.85 * v for k, v in got.items()}
        have = {r.key: r.rank for r in graph.pagerank(edges, nodes, rounds=rounds, every=every).collect()}
        assert have.keys() == ranks.keys() and all(abs(have[k] - ranks[k]) < 1e-9 for k in ranks)
    rest = spark.createDataFrame([("a", "b")], "src string, dst string")
    got = {r.key: round(r.rank, 6) for r in graph.pagerank(rest, nodes, rounds=10_000, every=2).collect()}
    assert got["b"] == round(0.15 + 0.85 * 0.15, 6) and got["a"] == 0.15
    assert graph.pagerank(rest, nodes.limit(0), rounds=4, every=2).count() == 0
