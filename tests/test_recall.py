"""The whole recall against plain Python, stage by stage."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tempofact.operators import inverted
from tempofact.operators import recall as r
from tempofact.sources.fixtures import ts

NOW = datetime(2024, 2, 1)
COLUMNS = "id bigint, content string, entity string, namespace string, status string, confidence double, access_count int, t_created timestamp_ntz, t_expired timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz, last_accessed timestamp_ntz"
TEXTS = ["red house sold", "red house was sold late", "blue car", "red red garden", "green tree of Ann", None, "red house sold ", "old cart", "red paint", "grey sky"]


def facts_of(n=10):
    out = []
    for i in range(n):
        made = datetime(2024, 1, 1) + timedelta(days=i)
        ended = datetime(2024, 1, 20) if i == 3 else None
        out.append((i, TEXTS[i], [None, "Ann", "Bob", "Cy"][i % 4], "n", "archived" if i == 8 else "active", 0.5 + i / 30, i % 3, made, ended, made, ended, None if i % 2 else made + timedelta(days=5)))
    return out


VECTORS = [(i, [math.cos(i / 3), math.sin(i / 3), 0.1]) for i in range(10) if i not in (1, 9)]
EDGES = [("ann", "bob", "KNOWS", "n", "2024-01-01"), ("bob", "zed", "KNOWS", "n", "2024-01-02")]
NODES = [("ann", "n", "Ann", "person"), ("bob", "n", "Bob", "person"), ("zed", "n", "Zed", "person")]


def by_hand(facts, query, terms, entities, as_of, top, most, gate, budget):
    seen = {f[0]: f for f in facts if (f[4] == "active" if as_of is None else f[7] <= as_of and (f[8] is None or f[8] > as_of) and f[9] <= as_of and (f[10] is None or f[10] > as_of))}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    near = sorted((1 - cos(v, query), i) for i, v in VECTORS if i in seen)[: top[0]]
    docs = {i: f[1].lower().split() for i, f in seen.items() if f[1] is not None}
    mean = sum(map(len, docs.values())) / max(1, len(docs))
    df = {t: sum(t in d for d in docs.values()) for t in terms}
    bm = {i: sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in terms) for i, d in docs.items()}
    said = sorted((-s, i) for i, s in bm.items() if s > 0)[: top[1]]
    rrf, first = {}, {}
    for lane, hits in enumerate((near, said)):
        for rank, (_, i) in enumerate(hits, 1):
            rrf[i] = rrf.get(i, 0) + 1 / (60 + rank)
            first.setdefault(i, (lane, rank))
    order = sorted(rrf, key=lambda i: (-round(rrf[i], 9), first[i]))
    away = {i: d for d, i in near}
    sim = {i: max(0, 1 - away.get(i, 1), 1 - p / len(order) if said else 0) for p, i in enumerate(order)}
    hop = {}
    if entities:
        hop = {"ann": 0, "bob": 1, "zed": 2}
    rows = []
    for i in order:
        h = hop.get((seen[i][2] or "").lower())
        score = 0.7 * min(1, sim[i]) + (-0.05 if h is None else 0.3 * {0: 0.3, 1: 0.2, 2: 0.1}[h])
        rows.append([i, seen[i][2], seen[i][1], score, seen[i][7], seen[i][5], seen[i][6], seen[i][11]])
    if entities:
        rows.append([-1, None, "ann KNOWS Bob (2024-01-01)", 0.6, NOW, 1.0, 0, None])
    once = {}
    for x in sorted(rows, key=lambda x: (-x[3], x[0])):
        once.setdefault(x[0] if x[2] is None else x[2].strip(), x)
    for x in once.values():
        x[3] += max(0, 1 - (NOW - x[4]).days / 90) * 0.2
        low = [e.lower() for e in entities]
        x[3] += 0.3 if (x[1] or "").lower() in low else 0.15 if any(len(e) > 2 and e in (x[2] or "").lower() for e in low) else 0
    left, picked = sorted(once.values(), key=lambda x: (-x[3], x[0])), []
    words = lambda x: set((x[2] or "").lower().split())
    like = lambda a, b: len(words(a) & words(b)) / len(words(a) | words(b)) if words(a) and words(b) else 0
    while left and len(picked) < most:
        best = max(left, key=lambda x: 0.7 * x[3] - 0.3 * max([like(x, y) for y in picked], default=0))
        left.remove(best)
        picked.append(best)
    out = []
    for x in picked:
        sure = min(1, max(0.1, x[5] - 0.001 * max(0, (NOW - (x[7] or x[4])).total_seconds() / 3600) + 0.03 * x[6]))
        if sure >= gate:
            out.append((x[0], x[3] * sure, len(x[2] or "") // 4))
    taken, used = [], 0
    for i, score, cost in sorted(out, key=lambda x: (-round(x[1], 9), x[0])):
        if not taken or used + cost <= budget:
            taken.append((i, round(score, 6)))
            used += cost
    return taken


@pytest.mark.parametrize(
    "terms, entities, as_of, top, most, gate, budget",
    [
        (["red", "house"], ["Ann"], None, (50, 30), 10, 0.0, 2000),
        (["red", "house"], [], datetime(2024, 1, 6), (50, 30), 10, 0.0, 2000),
        ([], ["Ann"], datetime(2024, 1, 15), (4, 3), 3, 0.1, 2000),
        (["red"], ["Ann"], datetime(2024, 1, 25), (50, 2), 6, 0.15, 7),
        (["red"], [], datetime(2023, 1, 1), (50, 30), 10, 0.0, 2000),
    ],
)
def test_recall_equals_plain_python(spark, terms, entities, as_of, top, most, gate, budget):
    facts = spark.createDataFrame(facts_of(), COLUMNS)
    vectors = spark.createDataFrame(VECTORS, "vec_id bigint, embedding array<float>")
    edges = spark.createDataFrame(EDGES, "src string, dst string, rel string, namespace string, event_date string")
    nodes = spark.createDataFrame(NODES, "key string, namespace string, display_name string, entity_type string")
    at = None if as_of is None else ts(as_of.strftime("%Y-%m-%d %H:%M:%S"))
    got = r.recall(facts, vectors, [1.0, 0.2, 0.1], terms, ts("2024-02-01 00:00:00"), edges=edges, nodes=nodes, entities=entities, as_of=at, top=top, most=most, gate=gate, budget=budget)
    rows = got.orderBy("rank").collect()
    assert [x["rank"] for x in rows] == list(range(1, len(rows) + 1))
    assert [(x.id, pytest.approx(x.score, abs=2e-5)) for x in rows] == by_hand(facts_of(), [1.0, 0.2, 0.1], terms, entities, as_of, top, most, gate, budget)


def test_context_falls_back(spark):
    old = spark.createDataFrame([(i, "c" if i % 2 else "d", None if i > 6 else "e", "active" if i else "archived", datetime(2024, 1, 1 + i)) for i in range(9)], "id bigint, category string, entity string, status string, t_created timestamp_ntz")
    new = spark.createDataFrame([(100, "c", "e"), (101, "c", "e"), (102, "d", None), (103, None, None), (104, "c", "none")], "id bigint, category string, entity string")
    vectors = spark.createDataFrame([(i, [1.0, i / 4]) for i in range(9)], "vec_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(100, [1.0, 0.0])], "query_id bigint, query array<float>")
    got = [tuple(x) for x in r.context(new, old, queries, vectors, 2).orderBy("id", "n").select("id", "known", "n").collect()]
    assert got == [(100, 1, 1), (100, 2, 2), (101, 5, 1), (101, 3, 2), (102, 8, 1), (102, 6, 2)]
    assert r.context(new.limit(0), old, queries.limit(0), vectors).where(F.lit(True)).count() == 0


def tables(spark, facts=None):
    return (
        spark.createDataFrame(facts or facts_of(), COLUMNS), spark.createDataFrame(VECTORS, "vec_id bigint, embedding array<float>"),
        spark.createDataFrame(EDGES, "src string, dst string, rel string, namespace string, event_date string"), spark.createDataFrame(NODES, "key string, namespace string, display_name string, entity_type string"),
    )


ASKED = "query_id bigint, query array<double>, terms array<string>, entities array<string>, as_of timestamp_ntz, namespace string"


def test_many_questions_equal_each_alone(spark):
    facts, vectors, edges, nodes = tables(spark)
    q = [1.0, 0.2, 0.1]
    rows = [(1, q, ["red", "house"], ["Ann"], None, None), (2, q, ["red", "house"], [], datetime(2024, 1, 6), "n"), (3, q, None, ["Ann"], datetime(2024, 1, 15), "n"), (4, None, ["red"], [None], datetime(2024, 1, 25), None), (5, [0.0, 0.0, 0.0], [], [], None, None), (6, [1.0], ["nowhere"], [], None, "other")]
    got = r.recall_all(spark.createDataFrame(rows, ASKED), facts, vectors, ts("2024-02-01 00:00:00"), edges=edges, nodes=nodes)
    found = {}
    for x in got.orderBy("query_id", "rank").collect():
        found.setdefault(x.query_id, []).append((x.id, pytest.approx(x.score, abs=2e-5)))
    hand = lambda terms, entities, as_of: by_hand(facts_of(), q, terms, entities, as_of, (50, 30), 10, 0.0, 2000)
    assert found[1] == hand(["red", "house"], ["Ann"], None)
    assert found[2] == hand(["red", "house"], [], datetime(2024, 1, 6))
    assert found[3] == hand([], ["Ann"], datetime(2024, 1, 15))
    assert {i for i, _ in found[4]} <= {0, 1, 3, 8} and found[4]  # words alone, no vector
    assert 5 not in found and 6 not in found


def test_graph_keeps_tenants_and_days_apart(spark):
    facts, vectors, _, _ = tables(spark)
    edges = spark.createDataFrame([("ann", "bob", "KNOWS", "n", "2024-01-01"), ("ann", "secret", "OWNS", "b", "2024-01-02"), ("ann", "late", "MEETS", "n", "2024-06-30"), ("ann", "ever", "LIKES", "n", None)], "src string, dst string, rel string, namespace string, event_date string")
    nodes = spark.createDataFrame([("ann", "n", "Ann", "p"), ("bob", "n", "Bob", "p"), ("bob", "b", "Bob of b", "p"), ("secret", "b", "Secret", "p"), ("late", "n", "Late", "p"), ("ever", "n", "Ever", "p")], "key string, namespace string, display_name string, entity_type string")
    ask = lambda **k: {x.content for x in r.recall(facts, vectors, [1.0, 0.2, 0.1], [], ts("2024-02-01 00:00:00"), edges=edges, nodes=nodes, entities=["Ann"], most=30, **k).collect() if x.source == "graph"}
    assert ask(namespace="n", as_of=ts("2024-01-15 00:00:00")) == {"ann KNOWS Bob (2024-01-01)", "ann LIKES Ever"}
    assert ask(namespace="b", as_of=ts("2024-01-15 00:00:00")) == {"ann OWNS Secret (2024-01-02)"}
    assert ask(namespace="n") == {"ann KNOWS Bob (2024-01-01)", "ann LIKES Ever", "ann MEETS Late (2024-06-30)"}
    seeds = spark.createDataFrame([(1, "n", "2024-01-15", "ann"), (2, None, None, "ann")], "query_id bigint, namespace string, day string, key string")
    hops = {(x.query_id, x.node, x.hop) for x in r.graph.hops_of(edges, seeds).collect()}
    assert (1, "bob", 1) in hops and not {(1, "secret", 1), (1, "late", 1)} & hops and (2, "secret", 1) in hops


def test_users_agents_and_windows(spark):
    facts, vectors, _, _ = tables(spark)
    facts = facts.withColumns({"user_id": F.concat(F.lit("u"), F.col("id") % 2), "agent_id": F.lit("x"), "visibility": F.when(F.col("id") == 2, "private").otherwise("team")})
    ask = lambda **k: {x.id for x in r.recall(facts, vectors, [1.0, 0.2, 0.1], ["red"], ts("2024-02-01 00:00:00"), most=30, **k).collect()}
    assert ask(user_id="u0") == {0, 2, 4, 6} - {6} | ({6} & ask(user_id="u0"))
    assert not {2} & ask(user_id="u0", agent_id="y") and {2} <= ask(user_id="u0", agent_id="x")
    assert ask(window=(ts("2024-01-02 00:00:00"), ts("2024-01-05 00:00:00"))) <= {0, 1, 2, 3}
    asked = spark.createDataFrame([(1, "what happened yesterday", datetime(2024, 1, 4, 9)), (2, "what else", datetime(2024, 1, 4)), (3, None, None)], "query_id bigint, text string, asked_at timestamp_ntz")
    got = {x.query_id: (x.start, x.end) for x in r.with_windows(asked).collect()}
    assert got == {1: (datetime(2024, 1, 2), datetime(2024, 1, 5)), 2: (None, None), 3: (None, None)}


def test_index_gives_the_same_recall(spark):
    facts, vectors, edges, nodes = tables(spark)
    index = inverted.build(facts.withColumn("tags", F.array(F.lit("home"))).select("id", "content", "tags", "entity"))
    ask = lambda **k: [tuple(x) for x in r.recall(facts, vectors, [1.0, 0.2, 0.1], ["red", "house"], ts("2024-02-01 00:00:00"), edges=edges, nodes=nodes, entities=["Ann"], as_of=ts("2024-01-15 00:00:00"), **k).orderBy("rank").collect()]
    assert ask() == ask(index=index)


def test_second_hop_and_bump(spark):
    facts, vectors, _, _ = tables(spark, [(i, c, None, "n", "active", 0.9, 0, NOW - timedelta(days=2), None, NOW - timedelta(days=2), None, None) for i, c in enumerate(["Ann knows Zed", "Zed lives in Rome", "other things", None])])
    asked = spark.createDataFrame([(1, None, ["knows"], [], "who is ann")], "query_id bigint, query array<double>, terms array<string>, entities array<string>, text string")
    got = {x.id: x.score for x in r.multi_hop(asked, facts, vectors, ts("2024-02-01 00:00:00")).collect()}
    assert set(got) == {0, 1} and got[1] < got[0]
    alone = {x.id: x.score for x in r.recall(facts, vectors, [0.0], ["zed"], ts("2024-02-01 00:00:00"), entities=["zed"]).collect()}
    assert got[1] == pytest.approx(0.8 * alone[1])
    once = r.recall_all(asked, facts, vectors, ts("2024-02-01 00:00:00"))
    after = {x.id: (x.access_count, x.last_accessed) for x in r.bumped(facts, once, ts("2024-02-01 00:00:00")).collect()}
    assert after[0] == (1, NOW) and after[2] == (0, None)
    two = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.1]), (1, 1, None), (1, 2, [0.9, 0.1, 0.1])], "query_id bigint, variant bigint, query array<double>")
    both = spark.createDataFrame(VECTORS, "vec_id bigint, embedding array<float>")
    assert [x.id for x in r.multi_query(two, both, 3).orderBy(F.desc("rrf_score")).collect()][0] == 0
