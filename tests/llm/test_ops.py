"""The operators on training data against brute force, and on odd tables."""

import hashlib
import html as H
import os
import re
import subprocess
import sys
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tempofact.llm import chat, decontam, exactdedup, htmlcut, langid, mixing, quality, queries, sentdedup, simhash, toxicity
from tempofact.llm.components import components
from tests.compare import connect, same_rows

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "Alpha beta gamma delta. " * 30_000


def odd(spark, extra=()):
    """Nulls, empty, blank, very long, repeated and tied rows, clashing names."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, LONG, "en", "b", len(LONG)), (5, "Same words here, twice over.", "en", "b", 28),
        (6, "same WORDS here, twice over.", "de", None, 28), (7, "Ünïcode ÄÖÜ straße ß", "de", "", 20), (7, "Ünïcode ÄÖÜ straße ß", "de", "", 20), (None, "no id", "en", "b", 5), (None, "no id", "en", "b", 5), (9, "x", "fr", "c", 1), *extra,
    ]
    df = spark.createDataFrame(rows, DOCS)
    df = df.withColumns({"a.b": F.lit("clash"), "my col": F.lit("clash"), "Score": F.lit("clash")}).withColumn("deep", F.struct(F.lit(1).alias("a-b"), F.lit(2).alias("c.d")))
    df = df.toDF(*df.columns[:-1], "tick`ed").drop("Score")
    for c in ("_row", "_id", "score", "spans", "salt", "digest", "fp", "size", "target", "n_words", "_text", "salts"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
ELSEWHERE = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as entry
from tempofact.session import build
spark = build("elsewhere", master="local[4]", spark__sql__shuffle__partitions=4, spark__ui__showConsoleProgress="false")
for name, query in entry.queries().items():
    if name == "pipeline" or name[:2] == "op" and name[2].isdigit():
        print(name, query(spark, {FOLDER!r}).count())
"""


def test_executors_need_no_package(tmp_path):
    """All these queries run where only the driver can import the package."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ELSEWHERE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines())
    assert len(counts) == 11 and all(int(n) > 0 for n in counts.values())


@pytest.mark.parametrize("stage", [toxicity.kept_documents, decontam.kept_documents, exactdedup.kept_documents, simhash.kept_documents, mixing.mixed_documents])
def test_stages_carry_any_column(spark, stage):
    """Nulls, repeats and odd names pass through every stage of the pipeline unchanged."""
    rows = odd(spark)
    more = {toxicity.kept_documents: [spark.createDataFrame([(5, 1), (6, 0)], "doc_id bigint, toxic int")], decontam.kept_documents: [spark.createDataFrame([(1, "no such words here")], "item_id bigint, text string")]}.get(stage, [])
    got = stage(rows, *more)
    new = {"size", "target"} if stage is mixing.mixed_documents else set()  # these replace columns of the same name
    assert [c for c in got.columns if c in rows.columns and c not in new] == [c for c in rows.columns if c not in new] and {"tick`ed", "a.b", "my col", "_id", "_row"} <= set(got.columns)
    assert 0 < len(got.collect()) and stage(rows.limit(0), *more).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLES[name])


# 1


def brute_hits(text, items):
    split = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s.translate(LOWER)) if s else []
    ws, hit, found = split(text), set(), set()
    for name, item in items:
        iw = split(item)
        k = min(10, len(iw))
        windows = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else set()
        for i in range(len(ws) - k + 1 if k else 0):
            if tuple(ws[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(name)
    return len(ws), len(hit), sorted(found)


@given(st.lists(st.sampled_from(["a", "b", "c", "ä"]), max_size=60), st.lists(st.lists(st.sampled_from(["a", "b", "c", "ä"]), max_size=25), max_size=4))
@settings(max_examples=150, deadline=None)
def test_winnowing_finds_all_spans(words, items):
    named = [(str(i), " ".join(w)) for i, w in enumerate(items)]
    index = decontam.Items([(n, t.encode()) for n, t in named])
    ws = decontam.words_of(" ".join(words).encode())
    got = index.spans(ws)
    n, hit, found = brute_hits(" ".join(words), named)
    assert (len(ws), decontam.covered(got, len(ws)), sorted({index.names[i] for i, _, _ in got})) == (n, hit, found)


def test_large_benchmark_in_parts(spark, docs):
    """The hashes sent in parts give what the whole index gives."""
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = bench.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "n_words", "n_hit", F.array_sort(F.array_distinct("spans.item"))).collect()))
    want = rows(decontam.by_broadcast(docs, items))
    assert rows(decontam.by_join(docs, items, part=40)) == want and any(r[2] for r in want)


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_decontamination_both_ways_and_odd_rows(spark, limit):
    passage = "One two three four five six seven eight nine ten eleven twelve"
    items = [(1, passage), (2, "short bit"), (3, None), (4, ""), (None, "no id at all"), (1, passage), (5, "a b c d e f g h i j"), (6, "k " * 12)]
    extra = [(20, f"Start. {passage.upper()}! End short bit", "en", "a", 1), (21, "one two three four five six seven eight nine", "en", "a", 1), (22, "k " * 40, "en", "a", 1), (23, "no id at all", "en", "a", 1)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.decontaminate(odd(spark, extra), bench, limit)
    rows = got.select("doc_id", "n_words", "n_hit", F.array_sort(F.array_distinct("spans.item")).alias("items"), "score").collect()
    named = [("" if i is None else str(i), t) for i, t in items]
    texts = [(r.doc_id, r.text) for r in odd(spark, extra).select("doc_id", "text").collect()]
    want = sorted(str((d, *brute_hits(t, named))) for d, t in texts)
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in rows) == want
    assert {r.score for r in rows} == {"clash"}
    assert decontam.decontaminate(odd(spark), bench.limit(0), limit).agg(F.sum("n_hit")).first()[0] == 0
    assert decontam.decontaminate(odd(spark).limit(0), bench, limit).count() == 0


# 2


def test_toxicity_held_out(spark, docs):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.QUERIES["op2_toxicity"](spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p == y for p, y in held) / len(held) > 0.93


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    c = toxicity.Chain({"=bad": 2.0, "=foul": 4.0}, rng.normal(size=(toxicity.BUCKETS, 2)), rng.normal(size=(2, 2)))
    words = [b"ok", b"bad", b"fine", b"foul", b"bad", b"ok", b"ok"]
    tagger = toxicity.Tagger(c)
    steps = tagger.steps(words)
    ks = [c.bucket(w) for w in words]
    total, at = 0.0, np.zeros(len(words))
    for code in range(2 ** len(words)):
        ys = [code >> i & 1 for i in range(len(words))]
        p = np.exp(sum(c.emit[k, y] for k, y in zip(ks, ys)) + c.trans[0, ys[0]] + sum(c.trans[a, b] for a, b in zip(ys, ys[1:])))
        total += p
        at += p * np.array(ys)
    assert np.allclose(tagger.marginals(steps, len(words)), [(at / total)[i] for i, _ in steps])


def test_chain_over_long_gaps():
    """Gaps of any length, here against the plain recursion."""
    rng = np.random.default_rng(2)
    c = toxicity.Chain({"=bad": 2.0}, rng.normal(size=(toxicity.BUCKETS, 2)), rng.normal(size=(2, 2)))
    words = [b"ok"] * 300 + [b"bad"] + [b"ok"] * 777 + [b"bad"] + [b"ok"] * 50
    tagger = toxicity.Tagger(c)
    e, t, ks = np.exp(c.emit), np.exp(c.trans), [c.bucket(w) for w in words]
    fwd, bwd, a, b = [], [], np.array([1.0, 0.0]), np.ones(2)
    for k in ks:
        a = (a @ t) * e[k]
        a /= a.sum()
        fwd.append(a)
    for k in ks[::-1]:
        bwd.append(b)
        b = t @ (e[k] * b)
        b /= b.sum()
    p = [x * y / (x @ y) for x, y in zip(fwd, bwd[::-1])]
    assert np.allclose(tagger.marginals(tagger.steps(words), len(words)), [p[i][1] for i, _ in tagger.steps(words)])


def test_toxic_spans_and_odd_rows(spark):
    c = toxicity.Chain({"=scum": 6.0}, layer=np.array([-3.0, 2.0, 1.0, 5.0]))
    c.emit[toxicity.BUCKETS - 1, 1] = 8.0
    got = {r.doc_id: r for r in toxicity.tag(odd(spark, [(30, "Ünd SCUM scum, ok", "en", "a", 1)]), c).collect()}
    assert [(s.start, s.end) for s in got[30].spans] == [(4, 13)] and got[30].score > got[5].score
    assert len({got[i].score for i in (1, 2, 3)}) == 1 and got[1].spans == []
    labels = spark.createDataFrame([(1, 1, 1), (None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")
    empty = toxicity.fit(odd(spark), labels)
    assert {r.score for r in toxicity.tag(odd(spark), empty).collect()} == {0.5}
    assert toxicity.tag(odd(spark).limit(0), empty).count() == 0


# 3


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.QUERIES["op3_language"](spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_bloom_masks_hold_all_members():
    rng = np.random.default_rng(2)
    grams = {f"l{i:03d}": rng.integers(0, 2**63, 500, dtype=np.uint64) for i in range(70)}
    f = langid.Filters.build(grams)
    for i, g in enumerate(f.languages):
        assert f.shares(grams[g])[i] == 1.0
    other = f.shares(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    assert other.max() < 0.05 and f.decide(grams["l069"]) == ("l069", 1.0)


def test_language_odd_rows(spark):
    got = langid.identify(odd(spark), langid.fit(odd(spark))).select("doc_id", "lang_pred", "text").collect()
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {1, 2, 3} and len(got) == 11
    none = langid.fit(odd(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(odd(spark), none).collect()} == {"und"}
    assert langid.identify(odd(spark).limit(0), none).count() == 0


# 4


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


@given(st.text(alphabet="aAbB \nä \u0085é", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_equals_brute_force(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("bits", [None, 7])
def test_near_dedup_equals_brute_force(spark, docs, bits):
    rows = {r.doc_id: r for r in simhash.near_dedup(docs, bits).collect()}
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    assert {d: r.fp & (2**64 - 1) for d, r in rows.items()} == fps
    assert {d: r.component_id for d, r in rows.items()} == brute_components(fps)


@pytest.mark.parametrize("bits", [1, 6, 21])
def test_links_of_clustered_fingerprints(spark, bits):
    rng = np.random.default_rng(bits)
    seeds = rng.integers(0, 2**64, 60, dtype=np.uint64)
    fps = set(seeds.tolist())
    for s in seeds.tolist():
        x = s
        for _ in range(25):
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")
    got = components(simhash.near_links(df, bits)).collect()
    roots = {r.node & (2**64 - 1): r.root for r in got}
    want = brute_components({x: x for x in fps})
    groups = defaultdict(set)
    for x in fps:
        groups[roots.get(x, ("alone", x))].add(x)
    expected = defaultdict(set)
    for x, r in want.items():
        expected[r].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_vantage_trees_prune_without_loss():
    rng = np.random.default_rng(4)
    pts = np.unique(np.concatenate([s ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for s in rng.integers(0, 2**64, 60, dtype=np.uint64)]))
    shift, width = simhash.masks()[1]
    mask = ((1 << width) - 1) << shift
    tree, label = simhash.shard_tree(pts, mask)
    masked = np.bitwise_count((pts[:, None] ^ pts[None, :]) & np.uint64(mask)) <= 1
    near = np.bitwise_count(pts[:, None] ^ pts[None, :]) <= simhash.RADIUS
    seen = np.zeros_like(near)
    compared = tree.visit(pts, np.arange(len(pts)), lambda q, p: seen.__setitem__((q, p), True))
    assert (seen[near & masked]).all() and not seen[~near].any() and compared < 0.3 * len(pts) ** 2
    assert sorted(map(sorted, groups_of(zip(pts.tolist(), pts[label].tolist())))) == sorted(map(sorted, groups_of((int(pts[a]), int(pts[b])) for a, b in zip(*np.nonzero(seen)))))


def test_trees_and_boundaries_are_used_at_sf01(spark):
    """At 9,296 distinct texts shards hold hundreds of fingerprints, rings prune and boundaries are queried."""
    fps = simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).select("fp").distinct()
    pts = np.array([r.fp for r in fps.collect()], dtype=np.int64).view(np.uint64)
    bits = simhash.shard_bits(len(pts))
    shift, width = simhash.masks()[0]
    key = pts >> np.uint64(shift) & np.uint64((1 << bits) - 1)
    home, visitors = pts[key == 0], pts[np.bitwise_count(key) == 1]
    tree, label = simhash.shard_tree(home, ((1 << width) - 1) << shift)
    compared = tree.visit(home, np.arange(len(home)), lambda q, p: None) + tree.visit(visitors, np.arange(len(visitors)), lambda q, p: None)
    assert tree.rings and len(visitors) > len(home) > 100 and compared < 0.4 * len(home) * (len(home) + len(visitors))
    rows = simhash.sharded(fps, bits)
    assert rows.where("visits").count() > rows.where("NOT visits").count() == 3 * len(pts)


def groups_of(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    out = defaultdict(list)
    for x in list(root):
        out[find(x)].append(x)
    return out.values()


def test_near_dedup_odd_rows(spark):
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_dedup(odd(spark)).collect())
    assert got == sorted([("1", 1), ("2", 1), ("3", 1), ("4", 4), ("5", 5), ("6", 5), ("7", 7), ("None", None), ("9", 9)])
    kept = simhash.kept_documents(odd(spark))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "7", "7", "9", "None", "None"] and kept.columns == odd(spark).columns
    assert simhash.near_dedup(odd(spark).limit(0)).count() == 0


# 5


def brute_spans(rows, owners):
    """What is removed, found by comparing all spans of whole sentences of all documents."""
    split = [sentdedup.sentences(text.encode()) if text else ([], []) for _, text in rows]
    spans = defaultdict(list)
    for i, (_, words) in enumerate(split):
        for a in range(len(words)):
            for b in range(a + sentdedup.SENTENCES, len(words) + 1):
                if sum(map(len, words[a:b])) >= sentdedup.WORDS:
                    spans[tuple(w for s in words[a:b] for w in s)].append((owners[i], i, a, b))
    gone = defaultdict(set)
    for found in spans.values():
        first = min(found)[0]
        for o, i, a, b in found:
            gone[i] |= set(range(a, b)) if o != first else set()
    out = []
    for i, (d, text) in enumerate(rows):
        starts = [*split[i][0], len((text or "").encode())]
        kept = [text.encode()[starts[k] : starts[k + 1]].decode() for k in range(len(split[i][1])) if k not in gone[i]] if text else []
        out.append((str(d), " ".join(" ".join(kept).split()), len(gone[i])))
    return sorted(out)


def test_span_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    sentence = lambda: " ".join(word() for _ in range(rng.integers(1, 15))) + "."
    pool = [sentence() for _ in range(60)]
    rows = []
    for i in range(80):
        at = rng.integers(0, 55, 3)
        parts = [sentence(), *pool[at[0] : at[0] + rng.integers(1, 6)], sentence(), *pool[at[1] : at[1] + rng.integers(0, 5)]]
        rows.append((i if i % 9 else None, (" " if i % 4 else "\n").join(parts)))
    rows += [(200, None), (201, ""), (7, rows[7][1]), (7, rows[9][1]), (None, rows[9][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    owners = [r.own for r in df.coalesce(1).select(sentdedup.owner().alias("own")).collect()]
    got = sorted((str(r.doc_id), " ".join((r.text or "").split()), r.n_removed) for r in sentdedup.dedup_spans(df).collect())
    assert got == brute_spans(rows, owners) and sum(n for *_, n in got) > 100


def test_shared_passages_go(spark):
    rng = np.random.default_rng(5)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    prose = lambda n: " ".join(words(9) + "." for _ in range(n))
    passage, own = " ".join(words(k) + "." for k in (12, 3, 15, 9, 14)), {i: (prose(4), prose(5)) for i in range(12)}
    rows = [(i, f"{a}\n{passage} {b}" if i % 2 else f"{a} {b}") for i, (a, b) in own.items()]
    rows += [(20, f"{own[0][0]} Short line. Other line."), (21, "Short line. Other line."), (22, None), (23, ""), (None, "Short line."), (9, rows[9][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("removed", F.lit("clash")).withColumn("th", F.lit(1)).withColumn("my `col`", F.lit(1))
    got = sentdedup.dedup_spans(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[22].text is None and by[23].text == ""
    assert passage in by[1].text and all(passage not in by[i].text and by[i].n_removed == 5 for i in (3, 5, 7, 9, 11))
    assert all(by[i].text.split() == (own[i][0] + " " + own[i][1]).split() for i in own if i != 1 and i % 2)
    assert all(by[i].n_removed == 0 for i in (0, 2, 4, 6, 8, 10, 21)) and by[20].text == "Short line. Other line."
    assert sentdedup.dedup_spans(df.limit(0)).count() == 0
    for r in got:
        old = dict(rows)[r.doc_id]
        cut, at = "", 0
        for s in r.removed:
            cut, at = cut + old[at : s.start], s.end
        assert old is None or (cut + old[at:]).rstrip() == r.text.rstrip()


def test_whole_sentences_only_and_own_repeats(spark):
    """A document that shares words inside a longer sentence keeps it; a text's own repeats go with ``within`` alone."""
    shared = " ".join(f"w{i}" for i in range(60))
    line = "one two three four five six seven. eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty. "
    df = spark.createDataFrame([(1, f"{shared}. Other end."), (2, f"a b c {shared} d e f. Another end."), (3, line * 4)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in sentdedup.dedup_spans(df).collect()} == {1: 0, 2: 0, 3: 0}
    assert {r.doc_id: r.n_removed for r in sentdedup.dedup_spans(df, within=True).collect()} == {1: 0, 2: 0, 3: 6}


@given(st.lists(st.sampled_from(["A b c.", "D e.", "f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8 9!", "\n", "..", "zz"]), max_size=30))
@settings(max_examples=100, deadline=None)
def test_sentences_partition_the_words(parts):
    text = " ".join(parts).encode()
    starts, words = sentdedup.sentences(text)
    assert [w for s in words for w in s] == text.translate(sentdedup.TABLE).split() and starts == sorted(starts)
    for _, a, b in sentdedup.runs(words):
        assert b - a >= sentdedup.SENTENCES and sum(len(w) for w in words[a:b]) >= sentdedup.WORDS


# 6


def test_mix_meets_targets(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES["op6_mixing"](spark, folder).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for d, r in docs.items()}
    total = defaultdict(int)
    for d, r in docs.items():
        total[r.source] += size[d]
    weight = dict(zip(sorted(total), [5.0, 2.0, 1.0] * len(total)))
    goal, free, left = {}, set(total), 1.5 * sum(total.values())
    while True:
        rate = left / sum(weight[s] for s in free)
        above = {s for s in free if rate * weight[s] > 2 * total[s]}
        if not above:
            break
        goal |= {s: 2.0 * total[s] for s in above}
        left, free = left - sum(goal[s] for s in above), free - above
    goal |= {s: rate * weight[s] for s in free}
    took = defaultdict(int)
    for r in got:
        s = docs[r.doc_id].source
        assert r.size == size[r.doc_id] and r.source_size == total[s] and abs(r.target - goal[s]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
        took[s] += r.taken
    assert len(got) == len(docs) and all(abs(took[s] - goal[s]) <= max(0.05 * goal[s], 60) for s in goal)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.QUERIES["op6_mixing"](spark, folder).collect()))


def test_mix_probabilities(spark):
    """Over many seeds a document is taken as often as its probability says."""
    df = spark.createDataFrame([(i, "w " * (10 + i % 3), "a", "s", 1) for i in range(40)] + [(100 + i, "w " * 30, "a", "t", 1) for i in range(40)], DOCS)
    n, times = 4, defaultdict(int)
    for seed in range(n):
        for r in mixing.mix(df, seed).where("src = '0t'").collect():
            times[r.doc_id] += r.copies
            p = r.target / r.source_size
    assert abs(sum(times.values()) / (40 * n) - p) < 0.03 and len(set(times.values())) > 1


def test_mix_without_ids_meets_targets(spark):
    """Rows without an id, of one size and even of one text, are decided apart."""
    rows = [(None if i % 2 else i, f"w{i % 500} " * 20, "en", "ab"[i % 3 == 0], 1) for i in range(4000)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    assert len(got) == 4000
    for src in ("0a", "0b"):
        mine = [r for r in got if r.src == src]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 20
    kept = mixing.mixed_documents(df)
    assert kept.agg(F.sum("taken")).first()[0] == sum(r.taken for r in got)
    assert kept.count() == sum(r.copies > 0 for r in got)


def test_mix_odd_rows(spark):
    rows = mixing.mix(odd(spark)).collect()
    assert len(rows) == 11 and all(r.taken <= 2 * r.size for r in rows)
    assert {r.src for r in rows} == {"0", "0a", "0b", "0c", "1"} and mixing.mix(odd(spark).limit(0)).count() == 0
    only_blank = spark.createDataFrame([(1, None, "en", "a", 0)], DOCS)
    assert [(r.size, r.target, r.taken) for r in mixing.mix(only_blank).collect()] == [(0, 0.0, 0)]


# 7


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no</p>";</script></head><body class="home">
<header class="masthead"><a href="/">Site name</a> <h1>Brand</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>
<div id="cookie-notice">We use cookies. They are great, for us and maybe for you too, in the long run.</div>
<main><article><h1>The &amp; title&nbsp;here</h1><p><b>First   para<br>graph &lt;3 &eacute;.<p>Second <a href=z>with a link</a> in it.
<div class="ad">Buy this product now. It is really good and you will like it very much, we think.</div><ul><li>An item of the list.</li></ul>
<blockquote>Quoted text, as it was said by someone.</blockquote><p>Of.</p></article></main>
<aside class="sidebar"><h2>Related</h2><p>Another story that you may like to read, with quite a few words in it.</p></aside>
<section id="comments"><p>First! I totally agree with this article, well written and all that.</p></section>
<form><label>Name</label><input><textarea>write</textarea><button>Send</button></form><footer>&copy; Site. All rights reserved.</footer></body></html>"""


def test_html_article_only():
    want = "The & title here\nFirst para graph <3 é.\nSecond with a link in it.\nAn item of the list.\nQuoted text, as it was said by someone.\nOf."
    assert htmlcut.main_text(PAGE)[0] == want


def test_html_without_article_tags():
    page = "<div class=menu><a href=1>One</a> <a href=2>Two</a></div><div class='post-content'><p>Some text that goes on for a while, with a few words more.</p><p>And a second paragraph of text, which is long too.</p></div><div class='footer'>All rights reserved by us, the owners of this site.</div>"
    assert htmlcut.main_text(page)[0].split("\n")[0].startswith("Some text") and "rights" not in htmlcut.main_text(page)[0] and "Two" not in htmlcut.main_text(page)[0]


def test_html_pages_whole(spark):
    got = {r.page_id: r for r in queries.QUERIES["op7_html_extract"](spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        body = re.split(r"</article>|$", r.html.split("<article>")[1])[0]
        parts = [re.sub(r"\s+", " ", H.unescape(re.sub(r"<br>", " ", x).replace("<b>", ""))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n".join(p for p in parts if p) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_html_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<"), (4, None, "plain text only"), (5, "u", "<p" * 2000), (6, "u", "<article>" + "<p>Words and words.</p>" * 5000), (6, "u", "<div " * 3000)], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = htmlcut.extract(pages).collect()
    assert len(got) == 7 and all(r.text is not None for r in got) and max(r.n_kept for r in got) == 5000
    assert htmlcut.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", [
    "<html><head><title>x</title><meta charset=utf-8><body><article><p>{0}</p></article></body></html>", "<head><title>x</title><link href=a><article><p>{0}</p></article>", "<head>\n{0} {0}",
    "<article><p>{0}</p><noscript><img src=x><p>{0}</p></article>", "<article><svg><path d=x><p>{0}</p></article>", "<article><select><option>One<p>{0}</p></article>",
    "<head><noscript><link href=a><body><article><p>{0}</p></article>", "<article><noscript>A<p>{0}</p><noscript><p>off</p></noscript></article>",
])
def test_html_without_end_tags(page):
    words = "Some text that goes on for a while, with a few words more, and then ends."
    assert words in htmlcut.main_text(page.format(words))[0]


SOME = "Some text that goes on for a while, with a few words more, and then ends."


@pytest.mark.parametrize("page, want", [
    ("<script>if(a<b){{x()}}</script><article><p>{0}</p></article>", "{0}"),
    ("<article><h1>Head</h1><p>{0}</p></article><div id=comments><article class='comment-body'><p>First! I totally agree with this, well written and all that.</p></article></div>", "Head\n{0}"),
    ("<main><p>{0}</p></main><section class='related'><article><p>Another story that you may like, with a good number of words in it.</p></article></section>", "{0}"),
    ("<article><header class='entry-header'><h1>Head</h1></header><p>{0}</p></article>", "Head\n{0}"),
    ("<div class='post'><header class='entry-header'><h1>Head</h1></header><p>{0}</p><p>{0}</p></div>", "Head\n{0}\n{0}"),
    ("<div class='content has-sidebar'><p>{0}</p><p>{0}</p></div><div class=sidebar>Other things to read</div>", "{0}\n{0}"),
    ("<body class='single comments-open'><article class='post category-social'><p>{0}</p></article>", "{0}"),
    ("<article><p title='a>b' data-x=\"c>d\">{0}</p></article>", "{0}"), ("<article><p>a < b, c > d</p><p>{0}</p></article>", "a < b, c > d\n{0}"),
    ("<article><p>It's <a href=\"x>here</a> now</p><p>{0}</p></article>", "It's here now\n{0}"), ("<article><title>x<p>{0}</p></article>", "x\n{0}"),
    ("<article><textarea>a <p>b</p></textarea><style>p > a {{}}</style><p>{0}</p></article>", "{0}"), ("<article><p>{0}</p><!-- <p>off</p> --><script>'</p>'", "{0}"),
])
def test_html_samples(page, want):
    assert htmlcut.main_text(page.format(SOME))[0] == want.format(SOME)


@pytest.mark.parametrize("part", ["<p", "<div ", "<b>", "<b>x<hr>", "<a href=\"", "<p>x", "<title>", "<noscript>", "<svg><g>", "<a b = ", "<ul><li>a", "<a href='a\" b=\"c'>x", "</div>", "<!--", "<![", "&amp"])
def test_html_time_is_linear(part):
    page = part * (1_000_000 // len(part))
    began = time.time()
    htmlcut.main_text(page)
    assert time.time() - began < 20


def test_html_classifier_is_fitted(spark):
    """Weights learnt from pages with article elements tell content on pages whose elements say nothing."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    weights = htmlcut.fit(pages)
    assert not np.allclose(weights, htmlcut.PRIOR) and np.allclose(weights, htmlcut.fit(pages))
    assert (htmlcut.fit(pages.limit(0)) == htmlcut.PRIOR).all()
    odds, right = htmlcut.odds_table(weights), []
    for r in pages.collect():
        plain = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        right.append(htmlcut.main_text(plain, odds)[0] == htmlcut.main_text(r.html, odds)[0])
    assert np.mean(right) > 0.9


def test_html_skipped_elements_stay_out():
    page = "<head><noscript><style>p</style></noscript><title>t</title></head><article><p>Before<noscript><div>off <p>off</p></div></noscript><svg><title>off</title><text>off</text></svg><template><template>off</template>off</template><select><option>off</select><video><br>off</video> after it, with some more words.</p></article>"
    assert htmlcut.main_text(page)[0] == "Before after it, with some more words."


@given(st.lists(st.floats(-3, 3), min_size=1, max_size=7), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.floats(0, 2)), max_size=12))
@settings(max_examples=300, deadline=None)
def test_min_cut_is_minimal(odds, edges):
    n = len(odds)
    edges = [(a % n, b % n, w) for a, b, w in edges if a % n != b % n]
    cost = lambda keep: sum(z for z, k in zip(odds, keep) if z > 0 and not k) + sum(-z for z, k in zip(odds, keep) if z < 0 and k) + sum(w for a, b, w in edges if keep[a] != keep[b])
    best = min(cost([bool(c >> i & 1) for i in range(n)]) for c in range(2**n))
    assert cost(htmlcut.min_cut(odds, edges)) <= best + 1e-6


# 8


def test_index_over_batches(spark):
    rows = odd(spark)
    index = exactdedup.DigestIndex(spark, buckets=4)
    got = index.append(rows).collect()
    by = {(str(r.doc_id), bytes(r.digest).hex()): r for r in got}
    assert len(got) == 9
    empty = hashlib.sha256(b"").hexdigest()
    assert [(by[i, empty].keep_id, by[i, empty].group_size, by[i, empty].kept) for i in ("1", "2")] == [(2, 2, False), (2, 2, True)]
    same = hashlib.sha256(b"same words here, twice over.").hexdigest()
    assert by["5", same].keep_id == 6 and by["6", same].kept
    assert [r.kept for r in got if r.doc_id is None] == [True]
    later = spark.createDataFrame([(50, "SAME words here, twice over."), (51, "fresh"), (52, "Fresh")], "doc_id bigint, text string")
    again = {r.doc_id: (r.keep_id, r.kept) for r in index.append(later).collect()}
    assert again == {50: (6, False), 51: (52, False), 52: (52, True)}
    assert index.rows().count() == 8 and index.append(rows.limit(0)).count() == 0


def test_index_takes_a_batch_again(spark):
    """A batch appended again has the same result and adds nothing; under another name all its texts are old."""
    index = exactdedup.DigestIndex(spark, buckets=4)
    first = sorted(map(str, index.append(odd(spark)).collect()))
    assert sorted(map(str, index.append(odd(spark)).collect())) == first and index.rows().count() == 7
    assert not any(r.kept for r in index.append(odd(spark), "another").collect()) and index.rows().count() == 7


def test_two_batches_keep_the_largest_id(spark):
    rows = [(i, f"text {i % 50}") for i in range(200)] + [(None, "text 7"), (None, "own")]
    got = exactdedup.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 202 and all(r.keep_id == 150 + r.doc_id % 50 and r.kept == (r.doc_id >= 150) for r in got if r.doc_id is not None)
    assert sorted((str(r.keep_id), r.group_size, r.kept) for r in got if r.doc_id is None) == [("157", 5, False), ("None", 1, True)]
    again = exactdedup.kept_documents(spark.createDataFrame(rows * 2, "doc_id bigint, text string"))
    assert again.count() == 51


def test_index_reads_its_buckets_without_a_shuffle(spark):
    index = exactdedup.DigestIndex(spark, buckets=4)
    index.append(odd(spark))
    plan = index.rows().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_kept_documents_are_distinct(spark):
    kept = exactdedup.kept_documents(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "6", "7", "9", "None"]


# 9


def test_fold_of_events(spark):
    log = [
        (1, 0, 1, "open", "user", "Hi"), (1, 1, 2, "open", "assistant", ""), (1, 1, 3, "delta", None, "He"), (1, 1, 4, "delta", None, "llo"), (1, 1, 5, "regenerate", None, None), (1, 1, 6, "delta", None, "Bye"),
        (1, 0, 9, "edit", None, "Hi <|im_end|>"), (1, 2, 10, "delta", "user", "lost open"), (None, None, 1, "open", None, None),
    ]
    ev = spark.createDataFrame(log, "conv_id bigint, turn bigint, seq bigint, kind string, role string, text string").withColumn("span", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(ev)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "Hi <|im_end|>"), ("assistant", "Bye"), ("user", "lost open")] and got[1].loss_texts == ["Bye"]
    assert got[None].formatted == "<|im_start|>\n<|im_end|>\n" and chat.format_chats(ev.limit(0)).count() == 0


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys\ntem", "<|im_end|>", "\\", ""]), st.text(alphabet="<|>\\!n\nimä_end\U0001f600", max_size=12)), min_size=1, max_size=8))
@settings(max_examples=8, deadline=None)
def test_rendering_is_reversible(spark, turns):
    rows = spark.createDataFrame([(7, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id bigint, turn bigint, role string, text string")
    got = chat.read_back(chat.format_chats(chat.events_of(rows))).first()
    assert [(t.role, t.text) for t in got.turns] == turns and got.loss_texts == [t for r, t in turns if r == "assistant"]
    assert got.formatted.count("<|im_start|>") == len(turns)
    for s, t in zip(got.loss_spans, got.loss_texts):
        assert got.formatted[s.start : s.end].replace("<\\|", "<|").replace("\\\\", "\\") == t


def test_events_of_fold_back(spark):
    """The log of the query streams, edits and regenerates; a long streamed answer folds in linear work."""
    rows = spark.createDataFrame([(1, 0, "user", "Hello there"), (1, 1, "assistant", "abcdefgh"), (1, 1, "assistant", "abcdefgh"), (1, 2, None, None), (None, None, "assistant", "x")], "conv_id bigint, turn bigint, role string, text string")
    log = chat.events_of(rows)
    assert {r.kind: r["count"] for r in log.groupBy("kind").count().collect()} == {"open": 5, "edit": 2, "delta": 12, "regenerate": 3}
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_chats(log)).collect()}
    assert got == {1: [("user", "Hello there"), ("assistant", "abcdefgh"), ("assistant", "abcdefgh"), ("", "")], None: [("assistant", "x")]}
    long = spark.range(100_000).selectExpr("1 AS conv_id", "1 AS turn", "id AS seq", "'delta' AS kind", "'assistant' AS role", "'word ' AS text")
    assert chat.format_chats(long).selectExpr("length(formatted)").first()[0] == 500_000 + len("<|im_start|>assistant\n<|im_end|>\n")


def test_long_conversation(spark):
    rows = spark.range(3000).selectExpr("1 AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('t', id) AS text")
    got = chat.read_back(chat.format_chats(chat.events_of(rows))).first()
    assert [t.text for t in got.turns] == [f"t{i}" for i in range(3000)] and got.loss_texts == [f"t{i}" for i in range(1, 3000, 2)]


# 10


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.QUERIES["op10_quality"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p == y for p, y in held) / len(held) > 0.93


def test_sum_of_squares_identity():
    rng = np.random.default_rng(3)
    m = quality.Machine(np.zeros((quality.STATS, quality.BINS - 1)), 0.1, rng.normal(size=50), rng.normal(size=(50, 4)))
    idx, val = np.array([3, 9, 20, 44]), rng.normal(size=4)
    pairs = sum(float(m.v[i] @ m.v[j]) * a * b for k, (i, a) in enumerate(zip(idx, val)) for j, b in list(zip(idx, val))[k + 1 :])
    assert np.isclose(m.score(idx, val), 1 / (1 + np.exp(-(m.bias + m.w[idx] @ val + pairs))))


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 10)] + [(None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")
    got = quality.score(odd(spark), quality.fit(odd(spark), labels)).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score(odd(spark), quality.fit(odd(spark), labels.limit(0))).collect()} == {0.5}
    assert quality.score(odd(spark).limit(0), None).count() == 0


# pipeline


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    from tempofact.session import cut

    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(cut(stage(spark, kept[-1], folder), "test-stage"))
    for before, after in zip(kept[:-2], kept[1:-1]):
        assert after.columns == docs.columns and after.exceptAll(before).count() == 0
    texts = [r.text.translate(LOWER) for r in kept[2].collect()]
    assert len(texts) == len(set(texts)) == len({r.text.translate(LOWER) for r in kept[1].collect()})
    fps = {r.doc_id: brute_fingerprint(r.text) for r in kept[2].collect()}
    assert {r.doc_id for r in kept[3].collect()} == set(brute_components(fps).values())
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in kept[3].collect() if brute_hits(r.text, items)[1] == 0}
    assert {r.doc_id for r in kept[4].collect()} == clean
    last = kept[5].collect()
    assert all(r.taken == r.copies * r.size > -1 and r.copies in (1, 2) for r in last) and {r.doc_id for r in last} <= clean
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == sorted(r.doc_id for r in last)


def test_pipeline_on_odd_rows(spark):
    for rows in (odd(spark), odd(spark).limit(0)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            before = docs
            docs = stage(spark, docs, FOLDER)
            assert set(before.columns) <= set(docs.columns) | {"size", "target"}
        assert docs.count() <= rows.count()
