"""Packing, prefix trie and vector codes against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from functools import lru_cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tempofact.llm import ordered, packing, queries, trie, vcodes
from tests.compare import connect, same_rows

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# running sums


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_running_sums_over_range_borders(spark, parts):
    rnd = random.Random(parts)
    rows = [(rnd.choice([1, 1, 1, 1, 2, 5, -3]), rnd.randrange(10_000), rnd.choice([1, 2, -1, (1 << 60) + 7])) for _ in range(700)]
    df = spark.createDataFrame(rows, "g bigint, o bigint, x bigint").dropDuplicates(["g", "o"])
    rows = [tuple(r) for r in df.collect()]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for group in ("g", None):
            got = {(r.g, r.o): r.s for r in ordered.running(df, ["g", "o"], {"x": "s"}, group).collect()}
            want, total = {}, Counter()
            for g, o, x in sorted(rows):
                total[g if group else 0] += x
                want[g, o] = total[g if group else 0] & ordered.MASK
            assert got == want
        assert ordered.running(df.limit(0), ["g", "o"], {"x": "s"}, "g").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


# 11


def optimum(sizes, size):
    """The least number of bins, by search."""
    sizes = sorted(sizes, reverse=True)

    @lru_cache(None)
    def least(i, rooms):
        if i == len(sizes):
            return 0
        best = 1 + least(i + 1, tuple(sorted([*rooms, size - sizes[i]])))
        for r in {r for r in rooms if r >= sizes[i]}:
            left = list(rooms)
            left.remove(r)
            best = min(best, least(i + 1, tuple(sorted([*left, r - sizes[i]]))))
        return best

    return least(0, ())


def test_dominance_costs_no_sequence():
    rnd, fixed = random.Random(2), 0
    for _ in range(150):
        size = rnd.choice([10, 20, 31])
        sizes = [rnd.randrange(1, size + 1) if rnd.random() < 0.6 else rnd.randrange(size // 4, size // 2 + 1) for _ in range(rnd.randrange(1, 9))]
        sets, left = packing.reduced(dict(Counter(sizes)), size)
        rest = [w for w, n in left.items() for _ in range(n)]
        assert Counter({w: n for p, t in sets for w, n in p for _ in range(0)}) == {}
        assert Counter(w for p, t in sets for _ in range(t) for w, n in p for _ in range(n)) + Counter(rest) == Counter(sizes)
        assert sum(t for _, t in sets) + optimum(rest, size) == optimum(sizes, size)
        fixed += sum(t for _, t in sets)
    assert fixed > 200


def test_best_fit_in_groups_equals_best_fit_one_by_one():
    rnd = random.Random(4)
    for _ in range(100):
        size, sizes = 50, [rnd.randrange(1, 30) for _ in range(rnd.randrange(0, 60))]
        rooms = []
        for w in sorted(sizes, reverse=True):
            fit = [r for r in rooms if r >= w]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else size) - w)
        got = packing.best_fit(dict(Counter(sizes)), size)
        assert sorted(size - sum(w * n for w, n in p) for p, t in got for _ in range(t)) == sorted(rooms)


def check_packing(rows, texts, size=2048):
    whole = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for i, t in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, a in enumerate(range(0, len(ids), size)):
            want[i, k, a, len(ids[a : a + size]), crc32(ids[a : a + size].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_of_a_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = queries.op11_best_fit(spark, FOLDER).collect()
    n = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= 1.01 * packing.least_sequences(dict(Counter(r.length for r in rows))) + 1


def test_packing_of_odd_rows(spark):
    odd = ["a b,c", "ΑΣ Σ ς", "é ́x É̂ Ünïcode", "don't it's 'S", "<|endoftext|> b<|startoftext|>c <|ENDOFTEXT|>", "İstanbul K Å ſ ß", "... .a! ét, ÀÉ;:?", "日本語 123abc", "x" * 9000 + " " + "é" * 5000, "\x00\x01 \x7f", " \n\t ", "word " * 6000, "Naïve,, co.uk"]
    texts = [(1, None), (1, None), (None, "no id"), (None, "no id"), (5, ""), *((10 + i, t) for i, t in enumerate(odd)), *((100 + i, "same words") for i in range(40))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumns({"length": F.lit("clash"), "part": F.lit(1), "piece": F.lit(2)}).repartition(3)
    assert check_packing(packing.pack(df, VOCABULARY).collect(), texts) >= 3
    assert check_packing(packing.pack(df, VOCABULARY, size=16).collect(), texts, 16) > 100
    assert packing.pack(df.limit(0), VOCABULARY).count() == 0


# 12


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, trie_key(r, x), r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    whole = {c: tuple(own.get(c - int(math.fmod(c, 20)), [])[: crc32(str(c).encode()) % 4] + v[crc32(str(c).encode()) % 4 :]) for c, v in own.items()}
    nodes = {v[:d] for v in whole.values() for d in range(len(v) + 1)}
    words = lambda x: len([w for w in x.replace("\t", " ").replace("\n", " ").split(" ") if w])
    members = {n: sorted(c for c, v in whole.items() if v[: len(n)] == n) for n in nodes}
    kids = Counter(n[:-1] for n in nodes if n)
    out = []
    for n in nodes:
        below = [m for m in nodes if m[: len(n)] == n]
        ends = ",".join(str(c) for c in members[n] if whole[c] == n)
        out.append((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), kids[n], sum(not kids[m] for m in below), sum((len(members[m]) - 1) * words(m[-1][1]) for m in below if m), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def trie_key(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def built(df):
    got = trie.trie(*trie.rebuilt(trie.turns(df)))
    rows = got.orderBy("preorder").collect()
    assert [r.preorder for r in rows] == list(range(len(rows)))
    for r in rows:
        assert r.preorder <= r.subtree_end < len(rows) and all(x.depth > r.depth for x in rows[r.preorder + 1 : r.subtree_end + 1])
        assert r.subtree_end + 1 == len(rows) or rows[r.subtree_end + 1].depth <= r.depth
    return sorted(tuple(r)[:8] for r in rows)


CONVERSATION = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("block, piece", [(64, 1000), (2, 2)])
def test_trie_of_odd_conversations(spark, monkeypatch, block, piece):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "PIECE", piece)
    rnd = random.Random(6)
    rows = [(c, t, rnd.choice(["u", "a", None]), rnd.choice(["x y", "x", " ", None])) for c in range(70) for t in range(rnd.choice([1, 2, 3, 5, 9, 20]))]
    rows += [(200 + c, t, "user", "hi there") for c in range(30) for t in range(2)] + [(None, 1, "u", "lost"), (300, None, "u", "first"), (300, 0, "u", "second"), (300, 0, "u", "second"), (300, 0, "a", "tie"), (-7, 0, "u", "below zero"), (400, 0, "u", "w " * 5000)]
    df = spark.createDataFrame(rows, CONVERSATION).withColumns({"idx": F.lit("clash"), "key": F.lit("clash"), "d": F.lit(1)}).repartition(4)
    got = built(df)
    assert got == trie_by_hand(rows) and len(got) > 200


def test_trie_of_empty_and_turnless(spark):
    none = spark.createDataFrame([], CONVERSATION)
    assert trie.trie(*trie.rebuilt(trie.turns(none))).count() == 0
    turnless = [(c, 0, "u", "gone") for c in range(21, 40) if crc32(str(c).encode()) % 4]  # no first conversation, all turns replaced
    assert built(spark.createDataFrame(turnless, CONVERSATION)) == trie_by_hand(turnless)


def test_trie_equals_sql(spark):
    same_rows(queries.op12_prefix_trie(spark, FOLDER), connect(FOLDER), queries.OP12_SQL)


# 13


def codes_by_hand(rows, entries=256, rounds=4):
    """Plain integers; rows (vec_id, vector, label) without odd ones."""
    width = -(-max((len(v) for _, v, _ in rows), default=0) // 4) * 4
    ints = [np.pad(np.floor(np.array(v, dtype=float) * 1024).astype(object), (0, width - len(v))) for _, v, _ in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    part = lambda v, p: [int(x) for x in v[p * width // 4 : (p + 1) * width // 4]]
    books = [[part(ints[i], p) for i in first] for p in range(4)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min((away(part(v, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        found = [[nearest(v, p)[1] for v in ints] for p in range(4)]
        for p in range(4):
            for e in range(len(books[p])):
                mine = [part(v, p) for v, f in zip(ints, found[p]) if f == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    got = [[nearest(v, p) for p in range(4)] for v in ints]
    labels = Counter()
    for (_, _, label), g in zip(rows, got):
        labels[label] += sum(d for d, _ in g)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{c:02x}" for _, c in g), sum(d for d, _ in g), labels[label], sha) for (i, _, label), g in zip(rows, got))


@pytest.mark.parametrize("entries", [256, 5])
def test_codes_of_odd_vectors(spark, monkeypatch, entries):
    monkeypatch.setattr(vcodes, "ENTRIES", entries)
    rnd = random.Random(8)
    good = [(i, [rnd.choice([0.0, -0.0005, 0.3, -1.25, rnd.gauss(0, 2)]) for _ in range(8)], rnd.choice([0, 1, None])) for i in range(60)]
    good += [(70, good[0][1], 1), (70, good[0][1], 1), (None, [0.5] * 8, None), (71, [1.5, -2.5, 3.0], 7), (72, [], None), (73, [9000.0] * 8, 0)]
    bad = [(80, None, 1), (81, [1.0] * 7 + [None], 1), (82, [float("nan")] * 8, 1), (83, [float("inf")] + [0.0] * 7, 0), (84, [float("-inf")] * 12, 0)]
    df = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<double>, label int").withColumns({"code": F.lit("clash"), "error": F.lit("clash"), "vector": F.lit("clash")}).repartition(3)
    got = sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vcodes.compress(df).collect())
    assert got == codes_by_hand(good, entries)
    assert vcodes.compress(df.limit(0)).count() == vcodes.compress(df.where("vec_id > 79")).count() == 0


def test_annulus_is_exact_and_saves_work():
    rnd = np.random.default_rng(3)
    for high in (50, 1 << 12, 1 << 26):
        entries = rnd.integers(-high, high, (256, 16)) * rnd.integers(0, 100, (256, 1)) // 100
        entries[100] = entries[30]  # a tie
        v = np.concatenate([rnd.integers(-high, high, (500, 16)) * rnd.integers(0, 100, (500, 1)) // 100, entries[:40]])
        index, best, _ = vcodes.Codebook(entries).nearest(v)
        d = ((v[:, None, :] - entries[None]) ** 2).sum(2)
        assert (best == d.min(1)).all() and (index == d.argmin(1)).all()
        near = entries[rnd.integers(0, 256, 2000)] + rnd.integers(-1, 2, (2000, 16))
        assert high == 50 or vcodes.Codebook(entries).nearest(near)[2] < 0.3 * 2000 * 256


def test_codes_equal_sql(spark):
    same_rows(queries.op13_vector_codes(spark, FOLDER), connect(FOLDER), queries.op13_sql())
