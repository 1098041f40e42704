"""Benchmark decontamination by winnowing.

Of the hashes of all runs of K words the least in every window of W runs is kept, in documents and benchmark items
alike, so that any shared span of K + W - 1 words (10) shares a kept hash. Documents meet items where kept hashes are
equal, and each meeting is extended word by word in both directions; a span that is long enough is a hit. Hashes
only find candidates: what counts is that the words are equal. Items of fewer than 10 words are one window of their
own length; their hash is looked up at every position.

A benchmark whose texts are below ``BROADCAST_BYTES`` (measured first) is indexed once and sent to all tasks. Of a
larger one, kept hashes alone are sent, sorted, in as many parts of at most ``PART`` as there are; documents are scanned once
a part, and what meets a hash sends the hashes of its windows (128 bits) to a join with the windows of all items. Texts are
shuffled in neither case, and no pair of texts is built.

Defined results: a null text has no words; items without words are left out; an item without an id marks words and
is listed as an empty string; repeated items count once for each id; every row of the input gives one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempofact.llm.common import columns, extended, packed, received, send, tune
from tempofact.session import cut, ship

SPAN, K = 10, 5
W = SPAN - K + 1
BROADCAST_BYTES, PART = 2 << 20, 4 << 20
#: Lower-cases A-Z and blanks every other ASCII byte that is no digit or letter; bytes of longer characters stay.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MULT = np.uint64(0x9E3779B97F4A7C15)
RESULT = ("n_words", "n_hit", "spans")
SPANS = "array<struct<item:string,start:int,end:int>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def grams(words: list[bytes], k: int) -> np.ndarray:
    """A 64-bit hash of every run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))
    out = h[:n].copy()
    for i in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * MULT + h[i : n + i]
    out = (out ^ (out >> np.uint64(32))) * MULT
    return out ^ (out >> np.uint64(31))


def kept(h: np.ndarray, w: int = W) -> np.ndarray:
    """Positions that are least in some window of w hashes (all of them, in a tie)."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least = h[:n].copy()
    for i in range(1, w):
        np.minimum(least, h[i : n + i], out=least)
    top = np.zeros(len(h), dtype=np.uint64)  # the largest of the minima of a position's windows
    for i in range(w):
        np.maximum(top[i : n + i], least, out=top[i : n + i])
    return np.flatnonzero(top == h)


class Items:
    """An index of benchmark items: kept hashes of long items, whole hashes of short ones."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.names = [name for name, _ in items]
        self.words = [words_of(text) for _, text in items]
        self.long: dict[int, dict[int, list[int]]] = {}
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, ws in enumerate(self.words):
            if len(ws) >= SPAN:
                h = grams(ws, K)
                chosen = set(h[kept(h)].tolist())
                for at, x in enumerate(h.tolist()):
                    if x in chosen:
                        self.long.setdefault(x, {}).setdefault(i, []).append(at)
            elif ws:
                self.short.setdefault(len(ws), {}).setdefault(int(grams(ws, len(ws))[0]), []).append(i)
        self.keys = np.array(sorted(self.long), dtype=np.uint64)
        self.short_keys = {n: np.array(sorted(x), dtype=np.uint64) for n, x in self.short.items()}

    def spans(self, ws: list[bytes]) -> list[tuple[int, int, int]]:
        """(item, start, end) in words: the stretches of a document that windows of an item cover, those that touch as one.

        A place is looked at for an item until all windows that hold it are covered, so repeated words cost no pairs of places.
        """
        out = []
        if len(self.keys) and len(ws) >= SPAN:
            h = grams(ws, K)
            at = kept(h)
            at = at[found(self.keys, h[at])]
            done: dict[tuple[int, int], int] = {}
            cover: dict[int, tuple[int, int]] = {}  # the last stretch of an item
            for p in at.tolist():
                first, last = max(0, p + K - SPAN), min(len(ws), p + SPAN)
                for i, qs in self.long[int(h[p])].items():
                    for q in qs:
                        c, d = cover.get(i, (0, 0))
                        if c <= first and last <= d:
                            break
                        if p < done.get((i, p - q), 0):
                            continue
                        a, b = extend(ws, self.words[i], p, q)
                        done[i, p - q] = max(b, p + 1)
                        if b - a < SPAN:
                            continue
                        if a <= d and d > 0:
                            cover[i] = (min(a, c), max(b, d))
                        else:
                            if d:
                                out.append((i, c, d))
                            cover[i] = (a, b)
            out += [(i, a, b) for i, (a, b) in cover.items()]
        for n, keys in self.short_keys.items():
            h = grams(ws, n)
            for p in np.flatnonzero(found(keys, h)).tolist():
                out += [(i, p, p + n) for i in self.short[n][int(h[p])] if ws[p : p + n] == self.words[i]]
        return out


def found(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of ``h`` are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(h), dtype=bool)
    return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h


def extend(ws: list[bytes], item: list[bytes], p: int, q: int) -> tuple[int, int]:
    """The maximal equal span around document position p and item position q."""
    a, b, d = p, p, q - p
    while b < len(ws) and b + d < len(item) and ws[b] == item[b + d]:
        b += 1
    while a > 0 and a + d > 0 and ws[a - 1] == item[a + d - 1]:
        a -= 1
    return a, b


def covered(spans: list[tuple[int, int, int]], n: int) -> int:
    hit = np.zeros(n, dtype=bool)
    for _, a, b in spans:
        hit[a:b] = True
    return int(hit.sum())


def decontaminate(docs: DataFrame, items: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Every row of ``docs`` with n_words, n_hit and spans (item id, first word, word after the last)."""
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text")).where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item") + 64), F.lit(0))).first()[0]
    return by_broadcast(docs, items) if size <= limit else by_join(docs, items)


def by_broadcast(docs: DataFrame, items: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    tune(spark)
    index = send(spark, Items([(r["item"], bytes(r["text"])) for r in items.orderBy("item", "text").collect()]))  # below the limit

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = received(index)
        for b in batches:
            n_words, n_hit, spans = [], [], []
            for text in b.column("_text").to_pylist():
                ws = words_of(text)
                got = idx.spans(ws)
                n_words.append(len(ws))
                n_hit.append(covered(got, len(ws)) if got else 0)
                spans.append([{"item": idx.names[i], "start": s, "end": e} for i, s, e in got])
            kind = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            rest = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, kind)], [*b.schema.names[:-1], "n_words", "n_hit", "spans"])

    row, back = packed(docs, *RESULT)
    rest = docs.select(row, F.col("text").cast("binary").alias("_text"))
    return rest.mapInArrow(scan, extended(rest, f"n_words bigint, n_hit bigint, spans {SPANS}", "_text")).select(*back, *RESULT)


def window_hash(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) to (fp, n, win, item): kept hashes with a null window, then windows with a null hash.

    ``n`` is the words of a short item, 0 for a long one.
    """
    for b in batches:
        rows = []
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ws = words_of(text)
            if len(ws) >= SPAN:
                h = grams(ws, K)
                rows += [(int(x), 0, None, None) for x in np.unique(h[kept(h)]).view(np.int64)]
                rows += [(None, 0, w, item) for w in {window_hash(ws[i : i + SPAN]) for i in range(len(ws) - SPAN + 1)}]
            elif ws:
                rows += [(int(grams(ws, len(ws)).view(np.int64)[0]), len(ws), None, None), (None, len(ws), window_hash(ws), item)]
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.string()))], ["fp", "n", "win", "item"])


def meetings(docs: DataFrame, keys: dict[int, np.ndarray]) -> DataFrame:
    """(key, start, end, win) of the windows of documents that hold a hash of ``keys``, sorted hashes by item words (0: long).

    ``key`` is a digest of the text.
    """
    sent = send(docs.sparkSession, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = received(sent)
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                ws, at = words_of(text), set()
                for n, fps in known.items():
                    h = grams(ws, n or K)
                    if n:
                        at |= {(p, p + n) for p in np.flatnonzero(found(fps, h)).tolist()}
                    else:
                        p = kept(h)
                        at |= {(s, s + SPAN) for x in p[found(fps, h[p])].tolist() for s in range(max(0, x - SPAN + K), min(x, len(ws) - SPAN) + 1)}
                key = sha256(text).digest() if at else b""
                rows += [(key, s, e, window_hash(ws[s:e])) for s, e in sorted(at)]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int32(), pa.binary()))], ["key", "start", "end", "win"])

    return docs.where("text IS NOT NULL").select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "key binary, start int, end int, win binary")


def merged(spans: Column) -> Column:
    """Sorted (start, end) as disjoint spans."""

    def step(acc: Column, s: Column) -> Column:
        now = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(now["start"].alias("start"), F.greatest(now["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), longer).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), step)


def by_join(docs: DataFrame, items: DataFrame, part: int = PART) -> DataFrame:
    """For a benchmark of any size."""
    spark = docs.sparkSession
    tune(spark)
    table = cut(items.select("item", "text").mapInArrow(item_windows, "fp bigint, n int, win binary, item string").distinct(), "items")
    hashes = table.where("fp IS NOT NULL").select("n", "fp")
    parts = math.ceil(hashes.count() / part)
    near = None
    for i in range(parts):
        some = hashes.where(F.pmod(F.xxhash64("fp"), F.lit(parts)) == i).toArrow()  # about ``part`` hashes
        n, fp = some["n"].to_numpy(), some["fp"].to_numpy().view(np.uint64)
        got = meetings(docs, {int(k): np.unique(fp[n == k]) for k in np.unique(n)})
        near = got if near is None else near.unionByName(got)
    if near is None:
        near = spark.createDataFrame([], "key binary, start int, end int, win binary")
    hits = near.distinct().join(table.where("win IS NOT NULL").select("win", "item"), "win")
    each = hits.groupBy("key", "item").agg(merged(F.array_sort(F.collect_set(F.struct("start", "end")))).alias("at"))  # at most a document's windows
    whole = each.groupBy("key").agg(
        F.array_sort(F.flatten(F.collect_list(F.transform("at", lambda s: F.struct(F.col("item"), s["start"].alias("start"), s["end"].alias("end")))))).alias("spans"),
        merged(F.array_sort(F.flatten(F.collect_list("at")))).alias("union"),
    )
    n_hit = F.aggregate("union", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    whole = whole.select(F.col("key").alias("_key"), F.col("spans").cast(SPANS).alias("_spans"), n_hit.alias("_hit"))
    blank = F.regexp_replace(F.col("text"), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", " ")
    n_words = F.coalesce(F.regexp_count(blank, F.lit("[^ ]+")), F.lit(0)).cast("long")
    row, back = packed(docs, *RESULT)
    rows = docs.select(row, n_words.alias("_words"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("_key"))
    return rows.join(whole, "_key", "left").select(*back, F.col("_words").alias("n_words"), F.coalesce("_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("_spans", F.array().cast(SPANS)).alias("spans"))


def kept_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, unchanged."""
    plain = docs.select(F.struct(*columns(docs)).alias("row"), "text")
    return decontaminate(plain, items).where("n_hit = 0").select("row.*")


ship(__name__)
