"""Substring deduplication over sliding spans of sentences.

A sentence ends after . ! or ? before white space, or at a line break; a sentence is the unit, whatever its length.
Sentences are compared by their words, lower-cased, without punctuation. Every run of at least ``SENTENCES``
consecutive sentences and ``WORDS`` words is a span. The shortest spans from each sentence on and up to each sentence
cover all longer ones, so these are hashed, once a document, and joined globally. Of a span that several documents
hold, the one with the least doc_id keeps it; in all others every sentence that it covers is removed. A span that
one document repeats by itself is removed only with ``within``, all but its first occurrence.

Hashes go through two shuffles: one finds the least document of each repeated hash by a map-side minimum, one takes
that back to the documents through (hash, salt). No occurrences are gathered and a hot hash is split. Texts are
shuffled once, to meet their repeated hashes.

Defined results: null texts stay null; texts without words stay as they are; rows that repeat doc_id are one document
and no repeats of each other; rows without doc_id are documents by their text, before all others; every row gives one
row; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempofact.llm.common import extended, packed, salt_mask, salt_of, spread, tune
from tempofact.session import cut, ship

#: Of 36,872 documents that share no 20 words with another, spans of 16 words touch 1.0 %, spans of 20 words none.
SENTENCES, WORDS = 2, 20
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BOUNDARY = re.compile(rb"[.!?]+(?:\s+|$)|\s*\n\s*")


def sentences(text: bytes) -> tuple[list[int], list[list[bytes]]]:
    """Start offsets and words; parts without words belong to the sentence before, or to the first."""
    plain, starts, words = text.translate(TABLE), [], []
    at = 0
    for end in [*(m.end() for m in BOUNDARY.finditer(text)), len(text)]:
        ws = plain[at:end].split()
        if ws:
            starts.append(at)
            words.append(ws)
            at = end
        elif words:
            at = end
    return starts, words


def runs(words: list[list[bytes]]) -> list[tuple[int, int, int]]:
    """(hash, first sentence, sentence after the last) of the shortest spans from and up to each sentence."""
    n = len(words)
    if n < SENTENCES:
        return []
    size = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    i = np.arange(n)
    to = np.maximum(np.searchsorted(size, size[:-1] + WORDS, side="left"), i + SENTENCES)
    back = np.minimum(np.searchsorted(size, size[1:] - WORDS, side="right") - 1, i + 1 - SENTENCES)
    spans = {(int(a), int(b)) for a, b in zip(i, to) if b <= n} | {(int(a), int(b) + 1) for a, b in zip(back, i) if a >= 0}
    joined = [b" ".join(w) for w in words]
    h = xxhash.xxh64_intdigest
    return [(h(b" ".join(joined[a:b])), a, b) for a, b in sorted(spans)]


def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(own, text) to (k, own): the distinct hashes of a text's spans."""
    for b in batches:
        keys, owners = [], []
        for own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got = np.unique(np.array([r[0] for r in runs(sentences(text)[1])] if text else [], dtype=np.uint64))
            keys.append(got)
            owners.append(np.full(len(got), own, dtype=np.int64))
        k = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.concatenate(owners) if owners else [], pa.int64())], ["k", "own"])


def owner() -> Column:
    """The document of a row: its doc_id, or a number below all usual ids made from its text."""
    unnamed = F.lit(-(1 << 63)) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    return F.coalesce(F.col("doc_id").cast("bigint"), unnamed)


def repeats(docs: DataFrame) -> DataFrame:
    """(own, ks): the hashes of spans that an earlier document holds, for documents that have some.

    ``ks`` is bounded by a document's own sentences.
    """
    tune(docs.sparkSession, 500)
    texts = docs.select(owner().alias("own"), F.col("text").cast("binary").alias("text"))
    found = cut(texts.mapInArrow(run_batches, "k bigint, own bigint"), "spans")
    salt = salt_of(F.col("own"))
    again = found.groupBy("k").agg(F.min("own").alias("first"), F.max("own").alias("last"), salt_mask(salt).alias("salts")).where("first < last").select("k", "first", "salts")
    later = found.withColumn("salt", salt).join(spread(again), ["k", "salt"]).where("own > first")
    return later.groupBy("own").agg(F.collect_set("k").alias("ks"))


def removed(words: list[list[bytes]], bad: set[int], within: bool) -> np.ndarray:
    """Which sentences lie in a span of ``bad``, or with ``within`` in a later occurrence of an own one."""
    out, seen = np.zeros(len(words), dtype=bool), set()
    for h, a, b in runs(words) if bad or within else ():
        if h in bad or within and h in seen:
            out[a:b] = True
        seen.add(h)
    return out


def dedup_spans(docs: DataFrame, within: bool = False) -> DataFrame:
    """Every row with its text cut, n_sentences, n_removed and removed (code point ranges of the old text)."""
    bad = repeats(docs).withColumnsRenamed({"own": "_own", "ks": "_ks"})
    row, back = packed(docs, "text", "n_sentences", "n_removed", "removed")
    rows = docs.select(row, owner().alias("_own"), F.col("text").cast("binary").alias("_text")).join(bad, "_own", "left").drop("_own")
    tune(docs.sparkSession, 500)
    ranges = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, ks in zip(b.column("_text").to_pylist(), b.column("_ks").to_pylist()):
                starts, words = sentences(text) if text else ([], [])
                gone = np.flatnonzero(removed(words, {k & (1 << 64) - 1 for k in ks or ()}, within)).tolist()
                cuts = [(starts[i], starts[i + 1] if i + 1 < len(starts) else len(text)) for i in gone]
                for x, v in zip(out, (kept_text(text, cuts), len(starts), len(gone), chars(text, cuts))):
                    x.append(v)
            own = [b.column(i) for i in range(b.num_columns - 2)]
            kinds = (pa.string(), pa.int64(), pa.int64(), ranges)
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, k) for x, k in zip(out, kinds))], [*b.schema.names[:-2], "text", "n_sentences", "n_removed", "removed"])

    return rows.mapInArrow(run, extended(rows, "text string, n_sentences bigint, n_removed bigint, removed array<struct<start:int,end:int>>", "_text", "_ks")).select(*back, "text", "n_sentences", "n_removed", "removed")


def kept_text(text: bytes | None, cuts: list[tuple[int, int]]) -> str | None:
    if text is None:
        return None
    if not cuts:
        return text.decode("utf-8", "replace")
    parts, at = [], 0
    for a, b in cuts:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]]).decode("utf-8", "replace").rstrip()


def chars(text: bytes | None, cuts: list[tuple[int, int]]) -> list[dict]:
    out, at, n = [], 0, 0
    for a, b in cuts:
        n += len(text[at:a].decode("utf-8", "replace"))
        m = n + len(text[a:b].decode("utf-8", "replace"))
        if out and out[-1]["end"] == n and at == a:
            out[-1]["end"] = m
        else:
            out.append({"start": n, "end": m})
        at, n = b, m
    return out


ship(__name__)
