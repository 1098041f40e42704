"""Language identification with bit-sliced Bloom filters of character n-grams.

One filter for each language, stored sliced: a slot holds a bit for every language, so the slots of one n-gram, taken
together with AND, are the bitmask of all languages that contain it. A text's score for a language is the share of its
n-grams found there, corrected for the filter's false positives: (share - f) / (1 - f).

Fitting counts document frequencies of n-grams on a bounded sample (about ``PER_LANGUAGE`` documents of each language, or
fewer of each where languages are so many that these were over ``ROWS``, drawn by a hash of doc_id). A language contains the n-grams that occur in at least ``COMMON`` of its documents and are not
``RARE`` times rarer there than elsewhere, which keeps stray labels and quotations out.

Defined results: ``und`` with score 0 for null texts and texts without letters (or if nothing was learnt); ties go to
the first language by name; every row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempofact.llm.common import extended, fold_of, packed, received, send, tune
from tempofact.session import ship

PER_LANGUAGE, ROWS, FOLDS, HELD = 2000, 1_000_000, 4, 2
COMMON, RARE, HASHES = 0.02, 0.2, 4
SPACE = 32
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(text: str | None, letters: np.ndarray) -> np.ndarray:
    """Hashes of all 3-grams and 4-grams within words, whose edges count as a space. Empty if there is no letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    is_letter = letters[c]
    if not is_letter.any():
        return np.zeros(0, dtype=np.uint64)
    c = np.where(is_letter, c, SPACE)
    gap = c == SPACE
    c = c[~(gap & np.concatenate(([True], gap[:-1])))]  # one space between words, none in front
    c = np.concatenate(([SPACE], c, [SPACE])).astype(np.uint64)
    gap = c == SPACE
    h3 = (c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:]
    three = h3[~gap[1:-1]]
    h4 = (h3[:-1] * A) ^ (c[3:] + B)
    four = h4[~(gap[1:-2] | gap[2:-1])]
    return np.concatenate((three, four))


def slots(grams: np.ndarray, size: int, j: int) -> np.ndarray:
    x = (grams ^ (grams >> np.uint64(31))) * A
    x ^= x >> np.uint64(29)
    y = (x * B) >> np.uint64(17) | np.uint64(1)
    return (x + np.uint64(j) * y) & np.uint64(size - 1)


@dataclass
class Filters:
    """slices: for each 64 languages an array of slot bitmasks."""

    languages: list[str]
    size: int
    slices: list[np.ndarray]
    false_rate: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> Filters:
        languages = sorted(grams)
        most = max((len(g) for g in grams.values()), default=0)
        size = 1 << max(10, int(12 * most - 1).bit_length()) if most else 1024
        slices = [np.zeros(size, dtype=np.uint64) for _ in range(0, len(languages), 64)]
        rate = np.zeros(len(languages))
        for i, lang in enumerate(languages):
            bit = np.uint64(1 << (i % 64))
            for j in range(HASHES):
                slices[i // 64][slots(grams[lang], size, j)] |= bit
            rate[i] = float(((slices[i // 64] & bit) != 0).mean()) ** HASHES
        return cls(languages, size, slices, rate)

    def shares(self, grams: np.ndarray) -> np.ndarray:
        at = [slots(grams, self.size, j) for j in range(HASHES)]
        hits = np.zeros(len(self.languages))
        for s, table in enumerate(self.slices):
            mask = table[at[0]]
            for x in at[1:]:
                mask &= table[x]
            for i in range(s * 64, min(s * 64 + 64, len(self.languages))):
                hits[i] = np.count_nonzero(mask & np.uint64(1 << (i % 64)))
        return np.maximum(0.0, (hits / len(grams) - self.false_rate) / (1 - self.false_rate))

    def decide(self, grams: np.ndarray) -> tuple[str, float]:
        if not len(grams) or not self.languages:
            return "und", 0.0
        p = self.shares(grams)
        best = int(np.argmax(p))
        return self.languages[best], float(min(1.0, p[best]))


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = letter_table()
    for b in batches:
        by: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
            by.setdefault(lang, []).append(np.unique(ngrams(text, letters)))
        for lang, sets in by.items():
            g, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Filters:
    tune(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != HELD)).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not sizes:
        return Filters.build({})
    per_language = max(1, min(per_language, ROWS // len(sizes)))
    quota = docs.sparkSession.createDataFrame([(lang, min(1.0, per_language / n), max(2.0, COMMON * min(n, per_language))) for lang, n in sizes.items()], "lang string, share double, floor double")
    drawn = F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.join(F.broadcast(quota), "lang").where(drawn < F.col("share")).select("text", "lang")  # a row a language
    counts = sample.mapInArrow(gram_counts, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counts.join(F.broadcast(quota), "lang").where((F.col("n") >= F.col("floor")) | (F.col("n") >= 1) & (F.lit(max(sizes.values()) < 2))).select("lang", "gram", "n").collect()  # at most 1 / COMMON times a document's n-grams
    top: dict[int, float] = {}
    rates = [(r["lang"], r["gram"], r["n"] / min(sizes[r["lang"]], per_language)) for r in got]
    for _, g, x in rates:
        top[g] = max(top.get(g, 0.0), x)
    grams: dict[str, list[int]] = {lang: [] for lang in sizes}
    for lang, g, x in rates:
        if x >= RARE * top[g]:
            grams[lang].append(g)
    return Filters.build({lang: np.array(sorted(g), dtype=np.int64).view(np.uint64) for lang, g in grams.items()})


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """Every row with lang_pred and score."""
    spark = docs.sparkSession
    tune(spark)
    model = send(spark, filters)  # a few bytes for each n-gram kept
    row, back = packed(docs, "lang_pred", "score")
    rest = docs.select(row, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, filters = letter_table(), received(model)
        for b in batches:
            got = [filters.decide(ngrams(t, letters)) for t in b.column("_text").to_pylist()]
            own = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    return rest.mapInArrow(run, extended(rest, "lang_pred string, score double", "_text")).select(*back, "lang_pred", "score")


ship(__name__)
