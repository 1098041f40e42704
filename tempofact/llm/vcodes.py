"""Compression of vectors to four codebook indexes, in integers, with annular norm pruning.

Components become floor(1024 x), vectors are cut into ``PARTS`` equal parts, and each part position has a codebook of
``ENTRIES`` entries that some rounds of assignment and componentwise floor means improve. In all rounds a part finds its
nearest entry so: entries are sorted by norm; those nearest in norm give a first distance D; since the norms of two
vectors differ by at most their distance, only entries with a norm within D of the part's can be nearer or as near, and
a binary search finds that annulus. Parts are taken by norm in blocks, whose annuli are one slice of the codebook; its
distances are exact integers. Ties go to the lower index.

A round is one scan of the table: tasks send counts and sums of their parts by entry, and the driver gets the sums, whose
number is bounded by the codebooks.

Defined results: rows whose vector is null or holds null, NaN or infinite components are left out. Components beyond
``LIMIT`` after scaling count as ``LIMIT``, so that squares fit a long. Vectors that are shorter than the longest kept one, or
of a length that is no multiple of four, count as if zeros followed. Of rows that repeat a vec_id each is a row; a null
vec_id comes after all others in the choice of the first entries, equal ones go by their vector. Fewer rows than entries give
as many entries; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempofact.llm.common import received, salt_mask, salt_of, send, spread, tune
from tempofact.session import cut, ship

PARTS, ENTRIES, ROUNDS, SCALE, LIMIT = 4, 256, 4, 1024, 1 << 26
#: Parts that are searched together, entries that give a part its first distance.
GROUP, SEED = 64, 8


def whole(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` integers, zeros behind shorter vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    flat = np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).astype(np.int64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), dtype=np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class Codebook:
    """Entries of one part position, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        square = (entries * entries).sum(1)
        self.order = np.lexsort((np.arange(len(entries)), square))
        self.entries, self.square = entries[self.order], square[self.order]
        self.norm = np.sqrt(self.square.astype(np.float64))
        self.high = int(np.abs(entries).max(initial=0))

    def distances(self, v: np.ndarray, vv: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Exact squared distances to the entries lo..hi-1."""
        c = self.entries[lo:hi]
        if int(np.abs(v).max(initial=0)) * self.high * max(v.shape[1], 1) < 1 << 52:  # all sums are exact in doubles
            dot = (v.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
        else:
            dot = v @ c.T
        return vv[:, None] + self.square[None, lo:hi] - 2 * dot

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each row's nearest entry, and the distances computed."""
        vv = (v * v).sum(1)
        norm = np.sqrt(vv.astype(np.float64))
        index, best, work = np.zeros(len(v), dtype=np.int64), np.zeros(len(v), dtype=np.int64), 0
        by_norm = np.argsort(norm, kind="stable")
        for g in range(0, len(v), GROUP):
            rows = by_norm[g : g + GROUP]
            x, xx, n = v[rows], vv[rows], norm[rows]
            first = np.searchsorted(self.norm, n) - SEED // 2
            some = np.clip(first[:, None] + np.arange(SEED), 0, len(self.norm) - 1)  # each row's nearest in norm
            apart = x[:, None, :] - self.entries[some]
            reach = np.sqrt((apart * apart).sum(2).min(1).astype(np.float64)) * (1 + 1e-9) + 1e-6 * (1 + n)  # more than what rounding takes
            left = int(np.searchsorted(self.norm, n - reach, side="left").min())
            right = int(np.searchsorted(self.norm, n + reach, side="right").max())
            d = self.distances(x, xx, left, right)
            best[rows] = d.min(1)
            index[rows] = np.where(d == best[rows][:, None], self.order[left:right], len(self.order)).min(1)
            work += len(rows) * (right - left + SEED)
        return index, best, work


def parts_of(v: np.ndarray) -> list[np.ndarray]:
    return np.split(v, PARTS, axis=1)


def sums_of(rows: DataFrame, books: list[np.ndarray], width: int) -> dict[int, int]:
    """Sums by cell: for part p and entry e, cell (p * ENTRIES + e) * (part width + 1) holds a count, those after it componentwise sums."""
    sent, step = send(rows.sparkSession, books), width // PARTS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = [Codebook(b) for b in received(sent)]
        total = np.zeros((PARTS * ENTRIES, step), dtype=np.int64)
        for b in batches:
            for p, v in enumerate(parts_of(integers(b.column(0), width))):
                index = coded[p].nearest(v)[0]
                by = np.argsort(index, kind="stable")
                used, at = np.unique(index[by], return_index=True)
                if len(used):
                    total[p * ENTRIES + used] += np.add.reduceat(np.concatenate([np.ones((len(v), 1), dtype=np.int64), v], axis=1)[by], at)
        flat = total.ravel()
        cells = np.flatnonzero(np.repeat(total[:, 0] > 0, step))
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(flat[cells])], ["cell", "value"])

    got = rows.select("vector").mapInArrow(run, "cell bigint, value bigint").groupBy("cell").agg(F.sum("value").alias("value"))
    return {r["cell"]: r["value"] for r in got.collect()}  # no more than the codebooks have


def fit(rows: DataFrame, width: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds, an array of entries a part."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES)
    start = integers(pa.array([r["vector"] for r in first.collect()], pa.list_(pa.float64())), width)
    books, step = parts_of(start), width // PARTS + 1
    for _ in range(rounds if len(start) else 0):
        got = sums_of(rows, books, width)
        for p, book in enumerate(books):
            for e in range(len(book)):
                at = (p * ENTRIES + e) * step
                if n := got.get(at, 0):
                    book[e] = [got[at + 1 + i] // n for i in range(step - 1)]
    return books


def compress(table: DataFrame) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every kept row of ``table`` (vec_id, embedding, label)."""
    spark = table.sparkSession
    tune(spark, 4000)
    rows = table.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector")).where(whole(F.col("vector")))
    width = -(-(rows.agg(F.max(F.size("vector"))).first()[0] or 0) // PARTS) * PARTS
    books = fit(rows, width)
    sent = send(spark, books)
    said = sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = [Codebook(b) for b in received(sent)]
        for b in batches:
            codes, error = np.zeros((b.num_rows, PARTS), dtype=np.uint8), np.zeros(b.num_rows, dtype=np.int64)
            for p, v in enumerate(parts_of(integers(b.column(2), width))):
                index, d, _ = coded[p].nearest(v)
                codes[:, p] = index
                error += d
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    coded = cut(rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"), "codes")
    key = [F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("of")]
    salt = salt_of(F.struct("vec_id", "code", "error")).alias("salt")
    by_label = coded.select(*key, "error", salt).groupBy("none", "of").agg(F.sum("error").alias("label_error"), salt_mask(F.col("salt")).alias("salts"))
    out = coded.select("*", *key, salt).join(spread(by_label), ["none", "of", "salt"])
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(said).alias("codebooks_sha256"))


ship(__name__)
