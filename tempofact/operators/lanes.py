"""Retrieval lanes: exact cosine top-k of one question or many, Okapi keyword top-k. Approximate top-k is in ann."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tempofact.session import ship

K1, B = 1.5, 0.75
#: Questions that a scan of all rows serves.
ASKED = 4096
#: Questions and rows whose distances are held at once.
TILE = (256, 1024)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def vector_top_k(vectors: DataFrame, query: list[float], k: int = 50, id_col: str = "vec_id") -> DataFrame:
    """(id, distance) of the k nearest; ties by id. The query is a literal, so each task keeps its own top k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where("embedding IS NOT NULL").select(F.col(id_col).alias("id"), cosine_distance(F.col("embedding"), q).alias("distance")).orderBy("distance", "id").limit(k)


def unit_rows(column: pa.Array, size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit vectors of the rows of ``size`` components (None: as many as the first) that are finite and not zero."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if size is None:
        size = int(lengths[lengths > 0][0]) if (lengths > 0).any() else 0
    at = np.flatnonzero(lengths == size) if size else np.zeros(0, dtype=int)
    x = column.take(pa.array(at, pa.int64())).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), size)
    length = np.sqrt((x * x).sum(1))
    ok = np.isfinite(length) & (length > 0)
    return at[ok], x[ok] / length[ok, None]


class Nearest:
    """The ``k`` nearest rows of each of ``n`` questions so far, by distance, then id; each with the tag of its tile."""

    def __init__(self, n: int, k: int):
        self.away, self.ids, self.tags, self.k = np.full((n, k), np.inf), np.zeros((n, k), dtype=np.int64), np.zeros((n, k), dtype=np.int32), k

    def take(self, first: int | np.ndarray, away: np.ndarray, ids: np.ndarray, tag: int = 0) -> None:
        """A tile of distances from questions ``first`` and on (or those listed) to rows ``ids``; infinite ones are no neighbours."""
        k, who = self.k, np.asarray(first) if np.ndim(first) else first + np.arange(len(away))
        least = np.partition(away, min(k, away.shape[1]) - 1, axis=1)[:, min(k, away.shape[1]) - 1]
        q, r = np.nonzero((away <= np.minimum(least, self.away[who].max(1))[:, None]) & np.isfinite(away))
        if not len(q):
            return
        asks = np.unique(q)
        kept = who[asks]
        row = np.concatenate([np.repeat(asks, k), q])
        d, i = np.concatenate([self.away[kept].ravel(), away[q, r]]), np.concatenate([self.ids[kept].ravel(), ids[r]])
        tags = np.concatenate([self.tags[kept].ravel(), np.full(len(q), tag, dtype=np.int32)])
        order = np.lexsort((i, d, row))
        row = row[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        best = nth < k
        at, order = (who[row[best]], nth[best]), order[best]
        self.away[at], self.ids[at], self.tags[at] = d[order], i[order], tags[order]


def closest(rows: DataFrame, queries: list[tuple[int, int, list[float] | None]], k: int) -> DataFrame:
    """(query_id, id, distance): for each of ``queries`` (id, bit, vector) the ``k`` nearest of ``rows`` (id, seen, v) that show its bit.

    A task keeps ``k`` rows a question and the distances of one ``TILE``; distances are rounded to 9 digits, ties go by id. Null and zero vectors,
    and those of another length, are near nothing: such a question has an empty lane.
    """
    good = [(i, b, np.array(v, dtype=float)) for i, b, v in queries if v and None not in v and np.linalg.norm(np.array(v, dtype=float)) > 0]
    sizes = sorted({len(v) for _, _, v in good})
    plan = [(d, np.array([i for i, _, v in good if len(v) == d]), np.array([b for _, b, v in good if len(v) == d]), np.stack([v / np.linalg.norm(v) for _, _, v in good if len(v) == d])) for d in sizes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Nearest(len(qid), k) for _, qid, _, _ in plan]
        for batch in batches:
            ids, seen = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for (d, _, bit, q), best in zip(plan, held):
                at, x = unit_rows(batch.column(2), d)
                for i in range(0, len(at), TILE[1]):
                    some = at[i : i + TILE[1]]
                    for j in range(0, len(q), TILE[0]):
                        away = np.round(1 - q[j : j + TILE[0]] @ x[i : i + TILE[1]].T, 9)
                        away[((seen[some][None, :] >> bit[j : j + TILE[0], None]) & 1) == 0] = np.inf
                        best.take(j, away, ids[some])
        for (_, qid, _, _), best in zip(plan, held):
            at, n = np.nonzero(np.isfinite(best.away))
            yield pa.RecordBatch.from_arrays([pa.array(qid[at], pa.int64()), pa.array(best.ids[at, n], pa.int64()), pa.array(best.away[at, n], pa.float64())], ["query_id", "id", "distance"])

    near = rows.mapInArrow(run, "query_id bigint, id bigint, distance double")
    return near.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("_n") <= k).drop("_n")


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, id, distance, rank): exact k nearest other rows of each query vector, a stated query set against all rows.

    The queries go to all tasks in blocks of ``ASKED``; each block is one scan of the rows, and k rows a query and task go on.
    """
    rows = vectors.where("embedding IS NOT NULL AND vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("id"), F.lit(1).cast("long").alias("seen"), "embedding")
    wanted = queries.where("query_id IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
    blocks = max(1, -(-wanted.count() // ASKED))
    out = None
    for block in range(blocks):
        some = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        near = closest(rows, [(r.query_id, 0, r.query) for r in some.collect()], k + 1)  # one of them may be the query itself
        out = near if out is None else out.unionByName(near)
    return out.where("id <> query_id").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def keyword_top_k(docs: DataFrame, query: list[str], k: int = 30, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, bm25, distance) by Okapi BM25. Only the query's terms become postings; lengths come from the same scan."""
    terms = sorted(set(query))
    if not terms:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("bm25"), F.lit(1.0).alias("distance")).limit(0)
    counted = docs.select(F.col(id_col).alias("id"), tokens(F.col(text)).alias("w"))
    count = lambda t: F.size(F.filter("w", lambda x: x == t))
    tf = [count(t) for t in terms]
    rows = counted.select("id", F.size("w").alias("len"), F.array(*tf).alias("tf"))
    seen = [F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), *seen)
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        t = F.col("tf")[i]
        score = score + idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    top = rows.join(F.broadcast(stats)).select("id", score.alias("bm25")).where("bm25 > 0").orderBy(F.desc("bm25"), "id").limit(k)
    best = F.max("bm25").over(W.partitionBy(F.lit(0)))  # over at most k rows
    return top.select("id", "bm25", (1 - F.col("bm25") / best).alias("distance"))


ship(__name__)
