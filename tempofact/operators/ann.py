"""Approximate nearest neighbours: coarse cells on disk, residual codes, several probes, exact distances of a short list.

Cells (k-means centroids of unit vectors), the step of the codes and the number of probes that reaches the wanted recall are
fitted on a bounded sample, chosen by a hash of the id. Every row is then assigned to its nearest cell and written twice in
that cell's folder: its residual as one byte a dimension, and the vector itself. A search ranks the codes of the probed
cells and reads the vectors of the best ``SHORT`` x k rows alone. On vectors without clusters a wanted recall needs
many cells; that is what the fit finds out, and what is saved there is the size of the codes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tempofact.operators.lanes import ASKED, TILE, Nearest, cosine_distance, unit_rows
from tempofact.session import shared_dir, ship

SAMPLE, CELLS, SHORT = 20_000, 128, 4


@dataclass
class Cells:
    centroids: np.ndarray
    step: np.ndarray
    probes: int

    def of(self, v: np.ndarray) -> np.ndarray:
        return (v @ self.centroids.T).argmax(1) if len(v) else np.zeros(0, dtype=int)

    def codes(self, v: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((v - self.centroids[cell]) / self.step), -127, 127).astype(np.int8)


def kmeans(v: np.ndarray, cells: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    centres = v[np.random.default_rng(seed).choice(len(v), cells, replace=False)].copy()
    for _ in range(rounds):
        at = (v @ centres.T).argmax(1)
        for c in np.unique(at):
            centres[c] = v[at == c].mean(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE, wanted: float = 0.95, k: int = 10) -> Cells | None:
    """Cells from at most ``sample`` rows of ``vectors`` (vec_id, embedding); None without a usable vector."""
    rows = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    v = unit_rows(rows.column(0).combine_chunks(), None)[1]
    if not len(v):
        return None
    cells = max(1, min(cells, len(v) // 4))
    centres = kmeans(v, cells)
    at = (v @ centres.T).argmax(1)
    left = v - centres[at]
    asked = v[: min(256, len(v))]
    near = asked @ v.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    true = np.argsort(-near, axis=1)[:, : min(k, len(v) - 1)]
    turn = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)  # a cell's place among a query's probes
    needed = np.sort(np.take_along_axis(turn, at[true], axis=1).ravel()) if true.size else np.zeros(1, dtype=int)
    probes = int(needed[min(len(needed) - 1, int(np.ceil(wanted * len(needed))) - 1)]) + 1
    return Cells(centres, np.maximum(np.abs(left).max(0) / 127, 1e-9), probes)


class AnnIndex:
    def __init__(self, spark: SparkSession, path: str, cells: Cells | None):
        self.spark, self.path, self.cells = spark, path, cells

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def build(vectors: DataFrame, path: str | None = None, **how: object) -> AnnIndex:
    """Index every row of ``vectors`` with a usable vector: not null, of the fitted length, finite and not zero."""
    spark = vectors.sparkSession
    path = path or f"{shared_dir(spark)}/tempofact/ann-{uuid.uuid4().hex}"
    cells = fit(vectors, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if cells is None:
                continue
            at, v = unit_rows(b.column(1), cells.centroids.shape[1])
            cell = cells.of(v)
            codes = [c.tobytes() for c in cells.codes(v, cell)]
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column(0).take(pa.array(at)), pa.array(codes, pa.binary()), b.column(1).take(pa.array(at))], ["cell", "id", "code", "embedding"])

    rows = vectors.where("embedding IS NOT NULL AND vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    done = rows.mapInArrow(run, "cell int, id bigint, code binary, embedding array<float>").repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
    done.write.partitionBy("cell").parquet(f"{path}/rows")  # columns apart: a scan of codes reads no vector
    return AnnIndex(spark, path, cells)


def short_lists(index: AnnIndex, queries: list[tuple[int, list[float] | None]], n: int) -> DataFrame:
    """(query_id, cell, id): of the cells that a query probes the ``n`` best rows by code, ties by id.

    A task keeps ``n`` rows a query and the distances of one ``TILE``; distances are rounded to 9 digits, so that copies of a vector tie.
    """
    cells = index.cells
    at, q = unit_rows(pa.array([v for _, v in queries], pa.list_(pa.float64())), cells.centroids.shape[1])
    qid = np.array([i for i, _ in queries], dtype=np.int64)[at]
    toward = q @ cells.centroids.T
    probed = np.argsort(np.argsort(-toward, axis=1, kind="stable"), axis=1) < cells.probes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(len(qid), n)
        for b in batches:
            cell, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            codes = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.int8).reshape(len(ids), -1)
            for c in np.unique(cell):
                rows, asks = np.flatnonzero(cell == c), np.flatnonzero(probed[:, c])
                for i in range(0, len(rows), TILE[1]):
                    part = rows[i : i + TILE[1]]
                    x = cells.centroids[c] + codes[part] * cells.step
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    for k in range(0, len(asks), TILE[0]):
                        who = asks[k : k + TILE[0]]
                        away = np.round(1 - q[who] @ x.T, 9)
                        away[qid[who][:, None] == ids[part][None, :]] = np.inf
                        best.take(who, away, ids[part], int(c))
        at, nth = np.nonzero(np.isfinite(best.away))
        cols = (qid[at], pa.int64()), (best.tags[at, nth], pa.int32()), (best.ids[at, nth], pa.int64()), (best.away[at, nth], pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in cols], ["query_id", "cell", "id", "away"])

    wanted = np.flatnonzero(probed.any(0)).tolist()
    near = index.read("rows").where(F.col("cell").isin(wanted)).select("cell", "id", "code").mapInArrow(run, "query_id bigint, cell int, id bigint, away double")
    first = F.row_number().over(W.partitionBy("query_id").orderBy("away", "id"))
    return near.withColumn("_n", first).where(F.col("_n") <= n).select("query_id", "cell", "id")


def asked(queries: DataFrame) -> DataFrame:
    return queries.where("query_id IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))


def listed(index: AnnIndex, queries: DataFrame, n: int) -> DataFrame:
    """``short_lists`` of a stated set of queries (query_id, query), whose vectors go to all tasks in blocks of ``ASKED``."""
    wanted = asked(queries)
    blocks = max(1, -(-wanted.count() // ASKED))
    out = None
    for block in range(blocks if index.cells else 0):
        some = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        got = short_lists(index, [(r.query_id, r.query) for r in some.collect()], n)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else wanted.select("query_id", F.lit(0).alias("cell"), F.col("query_id").alias("id")).limit(0)


def search(index: AnnIndex, queries: DataFrame, k: int = 10, short: int = SHORT, lists: DataFrame | None = None) -> DataFrame:
    """(query_id, id, distance, rank): about the k nearest other rows of each query (query_id, query), by exact distance.

    ``lists`` are those of ``listed`` for ``short`` x k rows, if they are there already.
    """
    if not index.cells:
        return asked(queries).select("query_id", F.col("query_id").alias("id"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).limit(0)
    lists = listed(index, queries, short * k) if lists is None else lists
    got = lists.join(index.read("rows").select("cell", "id", "embedding"), ["cell", "id"]).join(asked(queries), "query_id")
    out = got.select("query_id", "id", cosine_distance(F.col("embedding"), F.col("query")).alias("distance"))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries and the share of the ``exact`` pairs (query_id, id) that were found."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


ship(__name__)
