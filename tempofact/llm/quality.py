"""Quality classification by a factorisation machine.

Features of a text: hashed words (normalised log counts), structure statistics and size metadata, the latter two cut
into quantile bins. Every pair of features interacts through vectors of low rank; by the sum-of-squares identity a
score costs time linear in the features: sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2.

Fitted by mini-batch Adam on a bounded sample (``SAMPLE`` rows) of the labelled documents outside the held-out fold.

Defined results: null texts count as empty; without labelled rows of both kinds every score is 0.5; repeated labels of
a document count as the largest; every row gives one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempofact.llm.common import extended, labelled, packed, received, send, tune
from tempofact.session import cut, ship

SAMPLE, FOLDS, HELD, THRESHOLD = 6_000, 5, 0, 0.3
HASHED, BINS, RANK = 4096, 8, 8
LOWER, UPPER, DIGIT, BLANK, LINE, STOP, PUNCT, SYMBOL, OTHER = range(9)
STATS = 14


def class_table() -> np.ndarray:
    """The class of each byte."""
    t = np.full(256, SYMBOL, dtype=np.uint8)
    t[97:123], t[65:91], t[48:58], t[128:] = LOWER, UPPER, DIGIT, OTHER
    for chars, kind in ((b" \t\r\x0b\x0c", BLANK), (b"\n", LINE), (b".!?", STOP), (b",;:'\"()-", PUNCT)):
        t[list(chars)] = kind
    return t


def statistics(text: bytes, words: list[bytes], h: np.ndarray, classes: np.ndarray) -> list[float]:
    n = np.bincount(classes[np.frombuffer(text, dtype=np.uint8)], minlength=9).astype(float)
    size, count = max(len(text), 1), max(len(words), 1)
    distinct, times = np.unique(h, return_counts=True)
    letters = max(n[LOWER] + n[UPPER] + n[OTHER], 1.0)
    return [
        math.log1p(len(text)), math.log1p(len(words)), n[UPPER] / letters, n[SYMBOL] / size, n[DIGIT] / size, n[STOP] / count, n[PUNCT] / count, n[LINE] / count,
        (n[LOWER] + n[UPPER] + n[OTHER]) / size, size / count, len(distinct) / count, float(times.max(initial=0)) / count,
        float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0, len(distinct) / math.sqrt(count),
    ]


def describe(text: bytes | None, classes: np.ndarray) -> tuple[list[float], np.ndarray, np.ndarray]:
    """Statistics, hashed word buckets and their values."""
    text = text or b""
    words = text.lower().split()
    h = np.fromiter(map(crc32, words), dtype=np.int64, count=len(words))
    n = np.bincount(h & (HASHED - 1), minlength=HASHED)
    idx = np.flatnonzero(n)
    val = np.log1p(n[idx])
    return statistics(text, words, h, classes), idx, val / max(float(np.sqrt((val * val).sum())), 1e-9)


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    classes = class_table()
    for b in batches:
        got = [describe(t, classes) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("label"), pa.array([g[0] for g in got], pa.list_(pa.float64())), pa.array([g[1] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.list_(pa.float32()))],
            ["label", "stats", "idx", "val"],
        )


@dataclass
class Machine:
    """Bin edges for the statistics; bias, weights and vectors for HASHED words, then STATS * BINS bins."""

    edges: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def row(self, stats: list[float], idx: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins = [HASHED + i * BINS + int(np.searchsorted(e, x, side="right")) for i, (e, x) in enumerate(zip(self.edges, stats))]
        return np.concatenate((idx, bins)), np.concatenate((val, np.full(len(bins), 1 / math.sqrt(STATS))))

    def score(self, idx: np.ndarray, val: np.ndarray) -> float:
        vx = self.v[idx] * val[:, None]
        s = vx.sum(axis=0)
        z = self.bias + float(self.w[idx] @ val) + 0.5 * float((s * s).sum() - (vx * vx).sum())
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def train(stats: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = 600, rounds: int = 8, batch: int = 128, rate: float = 0.02, seed: int = 5) -> Machine:
    """At least ``rounds`` passes and ``steps`` batches."""
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    size = HASHED + STATS * BINS
    rng = np.random.default_rng(seed)
    m = Machine(edges, float(np.log(y.mean() / (1 - y.mean()))), np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    x = [m.row(s, i, v) for s, (i, v) in zip(stats.tolist(), rows)]
    first, second, step = [np.zeros(size), np.zeros((size, RANK))], [np.zeros(size), np.zeros((size, RANK))], 0
    for _ in range(max(rounds, math.ceil(steps / math.ceil(len(y) / batch)))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            idx, val = np.concatenate([x[i][0] for i in some]), np.concatenate([x[i][1] for i in some])
            start = np.concatenate(([0], np.cumsum([len(x[i][0]) for i in some])[:-1]))
            of = np.repeat(np.arange(len(some)), [len(x[i][0]) for i in some])
            vx = m.v[idx] * val[:, None]
            s = np.add.reduceat(vx, start)
            z = m.bias + np.add.reduceat(m.w[idx] * val, start) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), start))
            err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[some]) / len(some)
            gw, gv = np.zeros(size), np.zeros((size, RANK))
            np.add.at(gw, idx, err[of] * val)
            np.add.at(gv, idx, (err[of] * val)[:, None] * (s[of] - vx))
            step += 1
            m.bias -= rate * float(err.sum())
            for j, (p, g) in enumerate(((m.w, gw + 2e-5 * m.w), (m.v, gv + 2e-5 * m.v))):
                first[j], second[j] = 0.9 * first[j] + 0.1 * g, 0.999 * second[j] + 0.001 * g * g
                p -= rate * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
    return m


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Machine | None:
    """The driver gets the features of at most ``bound`` documents, of at most HASHED words each."""
    tune(docs.sparkSession)
    rows = labelled(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), labels, "quality", FOLDS, HELD, bound)
    sample = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "label")
    got = cut(sample.mapInArrow(described, "label int, stats array<double>, idx array<int>, val array<float>"), "quality_sample")
    got = got.toArrow()
    y = got["label"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    stats, idx, val = (got[c].to_pylist() for c in ("stats", "idx", "val"))
    order = sorted(range(len(y)), key=lambda i: (y[i], stats[i]))  # however tasks ended
    return train(np.array([stats[i] for i in order]), [(np.array(idx[i], dtype=np.int64), np.array(val[i], dtype=float)) for i in order], y[order])


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """Every row with its score."""
    spark = docs.sparkSession
    tune(spark)
    model = send(spark, machine)  # fixed size
    row, back = packed(docs, "score")
    rest = docs.select(row, F.col("text").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, classes = received(model), class_table()
        for b in batches:
            scores = [m.score(*m.row(*describe(t, classes))) if m else 0.5 for t in b.column("_text").to_pylist()]
            own = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(scores, pa.float64())], [*b.schema.names[:-1], "score"])

    return rest.mapInArrow(run, extended(rest, "score double", "_text")).select(*back, "score")


ship(__name__)
