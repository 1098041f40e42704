"""Toxicity by a linear-chain conditional random field over words.

Fitting, on a bounded sample of labelled documents (``SAMPLE`` rows): document frequencies of words and word beginnings
in toxic and other documents give each feature a conservative log-odds; a word's evidence is that of its strongest
feature. Words with evidence in toxic documents are the toxic tokens, all others are clean; on those labelled tokens
the chain's emission and transition weights are trained by gradient ascent on the conditional likelihood. A logistic
layer turns the expected number of toxic words (forward-backward marginals), its density and the largest marginal into
a document score.

Scoring reads whole texts. Only words with evidence are steps of the recursion; the words between them have one
emission, so a power of the transfer matrix carries the chain over a gap of any length.

Defined results: null, empty and wordless texts get the score of a document without evidence; without labelled rows
of both kinds every score is 0.5; repeated labels of a document count as toxic if any is; every row gives one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempofact.llm.common import bounded_sample, columns, extended, labelled, packed, received, send, tune
from tempofact.session import cut, ship

SAMPLE, FEATURES, SEQUENCES = 20_000, 50_000, 10_000
FOLDS, HELD, THRESHOLD = 3, 1, 0.7
MIN_DF, LEAST, STEP, BUCKETS = 5, 0.5, 0.5, 13
TOXIC_FROM = 1.0
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")


def features(word: bytes) -> list[str]:
    w = word.decode("utf-8", "replace").lower()
    return ["=" + w, *("^" + w[:k] for k in range(3, min(len(w), 9)))]


def document_features(text: bytes | None) -> set[str]:
    return {f for w in set((text or b"").translate(TABLE).split()) for f in features(w)}


def counted(keep: frozenset[str] | None):  # noqa: ANN201
    """Document frequency of features in a batch; ``keep`` restricts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                got = document_features(text)
                n.update(got if keep is None else got & keep)
            if len(n) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64())], ["f", "n"])
                n.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["f", "n"])

    return run


@dataclass
class Chain:
    """Evidence of features, the chain's weights and the document layer."""

    evidence: dict[str, float]
    emit: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 2)))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    layer: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def bucket(self, word: bytes) -> int:
        s = max((self.evidence.get(f, 0.0) for f in features(word)), default=0.0)
        return 0 if s < LEAST else 1 + min(int((s - LEAST) / STEP), BUCKETS - 2)


def weights_of(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """A lower bound of each feature's log-odds; those of no use are left out."""
    out = {}
    for f, a in toxic.items():
        c = clean.get(f, 0)
        odds = math.log((a + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        bound = odds - 1.64 * math.sqrt(1 / (a + 0.5) + 1 / (c + 0.5)) * 0.5
        if bound >= LEAST:
            out[f] = bound
    return out


class Tagger:
    """Forward-backward over one document, with a cache of words."""

    def __init__(self, chain: Chain):
        self.chain, self.cache = chain, {}
        self.emit = np.exp(chain.emit).tolist()
        m = np.exp(chain.trans) * np.exp(chain.emit[0])[None, :]
        self.squares, self.gaps = [m / m.sum()], {}

    def gap(self, g: int) -> tuple[list, list]:
        """The chain over g plain words: into the next word, and to the end. Powers up to a scale, by squaring."""
        got = self.gaps.get(g)
        if got is None:
            while 1 << len(self.squares) <= g:
                x = self.squares[-1] @ self.squares[-1]
                self.squares.append(x / x.sum())
            p = np.eye(2)
            for k, x in enumerate(self.squares):
                if g >> k & 1:
                    p = p @ x
                    p /= p.sum()
            if len(self.gaps) > 10_000:
                self.gaps.clear()
            got = self.gaps[g] = ((p @ np.exp(self.chain.trans)).tolist(), p.sum(axis=1).tolist())
        return got

    def steps(self, words: list[bytes]) -> list[tuple[int, int]]:
        cache, out = self.cache, []
        if len(cache) > 300_000:
            cache.clear()
        for i, w in enumerate(words):
            k = cache.get(w)
            if k is None:
                k = cache[w] = self.chain.bucket(w)
            if k:
                out.append((i, k))
        return out

    def marginals(self, steps: list[tuple[int, int]], n: int) -> list[float]:
        """P(toxic) at each step. The chain starts clean."""
        fwd, at, a0, a1 = [], -1, 1.0, 0.0
        for i, k in steps:
            g = self.gap(i - at - 1)[0]
            e = self.emit[k]
            b0, b1 = (a0 * g[0][0] + a1 * g[1][0]) * e[0], (a0 * g[0][1] + a1 * g[1][1]) * e[1]
            a0, a1, at = b0 / (b0 + b1), b1 / (b0 + b1), i
            fwd.append((a0, a1))
        out = []
        b0, b1 = self.gap(n - 1 - at)[1]
        for t in range(len(steps) - 1, -1, -1):
            x, y = fwd[t][0] * b0, fwd[t][1] * b1
            out.append(y / (x + y))
            i, k = steps[t]
            g, e = self.gap(i - (steps[t - 1][0] if t else -1) - 1)[0], self.emit[k]
            c0, c1 = g[0][0] * e[0] * b0 + g[0][1] * e[1] * b1, g[1][0] * e[0] * b0 + g[1][1] * e[1] * b1
            b0, b1 = c0 / (c0 + c1), c1 / (c0 + c1)
        return out[::-1]

    def summary(self, text: bytes | None) -> tuple[np.ndarray, list[tuple[int, int]], list[float]]:
        words = (text or b"").translate(TABLE).split()
        steps = self.steps(words)
        p = self.marginals(steps, len(words)) if steps else []
        total = sum(p)
        return np.array([1.0, math.log1p(total), math.log1p(1000 * total / (len(words) + 50)), max(p, default=0.0)]), steps, p

    def spans(self, text: bytes, steps: list[tuple[int, int]], p: list[float], least: float = 0.5) -> list[dict]:
        """Code point ranges of toxic words; neighbours are one span."""
        bad = {i for (i, _), x in zip(steps, p) if x >= least}
        if not bad:
            return []
        at = [m.span() for i, m in enumerate(WORD.finditer(text.translate(TABLE))) if i in bad]
        out: list[list[int]] = []
        for i, (a, b) in zip(sorted(bad), at):
            if out and out[-1][2] == i - 1:
                out[-1][1:] = [b, i]
            else:
                out.append([a, b, i])
        chars = lambda x: len(text[:x].decode("utf-8", "replace"))
        return [{"start": chars(a), "end": chars(b)} for a, b, _ in out]


def sequences_of(chain: Chain):  # noqa: ANN201
    """Labelled tokens: words with evidence and a plain word on either side, as (buckets, labels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(chain)
        for b in batches:
            ids, seqs, marks = [], [], []
            for doc, text, label in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "label"))):
                words = (text or b"").translate(TABLE).split()
                groups: list[list[tuple[int, int]]] = []
                for i, k in tagger.steps(words):
                    if groups and i - groups[-1][-1][0] <= 2 and len(groups[-1]) < 12:
                        groups[-1].append((i, k))
                    else:
                        groups.append([(i, k)])
                for g in groups:
                    seq, mark = [0], [0]
                    for t, (i, k) in enumerate(g):
                        if t and i - g[t - 1][0] == 2:
                            seq.append(0)
                            mark.append(0)
                        seq.append(k)
                        mark.append(int(bool(label) and LEAST + (k - 1) * STEP >= TOXIC_FROM))
                    ids.append(doc)
                    seqs.append([*seq, 0])
                    marks.append([*mark, 0])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seqs, pa.list_(pa.int32())), pa.array(marks, pa.list_(pa.int32()))], ["doc_id", "seq", "mark"])

    return run


def train_chain(seqs: list[list[int]], marks: list[list[int]], rounds: int = 100, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Gradient ascent on the conditional log-likelihood, all distinct sequences at once."""
    emit, trans = np.zeros((BUCKETS, 2)), np.zeros((2, 2))
    if not seqs:
        return emit, trans
    times = Counter((tuple(s), tuple(m)) for s, m in zip(seqs, marks))  # few buckets: many sequences are equal
    n, width, total = len(times), max(map(len, seqs)), len(seqs)
    x, y, on = np.zeros((n, width), int), np.zeros((n, width), int), np.zeros((n, width), bool)
    many = np.array(list(times.values()), float)
    for r, (s, m) in enumerate(times):
        x[r, : len(s)], y[r, : len(s)], on[r, : len(s)] = s, m, True
    seen_e, seen_t = np.zeros_like(emit), np.zeros_like(trans)
    weight = np.broadcast_to(many[:, None], on.shape)
    np.add.at(seen_e, (x[on], y[on]), weight[on])
    both = on[:, 1:]
    np.add.at(seen_t, (y[:, :-1][both], y[:, 1:][both]), weight[:, 1:][both])
    m1, m2 = [np.zeros_like(emit), np.zeros_like(trans)], [np.zeros_like(emit), np.zeros_like(trans)]
    for step in range(1, rounds + 1):
        e, t = np.exp(emit), np.exp(trans)
        fwd, bwd = np.zeros((n, width, 2)), np.ones((n, width, 2))
        fwd[:, 0] = e[x[:, 0]]
        fwd[:, 0] /= fwd[:, 0].sum(1, keepdims=True)
        for i in range(1, width):
            a = (fwd[:, i - 1] @ t) * e[x[:, i]]
            fwd[:, i] = np.where(on[:, i, None], a / a.sum(1, keepdims=True), fwd[:, i - 1])
        for i in range(width - 2, -1, -1):
            a = (bwd[:, i + 1] * e[x[:, i + 1]]) @ t.T
            bwd[:, i] = np.where(on[:, i + 1, None], a / a.sum(1, keepdims=True), bwd[:, i])
        p = fwd * bwd
        p /= p.sum(2, keepdims=True)
        pair = fwd[:, :-1, :, None] * t[None, None] * (bwd[:, 1:] * e[x[:, 1:]])[:, :, None, :]
        pair = pair[both] / pair[both].sum((1, 2), keepdims=True)
        want_e = np.zeros_like(emit)
        np.add.at(want_e, x[on], p[on] * weight[on][:, None])
        pair = (pair * weight[:, 1:][both][:, None, None]).sum(0)
        for j, (w, g) in enumerate(((emit, seen_e - want_e - 0.5 * emit), (trans, seen_t - pair - 0.5 * trans))):
            g = g / total
            m1[j], m2[j] = 0.9 * m1[j] + 0.1 * g, 0.999 * m2[j] + 0.001 * g * g
            w += rate * (m1[j] / (1 - 0.9**step)) / (np.sqrt(m2[j] / (1 - 0.999**step)) + 1e-8)
    return emit, trans


def train_layer(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * len(x) * np.diag([1e-6, 1, 1, 1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * len(x) * np.array([0, 1, 1, 1]) * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Chain:
    """All that reaches the driver is bounded: FEATURES counts, SEQUENCES token sequences, ``bound`` rows of numbers."""
    spark = docs.sparkSession
    tune(spark)
    rows = labelled(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), labels, "toxic", FOLDS, HELD, bound)
    rows = cut(rows.select("doc_id", F.col("text").cast("binary").alias("text"), "label"), "toxic_sample")
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Chain({})
    count = lambda label, keep: rows.where(F.col("label") == label).select("text").mapInArrow(counted(keep), "f string, n bigint").groupBy("f").agg(F.sum("n").alias("n"))
    toxic = {r["f"]: r["n"] for r in count(1, None).where(F.col("n") >= MIN_DF).orderBy(F.desc("n"), "f").limit(FEATURES).collect()}
    clean = {r["f"]: r["n"] for r in count(0, frozenset(toxic)).collect()}
    chain = Chain(weights_of(toxic, clean, n[1], n[0]))
    seqs = bounded_sample(rows.mapInArrow(sequences_of(chain), "doc_id bigint, seq array<int>, mark array<int>"), "doc_id", SEQUENCES).collect()
    chain.emit, chain.trans = train_chain([r["seq"] for r in seqs], [r["mark"] for r in seqs])

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(chain)
        for b in batches:
            xs = [tagger.summary(t)[0].tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), b.column("label")], ["x", "label"])

    got = rows.mapInArrow(summaries, "x array<double>, label int").collect()
    chain.layer = train_layer(np.array([r["x"] for r in got]), np.array([r["label"] for r in got], float))
    return chain


def tag(docs: DataFrame, chain: Chain, with_spans: bool = True) -> DataFrame:
    """Every row with score and, if asked for, spans: the code point ranges of offending words."""
    spark = docs.sparkSession
    tune(spark)
    model = send(spark, chain)
    ranges = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    row, back = packed(docs, "score", "spans")
    rest = docs.select(row, F.col("text").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(received(model))
        layer = tagger.chain.layer
        for b in batches:
            scores, spans = [], []
            for text in b.column("_text").to_pylist():
                x, steps, p = tagger.summary(text)
                scores.append(1 / (1 + math.exp(-max(-50.0, min(50.0, float(x @ layer))))))
                spans.append(tagger.spans(text, steps, p) if with_spans and steps else [])
            own = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(scores, pa.float64()), pa.array(spans, ranges)], [*b.schema.names[:-1], "score", "spans"])

    return rest.mapInArrow(run, extended(rest, "score double, spans array<struct<start:int,end:int>>", "_text")).select(*back, "score", "spans")


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not toxic, unchanged."""
    plain = docs.select(F.struct(*columns(docs)).alias("row"), "text")
    return tag(plain, fit(docs, labels), with_spans=False).where(F.col("score") < threshold).select("row.*")


ship(__name__)
