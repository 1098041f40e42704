"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Documents become token ids and an end id; those over the sequence size are cut. Only piece lengths decide a packing, and there
are no more of them than the sequence size, so the packing is planned on their histogram and for all pieces of a length
at once. A set of pieces dominates another when each piece of the other can be exchanged for one that is no smaller (or a
group of them for one) and still fits; a set with piece w that dominates all sets with w is fixed as a sequence, and
fixing it never costs a sequence:

* w alone, where nothing fits beside it;
* w and the longest j that fits, where j fills the rest, or nothing fits beside w and any other piece;
* where two more fit at most: w and j, if no two pieces together are longer than j; w, j and the longest l that fits beside
  them, if each pair that fits has its shorter piece no longer than l, or fits into j.

Fixing shrinks the instance, so the rules run until none applies. What remains is packed best-fit from the longest down:
sequences that hold the same lengths are one group with a count. The plan is a list of patterns, at most some thousands.

Pieces then find their places without being gathered: a piece's rank among those of its length is its rank within its task plus
the counts of the tasks before, and the plan maps (length, rank) to a sequence and an offset.

Defined results: a null text is empty, and an empty text is one piece, the end id; every row has its own pieces, also where
ids are null or repeat; control strings of the vocabulary in a text are encoded as the tokenizer does by default; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import sys
import types
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tempofact.llm.common import received, send, tune
from tempofact.session import cut, ship

SIZE, END = 2048, 0
#: Bytes of texts that are encoded together, and of remembered words.
GROUP_BYTES, KEPT_BYTES = 1 << 20, 96 << 20
#: A word of Latin letters and the marks that may follow it: two units of the tokenizer's own pattern.
WORD = re.compile(r"([a-zß-öø-ÿ]+)([.,;:!?]*)")


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones themselves, others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Whole texts to 32-bit ids (of little-endian machines), word by word: white space parts the units of this vocabulary.

    Words of lower-case Latin letters go to the model at once, others through the whole tokenizer; words are remembered up to
    ``KEPT_BYTES``.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(vocabulary)
        self.model, self.letters = self.whole.model, byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def unit(self, word: str) -> bytes:
        """Ids of one unit of the tokenizer's pattern, remembered."""
        key = word.encode()
        if (raw := self.known.get(key)) is None:
            raw = self.put(key, [t.id for t in self.model.tokenize(key.decode("latin-1").translate(self.letters))])
        return raw

    def learn(self, words: list[bytes]) -> None:
        hard = []
        for w in words:
            if not (m := WORD.fullmatch(w.decode().lower())):
                hard.append(w)
            elif m[2]:
                self.known[w] = self.unit(m[1]) + self.unit(m[2])
            else:
                self.known[w] = self.unit(m[1])
            self.held += len(w) + 150
        for w, e in zip(hard, self.whole.encode_batch_fast([w.decode() for w in hard], add_special_tokens=False)):
            self.put(w, e.ids)

    def put(self, word: bytes, ids: list[int]) -> bytes:
        self.known[word] = raw = array("I", ids).tobytes()
        self.held += len(raw)
        return raw

    def encode(self, texts: list[bytes]) -> list[bytes]:
        words = [t.split() for t in texts]
        new = {w for ws in words for w in ws} - self.known.keys()
        if self.held > KEPT_BYTES:
            self.known, self.held = {}, 0
            new = {w for ws in words for w in ws}
        self.learn([*new])
        return [b"".join(map(self.known.__getitem__, ws)) for ws in words]


def encoder_of(vocabulary: str) -> Encoder:
    """The encoder of this Python worker: a task that comes after another in it finds words remembered."""
    held = sys.modules.setdefault("tempofact_worker", types.ModuleType("tempofact_worker")).__dict__
    if held.get("vocabulary") != vocabulary:
        held |= {"vocabulary": vocabulary, "encoder": Encoder(vocabulary)}
    return held["encoder"]


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, with the task it comes from and its rank (``nth``) among those of its length there."""
    spark = docs.sparkSession
    tune(spark)
    with open(vocabulary, encoding="utf-8") as f:
        sent = send(spark, f.read())  # the vocabulary alone
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder_of(received(sent)), TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            at, rows = 0, []
            while at < len(texts):
                z, n = at, 0
                while z < len(texts) and (z == at or n + len(texts[z]) <= GROUP_BYTES):
                    n += len(texts[z])
                    z += 1
                for i, raw in enumerate(enc.encode(texts[at:z]), at):
                    raw += last
                    for k, a in enumerate(range(0, len(raw), 4 * size)):
                        piece = raw[a : a + 4 * size]
                        rows.append((i, k, a // 4, len(piece) // 4, crc32(piece), int(seen[len(piece) // 4])))
                        seen[len(piece) // 4] += 1
                at = z
            of, *cols = (pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), cols[0].cast(pa.int32()), cols[1], cols[2], cols[3], pa.array(np.full(len(of), part, dtype=np.int32)), cols[4]], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint")


Pattern = tuple[tuple[int, int], ...]


def reduced(counts: dict[int, int], size: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Sets fixed by dominance, as (pattern, times), and what is left of ``counts`` (pieces by length)."""
    left, fixed = Counter({w: n for w, n in counts.items() if n}), []
    found = True
    while found:
        found = False
        for w in sorted(left, reverse=True):
            while left[w] and (best := dominating(left, w, size)):
                used = Counter(best)
                times = min(left[x] // n for x, n in used.items())
                fixed.append((tuple(sorted(used.items(), reverse=True)), times))
                for x, n in used.items():
                    left[x] -= n * times
                found = True
        left = Counter({w: n for w, n in left.items() if n})
    return fixed, dict(left)


def dominating(left: Counter, w: int, size: int) -> list[int] | None:
    """Lengths of a set with w that dominates all sets with w; None if no rule names one."""
    rest = size - w
    have = lambda x, *taken: left[x] > taken.count(x)
    others = [x for x in sorted(left) if have(x, w)]
    fit = others[: bisect_left(others, rest + 1)]
    if not fit:
        return [w]
    j = fit[-1]
    most, room, taken = 0, rest, [w]
    for x in fit:  # how many of the shortest fit, three at most
        while most < 3 and x <= room and have(x, *taken):
            most, room = most + 1, room - x
            taken.append(x)
        if most == 3 or x > room:
            break
    if most == 1 or j == rest:
        return [w, j]
    if most > 2:
        return None

    def partner(q: int, room: int, *taken: int) -> int:
        """The longest piece within ``room`` beside those taken and q; 0 if there is none."""
        for x in reversed(fit[: bisect_left(fit, room + 1)]):
            if have(x, *taken, q):
                return x
        return 0

    pairs = [(p, q) for q in fit if (p := partner(q, rest - q, w)) and p >= q]
    if all(p + q <= j for p, q in pairs):
        return [w, j]
    last = partner(j, rest - j, w)
    if last and not any(q > last and p + q > j for p, q in pairs):
        return [w, j, last]
    return None


def best_fit(counts: dict[int, int], size: int) -> list[tuple[Pattern, int]]:
    """Best-fit from the longest down, all sequences of a pattern at once."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: dict[int, int], times: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((pattern, times))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            i = bisect_left(rooms, w)
            if i < len(rooms):
                room = rooms[i]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                room, pattern = size, {}
                times = -(-n // (size // w))
            each = room // w
            full = min(times, n // each)
            if full:
                put(room - each * w, pattern | {w: each}, full)
            n -= full * each
            if times > full and n:  # fewer than ``each``
                put(room - n * w, pattern | {w: n}, 1)
                n, full = 0, full + 1
            if times > full:
                put(room, pattern, times - full)
    return [(tuple(sorted(p.items(), reverse=True)), t) for room in rooms for p, t in open_[room]]


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[Pattern, int]]:
    fixed, left = reduced(counts, size)
    return fixed + best_fit(left, size)


class Places:
    """(length, rank) to (sequence, offset) by a plan."""

    def __init__(self, patterns: list[tuple[Pattern, int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        at: Counter = Counter()
        sequence = 0
        for pattern, times in patterns:
            offset = 0
            for w, n in pattern:
                rows.setdefault(w, []).append((at[w], sequence, n, offset))
                at[w] += n * times
                offset += n * w
            sequence += times
        self.sequences = sequence
        self.by_length = {w: np.array(x, dtype=np.int64).T for w, x in rows.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        by = np.argsort(length, kind="stable")
        for rows in np.split(by, np.flatnonzero(np.diff(length[by])) + 1) if len(by) else []:
            start, first, n, offset = self.by_length[w := int(length[rows[0]])]
            i = np.searchsorted(start, rank[rows], side="right") - 1
            q = rank[rows] - start[i]
            seq[rows], off[rows] = first[i] + q // n[i], offset[i] + q % n[i] * w
        return seq, off


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its sequence_id and offset; sequences hold at most ``size`` ids."""
    table = cut(pieces(docs, vocabulary, size, end), "pieces")
    by_task = table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    by_task = cut(by_task.select("part", "length", "n", before.alias("before")), "piece-counts")  # a row a task and length
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``size`` rows at most
    sent = send(docs.sparkSession, Places(plan(counts, size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = received(sent)
        for b in batches:
            seq, off = places.of(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    ranked = table.join(by_task.select("part", "length", "before"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def least_sequences(counts: dict[int, int], size: int = SIZE) -> int:
    """A lower bound: for some length k, pieces over half, and what does not fit beside those over ``size - k`` (Martello and Toth)."""
    best = math.ceil(sum(w * n for w, n in counts.items()) / size)
    for k in {0, *(w for w in counts if w <= size // 2)}:
        huge = sum(n for w, n in counts.items() if w > size - k)
        large = sum(n for w, n in counts.items() if size - k >= w > size / 2)
        room = sum((size - w) * n for w, n in counts.items() if size - k >= w > size / 2)
        small = sum(w * n for w, n in counts.items() if size / 2 >= w >= k)
        best = max(best, huge + large + max(0, math.ceil((small - room) / size)))
    return best


ship(__name__)
