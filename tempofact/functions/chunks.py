"""Chunking and topics: functions that need positions within a text, run in Arrow batches."""

from __future__ import annotations

import bisect
import heapq
import math
import re

import pandas as pd
from pyspark.sql import functions as F

from tempofact.functions.text import DATE_TAG, SUFFIXES, TOPIC_VALUE
from tempofact.session import ship

SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
VALUE = re.compile(TOPIC_VALUE)
TAG = re.compile(DATE_TAG)
WORD = re.compile(r"[a-z][a-z\-']{3,}")
# Words that are no topic.
NO_TOPIC = frozenset(
    "i im me my mine myself you your yours we our ours us the a an this that these those is am are was were be been being have has had do does did "
    "for from to of on in at by with and or but if then than as so user assistant now just really very quite today yesterday tomorrow".split()
)


def tokens(text: str) -> int:
    return int(len(text.split()) * 1.3)


def pieces(text: str, size: int) -> list[str]:
    """Sentences; those too long as lines; those too long as runs of words."""
    out = []
    for s in SENTENCE.split(text):
        for line in [s] if tokens(s) <= size else [x for x in s.split("\n") if x.strip()]:
            words, step = line.split(), max(1, int(size / 1.3))
            out += [line] if tokens(line) <= size else [" ".join(words[i : i + step]) for i in range(0, len(words), step)]
    return [p for p in out if p.strip()]


def chunk(text: str | None, size: int, overlap: int = 0) -> list[str]:
    """Pieces merged while they fit; with ``overlap`` a chunk begins with the last pieces of the one before."""
    out, now = [], []
    for p in pieces(text or "", size):
        if now and tokens(" ".join([*now, p])) > size:
            out.append(" ".join(now))
            tail: list[str] = []
            while now and tokens(" ".join([now[-1], *tail])) <= overlap:
                tail.insert(0, now.pop())
            now = tail if tokens(" ".join([*tail, p])) <= size else []
        now.append(p)
    return [*out, " ".join(now)] if now else out


def topics(text: str | None, most: int = 5) -> list[str]:
    """Stems of the ``most`` words that begin nearest to an end of a sum, a time of day or a number with a unit; distinct.

    In order of distance, then position; a word that occurs twice uses up two places. None without such a value.
    """
    low = TAG.sub("", (text or "").lower())
    edges = [-math.inf, *(e for m in VALUE.finditer(low) for e in m.span()), math.inf]
    if len(edges) == 2:
        return []
    near = lambda at, i: min(at - edges[i - 1], edges[i] - at)
    words = [(near(m.start(), bisect.bisect_left(edges, m.start())), m.start(), plain_stem(m.group())) for m in WORD.finditer(low) if m.group() not in NO_TOPIC]
    return list(dict.fromkeys(w for _, _, w in heapq.nsmallest(most, (x for x in words if x[2] not in NO_TOPIC))))


def plain_stem(w: str) -> str:
    w = w.lower().rstrip("'").strip("-")
    return next((w[: -len(s)] for s in SUFFIXES if w.endswith(s) and len(w) - len(s) >= 4), w)


def chunk_udf(size: int, overlap: int = 0):  # noqa: ANN201
    @F.pandas_udf("array<string>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: chunk(t, size, overlap))

    return run


def topic_udf(most: int = 5):  # noqa: ANN201
    @F.pandas_udf("array<string>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: topics(t, most))

    return run


ship(__name__)
