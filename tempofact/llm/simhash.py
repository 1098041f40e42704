"""SimHash near-duplicates, exact at a given Hamming radius, through sharded vantage-point trees.

A vantage point with a bit mask measures a masked Hamming distance, for which the triangle inequality holds. Distances
over all 64 bits of spread fingerprints have mean 32 and deviation 4, so rings around a vantage point of all bits hardly part
them at radius 4. Therefore the forest has one tree for each of ``MASKS`` disjoint masks: of two fingerprints within the
radius, at least one mask sees them within radius // MASKS = 1 (pigeonhole), and that mask's tree finds them.

The upper part of a tree is its shards: the sets at masked distance 0 from a vantage value of the mask's first bits, as
many bits as make shards of about ``SHARD`` fingerprints. The ball of a fingerprint overlaps the boundary of the shards
that differ in one of these bits; it queries those with a smaller value as well. Inside a shard a tree of vantage points over
the mask's bits, and over all bits where the mask parts no more, is built down to leaves of ``LEAF``; queries pass it together,
and a ring is entered only by those that the triangle bound lets in. Each point is linked once to the least point of its
component in the shard, a visitor once to each component that it touches: a crowd of copies gives as many links as members.

Defined results: a null or blank text has the fingerprint zero, linked like any other; rows that repeat doc_id and
fingerprint are one document, returned once; a null doc_id is never a component's id unless it has no other; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempofact.llm.common import salt_mask, salt_of, spread, tune
from tempofact.llm.components import components
from tempofact.session import cut, ship

RADIUS, WORDS, SEED = 4, 4, 42
#: Masks; fingerprints of a shard, on average; points that a tree's leaf compares directly.
MASKS, SHARD, LEAF = 3, 512, 32
BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes | None, k: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the word shingles of a UTF-8 text. bytes.lower and bytes.split know ASCII only, as asked for."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((counts * 2 > len(hashes)).astype(np.uint64) << BITS).sum(dtype=np.uint64))


def fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(fingerprint_batches, "doc_id bigint, fp bigint")


def masks(n: int = MASKS) -> list[tuple[int, int]]:
    """(shift, width) of n disjoint masks over 64 bits."""
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def shard_bits(n: int, shard: int = SHARD) -> int:
    """Bits of a mask that number the shards of n fingerprints."""
    return max(1, min(64 // MASKS, round(math.log2(max(n, 1) / shard)) if n > shard else 1))


def bits_of(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def sharded(fps: DataFrame, bits: int) -> DataFrame:
    """(mask, shard, visits, fp): each fingerprint at home, and where its ball overlaps a smaller shard's boundary."""
    rows = []
    for i, (shift, _) in enumerate(masks()):
        key = bits_of(F.col("fp"), shift, bits)
        near = F.filter(F.array(*[key.bitwiseXOR(F.lit(1 << b)) for b in range(bits)]), lambda s: s < key)
        rows.append(F.struct(F.lit(i).alias("mask"), F.concat(F.array(key), near).alias("shards"), key.alias("home")))
    flat = fps.select("fp", F.explode(F.array(*rows)).alias("m")).select("fp", "m.mask", "m.home", F.explode("m.shards").alias("shard"))
    return flat.select("mask", "shard", (F.col("shard") != F.col("home")).alias("visits"), "fp")


class Tree:
    """A vantage-point tree over a shard's points: rings of equal distance, pruned by the triangle inequality.

    ``compared`` counts the pairs that reached a leaf.
    """

    def __init__(self, points: np.ndarray, mask: int, ids: np.ndarray | None = None, leaf: int = LEAF):
        self.points, self.ids, self.rings = points, np.arange(len(points)) if ids is None else ids, None
        if len(self.ids) <= leaf:
            return
        for self.mask, self.radius in ((np.uint64(mask), RADIUS // MASKS), (np.uint64((1 << 64) - 1), RADIUS)):
            for at in (0, len(self.ids) // 2):  # another vantage point if the first sees all at one distance
                self.vantage = points[self.ids[at]]
                d = np.bitwise_count((points[self.ids] ^ self.vantage) & self.mask).astype(int)
                if d.min() < d.max():
                    self.rings = {int(r): Tree(points, mask, self.ids[d == r], leaf) for r in np.unique(d)}
                    return

    def visit(self, queries: np.ndarray, at: np.ndarray, meet: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> int:
        """Call ``meet`` with (query, point) numbers within the radius, leaf by leaf; return the pairs compared."""
        if self.rings is not None:
            d = np.bitwise_count((queries[at] ^ self.vantage) & self.mask).astype(int)
            return sum(ring.visit(queries, some, meet) for r, ring in self.rings.items() if len(some := at[np.abs(d - r) <= self.radius]))
        own = self.points[self.ids]
        step = max(1, (1 << 20) // max(len(own), 1))
        for i in range(0, len(at), step):
            q, p = np.nonzero(np.bitwise_count(queries[at[i : i + step], None] ^ own[None, :]) <= RADIUS)
            if len(q):
                meet(at[i + q], self.ids[p])
        return len(at) * len(own)


def shard_tree(home: np.ndarray, mask: int) -> tuple[Tree, np.ndarray]:
    """A shard's tree, and for each point the least point that it reaches within the shard, by repeated sweeps."""
    tree, label = Tree(home, mask), np.arange(len(home))

    def lower(q: np.ndarray, p: np.ndarray) -> None:
        np.minimum.at(label, q, label[p])
        np.minimum.at(label, p, label[q])

    everyone, before = np.arange(len(home)), None
    while len(home) > 1 and (before is None or (before != label).any()):
        before = label.copy()
        tree.visit(home, everyone, lower)
        while (label[label] != label).any():
            label = label[label]
        if (label == everyone).all():
            break
    return tree, label


def visitor_links(tree: Tree, label: np.ndarray, visitors: np.ndarray) -> np.ndarray:
    """(visitor, root) for each component of the shard that a visitor touches."""
    found: list[np.ndarray] = []
    tree.visit(visitors, np.arange(len(visitors)), lambda q, p: found.append(np.unique(np.stack((visitors[q], tree.points[label[p]]), axis=1), axis=0)))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.uint64)


def link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mask, shard, visits): the points of a shard, then its visitors, which are not kept."""
    home: list[np.ndarray] = []
    now, built = None, None

    def found(pairs: list[np.ndarray]) -> pa.RecordBatch:
        uv = np.concatenate(pairs) if pairs else np.zeros((0, 2), dtype=np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(uv[:, i]).view(np.int64)) for i in (0, 1)], ["u", "v"])

    def finish() -> list[np.ndarray]:
        """Links within the shard, once its points are complete."""
        nonlocal built
        if built is not None or not home:
            return []
        points = np.concatenate(home)
        shift, width = masks()[now[0]]
        built = shard_tree(points, ((1 << width) - 1) << shift)
        moved = np.flatnonzero(built[1] != np.arange(len(points)))
        return [np.stack((points[moved], points[built[1][moved]]), axis=1)]

    for b in batches:
        mask, shard, visits, fp = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy().view(np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (shard[1:] != shard[:-1]))))
        pairs: list[np.ndarray] = []
        for i, j in zip(starts, [*starts[1:], len(fp)]):
            if (int(mask[i]), int(shard[i])) != now:
                pairs += finish()
                now, home, built = (int(mask[i]), int(shard[i])), [], None
            k = i + int(np.searchsorted(visits[i:j], True))
            if k > i:
                home.append(fp[i:k])
            if k < j:
                pairs += finish()
                if built is not None:
                    pairs.append(visitor_links(*built, fp[k:j]))
        yield found(pairs)
    yield found(finish())


def near_links(fps: DataFrame, bits: int) -> DataFrame:
    """Links (u, v) between distinct fingerprints that connect all pairs within the radius."""
    shards = sharded(fps, bits).repartition("mask", "shard").sortWithinPartitions("mask", "shard", "visits")
    return shards.mapInArrow(link_batches, "u bigint, v bigint")


def near_dedup(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """doc_id, fp (signed) and component_id: the smallest doc_id that links reach."""
    spark = docs.sparkSession
    rows = cut(fingerprints(docs), "fingerprints").distinct().withColumn("salt", salt_of(F.col("doc_id")))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), salt_mask(F.col("salt")).alias("salts")), "classes")
    tune(spark, 100_000)  # rows of a few numbers
    found = cut(near_links(classes.select("fp"), bits or shard_bits(classes.count())), "near")
    tune(spark)
    roots = components(found)
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = cut(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = spread(named.join(least, "root").select("fp", "salts", "component_id"))
    return rows.join(ids, ["fp", "salt"]).select("doc_id", "fp", "component_id")


def kept_documents(docs: DataFrame) -> DataFrame:
    """Of each component the rows of its smallest doc_id, with all their columns.

    Rows that share that doc_id are one document and stay. Rows without an id stay where their component has no id.
    """
    found = near_dedup(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]), "left_semi")


ship(__name__)
