"""Prefix trie of conversations by preorder intervals.

A turn is 128 bits of a SHA-256 over role and text; texts are read once and not shuffled. Conversations are ranked
lexicographically: blocks of ``BLOCK`` turns are ranked among all distinct blocks, then blocks of their ranks, until a
conversation is one rank, so no task gathers a conversation. Of equal conversations one goes on, with their number.

A node is a distinct prefix, named by running sums (2 x 61 bits) of hashes of (position, turn). Those who share it are
neighbours in rank: its first and last member bound its subtree, and nodes sorted by (first member, depth) are the trie in
preorder. Leaves and savings of a subtree are differences of running sums at its two ends.

Defined results: rows without a conv_id are left out; turns are ordered by turn (null first), ties by their digest; null
roles and texts are empty; rows that repeat a turn are turns of their own; other columns are ignored; a conversation
without turns ends at the root; an empty table has no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempofact.llm.common import fold_of, salt_mask, salt_of, spread, tune
from tempofact.llm.mixing import word_count
from tempofact.llm.ordered import MASK, running
from tempofact.session import cut, ship

#: Turns, or ranks of a level below, of a ranked block; ids of a piece of a list.
BLOCK, PIECE = 64, 1000
#: Conversations of one run share the first; turns that one takes over are fewer than ``HEADS``.
SPAN, HEADS = 20, 4


def one() -> Column:
    return F.lit(1).cast("long")


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, idx (from 0), key and words of every turn."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    read = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.substring(F.sha2(said.cast("binary"), 256), 1, 32).alias("key"), word_count(text).alias("words"), one().alias("one"))
    got = running(cut(read.where("conv_id IS NOT NULL"), "turns"), ["conv_id", "turn", "key"], {"one": "idx"}, "conv_id", "numbered")
    return got.select("conv_id", (F.col("idx") - 1).alias("idx"), "key", "words")


def rebuilt(said: DataFrame, span: int = SPAN, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, d from 1, key, words) and conv_ids where the first crc32(conv_id) mod ``heads`` turns are those of the
    first conversation of a run of ``span`` ids (of ids below zero: of the run's last, since the remainder is negative)."""
    base = F.col("conv_id") - F.col("conv_id") % span
    h = fold_of(F.col("conv_id"), heads)
    first = said.where((F.col("conv_id") % span == 0) & (F.col("idx") < heads - 1))
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("idx", "key", "words"))).alias("head"))  # heads - 1 at most
    convs = said.select("conv_id").distinct().withColumn("base", base).join(first, "base", "left")
    convs = cut(convs.select("conv_id", F.slice(F.coalesce("head", F.array().cast("array<struct<idx:bigint,key:string,words:long>>")), F.lit(1), h.cast("int")).alias("head")), "conversations")
    taken = convs.select("conv_id", F.explode("head").alias("x")).select("conv_id", (F.col("x.idx") + 1).alias("d"), "x.key", "x.words")
    own = said.where(F.col("idx") >= h).join(convs.select("conv_id", F.size("head").cast("long").alias("off")), "conv_id")
    own = own.select("conv_id", (F.col("off") + F.col("idx") - h + 1).alias("d"), "key", F.col("words").cast("long").alias("words"))
    return cut(taken.unionByName(own), "rebuilt"), convs.select("conv_id")


def gathered(rows: DataFrame, at: str, key: Column) -> DataFrame:
    """Blocks of ``BLOCK`` keys of fixed width, in order, as one key."""
    blocks = rows.groupBy("conv_id", F.floor(F.col(at) / BLOCK).cast("long").alias("b")).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), key.alias("key")))).alias("xs"))
    return blocks.select("conv_id", "b", F.array_join(F.transform("xs", lambda x: x["key"]), "").alias("key"))


def ranked(said: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, r and len: the lexicographic rank among distinct conversations, 0 for one without turns."""
    level = gathered(said.withColumn("at", F.col("d") - 1), "at", F.col("key"))
    while True:  # log of the longest conversation to base BLOCK
        level = cut(level, "blocks")
        keys = running(level.select("key").distinct().withColumn("one", one()), ["key"], {"one": "rank"}, name="block-ranks")
        level = cut(level.join(keys.select("key", "rank"), "key").select("conv_id", "b", "rank"), "ranked-blocks")
        if not level.agg(F.max("b")).first()[0]:
            break
        level = gathered(level, "b", F.lpad(F.hex("rank"), 16, "0"))
    lengths = said.groupBy("conv_id").agg(F.max("d").alias("len"))
    none = F.lit(0).cast("long")
    got = convs.join(level.select("conv_id", "rank"), "conv_id", "left").join(lengths, "conv_id", "left")
    return cut(got.select("conv_id", F.coalesce("rank", none).alias("r"), F.coalesce("len", none).alias("len")), "ranks")


def prefixes(said: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row a node: its name (d, k1, k2), its parent's (d - 1, p1, p2), first and last member rank, and counts."""
    firsts = ranks.groupBy("r").agg(F.min("conv_id").alias("conv_id"), F.count(one()).alias("n"), F.max("len").alias("len"))
    rows = said.join(firsts, "conv_id").select("r", "conv_id", "n", "len", "d", "words", *[F.xxhash64(F.lit(i), "d", "key").bitwiseAND(F.lit(MASK)).alias(f"u{i}") for i in (1, 2)])
    rows = running(rows, ["r", "d"], {"u1": "k1", "u2": "k2"}, "r", "prefixes")
    before = [F.when(F.col("d") > 1, (F.col(f"k{i}") - F.col(f"u{i}")).bitwiseAND(F.lit(MASK))).otherwise(0).alias(f"p{i}") for i in (1, 2)]
    nodes = rows.select("*", *before).groupBy("d", "k1", "k2").agg(
        F.min("r").alias("r1"), F.max("r").alias("r2"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max(F.col("len") == F.col("d")).alias("ends"),
    )
    zero = F.lit(0).cast("long")
    root = firsts.agg(F.min("r").alias("r1"), F.max("r").alias("r2"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), (F.min("len") == 0).alias("ends")).where("conv_id IS NOT NULL")
    return nodes.unionByName(root.select(zero.alias("d"), zero.alias("k1"), zero.alias("k2"), "r1", "r2", "n_convs", "conv_id", zero.alias("words"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), "ends"))


def end_lists(ranks: DataFrame) -> DataFrame:
    """r and the SHA-256 of the conv_ids of that rank, ascending, comma-joined: pieces from sorted ranges, digested as a stream."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            r, ids = b.column(0).to_numpy(), b.column(1).to_pylist()
            cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(ids)]
            spans = [(i, min(i + PIECE, z)) for a, z in zip(cuts, cuts[1:]) for i in range(a, z, PIECE)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(r[a]) for a, _ in spans], pa.int64()), pa.array([part] * len(spans), pa.int32()), pa.array(range(n, n + len(spans)), pa.int64()), pa.array([",".join(map(str, ids[a:z])) for a, z in spans], pa.string())],
                ["r", "part", "n", "ids"])
            n += len(spans)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.string())], ["r", "sha"])
        for b in batches:
            done = []
            for r, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if r != now:
                    if h:
                        done.append((now, h.hexdigest()))
                    now, h = r, sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield batch(done)
        if h:
            yield batch([(now, h.hexdigest())])

    lists = ranks.select("r", "conv_id").repartitionByRange("r", "conv_id").sortWithinPartitions("r", "conv_id").mapInArrow(pieces, "r bigint, part int, n bigint, ids string")
    return lists.repartition("r").sortWithinPartitions("r", "part", "n").select("r", "ids").mapInArrow(digests, "r bigint, sha string")


def trie(said: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the trie of conversations ``convs`` with turns ``said`` (conv_id, d from 1, key, words).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256; preorder (root 0) and subtree_end,
    the preorder of the subtree's last node.
    """
    tune(said.sparkSession)
    ranks = ranked(said, convs)
    flat = prefixes(said, ranks).withColumns({"one": one(), "leaf": (F.col("ends") & (F.col("r1") == F.col("r2"))).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    nodes = running(flat, ["r1", "d"], {"one": "pos", "leaf": "leaves", "saved": "savings"}, name="preorder")
    last = nodes.where("ends").select(F.col("r1").alias("r2"), F.col("pos").alias("z"), F.col("leaves").alias("all_leaves"), F.col("savings").alias("all_savings"))
    nodes = nodes.join(last, "r2").withColumns({"n_leaves": F.col("all_leaves") - F.col("leaves") + F.col("leaf"), "saved_tokens": F.col("all_savings") - F.col("savings") + F.col("saved")})
    child = nodes.where("d > 0").select((F.col("d") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), salt_of(F.col("pos")).alias("salt"))
    kids = child.groupBy("d", "k1", "k2").agg(F.count(one()).alias("kids"), salt_mask(F.col("salt")).alias("salts"))
    nodes = cut(nodes.join(kids, ["d", "k1", "k2"], "left"), "nodes")
    above = spread(nodes.where("kids > 0").select((F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "salts"))
    tops = nodes.where("d = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    nodes = nodes.where("d > 0").withColumn("salt", salt_of(F.col("pos"))).join(above, ["d", "p1", "p2", "salt"]).drop("salt").unionByName(tops)
    ended = nodes.where("ends").join(end_lists(ranks), nodes["r1"] == F.col("r")).drop("r")
    whole = ended.unionByName(nodes.where("NOT ends").withColumn("sha", F.lit(sha256(b"").hexdigest())))
    return whole.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("kids", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
        F.col("sha").alias("ends_sha256"), (F.col("pos") - 1).alias("preorder"), (F.col("z") - 1).alias("subtree_end"),
    )


ship(__name__)
