"""Mixing sources to target weights by pivotal dependent rounding, with native DataFrame operations.

Each source has a rate (target words over its words, at most 2): every document is taken floor(rate) times and once
more with the fractional part as probability. Those fractions are rounded dependently: two documents of one source
and size class (a power of two) exchange word mass at random until one fraction is 0 or 1, which keeps the sum of
taken words. Blocks of bounded size are rounded in parallel; each leaves one undecided document, and these residuals
meet again in a reduction tree of fixed fan-in. At its root the last residual of each size class meets ``HELD`` units of the
class that were kept apart; they are rounded from the largest down, each with the error in words so far in mind, so
that what is left open in the end is at most a small document.

Defined results: size is the number of runs without white space (null: 0); a null source is a source, the last one;
rows that repeat doc_id, source and text (null ids too) are units of their own, decided apart; an empty table gives no
rows; extra columns are ignored. Randomness is a hash of the seed, ids and texts, so reruns agree on any cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tempofact.llm.common import columns
from tempofact.session import cut

#: Units of a block; residuals of a block of the tree; units of a size class that are kept for the root.
LEAF, FAN, HELD = 256, 64, 8
EPS = 1e-9
WEIGHTS = (5.0, 2.0, 1.0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression."""
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Orders by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def units(docs: DataFrame) -> DataFrame:
    """doc_id, src, size, a hash of the text and the number of rows that repeat them."""
    rows = docs.select(F.col("doc_id"), source_key(F.col("source")).alias("src"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("th"))
    return rows.groupBy("doc_id", "src", "size", "th").agg(F.count(F.lit(1)).alias("reps"))


def numbered(df: DataFrame, n: str, name: str, step: int = 10_000) -> DataFrame:
    """Each row ``n`` times, numbered from 1; long runs are unrolled in steps."""
    steps = df.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / step))))
    return steps.withColumn(name, F.explode(F.sequence(F.col("_step") * step + 1, F.least(F.col(n), (F.col("_step") + 1) * step)))).drop("_step")


def ranked_sources(sized: DataFrame, parts: int = 64) -> DataFrame:
    """src, words and rank from 0 by code point, ranked in ranges: no task holds all sources."""
    sums = sized.groupBy("src").agg(F.sum(F.col("size") * F.col("reps")).cast("long").alias("words"))
    ranged = cut(sums.repartitionByRange(parts, "src").withColumn("part", F.spark_partition_id()), "sources")
    before, offsets = 0, {}
    for part, n in sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):  # at most ``parts`` rows
        offsets[part], before = before, before + n
    start = F.lit(0).cast("long")
    for part, at in offsets.items():
        start = F.when(F.col("part") == part, F.lit(at).cast("long")).otherwise(start)
    rank = F.row_number().over(W.partitionBy("part").orderBy("src")) - 1 + start
    return ranged.select("src", "words", rank.alias("rank"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add weight and target: ``share`` of all words by weight, capped at ``most`` times a source, excess reshared."""
    w = F.lit(weights[-1])
    for i, x in enumerate(weights[:-1]):
        w = F.when(F.pmod(F.col("rank"), F.lit(len(weights))) == i, F.lit(x)).otherwise(w)
    s = cut(sources.withColumn("weight", w), "weights")
    cap = F.col("words") * F.lit(most)
    budget = share * float(s.agg(F.sum("words")).first()[0] or 0)
    rate, capped = None, -1
    while True:  # at most one round for each distinct cap level; only sums reach the driver
        above = F.lit(False) if rate is None else cap < F.col("weight") * F.lit(rate)
        got = s.agg(F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, cap)).alias("fixed"), F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        if got["n"] == capped or not got["free"]:
            break
        capped, rate = got["n"], (budget - (got["fixed"] or 0.0)) / got["free"]
    goal = F.least(cap, F.col("weight") * F.lit(rate if rate is not None else 0.0))
    return s.withColumn("target", goal.cast("double"))


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


UNIT = "struct<ord:bigint,doc_id:bigint,size:bigint,th:bigint,reps:bigint,w:double,p:double,base:bigint>"


def pivotal(items: Column, seed: int) -> Column:
    """Fold a sorted array of units: struct(rest, done), the undecided unit (or null) and those decided."""
    whole = lambda p: (p < EPS) | (p > 1 - EPS)
    put = lambda x, p: x.withField("p", F.when(p < EPS, F.lit(0.0)).when(p > 1 - EPS, F.lit(1.0)).otherwise(p))

    def meet(acc: Column, x: Column) -> Column:
        i = acc["rest"]
        up = F.least((1 - i["p"]) * i["w"], x["p"] * x["w"])  # mass that i can gain from x
        down = F.least(i["p"] * i["w"], (1 - x["p"]) * x["w"])

        def moved(m: Column) -> Column:
            a, b = put(i, i["p"] + m / i["w"]), put(x, x["p"] - m / x["w"])
            return let(F.struct(a.alias("a"), b.alias("b")), settle)

        def settle(s: Column) -> Column:
            a, b = s["a"], s["b"]
            none = F.lit(None).cast(UNIT)
            rest = F.when(~whole(a["p"]), a).when(~whole(b["p"]), b).otherwise(none)
            out = F.when(whole(a["p"]) & whole(b["p"]), F.array(a, b)).when(whole(a["p"]), F.array(a)).otherwise(F.array(b))
            return F.struct(rest.alias("rest"), F.concat(acc["done"], out).alias("done"))

        gain = let(F.struct(up.alias("up"), down.alias("down")), lambda d: F.when(uniform(F.lit(seed), i["ord"], x["ord"]) * (d["up"] + d["down"]) < d["down"], d["up"]).otherwise(-d["down"]))
        return F.when(i.isNull(), F.struct(x.cast(UNIT).alias("rest"), acc["done"].alias("done"))).otherwise(let(gain, moved))

    start = F.struct(F.lit(None).cast(UNIT).alias("rest"), F.array().cast(f"array<{UNIT}>").alias("done"))
    return F.aggregate(items, start, meet)


def last(items: Column, seed: int) -> Column:
    """Round the root's units from the largest down, each up with its probability after the error in words so far."""

    def step(acc: Column, x: Column) -> Column:
        return let(acc["over"] + x["p"] * x["w"], lambda want: let(
            F.when(uniform(F.lit(seed), x["ord"]) * x["w"] < want, F.lit(1.0)).otherwise(F.lit(0.0)),
            lambda up: F.struct((want - up * x["w"]).alias("over"), F.concat(acc["done"], F.array(x.withField("p", up))).alias("done")),
        ))

    start = F.struct(F.lit(0.0).alias("over"), F.array().cast(f"array<{UNIT}>").alias("done"))
    return F.aggregate(items, start, step)["done"]


def mix(docs: DataFrame, seed: int = 7, **goal: object) -> DataFrame:
    """doc_id, src, size, source_size, target, copies and taken for every row of ``docs``."""
    sized = cut(units(docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))), "units")
    sources = cut(targets(ranked_sources(sized), **goal).select("src", F.col("words").alias("source_size"), "target"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(rate + F.lit(EPS)).cast("long")
    of = sized.join(sources.select("src", base.alias("base"), F.greatest(rate - base, F.lit(0.0)).alias("p")), "src")
    of = numbered(of, "reps", "nth")
    of = of.withColumn("open", (F.col("p") > EPS) & (F.col("size") > 0))
    order = F.xxhash64(F.lit(seed), "doc_id", "size", "th", "nth")
    item = F.struct(order.alias("ord"), F.col("doc_id"), F.col("size"), F.col("th"), F.col("reps"), F.col("size").cast("double").alias("w"), F.col("p"), F.col("base")).cast(UNIT)
    level = of.where("open").select("src", F.length(F.bin(F.col("size"))).alias("class"), item.alias("x"))
    blocks = cut(level.groupBy("src", "class").agg(F.ceil(F.count(F.lit(1)) / LEAF).alias("blocks")), "blocks")
    widest = blocks.agg(F.max("blocks")).first()[0] or 0
    level = level.join(blocks, ["src", "class"]).select("src", "class", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("x.ord")), F.col("blocks")).alias("block"), "x")
    done, root = [], []
    for k in range(1 + math.ceil(math.log(max(widest, 1), FAN) - 1e-12) if widest else 0):
        held = F.when(F.col("block") == 0, F.lit(0 if k else HELD)).otherwise(F.lit(0))
        folded = level.groupBy("src", "class", "block").agg(F.array_sort(F.collect_list("x")).alias("xs")).select(
            "src", "class", "block", F.slice("xs", F.lit(1), held).alias("held"), pivotal(F.slice("xs", held + 1, F.size("xs")), seed + 2 + k).alias("r"))
        folded = cut(folded, f"pivotal{k}")
        done.append(folded.select("src", F.explode("r.done").alias("x")))
        if not k:
            root.append(folded.select("src", F.explode("held").alias("x")))
        level = folded.where(F.col("r.rest").isNotNull()).select("src", "class", F.floor(F.col("block") / FAN).cast("long").alias("block"), F.col("r.rest").alias("x"))
    if done:
        by_size = lambda a, b: F.when(a["w"] > b["w"], -1).when(a["w"] < b["w"], 1).when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)
        top = level.select("src", "x").unionByName(root[0]).groupBy("src").agg(F.collect_list("x").alias("xs"))  # at most HELD + 1 for each of 64 size classes
        done.append(top.select("src", F.explode(last(F.array_sort("xs", by_size), seed)).alias("x")))
    settled = of.where("NOT open").select("src", "doc_id", "size", "th", "reps", F.col("base").alias("copies"))
    for part in done:
        settled = settled.unionByName(part.select("src", "x.doc_id", "x.size", "x.th", "x.reps", (F.col("x.base") + F.col("x.p")).cast("long").alias("copies")))
    return settled.join(sources, "src").select("doc_id", "src", "size", "th", "reps", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 7, **goal: object) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with size, source_size, target, copies and taken.

    Of rows that repeat id, source and text as many stay as were taken; they are reduced before their shuffle.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    key = ["_none", "_id", "_src", "_th"]
    keyed = lambda df, src, th: df.select(F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("_id"), src.alias("_src"), th.alias("_th"), "_row")
    took = mix(docs, seed, **goal).where("copies > 0")
    times = keyed(took.withColumn("_row", F.struct("reps", *new)), F.col("src"), F.col("th")).groupBy(*key, "_row").agg(F.count(F.lit(1)).alias("_n"))
    times = cut(times.withColumnRenamed("_row", "_took"), "took")
    rows = keyed(docs.select("doc_id", "text", "source", F.struct(*columns(docs, *new)).alias("_row")), source_key(F.col("source")), F.xxhash64("text"))
    out = rows.join(times.where("_took.reps = 1"), key)
    repeated = times.where("_took.reps > 1")
    if not repeated.isEmpty():
        once = rows.join(repeated, key, "left_semi").groupBy(*key).agg(F.first("_row").alias("_row"))
        out = out.unionByName(numbered(once.join(repeated, key), "_n", "_nth").drop("_nth"))
    return out.select("_row.*", *[f"_took.{c}" for c in new])
