"""The ranking algebra: similarity, boosts, diversity and budget packing over candidate rows."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tempofact.session import cut, ship

VECTOR_WEIGHT, GRAPH_WEIGHT, UNREACHABLE = 0.7, 0.3, -0.05
HOP_BONUS = {0: 0.30, 1: 0.20, 2: 0.10}


def keep_best(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """Of each key the row with the largest score; the first by ``tie`` in a draw."""
    best = F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), tie))
    return df.withColumn("_rn", best).where("_rn = 1").drop("_rn")


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance)


def blend(sim: Column, hop: Column) -> Column:
    """Similarity and graph proximity; a null hop is unreachable."""
    bonus = F.lit(0.0)
    for h, x in HOP_BONUS.items():
        bonus = F.when(hop == h, F.lit(x)).otherwise(bonus)
    base = VECTOR_WEIGHT * F.least(F.lit(1.0), F.greatest(F.lit(0.0), sim)) + GRAPH_WEIGHT * bonus
    return F.when(hop.isNull(), base + UNREACHABLE).otherwise(base)


def temporal_boost(created: Column, now: Column, days: int = 90, weight: float = 0.2) -> Column:
    age = F.floor(F.timestamp_diff("SECOND", created, now) / 86400)
    return F.greatest(F.lit(0.0), 1 - age / days) * weight


def entity_boost(entity: Column, content: Column, wanted: list[str]) -> Column:
    low = [w.lower() for w in wanted]
    mentioned = F.lit(False)
    for w in low:
        if len(w) >= 3:
            mentioned = mentioned | F.contains(F.lower(content), F.lit(w))
    return F.when(F.lower(entity).isin(low), 0.3).when(mentioned, 0.15).otherwise(0.0)


def decayed_confidence(confidence: Column, accesses: Column, last: Column, now: Column) -> Column:
    hours = F.greatest(F.lit(0.0), F.timestamp_diff("SECOND", last, now) / 3600.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), confidence - 0.001 * hours + 0.03 * accesses))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def greedy_pack(items: Column, budget: Column | int) -> Column:
    """Fold of structs sorted by rank with ``cost``: those taken; what overflows is skipped, the first is always taken."""
    kind = items
    start = F.struct(F.lit(0).cast("long").alias("used"), F.filter(kind, lambda x: F.lit(False)).alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + x["cost"] <= budget) | (F.size(acc["taken"]) == 0)
        return F.when(fits, F.struct((acc["used"] + x["cost"]).alias("used"), F.concat(acc["taken"], F.array(x)).alias("taken"))).otherwise(acc)

    return F.aggregate(items, start, step)["taken"]


def pack(rows: DataFrame, keys: list[str], order: list[Column], cost: Column, budget: Column, block: int = 500) -> DataFrame:
    """Rows that a greedy walk of each group in ``order`` (unique, not null) takes within ``budget``; no rank is cut off.

    Each round folds the next ``block`` rows of every group, carries what is left of the budget on and keeps only rows
    behind them that still fit, until there is none. As in greedy_pack a group's first row is always taken; rows that cost
    nothing are taken at once, where the first is within the budget. Null keys are a group; a null cost is 0.
    """
    rest = cut(rows.withColumns({"_o": F.struct(*order), "_cost": F.coalesce(cost.cast("long"), F.lit(0)), "_left": budget.cast("long")}), "pack-rows")
    same = reduce(lambda p, i: p & F.col(keys[i]).eqNullSafe(F.col(f"_k{i}")), range(len(keys)), F.lit(True))
    heads = rest.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(F.struct("_o", "_cost", "_left")).alias("_h"))
    led = rest.join(heads, same)
    first, within = F.col("_o") == F.col("_h._o"), F.col("_h._cost") <= F.col("_h._left")
    out = led.where(first | ((F.col("_cost") == 0) & within)).select(*rows.columns)
    now = F.col("_left") - F.col("_h._cost")
    rest = cut(led.where(~first & (F.col("_cost") > 0) & (F.col("_cost") <= now)).select(*rows.columns, "_o", "_cost", now.alias("_left")), "pack-rows")
    while not rest.isEmpty():
        nth = F.row_number().over(W.partitionBy(*keys).orderBy("_o"))
        items = F.array_sort(F.collect_list(F.struct("_o", F.col("_cost").alias("cost"))))
        best = rest.select(*keys, "_o", "_cost", "_left").withColumn("_n", nth).where(F.col("_n") <= block).groupBy(*keys).agg(items.alias("items"), F.max("_o").alias("last"), F.first("_left").alias("left"))
        got = cut(best.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], greedy_pack(F.col("items"), F.col("left")).alias("taken"), "last", "left"), "pack-block")
        mine = reduce(lambda p, i: p & F.col(keys[i]).eqNullSafe(F.col(f"_k{i}")), range(len(keys)), F.lit(True))
        found = got.select(*[f"_k{i}" for i in range(len(keys))], F.explode("taken").alias("_t"))
        out = out.unionByName(rest.join(found, mine & (F.col("_o") == F.col("_t._o"))).select(*rows.columns))
        spent = F.aggregate("taken", F.lit(0).cast("long"), lambda s, x: s + x["cost"])
        state = got.select(*[f"_k{i}" for i in range(len(keys))], "last", (F.col("left") - spent).alias("_now"))
        after = rest.join(state, mine & (F.col("_o") > F.col("last")) & (F.col("_cost") <= F.col("_now")))
        rest = cut(after.select(*rows.columns, "_o", "_cost", F.col("_now").alias("_left")), "pack-rows")
    return out


def mmr(candidates: DataFrame, lam: float = 0.7, most: int = 10) -> DataFrame:
    """Maximal marginal relevance for each query_id over (id, score, words); candidates of a query are a top-k list."""

    def pick(batch: pd.DataFrame) -> pd.DataFrame:
        rows = batch.sort_values(["score", "id"], ascending=[False, True])
        sets = [set(w) for w in rows["words"]]
        ids, scores = rows["id"].tolist(), rows["score"].tolist()
        near, left, out = [0.0] * len(ids), list(range(len(ids))), []
        while left and len(out) < most:
            best = max(left, key=lambda i: (lam * scores[i] - (1 - lam) * near[i], -left.index(i)))
            left.remove(best)
            out.append((rows["query_id"].iloc[0], ids[best], scores[best], len(out) + 1))
            for i in left:
                u = len(sets[i] | sets[best])
                near[i] = max(near[i], len(sets[i] & sets[best]) / u if sets[i] and sets[best] else 0.0)
        return pd.DataFrame(out, columns=["query_id", "id", "score", "rank"])

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id bigint, id bigint, score double, rank int")


def keyword_boost(content: Column, nouns: list[str], weight: float = 0.3) -> Column:
    """Share of the proper nouns found in the text."""
    if not nouns:
        return F.lit(0.0)
    found = F.lit(0)
    for n in nouns:
        found = found + F.when(F.contains(F.lower(content), F.lit(n.lower())), 1).otherwise(0)
    return weight * found / len(nouns)


ship(__name__)
