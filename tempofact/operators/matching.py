"""Exact and substring matches of a set of items in documents, and shared words, by equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempofact.functions.text import normalise_answer
from tempofact.operators.groups import with_group

RUN = 5


def item_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, exact, inside) of items (item_id, gold) in docs (doc_id, text): equal normal forms; lower-cased substring.

    The parts of an item between its first and last space stand between spaces in every text that contains it. So a run
    of up to five of them is an exact key, looked up in the texts' runs of that length; candidates are compared whole.
    Items with fewer than two spaces have no such key: those few short ones meet every text, as a stated query set. A
    null item matches nothing; an empty one is inside every text.
    """
    gold = items.select("item_id", F.lower("gold").alias("g"), F.sha2(normalise_answer(F.col("gold")), 256).alias("h"))
    texts = docs.where("text IS NOT NULL")
    forms = texts.select(F.sha2(normalise_answer(F.col("text")), 256).alias("h"))
    exact = gold.join(forms, "h", "left_semi").select("item_id", F.lit(True).alias("exact")).distinct()

    parts = gold.select("item_id", "g", F.split("g", " ").alias("p")).withColumn("k", F.least(F.size("p") - 2, F.lit(RUN)))
    keyed = parts.where("k >= 1").select("item_id", "g", "k", F.array_join(F.slice("p", 2, F.col("k")), " ").alias("run"))
    short = parts.where("k < 1").select("item_id", "g")
    lengths = [r.k for r in keyed.select("k").distinct().collect()]  # at most RUN numbers
    low = texts.select(F.lower("text").alias("t")).select(F.sha2("t", 256).alias("row"), "t").groupBy("row").agg(F.first("t").alias("t")).withColumn("p", F.split("t", " "))
    found = low.join(short, F.contains("t", F.col("g"))).select("item_id")
    for k in sorted(lengths):
        near = low.select("row", F.explode(F.array_distinct(runs_of("p", k))).alias("run")).join(keyed.where(F.col("k") == k).drop("k"), "run")
        met = near.select("row", "item_id", "g").distinct().join(low.select("row", "t"), "row")  # a text goes once to those that may contain it
        found = found.unionByName(met.where(F.contains("t", F.col("g"))).select("item_id"))
    inside = found.distinct().withColumn("inside", F.lit(True))
    done = gold.select("item_id").join(exact, "item_id", "left").join(inside, "item_id", "left")
    return done.select("item_id", F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("inside", F.lit(False)).alias("inside"))


def runs_of(parts: str, k: int) -> Column:
    """All runs of ``k`` neighbouring parts, joined by a space; null where there are fewer."""
    n = F.size(parts) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.lit(k)), " ")))


def shared_words(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, j): word-set Jaccard of each query (id, words) with every other row that shares a word; all others have 0.

    A stated query set against all rows: words meet by an equi-join and pairs are counted, never built first.
    """
    a = queries.select(F.col("id").alias("a"), F.size("words").alias("n"), F.explode("words").alias("w"))
    b = rows.select(F.col("id").alias("b"), F.size("words").alias("m"), F.explode("words").alias("w"))
    same = a.join(b, "w").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("same"), F.first("n").alias("n"), F.first("m").alias("m"))
    return same.select("a", "b", (F.col("same") / (F.col("n") + F.col("m") - F.col("same"))).alias("j"))


def topic_links(facts: DataFrame) -> DataFrame:
    """(id, links): how many open facts of the same category and namespace share any topic with a fact and have another trimmed text.

    ``facts``: id, category, namespace, content, skeleton, topics (few, distinct), active, open. Topics are the second
    way: a fact whose skeleton differs from its text and is an active other fact's skeleton has no row here. A null category or
    namespace is a value like any other.

    No pair is built. Those who share any topic are counted by inclusion and exclusion over the subsets of a fact's
    topics (31 for five): each subset is a group key, and its count returns to its rows by (key, salt). The facts of the
    same text share all topics, so their group's count is taken off.
    """
    text = F.regexp_replace("content", r"^\s+|\s+$", "")
    none = F.array().cast("array<string>")
    known = facts.withColumns({"text": F.sha2(text.cast("binary"), 256), "set": F.array_sort(F.coalesce("topics", none)), "lost": F.col("skeleton") != F.lower(text)})
    chosen = lambda m: F.filter("set", lambda _, i: F.getbit(m, i) == 1)
    entry = lambda kind, what, sign: F.struct(F.lit(kind).alias("kind"), what.alias("what"), sign.cast("int").alias("sign"))
    masks = F.when(F.size("set") == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.size("set")) - 1))
    subsets = F.transform(masks, lambda m: entry("topics", F.to_json(chosen(m)), F.when(F.bit_count(m) % 2 == 1, 1).otherwise(-1)))
    others = F.array(entry("text", F.col("text"), F.lit(-1)), entry("skeleton", F.col("skeleton"), F.lit(0)))
    rows = known.select("id", "category", "namespace", "active", "open", "lost", F.explode(F.concat(subsets, others)).alias("e")).where("e.what IS NOT NULL")
    keyed = rows.select("id", "active", "open", "lost", F.col("e.kind").alias("kind"), F.col("e.sign").alias("sign"), F.sha2(F.to_json(F.struct("category", "namespace", "e.kind", "e.what")), 256).alias("key"))
    counted = with_group(keyed, ["key"], "id", F.count_if("open").alias("n_open"), F.count_if("active").alias("n_active"))
    twins = F.max(F.when((F.col("kind") == "skeleton") & F.col("lost"), F.col("n_active") - F.col("active").cast("int")).otherwise(0))
    per_fact = counted.groupBy("id").agg(F.sum(F.col("sign") * F.col("n_open")).alias("links"), twins.alias("twins"))
    return per_fact.where("twins = 0 AND links > 0").select("id", "links")
