"""Evaluation aggregates: confusion, accuracy, percentiles by rank, votes, agreement and gates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def zero_filled(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of the given values, with 0 for those that don't occur. One pass, one row to unfold."""
    wide = df.agg(*[F.count_if(F.col(column) == v).alias(f"_{i}") for i, v in enumerate(values)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(v).alias(column), F.col(f"_{i}").alias("n")) for i, v in enumerate(values)])))


def confusion(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    return df.agg(F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(~truth & ~guess).alias("tn"), F.count_if(truth & ~guess).alias("fn"))


def precision_recall(c: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    x = c.select(p.alias("p"), r.alias("r"), ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("o"))
    f1 = ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return x.select(F.bround("p", 4).alias("precision"), F.bround("r", 4).alias("recall"), F.bround(f1, 4).alias("f1"), F.bround("o", 4).alias("over_abstention"))


def bucket(x: Column, ranges: list[tuple[str, int, int]]) -> Column:
    """The name of the half-open range that holds x, else overflow."""
    return reduce(lambda acc, r: F.when((x >= r[1]) & (x < r[2]), r[0]).otherwise(acc), reversed(ranges), F.lit("overflow"))


def accuracy(df: DataFrame, by: list[str], correct: Column) -> DataFrame:
    ok, n = F.count_if(correct), F.count(F.lit(1))
    return df.groupBy(*by).agg(ok.alias("correct"), n.alias("total"), F.bround(100 * ok / n, 2).alias("pct"))


def ranked_values(df: DataFrame, by: list[str], value: str, at: dict[str, Callable[[Column], Column]], bins: int = 1024, few: int = 1000) -> DataFrame:
    """Values at 0-based ranks that depend on the group's size, found by selection: no group is sorted or gathered.

    Each round counts the values between a rank's bounds in ``bins`` equal parts and goes on with the part that holds the rank,
    until that has ``few`` rows or one value; those few are ranked. Null values and keys: values are left out, null keys are a key.
    """
    from tempofact.session import cut

    key = [f"_k{i}" for i in range(len(by))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, key)], F.col(value).cast("double").alias("_v"))
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), f(F.col("_n")).cast("long").alias("rank")) for k, f in at.items()])).alias("x")
    goals = cut(sizes.select(*key, "_n", "_lo", "_hi", names).select(*key, "x.name", "x.rank", "_n", "_lo", "_hi").where("rank >= 0 AND rank < _n"), "ranks")
    mine = [f"_g{i}" for i in range(len(by))]

    def met(some: DataFrame) -> DataFrame:
        """Rows beside the goals of their group whose bounds hold them."""
        on = reduce(lambda p, i: p & F.col(key[i]).eqNullSafe(F.col(mine[i])), range(len(by)), (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        return rows.join(some.select(*[F.col(k).alias(m) for k, m in zip(key, mine)], "name", "rank", "_lo", "_hi"), on).drop(*mine)

    while goals.where((F.col("_n") > few) & (F.col("_lo") < F.col("_hi"))).limit(1).count():
        part = F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)).cast("int")
        wide = goals.where((F.col("_n") > few) & (F.col("_lo") < F.col("_hi")))
        counts = met(wide).groupBy(*key, "name", "rank", part.alias("part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.sum("_n").over(W.partitionBy(*key, "name").orderBy("part")) - F.col("_n")  # of ``bins`` rows at most
        held = counts.withColumn("before", before).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("_n")))
        rest = goals.where((F.col("_n") <= few) | (F.col("_lo") == F.col("_hi")))
        goals = cut(rest.unionByName(held.select(*key, "name", (F.col("rank") - F.col("before")).alias("rank"), "_n", "_lo", "_hi")), "ranks")
    one = goals.where("_lo = _hi").select(*key, "name", F.col("_lo").alias("_v"))
    nth = F.row_number().over(W.partitionBy(*key, "name").orderBy("_v")) - 1
    some = met(goals.where("_lo < _hi")).withColumn("_r", nth).where(F.col("_r") == F.col("rank")).select(*key, "name", "_v")
    found = one.unionByName(some).groupBy(*key).agg(*[F.round(F.max(F.when(F.col("name") == k, F.col("_v"))), 6).alias(k) for k in at])
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, key)], *at)


def majority(df: DataFrame, group: str, fingerprint: Column, pos: str) -> DataFrame:
    """The most frequent fingerprint of a group; the first seen wins a tie."""
    c = df.groupBy(group, fingerprint.alias("fp")).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("pos"))
    return c.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), "pos"))).where("_rn = 1").drop("_rn")


def agreement(df: DataFrame, sample: str, judge: str, correct: str) -> DataFrame:
    """For each pair of judges: both right, both wrong, and the share of samples on which they agree."""
    a = df.select(sample, F.col(judge).alias("a"), F.col(correct).alias("x"))
    b = df.select(sample, F.col(judge).alias("b"), F.col(correct).alias("y"))
    n = F.count(F.lit(1))
    return a.join(b, sample).where("a < b").groupBy("a", "b").agg(
        F.count_if(F.col("x") & F.col("y")).alias("both_correct"), F.count_if(~F.col("x") & ~F.col("y")).alias("both_wrong"), F.bround(100 * F.count_if(F.col("x") == F.col("y")) / n, 2).alias("pct"))


def against_baseline(now: DataFrame, base: DataFrame, threshold: float, key: str = "metric") -> DataFrame:
    """delta and regressed (delta < -threshold); without a baseline nothing has regressed."""
    j = now.join(base.withColumnRenamed("score", "before"), key, "left")
    return j.select(key, (F.col("score") - F.col("before")).alias("delta"), F.coalesce(F.col("score") - F.col("before") < -threshold, F.lit(False)).alias("regressed"))


def pack_contains(df: DataFrame, by: list[str], need: list[str], never: list[str], text: str = "text") -> DataFrame:
    """Whether any text of a group contains any needle, and none a forbidden one; regardless of case."""
    has = lambda words: reduce(lambda a, w: a | F.contains(F.lower(text), F.lit(w.lower())), words, F.lit(False))
    return df.groupBy(*by).agg(F.bool_or(has(need)).alias("found"), (~F.bool_or(has(never))).alias("absent"))


def judge_pick(samples: DataFrame, judge: Callable[[str, list[str]], int], question: str = "question", pos: str = "pos", answer: str = "answer") -> DataFrame:
    """(question, chosen, voter): the sample that ``judge`` (question, answers in order) names by its place, of each question's few.

    A judge that fails or names no sample leaves it to the majority: the most frequent answer regardless of case, the first in a
    tie. Null and empty answers are no samples; without samples a question has no row. The judge runs as a table function over
    the partitions by question, in order.
    """
    spark = samples.sparkSession

    class Pick:
        def __init__(self):  # noqa: ANN204
            self.question, self.answers = None, []

        def eval(self, row):  # noqa: ANN001, ANN202
            self.question = row["question"]
            self.answers.append(row["answer"])

        def terminate(self):  # noqa: ANN202
            if not self.answers:
                return
            try:
                at = judge(self.question, list(self.answers))
                if not 0 <= at < len(self.answers):
                    raise IndexError(at)
                yield self.question, self.answers[at], "judge_pick"
            except Exception:  # noqa: BLE001  a judge may fail in any way
                forms = [a.strip().lower() for a in self.answers]
                yield self.question, self.answers[forms.index(max(forms, key=lambda f: (forms.count(f), -forms.index(f))))], "majority"

    name = "tempofact_judge_pick"
    spark.udtf.register(name, F.udtf(Pick, returnType="question string, chosen string, voter string"))
    rows = samples.select(F.col(question).cast("string").alias("question"), F.col(pos).alias("pos"), F.col(answer).alias("answer")).where("trim(answer) <> ''")
    return spark.sql(f"SELECT * FROM {name}(TABLE({{rows}}) PARTITION BY question ORDER BY (pos, answer))", rows=rows)
