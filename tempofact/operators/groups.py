"""Aggregates of a group beside its rows, where groups may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def with_group(rows: DataFrame, keys: list[str], spread: str, *aggs: Column) -> DataFrame:
    """Every row with its group's aggregates. ``spread`` is a column whose hash splits hot groups; no key is null.

    The salts that occur with a key are the bits of one long, so that nothing is gathered or multiplied.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_salt"))).alias("_salts")
    occurs = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(F.col("_salts"), i) == 1)
    groups = salted.groupBy(*keys).agg(*aggs, bits).withColumn("_salt", F.explode(occurs)).drop("_salts")
    return salted.join(groups, [*keys, "_salt"]).drop("_salt")


def beside(rows: DataFrame, keys: list[str], spread: str, groups: DataFrame) -> DataFrame:
    """Rows beside the row of ``groups`` (one for each of ``keys``) with their key; hot keys are split as in ``with_group``."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    bits = salted.groupBy(*keys).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_salt"))).alias("_salts"))
    occurs = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(F.col("_salts"), i) == 1)
    return salted.join(groups.join(bits, keys).withColumn("_salt", F.explode(occurs)).drop("_salts"), [*keys, "_salt"]).drop("_salt")
