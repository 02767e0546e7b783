"""Joins that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = 16) -> DataFrame:
    """Join ``many`` with ``one``, whose keys are unique, with each key spread over ``salts`` tasks.

    ``spread`` is a column of ``many`` that differs among rows of a key. ``one`` is repeated ``salts``
    times, so it should be the smaller side. Rows whose key is null find no partner.
    """
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, hot: int = 2000, salts: int = 16) -> DataFrame:
    """Inner join of two sides that both repeat keys, with hot keys spread over ``salts`` tasks.

    Keys that ``hot`` rows of the left side or more have are marked after a count; only their rows of the right side are
    repeated. ``spread`` is a column of the left side that differs among rows of a key. Null keys join nothing.
    """
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot).select(*keys, F.lit(True).alias("_hot"))
    salted = lambda c: F.when(F.col("_hot"), c).otherwise(F.lit(0))
    l = left.join(counts, keys, "left").withColumn("_salt", salted(F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    r = right.join(counts, keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return l.join(r, [*keys, "_salt"]).drop("_salt")
