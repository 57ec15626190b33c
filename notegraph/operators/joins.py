"""Joins that bear a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = 16


def salted(many: DataFrame, few: DataFrame, on: list[str], by: str, how: str = "inner", salt: int = SALT) -> DataFrame:
    """many joined with few, of which many may hold a third of its rows under one key.

    Rows of `many` are spread by the hash of the column `by` over `salt` places of their key, rows
    of `few` are repeated in all of them, so no key has more than its part of `many` in one task.
    The repeated side is never broadcast: Spark would judge it by its size before the repetition
    and build a table `salt` times as large in the driver.
    """
    left = many.withColumn("salt_", F.pmod(F.xxhash64(F.lit("salt"), by), F.lit(salt)).cast("int"))
    right = few.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))).hint("merge")
    return left.join(right, [*on, "salt_"], how).drop("salt_")


def split_hot(many: DataFrame, few: DataFrame, on: str, percent: int = 1, least: int = 10_000) -> DataFrame:
    """many joined with few, whose keys are unique, where some keys may hold much of many.

    Keys of at least `percent` of all rows of `many` (and `least` rows), of which there are at most
    100 / percent, are joined by broadcasting their rows of `few`, which is therefore bounded; all
    others meet in a shuffle in which no key is hot.  `many` is read twice and should be a written table.
    """
    total = many.agg(F.count("*").alias("total_"))
    hot = many.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("m_")).crossJoin(F.broadcast(total))  # one row
    hot = hot.where((F.col("m_") >= least) & (F.col("m_") * 100 >= F.col("total_") * percent)).select(on)
    there = many.join(F.broadcast(few.join(F.broadcast(hot), on, "left_semi")), on)
    rest = many.join(F.broadcast(hot), on, "left_anti").join(few, on)
    return there.unionByName(rest)
