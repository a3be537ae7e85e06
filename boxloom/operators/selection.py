"""Exact order statistics of groups of any size, without sorting a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.session import durable

#: Ranges that a round cuts the range of a wanted value into.
_RANGES = 1024


def _same(names: Sequence[str], mark: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{mark}{n}")) for n in names], F.lit(True))


def medians(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by`` (one column at least) and the exact ``median`` of a numeric column, nulls and
    not-a-numbers left out.

    The two middle ranks of each group are looked for in ranges of values. A round counts
    the values in each range, combined before they are shuffled, and goes on with the least
    and greatest value of the range that holds the rank, so a group costs a shuffle of at
    most 1 025 counts a task, whatever its size. The least and the greatest value never share
    a range, so every round narrows; it ends when they are equal.
    """
    number = F.col(value).cast("double")
    values = durable(rows.filter(number.isNotNull() & ~F.isnan(number)).select(*by, number.alias("_v")))
    n = F.col("_n")
    middle = F.array(F.floor((n + 1) / 2), F.floor((n + 2) / 2))
    groups = values.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    wanted = durable(groups.select(*by, "_low", "_high", F.posexplode(middle).alias("_side", "_rank")))
    found = []
    while True:
        found.append(wanted.filter("_low = _high").select(*by, "_side", "_low"))
        wanted = wanted.filter("_low < _high")
        if wanted.isEmpty():
            break
        asked = wanted.select(*[F.col(c).alias(f"_w{c}") for c in by], "_side", "_rank", "_low", "_high")
        near = values.join(asked, _same(by, "_w") & F.col("_v").between(F.col("_low"), F.col("_high")))
        share = (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low"))
        place = F.when(F.col("_v") == F.col("_high"), _RANGES).otherwise(F.least(F.floor(share * _RANGES), F.lit(_RANGES - 1)))
        counts = near.groupBy(*by, "_side", "_rank", place.alias("_range")).agg(
            F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
        )
        # a row per range and rank
        upto = F.sum("_n").over(Window.partitionBy(*by, "_side").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
        wanted = durable(
            counts.withColumn("_upto", upto)
            .filter((F.col("_upto") - n < F.col("_rank")) & (F.col("_rank") <= F.col("_upto")))
            .select(*by, "_low", "_high", "_side", (F.col("_rank") - F.col("_upto") + n).alias("_rank"))
        )
    return reduce(DataFrame.unionByName, found).groupBy(*by).agg(
        ((F.max(F.when(F.col("_side") == 0, F.col("_low"))) + F.max(F.when(F.col("_side") == 1, F.col("_low")))) / 2).alias("median")
    )
