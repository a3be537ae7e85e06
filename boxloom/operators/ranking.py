"""Row numbers that no single task has to produce alone.

A window numbers a group inside one task. That is the right plan while every
group is small; a group holding a third of the table is cut into range buckets
instead: number inside ``(group, bucket)``, then add the sizes of the group's
earlier buckets. The bucket is a pure function of the row (literal bounds), so a
recomputed task always lands on the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from boxloom.session import durable, hot_group_rows, shuffle_partitions

_SAMPLE_PER_BUCKET = 32


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Groups with more rows than ``limit``. Partial counts, so hot keys are cheap."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).drop("_n")


def has_hot_group(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    limit = hot_group_rows(df.sparkSession) if limit is None else limit
    return not hot_groups(df, keys, limit).isEmpty()


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of both sides' key columns."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _range_bounds(df: DataFrame, buckets: int) -> list[Row]:
    """Bucket bounds from a fixed-size sample (the rows of least hash).

    They are cut to the leading columns that tell most of them apart.
    """
    names = df.columns
    sample = df.orderBy(F.xxhash64(*names)).limit(buckets * _SAMPLE_PER_BUCKET)
    place = Window.orderBy(*names)
    ranked = sample.withColumn("_at", F.row_number().over(place))
    rows = ranked.filter(F.col("_at") % _SAMPLE_PER_BUCKET == 0).orderBy(*names).drop("_at").collect()
    for width in range(1, len(names) + 1):
        bounds = list(dict.fromkeys(Row(*names[:width])(*row[:width]) for row in rows))
        if 4 * len(bounds) >= 3 * len(rows):
            break
    return bounds


def _in_buckets(df: DataFrame, bounds: list[Row]) -> DataFrame:
    """Add ``_bucket``, how many bounds are at or below a row: a binary search over literals.

    A step is a column of its own, which compiles; a fold over the steps would not.
    """
    df = df.withColumn("_bucket", F.lit(0))
    if not bounds:
        return df
    names = bounds[0].__fields__
    types = {n: df.schema[n].dataType for n in names}
    listed = F.array(*[F.struct(*[F.lit(row[n]).cast(types[n]).alias(n) for n in names]) for row in bounds])
    place = F.struct(*[F.col(n) for n in names])
    for step in [2**p for p in reversed(range(len(bounds).bit_length()))]:
        probe = F.col("_bucket") + step
        further = (probe <= len(bounds)) & (F.get(listed, probe - 1) <= place)
        df = df.withColumn("_bucket", F.col("_bucket") + F.when(further, step).otherwise(0))
    return df


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    hot: bool | None = None,
    stored: bool = False,
) -> DataFrame:
    """Add a 1-based BIGINT ``name`` per ``keys`` group in ascending ``order``.

    ``order`` has to be total within a group. Whether any group is hot is looked
    up with a partial count unless the caller already knows. Bucketed numbering
    reads its input three times, so the input is settled first unless it is
    ``stored`` and cheap to read again.
    """
    if keys and hot is None:
        hot = has_hot_group(df.select(*keys), keys)
    if keys and not hot:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("bigint"))

    sorted_by = [f"_o{i}" for i in range(len(order))]
    placed = df.withColumns(dict(zip(sorted_by, order)))
    if not stored:
        placed = durable(placed)
    # a vocabulary or another small table is one small group
    if not keys and placed.limit(hot_group_rows(df.sparkSession) + 1).count() <= hot_group_rows(df.sparkSession):
        window = Window.partitionBy(F.lit(0)).orderBy(*sorted_by)
        return placed.select(*df.columns, F.row_number().over(window).cast("bigint").alias(name))
    placed = _in_buckets(placed, _range_bounds(placed.select(*sorted_by), shuffle_partitions(df.sparkSession)))
    cell = [*keys, "_bucket"]
    inside = placed.withColumn(
        "_inside", F.row_number().over(Window.partitionBy(*cell).orderBy(*sorted_by))
    )
    sizes = placed.groupBy(*cell).agg(F.count("*").alias("_size"))
    # One row per (group, bucket): at most ``buckets`` rows per group.
    earlier = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *[F.col(c).alias(f"_k_{c}") for c in cell],
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"),
    )
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in cell])
    return inside.join(offsets, match).select(
        *df.columns, (F.col("_inside") + F.col("_offset")).cast("bigint").alias(name)
    )
