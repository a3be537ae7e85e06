"""Roll-ups over compared annotation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.numbers import py_round
from boxloom.operators.matching import Comparison
from boxloom.schema import KINDS

DISPUTED = KINDS[1:]


def _total() -> Column:
    return sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))


def _disputed() -> Column:
    return sum((F.col(k) for k in DISPUTED[1:]), F.col(DISPUTED[0]))


def _agreement() -> Column:
    return F.when(_total() == 0, F.lit(1.0)).otherwise(F.col("agreed") / F.nullif(_total(), F.lit(0)))


def comparable(items: DataFrame) -> DataFrame:
    """Done items with something on at least one side."""
    return items.filter(
        (F.col("status") == "done")
        & ((F.col("detection_count") > 0) | (F.col("baseline_count") > 0))
    )


def keep_done(annotations: DataFrame, items: DataFrame) -> DataFrame:
    """Annotations of done items only; the images keep their own partitioning."""
    done = items.filter(F.col("status") == "done").select("item_id")
    return annotations.join(done, "item_id", "left_semi")


def item_diff(comparison: Comparison) -> DataFrame:
    """Counts per kind, disputed objects and agreement of each compared image."""
    return comparison.item_counts().select(
        comparison.image,
        *KINDS,
        _disputed().alias("disputed"),
        _agreement().alias("agreement"),
    )


def diff_summary(verdicts: DataFrame) -> DataFrame:
    """Project totals from per-image verdicts."""
    return (
        verdicts.agg(
            F.count("*").alias("items"),
            F.count_if(F.col("disputed") == 0).alias("items_identical"),
            *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in KINDS],
        )
        .withColumn("items_disputed", F.col("items") - F.col("items_identical"))
        .withColumn("disputed", _disputed())
        .withColumn("agreement", py_round(_agreement(), 4))
    )


def diff_by_class(pairings: DataFrame) -> DataFrame:
    """Kinds per class; a pair counts under its current class when it has one."""
    shown = F.when(F.col("c_pos").isNotNull(), F.col("c_class")).otherwise(F.col("b_class"))
    return (
        pairings.groupBy(F.coalesce(shown, F.lit("?")).alias("class_name"))
        .agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
        .withColumn("disputed", _disputed())
        .orderBy(F.desc("disputed"), "class_name")
    )


def diff_swaps(pairings: DataFrame) -> DataFrame:
    """How often one class turned into another."""
    before = F.coalesce("b_class", F.lit("?"))
    after = F.coalesce("c_class", F.lit("?"))
    return (
        pairings.filter(F.col("kind") == "reclassified")
        .groupBy(F.concat(before, F.lit(" -> "), after).alias("swap"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "swap")
    )


def top_swaps(swaps: DataFrame, limit: int = 6) -> DataFrame:
    return swaps.orderBy(F.desc("count"), "swap").limit(limit)


def top_disputed_classes(by_class: DataFrame, limit: int = 8) -> DataFrame:
    return (
        by_class.filter(F.col("disputed") > 0)
        .orderBy(F.desc("disputed"), "class_name")
        .limit(limit)
    )


def refresh_comparison(items: DataFrame, comparison: Comparison) -> DataFrame:
    """Items with ``disputed`` and ``agreement`` recomputed where they compare.

    Items outside the comparison keep the verdict they had.
    """
    verdicts = item_diff(comparison).select(
        F.col(comparison.image).alias("_id"),
        F.col("disputed").alias("_disputed"),
        F.col("agreement").alias("_agreement"),
    )
    fresh = items.join(verdicts, F.col("item_id") == F.col("_id"), "left")
    return fresh.withColumns(
        {
            "disputed": F.coalesce("_disputed", "disputed"),
            "agreement": F.coalesce("_agreement", "agreement"),
        }
    ).drop("_id", "_disputed", "_agreement")


def item_comparison(items: DataFrame, comparison: Comparison) -> DataFrame:
    """The object-level diff beside each image's verdict, one row per object."""
    objects = comparison.counted_pairings().select(
        F.col(comparison.image).alias("item_id"),
        "kind", "b_pos", "c_pos",
        F.when(F.col("kind") == "reclassified", F.coalesce("b_class", F.lit("?"))).alias("from_class"),
        F.when(F.col("kind") == "reclassified", F.coalesce("c_class", F.lit("?"))).alias("to_class"),
        py_round(F.col("overlap"), 3).alias("overlap"),
        _disputed().alias("disputed"), py_round(_agreement(), 4).alias("agreement"),
    )
    heads = items.select(
        "item_id", "rel_path", (F.col("baseline_count") > 0).alias("has_baseline")
    )
    return objects.join(heads, "item_id")
