"""Rows describing scored images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.numbers import margin_priority, py_round
from boxloom.schema import DETECTION, TOP_K


def result_rows(images: DataFrame, detections: DataFrame) -> DataFrame:
    """One serialised row per scored image: counts, timings, priority and rate."""
    found = detections.groupBy("item_id").agg(
        F.count("*").alias("_n"),
        F.max(margin_priority(F.coalesce("confidence", F.lit(1.0)))).alias("_p"),
    )
    total = F.col("preprocess_ms") + F.col("inference_ms") + F.col("postprocess_ms")
    return images.join(found, "item_id", "left").select(
        "item_id",
        "task",
        F.coalesce("_n", F.lit(0)).alias("count"),
        py_round(F.col("inference_ms"), 2).alias("speed_ms"),
        *[py_round(F.col(c), 3).alias(c) for c in ("preprocess_ms", "inference_ms", "postprocess_ms")],
        py_round(total, 3).alias("total_ms"),
        py_round(F.coalesce("_p", F.lit(1.0)), 4).alias("review_priority"),
        (F.lit(1000.0) / F.nullif(F.col("inference_ms"), F.lit(0.0))).alias("fps"),
    )


def softmax_top_k(
    logits: DataFrame,
    classes: list[int] | None = None,
    conf: float = 0.0,
    k: int = TOP_K,
) -> DataFrame:
    """Most likely classes per row of ``item_id, logits``.

    Classes are ranked first and filtered after, so a filter never lifts a class
    the scorer ranked low; the confidence cut comes last.
    """
    top = F.array_max("logits")
    powers = F.transform("logits", lambda v: F.exp(v - F.col("_top")))
    total = F.aggregate(F.col("_powers"), F.lit(0.0), lambda acc, v: acc + v)
    ranked = F.slice(
        F.filter(
            F.reverse(F.sort_array(F.transform("_powers", lambda p, i: F.struct(p.alias("p"), i.alias("i"))))),
            lambda e: e["i"].isin(sorted(set(classes))) if classes else F.lit(True),
        ),
        1,
        k,
    )
    staged = (
        logits.withColumn("_top", top).withColumn("_powers", powers).withColumn("_total", total)
        .withColumn("_ranked", ranked)
    )
    return (
        staged.select("item_id", "_total", F.posexplode("_ranked").alias("rank", "_e"))
        .select(
            "item_id",
            (F.col("rank") + 1).cast("bigint").alias("rank"),
            F.col("_e.i").alias("class_id"),
            (F.col("_e.p") / F.col("_total")).alias("confidence"),
        )
        .filter(F.col("confidence") >= conf)
    )


def assemble_detections(
    boxes: Column,
    confidences: Column,
    class_ids: Column,
    names: Column,
    masks: Column | None = None,
    keypoints: Column | None = None,
    track_ids: Column | None = None,
    oriented: bool = False,
) -> Column:
    """Parallel arrays of raw model output as one array of detections.

    Masks, keypoints and track ids may be shorter than the boxes; whatever is
    present decides the kind: pose over segmentation over box.
    """
    nothing = F.lit(None)

    def at(values: Column | None, i: Column, kind: str) -> Column:
        return nothing.cast(kind) if values is None else F.get(values, i).cast(kind)

    points = "array<array<double>>"

    def one(box: Column, i: Column) -> Column:
        mask, keys = at(masks, i, points), at(keypoints, i, points)
        kind = F.when(keys.isNotNull(), "pose").when(mask.isNotNull(), "segmentation").otherwise(
            "obb" if oriented else "box"
        )
        class_id = F.get(class_ids, i).cast("int")
        return F.struct(
            F.try_element_at(names, class_id).alias("class_name"),
            F.get(confidences, i).cast("double").alias("confidence"),
            kind.alias("kind"),
            box.cast("array<double>").alias("box"),
            mask.alias("mask"),
            keys.alias("keypoints"),
            class_id.alias("class_id"),
            at(track_ids, i, "int").alias("track_id"),
        )

    return F.transform(boxes, one).cast(f"array<{DETECTION.simpleString()}>")


def aligned_batch(inputs: DataFrame, results: DataFrame) -> DataFrame:
    """One slot per input, in input order; inputs without a result carry an error."""
    values = [c for c in results.columns if c != "ord"]
    return (
        inputs.join(results.withColumn("_hit", F.lit(True)), "ord", "left")
        .select(
            "ord",
            F.when(F.col("error").isNull() & F.col("_hit"), "ok").otherwise("error").alias("status"),
            F.when(
                F.col("error").isNotNull() | F.col("_hit").isNull(),
                F.coalesce("error", F.lit("could not decode image")),
            ).alias("detail"),
            *values,
        )
        .orderBy("ord")
    )

