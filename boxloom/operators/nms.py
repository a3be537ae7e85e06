"""Merging duplicate detections: greedy suppression within image and class."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import CORNERS, corners, iou, overlaps, shared_area
from boxloom.operators.overlap import at_home, check_threshold, split_by_size, visiting
from boxloom.operators.ranking import row_numbers
from boxloom.session import durable, nested_boxes, sent_if_few

_KEYS = ("item_id", "class_name")


def _survivors(sorted_boxes: Column, threshold: float) -> Column:
    """Fold over boxes by falling confidence; a box stays if it is far from all kept."""

    def covered(kept: Column, d: Column) -> Column:
        def same(k: Column) -> Column:
            shared = shared_area(corners(k), corners(d))
            return overlaps(corners(k), corners(d)) & (
                shared / (k["area"] + d["area"] - shared) >= threshold
            )

        return F.exists(kept, same)

    return F.aggregate(
        sorted_boxes,
        F.slice(sorted_boxes, 1, 0),
        lambda kept, d: F.when(covered(kept, d), kept).otherwise(F.concat(kept, F.array(d))),
    )


def _nested(boxes: DataFrame, threshold: float) -> DataFrame:
    rest = [c for c in boxes.columns if c not in (*_KEYS, "pos", *CORNERS)]
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    box = F.struct(
        (-F.col("confidence")).alias("down"), "pos", *CORNERS, area.alias("area"),
        F.struct(*rest).alias("rest"),
    )
    grouped = boxes.groupBy(*_KEYS).agg(F.collect_list(box).alias("_all"))
    # Only the leading fields decide the order: (down, pos) is already unique.
    kept = grouped.withColumn("_kept", _survivors(F.sort_array("_all"), threshold))
    return kept.select(*_KEYS, F.inline_outer("_kept")).filter(F.col("pos").isNotNull()).select(
        *[F.col(f"rest.{c}").alias(c) if c in rest else F.col(c) for c in boxes.columns]
    )


#: A cell is cut into so many parts along each side, and each part offers its best box.
_PARTS = 4
#: Boxes left over that one task settles, in units of the boxes nested into one row.
_FEW = 16


def _settle(boxes: DataFrame, threshold: float) -> DataFrame:
    """The survivors of few open boxes, group by group."""

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["down", "pos"])
        box = group[list(CORNERS)].to_numpy()
        area = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
        kept: list[int] = []
        for k in range(len(box)):
            near = box[kept]
            w = np.minimum(near[:, 2], box[k, 2]) - np.maximum(near[:, 0], box[k, 0])
            h = np.minimum(near[:, 3], box[k, 3]) - np.maximum(near[:, 1], box[k, 1])
            shared = w * h
            same = (w > 0) & (h > 0) & (shared / (area[kept] + area[k] - shared) >= threshold)
            if not same.any():
                kept.append(k)
        return group.iloc[kept][[*_KEYS, "pos"]]

    return boxes.groupBy(*_KEYS).applyInPandas(greedy, boxes.select(*_KEYS, "pos").schema)


def _rounds(boxes: DataFrame, threshold: float) -> DataFrame:
    """Oversized groups: rounds over grid cells, without a table of conflicts.

    In a round every part of a cell offers its best open box. An offer that no better open
    box covers stays, and drops what it covers before anything else is compared; both are
    joins of the few offers with the open boxes of the cells they reach, so a round reads
    and stores no more than the boxes that are open. Offers that are few by count are sent to
    the tasks, and open boxes stay where they are. Once these are few by count, one task
    for each group settles them. Where offers are many, copies of one box collapse to their
    first, which decides for all of them. Boxes without area overlap with nothing, not even
    with their copies, and all stay.
    """
    spark = boxes.sparkSession
    solid = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    flat = boxes.filter(F.coalesce(~solid, F.lit(True)))
    boxes = boxes.filter(solid)
    whole = ["down", "pos", *CORNERS]
    left, collapsed = boxes.withColumn("down", -F.col("confidence")).select(*_KEYS, *whole), False

    def reached(offers: DataFrame) -> DataFrame:
        rows = visiting(offers, threshold)
        return rows.select(*[F.col(c).alias(f"o_{c}") for c in (*_KEYS, *whole, "level", "gx", "gy")])

    def meets() -> Column:
        on = F.col("class_name").eqNullSafe(F.col("o_class_name"))
        for c in ("item_id", "level", "gx", "gy"):
            on = on & (F.col(c) == F.col(f"o_{c}"))
        return on & (iou(corners(prefix="o_"), corners()) >= threshold)

    kept = []
    while (open_boxes := left.count()) > _FEW * nested_boxes(spark):
        offers = durable(
            at_home(left, parts=_PARTS).groupBy(*_KEYS, "level", "gx", "gy")
            .agg(F.min(F.struct(*whole)).alias("_best")).select(*_KEYS, "_best.*")
        )
        visits, few = sent_if_few(reached(offers))
        if not few and not collapsed:
            heads = left.groupBy(*_KEYS, *CORNERS).agg(F.min(F.struct("down", "pos")).alias("_rank"))
            left, collapsed = durable(heads.select(*_KEYS, "_rank.*", *CORNERS)), True
            continue
        better = F.struct("down", "pos") < F.struct(F.col("o_down").alias("down"), F.col("o_pos").alias("pos"))
        found = at_home(left).join(visits, meets() & better) if few else visits.join(at_home(left), meets() & better, "left_semi")
        refused = found.select(
            F.col("o_item_id").alias("_k"), F.col("o_class_name").alias("_c"), F.col("o_pos").alias("_p")
        ).distinct()
        same = (F.col("item_id") == F.col("_k")) & F.col("class_name").eqNullSafe(F.col("_c")) & (F.col("pos") == F.col("_p"))
        stay = durable(offers.join(refused, same, "left_anti"))
        kept.append(stay.select("item_id", "pos"))
        # a box covers itself, so what stays leaves the open boxes as well
        rest = at_home(left).join(sent_if_few(reached(stay))[0], meets(), "left_anti")
        left = durable(rest.select(*_KEYS, *whole))
    if open_boxes:
        kept.append(_settle(left, threshold).select("item_id", "pos"))
    if not kept:
        return boxes.unionByName(flat)
    final = durable(reduce(DataFrame.unionByName, kept).select(F.col("item_id").alias("_k"), F.col("pos").alias("_p")))
    same = (F.col("item_id") == F.col("_k")) & (F.col("pos") == F.col("_p"))
    return boxes.join(sent_if_few(final)[0], same, "left_semi").unionByName(flat)


def merge_detections(
    detections: DataFrame, threshold: float = 0.5, largest: int | None = None, stored: bool = False
) -> DataFrame:
    """Keep the most confident of overlapping detections of one class per image.

    ``item_id, pos`` identify a detection; ties in confidence go to the smaller
    ``pos``. Detections without a box pass through. ``largest`` bounds the
    detections of one image, where the caller knows; ``stored`` ones are cheap to read again.
    """
    t = check_threshold(threshold)
    boxes = detections.filter(F.col("x1").isNotNull())
    light, heavy = split_by_size([boxes], list(_KEYS), largest, stored)
    merged = detections.filter(F.col("x1").isNull()).unionByName(_nested(light[0], t))
    return merged if heavy is None else merged.unionByName(_rounds(heavy[0], t))


def in_order(merged: DataFrame, detections: DataFrame) -> DataFrame:
    """Add ``rank``, the place of each kept detection in its image's result.

    Detections without a box come first, by place; the others follow by falling confidence,
    then by the first place at which ``detections`` have a box of their class, then by place.
    """
    first = detections.filter(F.col("x1").isNotNull()).groupBy(
        F.col("item_id").alias("_k"), F.col("class_name").alias("_c")
    ).agg(F.min("pos").alias("_first"))
    boxed = F.col("x1").isNotNull()
    on = (F.col("item_id") == F.col("_k")) & F.col("class_name").eqNullSafe(F.col("_c"))
    order = [boxed, F.when(boxed, -F.col("confidence")), F.when(boxed, F.col("_first")), F.col("pos")]
    # numbering reads its rows more than once
    placed = durable(merged.join(first, on, "left").drop("_k", "_c"))
    return row_numbers(placed, ["item_id"], order, "rank").drop("_first")
