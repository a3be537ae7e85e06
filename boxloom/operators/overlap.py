"""Finding overlapping boxes: the IoU join.

Within an image of ordinary size the equi-join on the image already bounds the
work, so the overlap test is a residual of that join. An image with more boxes
than ``boxloom.nestedBoxes`` is joined on grid cells instead: two boxes with
IoU >= t differ in size by at most 1/t and their centres lie close together, so
each current box visits a handful of cells and never meets far-away boxes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import CORNERS, corners, iou, overlaps
from boxloom.session import durable, nested_boxes

#: Tasks a single crowded grid cell is spread over.
_SALTS = 16


def check_threshold(threshold: float) -> float:
    if not 0 < threshold <= 1:
        raise ValueError("the IoU threshold must lie in (0, 1]")
    return float(threshold)


def split_by_size(frames: Sequence[DataFrame], keys: Sequence[str], largest: int | None = None, stored: bool = False):
    """Split frames into ordinary and oversized groups: ``(light, heavy | None)``.

    A group is oversized when any of the frames holds more than the nested limit.
    ``largest`` is an upper bound of a group's rows, where the caller knows one.
    ``stored`` frames are cheap to read again. Where every group is oversized, the ordinary
    part is known to be empty and nothing is read for it.
    """
    limit = nested_boxes(frames[0].sparkSession)
    if largest is not None and largest <= limit:
        return list(frames), None
    tagged = reduce(DataFrame.unionByName, [f.select(F.lit(n).alias("_side"), *keys) for n, f in enumerate(frames)])
    sizes = tagged.groupBy("_side", *keys).agg(F.count("*").alias("_n"))
    # ordinary groups fall together under a null, which tells whether there are any
    kinds = durable(sizes.groupBy(F.when(F.col("_n") > limit, F.struct(*keys)).alias("_heavy")).agg(F.sum("_n").alias("_n")))
    heavy_keys = kinds.filter("_heavy IS NOT NULL").select("_heavy.*")
    if heavy_keys.isEmpty():
        return list(frames), None
    if kinds.filter("_heavy IS NULL").isEmpty():
        return [f.filter(F.lit(False)) for f in frames], [f if stored else durable(f) for f in frames]
    renamed = heavy_keys.select(*[F.col(k).alias(f"_h_{k}") for k in keys])

    def pick(frame: DataFrame, how: str) -> DataFrame:
        condition = F.lit(True)
        for k in keys:
            condition = condition & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
        return frame.join(renamed, condition, how)

    # The crowded part is read many times, so it is settled once.
    heavy = [durable(pick(f, "left_semi")) for f in frames]
    return [pick(f, "left_anti") for f in frames], heavy


def _sides(baseline: DataFrame, current: DataFrame, keys: Sequence[str], extra: Sequence[str]):
    def side(df: DataFrame, p: str, pos: str) -> DataFrame:
        return df.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).select(
            *[F.col(k).alias(f"{p}{k}") for k in keys],
            F.col("pos").alias(pos),
            *[F.col(c).alias(f"{p}{c}") for c in (*CORNERS, *extra)],
        )

    return side(baseline, "b_", "i"), side(current, "c_", "j")


def _with_iou(pairs: DataFrame, keys: Sequence[str], extra: Sequence[str], t: float) -> DataFrame:
    value = iou(corners(prefix="b_"), corners(prefix="c_"))
    return pairs.withColumn("iou", value).filter(F.col("iou") >= t).select(
        *[F.col(f"b_{k}").alias(k) for k in keys],
        "i",
        "j",
        *[f"b_{c}" for c in extra],
        *[f"c_{c}" for c in extra],
        "iou",
    )


def _keys_equal(keys: Sequence[str], null_safe: bool = True) -> Column:
    condition = F.lit(True)
    for k in keys:
        left, right = F.col(f"b_{k}"), F.col(f"c_{k}")
        condition = condition & (left.eqNullSafe(right) if null_safe else left == right)
    return condition


def join_in_image(baseline, current, keys, threshold, extra=(), condition=None) -> DataFrame:
    """Candidates of ordinary images: equi-join on ``keys``, overlap as residual."""
    b, c = _sides(baseline, current, keys, extra)
    on = _keys_equal(keys) & overlaps(corners(prefix="b_"), corners(prefix="c_"))
    if condition is not None:
        on = on & condition
    return _with_iou(b.join(c, on), keys, extra, threshold)


def collapse_copies(boxes: DataFrame, image: str) -> tuple[DataFrame, DataFrame]:
    """Distinct boxes (class and corners) and the rows that share each of them.

    Returns ``types`` with the first position of each as ``pos`` and its ``copies``,
    and ``members`` as ``image, type, pos``.
    """
    same = ["class_name", *CORNERS]
    types = durable(
        boxes.groupBy(image, *same).agg(F.min("pos").alias("pos"), F.count("*").alias("copies"))
    )
    lookup = types.select(
        *[F.col(c).alias(f"_t_{c}") for c in (image, *same)], F.col("pos").alias("type")
    )
    on = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in (image, *same)]
    )
    return types, boxes.join(lookup, on).select(image, "type", "pos")


def _dims(p: str) -> tuple[Column, Column, Column, Column, Column]:
    """Centre, width, height and level of a box; the level is its larger side's power of two."""
    x1, y1, x2, y2 = corners(prefix=p)
    w, h = x2 - x1, y2 - y1
    return (x1 + x2) / 2.0, (y1 + y2) / 2.0, w, h, F.ceil(F.log2(F.greatest(w, h))).cast("int")


def at_home(boxes: DataFrame, p: str = "", parts: int = 1) -> DataFrame:
    """Add the cell ``level, gx, gy`` a box lies in, or one of ``parts`` squared parts of it."""
    cx, cy, _, _, level = _dims(p)
    size = F.pow(F.lit(2.0), F.col(f"{p}level") + 1) / parts
    return boxes.withColumn(f"{p}level", level).withColumns({f"{p}gx": F.floor(cx / size), f"{p}gy": F.floor(cy / size)})


def visiting(boxes: DataFrame, threshold: float, p: str = "") -> DataFrame:
    """A row for every cell ``level, gx, gy`` where a box of that IoU could be at home."""
    t = threshold
    spread = math.ceil(math.log2(1 / t) + 1e-9)
    reach = (1 - t) * max(1.0, 1 / (2 * t)) + 1e-6
    cx, cy, w, h, level = _dims(p)
    boxes = boxes.withColumn("_level", level).withColumn(
        # a partner on a level has a side of at most 2^level, so its area bounds the level too
        f"{p}level", F.explode(F.sequence(
            F.greatest(F.col("_level") - spread, F.ceil(F.log2(w * h * t) / 2 - 1e-9).cast("int")), F.col("_level") + spread
        ))
    )
    half = F.pow(F.lit(2.0), F.col(f"{p}level")) / 2 + 1e-6
    size = F.pow(F.lit(2.0), F.col(f"{p}level") + 1)

    def cells(centre: Column, side: Column) -> Column:
        near = F.least(side * reach, half + side / 2)
        return F.explode(F.sequence(F.floor((centre - near) / size), F.floor((centre + near) / size)))

    return boxes.withColumn(f"{p}gx", cells(cx, w)).withColumn(f"{p}gy", cells(cy, h)).drop("_level")


def join_on_grid(baseline, current, keys, threshold, extra=(), condition=None) -> DataFrame:
    """Candidates of oversized images: equi-join on ``keys`` and a size-scaled cell.

    Cells are salted, so a crowded spot is still spread over several tasks.
    """
    t = check_threshold(threshold)
    b, c = _sides(baseline, current, keys, extra)
    b = at_home(b, "b_").withColumn("b_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    c = visiting(c.withColumn("c_salt", F.pmod(F.xxhash64("j"), F.lit(_SALTS)).cast("int")), t, "c_")
    on = _keys_equal(keys) & overlaps(corners(prefix="b_"), corners(prefix="c_"))
    for name in ("level", "gx", "gy", "salt"):
        on = on & (F.col(f"b_{name}") == F.col(f"c_{name}"))
    if condition is not None:
        on = on & condition
    return _with_iou(b.join(c, on), keys, extra, t)


def iou_candidates(
    baseline: DataFrame,
    current: DataFrame,
    threshold: float,
    same_class: bool,
    image: str = "item_id",
    largest: int | None = None,
) -> DataFrame:
    """All pairs of one image with IoU >= ``threshold`` and equal / different class."""
    check_threshold(threshold)
    keys = [image, "class_name"] if same_class else [image]
    differ = None
    if not same_class:
        differ = ~F.col("b_class_name").eqNullSafe(F.col("c_class_name"))
    extra = [] if same_class else ["class_name"]
    light, heavy = split_by_size([baseline, current], [image], largest)
    pairs = join_in_image(*light, keys, threshold, extra, differ)
    if heavy is not None:
        types, members = collapse_copies(heavy[0], image)
        found = join_on_grid(types, heavy[1], keys, threshold, extra, differ)
        # Copies of a box have the same partners; they are put back afterwards.
        copies = members.select(
            F.col(image).alias("_image"), F.col("type").alias("_type"), F.col("pos").alias("_i")
        )
        expanded = found.join(
            copies, (F.col(image) == F.col("_image")) & (F.col("i") == F.col("_type"))
        ).withColumn("i", F.col("_i"))
        pairs = pairs.unionByName(expanded.select(*pairs.columns))
    return pairs
