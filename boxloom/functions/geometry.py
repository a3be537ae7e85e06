"""Box geometry as column expressions (pixels, corners ``x1 y1 x2 y2``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxloom.functions.numbers import clamp, py_round

Corners = Sequence[Column]
CORNERS = ("x1", "y1", "x2", "y2")


def corners(holder: Column | None = None, prefix: str = "") -> list[Column]:
    """The four corner columns, plain or as fields of a struct column."""
    if holder is None:
        return [F.col(f"{prefix}{name}") for name in CORNERS]
    return [holder[name] for name in CORNERS]


def corners_of_array(box: Column) -> list[Column]:
    return [F.get(box, F.lit(i)) for i in range(4)]


def overlaps(a: Corners, b: Corners) -> Column:
    """True when two boxes share a positive area; touching edges do not count."""
    return (
        (F.least(a[2], b[2]) > F.greatest(a[0], b[0]))
        & (F.least(a[3], b[3]) > F.greatest(a[1], b[1]))
    )


def shared_area(a: Corners, b: Corners) -> Column:
    return (F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * (
        F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    )


def _union(a: Corners, b: Corners) -> Column:
    return (
        (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared_area(a, b)
    )


def iou(a: Corners, b: Corners) -> Column:
    """Intersection over union; 0 for boxes that only touch or have no area."""
    return F.when(
        overlaps(a, b) & (_union(a, b) > 0), shared_area(a, b) / _union(a, b)
    ).otherwise(F.lit(0.0))


def box_area(box: Corners) -> Column:
    width = F.greatest(F.lit(0.0), box[2] - box[0])
    height = F.greatest(F.lit(0.0), box[3] - box[1])
    return F.coalesce(width * height, F.lit(0.0))


def tile_step(tile: int, overlap: float) -> int:
    if tile <= 0:
        raise ValueError("tile size must be positive")
    return max(1, round(tile * (1.0 - min(max(overlap, 0.0), 0.9))))


def tile_origins(extent: Column, tile: int, overlap: float) -> Column:
    """Where tiles start along one axis; the last one is pulled back to the edge."""
    step = tile_step(tile, overlap)
    last = (extent - F.lit(tile)).cast("int")
    return F.when(extent <= tile, F.array(F.lit(0))).otherwise(
        F.array_distinct(
            F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)), F.array(last))
        )
    )


def shift_box(box: Column, dx: Column, dy: Column) -> Column:
    return F.when(
        box.isNotNull(),
        F.transform(box, lambda v, i: v + F.when(i % 2 == 0, dx).otherwise(dy)),
    )


def shift_points(points: Column, dx: Column, dy: Column) -> Column:
    """Move polygon or keypoint rows; a third element (a score) stays as it is."""
    return F.transform(
        points,
        lambda p: F.transform(
            p, lambda v, i: v + F.when(i == 0, dx).when(i == 1, dy).otherwise(F.lit(0.0))
        ),
    )


def yolo_box(box: Corners, width: Column, height: Column) -> list[Column]:
    """Centre and size as shares of the image, each clamped to 0..1."""
    return [
        clamp((box[0] + box[2]) / F.lit(2.0) / width, 0.0, 1.0),
        clamp((box[1] + box[3]) / F.lit(2.0) / height, 0.0, 1.0),
        clamp((box[2] - box[0]) / width, 0.0, 1.0),
        clamp((box[3] - box[1]) / height, 0.0, 1.0),
    ]


def percent(value: Column, extent: Column) -> Column:
    return py_round(F.lit(100.0) * value / extent, 4)


def corners_from_coco(bbox: Column) -> Column:
    """``[x, y, w, h]`` to rounded corners; null unless it holds four numbers."""
    x, y, w, h = corners_of_array(bbox)
    return F.when(
        F.array_size(bbox) >= 4,
        F.array(py_round(x, 2), py_round(y, 2), py_round(x + w, 2), py_round(y + h, 2)),
    )


def polygon_from_flat(flat: Column) -> Column:
    """Pair up a flat coordinate list; an odd last value is dropped."""
    return F.transform(
        F.filter(F.sequence(F.lit(0), F.array_size(flat)), lambda i: (i % 2 == 0) & (i + 1 < F.array_size(flat))),
        lambda i: F.array(py_round(F.get(flat, i), 2), py_round(F.get(flat, i + 1), 2)),
    )


def keypoints_from_flat(flat: Column) -> Column:
    """Triples to ``[x, y, score]``; any non-zero visibility becomes 1.0."""
    return F.transform(
        F.filter(F.sequence(F.lit(0), F.array_size(flat)), lambda i: (i % 3 == 0) & (i + 2 < F.array_size(flat))),
        lambda i: F.array(
            py_round(F.get(flat, i), 2),
            py_round(F.get(flat, i + 1), 2),
            F.when(F.get(flat, i + 2) != 0, F.lit(1.0)).otherwise(F.lit(0.0)),
        ),
    )


def keypoint_visibility(point: Column) -> Column:
    """COCO visibility from a score: 2 sure, 1 doubtful, 0 absent."""
    score = F.coalesce(F.get(point, F.lit(2)), F.lit(0.0))
    return F.when(score > 0.5, F.lit(2.0)).when(score > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def flat_rounded(points: Column) -> Column:
    return F.transform(F.flatten(points), lambda v: py_round(v, 2))
