"""Sliced inference: planning tiles and merging what they found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import CORNERS, shift_points, tile_origins
from boxloom.operators.nms import merge_detections
from boxloom.schema import MAX_TILES

#: Overview detections follow all tile detections of their image.
OVERVIEW_FROM = 1 << 40
_TILE_STRIDE = 1 << 24


def tile_decision(images: DataFrame, tile: int, overlap: float = 0.2) -> DataFrame:
    """How many tiles an image needs and whether it is sliced at all.

    Images no larger than a tile, and those needing more than the allowed number
    of tiles, are scored in a single pass.
    """
    planned = images.withColumns(
        {
            "_xs": tile_origins(F.col("width"), tile, overlap),
            "_ys": tile_origins(F.col("height"), tile, overlap),
        }
    )
    count = F.array_size("_xs") * F.array_size("_ys")
    return planned.withColumn("tiles", count).withColumn(
        "tiled", (F.greatest("width", "height") > tile) & (F.col("tiles") <= MAX_TILES)
    )


def plan_tiles(images: DataFrame, tile: int, overlap: float = 0.2) -> DataFrame:
    """Every tile of every image, numbered row by row."""
    decided = tile_decision(images, tile, overlap)
    rows = decided.select(
        "item_id", "width", "height", "tiled", F.array_size("_xs").alias("_nx"), "_xs",
        F.posexplode("_ys").alias("_yi", "y"),
    ).select(
        "item_id", "width", "height", "tiled", "_nx", "_yi", "y", F.posexplode("_xs").alias("_xi", "x")
    )
    return rows.select(
        "item_id",
        (F.col("_yi") * F.col("_nx") + F.col("_xi")).alias("tile_no"),
        "x", "y",
        F.least(F.lit(tile), "width").alias("tile_width"),
        F.least(F.lit(tile), "height").alias("tile_height"),
        "tiled",
    )


def shift_to_image(detections: DataFrame) -> DataFrame:
    """Tile coordinates to image coordinates by the tile's ``x, y`` offset."""
    moved = {
        c: F.col(c) + F.col("x" if c.startswith("x") else "y").cast("double") for c in CORNERS
    }
    for c in ("mask", "keypoints"):
        if c in detections.columns:
            moved[c] = shift_points(F.col(c), F.col("x").cast("double"), F.col("y").cast("double"))
    return detections.withColumns(moved)


def merge_tiles(
    tile_detections: DataFrame, overview: DataFrame | None, threshold: float = 0.5, largest: int | None = None
) -> DataFrame:
    """Detections of all tiles plus the whole-image pass, duplicates merged.

    ``tile_detections`` carries ``tile_no, x, y`` and tile coordinates; ``pos``
    afterwards is the place in tile order, then overview order. ``largest`` bounds the
    detections of one image, where the caller knows.
    """
    columns = ["item_id", "pos", "class_name", "confidence", *CORNERS]
    moved = shift_to_image(tile_detections).withColumn(
        "pos", F.col("tile_no").cast("bigint") * _TILE_STRIDE + F.col("pos")
    )
    everything = moved.select(*columns)
    if overview is not None:
        everything = everything.unionByName(
            overview.withColumn("pos", F.col("pos") + OVERVIEW_FROM).select(*columns)
        )
    return merge_detections(everything, threshold, largest)


def tile_timings(passes: DataFrame) -> DataFrame:
    """Stage times per image, summed over its tiles and the overview."""
    stages = ("preprocess_ms", "inference_ms", "postprocess_ms")
    return passes.groupBy("item_id").agg(*[F.sum(c).alias(c) for c in stages])
