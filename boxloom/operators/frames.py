"""Sampling frames evenly and following objects from frame to frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.operators.matching import Comparison
from boxloom.operators.ranking import row_numbers
from boxloom.schema import FALLBACK_FPS
from boxloom.session import durable


def planned_frames(total: Column, cap: int) -> Column:
    """How many frames of a clip are kept; an unknown length keeps the first ones."""
    if cap <= 0:
        return F.greatest(F.coalesce(total, F.lit(0)), F.lit(0)).cast("bigint")
    known = F.coalesce(total, F.lit(0)) > 0
    return F.when(known, F.least(total, F.lit(cap))).otherwise(F.lit(cap)).cast("bigint")


def sample_frames(frames: DataFrame, cap: int) -> DataFrame:
    """Frame ``k`` of a sampled clip is source frame ``k * total / planned``.

    ``frames`` carries ``clip, idx, total``; a null or zero ``total`` is an unknown
    length, read in order up to the cap and marked ``truncated`` beyond it.
    """
    known = F.coalesce("total", F.lit(0)) > 0
    staged = frames.withColumn("planned", planned_frames(F.col("total"), cap)).withColumn(
        "out_idx",
        F.when(known, F.expr("(idx * planned + total - 1) div nullif(total, 0)")).otherwise(F.col("idx")),
    )
    unknown = F.lit(True) if cap <= 0 else F.col("idx") < cap
    keep = F.when(known, F.expr("(out_idx * total) div nullif(planned, 0)") == F.col("idx")).otherwise(unknown)
    return staged.filter(keep & (~known | (F.col("out_idx") < F.col("planned"))))


def truncated_clips(frames: DataFrame, cap: int) -> DataFrame:
    """Clips of unknown length that ran past the cap."""
    unknown = F.coalesce("total", F.lit(0)) <= 0
    longest = frames.filter(unknown).groupBy("clip").agg(F.max("idx").alias("_last"))
    return longest.select("clip", (F.lit(cap > 0) & (F.col("_last") >= cap)).alias("truncated"))


def clip_rate(clips: DataFrame, cap: int) -> DataFrame:
    """The frame rate at which a sampled clip lasts as long as its source."""
    source = F.coalesce(F.nullif(F.col("fps"), F.lit(0.0)), F.lit(FALLBACK_FPS))
    planned = planned_frames(F.col("total"), cap)
    known = (F.coalesce("total", F.lit(0)) > 0) & (planned > 0)
    return clips.withColumn("planned", planned).withColumn(
        "output_fps",
        F.when(known, source * F.col("planned") / F.nullif("total", F.lit(0))).otherwise(source),
    )


def track_objects(detections: DataFrame, threshold: float = 0.3, largest: int | None = None) -> DataFrame:
    """Add a ``track_id`` that follows an object through consecutive frames.

    ``clip, idx, pos`` identify a detection. Each frame is matched one-to-one with
    the next one (same class, IoU); the matched pairs form chains, and pointer
    doubling finds the first detection of every chain. A clip is never gathered:
    frames are matched pair by pair and a chain of n frames needs log2(n) rounds.
    ``largest`` bounds the detections of one frame, where the caller knows.
    """
    box = ["class_name", "x1", "y1", "x2", "y2"]
    frame = F.struct("clip", "idx").alias("frame")
    before = detections.select(frame, "pos", *box)
    after = detections.select(
        F.struct("clip", (F.col("idx") - 1).alias("idx")).alias("frame"), "pos", *box
    )
    links = Comparison(before, after, threshold, image="frame", largest=largest).matches().filter(F.col("pass") == 0)
    previous = links.select(
        F.col("frame.clip").alias("_clip"),
        (F.col("frame.idx") + 1).alias("_idx"),
        F.col("j").alias("_pos"),
        F.struct(F.col("frame.idx").alias("idx"), F.col("i").alias("pos")).alias("_prev"),
    )
    node = ["clip", "idx", "pos"]
    itself = F.struct("idx", "pos")
    heads = durable(
        detections.select(*node)
        .join(
            previous,
            (F.col("clip") == F.col("_clip")) & (F.col("idx") == F.col("_idx")) & (F.col("pos") == F.col("_pos")),
            "left",
        )
        .select(*node, F.coalesce("_prev", itself).alias("head"), F.col("_prev").isNull().alias("done"))
    )
    # Heads that have arrived stay where they are; only the others are written anew.
    arrived, moving = heads.filter("done"), heads.filter(~F.col("done"))
    while not moving.isEmpty():
        lookup = arrived.unionByName(moving).select(
            F.col("clip").alias("_clip"), itself.alias("_node"),
            F.col("head").alias("_head"), F.col("done").alias("_done"),
        )
        moved = durable(
            moving.join(lookup, (F.col("clip") == F.col("_clip")) & (F.col("head") == F.col("_node")))
            .select(*node, F.col("_head").alias("head"), F.col("_done").alias("done"))
        )
        arrived, moving = arrived.unionByName(moved.filter("done")), moved.filter(~F.col("done"))
    heads = arrived
    starts = heads.filter(F.col("head") == itself).select("clip", "head")
    numbered = row_numbers(starts, ["clip"], [F.col("head")], "track_id").select(
        F.col("clip").alias("_clip"), F.col("head").alias("_head"), "track_id"
    )
    ids = heads.join(
        numbered, (F.col("clip") == F.col("_clip")) & (F.col("head") == F.col("_head"))
    ).select(*node, "track_id")
    return detections.join(ids, node)
