"""Bringing COCO annotations back onto the items of a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boxloom.functions.geometry import corners_from_coco, keypoints_from_flat, polygon_from_flat
from boxloom.functions.text import match_key
from boxloom.operators.ranking import has_hot_group, row_numbers
from boxloom.session import durable, hot_group_rows


def of_documents(
    images: DataFrame, annotations: DataFrame, categories: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of several documents with ids and places that tell documents apart.

    Every document counts its own ids, so an id or place becomes ``(doc_id, id)``; a
    missing one stays missing. Documents stand in the order of their names. All other
    operators here take such tables as they take those of one document.
    """

    def own(df: DataFrame, *names: str) -> DataFrame:
        return df.withColumns({
            n: F.when(F.col(n).isNotNull(), F.struct("doc_id", F.col(n).alias("id"))) for n in names if n in df.columns
        })

    return own(images, "id", "ord"), own(annotations, "image_id", "category_id", "id", "ord"), own(categories, "id", "ord")


def _as_written(df: DataFrame, name: str) -> Column:
    """An id as its document gives it, as text."""
    whole = isinstance(df.schema[name].dataType, StructType)
    return (F.col(name)["id"] if whole else F.col(name)).cast("string")


def clean_categories(categories: DataFrame) -> DataFrame:
    """Category id to name: the last entry of an id wins, nameless ones get one."""
    last = categories.filter(F.col("id").isNotNull()).groupBy("id").agg(
        F.max_by("name", "ord").alias("_name")
    )
    default = F.concat(F.lit("class_"), _as_written(last, "id"))
    return last.select("id", F.coalesce("_name", default).alias("name"))


def clean_images(images: DataFrame) -> DataFrame:
    """Usable images by id: the last entry's values at the first entry's place."""
    values = F.struct("file_name", "width", "height")
    return (
        images.filter(F.col("id").isNotNull() & F.col("file_name").isNotNull())
        .groupBy("id")
        .agg(F.min("ord").alias("ord"), F.max_by(values, "ord").alias("_v"))
        .select("id", "ord", "_v.*")
    )


def clean_annotations(annotations: DataFrame) -> DataFrame:
    return annotations.filter(F.col("image_id").isNotNull())


def match_images(images: DataFrame, items: DataFrame) -> DataFrame:
    """Each image with its item, null where no item has that base name.

    The item side is reduced to one row per name before the join: the first path.
    """
    owner = F.struct(
        "item_id", F.col("width").alias("item_width"), F.col("height").alias("item_height"),
        F.col("task").alias("item_task"),
    )
    owners = items.groupBy(match_key(F.col("rel_path")).alias("_key")).agg(
        F.min_by(owner, "rel_path").alias("_item")
    )
    return (
        images.withColumnRenamed("id", "image_id")
        .join(owners, match_key(F.col("file_name")) == F.col("_key"), "left")
        .select("image_id", "ord", "file_name", "width", "height", "_item.*")
    )


def hits(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("item_id").isNotNull())


def unknown_files(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("item_id").isNull()).select("ord", "file_name")


def unknown_report(matched: DataFrame, shown: int = 20) -> DataFrame:
    """The first few unmatched file names beside their total."""
    unknown = unknown_files(matched)
    first = unknown.orderBy("ord").limit(shown).select(F.struct("ord", "file_name").alias("_f"), F.lit(0).alias("_n"))
    total = unknown.agg(F.count("*").alias("_n")).select(F.lit(None).alias("_f"), "_n")
    both = first.unionByName(total).agg(F.collect_list("_f").alias("_first"), F.sum("_n").alias("unknown_file_count"))
    return both.select(F.inline("_first"), "unknown_file_count")


def to_detections(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """COCO annotations as detections of certainty 1; unusable boxes are dropped.

    ``annotations`` carries ``image_id, id, category_id, bbox`` and optionally
    ``segmentation``, ``keypoints`` and ``ord``, the place in the document, which gives
    their order; without it ``id`` does.
    """
    place = "ord" if "ord" in annotations.columns else "id"
    named = annotations.join(
        categories.select(F.col("id").alias("_cid"), F.col("name").alias("_cname")),
        F.col("category_id") == F.col("_cid"),
        "left",
    )
    fallback = F.concat(F.lit("class_"), _as_written(annotations, "category_id"))
    points = "array<array<double>>"
    mask, keys = F.lit(None).cast(points), F.lit(None).cast(points)
    if "segmentation" in annotations.columns:
        mask = F.when(F.array_size("segmentation") > 0, polygon_from_flat(F.get("segmentation", F.lit(0))))
    if "keypoints" in annotations.columns:
        keys = F.when(F.array_size("keypoints") >= 3, keypoints_from_flat(F.col("keypoints")))
    boxed = named.select(
        "image_id",
        F.col(place).alias("ann_ord"),
        F.when(F.col("category_id").isNull(), "object")
        .otherwise(F.coalesce("_cname", fallback))
        .alias("class_name"),
        F.lit(1.0).alias("confidence"),
        corners_from_coco(F.col("bbox")).alias("box"),
        mask.alias("mask"),
        keys.alias("keypoints"),
    ).filter(F.col("box").isNotNull())
    kind = F.when(F.col("keypoints").isNotNull(), "pose").when(
        F.col("mask").isNotNull(), "segmentation"
    )
    return boxed.select(
        "image_id", "ann_ord", "class_name", "confidence", kind.otherwise("box").alias("kind"),
        *[F.get("box", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))],
        "mask", "keypoints",
    )


def winners(matched: DataFrame) -> DataFrame:
    """Of several images hitting one item, the last overwrites the others."""
    found = hits(matched)
    whole = F.struct(*[c for c in found.columns if c != "item_id"])
    return found.groupBy("item_id").agg(F.max_by(whole, "ord").alias("_w")).select("item_id", "_w.*")


SET_COLUMNS = ("item_id", "pos", "class_name", "confidence", "x1", "y1", "x2", "y2")


def _placed(
    rows: DataFrame, order: list[Column], start: Column, hot: bool | None = None
) -> DataFrame:
    numbered = row_numbers(rows, ["item_id"], order, "_n", hot=hot)
    return numbered.withColumn("pos", start + F.col("_n") - 1).select(*SET_COLUMNS)


def import_replace(current: DataFrame, matched: DataFrame, detections: DataFrame) -> DataFrame:
    """The annotation set after an overwriting import.

    Every matched item loses what it had, also when its image has no annotations.
    """
    chosen = winners(matched)
    touched = chosen.select("item_id")
    fresh = detections.join(chosen.select("item_id", "image_id"), "image_id")
    # One image per item, so the annotation side alone tells how large items get.
    crowded = has_hot_group(detections.select("image_id"), ["image_id"])
    return (
        current.select(*SET_COLUMNS)
        .join(touched, "item_id", "left_anti")
        .unionByName(_placed(fresh, [F.col("ann_ord")], F.lit(0), crowded))
    )


def import_append(current: DataFrame, matched: DataFrame, detections: DataFrame) -> DataFrame:
    """Previous rows followed by the imported ones, in image then annotation order."""
    found = durable(hits(matched).select("item_id", "image_id", "ord"))
    most = F.coalesce(F.max("count"), F.lit(0))
    # both sides' largest groups bound an item without joining them
    images = found.groupBy("item_id").count().agg(most).first()[0]
    entries = detections.groupBy("image_id").count().agg(most).first()[0]
    hot = False if images * entries <= hot_group_rows(current.sparkSession) else None
    fresh = detections.join(found, "image_id")
    sizes = current.groupBy("item_id").agg((F.max("pos") + 1).alias("_size"))
    started = fresh.join(sizes, "item_id", "left").withColumn("_size", F.coalesce("_size", F.lit(0)))
    return current.select(*SET_COLUMNS).unionByName(
        _placed(started, [F.col("ord"), F.col("ann_ord")], F.col("_size"), hot)
    )


def import_current(items: DataFrame, matched: DataFrame, detections: DataFrame) -> DataFrame:
    """Items after an overwriting import into the working set."""
    chosen = winners(matched)
    counts = detections.groupBy("image_id").agg(F.count("*").alias("_n"))
    update = chosen.join(counts, "image_id", "left").select(
        F.col("item_id").alias("_id"),
        F.coalesce("_n", F.lit(0)).alias("_n"),
        *[
            F.coalesce(F.nullif(F.col(side), F.lit(0)), F.col(f"item_{side}"), F.lit(0))
            .cast("int")
            .alias(f"_{side}")
            for side in ("width", "height")
        ],
    )
    joined = items.join(update, F.col("item_id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    changes = {
        "status": F.lit("done"),
        "detail": F.lit(""),
        "task": F.coalesce(F.nullif("task", F.lit("")), F.lit("detect")),
        "review_priority": F.lit(0.0),
        "detection_count": F.col("_n"),
        "width": F.col("_width"),
        "height": F.col("_height"),
    }
    return joined.withColumns(
        {c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items() if c in items.columns}
    ).select(*items.columns)


def import_baseline(items: DataFrame, matched: DataFrame, detections: DataFrame) -> DataFrame:
    """Items after importing into the baseline: only its size changes."""
    counts = detections.groupBy("image_id").agg(F.count("*").alias("_n"))
    update = winners(matched).join(counts, "image_id", "left").select(
        F.col("item_id").alias("_id"), F.coalesce("_n", F.lit(0)).alias("_n")
    )
    return (
        items.join(update, F.col("item_id") == F.col("_id"), "left")
        .withColumn("baseline_count", F.coalesce("_n", "baseline_count"))
        .select(*items.columns)
    )


def import_summary(
    matched: DataFrame, detections: DataFrame, current: DataFrame | None = None
) -> DataFrame:
    """Matched and unmatched images and the annotations written.

    With ``current`` the import appends, and every image counts its item's whole
    set at that moment: what was there, plus all images up to and including it.
    """
    counts = detections.groupBy("image_id").agg(F.count("*").alias("_n"))
    totals = matched.join(counts, "image_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    if current is None:
        weight = F.col("_n")
    else:
        found = row_numbers(hits(totals), ["item_id"], [F.col("ord")], "_at")
        images = found.groupBy("item_id").agg(F.count("*").alias("_images"))
        sizes = current.groupBy("item_id").agg(F.count("*").alias("_size"))
        joined = found.join(images, "item_id").join(sizes, "item_id", "left")
        # An image's detections are counted again by every later image of the item.
        totals = totals.filter(F.col("item_id").isNull()).select("item_id", F.lit(0).alias("_w"))
        totals = totals.unionByName(
            joined.select(
                "item_id",
                (
                    F.coalesce("_size", F.lit(0))
                    + F.col("_n") * (F.col("_images") - F.col("_at") + 1)
                ).alias("_w"),
            )
        )
        weight = F.col("_w")
    hit = F.col("item_id").isNotNull()
    return totals.agg(
        F.count_if(hit).alias("matched"),
        F.count_if(~hit).alias("unmatched"),
        F.coalesce(F.sum(F.when(hit, weight)), F.lit(0)).alias("annotations"),
    )
