"""Writing annotations out: COCO, COCO keypoints and ImageNet folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions.geometry import flat_rounded, keypoint_visibility
from boxloom.functions.numbers import py_round
from boxloom.functions.text import folder_label
from boxloom.operators.lifecycle import existing_files
from boxloom.operators.naming import unique_names
from boxloom.operators.ranking import row_numbers
from boxloom.operators.review import class_counts, visible
from boxloom.schema import FORMAT_LABELS, FORMATS_BY_TASK
from boxloom.session import durable, hot_group_rows


def formats_for(task: str) -> dict[str, str]:
    """The export offered for a task, as ``{id: label}``."""
    name = FORMATS_BY_TASK.get(task, FORMATS_BY_TASK["detect"])
    return {name: FORMAT_LABELS[name]}


def class_index(detections: DataFrame, model_names: Sequence[str]) -> DataFrame:
    """``class_name, class_index``: the model's order, then others by frequency."""
    known: dict[str, int] = {}
    for position, name in enumerate(model_names):
        known.setdefault(str(name), position)
    others = class_counts(detections).filter(~F.col("class_name").isin(list(known)))
    ranked = row_numbers(others, [], [-F.col("count"), F.col("class_name")], "_n")
    base = detections.sparkSession.createDataFrame(
        list(known.items()), "class_name string, class_index bigint"
    )
    return base.unionByName(
        ranked.select("class_name", (F.col("_n") - 1 + len(known)).alias("class_index"))
    )


def numbered_images(items: DataFrame) -> DataFrame:
    """Done items with archive name and image id.

    Ids count all done items in path order, so a file that is gone leaves a gap.
    """
    done = items.filter(F.col("status") == "done").select("item_id", "rel_path", "width", "height")
    numbered = row_numbers(done, [], [F.col("rel_path")], "image_id", stored=True)
    return unique_names(numbered)


def coco_images(numbered: DataFrame, listing: DataFrame) -> DataFrame:
    return existing_files(numbered, listing).select(
        F.col("image_id").alias("id"), F.col("archive_name").alias("file_name"),
        "width", "height", "item_id", "rel_path",
    )


def coco_annotations(
    images: DataFrame, detections: DataFrame, classes: DataFrame, threshold: float
) -> DataFrame:
    """COCO annotation rows with dense ids in image then stored order."""
    # ids and counts both need the images' numbers, which are costly to derive twice
    numbers = durable(images.select("item_id", "id"))
    return _numbered(annotation_rows(numbers, detections, classes, threshold))


#: Images whose annotations are numbered together.
_IMAGES = 1024


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``id`` by image, then place: a range of images starts where those before it end.

    Rows are derived twice, the first time only to be counted; none are stored. Where a
    range is too large for one task, rows are numbered by ranges of themselves.
    """
    bucket = F.expr(f"image_id div {_IMAGES}")
    sizes = durable(rows.groupBy(bucket.alias("_range")).agg(F.count("*").alias("_size")))
    largest = sizes.agg(F.coalesce(F.max("_size"), F.lit(0))).first()[0]
    if largest > hot_group_rows(rows.sparkSession):
        return row_numbers(rows, [], [F.col("image_id"), F.col("pos")], "id")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bucket").orderBy("image_id", "pos")
    placed = rows.withColumn("_bucket", bucket).withColumn("_n", F.row_number().over(inside))
    return placed.join(starts, F.col("_bucket") == F.col("_range")).select(
        *rows.columns, (F.col("_n") + F.col("_start")).cast("bigint").alias("id")
    )


def annotation_rows(
    images: DataFrame, detections: DataFrame, classes: DataFrame, threshold: float
) -> DataFrame:
    """COCO annotation rows without ids."""
    box = visible(detections, threshold).filter(F.col("x1").isNotNull())
    indexed = box.withColumn("_class", F.coalesce("class_name", F.lit("?"))).join(
        classes.select(F.col("class_name").alias("_class"), "class_index"), "_class", "left"
    )
    placed = indexed.join(images.select("item_id", F.col("id").alias("image_id")), "item_id")
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    nothing = F.lit(None).cast("array<array<double>>")
    mask = F.col("mask") if "mask" in detections.columns else nothing
    keys = F.col("keypoints") if "keypoints" in detections.columns else nothing
    return placed.select(
        "image_id",
        "pos",
        (F.coalesce("class_index", F.lit(0)) + 1).alias("category_id"),
        F.array(
            py_round(F.col("x1"), 2), py_round(F.col("y1"), 2), py_round(width, 2), py_round(height, 2)
        ).alias("bbox"),
        py_round(width * height, 2).alias("area"),
        F.lit(0).alias("iscrowd"),
        F.when(F.array_size(mask) > 0, F.array(flat_rounded(mask)))
        .otherwise(F.array().cast("array<array<double>>"))
        .alias("segmentation"),
        coco_keypoints(keys).alias("keypoints"),
        F.coalesce(
            F.array_size(F.filter(keys, lambda p: keypoint_visibility(p) > 0)), F.lit(0)
        ).alias("num_keypoints"),
    )


def coco_keypoints(keypoints: Column) -> Column:
    """Flat ``x, y, visibility`` triples."""
    triples = F.transform(
        keypoints,
        lambda p: F.array(
            py_round(F.get(p, F.lit(0)), 2), py_round(F.get(p, F.lit(1)), 2), keypoint_visibility(p)
        ),
    )
    return F.coalesce(F.flatten(triples), F.array().cast("array<double>"))


def keypoint_count(items: DataFrame, detections: DataFrame) -> DataFrame:
    """The largest number of keypoints on any detection of a done item, 0 without any."""
    done = items.filter(F.col("status") == "done").select("item_id")
    return detections.join(done, "item_id", "left_semi").agg(F.coalesce(F.max(F.array_size("keypoints")), F.lit(0)).alias("keypoint_count"))


def coco_categories(classes: DataFrame, keypoints: int | None = None) -> DataFrame:
    """1-based categories in index order; keypoint exports name their points."""
    rows = classes.select(
        (F.col("class_index") + 1).alias("id"), F.col("class_name").alias("name"),
        F.lit("").alias("supercategory"),
    )
    if keypoints is not None:
        names = F.array(*[F.lit(f"kp{i}") for i in range(keypoints)]).cast("array<string>")
        rows = rows.withColumns({"keypoints": names, "skeleton": F.array().cast("array<string>")})
    return rows.orderBy("id")


def top1_label(items: DataFrame, detections: DataFrame, threshold: float) -> DataFrame:
    """The first visible detection in stored order names the image."""
    first = visible(detections, threshold).groupBy("item_id").agg(
        F.min_by("class_name", "pos").alias("_label")
    )
    return items.join(first, "item_id", "left").select(
        *items.columns, F.coalesce("_label", F.lit("unknown")).alias("label")
    )


def imagenet_manifest(numbered: DataFrame, listing: DataFrame, detections: DataFrame, threshold: float):
    """Source and destination of each image of a folder-per-class export."""
    labelled = top1_label(existing_files(numbered, listing), detections, threshold)
    folder = folder_label(F.col("label"))
    return labelled.select(
        "item_id", F.col("rel_path").alias("source"),
        F.concat(folder, F.lit("/"), "archive_name").alias("destination"), folder.alias("folder"),
    )


def imagenet_files(manifest: DataFrame, root: str) -> DataFrame:
    """``path, source`` of the copies a folder-per-class export of ``root`` is made of."""
    return manifest.select(
        F.col("destination").alias("path"), F.concat(F.lit(f"{root.rstrip('/')}/"), "source").alias("source")
    )


def export_summary(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """How many images and annotations an export holds."""
    tagged = images.select(F.lit(True).alias("image")).unionByName(
        annotations.select(F.lit(False).alias("image"))
    )
    return tagged.agg(
        F.count_if("image").alias("images"), F.count_if(~F.col("image")).alias("annotations")
    )
