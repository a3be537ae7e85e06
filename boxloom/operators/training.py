"""Building a detector training set from stored annotations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import corners, yolo_box
from boxloom.functions.numbers import clamp, py_round
from boxloom.functions.text import extension, folded_path, split_of, stem, yaml_quote
from boxloom.operators.naming import first_free_names
from boxloom.operators.ranking import row_numbers
from boxloom.schema import TRAINING_METRICS

SOURCES = ("current", "baseline")

#: Inclusive bounds of the training settings.
BOUNDS = {
    "epochs": (1, 1000),
    "imgsz": (32, 1280),
    "batch": (1, 128),
    "val_fraction": (0.05, 0.5),
    "min_conf": (0.0, 1.0),
    "iou": (0.05, 0.95),
    "confidence": (0.0, 1.0),
}
DEFAULTS = {"epochs": 40, "imgsz": 640, "batch": 16, "val_fraction": 0.2, "min_conf": 0.25}


def clamp_settings(raw: Mapping[str, object] | None = None) -> dict[str, object]:
    """One run's settings with every value pulled into its bounds."""
    raw = raw or {}
    out: dict[str, object] = {}
    for name, default in DEFAULTS.items():
        low, high = BOUNDS[name]
        value = type(default)(raw.get(name, default))
        out[name] = max(low, min(value, high))
    out["imgsz"] = max(32, round(out["imgsz"] / 32) * 32)
    source = str(raw.get("source", "current"))
    out["source"] = source if source in SOURCES else "current"
    return out


def clamp_columns(settings: DataFrame) -> DataFrame:
    """The same bounds applied to columns of a settings table."""
    changed = {}
    for name, (low, high) in BOUNDS.items():
        if name not in settings.columns:
            continue
        value = clamp(F.col(name), low, high)
        if name == "imgsz":
            value = F.greatest(F.lit(32), (F.rint(value / 32.0) * 32).cast("int")).cast("bigint")
        changed[name] = value
    return settings.withColumns(changed)


def source_set(sets: DataFrame, source: str) -> DataFrame:
    """One named annotation set; an unknown name means the current one."""
    return sets.filter(F.col("set_name") == (source if source in SOURCES else "current"))


def _usable(detections: DataFrame, min_conf: float) -> DataFrame:
    return detections.filter(F.coalesce("confidence", F.lit(1.0)) >= float(min_conf)).withColumn(
        "class_name", F.coalesce("class_name", F.lit("object"))
    )


def train_classes(
    items: DataFrame, detections: DataFrame, min_conf: float, base_names: Mapping[int, str]
) -> DataFrame:
    """``class_index, class_name``: the base model's classes, then new ones.

    Base names keep their id order; a new class follows in the order it first
    appears (path, then position) among the usable detections of done items.
    """
    known = list(dict.fromkeys(name for _, name in sorted(base_names.items())))
    done = items.filter(F.col("status") == "done").select("item_id", "rel_path")
    first = (
        _usable(detections, min_conf)
        .filter(~F.col("class_name").isin(known))
        .join(done, "item_id")
        .groupBy("class_name")
        .agg(F.min(F.struct("rel_path", "pos")).alias("_first"))
    )
    added = row_numbers(first, [], [F.col("_first"), F.col("class_name")], "_n").select(
        (F.col("_n") - 1 + len(known)).alias("class_index"), "class_name"
    )
    spark = items.sparkSession
    base = spark.createDataFrame(list(enumerate(known)), "class_index bigint, class_name string")
    return base.unionByName(added)


def yolo_lines(
    items: DataFrame, detections: DataFrame, classes: DataFrame, min_conf: float
) -> DataFrame:
    """One normalised label line per usable box of a done image with known size."""
    done = items.filter(
        (F.col("status") == "done") & (F.col("width") > 0) & (F.col("height") > 0)
    ).select("item_id", "rel_path", "width", "height")
    boxes = _usable(detections, min_conf).filter(F.col("x1").isNotNull())
    cx, cy, w, h = yolo_box(corners(), F.col("width"), F.col("height"))
    return (
        boxes.join(classes, "class_name")
        .join(done, "item_id")
        .withColumns({"cx": cx, "cy": cy, "bw": w, "bh": h})
        .filter((F.col("bw") > 0) & (F.col("bh") > 0))
        .select(
            "item_id", "rel_path", "pos", "class_name", "class_index",
            *[py_round(F.col(c), 6).alias(c) for c in ("cx", "cy", "bw", "bh")],
        )
    )


def line_text() -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", "class_index", "cx", "cy", "bw", "bh")


def labelled_items(lines: DataFrame) -> DataFrame:
    """Images with at least one usable line; images without any are left out."""
    return lines.groupBy("item_id", "rel_path").agg(F.count("*").alias("boxes"))


def unique_stems(images: DataFrame) -> DataFrame:
    """A file stem per image that no other image of the set uses.

    The plain stem if free, else the stem of the folded path, else that with the
    first free ``_n``; earlier paths choose first and case does not matter.
    """
    folded = stem(folded_path(F.regexp_replace("rel_path", r"\\", "__")))
    return first_free_names(
        images,
        plain=stem(F.col("rel_path")),
        folded=folded,
        mark="_",
        out="stem",
    )


def yolo_manifest(labelled: DataFrame, val_fraction: float) -> DataFrame:
    """Where each labelled image and its label file go."""
    named = unique_stems(labelled).withColumn("split", split_of(F.col("rel_path"), val_fraction))
    suffix = F.coalesce(F.nullif(extension(F.col("rel_path")), F.lit("")), F.lit("jpg"))
    return named.withColumns(
        {
            "image_file": F.concat(F.lit("images/"), "split", F.lit("/"), "stem", F.lit("."), suffix),
            "label_file": F.concat(F.lit("labels/"), "split", F.lit("/"), "stem", F.lit(".txt")),
        }
    )


def guarantee_val(manifest: DataFrame) -> DataFrame:
    """Make sure the validation side is not empty.

    With no validation image the last one by path moves there; a single image is
    put on both sides.
    """
    counts = manifest.agg(
        F.count("*").alias("images"),
        F.count_if(F.col("split") == "val").alias("val"),
        F.max("rel_path").alias("last"),
    ).first()
    if counts["images"] == 0:
        raise ValueError("nothing to train on: no labelled images")
    if counts["val"]:
        return manifest

    def moved(name: str) -> Column:
        return F.replace(F.col(name), F.lit("/train/"), F.lit("/val/"))

    chosen = F.col("rel_path") == counts["last"]
    copy = manifest.filter(chosen).withColumns(
        {"split": F.lit("val"), "image_file": moved("image_file"), "label_file": moved("label_file")}
    )
    keep = manifest if counts["images"] == 1 else manifest.filter(~chosen)
    return keep.unionByName(copy)


def dataset_summary(manifest: DataFrame, lines: DataFrame, candidates: DataFrame) -> DataFrame:
    """Totals of a built set; ``candidates`` are the done images it was built from.

    ``images`` counts labelled images; ``skipped_empty`` is the true number of
    done images that gave no usable line.
    """
    images = manifest.groupBy("item_id", "split").agg(F.count("*").alias("n")).select(
        F.lit("image").alias("part"), F.col("item_id").alias("item"), F.col("split").alias("name"), "n"
    )
    boxes = lines.groupBy("class_name").agg(F.count("*").alias("n")).select(
        F.lit("box").alias("part"), F.lit(None).alias("item"), F.col("class_name").alias("name"), "n"
    )
    total = candidates.agg(F.count("*").alias("n")).select(
        F.lit("total").alias("part"), F.lit(None).alias("item"), F.lit(None).alias("name"), "n"
    )
    part, zero = F.col("part"), F.lit(0).cast("bigint")

    def summed(which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col("n"))), zero)

    return images.unionByName(boxes).unionByName(total).agg(
        F.count_distinct("item").alias("images"),
        summed(part == "box").alias("boxes"),
        summed((part == "image") & (F.col("name") == "train")).alias("train"),
        summed((part == "image") & (F.col("name") == "val")).alias("val"),
        (summed(part == "total") - F.count_distinct("item")).alias("skipped_empty"),
        F.array_sort(F.collect_list(F.when(part == "box", F.col("name")))).alias("classes"),
    )


def write_labels(lines: DataFrame, manifest: DataFrame, path: str) -> None:
    """Label lines as text, one folder per split and stem.

    Lines of one image are sorted inside their partition, so a crowded image is
    written by several tasks instead of being gathered first.
    """
    placed = lines.join(manifest.select("item_id", "split", "stem"), "item_id")
    (
        placed.repartitionByRange(F.col("split"), F.col("stem"), F.col("pos"))
        .sortWithinPartitions("split", "stem", "pos")
        .select(line_text().alias("value"), "split", "stem")
        .write.mode("overwrite").partitionBy("split", "stem").text(path)
    )


def dataset_files(lines: DataFrame, manifest: DataFrame, root: str) -> DataFrame:
    """``path, part, content, source`` of a training set as a trainer reads it.

    Every label file of ``manifest`` holds the lines of its image by place, one row each,
    and every image file is a copy of its image below ``root``.
    """
    placed = lines.join(manifest.select("item_id", "label_file"), "item_id")
    labels = placed.select(
        F.col("label_file").alias("path"), F.col("pos").cast("bigint").alias("part"),
        F.concat(line_text(), F.lit("\n")).alias("content"), F.lit(None).cast("string").alias("source"),
    )
    images = manifest.select(
        F.col("image_file").alias("path"), F.lit(0).cast("bigint").alias("part"), F.lit(None).cast("string").alias("content"),
        F.concat(F.lit(f"{root.rstrip('/')}/"), "rel_path").alias("source"),
    )
    return labels.unionByName(images)


def data_yaml(classes: DataFrame, path: str) -> DataFrame:
    """Lines of the dataset descriptor, in order, as ``line_no, line``."""
    head = [f"path: {path}", "train: images/train", "val: images/val", "names:"]
    spark = classes.sparkSession
    fixed = spark.createDataFrame(list(enumerate(head)), "line_no bigint, line string")
    names = classes.select(
        (F.col("class_index") + len(head)).alias("line_no"),
        F.concat(
            F.lit("  "), F.col("class_index").cast("string"), F.lit(": "), yaml_quote(F.col("class_name"))
        ).alias("line"),
    )
    return fixed.unionByName(names).orderBy("line_no")


def train_metrics(metrics: DataFrame) -> DataFrame:
    """The four headline metrics of a run from its raw ``metrics`` map."""
    return metrics.select(
        *[c for c in metrics.columns if c != "metrics"],
        *[
            py_round(F.try_element_at("metrics", F.lit(key)), 4).alias(short)
            for short, key in TRAINING_METRICS.items()
        ],
    )
