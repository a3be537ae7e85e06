"""Building the training set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions.text import hash_bucket, split_of
from boxloom.operators import training
from boxloom.plans.fixtures import Inputs
from boxloom.plans.registry import query

BASE = {1: "AF", 0: "NF", 7: "AF"}
MIN_CONF = 0.25


def classes(f: Inputs) -> DataFrame:
    return training.train_classes(f.items(), f.current(), MIN_CONF, BASE)


def lines(f: Inputs) -> DataFrame:
    return training.yolo_lines(f.items(), f.current(), classes(f), MIN_CONF)


def manifest(f: Inputs, val_fraction: float = 0.2) -> DataFrame:
    return training.yolo_manifest(training.labelled_items(lines(f)), val_fraction)


@query("train_classes", "SELECT class_index, class_name FROM train_names", "train_names")
def train_classes(f: Inputs) -> DataFrame:
    return classes(f)


@query(
    "yolo_lines",
    """SELECT item_id, pos, class_name, class_index, cx, cy, bw, bh,
       concat(class_index, ' ', printf('%.6f %.6f %.6f %.6f', cx, cy, bw, bh)) AS line FROM train_lines""",
    "train_lines",
)
def yolo_lines(f: Inputs) -> DataFrame:
    return lines(f).withColumn("line", training.line_text()).drop("rel_path")


@query("labelled_items", "SELECT item_id, rel_path, count(*) AS boxes FROM train_lines GROUP BY 1, 2", "train_lines")
def labelled_items(f: Inputs) -> DataFrame:
    return training.labelled_items(lines(f))


@query("unique_stems", "SELECT item_id, rel_path, stem FROM train_images", "train_images")
def unique_stems(f: Inputs) -> DataFrame:
    return training.unique_stems(training.labelled_items(lines(f))).drop("boxes")


@query(
    "hash_split",
    """SELECT item_id, concat('0x', substr(md5(rel_path), 1, 8))::BIGINT % 1000 AS bucket,
       CASE WHEN (concat('0x', substr(md5(rel_path), 1, 8))::BIGINT % 1000) / 1000e0 < 0.2e0 THEN 'val' ELSE 'train' END AS split FROM items""",
    "items",
)
def hash_split(f: Inputs) -> DataFrame:
    path = F.col("rel_path")
    return f.items().select("item_id", hash_bucket(path).alias("bucket"), split_of(path, 0.2).alias("split"))


@query("yolo_dataset", "SELECT item_id, rel_path, boxes, stem, split, image_file, label_file FROM train_images", "train_images")
def yolo_dataset(f: Inputs) -> DataFrame:
    return training.guarantee_val(manifest(f))


@query(
    "guarantee_val",
    """SELECT item_id, rel_path, stem, CASE WHEN rel_path = last THEN 'val' ELSE 'train' END AS split,
       concat('labels/', CASE WHEN rel_path = last THEN 'val' ELSE 'train' END, '/', stem, '.txt') AS label_file
FROM (SELECT *, max(rel_path) OVER () AS last FROM train_images)""",
    "train_images",
)
def guarantee_val(f: Inputs) -> DataFrame:
    return training.guarantee_val(manifest(f, 0.0)).select("item_id", "rel_path", "stem", "split", "label_file")


@query(
    "dataset_summary",
    """SELECT count(*) AS images, (SELECT count(*) FROM train_lines) AS boxes, count(*) FILTER (split = 'train') AS train,
       count(*) FILTER (split = 'val') AS val, (SELECT count(*) FROM items WHERE status = 'done') - count(*) AS skipped_empty,
       (SELECT string_agg(DISTINCT class_name, ',' ORDER BY class_name) FROM train_lines) AS classes FROM train_images""",
    "train_images train_lines items",
)
def dataset_summary(f: Inputs) -> DataFrame:
    done = f.items().filter(F.col("status") == "done")
    return training.dataset_summary(training.guarantee_val(manifest(f)), lines(f), done).withColumn(
        "classes", F.array_join("classes", ",")
    )


@query(
    "data_yaml",
    """SELECT class_index + 4 AS line_no, concat('  ', class_index, ': "', class_name, '"') AS line FROM train_names
UNION ALL SELECT * FROM (VALUES (0::BIGINT, 'path: /data/set'), (1, 'train: images/train'), (2, 'val: images/val'), (3, 'names:')) v(line_no, line)""",
    "train_names",
)
def data_yaml(f: Inputs) -> DataFrame:
    return training.data_yaml(classes(f), "/data/set")


@query(
    "train_metrics",
    """SELECT p_partkey, CAST(printf('%.4f', p_retailprice / 1024) AS DOUBLE) AS map50, CASE WHEN p_size % 3 <> 0 THEN CAST(printf('%.4f', p_size / 7e0) AS DOUBLE) END AS map,
       CAST(NULL AS DOUBLE) AS "precision", CAST(printf('%.4f', p_size / 3e0) AS DOUBLE) AS recall FROM part""",
)
def train_metrics(f: Inputs) -> DataFrame:
    size = F.col("p_size")
    raw = F.create_map(
        F.lit("metrics/mAP50(B)"), F.col("p_retailprice") / 1024,
        F.when(size % 3 != 0, "metrics/mAP50-95(B)").otherwise("other"), size / F.lit(7.0),
        F.lit("metrics/recall(B)"), size / F.lit(3.0),
    )
    return training.train_metrics(f.table("part").select("p_partkey", raw.alias("metrics")))
