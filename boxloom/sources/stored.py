"""Stored results: JSON text columns in, partitioned Parquet out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxloom.schema import DETECTION


def parse_detections(rows: DataFrame, *columns: str) -> DataFrame:
    """Turn JSON text columns into detection arrays; empty text is no detections."""
    schema = T.ArrayType(DETECTION)
    return rows.withColumns(
        {
            c: F.from_json(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("[]")), schema)
            for c in columns
        }
    )


def explode_detections(rows: DataFrame, column: str = "detections") -> DataFrame:
    """Nested detections as the long table the operators work on."""
    return rows.select("item_id", F.posexplode(column).alias("pos", "_d")).select(
        "item_id",
        F.col("pos").cast("bigint").alias("pos"),
        "_d.class_name",
        "_d.confidence",
        F.coalesce("_d.kind", F.lit("box")).alias("kind"),
        *[F.get("_d.box", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))],
        "_d.mask",
        "_d.keypoints",
        "_d.class_id",
        "_d.track_id",
    )


def write_table(df: DataFrame, root: str, name: str, by: tuple[str, ...] = ("project_id",)) -> None:
    """Overwrite only the partitions present in ``df``."""
    (
        df.write.mode("overwrite").partitionBy(*by)
        .option("partitionOverwriteMode", "dynamic")
        .parquet(f"{root}/{name}")
    )


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Older files may lack newer columns; those read as null."""
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}")
