"""Scoring through the scorer contract, as a batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.plans.fixtures import Inputs
from boxloom.plans.registry import query
from boxloom.session import shared_folder
from boxloom.streaming.live import parse_messages, score_stream, write_stream
from boxloom.streaming.scoring import UnreadableImage, result_columns, score


def byte_scorer():
    """A deterministic scorer: what it finds depends on the number of bytes only."""

    def run(images, conf):
        out = []
        for image in images:
            size = len(image)
            if size % 7 == 0:
                raise UnreadableImage("not a readable image")
            confidence = (size % 64) / 64.0
            found = [{"class_name": "car", "confidence": confidence, "kind": "box", "class_id": 0,
                      "box": [1.0, 2.0, 3.0, 4.0]}]
            out.append({
                "task": "detect", "device": "cpu", "width": size % 640 + 1, "height": 10,
                "inference_ms": size / 8.0,
                "detections": found if confidence >= conf else [],
            })
        return out

    return run


SCORED = """SELECT page_id AS item_id, CASE WHEN n % 7 = 0 THEN 'error' ELSE 'done' END AS status,
  CASE WHEN n = 0 THEN 'missing image data' WHEN n % 7 = 0 THEN 'not a readable image' ELSE '' END AS detail,
  CASE WHEN n % 7 <> 0 THEN 'detect' END AS task, CAST(CASE WHEN n % 7 <> 0 THEN n % 640 + 1 END AS INTEGER) AS width,
  CASE WHEN n % 7 <> 0 THEN n / 8e0 END AS inference_ms,
  CASE WHEN n % 7 <> 0 THEN CASE WHEN (n % 64) / 64e0 >= 0.05e0 THEN 1e0 - abs((n % 64) / 64e0 - 0.5e0) / 0.5e0 ELSE 1e0 END END AS review_priority,
  CAST(CASE WHEN n % 7 <> 0 AND (n % 64) / 64e0 >= 0.05e0 THEN 1 ELSE 0 END AS INTEGER) AS detection_count
FROM (SELECT page_id, strlen(html) AS n FROM pages)"""


@query("score_images", SCORED)
def score_images(f: Inputs) -> DataFrame:
    images = f.table("pages").select(
        F.col("page_id").alias("item_id"), F.col("html").cast("binary").alias("content")
    )
    return result_columns(score(images, byte_scorer)).select(
        "item_id", "status", "detail", "task", "width", "inference_ms", "review_priority", "detection_count"
    )


@query(
    "stream_score",
    """SELECT concat('u', page_id % 5) AS clip, page_id AS idx,
  CASE WHEN page_id % 9 = 0 OR n % 7 = 0 THEN 'error' ELSE 'done' END AS status,
  CASE WHEN page_id % 9 = 0 THEN 'malformed base64 data' WHEN n % 7 = 0 THEN 'not a readable image' ELSE '' END AS detail,
  CAST(CASE WHEN page_id % 9 <> 0 AND n % 7 <> 0 AND (n % 64) / 64e0 >= 0.25e0 THEN 1 ELSE 0 END AS INTEGER) AS detection_count
FROM (SELECT page_id, strlen(html) AS n FROM pages)""",
)
def stream_score(f: Inputs) -> DataFrame:
    pages = f.table("pages")
    # a stream's path has to be a folder unless it is a pattern; this one fits a table of one file and a folder of many
    stream = f.spark.readStream.schema(pages.schema).parquet(f"{f.sf_dir}/[p]ages.parquet")
    k = F.col("page_id")
    encoded = F.regexp_replace(F.base64(F.col("html").cast("binary")), r"\s", "")
    image = F.when(k % 9 == 0, F.lit("%%%")).otherwise(F.concat(F.lit("data:text/html;base64,"), encoded))
    message = F.struct(
        F.concat(F.lit("u"), (k % 5).cast("string")).alias("clip"), k.alias("idx"),
        image.alias("image"), F.lit(0.25).alias("conf"),
    )
    frames = parse_messages(stream.select(F.to_json(message).alias("value")))
    scored = score_stream(frames, byte_scorer).select("clip", "idx", "status", "detail", "detection_count")
    return _drain(f.spark, scored)


def _drain(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a stream over what is there and return the table it wrote."""
    target = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    running = write_stream(stream, f"{target}/rows", f"{target}/progress", once=True)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/rows")
