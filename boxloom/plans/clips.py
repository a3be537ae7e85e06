"""Frame sampling and tracking."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.operators import frames
from boxloom.plans.fixtures import Inputs
from boxloom.plans.registry import query
from boxloom.session import shared_folder
from boxloom.streaming import live
from boxloom.streaming.upsert import ResultStore, upsert_stream

CAP = 30


@query(
    "frame_sample",
    """WITH p AS (SELECT *, least(total, 30) AS planned FROM frames)
SELECT clip, event_id, idx, total, planned, k AS out_idx
FROM (SELECT p.*, (idx * planned + total - 1) // total AS k FROM p) WHERE k * total // planned = idx AND k < planned""",
    "frames",
)
def frame_sample(f: Inputs) -> DataFrame:
    return frames.sample_frames(f.frames(), CAP).select(
        "clip", "event_id", "idx", "total", "planned", "out_idx"
    )


@query(
    "clip_rate",
    """SELECT user_id AS clip, count(*) AS total, least(count(*), 30) AS planned,
       CASE WHEN user_id % 3 = 0 THEN 25e0 ELSE 24e0 + user_id % 3 END * least(count(*), 30) / count(*) AS output_fps
FROM events GROUP BY user_id""",
)
def clip_rate(f: Inputs) -> DataFrame:
    clip = F.col("user_id")
    fps = F.when(clip % 3 == 0, F.when(clip % 2 == 0, 0.0)).otherwise(24.0 + clip % 3)
    clips = f.table("events").groupBy(clip.alias("clip")).agg(F.count("*").alias("total"))
    rated = clips.join(f.table("events").select(clip.alias("clip"), fps.alias("fps")).distinct(), "clip")
    return frames.clip_rate(rated, CAP).select("clip", "total", "planned", "output_fps")


def objects(f: Inputs) -> DataFrame:
    """Three drifting objects per frame, one of them blinking."""
    rows = f.frames(totals=False).select(
        "clip", "idx", F.col("event_id").alias("e"),
        F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("pos"),
    )
    pos, idx = F.col("pos"), F.col("idx")
    left = (pos * 40 + idx * 3 % 200 + F.col("e") % 4).cast("double")
    return rows.filter((pos != 2) | (idx % 5 != 4)).select(
        "clip", "idx", "pos", F.concat(F.lit("k"), (pos % 2).cast("string")).alias("class_name"),
        left.alias("x1"), F.lit(10.0).alias("y1"), (left + 30).alias("x2"), F.lit(40.0).alias("y2"),
    )


@query(
    "track_objects",
    """SELECT c.clip, c.idx, c.pos, concat('k', c.pos % 2) AS class_name,
       dense_rank() OVER (PARTITION BY c.clip ORDER BY start_idx, start_pos) AS track_id FROM chains c""",
    "chains",
)
def track_objects(f: Inputs) -> DataFrame:
    return frames.track_objects(objects(f), largest=3).select("clip", "idx", "pos", "class_name", "track_id")


#: Frames of a clip that a micro-batch of the query brings, and how far they are out of order.
STEP, JITTER = 40, 8
#: When the first frame is taken; a time of zero would lie below the first watermark.
START = 1_700_000_000


@query(
    "track_stream",
    """SELECT c.clip, c.idx, c.pos, concat('k', c.pos % 2) AS class_name,
       dense_rank() OVER (PARTITION BY c.clip ORDER BY start_idx, start_pos) AS track_id, false AS late FROM chains c""",
    "chains",
)
def track_stream(f: Inputs) -> DataFrame:
    """The frames of all clips arrive out of order in micro-batches, and a last message says
    that none will follow."""
    folder = f"{shared_folder(f.spark)}/frames-{uuid.uuid4().hex}"
    jitter = F.pmod(F.xxhash64("clip", "idx"), F.lit(JITTER))
    rows = objects(f).withColumn("ts", F.timestamp_seconds(F.col("idx") + START)).withColumn("step", F.floor((F.col("idx") + jitter) / STEP))
    rows.write.partitionBy("step").parquet(f"{folder}/kept")
    kept = f.spark.read.schema(rows.schema).parquet(f"{folder}/kept")
    last = kept.agg(F.max("step")).first()[0] or 0
    message = [F.lit(None).cast(x.dataType).alias(x.name) for x in rows.drop("step").schema if x.name != "ts"]
    end = f.spark.range(1).select(*message, F.timestamp_seconds(F.lit(1 << 32)).alias("ts"))
    session = live.stateful(f.spark, max(4, f.spark.sparkContext.defaultParallelism))
    source, out, progress = f"{folder}/source", f"{folder}/rows", f"{folder}/progress"
    end.limit(0).write.parquet(source)
    stream = session.readStream.schema(rows.drop("step").schema).parquet(source)
    tracked = live.track_stream(stream, slack=f"{JITTER} seconds")
    running = live.write_stream(tracked, out, progress)
    try:
        for step in range(last + 1):
            kept.filter(F.col("step") == step).drop("step").write.mode("append").parquet(source)
            running.processAllAvailable()
        end.write.mode("append").parquet(source)
        running.processAllAvailable()
    finally:
        running.stop()
    return f.spark.read.schema(tracked.schema).parquet(out)


RESULT = "clip bigint, idx bigint, status string, detection_count bigint"
FRAMES = """SELECT clip, idx, CASE WHEN idx % 11 = 5 AND idx % 3 <> 0 THEN 'error' ELSE 'done' END AS status,
       CAST(CASE WHEN idx % 11 = 5 AND idx % 3 <> 0 THEN 0 WHEN idx % 5 = 4 THEN 2 ELSE 3 END AS BIGINT) AS detection_count FROM frames"""


def interrupted(f: Inputs) -> ResultStore:
    """Results of all frames from a stream that is stopped and started again; frames that
    failed at first and can be read later come a second time."""
    folder = f"{shared_folder(f.spark)}/results-{uuid.uuid4().hex}"
    idx = F.col("idx")
    fails = idx % 11 == 5
    found = f.frames().select(
        "clip", "idx", F.when(fails, "error").otherwise("done").alias("status"),
        F.when(fails, 0).when(idx % 5 == 4, 2).otherwise(3).cast("bigint").alias("detection_count"),
    )
    again = found.filter(fails & (idx % 3 == 0)).select(
        "clip", "idx", F.lit("done").alias("status"), F.when(idx % 5 == 4, 2).otherwise(3).cast("bigint").alias("detection_count")
    )
    store = ResultStore(f"{folder}/store")
    for rows in (found.filter(idx % 2 == 0), found.filter(idx % 2 == 1), again):
        rows.write.mode("append").parquet(f"{folder}/frames")
        stream = f.spark.readStream.schema(RESULT).parquet(f"{folder}/frames")
        upsert_stream(stream, store, f"{folder}/progress", once=True).awaitTermination()
    return store


@query("stream_restart", FRAMES, "frames")
def stream_restart(f: Inputs) -> DataFrame:
    """Every frame once, with its last result."""
    return interrupted(f).latest(f.spark, RESULT, ["clip", "idx"])


@query(
    "stream_progress",
    """SELECT CAST(count(*) FILTER (idx % 11 <> 5) + count(*) FILTER (idx % 11 = 5 AND idx % 3 = 0) AS BIGINT) AS processed,
       CAST(count(*) FILTER (idx % 11 = 5) AS BIGINT) AS failed,
       CAST(count(*) + count(*) FILTER (idx % 11 = 5 AND idx % 3 = 0) AS BIGINT) AS total FROM frames""",
    "frames",
)
def stream_progress(f: Inputs) -> DataFrame:
    """What was observed while the batches were saved."""
    return interrupted(f).ledger(f.spark).agg(*[F.sum(c).alias(c) for c in ("processed", "failed", "total")])
