"""Structured Streaming jobs: live frame scoring and live tracking."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructField, StructType

from boxloom.functions.geometry import CORNERS
from boxloom.functions.numbers import clamp
from boxloom.functions.text import payload_bytes, payload_error
from boxloom.streaming.scoring import Scorer, result_columns, score

#: A frame message: who sent it, its place, the image payload and the threshold.
MESSAGE = "clip string, idx bigint, image string, conf double"
MAX_FRAME_BYTES = 16 * 2**20


def parse_messages(raw: DataFrame, max_bytes: int = MAX_FRAME_BYTES) -> DataFrame:
    """JSON frame messages in ``value``; a bad one carries its error and survives."""
    message = F.from_json("value", MESSAGE)
    parsed = raw.select(F.col("value").cast("string").alias("value")).withColumn("m", message)
    payload = F.col("m.image")
    malformed = F.col("m").isNull() | F.try_parse_json("value").isNull()
    return parsed.select(
        "m.clip",
        "m.idx",
        clamp(F.coalesce("m.conf", F.lit(0.5)), 0.0, 1.0).alias("conf"),
        payload_bytes(payload).alias("content"),
        F.when(malformed, "expected a JSON object").otherwise(payload_error(payload, max_bytes)).alias("error"),
    )


def score_stream(frames: DataFrame, factory: Callable[[], Scorer]) -> DataFrame:
    """Score parsed frames; detections below a frame's own threshold are dropped."""
    scored = result_columns(score(frames, factory, conf=0.0))
    kept = F.filter("detections", lambda d: d["confidence"] >= F.col("conf"))
    return scored.withColumn("detections", kept).withColumn(
        "detection_count", F.coalesce(F.array_size("detections"), F.lit(0))
    )


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append results to Parquet; the checkpoint makes a restart continue, not repeat."""
    writer = (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


TRACKED = "idx bigint, pos bigint, class_name string, track_id bigint, late boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "idx bigint, next_id bigint, boxes array<struct<track_id:bigint,class_name:string,x1:double,y1:double,x2:double,y2:double>>"


def _iou(a, b) -> float:
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def _follow(last: list, frame: list, threshold: float, next_id: int):
    """Give a frame's boxes the ids of the boxes they continue, or new ones."""
    edges = sorted(
        (-value, i, j)
        for i, a in enumerate(last)
        for j, b in enumerate(frame)
        if a[1] == b[1] and (value := _iou(a[2:], b[2:])) >= threshold
    )
    ids: dict[int, int] = {}
    used: set[int] = set()
    for _, i, j in edges:
        if i not in used and j not in ids:
            used.add(i)
            ids[j] = last[i][0]
    out = []
    for j, b in enumerate(frame):
        if j not in ids:
            ids[j], next_id = next_id, next_id + 1
        out.append((ids[j], *b[1:]))
    return out, next_id


#: One clip: the last frame that was followed, the next free id and the boxes of that frame,
#: the time of the youngest frame, and the detections of frames that wait for their turn.
CLIP = f"{STATE}, youngest bigint, waiting array<struct<idx:bigint,pos:bigint,class_name:string,x1:double,y1:double,x2:double,y2:double,ms:bigint>>"


class _Follower(StatefulProcessor):
    """The buffer of one clip: the last frame that was followed with the next free id, and
    detections of frames that are not due. It is one value, read and written once a batch.

    A frame is due once the clip has a frame that is ``slack`` younger, or once the
    watermark has passed the clip's youngest frame; the timer set for that also ends the
    clip. A clip has one timer; where younger frames came since, it is set anew when it is
    due. Due frames are followed by rising number. A frame that comes when a younger one
    has been followed is late: it is passed on without an id and changes nothing.
    """

    def __init__(self, threshold: float, slack: int) -> None:
        self.threshold, self.slack = threshold, slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clip = handle.getValueState("clip", CLIP)

    def _follow(self, clip: Any, last: tuple[int, int, list], rows: list[tuple]) -> tuple[tuple[int, int, list], list[Row]]:
        """Ids for the detections of due frames, and the last of these."""
        last_idx, next_id, boxes = last
        out = []
        for idx, frame in groupby(sorted(rows, key=lambda r: r[:2]), key=lambda r: r[0]):
            frame = list(frame)
            boxes, next_id = _follow(boxes if idx == last_idx + 1 else [], [(0, *r[2:7]) for r in frame], self.threshold, next_id)
            last_idx = idx
            out += [_row(clip, idx, r[1], b[1], b[0], False) for r, b in zip(frame, boxes, strict=True)]
        return (last_idx, next_id, boxes), out

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        came = [_unpacked(r.packed) for r in rows if r.packed is not None]
        if not came:
            return
        youngest = max(r[7] for r in came)
        known = self.clip.get()
        if known is None:
            last, rest = (-1, 1, []), []
            self.handle.registerTimer(youngest)
        else:
            last, rest = (known[0], known[1], [tuple(b) for b in known[2]]), [tuple(r) for r in known[4]]
            youngest = max(youngest, known[3])
        late = [_row(key[0], r[0], r[1], r[2], None, True) for r in came if r[0] <= last[0]]
        rest += [r for r in came if r[0] > last[0]]
        due = [r for r in rest if r[7] <= youngest - self.slack]
        rest = [r for r in rest if r[7] > youngest - self.slack]
        out = []
        if due:
            last, out = self._follow(key[0], last, due)
        self.clip.update((*last, youngest, rest))
        yield from late + out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        idx, next_id, boxes, youngest, rest = self.clip.get()
        if youngest > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(youngest)
            return
        self.clip.clear()
        yield from self._follow(key[0], (idx, next_id, [tuple(b) for b in boxes]), [tuple(r) for r in rest])[1]

    def close(self) -> None:
        pass


def _packed() -> Column:
    """A detection as one text: a worker takes rows over cell by cell. Null without ``idx``,
    and a corner that is null is no number."""
    corners = [F.coalesce(F.col(c).cast("double"), F.lit(math.nan)) for c in CORNERS]
    name = F.coalesce(F.concat(F.lit("+"), "class_name"), F.lit("-"))
    parts = [F.col("idx"), F.coalesce(F.col("pos").cast("string"), F.lit("null")), *corners, F.unix_millis("ts"), name]
    return F.when(F.col("idx").isNotNull(), F.concat_ws(" ", *[p.cast("string") for p in parts]))


def _unpacked(text: str) -> tuple:
    idx, pos, x1, y1, x2, y2, ms, name = text.split(" ", 7)
    return int(idx), int(pos), name[1:] if name[0] == "+" else None, float(x1), float(y1), float(x2), float(y2), int(ms)


_row = Row("clip", "idx", "pos", "class_name", "track_id", "late")


def stateful(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session beside ``spark`` with the state store that the clips' state and timers need."""
    own = spark.newSession()
    own.conf.set(_PROVIDER, _ROCKS)
    if partitions is not None:
        own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return own


def track_stream(
    detections: DataFrame, threshold: float = 0.3, forget: str = "10 minutes", slack: str = "0 seconds"
) -> DataFrame:
    """Follow objects on a stream of ``clip, idx, pos, class_name, x1..y2, ts``.

    Returns ``clip, idx, pos, class_name, track_id, late``. Frames of a clip may come in any
    order within ``slack``: each clip holds back the frames of its last ``slack`` and follows
    the older ones by number, so the ids are those of :func:`~boxloom.operators.frames.track_objects`.
    A frame that comes later than that is marked late and gets no id. A clip's state ends
    when the watermark (the youngest frame of all clips less ``forget``) passes its last
    frame, which also settles the frames held back; ``forget`` has to be at least
    ``slack``. Frames beyond the watermark are dropped by Spark, and a clip that speaks
    again after that starts anew. A row without ``idx`` only moves the watermark on, as a
    closed source does with a last message. The state and its timers need the RocksDB state
    store, which the stream's session is set to; :func:`stateful` gives one of its own.
    """
    wait = pd.Timedelta(slack)
    if wait > pd.Timedelta(forget):
        raise ValueError("forget has to be at least slack")
    detections.sparkSession.conf.set(_PROVIDER, _ROCKS)
    return (
        detections.select("clip", _packed().alias("packed"), "ts").withWatermark("ts", forget)
        .groupBy("clip")
        .transformWithState(_Follower(threshold, int(wait.total_seconds() * 1000)), _tracked(detections), "Append", "EventTime")
    )


def _tracked(detections: DataFrame) -> StructType:
    return StructType([StructField("clip", detections.schema["clip"].dataType), *StructType.fromDDL(TRACKED).fields])
