"""Sources, sinks, scoring and streams."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from boxloom.operators import importing
from boxloom.plans.scoring import byte_scorer
from boxloom.sources import coco, folder, stored
from boxloom.streaming import live
from boxloom.streaming.scoring import result_columns, score, score_pending
from test_operators import track_one_by_one


@pytest.fixture
def images(tmp_path):
    root = tmp_path / "set"
    for name, data in {
        "a.jpg": b"1", "b.JPG": b"22", "notes.txt": b"x", "empty.png": b"", "sub/c d.png": b"333",
        ".git/x.jpg": b"1", "sub/node_modules/y.jpg": b"1", "sub/.cache/z.jpg": b"1",
        "_b.jpg": b"4444", "_kept/deep/d.webp": b"55555",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(root)


def test_folder_scan(spark, images):
    rows = folder.scan_images(spark, images).collect()
    assert [(r["rel_path"], r["size"]) for r in rows] == [
        ("_b.jpg", 4), ("_kept/deep/d.webp", 5), ("a.jpg", 1), ("b.JPG", 2), ("sub/c d.png", 3),
    ]
    assert folder.scan_images(spark, images, limit=2).count() == 2


def test_image_bytes_are_not_shuffled(spark, images):
    read = folder.read_image_bytes(spark, images)
    assert {r["rel_path"]: bytes(r["content"]) for r in read.collect()}["sub/c d.png"] == b"333"
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]


def test_coco_numbers_as_text_and_with_fractions(spark, tmp_path):
    document = {
        "images": [{"id": "7", "file_name": "a.jpg", "width": 640.0, "height": "480"}],
        "annotations": [{"id": 30, "image_id": 7.0, "bbox": [1, 2, 3, 4]}, {"id": "10", "image_id": "7", "bbox": [1, 2, 3, 5]}],
        "categories": [],
    }
    (tmp_path / "text.json").write_text(json.dumps(document))
    images, annotations, _ = coco.read_coco(spark, str(tmp_path / "text.json"))
    assert images.select("id", "width", "height").first()[:] == (7, 640, 480)
    assert sorted(r[:] for r in annotations.select("ord", "id", "image_id").collect()) == [(0, 30, 7), (1, 10, 7)]
    ordered = importing.to_detections(annotations, importing.clean_categories(_))
    assert [r["y2"] for r in ordered.orderBy("ann_ord").collect()] == [6.0, 7.0]  # document order, not ids
    document["images"][0]["id"] = "seven"
    (tmp_path / "odd.json").write_text(json.dumps(document))
    with pytest.raises(ValueError, match="number"):
        coco.read_coco(spark, str(tmp_path / "odd.json"))


def test_coco_files(spark, tmp_path):
    good = {"images": [{"id": 1, "file_name": "a.jpg"}], "annotations": [{"id": 3, "image_id": 1, "bbox": [1, 2, 3, 4]}]}
    (tmp_path / "good.json").write_text(json.dumps(good, indent=1))
    images, annotations, categories = coco.read_coco(spark, str(tmp_path / "good.json"))
    assert (images.count(), annotations.first()["bbox"], categories.count()) == (1, [1.0, 2.0, 3.0, 4.0], 0)
    coco.write_coco(images, annotations, categories, str(tmp_path / "out"))
    again = coco.read_coco(spark, str(tmp_path / "out"))
    assert (again[0].first()["file_name"], again[1].first()["bbox"]) == ("a.jpg", [1.0, 2.0, 3.0, 4.0])
    document = json.loads(spark.read.text(str(tmp_path / "out")).first()["value"])
    assert set(document) == {"info", "licenses", "images", "annotations", "categories"}
    for bad in ('{"nope": true}', "{not json"):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            coco.read_coco(spark, str(tmp_path / "bad.json"))


def test_stored_tables_replace_only_their_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1), ("q", 2)], "project_id string, n int")
    stored.write_table(rows, str(tmp_path), "items")
    stored.write_table(spark.createDataFrame([("p", 9)], "project_id string, n int"), str(tmp_path), "items")
    back = stored.read_table(spark, str(tmp_path), "items")
    assert {(r["project_id"], r["n"]) for r in back.collect()} == {("p", 9), ("q", 2)}


def test_stored_json(spark):
    rows = spark.createDataFrame(
        [(1, '[{"class_name":"car","box":[1,2,3,4],"keypoints":[[1,2,0.5]]},{"confidence":0.5}]'), (2, ""), (3, None)],
        "item_id bigint, detections string",
    )
    parsed = stored.parse_detections(rows, "detections")
    assert [len(r["detections"]) for r in parsed.orderBy("item_id").collect()] == [2, 0, 0]
    long = stored.explode_detections(parsed).orderBy("pos").collect()
    assert (long[0]["x2"], long[0]["kind"], long[1]["x1"], long[1]["confidence"]) == (3.0, "box", None, 0.5)


def test_scoring_keeps_bad_images_as_error_rows(spark):
    rows = [(n, b"x" * n, "too large" if n == 3 else None) for n in range(20)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "item_id bigint, content binary, error string")
    got = {r["item_id"]: r for r in result_columns(score(df, byte_scorer, batch=4)).collect()}
    assert len(got) == 21
    assert {k: v["detail"] for k, v in got.items() if v["status"] == "error"} == {
        0: "missing image data", 3: "too large", 7: "not a readable image", 14: "not a readable image", 99: "missing image data",
    }
    assert got[16]["detection_count"] == 1 and got[1]["review_priority"] == 1.0


def test_a_failing_scorer_fails_the_job(spark):
    def broken():
        def run(images, conf):
            raise RuntimeError("device lost")

        return run

    df = spark.createDataFrame([(1, b"x")], "item_id bigint, content binary")
    with pytest.raises(Exception, match="device lost"):
        score(df, broken).collect()


def test_finished_images_are_not_scored_again(spark):
    df = spark.createDataFrame([(n, b"x" * 9) for n in range(4)], "item_id bigint, content binary")
    done = df.filter("item_id < 3").select("item_id")
    assert [r["item_id"] for r in score_pending(df, done, byte_scorer).collect()] == [3]


def test_stream_survives_bad_frames_and_resumes(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def send(name, *messages):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(messages))

    def drain():
        raw = spark.readStream.text(source)
        frames = live.score_stream(live.parse_messages(raw), byte_scorer)
        live.write_stream(frames.select("clip", "idx", "status", "detail", "detection_count"), out, progress, once=True).awaitTermination()
        return spark.read.parquet(out)

    image = base64.b64encode(b"x" * 40).decode()
    send("1", json.dumps({"clip": "a", "idx": 0, "image": image, "conf": 0.1}), "{broken", json.dumps({"clip": "a", "idx": 1, "image": "%%"}))
    first = drain()
    assert sorted(r["detail"] for r in first.collect()) == ["", "expected a JSON object", "malformed base64 data"]
    send("2", json.dumps({"clip": "a", "idx": 2, "image": image, "conf": 0.9}))
    rows = drain().collect()
    assert len(rows) == 4
    assert {r["idx"]: r["detection_count"] for r in rows if r["status"] == "done"} == {0: 1, 2: 0}


def test_tracking_on_a_stream_carries_state_between_batches(spark, tmp_path):
    rows = []
    for idx in range(8):
        for pos in range(2):
            x = float(pos * 100 + idx * 4)
            rows.append(("a", idx, pos, "car", x, 0.0, x + 20, 20.0))
    schema = "clip string, idx bigint, pos bigint, class_name string, x1 double, y1 double, x2 double, y2 double"
    frame = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("idx") + 1_700_000_000))
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for low in (0, 4):
        frame.filter(F.col("idx").between(low, low + 3)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame.schema).parquet(source)
        live.write_stream(live.track_stream(stream), out, progress, once=True).awaitTermination()
    got = {(r["idx"], r["pos"]): r["track_id"] for r in spark.read.parquet(out).collect()}
    assert got == track_one_by_one(rows, 0.3)
    assert set(got.values()) == {1, 2}


def test_tracking_of_a_stream_out_of_order(spark, tmp_path):
    """Frames within the slack are followed in order, later ones are marked."""
    rows = [("a", idx, pos, "car", x := float(pos * 100 + idx * 4), 0.0, x + 20, 20.0) for idx in range(12) for pos in range(2)]
    schema = "clip string, idx bigint, pos bigint, class_name string, x1 double, y1 double, x2 double, y2 double"
    frame = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("idx") + 1_700_000_000))
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    session = live.stateful(spark, 2)
    batches = [(1, 3, 0), (2, 5, 6, 4), (11, 9, 8), (10, 7)]
    for batch in batches:
        frame.filter(F.col("idx").isin(*batch)).write.mode("append").parquet(source)
        stream = session.readStream.schema(frame.schema).parquet(source)
        tracked = live.track_stream(stream, slack="3 seconds")
        live.write_stream(tracked, out, progress, once=True).awaitTermination()
    end = frame.limit(1).select(*[F.lit(None).cast(x.dataType).alias(x.name) for x in frame.schema[:-1]], F.timestamp_seconds(F.lit(1 << 32)).alias("ts"))
    end.write.mode("append").parquet(source)
    live.write_stream(live.track_stream(session.readStream.schema(frame.schema).parquet(source), slack="3 seconds"), out, progress, once=True).awaitTermination()
    found = spark.read.parquet(out).collect()
    assert {r["idx"] for r in found if r["late"]} == {7} and all(r["track_id"] is None for r in found if r["late"])
    got = {(r["idx"], r["pos"]): r["track_id"] for r in found if not r["late"]}
    assert got == track_one_by_one([r for r in rows if r[1] != 7], 0.3) and len(found) == 24


def test_tracking_state_is_one_value_and_rows_come_packed(spark, tmp_path):
    """Odd names and missing corners survive; a clip's timer moves with its frames."""
    names = ["a b", None, "", "+x -"]
    rows = [("a", idx, pos, names[pos], 0.1 + pos * 100 + idx / 3, 0.0, 20.7 + pos * 100 + idx / 3, 20.0) for idx in range(6) for pos in range(4)]
    rows += [("a", idx, 4, "none", None, 0.0, None, 20.0) for idx in range(6)]
    schema = "clip string, idx bigint, pos bigint, class_name string, x1 double, y1 double, x2 double, y2 double"
    frame = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("idx") + 1_700_000_000))
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    session = live.stateful(spark, 2)
    for batch in ((0, 2, 1), (3, 5, 4)):
        frame.filter(F.col("idx").isin(*batch)).write.mode("append").parquet(source)
        tracked = live.track_stream(session.readStream.schema(frame.schema).parquet(source), slack="3 seconds")
        assert tracked.columns == ["clip", "idx", "pos", "class_name", "track_id", "late"]
        live.write_stream(tracked, out, progress, once=True).awaitTermination()
    end = frame.limit(1).select(*[F.lit(None).cast(x.dataType).alias(x.name) for x in frame.schema[:-1]], F.timestamp_seconds(F.lit(1 << 32)).alias("ts"))
    end.write.mode("append").parquet(source)
    live.write_stream(live.track_stream(session.readStream.schema(frame.schema).parquet(source), slack="3 seconds"), out, progress, once=True).awaitTermination()
    found = spark.read.parquet(out).collect()
    assert {(r["idx"], r["pos"]): r["class_name"] for r in found} == {(r[1], r[2]): r[3] for r in rows} and len(found) == len(rows)
    ids = {p: [r["track_id"] for r in found if r["pos"] == p] for p in range(5)}
    assert all(len(set(ids[p])) == 1 for p in range(4)) and len(set(ids[4])) == 6 and not any(r["late"] for r in found)
    assert "waiting" in live.CLIP
