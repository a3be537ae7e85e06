"""Ranking, suppression, naming, frames and training against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from boxloom.operators import exporting, frames, importing, lifecycle, naming, review, tiling, training
from boxloom.operators.nms import merge_detections
from boxloom.operators.ranking import row_numbers
from test_matching import iou

BOXES = "item_id bigint, pos bigint, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("hot", [0, 1000])
@pytest.mark.parametrize("keys", [["k"], []])
def test_row_numbers(spark, limits, hot, keys):
    limits(hot=hot)
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "b", "b"]), n % 41, n) for n in range(700)]
    df = spark.createDataFrame(rows, "k string, a int, b int")
    got = row_numbers(df, keys, [F.col("a"), -F.col("b")], "n")
    assert dict(got.dtypes)["n"] == "bigint"
    want = {}
    groups = {}
    for k, a, b in sorted(rows, key=lambda r: (r[1], -r[2])):
        groups[k if keys else 0] = groups.get(k if keys else 0, 0) + 1
        want[b] = groups[k if keys else 0]
    assert {r["b"]: r["n"] for r in got.collect()} == want


def test_row_numbers_of_nothing(spark):
    df = spark.createDataFrame([], "a int")
    assert row_numbers(df, [], [F.col("a")], "n").collect() == []


def suppress(rows, t):
    kept = []
    for row in sorted(rows, key=lambda r: (-r[3], r[1])):
        if all(k[2] != row[2] or iou(k[4:], row[4:]) < t for k in kept):
            kept.append(row)
    return {(r[0], r[1]) for r in kept}


@pytest.mark.parametrize("nested", [256, 0])
@pytest.mark.parametrize("t", [0.5, 0.15])
def test_merge_equals_brute_force(spark, limits, nested, t):
    limits(nested=nested)
    rng = random.Random(f"{nested}{t}")
    rows = []
    for item in range(4):
        for pos in range(60):
            x, y, w = rng.randrange(50), rng.randrange(50), rng.choice([8, 9, 30])
            rows.append((item, pos, rng.choice("ab"), rng.randrange(9) / 8, x, y, x + w, y + w))
    rows += [(i, 99 + n, "a", 0.1, 0, 0, 8, 8) for i in range(4) for n in range(5)]
    # boxes without area, upside down and alike: each stays, as it overlaps with nothing
    rows += [(i, 200 + n, "a", 0.2, *box) for i in range(4) for n, box in enumerate([(5, 5, 5, 9), (5, 5, 5, 9), (9, 9, 3, 3), (9, 9, 3, 3)])]
    rows = [(*r[:3], *map(float, r[3:])) for r in rows]
    df = spark.createDataFrame(rows, BOXES)
    got = {(r["item_id"], r["pos"]) for r in merge_detections(df, t).collect()}
    want = set().union(*(suppress([r for r in rows if r[0] == i], t) for i in range(4)))
    assert got == want


def test_merge_keeps_boxless_and_extra_columns(spark):
    df = spark.createDataFrame(
        [(1, 0, "a", 0.5, None, None, None, None), (1, 1, "a", 0.5, 0.0, 0.0, 4.0, 4.0), (1, 2, "b", 0.4, 0.0, 0.0, 4.0, 4.0)],
        BOXES,
    ).withColumn("track", F.col("pos") * 7)
    got = merge_detections(df).orderBy("pos").collect()
    assert [(r["pos"], r["track"]) for r in got] == [(0, 0), (1, 7), (2, 14)]


PATHS = [
    "x.jpg", "x.png", "x_1.jpg", "x_1.png", "a/x.jpg", "a/X.jpeg", "a/x.png", "a/x_1.jpg", "b/x.jpg", "b/a__x.jpg",
    "a__x.jpg", "c/a__x.jpg", "a__x_1.jpg", "z/c__a__x.jpg", "deep/b/x.jpg", "deep__b/x.jpg", "q/.hidden", ".hidden",
]


#: What each path is called: stem in a training set, name in an archive.
CALLED = {
    ".hidden": (".hidden", ".hidden"),
    "a/X.jpeg": ("X", "X.jpeg"),
    "a/x.jpg": ("a__x", "x.jpg"),
    "a/x.png": ("a__x_1", "x.png"),
    "a/x_1.jpg": ("x_1", "x_1.jpg"),
    "a__x.jpg": ("a__x_2", "a__x.jpg"),
    "a__x_1.jpg": ("a__x_1_1", "a__x_1.jpg"),
    "b/a__x.jpg": ("b__a__x", "b__a__x.jpg"),
    "b/x.jpg": ("b__x", "b__x.jpg"),
    "c/a__x.jpg": ("c__a__x", "c__a__x.jpg"),
    "deep/b/x.jpg": ("deep__b__x", "deep__b__x.jpg"),
    "deep__b/x.jpg": ("deep__b__x_1", "deep__b__x.jpg"),
    "q/.hidden": ("q__", "q__.hidden"),
    "x.jpg": ("x_2", "x.jpg"),
    "x.png": ("x_3", "x.png"),
    "x_1.jpg": ("x_1_1", "x_1.jpg"),
    "x_1.png": ("x_1_2", "x_1.png"),
    "z/c__a__x.jpg": ("z__c__a__x", "z__c__a__x.jpg"),
}


def test_names_of_known_paths(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "rel_path string")
    stems = {r["rel_path"]: r["stem"] for r in training.unique_stems(df).collect()}
    names = {r["rel_path"]: r["archive_name"] for r in naming.unique_names(df).collect()}
    assert {p: (stems[p], names[p]) for p in PATHS} == CALLED
    assert len({v.lower() for v in stems.values()}) == len(PATHS)



def test_repeats_are_numbered_before_the_extension(spark):
    names = ["a.jpg", "A.jpg", "a.jpg", ".env", ".env", "b", "b", "c.tar.gz", "c.tar.gz"]
    df = spark.createDataFrame(list(enumerate(names)), "n int, name string")
    got = [r["name"] for r in naming.number_repeats(df, [F.col("n")]).orderBy("n").collect()]
    assert got == ["a.jpg", "A (2).jpg", "a (3).jpg", ".env", ".env (2)", "b", "b (2)", "c.tar.gz", "c.tar (2).gz"]


@pytest.mark.parametrize("total", [1, 7, 30, 31, 100, 450])
@pytest.mark.parametrize("cap", [0, 1, 30, 50])
def test_frame_sampling(spark, total, cap):
    df = spark.range(total).select(F.lit("c").alias("clip"), F.col("id").alias("idx"), F.lit(total).cast("bigint").alias("total"))
    got = sorted(r["idx"] for r in frames.sample_frames(df, cap).collect())
    planned = total if cap <= 0 else min(total, cap)
    assert got == [k * total // planned for k in range(planned)]


def test_frames_of_unknown_length_stop_at_the_cap(spark):
    df = spark.range(9).select(F.lit("c").alias("clip"), F.col("id").alias("idx"), F.lit(None).cast("bigint").alias("total"))
    assert sorted(r["idx"] for r in frames.sample_frames(df, 4).collect()) == [0, 1, 2, 3]
    assert frames.truncated_clips(df, 4).first()["truncated"]
    assert not frames.truncated_clips(df, 20).first()["truncated"]


def test_rate_keeps_the_duration(spark):
    clips = spark.createDataFrame([("a", 30.0, 90), ("b", 0.0, 10), ("c", 24.0, 0)], "clip string, fps double, total bigint")
    got = {r["clip"]: r["output_fps"] for r in frames.clip_rate(clips, 45).collect()}
    assert got == {"a": 15.0, "b": 25.0, "c": 24.0}


def track_one_by_one(rows, t):
    from boxloom.streaming.live import _follow

    out, last, last_idx, next_id = {}, [], None, 1
    for idx in sorted({r[1] for r in rows}):
        now = sorted(r for r in rows if r[1] == idx)
        boxes = [(0, r[3], *r[4:]) for r in now]
        last, next_id = _follow(last if last_idx == idx - 1 else [], boxes, t, next_id)
        last_idx = idx
        out.update({(idx, r[2]): b[0] for r, b in zip(now, last)})
    return out


@pytest.mark.parametrize("nested", [256, 0])
def test_tracks_equal_following_frame_by_frame(spark, limits, nested):
    limits(nested=nested)
    rng = random.Random(5)
    rows = []
    for idx in [i for i in range(40) if i not in (13, 14, 27)]:
        for pos in range(rng.choice([1, 3, 4])):
            x = float(pos * 15 + rng.randrange(12))
            rows.append(("clip", idx, pos, rng.choice("aab"), x, 0.0, x + 20, 20.0))
    df = spark.createDataFrame(rows, "clip string, idx bigint, pos bigint, class_name string, x1 double, y1 double, x2 double, y2 double")
    got = {(r["idx"], r["pos"]): r["track_id"] for r in frames.track_objects(df, 0.3).collect()}
    assert got == track_one_by_one(rows, 0.3)


def test_tiles_cover_the_image(spark):
    images = spark.createDataFrame([(1, 1500, 700), (2, 640, 640), (3, 641, 100)], "item_id int, width int, height int")
    tiles = tiling.plan_tiles(images, 640, 0.2).collect()
    for item, width, height in [(1, 1500, 700), (2, 640, 640), (3, 641, 100)]:
        mine = [t for t in tiles if t["item_id"] == item]
        xs = sorted({t["x"] for t in mine})
        assert xs[0] == 0 and xs[-1] + min(640, width) == width
        assert all(b - a <= 640 for a, b in zip(xs, xs[1:]))
        assert all(t["x"] + t["tile_width"] <= width and t["y"] + t["tile_height"] <= height for t in mine)
        assert [t["tile_no"] for t in sorted(mine, key=lambda t: (t["y"], t["x"]))] == list(range(len(mine)))
    decided = {r["item_id"]: r["tiled"] for r in tiling.tile_decision(images, 640).collect()}
    assert decided == {1: True, 2: False, 3: True}
    with pytest.raises(ValueError):
        tiling.plan_tiles(images, 0)


def test_too_many_tiles_fall_back_to_one_pass(spark):
    images = spark.createDataFrame([(1, 9000, 9000)], "item_id int, width int, height int")
    row = tiling.tile_decision(images, 320).first()
    assert row["tiles"] > 256 and not row["tiled"]


def test_settings_are_clamped():
    raw = {"epochs": 100000, "imgsz": 999, "batch": 9999, "val_fraction": 0.99, "source": "nonsense"}
    got = training.clamp_settings(raw)
    assert (got["epochs"], got["imgsz"], got["batch"], got["val_fraction"], got["source"]) == (1000, 992, 128, 0.5, "current")
    assert training.clamp_settings() == {
        "epochs": 40, "imgsz": 640, "batch": 16, "val_fraction": 0.2, "min_conf": 0.25, "source": "current",
    }


ITEMS = "item_id bigint, rel_path string, width int, height int, status string, task string"


def test_training_lines_and_split(spark, tmp_path):
    items = spark.createDataFrame(
        [(1, "a.jpg", 100, 100, "done", ""), (2, "sub/a.jpg", 100, 100, "done", ""), (3, "b.jpg", 0, 0, "done", ""),
         (4, "c.jpg", 100, 100, "error", "")], ITEMS,
    )
    rows = [(1, 0, "car", 1.0, 10.0, 20.0, 50.0, 60.0), (2, 0, "dog", None, 0.0, 0.0, 200.0, 50.0), (2, 1, "car", 0.1, 0.0, 0.0, 9.0, 9.0),
            (3, 0, "car", 1.0, 0.0, 0.0, 5.0, 5.0), (4, 0, "cow", 1.0, 0.0, 0.0, 5.0, 5.0)]
    detections = spark.createDataFrame(rows, BOXES)
    classes = training.train_classes(items, detections, 0.25, {0: "car", 1: "van"})
    assert sorted(tuple(r) for r in classes.collect()) == [(0, "car"), (1, "van"), (2, "dog")]
    lines = training.yolo_lines(items, detections, classes, 0.25)
    texts = {r["item_id"]: r["t"] for r in lines.withColumn("t", training.line_text()).collect()}
    assert texts == {1: "0 0.300000 0.400000 0.400000 0.400000", 2: "2 1.000000 0.250000 1.000000 0.500000"}
    manifest = training.yolo_manifest(training.labelled_items(lines), 0.0)
    assert {r["stem"] for r in manifest.collect()} == {"a", "sub__a"}
    safe = training.guarantee_val(manifest)
    assert {(r["stem"], r["split"]) for r in safe.collect()} == {("a", "train"), ("sub__a", "val")}
    single = training.guarantee_val(manifest.filter("stem = 'a'"))
    assert sorted(r["split"] for r in single.collect()) == ["train", "val"]
    row = training.dataset_summary(safe, lines, items.filter("status = 'done'")).first()
    assert row.asDict() == {"images": 2, "boxes": 2, "train": 1, "val": 1, "skipped_empty": 1, "classes": ["car", "dog"]}
    training.write_labels(lines, safe, str(tmp_path / "labels"))
    back = spark.read.text(str(tmp_path / "labels"))
    assert {(r["split"], r["stem"], r["value"]) for r in back.collect()} == {("train", "a", texts[1]), ("val", "sub__a", texts[2])}
    with pytest.raises(ValueError):
        training.guarantee_val(manifest.limit(0))


def test_import_round_trip(spark):
    items = spark.createDataFrame([(1, "x/a.jpg", 10, 20, "done", "")], ITEMS)
    images = spark.createDataFrame([(0, 5, "up\\A.JPG", None, 7), (1, 6, "zz.jpg", 1, 1)], "ord bigint, id bigint, file_name string, width int, height int")
    annotations = spark.createDataFrame(
        [(0, 5, 1, [1.0, 2.0, 3.005, 4.0], [[0.0, 1.0, 2.0, 3.0, 9.0]], [1.0, 2.0, 0.0, 4.0, 5.0, 2.0, 8.0]),
         (1, 5, None, [1.0, 2.0, 3.0], None, None), (2, 5, 9, [0.0, 0.0, 1.0, 1.0], [], [])],
        "id bigint, image_id bigint, category_id bigint, bbox array<double>, segmentation array<array<double>>, keypoints array<double>",
    )
    categories = spark.createDataFrame([(0, 1, "van")], "ord bigint, id bigint, name string")
    found = importing.to_detections(annotations, importing.clean_categories(categories)).orderBy("ann_ord").collect()
    assert [(r["class_name"], r["kind"]) for r in found] == [("van", "pose"), ("class_9", "box")]
    assert found[0]["mask"] == [[0.0, 1.0], [2.0, 3.0]]
    assert found[0]["keypoints"] == [[1.0, 2.0, 0.0], [4.0, 5.0, 1.0]]
    assert found[0]["x2"] == 4.0  # 1 + 3.005 is just below the tie
    matched = importing.match_images(importing.clean_images(images), items)
    assert {r["file_name"]: r["item_id"] for r in matched.collect()} == {"up\\A.JPG": 1, "zz.jpg": None}
    row = importing.import_current(
        items.withColumns({"detail": F.lit(""), "review_priority": F.lit(0.5), "detection_count": F.lit(0)}), matched,
        importing.to_detections(annotations, importing.clean_categories(categories)),
    ).first()
    assert (row["width"], row["height"], row["task"], row["detection_count"], row["review_priority"]) == (10, 7, "detect", 2, 0.0)


def test_export_leaves_id_gaps_and_defaults_the_category(spark):
    items = spark.createDataFrame([(n, f"{c}.jpg", 9, 9, "done", "") for n, c in enumerate("abc")], ITEMS)
    rows = [(n, 0, name, 0.9, 0.0, 0.0, 2.0, 3.0) for n, name in enumerate(["car", None, "dog"])]
    detections = spark.createDataFrame(rows, BOXES)
    listing = items.filter("rel_path <> 'a.jpg'").select("rel_path")
    images = exporting.coco_images(exporting.numbered_images(items), listing)
    assert sorted(r["id"] for r in images.collect()) == [2, 3]
    classes = exporting.class_index(detections, ["dog", "cat"])
    assert {r["class_name"]: r["class_index"] for r in classes.collect()} == {"dog": 0, "cat": 1, "?": 2, "car": 3}
    got = exporting.coco_annotations(images, detections, classes.filter("class_name <> '?'"), 0.0).orderBy("id").collect()
    assert [(r["id"], r["image_id"], r["category_id"], r["area"]) for r in got] == [(1, 2, 1, 6.0), (2, 3, 1, 6.0)]
    assert exporting.formats_for("pose") == {"coco_keypoints": "COCO Keypoints 1.0"}
    assert exporting.formats_for("unheard") == {"coco": "COCO 1.0"}


def test_queue_orders_and_pages(spark):
    rows = [(1, "b", 0.5, 2, 0, 1.0), (2, "a", 0.5, 1, 3, 0.2), (3, "c", 0.9, 2, 3, 0.1)]
    items = spark.createDataFrame(rows, "item_id int, rel_path string, review_priority double, detection_count int, disputed int, agreement double")

    def ids(order):
        return [r["item_id"] for r in review.ordered(items, order).collect()]

    assert ids("path") == ids("unheard of") == [2, 1, 3]
    assert ids("priority") == [3, 2, 1]
    assert ids("most") == [1, 3, 2]
    assert ids("least") == [2, 1, 3]
    assert ids("disputed") == [3, 2, 1]
    assert [r["item_id"] for r in review.page(items, "path", 1, 1).collect()] == [1]
    assert [r["item_id"] for r in review.page_after(items, "a", 5).collect()] == [1, 3]


def test_reset_keeps_types_and_baseline(spark):
    items = spark.createDataFrame(
        [(1, "done", "x", "detect", 5.0, 0.5, 3, 4, 2, 0.5)],
        "item_id bigint, status string, detail string, task string, inference_ms double, review_priority double,"
        " detection_count bigint, baseline_count bigint, disputed bigint, agreement double",
    )
    after = lifecycle.reset_items(items)
    assert after.dtypes == items.dtypes
    assert tuple(after.first()) == (1, "pending", "", "", 0.0, 0.0, 0, 4, 0, 0.0)


def test_projects_create_patch_delete(spark):
    made = lifecycle.create_projects(spark.createDataFrame([("  ", "/d"), ("n", "/e")], "name string, source_dir string"))
    made = spark.createDataFrame(made.collect(), made.schema)
    assert {r["name"] for r in made.collect()} == {"Untitled", "n"}
    one = made.first()["project_id"]
    assert len(one) == 12
    patched = lifecycle.patch_project(made, one, status="running", colour="red")
    assert {r["project_id"]: r["status"] for r in patched.collect()}[one] == "running"
    assert patched.columns == made.columns
    left = lifecycle.delete_projects(made, made.filter(F.col("project_id") == one))
    assert left.count() == 1
