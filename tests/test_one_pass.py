"""Jobs that once derived, counted or stored their rows more often than they need."""

from test_matching import frame

from boxloom.operators import diff, exporting, frames, importing, overlap, ranking, tiling
from boxloom.operators.matching import Comparison

BOX = "class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"


def refuse(*_, **__):
    raise AssertionError("counted again")


def test_annotation_ids_by_ranges_of_images(spark, limits, monkeypatch):
    images = spark.createDataFrame([(100 + k, k) for k in range(1, 12)], "item_id bigint, id bigint")
    rows = [(100 + k, p, "ab"[p % 2], 0.9 if p else 0.1, 1.0, 1.0, 3.0, 4.0) for k in range(1, 12) for p in range(k % 4)]
    boxes = spark.createDataFrame(rows, f"item_id bigint, pos bigint, {BOX}")
    classes = spark.createDataFrame([("a", 0), ("b", 1)], "class_name string, class_index bigint")
    want = [(n + 1, *key) for n, key in enumerate(sorted((r[0] - 100, r[1]) for r in rows if r[3] > 0.3))]
    monkeypatch.setattr(exporting, "_IMAGES", 3)
    for hot in (None, 1):
        limits(hot=hot)
        with monkeypatch.context() as patch:
            if hot is None:  # only ranges that are too large number rows by themselves
                patch.setattr(exporting, "row_numbers", refuse)
            got = exporting.coco_annotations(images, boxes, classes, 0.3).orderBy("id").collect()
        assert [(r["id"], r["image_id"], r["pos"]) for r in got] == want
    monkeypatch.setattr(exporting, "durable", refuse)
    plain = exporting.annotation_rows(images, boxes, classes, 0.3)
    assert exporting.export_summary(images, plain).first()["annotations"] == len(want)


def test_item_comparison_matches_once(spark, limits):
    items = spark.createDataFrame([(1, "a.jpg", 2)], "item_id bigint, rel_path string, baseline_count bigint")
    base = frame(spark, [(1, 0, "a", (0, 0, 5, 5)), (1, 1, "b", (50, 0, 59, 9))])
    now = frame(spark, [(1, 0, "a", (0, 0, 5, 5))])
    for nested in (256, 0):
        limits(nested=nested)
        shown = diff.item_comparison(items, Comparison(base, now))
        rows = {(r["kind"], r["disputed"], r["agreement"]) for r in shown.collect()}
        assert rows == {("agreed", 1, 0.5), ("missing", 1, 0.5)}
        if nested:
            assert shown._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_known_bounds_are_not_counted_again(spark, monkeypatch):
    tiles = spark.createDataFrame(
        [(1, n, 0, 0, 0, "a", 0.5, 1.0, 1.0, 9.0, 9.0) for n in range(3)], f"item_id bigint, tile_no int, x int, y int, pos bigint, {BOX}"
    )
    clip = spark.createDataFrame(
        [("c", i, 0, "a", 1.0, 0.0, 0.0, 9.0, 9.0) for i in range(5)], f"clip string, idx bigint, pos bigint, {BOX}"
    )
    monkeypatch.setattr(overlap, "hot_groups", refuse)
    assert tiling.merge_tiles(tiles, None, largest=3).count() == 1
    assert {r["track_id"] for r in frames.track_objects(clip, largest=1).collect()} == {1}


def test_import_append_is_not_joined_to_be_counted(spark, monkeypatch):
    current = spark.createDataFrame([(7, 0, "a", 1.0, 0.0, 0.0, 1.0, 1.0)], f"item_id bigint, pos bigint, {BOX}")
    found = spark.createDataFrame([(7, 1, 2), (7, 2, 1)], "item_id bigint, image_id bigint, ord bigint")
    monkeypatch.setattr(importing, "hits", lambda matched: matched)
    monkeypatch.setattr(ranking, "has_hot_group", refuse)
    new = spark.createDataFrame([(1, 5, "x", 1.0, 0.0, 0.0, 1.0, 1.0), (2, 9, "y", 1.0, 0.0, 0.0, 1.0, 1.0)], f"image_id bigint, ann_ord bigint, {BOX}")
    got = importing.import_append(current, found, new).orderBy("pos").collect()
    assert [(r["pos"], r["class_name"]) for r in got] == [(0, "a"), (1, "y"), (2, "x")]
