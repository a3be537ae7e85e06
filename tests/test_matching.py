"""Matching and diffing on small cases and against brute force."""

import random

import pytest

from boxloom.operators import diff
from boxloom.operators.matching import Comparison
from boxloom.operators.overlap import iou_candidates

SCHEMA = "item_id bigint, pos bigint, class_name string, x1 double, y1 double, x2 double, y2 double"


def frame(spark, rows):
    def corners(box):
        return [float(v) for v in box] if box else [None] * 4

    return spark.createDataFrame([(i, p, c, *corners(box)) for i, p, c, box in rows], SCHEMA)


def compare(spark, baseline, current, iou=0.5):
    base = frame(spark, [(1, p, c, b) for p, (c, b) in enumerate(baseline)])
    now = frame(spark, [(1, p, c, b) for p, (c, b) in enumerate(current)])
    return Comparison(base, now, iou)


def kinds(comparison):
    return sorted(r["kind"] for r in comparison.pairings().collect())


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union


def greedy(baseline, current, t):
    """One by one: best pair of the same class first, then across classes."""
    used_b, used_c, out = set(), set(), set()
    for same in (True, False):
        pairs = sorted(
            (-iou(b[1], c[1]), i, j)
            for i, b in enumerate(baseline)
            for j, c in enumerate(current)
            if (b[0] == c[0]) == same and iou(b[1], c[1]) >= t
        )
        for _, i, j in pairs:
            if i not in used_b and j not in used_c:
                used_b.add(i), used_c.add(j), out.add((i, j, 0 if same else 1))
    return out


def test_overlapping_same_class_agrees(spark):
    assert kinds(compare(spark, [("car", (0, 0, 10, 10))], [("car", (1, 1, 11, 11))])) == ["agreed"]


def test_same_class_match_is_not_stolen_by_a_closer_other_class(spark):
    result = compare(
        spark,
        [("car", (0, 0, 10, 10))],
        [("van", (0, 0, 10, 10)), ("car", (0, 0, 10, 8))],
    )
    assert kinds(result) == ["added", "agreed"]


def test_each_side_is_used_once(spark):
    result = compare(spark, [("car", (0, 0, 10, 10))], [("car", (0, 0, 10, 10)), ("car", (0, 0, 10, 10))])
    assert kinds(result) == ["added", "agreed"]


def test_best_overlap_wins(spark):
    result = compare(spark, [("car", (0, 0, 10, 10))], [("car", (0, 0, 10, 7)), ("car", (0, 0, 10, 9))])
    assert result.matches().first()["j"] == 1


def test_touching_boxes_do_not_match(spark):
    assert kinds(compare(spark, [("a", (0, 0, 5, 5))], [("a", (5, 0, 10, 5))])) == ["added", "missing"]


def test_missing_class_names_are_equal(spark):
    assert kinds(compare(spark, [(None, (0, 0, 5, 5))], [(None, (0, 0, 5, 5))])) == ["agreed"]


def test_boxless_detection_among_boxes_is_only_missing_or_added(spark):
    result = compare(spark, [("a", (0, 0, 5, 5)), ("b", None)], [("a", (0, 0, 5, 5)), ("b", None)])
    assert kinds(result) == ["added", "agreed", "missing"]


@pytest.mark.parametrize("nested", [256, 0])
def test_labels_compare_their_first_element(spark, limits, nested):
    limits(nested=nested)
    result = compare(spark, [("cat", None), ("dog", None)], [("cat", None), ("owl", None)])
    rows = result.pairings().collect()
    assert [(r["kind"], r["overlap"]) for r in rows] == [("agreed", 1.0)]
    mixed = compare(spark, [("cat", (0, 0, 5, 5)), ("x", (1, 1, 9, 9))], [("dog", None)])
    assert kinds(mixed) == ["reclassified"]
    assert kinds(compare(spark, [("cat", None)], [])) == ["missing"]


def test_summary_counts_and_swaps(spark):
    base = frame(spark, [(1, 0, "car", (0, 0, 9, 9)), (2, 0, "car", (0, 0, 9, 9)), (3, 0, "van", (0, 0, 9, 9))])
    now = frame(spark, [(1, 0, "car", (0, 0, 9, 9)), (2, 0, "van", (0, 0, 9, 9)), (4, 0, "bus", (0, 0, 9, 9))])
    result = Comparison(base, now)
    row = diff.diff_summary(diff.item_diff(result)).first()
    assert (row["items"], row["items_identical"], row["items_disputed"], row["disputed"]) == (4, 1, 3, 3)
    assert row["agreement"] == 0.25
    assert [tuple(r) for r in diff.diff_swaps(result.pairings()).collect()] == [("car -> van", 1)]
    by_class = {r["class_name"]: r["disputed"] for r in diff.diff_by_class(result.pairings()).collect()}
    assert by_class == {"car": 0, "van": 2, "bus": 1}


def test_empty_sets_give_full_agreement(spark):
    nothing = frame(spark, [])
    row = diff.diff_summary(diff.item_diff(Comparison(nothing, nothing))).first()
    assert (row["items"], row["agreement"]) == (0, 1.0)


def scene(rng, n, copies):
    out = []
    for _ in range(n):
        x, y = rng.randrange(60), rng.randrange(60)
        size = rng.choice([6, 12, 40])
        item = (rng.choice("ab"), (x, y, x + size, y + rng.choice([6, 12, 40])))
        out += [item] * rng.choice(copies)
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("nested,hot", [(256, 1000), (0, 1000), (0, 0)])
@pytest.mark.parametrize("t", [0.5, 0.2])
def test_matching_equals_brute_force(spark, limits, nested, hot, t):
    limits(nested=nested, hot=hot)
    rng = random.Random(f"{nested}{hot}{t}")
    scenes = {k: (scene(rng, 9, [1, 2, 4]), scene(rng, 9, [1, 2, 3])) for k in range(6)}
    base = frame(spark, [(k, p, *d) for k, (b, _) in scenes.items() for p, d in enumerate(b)])
    now = frame(spark, [(k, p, *d) for k, (_, c) in scenes.items() for p, d in enumerate(c)])
    got = {(r["item_id"], r["i"], r["j"], r["pass"]) for r in Comparison(base, now, t).matches().collect()}
    want = {(k, *m) for k, (b, c) in scenes.items() for m in greedy(b, c, t)}
    assert got == want
    for same in (True, False):
        pairs = iou_candidates(base, now, t, same).collect()
        assert {(r["item_id"], r["i"], r["j"]) for r in pairs} == {
            (k, i, j)
            for k, (b, c) in scenes.items()
            for i, x in enumerate(b)
            for j, y in enumerate(c)
            if (x[0] == y[0]) == same and iou(x[1], y[1]) >= t
        }
        assert len(pairs) == len({(r["item_id"], r["i"], r["j"]) for r in pairs})


@pytest.mark.parametrize("t", [0.0, 1.5])
def test_threshold_outside_range_is_refused(spark, t):
    with pytest.raises(ValueError):
        compare(spark, [], [], t)


def test_ordinary_images_need_one_shuffle(spark):
    """Nesting both sets costs one exchange; nothing else moves rows."""
    base = frame(spark, [(1, 0, "a", (0, 0, 5, 5))])
    nested = Comparison(base, base).nested
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_stored_items_compare_without_a_shuffle(spark):
    from pyspark.sql import types as T

    from boxloom.schema import DETECTION

    def found(name, box):
        return {"class_name": name, "confidence": 1.0, "kind": "box", "box": box}

    schema = T.StructType(
        [T.StructField("item_id", T.LongType()), T.StructField("baseline", T.ArrayType(DETECTION)),
         T.StructField("detections", T.ArrayType(DETECTION))]
    )
    box = [0.0, 0.0, 9.0, 9.0]
    rows = [
        (1, [found("car", box)], [found("van", box), found("car", box)]),
        (2, [], [found("cat", None)]),
        (3, [], []),
        (4, [found("car", box)], [found("car", [1.0, 2.0])]),
    ]
    result = Comparison.of_items(spark.createDataFrame(rows, schema))
    got = sorted((r["item_id"], r["kind"]) for r in result.pairings().collect())
    assert got == [(1, "added"), (1, "agreed"), (2, "added"), (4, "agreed")]
    plan = diff.item_diff(result)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_refresh_keeps_items_outside_the_comparison(spark):
    items = spark.createDataFrame([(1, 9, 0.5), (2, 7, 0.25)], "item_id bigint, disputed bigint, agreement double")
    base = frame(spark, [(1, 0, "a", (0, 0, 5, 5))])
    rows = diff.refresh_comparison(items, Comparison(base, base)).orderBy("item_id").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 1.0), (2, 7, 0.25)]
