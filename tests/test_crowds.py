"""Crowded images: right results, and no table that grows with the pairs."""

import random

import pytest
from test_matching import frame, greedy

from boxloom.operators import matching, nms
from boxloom.operators.matching import Comparison
from boxloom.operators.nms import in_order, merge_detections

BOXES = "item_id bigint, pos bigint, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"


@pytest.fixture
def rows_stored(monkeypatch):
    """Counts the rows that the operators write."""
    counts = []

    def counted(real):
        def durable(df):
            kept = real(df)
            counts.append(kept.count())
            return kept

        return durable

    for module in (matching, nms):
        monkeypatch.setattr(module, "durable", counted(module.durable))
    return counts


def test_suppression_of_near_equal_boxes_stores_rows_in_proportion(spark, rows_stored):
    rng = random.Random(4)
    n = 20_000
    rows = []
    for pos in range(n):
        x, y = rng.uniform(0, 30), rng.uniform(0, 30)
        rows.append((1, pos, "a", rng.randrange(1000) / 1000, x, y, x + rng.uniform(80, 100), y + rng.uniform(80, 100)))
    kept = []
    for row in sorted(rows, key=lambda r: (-r[3], r[1])):
        if all(not covers(k, row, 0.5) for k in kept):
            kept.append(row)
    found = merge_detections(spark.createDataFrame(rows, BOXES), 0.5)
    assert {r["pos"] for r in found.collect()} == {k[1] for k in kept}
    assert sum(rows_stored) < 3 * n


def covers(a, b, t):
    w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
    if w <= 0 or h <= 0:
        return False
    shared = w * h
    return shared / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - shared) >= t


def test_order_of_kept_detections(spark):
    rows = [
        (1, 0, "b", 0.5, 0.0, 0.0, 9.0, 9.0), (1, 1, "a", 0.9, 50.0, 0.0, 59.0, 9.0), (1, 2, "a", 0.5, 80.0, 0.0, 89.0, 9.0),
        (1, 3, "label", 0.1, None, None, None, None), (1, 4, None, 0.5, 0.0, 60.0, 9.0, 69.0), (1, 5, "b", 0.5, 0.0, 90.0, 9.0, 99.0),
        (1, 6, "label", 0.2, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, BOXES)
    found = in_order(merge_detections(df), df).orderBy("rank").collect()
    assert [r["pos"] for r in found] == [3, 6, 1, 0, 5, 2, 4] and [r["rank"] for r in found] == list(range(1, 8))


def boxes(rng, n, classes, copies=0):
    """Near-equal boxes, some of them alike, some without a class."""
    out = []
    for _ in range(n):
        x, y = rng.randrange(20) / 4, rng.randrange(20) / 4
        out.append((rng.choice(classes), (x, y, x + 40 + rng.randrange(4), y + 40)))
    return out + [out[0]] * copies


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_in_a_crowd_of_ties_copies_and_null_classes(spark, limits, rows_stored, seed):
    limits(nested=16, hot=2000)
    rng = random.Random(seed)
    base, now = boxes(rng, 250, ["a", "b", None], 40), boxes(rng, 250, ["a", "b", None, "c"], 25)
    found = Comparison(
        frame(spark, [(1, p, c, b) for p, (c, b) in enumerate(base)]),
        frame(spark, [(1, p, c, b) for p, (c, b) in enumerate(now)]), 0.5,
    ).matches().collect()
    assert {(r["i"], r["j"], r["pass"]) for r in found} == greedy(base, now, 0.5)
    pairs = len(base) * len(now)
    # tables that are kept: boxes and what is final of them, and the last rest of each pass
    assert max(rows_stored) <= 2000 < pairs / 20
