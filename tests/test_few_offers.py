"""Suppression in a crowd: few offers travel to the boxes, not the boxes to the offers."""

import random

import pytest
from test_crowds import BOXES, covers, rows_stored  # noqa: F401

from boxloom.operators.nms import merge_detections


@pytest.mark.parametrize("hot", [None, 2])
def test_open_boxes_stay_where_they_are(spark, limits, rows_stored, hot):  # noqa: F811
    limits(nested=16, hot=hot)
    rng, n = random.Random(7), 6000
    rows = []
    for pos in range(n):
        x, y = rng.randrange(12) + rng.randrange(2) * 500, rng.randrange(12)
        box = (float(x), float(y), x + rng.choice([20.0, 30.0, 30.0, 0.0]), y + 24.0)
        rows.append((pos % 2, pos, rng.choice(["a", None]), rng.randrange(9) / 8, *box))
    want = []
    for row in sorted(rows, key=lambda r: (-r[3], r[1])):
        if not any(k[0] == row[0] and k[2] == row[2] and covers(k, row, 0.5) for k in want):
            want.append(row)
    rows_stored.clear()
    found = merge_detections(spark.createDataFrame(rows, BOXES), 0.5, stored=True)
    assert {r["pos"] for r in found.collect()} == {k[1] for k in want}
    if hot is None:
        assert sum(rows_stored) < n / 2
