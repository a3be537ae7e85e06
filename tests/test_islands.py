"""Crowded images cut into islands, and the bounded search for their best pairs."""

import random

import numpy as np
import pytest
from test_crowds import boxes
from test_matching import frame, greedy

from boxloom.operators import islands, matching
from boxloom.operators.matching import Comparison


def test_islands_of_a_crowd_need_no_rounds(spark, limits, monkeypatch):
    limits(nested=16)
    monkeypatch.setattr(matching, "match_in_rounds", None)
    rng = random.Random(5)
    scenes, base, now = {}, [], []
    for image in (1, 2):
        for spot in range(4):
            x, y = spot % 2 * 500 + 3, spot // 2 * 500
            for side in (base, now):
                for name, (x1, y1, x2, y2) in boxes(rng, 40, ["a", "b", None], 5) + [("a", (0, 0, 0, 9))]:
                    side.append((image, name, (x1 + x, y1 + y, x2 + x, y2 + y)))
    got = Comparison(
        frame(spark, [(k, p, c, b) for p, (k, c, b) in enumerate(base)]),
        frame(spark, [(k, p, c, b) for p, (k, c, b) in enumerate(now)]), 0.5,
    ).matches().collect()
    want = set()
    for image in (1, 2):
        first = [p for p, row in enumerate(base) if row[0] == image]
        second = [p for p, row in enumerate(now) if row[0] == image]
        found = greedy([base[p][1:] for p in first], [now[p][1:] for p in second], 0.5)
        want |= {(image, first[i], second[j], s) for i, j, s in found}
    assert {(r["item_id"], r["i"], r["j"], r["pass"]) for r in got} == want


def test_large_islands_still_go_in_rounds(spark, limits):
    limits(nested=16, hot=60)
    rng = random.Random(6)
    base, now = boxes(rng, 50, ["a", None], 8), boxes(rng, 50, ["a", None, "c"], 8)
    apart = [("a", (900 + k, 0, 940 + k, 40)) for k in range(9)]
    base, now = base + apart, now + apart[::-1]
    got = Comparison(
        frame(spark, [(1, p, c, b) for p, (c, b) in enumerate(base)]),
        frame(spark, [(1, p, c, b) for p, (c, b) in enumerate(now)]), 0.5,
    ).matches().collect()
    assert {(r["i"], r["j"], r["pass"]) for r in got} == greedy(base, now, 0.5)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("t", [0.5, 0.15])
def test_few_pairs_held_at_once_choose_the_same(monkeypatch, seed, t):
    monkeypatch.setattr(islands, "_LEAST", 20)
    monkeypatch.setattr(islands, "_HELD", 0)
    monkeypatch.setattr(islands, "_BLOCK", 7)
    rng = random.Random(seed)
    base, now = boxes(rng, 90, ["a", "b", None], 9), boxes(rng, 80, ["a", None, "c"], 4)
    if seed % 2:
        base, now = [[(c, (x, y, x + rng.choice([6, 30, 90]), y2)) for c, (x, y, _, y2) in side] for side in (base, now)]
    codes = {"a": 0, "b": 1, "c": 2, None: -1}
    both = base + now
    pos = np.array([*range(len(base)), *range(len(now))])
    box = np.array([b for _, b in both], float)
    code = np.array([codes[c] for c, _ in both])
    sides = [islands._Types(rows, pos, box, code) for rows in (np.arange(len(base)), np.arange(len(base), len(both)))]
    got = {(int(pos[i]), int(pos[j]), stage) for stage, _, i, j in islands.match(*sides, t)}
    assert got == greedy(base, now, t)
