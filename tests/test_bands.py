"""The search for the best pairs of an island looks at near boxes only."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_crowds import boxes
from test_matching import frame, greedy

from boxloom.operators import islands, matching
from boxloom.operators.matching import Comparison
from boxloom.operators.overlap import split_by_size


def sides(base, now):
    codes = {"a": 0, "b": 1, "c": 2, None: -1}
    both = base + now
    pos = np.array([*range(len(base)), *range(len(now))])
    box = np.array([b for _, b in both], float)
    code = np.array([codes[c] for c, _ in both])
    return pos, [islands._Types(rows, pos, box, code) for rows in (np.arange(len(base)), np.arange(len(base), len(both)))]


def chosen(base, now, t):
    pos, types = sides(base, now)
    return {(int(pos[i]), int(pos[j]), stage) for stage, _, i, j in islands.match(*types, t)}


def mixed(rng, n, names, spread):
    """Boxes of very different shapes around one place, some of them equal."""
    out = []
    for _ in range(n):
        x, y = rng.choice([rng.uniform(0, spread), rng.randrange(spread)]), rng.uniform(0, spread)
        out.append((rng.choice(names), (x, y, x + rng.choice([0.5, 30, 31.5, 90]), y + rng.choice([29, 30, 200]))))
    return out + out[: n // 5]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("t", [0.5, 0.15, 0.93, 1.0])
def test_bands_choose_what_one_by_one_does(monkeypatch, seed, t):
    monkeypatch.setattr(islands, "_FEW", 0)
    monkeypatch.setattr(islands, "_BLOCK", [3, 5, 8, 64][seed])
    monkeypatch.setattr(islands, "_STEP", 16)
    rng = random.Random(seed)
    if seed % 2:
        base, now = boxes(rng, 90, ["a", "b", None], 9), boxes(rng, 80, ["a", None, "c"], 4)
    else:
        base, now = mixed(rng, 90, ["a", "b", None], 40), mixed(rng, 70, ["a", None, "c"], 40)
    assert chosen(base, now, t) == greedy(base, now, t)


def test_a_spot_of_near_equal_boxes_is_not_compared_pair_by_pair(monkeypatch):
    class Counting:
        seen = 0

        def __getattr__(self, name):
            return getattr(np, name)

        def nonzero(self, of):
            Counting.seen += of.size
            return np.nonzero(of)

    rng, n = random.Random(8), 4000
    base = []
    for _ in range(n):
        x, y = rng.uniform(0, 30), rng.uniform(0, 24)
        base.append(("a", (x, y, x + rng.uniform(60, 72), y + rng.uniform(60, 70))))
    now = [("a", tuple(v + rng.uniform(0, 2) for v in box)) for _, box in base]
    monkeypatch.setattr(islands, "np", Counting())
    assert len(chosen(base, now, 0.5)) > 0.9 * n
    assert Counting.seen < n * n / 4


def test_islands_beyond_the_limit_go_in_rounds(spark, limits, monkeypatch):
    limits(nested=16, hot=40)
    seen = []
    real = matching.match_in_rounds
    monkeypatch.setattr(matching, "match_in_rounds", lambda *a: seen.append(1) or real(*a))
    rng = random.Random(9)
    base, now = boxes(rng, 50, ["a", None], 8), boxes(rng, 50, ["a", None, "c"], 8)
    got = Comparison(
        frame(spark, [(1, p, c, b) for p, (c, b) in enumerate(base)]),
        frame(spark, [(1, p, c, b) for p, (c, b) in enumerate(now)]), 0.5,
    ).matches().collect()
    assert seen and {(r["i"], r["j"], r["pass"]) for r in got} == greedy(base, now, 0.5)


def test_nothing_is_read_for_ordinary_groups_where_there_are_none(spark, limits):
    limits(nested=3)
    one = frame(spark, [(k % 2, k, "a", (0, 0, 1, 1)) for k in range(10)])
    light, heavy = split_by_size([one, one], ["item_id"])
    assert all(f._jdf.queryExecution().optimizedPlan().toString().startswith("LocalRelation <empty>") for f in light)
    assert [h.count() for h in heavy] == [10, 10]
    mixed_sizes = one.unionByName(frame(spark, [(None, 0, "a", (0, 0, 1, 1)), (7, 0, "a", (0, 0, 1, 1))]))
    light, heavy = split_by_size([mixed_sizes, one], ["item_id"])
    assert [f.count() for f in light + heavy] == [2, 0, 10, 10]


def test_numbers_of_a_hot_group_fall_in_order(spark, limits):
    from boxloom.operators.ranking import _in_buckets, _range_bounds, row_numbers
    limits(hot=50)
    rng = random.Random(3)
    rows = [(k % 2, rng.choice([None, 1.0, 2.0, float(rng.randrange(9))]), rng.choice([None, "a", "b"]), k) for k in range(900)]
    df = spark.createDataFrame(rows, "g int, a double, b string, c bigint")
    got = row_numbers(df, ["g"], [F.col("a"), F.col("b"), F.col("c")], "n").collect()
    for g in (0, 1):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["n"])
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3]))
        assert [r["n"] for r in mine] == list(range(1, 451)) and [r["c"] for r in mine] == [r[3] for r in order]
    # no fold over an array for every row, and nothing compared that need not be
    places = spark.range(5000).select(F.col("id").alias("_o0"), (F.col("id") % 7).alias("_o1"))
    bounds = _range_bounds(places, 8)
    placed = _in_buckets(places, bounds)
    assert list(bounds[0].__fields__) == ["_o0"] and "lambdafunction" not in placed._jdf.queryExecution().optimizedPlan().toString()
    sizes = [r["n"] for r in placed.groupBy("_bucket").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 5000 and max(sizes) < 1500
