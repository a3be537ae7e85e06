"""Free names against choosing one by one."""

import random

import pytest
from pyspark.sql import functions as F

from boxloom.operators import naming


def one_by_one(rows, numbered=True):
    seen, out, last = set(), {}, {}
    for path, plain, folded in sorted(rows):
        name, n = plain, last.get(folded.lower(), 0)
        if name.lower() in seen:
            name = folded
        while numbered and name.lower() in seen:
            n += 1
            name = f"{folded}_{n}"
        last[folded.lower()] = n  # a number once taken stays taken
        seen.add(name.lower())
        out[path] = name
    return out


def chosen(spark, rows, mark="_"):
    df = spark.createDataFrame([(*r, 7) for r in rows], "rel_path string, plain string, folded string, extra int")
    found = naming.first_free_names(df, F.col("plain"), F.col("folded"), "name", mark)
    assert found.columns == ["rel_path", "plain", "folded", "extra", "name"]
    return {r["rel_path"]: r["name"] for r in found.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_names_with_all_kinds_of_clashes(spark, seed):
    rng = random.Random(seed)
    pool = ["x", "X", "x_1", "x_2", "x_1_1", "x_01", "y", "y_3", "x_", "_1", "a__x"]
    rows = [(f"p{k:04d}{rng.random()}", rng.choice(pool), rng.choice(pool)) for k in range(rng.choice((3, 40, 120)))]
    assert chosen(spark, rows) == one_by_one(rows)
    assert chosen(spark, rows, None) == one_by_one(rows, numbered=False)


def test_a_name_of_very_many_images_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = naming._gaps
    monkeypatch.setattr(naming, "_gaps", lambda *a: rounds.append(1) or real(*a))
    rows = [(f"b{k:06d}", "frame", "frame") for k in range(100_000)]
    rows += [(f"a{k}", f"frame_{k * 3}", f"frame_{k * 3}") for k in range(1, 2000)]
    assert chosen(spark, rows) == one_by_one(rows)
    assert len(rounds) <= 3


def test_no_images(spark):
    assert chosen(spark, []) == {}
