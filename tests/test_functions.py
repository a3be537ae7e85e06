"""Column functions, mostly against plain Python."""

import hashlib

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boxloom.functions import text
from boxloom.functions.geometry import box_area, iou, keypoints_from_flat, polygon_from_flat
from boxloom.functions.numbers import py_round, short_decimal
from boxloom.operators.review import search_path

NUMBERS = st.one_of(
    st.floats(-1e6, 1e6),
    st.integers(-10**7, 10**7).map(lambda n: n / 1000),
    st.integers(-10**9, 10**9).map(lambda n: n / 10**5),
)


@settings(max_examples=12, deadline=None)
@given(st.lists(NUMBERS, min_size=50, max_size=200))
def test_rounding_is_pythons(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    for digits in (2, 4, 6):
        got = [r[0] for r in df.select(py_round(F.col("v"), digits)).collect()]
        assert got == [round(v, digits) for v in values]


def test_rounding_ties():
    assert round(2.675, 2) == 2.67


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("value,want", [(0.9, "0.9"), (1.0, "1.0"), (0.0001, "0.0001"), (0.12346, "0.1235"), (0.0, "0.0")])
def test_short_decimal(spark, value, want):
    assert one(spark, short_decimal(F.lit(value), 4)) == want


@pytest.mark.parametrize(
    "a,b,want",
    [((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (10, 0, 20, 10), 0.0), ((0, 0, 10, 10), (5, 0, 15, 10), 1 / 3)],
)
def test_iou(spark, a, b, want):
    cols = [[F.lit(float(v)) for v in box] for box in (a, b)]
    assert one(spark, iou(*cols)) == pytest.approx(want)


def test_area_of_inverted_or_absent_box(spark):
    assert one(spark, box_area([F.lit(v) for v in (5.0, 5.0, 1.0, 9.0)])) == 0.0
    assert one(spark, box_area([F.lit(None).cast("double")] * 4)) == 0.0


@pytest.mark.parametrize("n", range(8))
def test_flat_coordinates(spark, n):
    flat = [float(v) for v in range(1, n + 1)]
    column = F.array(*[F.lit(v) for v in flat]).cast("array<double>")
    assert one(spark, polygon_from_flat(column)) == [[flat[i], flat[i + 1]] for i in range(0, n - 1, 2)]
    assert one(spark, keypoints_from_flat(column)) == [[flat[i], flat[i + 1], 1.0] for i in range(0, n - 2, 3)]


@pytest.mark.parametrize(
    "name,want",
    [("../../etc/passwd", "passwd"), ("C:\\W\\evil.pt", "evil.pt"), ("写真.jpg", "写真.jpg"), ('a<b>:"c".jpg', "a_b___c_.jpg"),
     (" . ", None), ("x" * 300, "x" * 255), ("a\nb", "a_b")],
)
def test_safe_name(spark, name, want):
    assert one(spark, text.safe_name(F.lit(name))) == want


def test_entry_and_folder_names(spark):
    assert one(spark, text.safe_entry_name(F.lit("..a//b?.jpg"))) == "_a_b_.jpg"
    assert one(spark, text.safe_entry_name(F.lit(""))) == "file"
    assert one(spark, text.folder_label(F.lit("a/b é-1"))) == "a_b é-1"
    assert one(spark, text.folder_label(F.lit(""))) == "unknown"
    assert one(spark, text.archive_label(F.lit("my set.v1"))) == "my_set_v1"
    assert one(spark, text.yaml_quote(F.lit('a"b\\c'))) == '"a\\"b\\\\c"'


@pytest.mark.parametrize("raw,server,browser", [("0, 2;5", [0, 2, 5], [0, 2, 5]), ("2,2, x,-1", [-1, 2], [2]), ("3 4px", None, [3, 4]), ("", None, None)])
def test_class_lists(spark, raw, server, browser):
    assert one(spark, text.class_ids(F.lit(raw))) == server
    assert one(spark, text.class_ids_browser(F.lit(raw))) == browser


@pytest.mark.parametrize("path", ["a.jpg", "sub/b.png", "写真/c.jpg"])
def test_split_hash(spark, path):
    want = int(hashlib.md5(path.encode()).hexdigest()[:8], 16) % 1000
    assert one(spark, text.hash_bucket(F.lit(path))) == want


def test_hue(spark):
    hue = 0
    for char in "truck é":
        hue = (hue * 31 + ord(char)) % 360
    assert one(spark, text.class_hue(F.lit("truck é"))) == hue


@pytest.mark.parametrize("payload,error", [("", "missing image data"), ("!!", "malformed base64 data"), ("data:image/png;base64,aGk=", None), ("aGk=", None), ("A" * 8, "exceeds the 0 MB limit")])
def test_payload(spark, payload, error):
    assert one(spark, text.payload_error(F.lit(payload), 5)) == error


def test_search_folds_ascii_only_and_keeps_wildcards(spark):
    items = spark.createDataFrame([("Ä/CAM1.jpg",), ("ä/cam2.JPG",), ("x/c%m.jpg",), ("a\\b.jpg",)], "rel_path string")

    def found(term):
        return {r[0] for r in search_path(items, term).collect()}

    assert found("cam_.JPG") == {"Ä/CAM1.jpg", "ä/cam2.JPG"}
    assert found("ä/") == {"ä/cam2.JPG"}
    assert found("c%m") == {"Ä/CAM1.jpg", "ä/cam2.JPG", "x/c%m.jpg"}
    assert found("\\b") == {"a\\b.jpg"}
    assert len(found("")) == 4
