"""Pages after a row, in every order, with ties and nulls; documents with equal ids."""

import random

import pytest

from boxloom.operators import importing, review

ITEMS = "item_id bigint, rel_path string, review_priority double, detection_count bigint, disputed bigint, agreement double"


@pytest.fixture(scope="module")
def queue(spark):
    rng = random.Random(3)
    pick = lambda *values: rng.choice((None, *values))
    data = [(i, f"a/{i % 11}", pick(0.5, 1.0), pick(1, 2, 3), pick(0, 1), pick(0.0, 0.25)) for i in range(90)]
    return spark.createDataFrame(data, ITEMS).cache()


@pytest.mark.parametrize("order", ["path", "priority", "most", "least", "disputed"])
def test_pages_after_a_row_walk_the_whole_order(queue, order):
    whole = review.ordered(queue, order).collect()
    for at in (0, 7, 30, 61, 88, 89):
        found = review.page_after_row(queue, order, whole[at], 20).collect()
        assert found == whole[at + 1 : at + 21]


def test_rows_after_skips_files(spark, queue, tmp_path):
    path = str(tmp_path / "queue")
    review.clustered(queue, "most").write.parquet(path)
    stored = spark.read.parquet(path)
    last = review.page(stored, "most", 40, 1).first()
    after = review.rows_after(stored, "most", last)
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert f"LessThanOrEqual(detection_count,{last['detection_count']})" in plan
    assert after.count() == 49


def test_visible_pages(spark):
    counted = spark.createDataFrame(
        [(1, "b/Z.jpg", 2), (2, "a/y.jpg", 0), (3, "c/a.jpg", 2), (4, "a/A.jpg", 1)], "item_id bigint, rel_path string, visible_count bigint"
    )
    ids = lambda order: [r["item_id"] for r in review.visible_page(counted, order).collect()]
    assert ids("most") == [1, 3, 4, 2]
    assert ids("least") == [2, 4, 1, 3]
    assert ids("name") == [4, 3, 2, 1]


def test_documents_with_equal_ids_stay_apart(spark):
    images = spark.createDataFrame(
        [("x", 0, 1, "a.jpg"), ("y", 0, 1, "b.jpg"), ("y", 1, None, "c.jpg")], "doc_id string, ord bigint, id bigint, file_name string"
    ).selectExpr("*", "10 AS width", "10 AS height")
    categories = spark.createDataFrame([("x", 0, 1, "cat"), ("y", 0, 1, "dog"), ("y", 1, 2, None)], "doc_id string, ord bigint, id bigint, name string")
    boxes = [("x", 0, 1, 1), ("y", 0, 1, 1), ("y", 1, 1, 2), ("y", 2, 1, 9), ("y", 3, 1, None)]
    annotations = spark.createDataFrame(boxes, "doc_id string, ord bigint, image_id bigint, category_id bigint").selectExpr(
        "*", "ord AS id", "array(1D, 1D, 2D, 2D) AS bbox"
    )
    i, a, c = importing.of_documents(images, annotations, categories)
    assert sorted(r["file_name"] for r in importing.clean_images(i).collect()) == ["a.jpg", "b.jpg"]
    found = importing.to_detections(importing.clean_annotations(a), importing.clean_categories(c)).collect()
    assert sorted((r["image_id"]["doc_id"], r["ann_ord"]["id"], r["class_name"]) for r in found) == [
        ("x", 0, "cat"), ("y", 0, "dog"), ("y", 1, "class_2"), ("y", 2, "class_9"), ("y", 3, "object")
    ]
