"""Streams that are stopped and started, and exact medians."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from boxloom.operators import review, selection
from boxloom.streaming.upsert import ResultStore, upsert_stream

RESULT = "item_id bigint, status string, value bigint"


def feed(spark, folder, rows):
    spark.createDataFrame(rows, RESULT).coalesce(1).write.mode("append").parquet(folder)


def test_a_batch_that_breaks_off_counts_once(spark, tmp_path):
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    store = ResultStore(str(tmp_path / "store"))
    first = [(k, "error" if k % 4 == 0 else "done", k) for k in range(20)]
    feed(spark, source, first)

    def stream():
        return spark.readStream.schema(RESULT).parquet(source)

    def breaks(batch, number):
        raise RuntimeError("stopped")

    # saved and in the ledger, but the checkpoint does not know: the batch comes again
    with pytest.raises(Exception, match="stopped"):
        upsert_stream(stream(), store, progress, once=True, after=breaks).awaitTermination()
    upsert_stream(stream(), store, progress, once=True).awaitTermination()
    assert [tuple(r) for r in store.ledger(spark).select("batch", "processed", "failed", "total").collect()] == [(0, 15, 5, 20)]
    # remains of a batch that never reached the ledger do not count, and are replaced
    spark.createDataFrame([(99, "done", 99)], RESULT).write.parquet(f"{store.folder}/results/batch=1")
    assert store.latest(spark, RESULT, ["item_id"]).count() == 20
    feed(spark, source, [(0, "done", 100), (50, "done", 50)])
    upsert_stream(stream(), store, progress, once=True).awaitTermination()
    found = {r["item_id"]: (r["status"], r["value"]) for r in store.latest(spark, RESULT, ["item_id"]).collect()}
    assert found == {k: (s, v) for k, s, v in first} | {0: ("done", 100), 50: ("done", 50)}
    assert store.ledger(spark).agg(F.sum("processed"), F.sum("failed"), F.sum("total")).first()[:] == (17, 5, 22)


def test_an_empty_store(spark, tmp_path):
    store = ResultStore(str(tmp_path))
    assert store.ledger(spark).count() == 0 and store.latest(spark, RESULT, ["item_id"]).count() == 0


def test_medians(spark):
    rng = random.Random(2)
    groups = {
        "distinct": [rng.random() * 100 for _ in range(20_001)], "even": [rng.random() for _ in range(500)], "one": [4.5], "two": [1.0, 2.0],
        "ties": [rng.choice((0.1, 0.2, 0.3)) for _ in range(999)], "wide": [10.0 ** rng.randrange(-300, 300) for _ in range(400)],
        "endless": [1.0, 2.0, float("inf"), float("inf")], None: [rng.gauss(0, 1) for _ in range(77)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = {r["g"]: r["median"] for r in selection.medians(df, ["g"], "v").collect()}
    assert found == {g: statistics.median(v) for g, v in groups.items()}


def test_profile_of_one_project_sorts_no_group(spark):
    rng = random.Random(1)
    times = [rng.random() * 50 for _ in range(3000)]
    items = spark.createDataFrame([("p", "done", t) for t in times] + [("p", "error", 1.0)], "project_id string, status string, inference_ms double")
    row = review.timing_profile(items, ["project_id"]).first()
    assert row["runs"] == 3000 and row["latency_ms"] == round(statistics.median(times), 2)
    (whole,) = review.timing_profile(items, []).collect()
    assert whole["latency_ms"] == row["latency_ms"]
