"""Thresholds, filters, orders and roll-ups of the review queue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from boxloom.functions.numbers import margin_priority, py_round
from boxloom.functions.text import base_name, contains_like
from boxloom.operators.selection import medians
from boxloom.schema import DEFAULT_PAGE, MAX_PAGE


def is_visible(confidence: Column, threshold: float) -> Column:
    """A detection without a confidence counts as certain."""
    return F.coalesce(confidence, F.lit(1.0)) >= F.lit(float(threshold))


def visible(detections: DataFrame, threshold: float) -> DataFrame:
    return detections.filter(is_visible(F.col("confidence"), threshold))


def visible_array(detections: Column, threshold: float) -> Column:
    """The same threshold on a nested array of detections."""
    return F.filter(detections, lambda d: is_visible(d["confidence"], threshold))


def keep_classes(detections: DataFrame, class_ids: Sequence[int] | None) -> DataFrame:
    """Keep some class ids; an empty list keeps everything."""
    ids = sorted({int(i) for i in class_ids or ()})
    return detections.filter(F.col("class_id").isin(ids)) if ids else detections


def only(items: DataFrame, mode: str | None) -> DataFrame:
    """One of the queue's named filters; an unknown name filters nothing."""
    found, status = F.col("detection_count"), F.col("status")
    filters = {
        "with": found > 0,
        "without": (found == 0) & (status == "done"),
        "error": status == "error",
        "disputed": F.col("disputed") > 0,
        "agreed": (F.col("disputed") == 0) & (F.col("baseline_count") > 0),
    }
    return items.filter(filters[mode]) if mode in filters else items


def search_path(items: DataFrame, term: str | None) -> DataFrame:
    return items.filter(contains_like(F.col("rel_path"), term)) if term else items


def search_name(items: DataFrame, term: str) -> DataFrame:
    wanted = term.strip().lower()
    if not wanted:
        return items
    return items.filter(F.lower(base_name(F.col("rel_path"))).contains(wanted))


def narrow(items: DataFrame) -> DataFrame:
    """Counts without the annotation arrays: the scan never reads those columns."""
    return items.drop("detections", "baseline")


#: Leading sort columns of the named orders, and whether they fall.
_ORDERS = {
    "priority": [("review_priority", True)],
    "most": [("detection_count", True)],
    "least": [("detection_count", False)],
    "disputed": [("disputed", True), ("agreement", False)],
}


def _keys(order: str) -> list[tuple[str, bool]]:
    return [*_ORDERS.get(order, []), ("rel_path", False), ("item_id", False)]


def sort_keys(order: str) -> list[Column]:
    """Sort columns of a named order; an unknown name sorts by path."""
    return [F.desc(name) if falls else F.asc(name) for name, falls in _keys(order)]


def ordered(items: DataFrame, order: str) -> DataFrame:
    return items.orderBy(*sort_keys(order))


def page(items: DataFrame, order: str = "path", offset: int = 0, limit: int = DEFAULT_PAGE) -> DataFrame:
    """One page of the queue. Only ``offset + limit`` rows leave each task."""
    size = max(1, min(int(limit), MAX_PAGE))
    return ordered(items, order).offset(max(0, int(offset))).limit(size)


def page_after(items: DataFrame, last_path: str, limit: int = DEFAULT_PAGE) -> DataFrame:
    """The page following a path: deep paging without counting rows off."""
    return page(items.filter(F.col("rel_path") > last_path), "path", 0, limit)


def _beyond(name: str, falls: bool, value: object) -> Column:
    """Values that come after ``value``; nulls are the smallest values of either direction."""
    column = F.col(name)
    if falls:
        return F.lit(False) if value is None else column.isNull() | (column < F.lit(value))
    return column.isNotNull() if value is None else column > F.lit(value)


def rows_after(items: DataFrame, order: str, last: Row | Mapping[str, object]) -> DataFrame:
    """The rows that follow the row ``last`` in a named order.

    ``last`` has the order's sort columns. The bound on the leading column stands alone
    as well, so it reaches the scan: on a table written by :func:`clustered`, row groups
    before the page are not read.
    """
    values = last.asDict() if isinstance(last, Row) else dict(last)
    keys = _keys(order)
    after, same = F.lit(False), F.lit(True)
    for name, falls in keys:
        after = after | (same & _beyond(name, falls, values[name]))
        same = same & F.col(name).eqNullSafe(F.lit(values[name]))
    lead, falls = keys[0]
    value = values[lead]
    if value is None:
        return items.filter(F.col(lead).isNull() & after if falls else after)
    column = F.col(lead)
    bound = column.isNull() | (column <= F.lit(value)) if falls else column >= F.lit(value)
    return items.filter(bound & after)


def page_after_row(
    items: DataFrame, order: str, last: Row | Mapping[str, object], limit: int = DEFAULT_PAGE
) -> DataFrame:
    """The page that follows a given row: its cost does not grow with its depth."""
    return page(rows_after(items, order, last), order, 0, limit)


def clustered(items: DataFrame, order: str) -> DataFrame:
    """The rows range-partitioned and sorted by a named order. Written as Parquet, every
    file holds one range, whose bounds let :func:`rows_after` skip it."""
    keys = sort_keys(order)
    return items.repartitionByRange(*keys).sortWithinPartitions(*keys)


def visible_keys(order: str) -> list[Column]:
    """Sort columns of the batch view: ``most`` or ``least`` visible detections, or
    ``name`` without regard to case; ties by path."""
    leads = {"most": [F.desc("visible_count")], "least": [F.asc("visible_count")]}
    named = base_name(F.col("rel_path"))
    return [*leads.get(order, [F.lower(named), named]), F.asc("rel_path"), F.asc("item_id")]


def visible_page(counted: DataFrame, order: str, offset: int = 0, limit: int = DEFAULT_PAGE) -> DataFrame:
    """A page of :func:`visible_counts` in one of the orders of the batch view."""
    return counted.orderBy(*visible_keys(order)).offset(offset).limit(limit)


def visible_counts(items: DataFrame, detections: DataFrame, threshold: float) -> DataFrame:
    """Items with the number of detections that survive the threshold."""
    counts = visible(detections, threshold).groupBy("item_id").agg(F.count("*").alias("visible_count"))
    return items.join(counts, "item_id", "left").withColumn(
        "visible_count", F.coalesce("visible_count", F.lit(0))
    )


def two_sided_counts(items: DataFrame, current: DataFrame, baseline: DataFrame, threshold: float):
    """Visible objects on both sides beside the stored verdict, which stays put."""
    shown = F.count_if(is_visible(F.col("confidence"), threshold))
    c = current.groupBy("item_id").agg(shown.alias("_c"))
    b = baseline.groupBy("item_id").agg(shown.alias("_b"), F.count("*").alias("_total"))
    differs = F.when(
        F.col("disputed") > 0, F.concat(F.col("disputed").cast("string"), F.lit(" differ"))
    ).otherwise("identical")
    return (
        items.select("item_id", "disputed")
        .join(c, "item_id", "left")
        .join(b, "item_id", "left")
        .select(
            "item_id",
            F.coalesce("_c", F.lit(0)).alias("shown"),
            F.coalesce("_b", F.lit(0)).alias("baseline_shown"),
            F.when(F.col("_total") > 0, differs).alias("verdict"),
        )
    )


def stats(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals of a project, or of each group in ``by``."""
    status = F.col("status")
    return items.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(status == "done").alias("done"),
        F.count_if(status == "error").alias("failed"),
        F.count_if(status == "pending").alias("pending"),
        F.coalesce(F.sum("detection_count"), F.lit(0)).alias("detections"),
        F.coalesce(
            py_round(F.avg(F.nullif(F.col("inference_ms"), F.lit(0.0))), 2), F.lit(0.0)
        ).alias("average_ms"),
    )


def progress(totals: DataFrame) -> DataFrame:
    """Share of the images that are finished, successfully or not."""
    share = (F.col("done") + F.col("failed")) / F.nullif(F.col("total"), F.lit(0))
    return totals.withColumn("progress", F.coalesce(share, F.lit(0.0)))


def class_counts(detections: DataFrame) -> DataFrame:
    return (
        detections.groupBy(F.coalesce("class_name", F.lit("?")).alias("class_name"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "class_name")
    )


def review_priority(items: DataFrame, detections: DataFrame) -> DataFrame:
    """Margin sampling per image; an image without detections scores 1."""
    best = detections.groupBy("item_id").agg(
        F.max(margin_priority(F.coalesce("confidence", F.lit(1.0)))).alias("_best")
    )
    return items.join(best, "item_id", "left").select(
        *[c for c in items.columns if c != "review_priority"],
        F.coalesce("_best", F.lit(1.0)).alias("review_priority"),
    )


def task_score(items: DataFrame, detections: DataFrame) -> DataFrame:
    """Mean confidence per image, 0 without detections."""
    mean = detections.groupBy("item_id").agg(F.avg("confidence").alias("_mean"))
    return items.join(mean, "item_id", "left").select(
        "item_id", F.coalesce(py_round(F.col("_mean"), 4), F.lit(0.0)).alias("score")
    )


def threshold_summary(items: DataFrame, detections: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Visible totals, images showing anything and timings for each threshold.

    Per image only the counts at every threshold are kept, so one pass over the
    detections serves the whole sweep.
    """
    steps = [float(t) for t in thresholds]
    per_item = detections.groupBy("item_id").agg(
        *[F.count_if(is_visible(F.col("confidence"), t)).alias(f"_v{n}") for n, t in enumerate(steps)]
    )
    joined = items.join(per_item, "item_id", "left")
    done_ms = F.when(F.col("status") == "done", F.nullif(F.col("inference_ms"), F.lit(0.0)))
    wide = joined.agg(
        F.count("*").alias("count"),
        F.count_if(F.col("status") != "pending").alias("processed"),
        F.coalesce(F.avg(done_ms), F.lit(0.0)).alias("average_ms"),
        *[F.coalesce(F.sum(f"_v{n}"), F.lit(0)).alias(f"_t{n}") for n in range(len(steps))],
        *[F.count_if(F.col(f"_v{n}") > 0).alias(f"_w{n}") for n in range(len(steps))],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("threshold"),
                F.col(f"_t{n}").alias("total"),
                F.col(f"_w{n}").alias("images_with_detections"),
            )
            for n, t in enumerate(steps)
        ]
    )
    return wide.select(F.inline(rows), "count", "processed", "average_ms")


def visible_class_counts(detections: DataFrame, threshold: float) -> DataFrame:
    return class_counts(visible(detections, threshold))


def timing_profile(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median latency and mean throughput of recorded inference times."""
    ms = F.col("inference_ms")
    timed = items.filter((F.col("status") == "done") & (ms > 0)).select(*by, F.lit(0).alias("_all"), ms.alias("ms"))
    keys = [*by, "_all"]
    means = timed.groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(
        F.count("*").alias("runs"), (F.sum("ms") / F.count("*")).alias("_throughput")
    )
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    return medians(timed, keys, "ms").join(means, on).select(
        *by,
        "runs",
        py_round(F.col("median"), 2).alias("latency_ms"),
        py_round(F.lit(1000.0) / F.col("median"), 1).alias("latency_fps"),
        py_round(F.col("_throughput"), 2).alias("throughput_ms_per_image"),
        py_round(F.lit(1000.0) / F.col("_throughput"), 1).alias("throughput_fps"),
    )


def result_task(items: DataFrame, fallback: str = "detect") -> DataFrame:
    """The task of the first done item decides how results are exported."""
    first = F.min_by("task", "item_id")
    return items.filter(F.col("status") == "done").agg(
        F.coalesce(F.nullif(first, F.lit("")), F.lit(fallback)).alias("task")
    )


def folder_counts(items: DataFrame) -> DataFrame:
    """Images below each top-level folder, in case-insensitive name order.

    Images in no folder are counted under the name ``''``, so the counts add up to all.
    """
    folder = F.when(F.col("rel_path").contains("/"), F.substring_index("rel_path", "/", 1)).otherwise("")
    return (
        items.groupBy(folder.alias("name"))
        .agg(F.count("*").alias("image_count"))
        .orderBy(F.lower("name"), "name")
    )


def rank_by_confidence(detections: DataFrame) -> DataFrame:
    """Detections of each image, most confident first, with the shown percentage."""
    return detections.withColumn(
        "percentage",
        F.format_string("%.1f%%", py_round(F.col("confidence") * F.lit(100.0), 1)),
    ).orderBy("item_id", F.desc("confidence"), "pos")


def serialised(detections: DataFrame) -> Column:
    """A detection as the JSON text of a stored result; parts without a value are left out.

    Takes ``class_name, confidence`` and, where the columns exist, ``kind``, ``class_id``,
    the box ``x1, y1, x2, y2``, ``mask`` and ``keypoints`` (arrays of points) and ``track_id``.
    """
    has = set(detections.columns)
    kind = F.coalesce("kind", F.lit("box")) if "kind" in has else F.lit("box")
    parts = [F.col("class_name"), py_round(F.col("confidence"), 4).alias("confidence"), kind.alias("kind")]
    if "class_id" in has:
        parts.append(F.col("class_id").cast("bigint").alias("class_id"))
    if "x1" in has:
        box = F.transform(F.array("x1", "y1", "x2", "y2"), lambda v: py_round(v, 2))
        parts.append(F.when(F.col("x1").isNotNull(), box).alias("box"))
    parts += [F.col(name) for name in ("mask", "keypoints") if name in has]
    if "track_id" in has:
        parts.append(F.col("track_id").cast("bigint").alias("track_id"))
    return F.to_json(F.struct(*parts))
