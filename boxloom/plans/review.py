"""The review queue: thresholds, filters, orders, pages and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions.numbers import py_round
from boxloom.functions.text import class_hue, class_ids, class_ids_browser, folder_label, match_key, safe_name
from boxloom.operators import review
from boxloom.operators.diff import comparable
from boxloom.plans.fixtures import Inputs
from boxloom.plans.registry import query

CLASS_ID = "CASE class_name WHEN 'AF' THEN 0 WHEN 'NF' THEN 1 WHEN 'NO' THEN 2 WHEN 'RF' THEN 3 ELSE 4 END"


@query("done_items", "SELECT * FROM items WHERE status = 'done'", "items")
def done_items(f: Inputs) -> DataFrame:
    return f.items().filter(F.col("status") == "done")


@query(
    "comparable_items",
    "SELECT * FROM items WHERE status = 'done' AND (detection_count > 0 OR baseline_count > 0)",
    "items",
)
def comparable_items(f: Inputs) -> DataFrame:
    return comparable(f.items())


@query(
    "visible_detections",
    "SELECT item_id, pos, class_name, confidence FROM current_set WHERE confidence >= 0.5e0",
    "current_set",
)
def visible_detections(f: Inputs) -> DataFrame:
    return review.visible(f.current(), 0.5).select("item_id", "pos", "class_name", "confidence")


@query(
    "class_filter",
    f"""SELECT item_id, pos, class_id FROM
(SELECT item_id, pos, {CLASS_ID} AS class_id FROM current_set) WHERE class_id IN (0, 2)""",
    "current_set",
)
def class_filter(f: Inputs) -> DataFrame:
    return review.keep_classes(with_class_id(f.current()), [2, 0, 2]).select("item_id", "pos", "class_id")


def with_class_id(detections: DataFrame) -> DataFrame:
    name = F.col("class_name")
    ids = F.when(name == "AF", 0).when(name == "NF", 1).when(name == "NO", 2).when(name == "RF", 3)
    return detections.withColumn("class_id", ids.otherwise(4))


CLASS_TEXT = """concat(CAST(floor(value) AS BIGINT) % 7, ', ', event_id % 5, ';', event_type, ',,', -(event_id % 3), 'x ', user_id % 4)"""


@query(
    "parse_classes",
    f"""WITH t AS (SELECT event_id, {CLASS_TEXT} AS classes FROM events),
s AS (SELECT event_id, classes, list_transform(string_split(replace(classes, ';', ','), ','), lambda x: trim(x)) AS parts FROM t),
b AS (SELECT event_id, list_transform(string_split_regex(classes, '[,;\\s]+'), lambda x: TRY_CAST(regexp_extract(x, '^[+-]?[0-9]+') AS BIGINT)) AS nums FROM t)
SELECT s.event_id, s.classes,
  array_to_string(list_sort(list_distinct(list_transform(list_filter(parts, lambda x: regexp_full_match(x, '[+-]?[0-9]+')), lambda x: CAST(x AS BIGINT)))), ',') AS server_ids,
  array_to_string(list_sort(list_distinct(list_filter(nums, lambda x: x >= 0))), ',') AS browser_ids
FROM s JOIN b ON b.event_id = s.event_id""",
)
def parse_classes(f: Inputs) -> DataFrame:
    text = F.concat(
        (F.col("value").cast("bigint") % 7).cast("string"), F.lit(", "),
        (F.col("event_id") % 5).cast("string"), F.lit(";"), F.col("event_type"), F.lit(",,"),
        (-(F.col("event_id") % 3)).cast("string"), F.lit("x "), (F.col("user_id") % 4).cast("string"),
    )
    return f.table("events").select("event_id", text.alias("classes")).select(
        "event_id",
        "classes",
        F.array_join(class_ids(F.col("classes")).cast("array<string>"), ",").alias("server_ids"),
        F.array_join(class_ids_browser(F.col("classes")).cast("array<string>"), ",").alias("browser_ids"),
    )


def _only(mode: str, where: str) -> None:
    @query(f"only_{mode}", f"SELECT * FROM items WHERE {where}", "items")
    def build(f: Inputs) -> DataFrame:
        return review.only(f.items(), mode)


_only("with", "detection_count > 0")
_only("without", "detection_count = 0 AND status = 'done'")
_only("error", "status = 'error'")
_only("disputed", "disputed > 0")
_only("agreed", "disputed = 0 AND baseline_count > 0")


@query("search_path", "SELECT item_id, rel_path FROM items WHERE rel_path ILIKE '%CAM_/b1%3.J%'", "items")
def search_path(f: Inputs) -> DataFrame:
    return review.search_path(f.items(), "CAM_/b1%3.J").select("item_id", "rel_path")


@query(
    "search_name",
    "SELECT item_id, rel_path FROM items WHERE contains(lower(regexp_extract(rel_path, '([^/]*)$', 1)), '39.j')",
    "items",
)
def search_name(f: Inputs) -> DataFrame:
    return review.search_name(f.items(), " 39.J ").select("item_id", "rel_path")


@query(
    "items_narrow",
    """SELECT item_id, rel_path, width, height, status, detail, task, inference_ms, review_priority,
       detection_count, baseline_count, disputed, agreement FROM items""",
    "items",
)
def items_narrow(f: Inputs) -> DataFrame:
    return review.narrow(f.items().withColumn("detections", F.array(F.lit("…")))).drop("project_id")


def _order(order: str, by: str) -> None:
    @query(f"order_{order}", "SELECT * FROM items", "items")
    def everything(f: Inputs) -> DataFrame:
        return review.ordered(f.items(), order)

    @query(f"page_{order}", f"SELECT item_id, rel_path FROM items ORDER BY {by}, item_id LIMIT 200", "items")
    def first_page(f: Inputs) -> DataFrame:
        return review.page(f.items(), order).select("item_id", "rel_path")

    @query(f"after_{order}", f"SELECT item_id, rel_path FROM items ORDER BY {by}, item_id LIMIT 200 OFFSET 777", "items")
    def page_after(f: Inputs) -> DataFrame:
        last = review.page(f.items(), order, offset=776, limit=1).first()
        if last is None:
            return f.items().select("item_id", "rel_path").filter(F.lit(False))
        return review.page_after_row(f.items(), order, last).select("item_id", "rel_path")


_order("path", "rel_path")
_order("priority", "review_priority DESC, rel_path")
_order("most", "detection_count DESC, rel_path")
_order("least", "detection_count, rel_path")
_order("disputed", "disputed DESC, agreement, rel_path")


@query(
    "page",
    "SELECT item_id, rel_path FROM items ORDER BY rel_path, item_id LIMIT 120 OFFSET 240",
    "items",
)
def page(f: Inputs) -> DataFrame:
    return review.page(f.items(), "path", offset=240, limit=120).select("item_id", "rel_path")


VISIBLE = """SELECT t.*, coalesce(c.n, 0) AS visible_count FROM items t
LEFT JOIN (SELECT item_id, count(*) AS n FROM current_set WHERE confidence >= 0.6e0 GROUP BY 1) c ON c.item_id = t.item_id"""


@query("visible_with", f"SELECT item_id, visible_count FROM ({VISIBLE}) WHERE visible_count > 0", "items current_set")
def visible_with(f: Inputs) -> DataFrame:
    counted = review.visible_counts(f.items(), f.current(), 0.6)
    return counted.filter(F.col("visible_count") > 0).select("item_id", "visible_count")


@query("visible_without", f"SELECT item_id, visible_count FROM ({VISIBLE}) WHERE visible_count = 0", "items current_set")
def visible_without(f: Inputs) -> DataFrame:
    counted = review.visible_counts(f.items(), f.current(), 0.6)
    return counted.filter(F.col("visible_count") == 0).select("item_id", "visible_count")


@query("order_visible", f"SELECT item_id, rel_path, visible_count FROM ({VISIBLE})", "items current_set")
def order_visible(f: Inputs) -> DataFrame:
    counted = review.visible_counts(f.items(), f.current(), 0.6)
    return counted.select("item_id", "rel_path", "visible_count").orderBy(
        F.desc("visible_count"), "rel_path"
    )


def _visible(order: str, by: str) -> None:
    @query(
        f"visible_page_{order}",
        f"SELECT item_id, rel_path, visible_count FROM ({VISIBLE}) ORDER BY {by}, rel_path, item_id LIMIT 200 OFFSET 100",
        "items current_set",
    )
    def visible_page(f: Inputs) -> DataFrame:
        counted = review.visible_counts(f.items(), f.current(), 0.6)
        return review.visible_page(counted, order, 100).select("item_id", "rel_path", "visible_count")


NAME = "regexp_extract(rel_path, '([^/]*)$', 1)"
_visible("most", "visible_count DESC")
_visible("least", "visible_count")
_visible("name", f"lower({NAME}), {NAME}")


@query("result_task", "SELECT coalesce(nullif((SELECT arg_min(task, item_id) FROM items WHERE status = 'done'), ''), 'detect') AS task", "items")
def result_task(f: Inputs) -> DataFrame:
    return review.result_task(f.items())


STATS = """count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS failed,
       count(*) FILTER (status = 'pending') AS pending, CAST(sum(detection_count) AS BIGINT) AS detections,
       CAST(printf('%.2f', avg(nullif(inference_ms, 0))) AS DOUBLE) AS average_ms"""


@query("project_stats", f"SELECT {STATS} FROM items", "items")
def project_stats(f: Inputs) -> DataFrame:
    return review.stats(f.items())


@query("progress", f"SELECT *, (done + failed) / CAST(total AS DOUBLE) AS progress FROM (SELECT project_id, {STATS} FROM items GROUP BY 1)", "items")
def progress(f: Inputs) -> DataFrame:
    return review.progress(review.stats(f.items(), ["project_id"]))


@query("class_counts", 'SELECT class_name, count(*) AS "count" FROM current_set GROUP BY 1', "current_set")
def class_counts(f: Inputs) -> DataFrame:
    return review.class_counts(f.current())


@query(
    "review_priority",
    """SELECT t.item_id, coalesce(max(1e0 - abs(c.confidence - 0.5e0) / 0.5e0), 1e0) AS review_priority
FROM items t LEFT JOIN current_set c ON c.item_id = t.item_id GROUP BY 1""",
    "items current_set",
)
def review_priority(f: Inputs) -> DataFrame:
    return review.review_priority(f.items(), f.current()).select("item_id", "review_priority")


@query(
    "task_score",
    """SELECT t.item_id, coalesce(CAST(printf('%.4f', avg(c.confidence)) AS DOUBLE), 0e0) AS score
FROM items t LEFT JOIN current_set c ON c.item_id = t.item_id GROUP BY 1""",
    "items current_set",
)
def task_score(f: Inputs) -> DataFrame:
    return review.task_score(f.items(), f.current())


@query(
    "threshold_summary",
    """SELECT x.threshold, CAST(sum(v) AS BIGINT) AS total, count(*) FILTER (v > 0) AS images_with_detections,
       count(*) AS "count", count(*) FILTER (status <> 'pending') AS processed,
       avg(CASE WHEN status = 'done' AND inference_ms <> 0 THEN inference_ms END) AS average_ms
FROM (SELECT t.item_id, t.status, t.inference_ms, h.threshold, count(c.item_id) AS v
      FROM items t CROSS JOIN (VALUES (0.1e0), (0.3e0), (0.5e0), (0.7e0), (0.9e0)) h(threshold)
      LEFT JOIN current_set c ON c.item_id = t.item_id AND c.confidence >= h.threshold GROUP BY ALL) x GROUP BY 1""",
    "items current_set",
)
def threshold_summary(f: Inputs) -> DataFrame:
    return review.threshold_summary(f.items(), f.current(), [0.1, 0.3, 0.5, 0.7, 0.9])


@query(
    "visible_class_counts",
    'SELECT class_name, count(*) AS "count" FROM current_set WHERE confidence >= 0.5e0 GROUP BY 1',
    "current_set",
)
def visible_class_counts(f: Inputs) -> DataFrame:
    return review.visible_class_counts(f.current(), 0.5)


@query(
    "timing_profile",
    """SELECT project_id, count(*) AS runs, CAST(printf('%.2f', median(inference_ms)) AS DOUBLE) AS latency_ms,
       CAST(printf('%.1f', 1000e0 / median(inference_ms)) AS DOUBLE) AS latency_fps,
       CAST(printf('%.2f', sum(inference_ms) / count(*)) AS DOUBLE) AS throughput_ms_per_image,
       CAST(printf('%.1f', 1000e0 / (sum(inference_ms) / count(*))) AS DOUBLE) AS throughput_fps
FROM items WHERE status = 'done' AND inference_ms > 0 GROUP BY 1""",
    "items",
)
def timing_profile(f: Inputs) -> DataFrame:
    return review.timing_profile(f.items(), ["project_id"])


@query(
    "folder_counts",
    "SELECT split_part(rel_path, '/', 1) AS name, count(*) AS image_count FROM items GROUP BY 1",
    "items",
)
def folder_counts(f: Inputs) -> DataFrame:
    return review.folder_counts(f.items())


@query(
    "detections_sorted",
    """SELECT item_id, pos, class_name, confidence, printf('%.1f%%', confidence * 100e0) AS percentage FROM current_set""",
    "current_set",
)
def detections_sorted(f: Inputs) -> DataFrame:
    return review.rank_by_confidence(f.current()).select(
        "item_id", "pos", "class_name", "confidence", "percentage"
    )


@query(
    "detections_json",
    f"""SELECT item_id, pos, concat('{{"class_name":"', class_name, '","confidence":', confidence, ',"kind":"box"',
       CASE WHEN id < 4 THEN concat(',"class_id":', id) ELSE '' END, ',"box":[', x1, ',', y1, ',', x2, ',', y2, ']}}') AS detection
FROM (SELECT *, {CLASS_ID} AS id FROM current_set)""",
    "current_set",
)
def detections_json(f: Inputs) -> DataFrame:
    detection = F.struct(
        "class_name",
        py_round(F.col("confidence"), 4).alias("confidence"),
        F.lit("box").alias("kind"),
        F.nullif("class_id", F.lit(4)).alias("class_id"),
        F.transform(F.array("x1", "y1", "x2", "y2"), lambda v: py_round(v, 2)).alias("box"),
    )
    return with_class_id(f.current()).select("item_id", "pos", F.to_json(detection).alias("detection"))


@query(
    "detections_serialised",
    f"""SELECT item_id, pos, concat('{{"class_name":"', class_name, '","confidence":', confidence, ',"kind":"',
       CASE WHEN pos % 3 = 0 THEN 'segmentation' WHEN pos % 3 = 1 THEN 'pose' ELSE 'box' END, '"',
       CASE WHEN id < 4 THEN concat(',"class_id":', id) ELSE '' END,
       CASE WHEN pos % 5 <> 4 THEN concat(',"box":[', x1, ',', y1, ',', x2, ',', y2, ']') ELSE '' END,
       CASE WHEN pos % 3 = 0 THEN concat(',"mask":[[', x1, ',', y1, '],[', x2, ',', y1, '],[', x2, ',', y2, ']]') ELSE '' END,
       CASE WHEN pos % 3 = 1 THEN concat(',"keypoints":[[', x1, ',', y2, ',2.0]]') ELSE '' END,
       CASE WHEN item_id % 2 = 0 THEN concat(',"track_id":', pos + 1) ELSE '' END, '}}') AS detection
FROM (SELECT *, {CLASS_ID} AS id FROM current_set)""",
    "current_set",
)
def detections_serialised(f: Inputs) -> DataFrame:
    place = F.col("pos") % 3
    mask = F.array(F.array("x1", "y1"), F.array("x2", "y1"), F.array("x2", "y2"))
    shaped = with_class_id(f.current()).withColumns({
        "class_id": F.nullif("class_id", F.lit(4)),
        "kind": F.when(place == 0, "segmentation").when(place == 1, "pose"),
        "mask": F.when(place == 0, mask),
        "keypoints": F.when(place == 1, F.array(F.array("x1", "y2", F.lit(2.0)))),
        "track_id": F.when(F.col("item_id") % 2 == 0, F.col("pos") + 1),
    })
    boxless = shaped.withColumns({c: F.when(F.col("pos") % 5 != 4, F.col(c)) for c in ("x1", "y1", "x2", "y2")})
    return boxless.select("item_id", "pos", review.serialised(boxless).alias("detection"))


@query(
    "result_row",
    """SELECT t.item_id, coalesce(c.n, 0) AS "count", CAST(printf('%.2f', t.inference_ms) AS DOUBLE) AS speed_ms,
       CAST(printf('%.3f', t.inference_ms / 8 + t.inference_ms + t.inference_ms / 4) AS DOUBLE) AS total_ms,
       CAST(printf('%.4f', coalesce(c.p, 1e0)) AS DOUBLE) AS review_priority, 1000e0 / nullif(t.inference_ms, 0) AS fps
FROM items t LEFT JOIN (SELECT item_id, count(*) AS n, max(1e0 - abs(confidence - 0.5e0) / 0.5e0) AS p
  FROM current_set GROUP BY 1) c ON c.item_id = t.item_id""",
    "items current_set",
)
def result_row(f: Inputs) -> DataFrame:
    from boxloom.operators.results import result_rows

    timed = f.items().withColumns(
        {"preprocess_ms": F.col("inference_ms") / 8, "postprocess_ms": F.col("inference_ms") / 4}
    )
    return result_rows(timed, f.current()).select(
        "item_id", "count", "speed_ms", "total_ms", "review_priority", "fps"
    )


@query(
    "source_set",
    """SELECT 'baseline' AS set_name, item_id, pos, class_name FROM baseline""",
    "baseline",
)
def source_set(f: Inputs) -> DataFrame:
    from boxloom.operators.training import source_set as op

    both = f.baseline().withColumn("set_name", F.lit("baseline")).unionByName(
        f.current().withColumn("set_name", F.lit("current"))
    )
    return op(both, "baseline").select("set_name", "item_id", "pos", "class_name")


@query(
    "clamp_settings",
    """SELECT o_orderkey, greatest(1, least(o_orderkey * 3, 1000)) AS epochs,
       CAST(greatest(32, round_even(greatest(32, least(o_orderkey * 7, 1280)) / 32e0, 0) * 32) AS BIGINT) AS imgsz,
       greatest(1, least(o_custkey - 5, 128)) AS batch,
       greatest(0.05e0, least((o_orderkey % 100) / 1e2, 0.5e0)) AS val_fraction,
       greatest(0e0, least((o_orderkey % 150 - 20) / 1e2, 1e0)) AS min_conf FROM orders""",
)
def clamp_settings(f: Inputs) -> DataFrame:
    from boxloom.operators.training import clamp_columns

    k = F.col("o_orderkey")
    raw = f.table("orders").select(
        "o_orderkey", (k * 3).alias("epochs"), (k * 7).alias("imgsz"),
        (F.col("o_custkey") - 5).alias("batch"),
        ((k % 100) / 100.0).alias("val_fraction"), ((k % 150 - 20) / 100.0).alias("min_conf"),
    )
    return clamp_columns(raw)


@query("match_key", r"""SELECT item_id, lower(regexp_extract(replace(concat('x\', rel_path), '\', '/'), '([^/]*)$', 1)) AS key FROM items""", "items")
def match_keys(f: Inputs) -> DataFrame:
    return f.items().select(
        "item_id", match_key(F.concat(F.lit("x\\"), F.col("rel_path"))).alias("key")
    )


@query(
    "safe_name",
    r"""SELECT page_id, nullif(left(trim(regexp_replace(regexp_extract(replace(n, '\', '/'), '([^/]*)$', 1),
       '[\x00-\x1f<>:"/\\|?*]', '_', 'g'), ' .'), 255), '') AS name
FROM (SELECT page_id, concat(url, '. ') AS n FROM pages)""",
)
def safe_names(f: Inputs) -> DataFrame:
    return f.table("pages").select(
        "page_id", safe_name(F.concat(F.col("url"), F.lit(". "))).alias("name")
    )


@query(
    "folder_label",
    r"""SELECT doc_id, coalesce(nullif(regexp_replace(text, '[^\p{L}\p{N} ._-]', '_', 'g'), ''), 'unknown') AS label FROM documents""",
)
def folder_labels(f: Inputs) -> DataFrame:
    return f.table("documents").select("doc_id", folder_label(F.col("text")).alias("label"))


@query(
    "class_hue",
    """SELECT p_name, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: unicode(c)::BIGINT)),
       lambda h, c: (h * 31 + c) % 360) AS INTEGER) AS hue FROM part""",
)
def class_hues(f: Inputs) -> DataFrame:
    return f.table("part").select("p_name", class_hue(F.col("p_name")).alias("hue"))


