"""Import, export and labelling-tool conversions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions.text import payload_bytes, payload_error
from boxloom.operators import exporting, importing, labeltools, naming
from boxloom.operators.lifecycle import existing_files
from boxloom.plans.fixtures import Inputs
from boxloom.plans.registry import query
from boxloom.session import shared_folder
from boxloom.sources import coco

MODEL = ["NF", "AF"]


def exact(expression: str, digits: int) -> str:
    """SQL rounding of the exact binary value, half-even."""
    return f"CAST(printf('%.{digits}f', {expression}) AS DOUBLE)"


def matched(f: Inputs) -> DataFrame:
    return importing.match_images(importing.clean_images(f.coco_images()), f.items())


def detections(f: Inputs) -> DataFrame:
    return importing.to_detections(
        importing.clean_annotations(f.coco_annotations()),
        importing.clean_categories(f.coco_categories()),
    )


@query("coco_tables", """SELECT 'category' AS part, id, CAST(NULL AS BIGINT) AS ord, name FROM cats
UNION ALL SELECT 'image', id, ord, file_name FROM imgs""", "cats imgs")
def coco_tables(f: Inputs) -> DataFrame:
    cats = importing.clean_categories(f.coco_categories())
    imgs = importing.clean_images(f.coco_images())
    return cats.select(
        F.lit("category").alias("part"), "id", F.lit(None).cast("bigint").alias("ord"), "name"
    ).unionByName(imgs.select(F.lit("image").alias("part"), "id", "ord", F.col("file_name").alias("name")))


@query(
    "import_documents",
    r"""WITH dealt AS (SELECT concat('d', ord % 2) AS doc_id, ord, id // 2 AS image_id, file_name FROM coco_image
  WHERE file_name IS NOT NULL),
latest AS (SELECT * FROM dealt QUALIFY row_number() OVER (PARTITION BY doc_id, image_id ORDER BY ord DESC) = 1),
owners AS (SELECT l.doc_id, l.image_id, k.item_id FROM latest l JOIN item_keys k
  ON k.key = lower(regexp_extract(replace(l.file_name, '\', '/'), '([^/]*)$', 1))),
named AS (SELECT concat('d', ord % 2) AS doc_id, id, coalesce(name, concat('class_', CAST(id AS VARCHAR))) AS name FROM coco_category
  QUALIFY row_number() OVER (PARTITION BY ord % 2, id ORDER BY ord DESC) = 1),
boxes AS (SELECT concat('d', image_id % 2) AS doc_id, image_id // 2 AS image_id, id, category_id, bx FROM coco_annotation
  WHERE bx IS NOT NULL)
SELECT b.doc_id, b.image_id, o.item_id, b.id AS annotation_id, b.bx AS x1,
       CASE WHEN b.category_id IS NULL THEN 'object'
            ELSE coalesce(c.name, concat('class_', CAST(b.category_id AS VARCHAR))) END AS class_name
FROM boxes b JOIN owners o ON o.doc_id = b.doc_id AND o.image_id = b.image_id
LEFT JOIN named c ON c.doc_id = b.doc_id AND c.id = b.category_id""",
    "coco_image coco_category coco_annotation item_keys",
)
def import_documents(f: Inputs) -> DataFrame:
    """Two documents that count their ids from the same start."""
    def dealt(df: DataFrame, by: str, halved: str | None = None) -> DataFrame:
        found = df.withColumn("doc_id", F.concat(F.lit("d"), (F.col(by) % 2).cast("string")))
        return found.withColumn(halved, F.expr(f"{halved} div 2")) if halved else found

    images, annotations, categories = importing.of_documents(
        dealt(f.coco_images(), "ord", "id"), dealt(f.coco_annotations(), "image_id", "image_id"),
        dealt(f.coco_categories(), "ord"),
    )
    found = importing.to_detections(importing.clean_annotations(annotations), importing.clean_categories(categories))
    owners = importing.hits(importing.match_images(importing.clean_images(images), f.items()))
    return owners.select("image_id", "item_id").join(found, "image_id").select(
        F.col("image_id.doc_id").alias("doc_id"), F.col("image_id.id").alias("image_id"), "item_id",
        F.col("ann_ord.id").alias("annotation_id"), "x1", "class_name",
    )


@query(
    "import_match",
    "SELECT i.id AS image_id, i.ord, i.file_name, k.item_id FROM imgs i LEFT JOIN item_keys k ON k.key = i.key",
    "imgs item_keys",
)
def import_match(f: Inputs) -> DataFrame:
    return matched(f).select("image_id", "ord", "file_name", "item_id")


@query(
    "import_unknown",
    """WITH u AS (SELECT i.ord, i.file_name FROM imgs i LEFT JOIN item_keys k ON k.key = i.key WHERE k.item_id IS NULL)
SELECT ord, file_name, (SELECT count(*) FROM u) AS unknown_file_count FROM u ORDER BY ord LIMIT 20""",
    "imgs item_keys",
)
def import_unknown(f: Inputs) -> DataFrame:
    return importing.unknown_report(matched(f))


@query("import_detections", "SELECT image_id, ann_ord, class_name, 1e0 AS confidence, 'box' AS kind, x1, y1, x2, y2 FROM dets", "dets")
def import_detections(f: Inputs) -> DataFrame:
    return detections(f).drop("mask", "keypoints")


@query(
    "import_replace",
    """SELECT * FROM imported UNION ALL SELECT * FROM current_set c
WHERE NOT EXISTS (SELECT 1 FROM winners w WHERE w.item_id = c.item_id)""",
    "imported current_set winners",
)
def import_replace(f: Inputs) -> DataFrame:
    return importing.import_replace(f.current(), matched(f), detections(f))


@query(
    "import_append",
    """SELECT * FROM current_set UNION ALL
SELECT h.item_id, coalesce(s.n, 0) + CAST(row_number() OVER (PARTITION BY h.item_id ORDER BY h.ord, d.ann_ord) AS BIGINT) - 1,
       d.class_name, 1e0, d.x1, d.y1, d.x2, d.y2
FROM hits h JOIN dets d ON d.image_id = h.image_id
LEFT JOIN (SELECT item_id, count(*) AS n FROM current_set GROUP BY 1) s ON s.item_id = h.item_id""",
    "current_set hits dets",
)
def import_append(f: Inputs) -> DataFrame:
    return importing.import_append(f.current(), matched(f), detections(f))


@query(
    "import_current",
    """SELECT t.item_id, t.rel_path, CASE WHEN w.item_id IS NULL THEN t.status ELSE 'done' END AS status,
       CASE WHEN w.item_id IS NULL THEN t.detail ELSE '' END AS detail,
       CASE WHEN w.item_id IS NULL OR t.task <> '' THEN t.task ELSE 'detect' END AS task,
       CASE WHEN w.item_id IS NULL THEN t.review_priority ELSE 0 END AS review_priority,
       CASE WHEN w.item_id IS NULL THEN t.detection_count ELSE coalesce(n.n, 0) END AS detection_count,
       coalesce(w.width, t.width) AS width, coalesce(w.height, t.height) AS height
FROM items t LEFT JOIN winners w ON w.item_id = t.item_id
LEFT JOIN (SELECT image_id, count(*) AS n FROM dets GROUP BY 1) n ON n.image_id = w.image_id""",
    "items winners dets",
)
def import_current(f: Inputs) -> DataFrame:
    return importing.import_current(f.items(), matched(f), detections(f)).select(
        "item_id", "rel_path", "status", "detail", "task", "review_priority", "detection_count",
        "width", "height",
    )


@query(
    "import_baseline",
    """SELECT t.item_id, CASE WHEN w.item_id IS NULL THEN t.baseline_count ELSE coalesce(n.n, 0) END AS baseline_count,
       t.disputed, t.agreement
FROM items t LEFT JOIN winners w ON w.item_id = t.item_id
LEFT JOIN (SELECT image_id, count(*) AS n FROM dets GROUP BY 1) n ON n.image_id = w.image_id""",
    "items winners dets",
)
def import_baseline(f: Inputs) -> DataFrame:
    return importing.import_baseline(f.items(), matched(f), detections(f)).select(
        "item_id", "baseline_count", "disputed", "agreement"
    )


@query(
    "import_summary",
    """WITH c AS (SELECT i.id, k.item_id, coalesce(n.n, 0) AS n FROM imgs i LEFT JOIN item_keys k ON k.key = i.key
  LEFT JOIN (SELECT image_id, count(*) AS n FROM dets GROUP BY 1) n ON n.image_id = i.id)
SELECT count(item_id) AS matched, count(*) - count(item_id) AS unmatched,
       CAST(sum(n) FILTER (item_id IS NOT NULL) AS BIGINT) AS annotations FROM c""",
    "imgs item_keys dets",
)
def import_summary(f: Inputs) -> DataFrame:
    return importing.import_summary(matched(f), detections(f))


@query(
    "import_summary_append",
    """WITH c AS (SELECT i.ord, k.item_id, coalesce(n.n, 0) AS n, coalesce(s.n, 0) AS had
  FROM imgs i LEFT JOIN item_keys k ON k.key = i.key
  LEFT JOIN (SELECT image_id, count(*) AS n FROM dets GROUP BY 1) n ON n.image_id = i.id
  LEFT JOIN (SELECT item_id, count(*) AS n FROM current_set GROUP BY 1) s ON s.item_id = k.item_id),
r AS (SELECT item_id, had + sum(n) OVER (PARTITION BY item_id ORDER BY ord) AS n FROM c)
SELECT count(item_id) AS matched, count(*) - count(item_id) AS unmatched,
       CAST(sum(n) FILTER (item_id IS NOT NULL) AS BIGINT) AS annotations FROM r""",
    "imgs item_keys dets current_set",
)
def import_summary_append(f: Inputs) -> DataFrame:
    return importing.import_summary(matched(f), detections(f), f.current())


@query(
    "unique_names",
    """SELECT item_id, rel_path, CASE WHEN row_number() OVER (PARTITION BY lower(regexp_extract(rel_path, '([^/]*)$', 1))
  ORDER BY rel_path) = 1 THEN regexp_extract(rel_path, '([^/]*)$', 1) ELSE replace(rel_path, '/', '__') END AS archive_name
FROM items""",
    "items",
)
def unique_names(f: Inputs) -> DataFrame:
    return naming.unique_names(f.items().select("item_id", "rel_path"))


@query(
    "uniquify_suffix",
    """SELECT item_id, CASE WHEN n = 1 THEN name ELSE regexp_replace(name, '[.]([^.]*)$', concat(' (', n, ').\\1')) END AS name
FROM (SELECT item_id, regexp_extract(rel_path, '([^/]*)$', 1) AS name,
      row_number() OVER (PARTITION BY lower(regexp_extract(rel_path, '([^/]*)$', 1)) ORDER BY item_id) AS n FROM items)""",
    "items",
)
def uniquify_suffix(f: Inputs) -> DataFrame:
    entries = f.items().select("item_id", F.substring_index("rel_path", "/", -1).alias("name"))
    return naming.number_repeats(entries, [F.col("item_id")])


@query("class_index", "SELECT class_name, class_index FROM class_ids", "class_ids")
def class_index(f: Inputs) -> DataFrame:
    return exporting.class_index(f.current(), MODEL)


def shaped(f: Inputs) -> DataFrame:
    """Detections with masks, keypoints and some missing boxes, per task."""
    pos, x1, y1, x2, y2 = (F.col(c) for c in ("pos", "x1", "y1", "x2", "y2"))
    half = F.col("confidence") / 2
    images = f.items().select("item_id", "width", "height")
    rows = f.current().join(images, "item_id")
    mask = F.array(F.array(x1, y1), F.array(x2, y1), F.array(x2, y2))
    points = F.when(
        pos % 3 == 0, F.array(F.array(x1, y1, F.col("confidence")), F.array(x2, y2, half))
    ).when(pos % 3 == 1, F.array(F.array(x1 + 0.125, y1)))
    k = F.col("item_id") % 4
    rows = rows.withColumns(
        {
            "task": F.when(k == 0, "detect").when(k == 1, "segment").when(k == 2, "pose").otherwise("classify"),
            "mask": F.when(pos % 2 == 0, mask),
            "keypoints": points,
        }
    )
    return rows.withColumns({c: F.when(pos % 5 != 4, F.col(c)) for c in ("x1", "y1", "x2", "y2")})


def listing(f: Inputs) -> DataFrame:
    return f.items().filter(F.col("item_id") % 13 != 0).select("rel_path")


@query("existing_files", "SELECT item_id, rel_path FROM items WHERE item_id % 13 <> 0", "items")
def existing(f: Inputs) -> DataFrame:
    return existing_files(f.items(), listing(f)).select("item_id", "rel_path")


@query("coco_ids", "SELECT item_id, image_id, file_name AS archive_name FROM done_names", "done_names")
def coco_ids(f: Inputs) -> DataFrame:
    return exporting.numbered_images(f.items()).select("item_id", "image_id", "archive_name")


@query("coco_images", "SELECT image_id AS id, file_name, width, height FROM done_names WHERE item_id % 13 <> 0", "done_names")
def coco_images(f: Inputs) -> DataFrame:
    return exporting.coco_images(exporting.numbered_images(f.items()), listing(f)).select(
        "id", "file_name", "width", "height"
    )


def coco_rows(f: Inputs) -> DataFrame:
    images = exporting.coco_images(exporting.numbered_images(f.items()), listing(f))
    return exporting.coco_annotations(
        images, shaped(f), exporting.class_index(f.current(), MODEL), 0.3
    )


@query(
    "coco_annotations",
    """SELECT id, image_id, category_id, x1 AS bbox_x, y1 AS bbox_y, x2 - x1 AS bbox_w, y2 - y1 AS bbox_h,
       (x2 - x1) * (y2 - y1) AS area, 0 AS iscrowd, CASE WHEN has_mask THEN 6 END AS polygon_values,
       CASE WHEN has_mask THEN x1 + y1 + x2 + y1 + x2 + y2 END AS polygon_sum FROM coco_rows""",
    "coco_rows",
)
def coco_annotations(f: Inputs) -> DataFrame:
    polygon = F.get("segmentation", F.lit(0))
    return coco_rows(f).select(
        "id", "image_id", "category_id",
        *[F.get("bbox", F.lit(i)).alias(f"bbox_{c}") for i, c in enumerate("xywh")],
        "area", "iscrowd",
        F.array_size(polygon).alias("polygon_values"),
        F.when(F.array_size(polygon) > 0, F.aggregate(polygon, F.lit(0.0), lambda a, v: a + v)).alias("polygon_sum"),
    )


@query(
    "coco_round_trip",
    """SELECT id, image_id, category_id, x1 AS bbox_x, y1 AS bbox_y, x2 - x1 AS bbox_w, y2 - y1 AS bbox_h FROM coco_rows""",
    "coco_rows",
)
def coco_round_trip(f: Inputs) -> DataFrame:
    """Exported as documents, read back from their files."""
    path = f"{shared_folder(f.spark)}/coco-{uuid.uuid4().hex}"
    images = exporting.coco_images(exporting.numbered_images(f.items()), listing(f))
    classes = exporting.class_index(f.current(), MODEL)
    rows = exporting.coco_annotations(images, shaped(f), classes, 0.3)
    coco.write_coco(images, rows, exporting.coco_categories(classes), path)
    _, annotations, _ = coco.read_coco(f.spark, path)
    return annotations.select(
        "id", "image_id", "category_id", *[F.get("bbox", F.lit(i)).alias(f"bbox_{c}") for i, c in enumerate("xywh")]
    )


@query(
    "coco_packed",
    """SELECT row_number() OVER (ORDER BY item_id, pos) AS id, item_id + 1 AS image_id, concat('crowd_', item_id, '.jpg') AS file_name,
       x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h, x1 AS key_x, CASE WHEN confidence > 0.5e0 THEN 2e0 WHEN confidence > 0 THEN 1e0 ELSE 0e0 END AS key_v,
       CAST(CASE WHEN confidence > 0 THEN 1 ELSE 0 END AS INTEGER) AS num_keypoints, 'kp0' AS key_name
FROM crowd""",
    "crowd",
)
def coco_packed(f: Inputs) -> DataFrame:
    """Images with very many annotations and keypoints, in documents of bounded size, each
    read back with the names of its keypoints."""
    path = f"{shared_folder(f.spark)}/packed-{uuid.uuid4().hex}"
    boxes = f.crowd().withColumn("keypoints", F.array(F.array("x1", "y1", "confidence")))
    images = boxes.select("item_id").distinct().select(
        (F.col("item_id") + 1).alias("id"), F.concat(F.lit("crowd_"), F.col("item_id").cast("string"), F.lit(".jpg")).alias("file_name"),
        F.lit(100_100).alias("width"), F.lit(200).alias("height"), "item_id",
    )
    classes = exporting.class_index(boxes, ["c0", "c1"])
    rows = exporting.coco_annotations(images, boxes, classes, 0.0)
    coco.write_packed(images.drop("item_id"), rows, exporting.coco_categories(classes, 1), path, entries=500)
    shown, drawn, named = coco.read_coco(f.spark, path)
    names = named.groupBy("doc_id").agg(F.min(F.get("keypoints", F.lit(0))).alias("key_name"))
    shown = shown.select("doc_id", F.col("id").alias("image_id"), "file_name")
    return drawn.join(shown, ["doc_id", "image_id"]).join(names, "doc_id").select(
        "id", "image_id", "file_name", *[F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")],
        F.get("keypoints", F.lit(0)).alias("key_x"), F.get("keypoints", F.lit(2)).alias("key_v"), "num_keypoints", "key_name",
    )


@query(
    "coco_keypoints",
    f"""WITH v AS (SELECT *, CASE WHEN has_scores AND confidence > 0.5e0 THEN 2e0 WHEN has_scores AND confidence > 0 THEN 1e0 ELSE 0e0 END AS v1,
       CASE WHEN confidence / 2 > 0.5e0 THEN 2e0 WHEN confidence > 0 THEN 1e0 ELSE 0e0 END AS v2 FROM coco_rows WHERE has_points)
SELECT id, image_id, 1 AS point, CASE WHEN has_scores THEN x1 ELSE {exact('x1 + 0.125e0', 2)} END AS x, y1 AS y, v1 AS visibility,
       CAST(CASE WHEN NOT has_scores THEN 0 ELSE (v1 > 0)::INT + (v2 > 0)::INT END AS INTEGER) AS num_keypoints FROM v
UNION ALL SELECT id, image_id, 2, x2, y2, v2, (v1 > 0)::INT + (v2 > 0)::INT FROM v WHERE has_scores""",
    "coco_rows",
)
def coco_keypoint_rows(f: Inputs) -> DataFrame:
    keys = F.col("keypoints")
    starts = F.filter(F.sequence(F.lit(0), F.array_size(keys)), lambda i: (i % 3 == 0) & (i < F.array_size(keys)))
    points = F.transform(
        starts,
        lambda i: F.struct(
            (i / 3 + 1).cast("int").alias("point"), F.get(keys, i).alias("x"),
            F.get(keys, i + 1).alias("y"), F.get(keys, i + 2).alias("visibility"),
        ),
    )
    return coco_rows(f).filter(F.array_size(keys) > 0).select(
        "id", "image_id", F.inline(points), "num_keypoints"
    )


@query("coco_categories", "SELECT class_index + 1 AS id, class_name AS name, '' AS supercategory FROM class_ids", "class_ids")
def coco_categories(f: Inputs) -> DataFrame:
    return exporting.coco_categories(exporting.class_index(f.current(), MODEL))


@query("keypoint_count", "SELECT CAST(max(CASE WHEN has_scores THEN 2 WHEN has_points THEN 1 ELSE 0 END) AS INTEGER) AS keypoint_count FROM shaped WHERE item_id IN (SELECT item_id FROM items WHERE status = 'done')", "shaped items")
def keypoint_count(f: Inputs) -> DataFrame:
    return exporting.keypoint_count(f.items(), shaped(f))


TOP1 = """SELECT t.item_id, coalesce(c.label, 'unknown') AS label FROM items t LEFT JOIN
 (SELECT item_id, class_name AS label FROM current_set WHERE confidence >= 0.4e0
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY pos) = 1) c ON c.item_id = t.item_id"""


@query("top1_label", TOP1, "items current_set")
def top1_label(f: Inputs) -> DataFrame:
    return exporting.top1_label(f.items().select("item_id"), f.current(), 0.4)


@query(
    "imagenet_manifest",
    f"""SELECT n.item_id, n.rel_path AS source, concat(l.label, '/', n.file_name) AS destination, l.label AS folder
FROM done_names n JOIN ({TOP1}) l ON l.item_id = n.item_id WHERE n.item_id % 13 <> 0""",
    "items current_set done_names",
)
def imagenet_manifest(f: Inputs) -> DataFrame:
    return exporting.imagenet_manifest(
        exporting.numbered_images(f.items()), listing(f), f.current(), 0.4
    )


@query(
    "export_summary",
    """SELECT (SELECT count(*) FROM done_names WHERE item_id % 13 <> 0) AS images, (SELECT count(*) FROM coco_rows) AS annotations""",
    "done_names coco_rows",
)
def export_summary(f: Inputs) -> DataFrame:
    images = exporting.coco_images(exporting.numbered_images(f.items()), listing(f))
    rows = exporting.annotation_rows(
        images, shaped(f), exporting.class_index(f.current(), MODEL), 0.3
    )
    return exporting.export_summary(images, rows)


PERCENT = {
    "x": exact("100e0 * x1 / width", 4), "y": exact("100e0 * y1 / height", 4),
    "w": exact("100e0 * (x2 - x1) / width", 4), "h": exact("100e0 * (y2 - y1) / height", 4),
}


@query(
    "percent_boxes",
    f"""SELECT item_id, pos, {PERCENT['x']} AS x, {PERCENT['y']} AS y, {PERCENT['w']} AS width, {PERCENT['h']} AS height
FROM shaped WHERE has_box""",
    "shaped",
)
def percent_boxes(f: Inputs) -> DataFrame:
    return labeltools.percent_boxes(shaped(f))


CVAT_KIND = """CASE WHEN task = 'segment' AND has_mask THEN 'polygon' WHEN task = 'pose' AND has_points THEN 'points'
 WHEN has_box THEN 'rectangle' WHEN task = 'classify' THEN 'tag' END"""


CVAT = f"""SELECT item_id, pos, CASE WHEN confidence = round(confidence, 1) THEN printf('%.1f', confidence) ELSE printf('%.2f', confidence) END AS confidence,
       class_name AS label, type, CAST(CASE type WHEN 'polygon' THEN 6 WHEN 'points' THEN CASE WHEN has_scores THEN 4 ELSE 2 END
         WHEN 'rectangle' THEN 4 ELSE 0 END AS INTEGER) AS n_points,
       CASE type WHEN 'tag' THEN NULL WHEN 'points' THEN CASE WHEN has_scores THEN x1 ELSE {exact('x1 + 0.125e0', 2)} END ELSE x1 END AS p0,
       CASE type WHEN 'tag' THEN NULL WHEN 'points' THEN CASE WHEN has_scores THEN x2 ELSE y1 END ELSE y1 END AS p1
FROM (SELECT *, {CVAT_KIND} AS type FROM shaped) WHERE type IS NOT NULL"""


@query("cvat_shapes", CVAT, "shaped")
def cvat_shapes(f: Inputs) -> DataFrame:
    return labeltools.cvat_shapes(shaped(f)).select(
        "item_id", "pos", "confidence", "label", "type", F.array_size("points").alias("n_points"),
        F.get("points", F.lit(0)).alias("p0"), F.get("points", F.lit(1)).alias("p1"),
    )


LS_KIND = """CASE WHEN task = 'classify' THEN 'choices' WHEN task = 'segment' AND has_mask THEN 'polygonlabels'
 WHEN task = 'pose' AND has_points THEN 'keypointlabels' WHEN has_box THEN 'rectanglelabels' END"""
LS = f"""SELECT item_id, pos, kind, CASE task WHEN 'segment' THEN 'PolygonLabels' WHEN 'pose' THEN 'KeyPointLabels'
    WHEN 'classify' THEN 'Choices' ELSE 'RectangleLabels' END AS from_name, 'image' AS to_name,
  CASE task WHEN 'segment' THEN 'polygonlabels' WHEN 'pose' THEN 'keypointlabels' WHEN 'classify' THEN 'choices'
    ELSE 'rectanglelabels' END AS type, width AS original_width, height AS original_height, 0 AS image_rotation,
  confidence AS score, class_name AS label,
  CASE kind WHEN 'rectanglelabels' THEN {PERCENT['x']}
    WHEN 'keypointlabels' THEN CASE WHEN has_scores THEN {PERCENT['x']} ELSE {exact('100e0 * (x1 + 0.125e0) / width', 4)} END END AS x,
  CASE WHEN kind IN ('rectanglelabels', 'keypointlabels') THEN {PERCENT['y']} END AS y,
  CASE kind WHEN 'rectanglelabels' THEN {PERCENT['w']} WHEN 'keypointlabels' THEN 0.5e0 END AS width,
  CASE kind WHEN 'rectanglelabels' THEN {PERCENT['h']} END AS height,
  CASE kind WHEN 'rectanglelabels' THEN 0e0 END AS rotation,
  CAST(CASE kind WHEN 'polygonlabels' THEN 3 END AS INTEGER) AS polygon_points
FROM (SELECT *, {LS_KIND} AS kind FROM shaped) WHERE kind IS NOT NULL"""


@query("ls_results", LS, "shaped")
def ls_results(f: Inputs) -> DataFrame:
    return labeltools.label_studio_results(shaped(f)).withColumn(
        "polygon_points", F.array_size("points")
    ).drop("points")


@query(
    "ls_predictions",
    f"""SELECT t.item_id, t.item_id % 6 <> 0 AS readable, e.pos, e.kind, e.label, e.x, e.y, e.score AS entry_score,
       CASE WHEN t.item_id % 6 = 0 THEN 0e0 ELSE coalesce(s.score, 0e0) END AS score, 'detector' AS model_version
FROM items t LEFT JOIN ({LS}) e ON e.item_id = t.item_id AND t.item_id % 6 <> 0
LEFT JOIN (SELECT item_id, {exact('avg(confidence)', 4)} AS score FROM shaped GROUP BY 1) s ON s.item_id = t.item_id""",
    "items shaped",
)
def ls_predictions(f: Inputs) -> DataFrame:
    k = F.col("item_id")
    tasks = f.items().select(
        "item_id",
        F.lit("").alias("image"),
        F.when(k % 6 != 0, F.base64(F.col("rel_path").cast("binary"))).alias("image_base64"),
        F.when(k % 12 == 0, "not base64!").alias("img"),
    )
    return labeltools.label_studio_predictions(tasks, shaped(f), "detector").select(
        "item_id", "readable", "pos", "kind", "label", "x", "y", "entry_score", "score", "model_version"
    )


@query(
    "ls_entries",
    f"""SELECT item_id, pos, kind, from_name, to_name, type, original_width, original_height, image_rotation, x, y, width, height,
       rotation, polygon_points FROM ({LS}) WHERE item_id % 6 <> 0""",
    "shaped",
)
def ls_entries(f: Inputs) -> DataFrame:
    payload = F.when(F.col("item_id") % 6 != 0, F.base64(F.col("rel_path").cast("binary")))
    tasks = f.items().select("item_id", payload.alias("image"), *[F.lit("").alias(c) for c in ("image_base64", "img")])
    found = labeltools.label_studio_predictions(tasks, shaped(f), "detector").filter(F.col("pos").isNotNull())
    return found.withColumn("polygon_points", F.array_size("points")).drop(
        "points", "readable", "label", "entry_score", "score", "model_version"
    )


@query(
    "label_spec",
    """SELECT model, CAST(id AS INTEGER) AS id, name, CASE task WHEN 'segment' THEN 'polygon' WHEN 'pose' THEN 'points' ELSE 'rectangle' END AS type
FROM (SELECT p_brand AS model, p_size AS id, min(p_type) AS name,
      CASE p_brand WHEN 'Brand#1' THEN 'segment' WHEN 'Brand#2' THEN 'pose' WHEN 'Brand#3' THEN 'obb' ELSE 'detect' END AS task
      FROM part GROUP BY p_brand, p_size)""",
)
def label_spec(f: Inputs) -> DataFrame:
    brand = F.col("model")
    task = F.when(brand == "Brand#1", "segment").when(brand == "Brand#2", "pose").when(brand == "Brand#3", "obb")
    names = f.table("part").groupBy(F.col("p_brand").alias("model"), F.col("p_size").alias("id")).agg(
        F.min("p_type").alias("name")
    )
    # One map per model: its size is that of a model's class list.
    models = names.select(
        "model", task.otherwise("detect").alias("task"), F.create_map("id", "name").alias("class_names")
    )
    return labeltools.label_spec(models)


PAYLOAD = """CASE WHEN page_id % 5 = 0 THEN concat(to_base64(encode(url)), '*') WHEN page_id % 7 = 0 THEN ''
 WHEN page_id % 3 = 0 THEN to_base64(encode(html)) ELSE concat('data:text/html;base64,', to_base64(encode(html))) END"""


@query(
    "payload_decode",
    f"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'malformed base64 data' WHEN page_id % 7 = 0 THEN 'missing image data'
   WHEN length(to_base64(encode(html))) * 3 // 4 > 2097152 THEN 'exceeds the 2 MB limit' END AS error,
   CASE WHEN page_id % 5 = 0 OR page_id % 7 = 0 THEN NULL ELSE strlen(html) END AS bytes,
   CASE WHEN page_id % 5 = 0 OR page_id % 7 = 0 THEN NULL ELSE md5(html) END AS digest FROM pages""",
)
def payload_decode(f: Inputs) -> DataFrame:
    k = F.col("page_id")
    html = F.base64(F.col("html").cast("binary"))
    clean = F.regexp_replace(html, r"\s", "")
    payload = (
        F.when(k % 5 == 0, F.concat(F.base64(F.col("url").cast("binary")), F.lit("*")))
        .when(k % 7 == 0, "")
        .when(k % 3 == 0, clean)
        .otherwise(F.concat(F.lit("data:text/html;base64,"), clean))
    )
    raw = F.nullif(payload_bytes(F.col("payload")), F.lit(b""))
    return f.table("pages").select("page_id", payload.alias("payload")).select(
        "page_id",
        payload_error(F.col("payload"), 2 * 2**20).alias("error"),
        F.octet_length(raw).cast("bigint").alias("bytes"),
        F.md5(raw).alias("digest"),
    )


@query(
    "task_payload",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN html
   WHEN page_id % 2 = 0 THEN concat('x', url) END AS payload FROM pages""",
)
def task_payload(f: Inputs) -> DataFrame:
    k = F.col("page_id")
    tasks = f.table("pages").select(
        "page_id",
        F.when(k % 3 == 0, F.col("url")).when(k % 3 == 1, "").alias("image"),
        F.when(k % 3 == 1, F.col("html")).otherwise("").alias("image_base64"),
        F.when(k % 2 == 0, F.concat(F.lit("x"), F.col("url"))).alias("img"),
    )
    return labeltools.task_payload(tasks).select("page_id", "payload")
