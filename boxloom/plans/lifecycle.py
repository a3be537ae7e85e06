"""Registering, saving, resetting and recovering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.operators import lifecycle, review
from boxloom.plans.fixtures import Inputs
from boxloom.plans.registry import query
from boxloom.plans.review import STATS
from boxloom.schema import THUMBNAIL_EDGE
from boxloom.sources.coco import document_tables, parse_documents
from boxloom.sources.folder import keep_images
from boxloom.sources.stored import explode_detections, parse_detections

LISTING = """SELECT o_orderkey, concat(
    CASE o_orderkey % 11 WHEN 0 THEN '.git/' WHEN 1 THEN 'a/node_modules/' WHEN 2 THEN 'x/.cache/' WHEN 3 THEN 'a/_kept/' ELSE 'a/b/' END,
    CASE WHEN o_orderkey % 13 = 0 THEN '.jpg' ELSE concat('img', o_orderkey) END,
    CASE o_orderkey % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.webp' WHEN 2 THEN '.txt' WHEN 3 THEN '.tar.tiff' ELSE '' END) AS rel_path,
  CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE o_orderkey END AS size FROM orders"""


@query(
    "scan_images",
    f"""SELECT rel_path, size FROM ({LISTING}) WHERE size > 0 AND NOT regexp_matches(rel_path, '(^|/)([.][^/]*|node_modules)/')
 AND regexp_matches(lower(rel_path), '[^/][.](jpg|jpeg|png|bmp|webp|tiff|tif)$')""",
)
def scan_images(f: Inputs) -> DataFrame:
    k = F.col("o_orderkey")
    folder = (
        F.when(k % 11 == 0, ".git/").when(k % 11 == 1, "a/node_modules/").when(k % 11 == 2, "x/.cache/")
        .when(k % 11 == 3, "a/_kept/").otherwise("a/b/")
    )
    name = F.when(k % 13 == 0, ".jpg").otherwise(F.concat(F.lit("img"), k.cast("string")))
    ending = F.when(k % 5 == 0, ".JPG").when(k % 5 == 1, ".webp").when(k % 5 == 2, ".txt").when(k % 5 == 3, ".tar.tiff")
    listing = f.table("orders").select(
        F.concat(folder, name, ending.otherwise("")).alias("rel_path"),
        F.when(k % 17 == 0, 0).otherwise(k).alias("size"),
    )
    return keep_images(listing)


@query(
    "rescan_new",
    """SELECT DISTINCT project_id, concat(rel_path, CASE WHEN item_id % 4 = 0 THEN '' ELSE '.png' END) AS rel_path
FROM items WHERE item_id % 4 <> 0""",
    "items",
)
def rescan_new(f: Inputs) -> DataFrame:
    items = f.items()
    path = F.when(F.col("item_id") % 4 == 0, F.col("rel_path")).otherwise(F.concat("rel_path", F.lit(".png")))
    found = items.select("project_id", path.alias("rel_path"))
    return lifecycle.rescan_new(items, found.unionByName(found))


@query("pending_items", "SELECT item_id, rel_path FROM items WHERE item_id % 3 <> 0", "items")
def pending_items(f: Inputs) -> DataFrame:
    items = f.items()
    return lifecycle.pending_items(items, items.filter(F.col("item_id") % 3 == 0)).select("item_id", "rel_path")


RUNS = """SELECT l_orderkey AS item_id, ((l_linenumber * 100000000 + l_partkey) * 1000000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS run_id,
       CASE WHEN l_partkey % 5 = 0 THEN repeat(concat('bad file ', l_suppkey, ' '), 60) END AS error,
       CAST(100 + l_partkey % 50 AS INTEGER) AS width, CAST(100 + l_suppkey % 50 AS INTEGER) AS height,
       'detect' AS task, l_quantity AS inference_ms, l_discount AS review_priority, l_partkey % 6 AS detection_count FROM lineitem"""


@query(
    "results_upsert",
    f"""SELECT t.item_id, CASE WHEN r.error IS NOT NULL THEN 'error' WHEN r.item_id IS NOT NULL THEN 'done' ELSE t.status END AS status,
       CASE WHEN r.error IS NOT NULL THEN left(r.error, 500) WHEN r.item_id IS NOT NULL THEN '' ELSE t.detail END AS detail,
       CASE WHEN r.item_id IS NULL OR r.error IS NOT NULL THEN t.width ELSE r.width END AS width,
       CASE WHEN r.item_id IS NULL OR r.error IS NOT NULL THEN t.inference_ms ELSE r.inference_ms END AS inference_ms,
       CASE WHEN r.item_id IS NULL OR r.error IS NOT NULL THEN t.detection_count ELSE r.detection_count END AS detection_count
FROM items t LEFT JOIN (SELECT * FROM ({RUNS}) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY run_id DESC) = 1) r
  ON r.item_id = t.item_id""",
    "items",
)
def results_upsert(f: Inputs) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    text = F.repeat(F.concat(F.lit("bad file "), s.cast("string"), F.lit(" ")), 60)
    results = f.table("lineitem").select(
        F.col("l_orderkey").alias("item_id"),
        (((F.col("l_linenumber").cast("bigint") * 100000000 + p) * 1000000 + s) * 100
         + F.col("l_quantity").cast("bigint")).alias("run_id"),
        F.when(p % 5 == 0, text).alias("error"),
        (100 + p % 50).cast("int").alias("width"),
        (100 + s % 50).cast("int").alias("height"),
        F.lit("detect").alias("task"),
        F.col("l_quantity").alias("inference_ms"),
        F.col("l_discount").alias("review_priority"),
        (p % 6).alias("detection_count"),
    )
    return lifecycle.results_upsert(f.items(), results).select(
        "item_id", "status", "detail", "width", "inference_ms", "detection_count"
    )


@query(
    "reset_items",
    """SELECT item_id, rel_path, width, height, 'pending' AS status, '' AS detail, '' AS task, 0e0 AS inference_ms,
       0e0 AS review_priority, CAST(0 AS BIGINT) AS detection_count, baseline_count, CAST(0 AS BIGINT) AS disputed,
       0e0 AS agreement FROM items""",
    "items",
)
def reset_items(f: Inputs) -> DataFrame:
    return lifecycle.reset_items(f.items()).drop("project_id")


@query(
    "capture_baseline",
    """SELECT item_id, status, CASE WHEN status = 'done' THEN detection_count ELSE baseline_count END AS baseline_count,
       CASE WHEN status = 'done' THEN 0 ELSE disputed END AS disputed,
       CASE WHEN status = 'done' THEN 1e0 ELSE agreement END AS agreement FROM items""",
    "items",
)
def capture_baseline(f: Inputs) -> DataFrame:
    return lifecycle.capture_baseline(f.items()).select(
        "item_id", "status", "baseline_count", "disputed", "agreement"
    )


@query(
    "capture_set",
    """SELECT b.* FROM baseline b LEFT JOIN items t ON t.item_id = b.item_id AND t.status = 'done' WHERE t.item_id IS NULL
UNION ALL SELECT c.* FROM current_set c JOIN items t ON t.item_id = c.item_id AND t.status = 'done'""",
    "baseline current_set items",
)
def capture_set(f: Inputs) -> DataFrame:
    return lifecycle.capture_set(f.items(), f.current(), f.baseline())


@query(
    "clear_baseline",
    "SELECT item_id, CAST(0 AS BIGINT) AS baseline_count, CAST(0 AS BIGINT) AS disputed, 1e0 AS agreement, detection_count FROM items",
    "items",
)
def clear_baseline(f: Inputs) -> DataFrame:
    return lifecycle.clear_baseline(f.items()).select(
        "item_id", "baseline_count", "disputed", "agreement", "detection_count"
    )


@query(
    "baseline_size",
    "SELECT count(*) FILTER (baseline_count > 0) AS baseline_items, count(*) FILTER (baseline_count > 0) > 0 AS available FROM items",
    "items",
)
def baseline_size(f: Inputs) -> DataFrame:
    return lifecycle.baseline_size(f.items())


def projects(f: Inputs) -> DataFrame:
    """Customers as projects."""
    k = F.col("c_custkey")
    return f.table("customer").select(
        F.concat(F.lit("p"), k.cast("string")).alias("project_id"),
        F.col("c_name").alias("name"),
        F.when(k % 4 == 0, "running").when(k % 4 == 1, "done").otherwise("new").alias("status"),
        F.when(k % 4 == 1, "ok").otherwise("").alias("detail"),
        F.when(k % 6 == 0, "running").when(k % 6 == 1, "done").otherwise("").alias("training_status"),
        F.lit("").alias("training_detail"),
        (k * 37 % 1009).alias("updated_at"),
    )


PROJECTS = """SELECT concat('p', c_custkey) AS project_id, c_name AS name,
       CASE c_custkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'done' ELSE 'new' END AS status,
       CASE WHEN c_custkey % 4 = 1 THEN 'ok' ELSE '' END AS detail,
       CASE c_custkey % 6 WHEN 0 THEN 'running' WHEN 1 THEN 'done' ELSE '' END AS training_status,
       c_custkey * 37 % 1009 AS updated_at FROM customer"""


@query(
    "recover_runs",
    f"""SELECT project_id, CASE status WHEN 'running' THEN 'cancelled' ELSE status END AS status,
       CASE status WHEN 'running' THEN 'interrupted by a restart; run again to continue' ELSE detail END AS detail,
       CASE training_status WHEN 'running' THEN 'failed' ELSE training_status END AS training_status,
       CASE training_status WHEN 'running' THEN 'interrupted by a restart' ELSE '' END AS training_detail
FROM ({PROJECTS})""",
)
def recover_runs(f: Inputs) -> DataFrame:
    return lifecycle.recover_runs(projects(f)).select(
        "project_id", "status", "detail", "training_status", "training_detail"
    )


@query("delete_cascade", "SELECT item_id, project_id FROM items WHERE project_id NOT IN ('p0', 'p4')", "items")
def delete_cascade(f: Inputs) -> DataFrame:
    gone = projects(f).filter(F.col("project_id").isin("p0", "p4"))
    return lifecycle.delete_projects(f.items(), gone).select("item_id", "project_id")


@query(
    "projects_overview",
    f"""SELECT p.project_id, p.name, p.updated_at, coalesce(s.total, 0) AS total, coalesce(s.done, 0) AS done,
       coalesce(s.failed, 0) AS failed, coalesce(s.pending, 0) AS pending, coalesce(s.detections, 0) AS detections,
       coalesce(s.average_ms, 0) AS average_ms
FROM ({PROJECTS}) p LEFT JOIN (SELECT project_id, {STATS} FROM items GROUP BY 1) s ON s.project_id = p.project_id""",
    "items",
)
def projects_overview(f: Inputs) -> DataFrame:
    totals = review.stats(f.items(), ["project_id"])
    return lifecycle.projects_overview(projects(f), totals).drop(
        "status", "detail", "training_status", "training_detail"
    )


@query(
    "thumb_plan",
    """SELECT item_id, CAST(greatest(1, round_even(width * least(1e0, 480e0 / greatest(width, height)), 0)) AS INTEGER) AS thumb_width,
       CAST(greatest(1, round_even(height * least(1e0, 480e0 / greatest(width, height)), 0)) AS INTEGER) AS thumb_height
FROM items WHERE item_id % 3 <> 1 OR item_id % 5 < 2""",
    "items",
)
def thumb_plan(f: Inputs) -> DataFrame:
    k = F.col("item_id")
    images = f.items().withColumn("modified_at", F.lit(10) - k % 5)
    built = f.items().filter(k % 3 == 1).select("item_id", F.lit(8).alias("built_at"))
    return lifecycle.thumbnail_plan(images, built, THUMBNAIL_EDGE)


JSON_TEXT = """CASE WHEN l_partkey % 6 = 0 THEN '' ELSE concat('[{"class_name":"', l_returnflag, '","confidence":', l_discount,
  ',"box":[1.5,2,', l_suppkey, '.25,7]}', CASE WHEN l_partkey % 2 = 0 THEN ',{"confidence":1,"class_id":3}' ELSE '' END, ']') END"""


@query(
    "items_from_json",
    """SELECT item_id, CAST(pos AS BIGINT) AS pos, CASE WHEN pos = 0 THEN l_returnflag END AS class_name,
       CASE WHEN pos = 0 THEN l_discount ELSE 1e0 END AS confidence, CASE WHEN pos = 0 THEN 1.5e0 END AS x1,
       CASE WHEN pos = 0 THEN l_suppkey + 25e-2 END AS x2, CAST(CASE WHEN pos = 1 THEN 3 END AS INTEGER) AS class_id
FROM (SELECT l_orderkey AS item_id, l_returnflag, l_discount, l_suppkey,
             unnest(CASE WHEN l_partkey % 6 = 0 THEN [] WHEN l_partkey % 2 = 0 THEN [0, 1] ELSE [0] END) AS pos FROM lineitem)""",
)
def items_from_json(f: Inputs) -> DataFrame:
    p = F.col("l_partkey")
    text = F.concat(
        F.lit('[{"class_name":"'), "l_returnflag", F.lit('","confidence":'), F.col("l_discount").cast("string"),
        F.lit(',"box":[1.5,2,'), F.col("l_suppkey").cast("string"), F.lit(".25,7]}"),
        F.when(p % 2 == 0, ',{"confidence":1,"class_id":3}').otherwise(""), F.lit("]"),
    )
    rows = f.table("lineitem").select(
        F.col("l_orderkey").alias("item_id"), F.when(p % 6 == 0, "").otherwise(text).alias("detections")
    )
    return explode_detections(parse_detections(rows, "detections")).select(
        "item_id", "pos", "class_name", "confidence", "x1", "x2", "class_id"
    )


@query(
    "coco_read",
    """SELECT item_id AS doc_id, 'image' AS part, CAST(0 AS BIGINT) AS ord, item_id AS id, rel_path AS name, CAST(NULL AS DOUBLE) AS x
FROM items WHERE item_id % 9 > 1
UNION ALL SELECT item_id, 'annotation', n, item_id * 10 + n, NULL, n + 5e-1 FROM items CROSS JOIN (VALUES (0), (1)) v(n) WHERE item_id % 9 > 1
UNION ALL SELECT item_id, 'category', 0, item_id % 5, concat('c', item_id % 5), NULL FROM items WHERE item_id % 9 > 1 AND item_id % 2 = 0""",
    "items",
)
def coco_read(f: Inputs) -> DataFrame:
    k = F.col("item_id")
    number = k.cast("string")

    def annotation(n: int):
        return F.concat(
            F.lit('{"id":'), (k * 10 + n).cast("string"), F.lit(',"image_id":'), number,
            F.lit(f',"category_id":1,"bbox":[{n}.5,2,3,4]}}'),
        )

    categories = F.when(
        k % 2 == 0,
        F.concat(F.lit(',"categories":[{"id":'), (k % 5).cast("string"), F.lit(',"name":"c'), (k % 5).cast("string"), F.lit('"}]')),
    ).otherwise("")
    text = F.concat(
        F.lit('{"images":[{"id":'), number, F.lit(',"file_name":"'), "rel_path", F.lit('","width":'),
        F.col("width").cast("string"), F.lit('}],"annotations":['), annotation(0), F.lit(","), annotation(1),
        F.lit("]"), categories, F.lit("}"),
    )
    broken = F.when(k % 9 == 0, '{"nope":true}').when(k % 9 == 1, "{not json").otherwise(text)
    documents = parse_documents(f.items().select(k.alias("doc_id"), broken.alias("text")))
    images, annotations, categories = document_tables(documents)
    nothing = F.lit(None)
    return (
        images.select("doc_id", F.lit("image").alias("part"), "ord", "id", F.col("file_name").alias("name"), nothing.cast("double").alias("x"))
        .unionByName(annotations.select("doc_id", F.lit("annotation").alias("part"), "ord", "id", nothing.cast("string").alias("name"), F.get("bbox", F.lit(0)).alias("x")))
        .unionByName(categories.select("doc_id", F.lit("category").alias("part"), "ord", "id", "name", nothing.cast("double").alias("x")))
    )
