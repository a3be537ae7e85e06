"""Images, annotation sets, COCO tables and clips derived from the given tables.

An order is an image and its line items are the objects in it. ``baseline`` is
one annotation set; ``current`` is a shifted, thinned and partly relabelled twin.
Every derivation exists twice: as a DataFrame here and as SQL in ``VIEWS``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions.geometry import CORNERS
from boxloom.functions.text import base_name
from boxloom.operators.ranking import row_numbers
from boxloom.session import hot_group_rows

#: Views in dependency order: name -> (views it reads, SQL).
VIEWS: dict[str, tuple[str, str]] = {
    "items": (
        "",
        """SELECT o_orderkey AS item_id, concat('p', o_custkey % 5) AS project_id,
       concat('cam', CAST(o_custkey % 7 AS VARCHAR), '/b',
              CAST(CAST((o_orderkey - o_orderkey % 400) / 400 AS BIGINT) AS VARCHAR), '/frame_',
              lpad(CAST(o_orderkey % 400 AS VARCHAR), 4, '0'),
              CASE WHEN o_orderkey % 3 = 0 THEN '.JPG' ELSE '.jpg' END) AS rel_path,
       CAST(400 + (o_orderkey * 37) % 2200 AS INTEGER) AS width,
       CAST(300 + (o_orderkey * 53) % 1700 AS INTEGER) AS height,
       CASE WHEN o_orderkey % 23 = 0 THEN 'error' WHEN o_orderkey % 19 = 0 THEN 'pending' ELSE 'done' END AS status,
       CASE WHEN o_orderkey % 23 = 0 THEN 'not a readable image' ELSE '' END AS detail,
       CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE 'detect' END AS task,
       CAST((o_orderkey * 31) % 97 AS DOUBLE) / 4e0 AS inference_ms,
       CAST((o_orderkey * 13) % 101 AS DOUBLE) / 128e0 AS review_priority,
       (o_orderkey * 29) % 9 AS detection_count, (o_orderkey * 17) % 6 AS baseline_count,
       (o_orderkey * 7) % 5 AS disputed, CAST((o_orderkey * 11) % 9 AS DOUBLE) / 8e0 AS agreement
FROM orders""",
    ),
    "seed": (
        "",
        """SELECT l_orderkey AS item_id, l_partkey AS p, l_suppkey AS s, CAST(l_linenumber AS BIGINT) AS ln,
       CAST(round(l_discount * 100) AS BIGINT) AS d100, concat(l_returnflag, l_linestatus) AS cls,
       (l_partkey % 4) * 30 AS bx, (l_suppkey % 3) * 30 AS by_,
       20 + CAST(l_quantity AS BIGINT) % 20 AS w, 20 + (CAST(l_quantity AS BIGINT) * 3) % 20 AS h
FROM lineitem""",
    ),
    "baseline": (
        "seed",
        """SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY ln, p, s, d100, w, cls) - 1 AS BIGINT) AS pos,
       cls AS class_name, 1e0 AS confidence, CAST(bx AS DOUBLE) AS x1, CAST(by_ AS DOUBLE) AS y1,
       CAST(bx + w AS DOUBLE) AS x2, CAST(by_ + h AS DOUBLE) AS y2
FROM seed WHERE (p + s) % 9 <> 0""",
    ),
    "current_set": (
        "seed",
        """SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY ln, p, s, d100, w, cls) - 1 AS BIGINT) AS pos,
       CASE WHEN (p + ln) % 7 = 0 THEN 'XX' ELSE cls END AS class_name,
       CAST(d100 AS DOUBLE) / 1e1 AS confidence,
       CAST(bx + (p * 7 + s) % 9 AS DOUBLE) AS x1, CAST(by_ + (p + s * 5) % 7 AS DOUBLE) AS y1,
       CAST(bx + w + (p * 7 + s) % 9 AS DOUBLE) AS x2, CAST(by_ + h + (p + s * 5) % 7 AS DOUBLE) AS y2
FROM seed WHERE (p * 3 + s) % 11 <> 0""",
    ),
    "cand": (
        "baseline current_set",
        """SELECT item_id, i, j, pass, inter / (areas - inter) AS iou, b_class, c_class FROM (
  SELECT b.item_id, b.pos AS i, c.pos AS j, b.class_name AS b_class, c.class_name AS c_class,
         CASE WHEN b.class_name = c.class_name THEN 0 ELSE 1 END AS pass,
         (least(b.x2, c.x2) - greatest(b.x1, c.x1)) * (least(b.y2, c.y2) - greatest(b.y1, c.y1)) AS inter,
         (b.x2 - b.x1) * (b.y2 - b.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) AS areas
  FROM baseline b JOIN current_set c ON b.item_id = c.item_id
  WHERE least(b.x2, c.x2) > greatest(b.x1, c.x1) AND least(b.y2, c.y2) > greatest(b.y1, c.y1)) t
WHERE inter / (areas - inter) >= 0.5e0""",
    ),
    "ranked": (
        "cand",
        "SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pass, iou DESC, i, j) AS rn FROM cand",
    ),
    "fold": (
        "ranked",
        """SELECT item_id, rn, i, j, pass, iou, b_class, c_class, true AS took, [i] AS ui, [j] AS uj FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.item_id, r.rn, r.i, r.j, r.pass, r.iou, r.b_class, r.c_class,
         NOT (list_contains(f.ui, r.i) OR list_contains(f.uj, r.j)),
         CASE WHEN list_contains(f.ui, r.i) OR list_contains(f.uj, r.j) THEN f.ui ELSE list_append(f.ui, r.i) END,
         CASE WHEN list_contains(f.ui, r.i) OR list_contains(f.uj, r.j) THEN f.uj ELSE list_append(f.uj, r.j) END
  FROM fold f JOIN ranked r ON r.item_id = f.item_id AND r.rn = f.rn + 1""",
    ),
    "matches": ("fold", "SELECT item_id, i, j, pass, iou, b_class, c_class FROM fold WHERE took"),
    "pairs": (
        "matches baseline current_set",
        """SELECT item_id, CASE WHEN pass = 0 THEN 'agreed' ELSE 'reclassified' END AS kind, i AS b_pos, j AS c_pos,
       b_class, c_class, iou AS overlap FROM matches
UNION ALL SELECT b.item_id, 'missing', b.pos, NULL, b.class_name, NULL, 0e0 FROM baseline b
  WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.item_id = b.item_id AND m.i = b.pos)
UNION ALL SELECT c.item_id, 'added', NULL, c.pos, NULL, c.class_name, 0e0 FROM current_set c
  WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.item_id = c.item_id AND m.j = c.pos)""",
    ),
    "done_pairs": (
        "pairs items",
        "SELECT p.* FROM pairs p JOIN items t ON t.item_id = p.item_id WHERE t.status = 'done'",
    ),
    "verdicts": (
        "done_pairs",
        """SELECT item_id, count(*) FILTER (kind = 'agreed') AS agreed,
       count(*) FILTER (kind = 'reclassified') AS reclassified,
       count(*) FILTER (kind = 'missing') AS missing, count(*) FILTER (kind = 'added') AS added,
       count(*) FILTER (kind <> 'agreed') AS disputed,
       count(*) FILTER (kind = 'agreed') / CAST(count(*) AS DOUBLE) AS agreement
FROM done_pairs GROUP BY item_id""",
    ),
    "crowd_seed": (
        "",
        """SELECT l_suppkey % 20 AS item_id, (l_partkey * 7 + l_orderkey) % 100 AS cluster, l_orderkey AS o, l_partkey AS p, l_suppkey AS s,
       CAST(l_linenumber AS BIGINT) AS ln, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d100,
       CASE WHEN l_partkey % 13 <> 0 THEN concat('c', l_partkey % 2) END AS cls,
       (l_partkey * 7 + l_orderkey) % 100 * 1000 + (l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 30 AS bx,
       (l_partkey + l_suppkey * 5 + l_linenumber * 11) % 24 AS by_,
       60 + CAST(l_quantity AS BIGINT) % 12 AS w, 60 + (CAST(l_quantity AS BIGINT) * 3) % 10 AS h
FROM lineitem""",
    ),
    "crowd": (
        "crowd_seed",
        """SELECT item_id, cluster, CAST(row_number() OVER (PARTITION BY item_id ORDER BY o, ln, p, s, q, d100) - 1 AS BIGINT) AS pos,
       cls AS class_name, CAST((p * 31 + s * 17 + ln * 7) % 1000 AS DOUBLE) / 1e3 AS confidence,
       CAST(bx AS DOUBLE) AS x1, CAST(by_ AS DOUBLE) AS y1, CAST(bx + w AS DOUBLE) AS x2, CAST(by_ + h AS DOUBLE) AS y2
FROM crowd_seed""",
    ),
    "crowd_now": (
        "crowd_seed",
        """SELECT item_id, cluster, CAST(row_number() OVER (PARTITION BY item_id ORDER BY o, ln, p, s, q, d100) - 1 AS BIGINT) AS pos,
       CASE WHEN (p + ln) % 7 = 0 THEN 'XX' ELSE cls END AS class_name, 1e0 AS confidence,
       CAST(bx + (p * 7 + s) % 5 AS DOUBLE) AS x1, CAST(by_ + (p + s * 5) % 4 AS DOUBLE) AS y1,
       CAST(bx + w + (p * 7 + s) % 5 AS DOUBLE) AS x2, CAST(by_ + h + (p + s * 5) % 4 AS DOUBLE) AS y2
FROM crowd_seed WHERE (p * 3 + s) % 11 <> 0""",
    ),
    "label_baseline": (
        "",
        """SELECT doc_id AS item_id, CAST(0 AS BIGINT) AS pos, concat('q', CAST(quality AS VARCHAR)) AS class_name
FROM labels WHERE doc_id % 17 <> 0
UNION ALL SELECT doc_id, 1, concat('t', CAST(toxic AS VARCHAR)) FROM labels WHERE doc_id % 17 <> 0""",
    ),
    "label_current": (
        "",
        """SELECT doc_id AS item_id, CAST(2 AS BIGINT) AS pos,
       concat('q', CAST(CASE WHEN doc_id % 10 < 8 THEN quality ELSE 1 - quality END AS VARCHAR)) AS class_name
FROM labels WHERE doc_id % 19 <> 0
UNION ALL SELECT doc_id, 5, concat('t', CAST(toxic AS VARCHAR)) FROM labels WHERE doc_id % 19 <> 0""",
    ),
    "coco_image": (
        "items",
        """SELECT item_id AS ord, CASE WHEN item_id % 15 = 0 AND item_id > 0 THEN item_id - 3 ELSE item_id END AS id,
       CASE WHEN item_id % 33 = 0 THEN concat('missing_', CAST(item_id AS VARCHAR), '.jpg')
            WHEN item_id % 57 = 0 THEN NULL
            ELSE concat('export\\', upper(regexp_extract(rel_path, '([^/]*)$', 1))) END AS file_name,
       CASE WHEN item_id % 7 <> 0 THEN width END AS width, CASE WHEN item_id % 7 <> 0 THEN height END AS height
FROM items""",
    ),
    "coco_category": (
        "",
        """SELECT CAST(n_nationkey AS BIGINT) AS ord, CAST(n_nationkey % 3 AS BIGINT) AS id,
       CASE WHEN n_nationkey % 3 = 2 THEN NULL ELSE n_name END AS name FROM nation""",
    ),
    "coco_annotation": (
        "seed",
        """SELECT item_id AS image_id, ((ln * 100000000 + p) * 1000000 + s) * 100 + w AS id,
       CASE WHEN p % 13 = 0 THEN NULL ELSE p % 4 END AS category_id,
       CASE WHEN p % 29 = 0 THEN NULL ELSE CAST(bx AS DOUBLE) + 25e-2 END AS bx, CAST(by_ AS DOUBLE) AS by_,
       CAST(w AS DOUBLE) AS bw, CAST(h AS DOUBLE) AS bh
FROM seed""",
    ),
    "cats": (
        "coco_category",
        """SELECT id, coalesce(name, concat('class_', CAST(id AS VARCHAR))) AS name FROM coco_category
QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1""",
    ),
    "imgs": (
        "coco_image",
        """SELECT id, min(ord) OVER (PARTITION BY id) AS ord, file_name, width, height,
       lower(regexp_extract(replace(file_name, '\\', '/'), '([^/]*)$', 1)) AS key
FROM coco_image WHERE file_name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY id ORDER BY coco_image.ord DESC) = 1""",
    ),
    "item_keys": (
        "items",
        """SELECT lower(regexp_extract(rel_path, '([^/]*)$', 1)) AS key, item_id, width AS item_width, height AS item_height,
       task AS item_task FROM items
QUALIFY row_number() OVER (PARTITION BY lower(regexp_extract(rel_path, '([^/]*)$', 1)) ORDER BY rel_path) = 1""",
    ),
    "hits": (
        "imgs item_keys",
        """SELECT i.id AS image_id, i.ord, i.file_name, i.width, i.height, k.item_id, k.item_width, k.item_height, k.item_task
FROM imgs i JOIN item_keys k ON k.key = i.key""",
    ),
    "dets": (
        "coco_annotation cats",
        """SELECT a.image_id, a.id AS ann_ord,
       CASE WHEN a.category_id IS NULL THEN 'object' ELSE coalesce(c.name, concat('class_', CAST(a.category_id AS VARCHAR))) END AS class_name,
       a.bx AS x1, a.by_ AS y1, a.bx + a.bw AS x2, a.by_ + a.bh AS y2
FROM coco_annotation a LEFT JOIN cats c ON c.id = a.category_id WHERE a.bx IS NOT NULL""",
    ),
    "winners": (
        "hits",
        "SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ord DESC) = 1",
    ),
    "imported": (
        "winners dets",
        """SELECT w.item_id, CAST(row_number() OVER (PARTITION BY w.item_id ORDER BY d.ann_ord) - 1 AS BIGINT) AS pos,
       d.class_name, 1e0 AS confidence, d.x1, d.y1, d.x2, d.y2 FROM winners w JOIN dets d ON d.image_id = w.image_id""",
    ),
    "shaped": (
        "current_set items",
        """SELECT c.*, t.width, t.height,
       CASE t.item_id % 4 WHEN 0 THEN 'detect' WHEN 1 THEN 'segment' WHEN 2 THEN 'pose' ELSE 'classify' END AS task,
       c.pos % 5 <> 4 AS has_box, c.pos % 2 = 0 AS has_mask, c.pos % 3 <> 2 AS has_points, c.pos % 3 = 0 AS has_scores
FROM current_set c JOIN items t ON t.item_id = c.item_id""",
    ),
    "done_names": (
        "items",
        """SELECT item_id, rel_path, width, height, row_number() OVER (ORDER BY rel_path) AS image_id,
       CASE WHEN row_number() OVER (PARTITION BY lower(regexp_extract(rel_path, '([^/]*)$', 1)) ORDER BY rel_path) = 1
            THEN regexp_extract(rel_path, '([^/]*)$', 1) ELSE replace(rel_path, '/', '__') END AS file_name
FROM items WHERE status = 'done'""",
    ),
    "class_ids": (
        "current_set",
        """SELECT class_name, CAST(row_number() OVER (ORDER BY first_id, n DESC, class_name) - 1 AS BIGINT) AS class_index FROM (
  SELECT class_name, CASE class_name WHEN 'NF' THEN 0 WHEN 'AF' THEN 1 ELSE 2 END AS first_id, count(*) AS n FROM current_set GROUP BY 1)""",
    ),
    "coco_rows": (
        "shaped done_names class_ids",
        """SELECT row_number() OVER (ORDER BY i.image_id, s.pos) AS id, i.image_id, k.class_index + 1 AS category_id, s.*
FROM shaped s JOIN done_names i ON i.item_id = s.item_id JOIN class_ids k ON k.class_name = s.class_name
WHERE s.has_box AND s.confidence >= 0.3e0 AND s.item_id % 13 <> 0""",
    ),
    "train_names": (
        "current_set items",
        """SELECT class_name, CAST(row_number() OVER (ORDER BY known, rel_path, pos) - 1 AS BIGINT) AS class_index FROM (
  SELECT class_name, min(known) AS known, min((t.rel_path, c.pos))[1] AS rel_path, min((t.rel_path, c.pos))[2] AS pos FROM (
     SELECT *, CASE class_name WHEN 'NF' THEN 0 WHEN 'AF' THEN 1 ELSE 2 END AS known FROM current_set WHERE confidence >= 0.25e0) c
  JOIN items t ON t.item_id = c.item_id WHERE t.status = 'done' GROUP BY 1)""",
    ),
    "train_lines": (
        "current_set items train_names",
        """SELECT c.item_id, t.rel_path, c.pos, c.class_name, n.class_index,
       CAST(printf('%.6f', greatest(0e0, least(1e0, (c.x1 + c.x2) / 2e0 / t.width))) AS DOUBLE) AS cx,
       CAST(printf('%.6f', greatest(0e0, least(1e0, (c.y1 + c.y2) / 2e0 / t.height))) AS DOUBLE) AS cy,
       CAST(printf('%.6f', greatest(0e0, least(1e0, (c.x2 - c.x1) / t.width))) AS DOUBLE) AS bw,
       CAST(printf('%.6f', greatest(0e0, least(1e0, (c.y2 - c.y1) / t.height))) AS DOUBLE) AS bh
FROM current_set c JOIN items t ON t.item_id = c.item_id JOIN train_names n ON n.class_name = c.class_name
WHERE t.status = 'done' AND c.confidence >= 0.25e0""",
    ),
    "train_images": (
        "train_lines",
        """SELECT item_id, rel_path, boxes, stem, split, concat('images/', split, '/', stem, '.jpg') AS image_file,
       concat('labels/', split, '/', stem, '.txt') AS label_file FROM (
  SELECT item_id, rel_path, boxes,
       CASE WHEN row_number() OVER (PARTITION BY lower(regexp_extract(rel_path, '([^/]*)[.][^.]*$', 1)) ORDER BY rel_path) = 1
            THEN regexp_extract(rel_path, '([^/]*)[.][^.]*$', 1)
            ELSE regexp_replace(replace(rel_path, '/', '__'), '[.][^.]*$', '') END AS stem,
       CASE WHEN (concat('0x', substr(md5(rel_path), 1, 8))::BIGINT % 1000) / 1000e0 < 0.2e0 THEN 'val' ELSE 'train' END AS split
  FROM (SELECT item_id, rel_path, count(*) AS boxes FROM train_lines GROUP BY 1, 2))""",
    ),
    "frames": (
        "",
        """SELECT user_id AS clip, event_id, event_type AS class_name,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx,
       CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS total
FROM events""",
    ),
    "objects": (
        "frames",
        """SELECT clip, idx, pos, concat('k', pos % 2) AS class_name, l AS x1, 10e0 AS y1, l + 30 AS x2, 40e0 AS y2 FROM (
  SELECT clip, idx, pos, CAST(pos * 40 + idx * 3 % 200 + event_id % 4 AS DOUBLE) AS l
  FROM frames CROSS JOIN (VALUES (0::BIGINT), (1), (2)) v(pos) WHERE pos <> 2 OR idx % 5 <> 4)""",
    ),
    "steps": (
        "objects",
        """SELECT *, row_number() OVER (PARTITION BY clip, idx ORDER BY iou DESC, i, j) AS rn FROM (
  SELECT a.clip, a.idx, a.pos AS i, b.pos AS j,
         (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * 30e0 /
         (1800e0 - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * 30e0) AS iou
  FROM objects a JOIN objects b ON a.clip = b.clip AND b.idx = a.idx + 1 AND a.class_name = b.class_name
  WHERE least(a.x2, b.x2) > greatest(a.x1, b.x1)) WHERE iou >= 0.3e0""",
    ),
    "step_fold": (
        "steps",
        """SELECT clip, idx, rn, i, j, true AS took, [i] AS ui, [j] AS uj FROM steps WHERE rn = 1
  UNION ALL
  SELECT r.clip, r.idx, r.rn, r.i, r.j, NOT (list_contains(f.ui, r.i) OR list_contains(f.uj, r.j)),
         CASE WHEN list_contains(f.ui, r.i) OR list_contains(f.uj, r.j) THEN f.ui ELSE list_append(f.ui, r.i) END,
         CASE WHEN list_contains(f.ui, r.i) OR list_contains(f.uj, r.j) THEN f.uj ELSE list_append(f.uj, r.j) END
  FROM step_fold f JOIN steps r ON r.clip = f.clip AND r.idx = f.idx AND r.rn = f.rn + 1""",
    ),
    "chains": (
        "objects step_fold",
        """SELECT clip, idx, pos, idx AS start_idx, pos AS start_pos FROM objects o WHERE NOT EXISTS (
    SELECT 1 FROM step_fold s WHERE s.took AND s.clip = o.clip AND s.idx = o.idx - 1 AND s.j = o.pos)
  UNION ALL
  SELECT c.clip, c.idx + 1, s.j, c.start_idx, c.start_pos
  FROM chains c JOIN step_fold s ON s.took AND s.clip = c.clip AND s.idx = c.idx AND s.i = c.pos""",
    ),
}


def with_views(names: Sequence[str], body: str) -> str:
    """``body`` behind a WITH clause holding every view it needs."""
    needed: set[str] = set()

    def need(name: str) -> None:
        if name not in needed:
            needed.add(name)
            for other in VIEWS[name][0].split():
                need(other)

    for name in names:
        need(name)
    if not needed:
        return body
    ctes = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in VIEWS if name in needed)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH RECURSIVE {ctes},\n{body[5:]}"
    return f"WITH RECURSIVE {ctes}\n{body}"


def _text(value: Column) -> Column:
    return value.cast("string")


class Inputs:
    """The derived inputs of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def largest(self) -> int:
        """The most objects any image holds; every set is a subset of these."""
        counts = self.table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
        return counts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]

    @property
    def crowded(self) -> bool:
        """Whether some image holds more objects than one task should number."""
        return self.largest > hot_group_rows(self.spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def items(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").select(
            k.alias("item_id"),
            F.concat(F.lit("p"), _text(F.col("o_custkey") % 5)).alias("project_id"),
            F.concat(
                F.lit("cam"), _text(F.col("o_custkey") % 7),
                F.lit("/b"), _text(F.expr("o_orderkey div 400")),
                F.lit("/frame_"), F.lpad(_text(k % 400), 4, "0"),
                F.when(k % 3 == 0, ".JPG").otherwise(".jpg"),
            ).alias("rel_path"),
            (400 + (k * 37) % 2200).cast("int").alias("width"),
            (300 + (k * 53) % 1700).cast("int").alias("height"),
            F.when(k % 23 == 0, "error").when(k % 19 == 0, "pending").otherwise("done").alias("status"),
            F.when(k % 23 == 0, "not a readable image").otherwise("").alias("detail"),
            F.when(k % 31 == 0, "").otherwise("detect").alias("task"),
            (((k * 31) % 97).cast("double") / 4.0).alias("inference_ms"),
            (((k * 13) % 101).cast("double") / 128.0).alias("review_priority"),
            ((k * 29) % 9).alias("detection_count"),
            ((k * 17) % 6).alias("baseline_count"),
            ((k * 7) % 5).alias("disputed"),
            (((k * 11) % 9).cast("double") / 8.0).alias("agreement"),
        )

    def seed(self) -> DataFrame:
        return self.raw_seed().withColumns(self.shape()).drop("q")

    @staticmethod
    def shape() -> dict[str, Column]:
        """Place and size of a line item's box."""
        return {
            "bx": (F.col("p") % 4) * 30, "by_": (F.col("s") % 3) * 30,
            "w": 20 + F.col("q") % 20, "h": 20 + (F.col("q") * 3) % 20,
        }

    def raw_seed(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("item_id"),
            F.col("l_partkey").alias("p"),
            F.col("l_suppkey").alias("s"),
            F.col("l_linenumber").cast("bigint").alias("ln"),
            F.round(F.col("l_discount") * 100).cast("bigint").alias("d100"),
            F.concat("l_returnflag", "l_linestatus").alias("cls"),
            F.col("l_quantity").cast("bigint").alias("q"),
        )

    def _set(self, keep: Column, shift: tuple[Column, Column], name: Column, confidence: Column):
        # what other columns give is derived after the rows have moved
        kept = self.raw_seed().filter(keep)
        order = [*[F.col(c) for c in ("ln", "p", "s", "d100")], self.shape()["w"], F.col("cls")]
        numbered = row_numbers(kept, ["item_id"], order, "_n", hot=self.crowded, stored=True).withColumns(self.shape())
        dx, dy = shift
        return numbered.select(
            "item_id",
            (F.col("_n") - 1).alias("pos"),
            name.alias("class_name"),
            confidence.alias("confidence"),
            (F.col("bx") + dx).cast("double").alias("x1"),
            (F.col("by_") + dy).cast("double").alias("y1"),
            (F.col("bx") + F.col("w") + dx).cast("double").alias("x2"),
            (F.col("by_") + F.col("h") + dy).cast("double").alias("y2"),
        )

    def baseline(self) -> DataFrame:
        p, s = F.col("p"), F.col("s")
        zero = F.lit(0)
        return self._set((p + s) % 9 != 0, (zero, zero), F.col("cls"), F.lit(1.0))

    def current(self) -> DataFrame:
        p, s = F.col("p"), F.col("s")
        return self._set(
            (p * 3 + s) % 11 != 0,
            ((p * 7 + s) % 9, (p + s * 5) % 7),
            F.when((p + F.col("ln")) % 7 == 0, "XX").otherwise(F.col("cls")),
            F.col("d100").cast("double") / 10.0,
        )

    def _crowd(self, keep: Column, shift: tuple[Column, Column], name: Column, confidence: Column) -> DataFrame:
        p, s, ln, q = F.col("p"), F.col("s"), F.col("ln"), F.col("q")
        seed = self.table("lineitem").select(
            (F.col("l_suppkey") % 20).alias("item_id"), F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"),
            F.col("l_suppkey").alias("s"), F.col("l_linenumber").cast("bigint").alias("ln"),
            F.col("l_quantity").cast("bigint").alias("q"), F.round(F.col("l_discount") * 100).cast("bigint").alias("d100"),
        ).filter(keep)
        order = [F.col(c) for c in ("o", "ln", "p", "s", "q", "d100")]
        numbered = row_numbers(seed, ["item_id"], order, "_n", stored=True)
        left = (p * 7 + F.col("o")) % 100 * 1000 + (p * 7 + s * 3 + ln) % 30 + shift[0]
        top = (p + s * 5 + ln * 11) % 24 + shift[1]
        boxes = zip(CORNERS, (left, top, left + 60 + q % 12, top + 60 + (q * 3) % 10), strict=True)
        return numbered.select(
            "item_id", (F.col("_n") - 1).alias("pos"), name.alias("class_name"), confidence.alias("confidence"),
            *[value.cast("double").alias(c) for c, value in boxes],
        )

    def crowd(self) -> DataFrame:
        """A few images with very many boxes, in a hundred spots of near-equal ones."""
        p, s = F.col("p"), F.col("s")
        name = F.when(p % 13 != 0, F.concat(F.lit("c"), _text(p % 2)))
        rank = ((p * 31 + s * 17 + F.col("ln") * 7) % 1000).cast("double") / 1000.0
        return self._crowd(F.lit(True), (F.lit(0), F.lit(0)), name, rank)

    def crowd_now(self) -> DataFrame:
        p, s = F.col("p"), F.col("s")
        name = F.when((p + F.col("ln")) % 7 == 0, "XX").otherwise(F.when(p % 13 != 0, F.concat(F.lit("c"), _text(p % 2))))
        return self._crowd((p * 3 + s) % 11 != 0, ((p * 7 + s) % 5, (p + s * 5) % 4), name, F.lit(1.0))

    def _label_set(self, skip: int, places: tuple[int, int], quality: Column) -> DataFrame:
        kept = self.table("labels").filter(F.col("doc_id") % skip != 0)
        names = F.array(
            F.struct(F.lit(places[0]).cast("bigint").alias("pos"), F.concat(F.lit("q"), _text(quality)).alias("class_name")),
            F.struct(F.lit(places[1]).cast("bigint").alias("pos"), F.concat(F.lit("t"), _text(F.col("toxic"))).alias("class_name")),
        )
        nothing = F.lit(None).cast("double")
        return kept.select(F.col("doc_id").alias("item_id"), F.inline(names)).select(
            "*", *[nothing.alias(c) for c in CORNERS]
        )

    def label_baseline(self) -> DataFrame:
        return self._label_set(17, (0, 1), F.col("quality"))

    def label_current(self) -> DataFrame:
        flipped = F.when(F.col("doc_id") % 10 < 8, F.col("quality")).otherwise(1 - F.col("quality"))
        return self._label_set(19, (2, 5), flipped)

    def coco_images(self) -> DataFrame:
        k = F.col("item_id")
        sized = k % 7 != 0
        return self.items().select(
            k.alias("ord"),
            F.when((k % 15 == 0) & (k > 0), k - 3).otherwise(k).alias("id"),
            F.when(k % 33 == 0, F.concat(F.lit("missing_"), _text(k), F.lit(".jpg")))
            .when(k % 57 == 0, F.lit(None))
            .otherwise(F.concat(F.lit("export\\"), F.upper(base_name(F.col("rel_path")))))
            .alias("file_name"),
            F.when(sized, F.col("width")).alias("width"),
            F.when(sized, F.col("height")).alias("height"),
        )

    def coco_categories(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.table("nation").select(
            n.cast("bigint").alias("ord"),
            (n % 3).cast("bigint").alias("id"),
            F.when(n % 3 != 2, F.col("n_name")).alias("name"),
        )

    def coco_annotations(self) -> DataFrame:
        p, s = F.col("p"), F.col("s")
        bbox = F.array(*[F.col(c).cast("double") for c in ("bx", "by_", "w", "h")])
        moved = F.transform(bbox, lambda v, i: F.when(i == 0, v + 0.25).otherwise(v))
        return self.seed().select(
            F.col("item_id").alias("image_id"),
            (((F.col("ln") * 100000000 + p) * 1000000 + s) * 100 + F.col("w")).alias("id"),
            F.when(p % 13 != 0, p % 4).alias("category_id"),
            F.when(p % 29 != 0, moved).alias("bbox"),
        )

    def frames(self, totals: bool = True) -> DataFrame:
        events = self.table("events").select(
            F.col("user_id").alias("clip"), "event_id", F.col("event_type").alias("class_name"), "ts"
        )
        numbered = row_numbers(
            events, ["clip"], [F.col("ts"), F.col("event_id")], "_n", stored=True
        )
        placed = ["clip", "event_id", "class_name", (F.col("_n") - 1).alias("idx")]
        if not totals:
            return numbered.select(*placed)
        counts = events.groupBy("clip").agg(F.count("*").alias("total"))
        return numbered.join(counts, "clip").select(*placed, "total")
