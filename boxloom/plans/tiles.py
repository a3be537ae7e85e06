"""Tiles, duplicate merging and raw model output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.operators import results, tiling
from boxloom.operators.nms import in_order, merge_detections
from boxloom.plans.fixtures import Inputs
from boxloom.plans.registry import query
from boxloom.session import durable

#: Starts of 640 px tiles with 20 % overlap along one axis, in SQL.
STARTS = "CASE WHEN {0} <= 640 THEN [0::BIGINT] ELSE list_sort(list_distinct(list_append(range(0, {0} - 640 + 1, 512), {0}::BIGINT - 640))) END"
TILES = f"""SELECT item_id, CAST(yi * len(xs) + xi AS INTEGER) AS tile_no, CAST(xs[xi + 1] AS INTEGER) AS x, CAST(ys[yi + 1] AS INTEGER) AS y,
  CAST(least(640, width) AS INTEGER) AS tile_width, CAST(least(640, height) AS INTEGER) AS tile_height,
  greatest(width, height) > 640 AND len(xs) * len(ys) <= 256 AS tiled
FROM (SELECT *, unnest(range(len(xs))) AS xi FROM (SELECT *, unnest(range(len(ys))) AS yi FROM (
  SELECT item_id, width, height, {STARTS.format('width')} AS xs, {STARTS.format('height')} AS ys FROM items)))"""


@query("plan_tiles", TILES, "items")
def plan_tiles(f: Inputs) -> DataFrame:
    return tiling.plan_tiles(f.items(), 640, 0.2)


@query(
    "tile_decision",
    f"""SELECT item_id, CAST(len(xs) * len(ys) AS INTEGER) AS tiles, greatest(width, height) > 640 AND len(xs) * len(ys) <= 256 AS tiled
FROM (SELECT item_id, width, height, {STARTS.format('width')} AS xs, {STARTS.format('height')} AS ys FROM items)""",
    "items",
)
def tile_decision(f: Inputs) -> DataFrame:
    return tiling.tile_decision(f.items(), 640, 0.2).select("item_id", "tiles", "tiled")


def found_in_tiles(f: Inputs) -> DataFrame:
    """Two derived detections per tile of a sliced image."""
    tiles = tiling.plan_tiles(f.items(), 640, 0.2).filter("tiled")
    k, n = F.col("item_id"), F.col("tile_no")
    both = F.array(*[F.struct(F.lit(i).cast("bigint").alias("pos")) for i in range(2)])
    rows = tiles.select("*", F.inline(both))
    pos = F.col("pos")
    left = ((k + n * 61 + pos * 17) % 500).cast("double")
    top = ((k * 3 + n * 37 + pos * 29) % 400).cast("double")
    return rows.select(
        "item_id", "tile_no", "x", "y", "pos",
        F.concat(F.lit("c"), ((k + pos) % 2).cast("string")).alias("class_name"),
        (((k * 7 + n * 13 + pos * 5) % 64).cast("double") / 64.0).alias("confidence"),
        left.alias("x1"), top.alias("y1"), (left + 200).alias("x2"), (top + 240).alias("y2"),
    )


FOUND = f"""SELECT item_id, tile_no, x, y, pos, concat('c', (item_id + pos) % 2) AS class_name,
  CAST((item_id * 7 + tile_no * 13 + pos * 5) % 64 AS DOUBLE) / 64e0 AS confidence,
  CAST((item_id + tile_no * 61 + pos * 17) % 500 AS DOUBLE) AS l, CAST((item_id * 3 + tile_no * 37 + pos * 29) % 400 AS DOUBLE) AS t
FROM ({TILES}) CROSS JOIN (VALUES (0::BIGINT), (1)) v(pos) WHERE tiled"""


@query(
    "tile_shift",
    f"""SELECT item_id, tile_no, pos, l + x AS x1, t + y AS y1, l + 200 + x AS x2, t + 240 + y AS y2,
       l + x AS mask_x, t + y AS mask_y, confidence AS score FROM ({FOUND})""",
    "items",
)
def tile_shift(f: Inputs) -> DataFrame:
    corner = F.array(F.array("x1", "y1", "confidence"))
    moved = tiling.shift_to_image(found_in_tiles(f).withColumn("keypoints", corner))
    first = F.get("keypoints", F.lit(0))
    return moved.select(
        "item_id", "tile_no", "pos", "x1", "y1", "x2", "y2",
        F.get(first, F.lit(0)).alias("mask_x"), F.get(first, F.lit(1)).alias("mask_y"),
        F.get(first, F.lit(2)).alias("score"),
    )


def nms_sql(source: str, threshold: str) -> str:
    return f"""WITH src AS ({source}),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id, class_name ORDER BY confidence DESC, pos) AS rn FROM src),
g AS (SELECT *, true AS keep, [struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2)] AS kept FROM n WHERE rn = 1
 UNION ALL SELECT n.*, h.ok, CASE WHEN h.ok THEN list_append(g.kept, struct_pack(x1 := n.x1, y1 := n.y1, x2 := n.x2, y2 := n.y2)) ELSE g.kept END
 FROM g JOIN n ON n.item_id = g.item_id AND n.class_name = g.class_name AND n.rn = g.rn + 1,
 LATERAL (SELECT len(list_filter(g.kept, lambda k: least(k.x2, n.x2) > greatest(k.x1, n.x1) AND least(k.y2, n.y2) > greatest(k.y1, n.y1)
   AND (least(k.x2, n.x2) - greatest(k.x1, n.x1)) * (least(k.y2, n.y2) - greatest(k.y1, n.y1)) /
       ((k.x2 - k.x1) * (k.y2 - k.y1) + (n.x2 - n.x1) * (n.y2 - n.y1)
        - (least(k.x2, n.x2) - greatest(k.x1, n.x1)) * (least(k.y2, n.y2) - greatest(k.y1, n.y1))) >= {threshold})) = 0 AS ok) h)
SELECT item_id, pos, class_name, confidence, x1, y1, x2, y2 FROM g WHERE keep"""


@query(
    "nms",
    nms_sql("SELECT item_id, pos, class_name, confidence, x1, y1, x2, y2 FROM current_set", "0.3e0"),
    "current_set",
)
def nms(f: Inputs) -> DataFrame:
    return merge_detections(f.current(), 0.3, largest=f.largest)


#: One run over each group of boxes that can overlap, so that no group is long.
CROWDED = nms_sql(
    """SELECT item_id * 100 + cluster AS item_id, pos, coalesce(class_name, '') AS class_name, confidence, x1, y1, x2, y2 FROM crowd""", "0.5e0"
).replace("WITH src", "WITH RECURSIVE src", 1)


@query(
    "nms_crowded",
    f"""WITH kept AS ({CROWDED}),
firsts AS (SELECT item_id, class_name, min(pos) AS first FROM crowd GROUP BY 1, 2)
SELECT c.item_id, c.pos, c.class_name, c.confidence, c.x1, c.y1, c.x2, c.y2,
       row_number() OVER (PARTITION BY c.item_id ORDER BY c.confidence DESC, f.first, c.pos) AS rank
FROM crowd c JOIN kept k ON k.item_id = c.item_id * 100 + c.cluster AND k.pos = c.pos
JOIN firsts f ON f.item_id = c.item_id AND f.class_name IS NOT DISTINCT FROM c.class_name""",
    "crowd",
)
def nms_crowded(f: Inputs) -> DataFrame:
    """Images far beyond what one row can nest, with the order of the result."""
    boxes = durable(f.crowd())
    return in_order(merge_detections(boxes, 0.5, stored=True), boxes)


@query(
    "tiled_merge",
    nms_sql(
        f"""SELECT item_id, tile_no::BIGINT * 16777216 + pos AS pos, class_name, confidence, l + x AS x1, t + y AS y1,
  l + 200 + x AS x2, t + 240 + y AS y2 FROM ({FOUND})
UNION ALL SELECT item_id, pos + 1099511627776, class_name, confidence, x1, y1, x2, y2 FROM current_set""",
        "0.5e0",
    ),
    "items current_set",
)
def tiled_merge(f: Inputs) -> DataFrame:
    tiles = tiling.tile_decision(f.items(), 640, 0.2).filter("tiled").agg(F.coalesce(F.max("tiles"), F.lit(0))).first()[0]
    return tiling.merge_tiles(found_in_tiles(f), f.current(), largest=2 * tiles + f.largest)


@query(
    "tile_timings",
    f"""SELECT item_id, sum((x % 7) / 8e0) AS preprocess_ms, sum((y % 50) / 4e0) AS inference_ms, sum(tile_no / 16e0) AS postprocess_ms
FROM ({TILES}) GROUP BY 1""",
    "items",
)
def tile_timings(f: Inputs) -> DataFrame:
    passes = tiling.plan_tiles(f.items(), 640, 0.2).select(
        "item_id", ((F.col("x") % 7) / 8.0).alias("preprocess_ms"),
        ((F.col("y") % 50) / 4.0).alias("inference_ms"), (F.col("tile_no") / 16.0).alias("postprocess_ms"),
    )
    return tiling.tile_timings(passes)


@query(
    "softmax_topk",
    """WITH l AS (SELECT vec_id, unnest(range(len(embedding))) AS class_id, CAST(unnest(embedding) AS DOUBLE) * 10 AS v FROM embeddings),
s AS (SELECT vec_id, class_id, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM l),
p AS (SELECT vec_id, class_id, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class_id DESC) AS rank FROM p WHERE class_id % 4 <> 3)
SELECT vec_id AS item_id, rank, CAST(class_id AS INTEGER) AS class_id, CAST(printf('%.4f', p) AS DOUBLE) AS confidence
FROM r WHERE rank <= 5 AND p >= 0.05e0""",
)
def softmax_topk(f: Inputs) -> DataFrame:
    from boxloom.functions.numbers import py_round

    logits = f.table("embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.transform("embedding", lambda v: v.cast("double") * 10).alias("logits"),
    )
    wanted = [c for c in range(64) if c % 4 != 3]
    return results.softmax_top_k(logits, wanted, conf=0.05).withColumn(
        "confidence", py_round(F.col("confidence"), 4)
    )


@query(
    "assemble_detections",
    """SELECT vec_id AS item_id, CAST(i AS INTEGER) AS place, CASE c WHEN 0 THEN 'car' WHEN 1 THEN 'van' END AS class_name, CAST(c AS INTEGER) AS class_id,
       CAST(embedding[49 + i] AS DOUBLE) AS confidence, CASE WHEN i < 3 THEN 'pose' WHEN i < 5 THEN 'segmentation' ELSE 'box' END AS kind,
       CAST(embedding[4 * i + 1] AS DOUBLE) AS x1, CAST(embedding[4 * i + 4] AS DOUBLE) AS y2,
       CASE WHEN i < 5 THEN CAST(embedding[i + 1] AS DOUBLE) END AS mask_x,
       CASE WHEN i < 3 THEN CAST(embedding[i + 2] AS DOUBLE) END AS key_y, CAST(CASE WHEN i < 8 THEN label * 100 + i END AS INTEGER) AS track_id
FROM (SELECT *, CAST((label + i) % 3 AS BIGINT) AS c FROM (SELECT *, unnest(range(12)) AS i FROM embeddings))""",
)
def assemble_detections(f: Inputs) -> DataFrame:
    e, label = F.col("embedding"), F.col("label")

    def steps(n: int):
        return F.sequence(F.lit(0), F.lit(n - 1))

    raw = f.table("embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.transform(steps(12), lambda i: F.slice(e, i * 4 + 1, 4)).alias("boxes"),
        F.slice(e, 49, 12).alias("confidences"),
        F.transform(steps(12), lambda i: (label + i) % 3).alias("class_ids"),
        F.transform(steps(5), lambda i: F.array(F.array(F.get(e, i), F.lit(1.0)))).alias("masks"),
        F.transform(steps(3), lambda i: F.array(F.array(F.lit(2.0), F.get(e, i + 1)))).alias("keypoints"),
        F.transform(steps(8), lambda i: label * 100 + i).alias("track_ids"),
    )
    names = F.create_map(F.lit(0), F.lit("car"), F.lit(1), F.lit("van"))
    detections = results.assemble_detections(
        F.col("boxes"), F.col("confidences"), F.col("class_ids"), names,
        F.col("masks"), F.col("keypoints"), F.col("track_ids"),
    )
    d = F.col("d")
    return raw.select("item_id", F.posexplode(detections).alias("place", "d")).select(
        "item_id", "place", "d.class_name", "d.class_id", "d.confidence", "d.kind",
        F.get("d.box", F.lit(0)).alias("x1"), F.get("d.box", F.lit(3)).alias("y2"),
        F.get(F.get(d["mask"], F.lit(0)), F.lit(0)).alias("mask_x"),
        F.get(F.get(d["keypoints"], F.lit(0)), F.lit(1)).alias("key_y"), "d.track_id",
    )


@query(
    "aligned_batch",
    """SELECT page_id AS ord, CASE WHEN page_id % 4 = 0 OR page_id % 5 = 0 THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN page_id % 4 = 0 THEN 'too large' WHEN page_id % 5 = 0 THEN 'could not decode image' END AS detail,
       CASE WHEN page_id % 4 <> 0 AND page_id % 5 <> 0 THEN strlen(html) END AS size FROM pages""",
)
def aligned_batch(f: Inputs) -> DataFrame:
    k = F.col("page_id")
    inputs = f.table("pages").select(k.alias("ord"), F.when(k % 4 == 0, "too large").alias("error"))
    scored = f.table("pages").filter((k % 4 != 0) & (k % 5 != 0)).select(
        k.alias("ord"), F.octet_length("html").cast("bigint").alias("size")
    )
    return results.aligned_batch(inputs, scored)
