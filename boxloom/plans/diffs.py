"""Comparing two annotation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import box_area, corners, iou
from boxloom.operators import diff
from boxloom.operators.matching import Comparison
from boxloom.operators.overlap import iou_candidates
from boxloom.plans.fixtures import Inputs
from boxloom.plans.registry import query
from boxloom.schema import KINDS


def everything(f: Inputs) -> Comparison:
    return Comparison(f.baseline(), f.current(), largest=f.largest)


def done_only(f: Inputs) -> Comparison:
    items = f.items()
    return Comparison(
        diff.keep_done(f.baseline(), items), diff.keep_done(f.current(), items), largest=f.largest
    )


@query("greedy_match", "SELECT item_id, i, j, pass, iou FROM matches", "matches")
def greedy_match(f: Inputs) -> DataFrame:
    return everything(f).matches()


@query(
    "match_crowded",
    """WITH pairs AS (
  SELECT b.item_id * 100 + b.cluster AS spot, b.item_id, b.pos AS i, c.pos AS j, CASE WHEN b.class_name IS NOT DISTINCT FROM c.class_name THEN 0 ELSE 1 END AS pass,
         (least(b.x2, c.x2) - greatest(b.x1, c.x1)) * (least(b.y2, c.y2) - greatest(b.y1, c.y1)) AS inter,
         (b.x2 - b.x1) * (b.y2 - b.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) AS areas
  FROM crowd b JOIN crowd_now c ON b.item_id = c.item_id AND b.cluster = c.cluster
  WHERE least(b.x2, c.x2) > greatest(b.x1, c.x1) AND least(b.y2, c.y2) > greatest(b.y1, c.y1)),
near AS (SELECT spot, item_id, i, j, pass, inter / (areas - inter) AS iou FROM pairs WHERE inter / (areas - inter) >= 0.5e0),
r AS (SELECT *, row_number() OVER (PARTITION BY spot ORDER BY pass, iou DESC, i, j) AS rn FROM near),
f AS (SELECT spot, rn, item_id, i, j, pass, iou, true AS took, [i] AS ui, [j] AS uj FROM r WHERE rn = 1
  UNION ALL SELECT r.spot, r.rn, r.item_id, r.i, r.j, r.pass, r.iou, NOT (list_contains(f.ui, r.i) OR list_contains(f.uj, r.j)),
    CASE WHEN list_contains(f.ui, r.i) OR list_contains(f.uj, r.j) THEN f.ui ELSE list_append(f.ui, r.i) END,
    CASE WHEN list_contains(f.ui, r.i) OR list_contains(f.uj, r.j) THEN f.uj ELSE list_append(f.uj, r.j) END
  FROM f JOIN r ON r.spot = f.spot AND r.rn = f.rn + 1)
SELECT item_id, i, j, CAST(pass AS INTEGER) AS pass, iou FROM f WHERE took""",
    "crowd crowd_now",
)
def match_crowded(f: Inputs) -> DataFrame:
    """Images far beyond what one row can nest; boxes that can overlap lie in one spot, so
    the SQL may choose pairs spot by spot."""
    return Comparison(f.crowd(), f.crowd_now()).matches()


@query("iou_candidates_same", "SELECT item_id, b_class AS class_name, i, j, iou FROM cand WHERE pass = 0", "cand")
def iou_candidates_same(f: Inputs) -> DataFrame:
    return iou_candidates(f.baseline(), f.current(), 0.5, same_class=True, largest=f.largest)


@query(
    "iou_candidates_cross",
    "SELECT item_id, i, j, b_class AS b_class_name, c_class AS c_class_name, iou FROM cand WHERE pass = 1",
    "cand",
)
def iou_candidates_cross(f: Inputs) -> DataFrame:
    return iou_candidates(f.baseline(), f.current(), 0.5, same_class=False, largest=f.largest)


@query("diff_missing", "SELECT item_id, b_pos AS pos, b_class AS class_name FROM pairs WHERE kind = 'missing'", "pairs")
def diff_missing(f: Inputs) -> DataFrame:
    return (
        everything(f).pairings().filter(F.col("kind") == "missing")
        .select("item_id", F.col("b_pos").alias("pos"), F.col("b_class").alias("class_name"))
    )


@query("diff_added", "SELECT item_id, c_pos AS pos, c_class AS class_name FROM pairs WHERE kind = 'added'", "pairs")
def diff_added(f: Inputs) -> DataFrame:
    return (
        everything(f).pairings().filter(F.col("kind") == "added")
        .select("item_id", F.col("c_pos").alias("pos"), F.col("c_class").alias("class_name"))
    )


@query("pairings", "SELECT item_id, kind, b_pos, c_pos, b_class, c_class, overlap FROM pairs", "pairs")
def pairings(f: Inputs) -> DataFrame:
    return everything(f).pairings()


@query(
    "label_diff",
    """SELECT coalesce(b.item_id, c.item_id) AS item_id,
       CASE WHEN b.item_id IS NULL THEN 'added' WHEN c.item_id IS NULL THEN 'missing'
            WHEN b.class_name = c.class_name THEN 'agreed' ELSE 'reclassified' END AS kind,
       b.pos AS b_pos, c.pos AS c_pos, b.class_name AS b_class, c.class_name AS c_class,
       CASE WHEN b.item_id IS NULL OR c.item_id IS NULL THEN 0e0 ELSE 1e0 END AS overlap
FROM (SELECT * FROM label_baseline WHERE pos = 0) b
FULL OUTER JOIN (SELECT * FROM label_current WHERE pos = 2) c ON b.item_id = c.item_id""",
    "label_baseline label_current",
)
def label_diff(f: Inputs) -> DataFrame:
    return Comparison(f.label_baseline(), f.label_current()).pairings()


@query("item_diff", "SELECT * FROM verdicts", "verdicts")
def item_diff(f: Inputs) -> DataFrame:
    return diff.item_diff(done_only(f))


@query(
    "diff_summary",
    """SELECT count(*) AS items, count(*) FILTER (disputed = 0) AS items_identical,
       CAST(sum(agreed) AS BIGINT) AS agreed, CAST(sum(reclassified) AS BIGINT) AS reclassified,
       CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(added) AS BIGINT) AS added,
       count(*) - count(*) FILTER (disputed = 0) AS items_disputed,
       CAST(sum(disputed) AS BIGINT) AS disputed,
       CAST(printf('%.4f', sum(agreed) / CAST(sum(agreed + disputed) AS DOUBLE)) AS DOUBLE) AS agreement FROM verdicts""",
    "verdicts",
)
def diff_summary(f: Inputs) -> DataFrame:
    return diff.diff_summary(diff.item_diff(done_only(f)))


BY_CLASS = """SELECT coalesce(c_class, b_class) AS class_name, count(*) FILTER (kind = 'agreed') AS agreed,
       count(*) FILTER (kind = 'reclassified') AS reclassified, count(*) FILTER (kind = 'missing') AS missing,
       count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind <> 'agreed') AS disputed
FROM done_pairs GROUP BY 1"""
SWAPS = """SELECT concat(b_class, ' -> ', c_class) AS swap, count(*) AS "count"
FROM done_pairs WHERE kind = 'reclassified' GROUP BY 1"""


@query("diff_by_class", BY_CLASS, "done_pairs")
def diff_by_class(f: Inputs) -> DataFrame:
    return diff.diff_by_class(done_only(f).pairings())


@query("diff_swaps", SWAPS, "done_pairs")
def diff_swaps(f: Inputs) -> DataFrame:
    return diff.diff_swaps(done_only(f).pairings())


@query("top_swaps", f'{SWAPS} ORDER BY "count" DESC, swap LIMIT 6', "done_pairs")
def top_swaps(f: Inputs) -> DataFrame:
    return diff.top_swaps(diff_swaps(f))


@query(
    "top_disputed_classes",
    f"SELECT * FROM ({BY_CLASS}) WHERE disputed > 0 ORDER BY disputed DESC, class_name LIMIT 8",
    "done_pairs",
)
def top_disputed_classes(f: Inputs) -> DataFrame:
    return diff.top_disputed_classes(diff_by_class(f))


@query(
    "refresh_comparison",
    """SELECT t.item_id, t.rel_path, coalesce(v.disputed, t.disputed) AS disputed,
       coalesce(v.agreement, t.agreement) AS agreement FROM items t LEFT JOIN verdicts v ON v.item_id = t.item_id""",
    "items verdicts",
)
def refresh_comparison(f: Inputs) -> DataFrame:
    return diff.refresh_comparison(f.items(), done_only(f)).select(
        "item_id", "rel_path", "disputed", "agreement"
    )


@query(
    "item_comparison",
    """SELECT p.item_id, t.rel_path, t.baseline_count > 0 AS has_baseline, p.kind, p.b_pos, p.c_pos,
       CASE WHEN p.kind = 'reclassified' THEN p.b_class END AS from_class,
       CASE WHEN p.kind = 'reclassified' THEN p.c_class END AS to_class,
       CAST(printf('%.3f', p.overlap) AS DOUBLE) AS overlap, v.disputed, CAST(printf('%.4f', v.agreement) AS DOUBLE) AS agreement
FROM pairs p JOIN items t ON t.item_id = p.item_id
JOIN (SELECT item_id, count(*) FILTER (kind <> 'agreed') AS disputed,
             count(*) FILTER (kind = 'agreed') / CAST(count(*) AS DOUBLE) AS agreement
      FROM pairs GROUP BY item_id) v ON v.item_id = p.item_id""",
    "pairs items",
)
def item_comparison(f: Inputs) -> DataFrame:
    return diff.item_comparison(f.items(), everything(f))


@query(
    "iou",
    """SELECT b.item_id, b.pos AS i, c.pos AS j,
       CASE WHEN least(b.x2, c.x2) > greatest(b.x1, c.x1) AND least(b.y2, c.y2) > greatest(b.y1, c.y1)
            THEN (least(b.x2, c.x2) - greatest(b.x1, c.x1)) * (least(b.y2, c.y2) - greatest(b.y1, c.y1)) /
                 ((b.x2 - b.x1) * (b.y2 - b.y1) + (c.x2 - c.x1) * (c.y2 - c.y1)
                  - (least(b.x2, c.x2) - greatest(b.x1, c.x1)) * (least(b.y2, c.y2) - greatest(b.y1, c.y1)))
            ELSE 0e0 END AS iou
FROM baseline b JOIN current_set c ON b.item_id = c.item_id AND b.pos = c.pos""",
    "baseline current_set",
)
def iou_of_twins(f: Inputs) -> DataFrame:
    b = f.baseline().select("item_id", "pos", *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    c = f.current().select("item_id", "pos", *[F.col(c).alias(f"c_{c}") for c in ("x1", "y1", "x2", "y2")])
    return b.join(c, ["item_id", "pos"]).select(
        "item_id", F.col("pos").alias("i"), F.col("pos").alias("j"),
        iou(corners(prefix="b_"), corners(prefix="c_")).alias("iou"),
    )


@query("box_area", "SELECT item_id, pos, (x2 - x1) * (y2 - y1) AS area FROM current_set", "current_set")
def areas(f: Inputs) -> DataFrame:
    return f.current().select("item_id", "pos", box_area(corners()).alias("area"))


@query(
    "two_sided_counts",
    """SELECT t.item_id, coalesce(c.n, 0) AS shown, coalesce(b.n, 0) AS baseline_shown,
       CASE WHEN coalesce(b.total, 0) = 0 THEN NULL WHEN t.disputed > 0 THEN concat(t.disputed, ' differ')
            ELSE 'identical' END AS verdict
FROM items t
LEFT JOIN (SELECT item_id, count(*) FILTER (confidence >= 0.4e0) AS n FROM current_set GROUP BY 1) c ON c.item_id = t.item_id
LEFT JOIN (SELECT item_id, count(*) FILTER (confidence >= 0.4e0) AS n, count(*) AS total FROM baseline GROUP BY 1) b
  ON b.item_id = t.item_id""",
    "items baseline current_set",
)
def two_sided_counts(f: Inputs) -> DataFrame:
    from boxloom.operators.review import two_sided_counts as op

    return op(f.items(), f.current(), f.baseline(), 0.4)
