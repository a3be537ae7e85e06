"""Greedy matching of one island: boxes that overlap nothing outside of it.

A crowded image is cut along x and then along y where no box reaches across. An island of
bounded size is settled by one task, which holds its boxes and a bounded number of its best
pairs at a time, never all of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions.geometry import CORNERS
from boxloom.session import durable, sent_if_few, shuffle_partitions

#: An image is cut at the edges of so many columns, and of so many lines, at most.
_COLUMNS = 4096


def _starts(cells: DataFrame, keys: list[str], place: str, low: str, high: str, name: str) -> DataFrame:
    """``cells`` with ``name``, the strip of their group they lie in.

    A strip ends at a column before which all earlier boxes end, so boxes of different
    strips do not overlap. Only the ends of columns are put in order.
    """
    in_order = Window.partitionBy(*keys).orderBy(place)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    columns = cells.groupBy(*keys, place).agg(F.min(low).alias("_from"), F.max(high).alias("_to"))
    starts = (F.col("_from") >= F.max("_to").over(before)).cast("int")
    columns = columns.withColumn("_starts", F.coalesce(starts, F.lit(0))).select(
        *keys, place, F.sum("_starts").over(in_order).alias(name)
    )
    columns = columns.withColumnsRenamed({k: f"_k_{k}" for k in [*keys, place]})
    return cells.join(columns, _same([*keys, place])).select(*cells.columns, name)


def _same(keys: list[str]) -> Column:
    """Equality with the renamed keys of the other side."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])


def _looked_up(boxes: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``boxes`` with the other columns of ``table``, which is sent to all tasks if few rows by count."""
    table = table.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return boxes.join(sent_if_few(table)[0], _same(keys)).drop(*[f"_k_{k}" for k in keys])


def in_islands(boxes: DataFrame, image: str) -> tuple[DataFrame, DataFrame]:
    """``boxes`` with area and their island ``strip, part``, and every island's boxes in its larger set.

    Boxes count into cells of a column and a line first; what else is done to find the
    islands is done to cells.
    """
    solid = boxes.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    sides = {"_x": ("x1", "x2"), "_y": ("y1", "y2")}
    ends = durable(solid.groupBy(image).agg(
        *[F.min(low).alias(f"{place}_lo") for place, (low, _) in sides.items()],
        *[F.max(high).alias(f"{place}_hi") for place, (_, high) in sides.items()],
    ))
    placed = _looked_up(solid, ends, [image]).withColumns({
        place: F.floor((F.col(low) - F.col(f"{place}_lo")) / (F.col(f"{place}_hi") - F.col(f"{place}_lo")) * _COLUMNS)
        for place, (low, _) in sides.items()
    }).select(*boxes.columns, "_x", "_y")
    cells = durable(placed.groupBy(image, "_x", "_y").agg(
        *[F.min(c).alias(c) for c in ("x1", "y1")], *[F.max(c).alias(c) for c in ("x2", "y2")],
        F.count_if("base").alias("b"), F.count_if(~F.col("base")).alias("c"),
    ))
    strips = _starts(cells, [image], "_x", "x1", "x2", "strip")
    cells = durable(_starts(strips, [image, "strip"], "_y", "y1", "y2", "part"))
    islands = cells.groupBy(image, "strip", "part").agg(F.greatest(F.sum("b"), F.sum("c")).alias("boxes"))
    parts = _looked_up(placed, cells.select(image, "_x", "_y", "strip", "part"), [image, "_x", "_y"])
    return parts.drop("_x", "_y"), durable(islands)


def settle_islands(boxes: DataFrame, threshold: float, image: str) -> DataFrame:
    """The matches of small islands; ``base`` tells the two sets apart."""
    kind = boxes.schema[image].dataType.simpleString()
    schema = f"{image} {kind}, pass int, down double, i bigint, j bigint, b_class string, c_class string"

    def settle(island: pd.DataFrame) -> pd.DataFrame:
        names = island["class_name"].to_numpy(dtype=object)
        codes = pd.factorize(names)[0]
        pos, box = island["pos"].to_numpy(), island[list(CORNERS)].to_numpy(dtype=float)
        base = island["base"].to_numpy(dtype=bool)
        b, c = _Types(np.flatnonzero(base), pos, box, codes), _Types(np.flatnonzero(~base), pos, box, codes)
        taken = list(match(b, c, threshold))
        first, second = [t[2] for t in taken], [t[3] for t in taken]
        out = pd.DataFrame({"pass": [t[0] for t in taken], "down": [-t[1] for t in taken], "i": pos[first], "j": pos[second]})
        out["b_class"], out["c_class"] = names[first], names[second]
        out.insert(0, image, island[image].iloc[0])
        return out

    keys = [image, "strip", "part"]
    spread = boxes.repartition(shuffle_partitions(boxes.sparkSession), *keys)
    return spread.groupBy(*keys).applyInPandas(settle, schema)


class _Types:
    """One set's boxes by type; rows of equal class and corners are one, used up by position."""

    def __init__(self, rows: np.ndarray, pos: np.ndarray, box: np.ndarray, codes: np.ndarray) -> None:
        rows = rows[np.lexsort((pos[rows], *box[rows].T[::-1], codes[rows]))]
        box, codes = box[rows], codes[rows]
        new = np.ones(len(rows), bool)
        new[1:] = (box[1:] != box[:-1]).any(axis=1) | (codes[1:] != codes[:-1])
        self.rows, self.place = rows.tolist(), pos[rows].tolist()
        starts = np.flatnonzero(new)
        self.next, self.end = starts.tolist(), np.append(starts[1:], len(rows)).tolist()
        self.box, self.code = box[starts], codes[starts]
        self.area = (self.box[:, 2] - self.box[:, 0]) * (self.box[:, 3] - self.box[:, 1])
        self.free = np.ones(len(starts), bool)

    def head(self, t: int) -> int:
        """The least position of a type's free rows."""
        return self.place[self.next[t]]

    def take(self, t: int) -> int:
        row = self.rows[self.next[t]]
        self.next[t] += 1
        self.free[t] = self.next[t] < self.end[t]
        return row


#: Pairs of types held at once, in units of the types they are chosen from, boxes of a leaf,
#: boxes that a leaf meets in one step, pairs of types that need no bands, and their least IoU.
_HELD, _LEAST, _BLOCK, _STEP, _FEW, _BANDS = 32, 65_536, 64, 2_048, 65_536, (0.96, 0.92, 0.86, 0.78, 0.65)


def match(b: _Types, c: _Types, threshold: float) -> Iterator[tuple[int, float, int, int]]:
    """``pass, iou, row, row`` of the matches."""
    for code in np.intersect1d(b.code, c.code):
        yield from _choose(b, c, b.code == code, c.code == code, False, threshold, 0)
    yield from _choose(b, c, np.True_, np.True_, True, threshold, 1)


def _choose(b: _Types, c: _Types, b_part, c_part, differ: bool, threshold: float, stage: int):
    """Best pairs first, in bands of falling IoU. Once the pairs above a value are decided, no
    two free boxes have such a pair, so the next are found among what is left."""
    low = np.inf
    while True:
        left, right = np.flatnonzero(b.free & b_part), np.flatnonzero(c.free & c_part)
        bands = _BANDS if len(left) * len(right) > _FEW else ()
        band = max((v for v in bands if threshold < v < low), default=threshold)
        low, values, i, j = _best_pairs(b, c, left, right, differ, band)
        yield from ((stage, *pair) for pair in _in_order(b, c, values, i, j))
        if low <= threshold:
            return


def _leaves(box: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``rows`` in leaves of near-equal boxes, a leaf a line, and what of it is no filling.

    All parts are cut in halves along the corner that differs most for the boxes' size.
    """
    depth = (-(-len(rows) // _BLOCK) - 1).bit_length()
    size = -(-len(rows) // 2**depth)
    count, rows = len(rows), np.append(rows, np.repeat(rows[:1], size * 2**depth - len(rows)))
    scaled = box[rows] / np.tile((box[rows, 2:] - box[rows, :2]).mean(axis=0), 2)
    at = np.arange(len(rows))[None, :]
    for _ in range(depth):
        near, half = scaled[at], at.shape[1] // 2
        side = (near.max(axis=1) - near.min(axis=1)).argmax(axis=1)
        order = np.argpartition(np.take_along_axis(near, side[:, None, None], 2)[:, :, 0], half, axis=1)
        at = np.take_along_axis(at, order, 1).reshape(-1, half)
    return rows[at], at < count


def _ranges(box: np.ndarray) -> np.ndarray:
    """Least corner, greatest corner, least and greatest size of every leaf (or single box)."""
    size = box[..., 2:] - box[..., :2]
    if box.ndim == 2:
        return np.concatenate([box, size, size], axis=1).T
    ends = [box[..., :2].min(axis=1), box[..., 2:].max(axis=1), size.min(axis=1), size.max(axis=1)]
    return np.concatenate(ends, axis=1).T


def _may_reach(a: np.ndarray, b: np.ndarray, low: float) -> np.ndarray:
    """Whether boxes within two ranges can have an IoU of ``low``.

    An IoU is at most p / (2 - p), where p is the shared area by the root of both areas;
    along an axis, what is shared by the root of both sides rises with what is shared.
    """
    shared, sides = 1.0, 1.0
    for d in (0, 1):
        wide = np.minimum(a[2 + d], b[2 + d]) - np.maximum(a[d], b[d])
        wide = np.maximum(np.minimum(wide, np.minimum(a[6 + d], b[6 + d])), 0.0)
        shared = shared * wide
        sides = sides * (np.maximum(wide, a[4 + d]) * np.maximum(wide, b[4 + d]))
    return (shared > 0) & (shared * shared >= (2 * low / (1 + low)) ** 2 * (1 - 1e-9) * sides)


def _best_pairs(b: _Types, c: _Types, left: np.ndarray, right: np.ndarray, differ: bool, low: float):
    """A value and all pairs of free types that reach it, about as many as may be held.

    Leaves of both sets are compared first, then a leaf with single boxes, then boxes.
    """
    held = max(_LEAST, _HELD * (len(left) + len(right)))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = 0

    def joined():
        return tuple(np.concatenate([f[n] for f in found]) if found else np.empty(0, float if n == 0 else int) for n in range(3))

    if not len(left) or not len(right):
        return low, *joined()
    (leaves, real), (others, real_others) = _leaves(b.box, left), _leaves(c.box, right)
    near, far, single = _ranges(b.box[leaves]), _ranges(c.box[others]), _ranges(c.box)
    for n, own in enumerate(near.T[:, :, None]):
        block, met = leaves[n][real[n]], _may_reach(own, far, low)
        reached = others[met][real_others[met]]
        reached = reached[_may_reach(own, single[:, reached], low)]
        box, area = b.box[block].T[:, :, None], b.area[block][:, None]
        for at in range(0, len(reached), _STEP):
            part = reached[at:at + _STEP]
            x1, y1, x2, y2 = single[:4, part]
            wide = np.minimum(box[2], x2) - np.maximum(box[0], x1)
            high = np.minimum(box[3], y2) - np.maximum(box[1], y1)
            shared = np.maximum(wide, 0.0) * np.maximum(high, 0.0)
            value = shared / (area + c.area[part] - shared)
            fits = (value >= low) & (shared > 0)
            if differ:
                fits &= b.code[block][:, None] != c.code[part]
            p, q = np.nonzero(fits)
            found.append((value[p, q], block[p], part[q]))
            count += len(p)
            if count > 2 * held:
                values, i, j = joined()
                low = float(np.partition(values, count - held)[count - held])
                kept = values >= low
                found, count = [(values[kept], i[kept], j[kept])], int(kept.sum())
                held = max(held, count)  # a value that very many pairs share stays whole
    return low, *joined()


def _in_order(b: _Types, c: _Types, values: np.ndarray, i: np.ndarray, j: np.ndarray):
    """Take pairs by falling value; among equal ones the first free row of the first set
    takes its first free partner."""
    order = np.argsort(-values, kind="stable")
    values, i, j = values[order], i[order], j[order]
    ends = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values))
    at = 0
    while at < len(values):
        # a portion ends with a value; what is used up by then is left out in one step
        stop = ends[min(np.searchsorted(ends, at + 4096), len(ends) - 1)]
        free = np.flatnonzero(b.free[i[at:stop]] & c.free[j[at:stop]]) + at
        rows = zip(values[free].tolist(), i[free].tolist(), j[free].tolist())
        at = stop
        level, partners = None, {}
        for value, t, u in rows:
            if value != level:
                if partners:
                    yield from _level(b, c, level, partners)
                level, partners = value, {}
            partners.setdefault(t, []).append(u)
        if partners:
            yield from _level(b, c, level, partners)


def _level(b: _Types, c: _Types, value: float, partners: dict[int, list[int]]):
    heads = [(b.head(t), t) for t in partners if b.free[t]]
    heapq.heapify(heads)
    while heads:
        _, t = heapq.heappop(heads)
        options = [u for u in partners[t] if c.free[u]]
        if not options:
            continue
        u = min(options, key=c.head)
        yield value, b.take(t), c.take(u)
        if b.free[t]:
            heapq.heappush(heads, (b.head(t), t))
