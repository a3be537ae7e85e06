"""Greedy one-to-one matching of two annotation sets.

Same-class pairs come first, then pairs whose classes differ; inside each pass
the larger IoU wins and ties go to the earlier positions. Ordinary images are
nested to one row each and matched by a fold over their sorted candidates: one
shuffle in all, none when the sets are already stored nested. Oversized images are
cut into islands that no box reaches across, one task each; islands too large for that
run rounds of pairs nobody else has a better claim on, which picks the same pairs
because the order of candidates is total.
"""

from __future__ import annotations

import heapq
from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions.geometry import CORNERS, corners, overlaps, shared_area
from boxloom.operators.islands import in_islands, settle_islands
from boxloom.operators.overlap import (
    check_threshold,
    collapse_copies,
    join_on_grid,
    split_by_size,
)
from boxloom.operators.ranking import row_numbers
from boxloom.schema import KINDS
from boxloom.session import durable, hot_group_rows

MATCH = (
    "struct<pass:int,down:double,i:bigint,j:bigint,b_class:string,c_class:string>"
)
PAIR = (
    "struct<kind:string,b_pos:bigint,c_pos:bigint,b_class:string,c_class:string,overlap:double>"
)
_OBJECT = ("pos", "class_name", "x1", "y1", "x2", "y2")


def nest_sets(baseline: DataFrame, current: DataFrame, image: str = "item_id") -> DataFrame:
    """One row per image with both sets as position-ordered arrays."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    item = F.struct(*[F.col(c) for c in _OBJECT], area.alias("area"))
    both = baseline.select(image, F.lit(True).alias("_base"), item.alias("_d")).unionByName(
        current.select(image, F.lit(False).alias("_base"), item.alias("_d"))
    )
    return both.groupBy(image).agg(
        F.sort_array(F.collect_list(F.when(F.col("_base"), F.col("_d")))).alias("b"),
        F.sort_array(F.collect_list(F.when(~F.col("_base"), F.col("_d")))).alias("c"),
    )


def _candidates(b: Column, c: Column, threshold: float) -> Column:
    """Sorted candidate edges of one row. Interpreted per pair, so kept lean."""

    def touching(x: Column) -> Column:
        near = F.filter(c, lambda y: overlaps(corners(x), corners(y)))
        shared = F.transform(
            near, lambda y: F.struct(y.alias("y"), shared_area(corners(x), corners(y)).alias("s"))
        )
        return F.transform(
            shared,
            lambda e: F.struct(
                F.when(x["class_name"].eqNullSafe(e["y"]["class_name"]), 0).otherwise(1).alias("pass"),
                (-(e["s"] / (x["area"] + e["y"]["area"] - e["s"]))).alias("down"),
                x["pos"].alias("i"),
                e["y"]["pos"].alias("j"),
                x["class_name"].alias("b_class"),
                e["y"]["class_name"].alias("c_class"),
            ),
        )

    edges = F.flatten(F.transform(b, touching))
    return F.sort_array(F.filter(edges, lambda e: e["down"] <= -threshold))


def _take_greedily(edges: Column) -> Column:
    return F.aggregate(
        edges,
        F.array().cast(f"array<{MATCH}>"),
        lambda taken, e: F.when(
            F.exists(taken, lambda m: (m["i"] == e["i"]) | (m["j"] == e["j"])), taken
        ).otherwise(F.concat(taken, F.array(e))),
    )


def _pair(kind, b_pos, c_pos, b_class, c_class, overlap) -> Column:
    return F.struct(
        kind.alias("kind"),
        b_pos.cast("bigint").alias("b_pos"),
        c_pos.cast("bigint").alias("c_pos"),
        b_class.cast("string").alias("b_class"),
        c_class.cast("string").alias("c_class"),
        overlap.cast("double").alias("overlap"),
    )


def _one_sided(kind: str, d: Column) -> Column:
    nothing = F.lit(None)
    if kind == "missing":
        return _pair(F.lit(kind), d["pos"], nothing, d["class_name"], nothing, F.lit(0.0))
    return _pair(F.lit(kind), nothing, d["pos"], nothing, d["class_name"], F.lit(0.0))


def _label_pair(b: Column, c: Column) -> Column:
    """The verdict on two first elements, either of which may be absent."""
    same = b["class_name"].eqNullSafe(c["class_name"])
    return (
        F.when(b.isNull(), _one_sided("added", c))
        .when(c.isNull(), _one_sided("missing", b))
        .otherwise(
            _pair(
                F.when(same, "agreed").otherwise("reclassified"),
                b["pos"], c["pos"], b["class_name"], c["class_name"], F.lit(1.0),
            )
        )
    )


def _boxless(side: Column) -> Column:
    return (F.array_size(side) > 0) & F.forall(side, lambda d: d["x1"].isNull())


def diff_nested(nested: DataFrame, threshold: float) -> DataFrame:
    """Add ``matches`` and ``pairs`` to rows holding both sets as ``b`` and ``c``."""
    b, c = F.col("b"), F.col("c")
    matched = (
        nested.withColumn("labels", _boxless(b) | _boxless(c))
        .withColumn("edges", F.when(~F.col("labels"), _candidates(b, c, threshold)))
        .withColumn(
            "matches",
            F.when(F.col("labels"), F.array().cast(f"array<{MATCH}>"))
            .when(F.array_size("edges") <= 1, F.col("edges"))
            .otherwise(_take_greedily(F.col("edges"))),
        )
        .drop("edges")
    )
    m = F.col("matches")
    found = F.transform(
        m,
        lambda e: _pair(
            F.when(e["pass"] == 0, "agreed").otherwise("reclassified"),
            e["i"], e["j"], e["b_class"], e["c_class"], -e["down"],
        ),
    )
    missing = F.transform(
        F.filter(b, lambda d: ~F.exists(m, lambda e: e["i"] == d["pos"])),
        lambda d: _one_sided("missing", d),
    )
    added = F.transform(
        F.filter(c, lambda d: ~F.exists(m, lambda e: e["j"] == d["pos"])),
        lambda d: _one_sided("added", d),
    )
    label = F.array(_label_pair(F.get(b, F.lit(0)), F.get(c, F.lit(0))))
    return matched.withColumn(
        "pairs", F.when(F.col("labels"), label).otherwise(F.concat(found, missing, added))
    )


#: Boxes of either set in an island that one task settles.
_ISLAND_BOXES = 200_000


def match_crowds(
    baseline: DataFrame, current: DataFrame, threshold: float, image: str = "item_id"
) -> DataFrame:
    """Greedy matching of oversized images, island by island; in rounds where an island is
    too large for one task."""
    limit = min(_ISLAND_BOXES, hot_group_rows(baseline.sparkSession))
    columns = [image, "pos", "class_name", *CORNERS]
    both = baseline.select(*columns, F.lit(True).alias("base")).unionByName(
        current.select(*columns, F.lit(False).alias("base"))
    )
    boxes, islands = in_islands(both, image)
    large = islands.filter(F.col("boxes") > limit)
    keys = [image, "strip", "part"]
    if large.isEmpty():
        return durable(settle_islands(boxes, threshold, image))
    rest = durable(boxes.join(large, keys, "left_semi"))
    small = settle_islands(boxes.join(large, keys, "left_anti"), threshold, image)
    rounds = match_in_rounds(rest.filter("base"), rest.filter("not base"), threshold, image)
    return durable(small).unionByName(rounds)


def match_in_rounds(
    baseline: DataFrame, current: DataFrame, threshold: float, image: str = "item_id"
) -> DataFrame:
    """Greedy matching of oversized images as distributed rounds.

    Copies of a baseline box have the same partners in the same order and are used
    up by rising position, so one *type* stands for all of them. Pairs are never stored as a
    whole. Pairs of one class come first, and among them bands of falling IoU: a band's
    pairs are found anew from the types and partners that are still free, and every pair of
    a band comes before those of the next. In a round the m-th best partner of a type is
    offered the type's m-th free copy, and the pair is final when no other type has a
    better claim on that partner. A type keeps its pairs up to the first refusal. The best
    pair left is always final, so every round makes progress and chooses what choosing
    pair by pair would. A round stores at most one pair for a free copy and two for a
    partner. Once the counted rest fits a task, it is settled directly.
    """
    boxed = F.col("x1").isNotNull()
    types, members = collapse_copies(baseline.filter(boxed), image)
    places = durable(
        row_numbers(members, [image, "type"], [F.col("pos")], "place").select(
            F.col(image).alias("_pk"), F.col("type").alias("_pt"), F.col("place").alias("_pn"),
            F.col("pos").alias("_pi"),
        )
    )
    match = _Crowd(types, current.filter(boxed), places, image)
    limit = hot_group_rows(baseline.sparkSession)
    for same in (True, False):
        for low in [b for b in _BANDS if b > threshold] + [threshold]:
            rest = match.edges(threshold, same)
            if (count := rest.count()) <= limit:
                if count:
                    match.settle(rest)
                break
            while (count := match.edges(low, same).count()) > limit:
                match.round(match.edges(low, same))
            if count:
                match.settle(match.edges(low, same))
    return match.taken()


#: Least IoU of the bands above the threshold.
_BANDS = (0.9, 0.75, 0.6)


class _Crowd:
    """What is free of oversized images, and the pairs that are final."""

    def __init__(self, types: DataFrame, partners: DataFrame, places: DataFrame, image: str) -> None:
        self.image, self.places, self.pairs = image, places, []
        self.schema = f"{image} {types.schema[image].dataType.simpleString()}, pass int, down double, i bigint, j bigint, b_class string, c_class string"
        nothing = F.lit(None).cast("bigint")
        self.partners = partners.select(
            image, "pos", "class_name", *CORNERS, *[nothing.alias(c) for c in ("head", "used", "free")]
        )
        self.types = self._headed(types.withColumn("used", F.lit(0).cast("bigint")))

    def _at(self, rows: DataFrame, key: str, place: Column, name: str) -> DataFrame:
        """Add the position of a type's copy by its number."""
        on = (F.col(self.image) == F.col("_pk")) & (F.col(key) == F.col("_pt")) & (place == F.col("_pn"))
        return rows.join(self.places, on).withColumn(name, F.col("_pi")).drop("_pk", "_pt", "_pn", "_pi")

    def _headed(self, types: DataFrame) -> DataFrame:
        """Types with free copies, with the first of these."""
        kept = types.filter("used < copies").select(self.image, "pos", "class_name", *CORNERS, "copies", "used")
        return durable(self._at(kept, "pos", F.col("used") + 1, "head").withColumn("free", F.col("copies") - F.col("used")))

    def edges(self, low: float, same: bool) -> DataFrame:
        """Pairs of what is free, of equal or of different classes; nothing of it is stored."""
        keys, extra = [self.image], ["head", "used", "free"]
        if same:
            found = join_on_grid(self.types, self.partners, [*keys, "class_name"], low, extra).withColumns(
                {"b_class_name": F.col("class_name"), "c_class_name": F.col("class_name")}
            )
        else:
            differ = ~F.col("b_class_name").eqNullSafe(F.col("c_class_name"))
            found = join_on_grid(self.types, self.partners, keys, low, ["class_name", *extra], differ)
        return found.select(
            self.image, F.lit(0 if same else 1).alias("pass"), (-F.col("iou")).alias("down"), F.col("i").alias("type"), "j",
            F.col("b_class_name").alias("b_class"), F.col("c_class_name").alias("c_class"),
            F.col("b_head").alias("head"), F.col("b_used").alias("used"), F.col("b_free").alias("free"),
        )

    def round(self, edges: DataFrame) -> None:
        most = min(_OFFERS, self.types.agg(F.coalesce(F.max("free"), F.lit(1))).first()[0])
        by_partner = Window.partitionBy(self.image, "j").orderBy("down", "head")
        claim = F.struct("down", "head", "type")
        claims = (
            edges.withColumn("_r", F.row_number().over(by_partner))
            .filter(F.col("_r") <= 2)
            .groupBy(F.col(self.image).alias("_ck"), F.col("j").alias("_cj"))
            .agg(F.min(claim).alias("_first"), F.max(F.when(F.col("_r") == 2, claim)).alias("_second"))
        )
        by_type = Window.partitionBy(self.image, "type").orderBy("down", "j")
        offers = (
            edges.withColumn("_m", F.row_number().over(by_type))
            .filter(F.col("_m") <= most)
            .filter(F.col("_m") <= F.col("free"))
        )
        offers = self._at(offers, "type", F.col("used") + F.col("_m"), "i")
        rival = F.when(F.col("_first.type") == F.col("type"), F.col("_second")).otherwise(F.col("_first"))
        judged = offers.join(
            claims, (F.col(self.image) == F.col("_ck")) & (F.col("j") == F.col("_cj"))
        ).withColumn("_rival", rival)
        better = F.struct(F.col("_rival.down"), F.col("_rival.head")) < F.struct(F.col("down"), F.col("i").alias("head"))
        refused = F.col("_rival").isNotNull() & better
        whole_type = Window.partitionBy(self.image, "type")
        final = (
            judged.withColumn("_stop", F.min(F.when(refused, F.col("_m"))).over(whole_type))
            .filter(F.col("_stop").isNull() | (F.col("_m") < F.col("_stop")))
        )
        self._take(durable(final.select(self.image, "pass", "down", "type", "i", "j", "b_class", "c_class")))

    def settle(self, edges: DataFrame) -> None:
        """Take pairs that are few by count, in order."""
        edges = durable(edges.select(self.image, "pass", "down", "type", "j", "b_class", "c_class"))
        alive = self.types.select(F.col(self.image).alias("_k"), F.col("pos").alias("_t"), "used")
        on = (F.col("_k") == F.col("_pk")) & (F.col("_t") == F.col("_pt")) & (F.col("_pn") > F.col("used"))
        free = alive.join(self.places, on).select(F.col("_k").alias(self.image), F.col("_t").alias("type"), F.col("_pi").alias("i"))
        taken = durable(_finish(edges, free, self.image))
        owner = self.places.select(F.col("_pk").alias(self.image), F.col("_pi").alias("i"), F.col("_pt").alias("type"))
        self._take(durable(taken.join(owner, [self.image, "i"])))

    def _take(self, final: DataFrame) -> None:
        """Make pairs final and what they use no longer free."""
        self.pairs.append(final)
        spent = final.groupBy(F.col(self.image).alias("_k"), F.col("type").alias("_t")).agg(F.count("*").alias("_spent"))
        on = (F.col(self.image) == F.col("_k")) & (F.col("pos") == F.col("_t"))
        self.types = self._headed(self.types.drop("head", "free").join(spent, on, "left").withColumn("used", F.col("used") + F.coalesce("_spent", F.lit(0))))
        gone = final.select(F.col(self.image).alias("_k"), F.col("j").alias("_t"))
        self.partners = durable(self.partners.join(gone, on, "left_anti"))

    def taken(self) -> DataFrame:
        columns = [self.image, "pass", "down", "i", "j", "b_class", "c_class"]
        if not self.pairs:
            return self.types.sparkSession.createDataFrame([], self.schema)
        return reduce(DataFrame.unionByName, [p.select(columns) for p in self.pairs])


def _finish(edges: DataFrame, free: DataFrame, image: str) -> DataFrame:
    """The last edges of each image, few enough by count for one task, in order.

    Only free copies of types that still have an edge are brought along.
    """
    wanted = free.join(
        edges.select(F.col(image).alias("_k"), F.col("type").alias("_t")).distinct(),
        (F.col(image) == F.col("_k")) & (F.col("type") == F.col("_t")),
        "left_semi",
    )
    # A type can use at most one copy per edge it has left.
    degree = edges.groupBy(F.col(image).alias("_k"), F.col("type").alias("_t")).agg(
        F.count("*").alias("_most")
    )
    numbered = row_numbers(wanted, [image, "type"], [F.col("i")], "_n")
    bounded = numbered.join(degree, (F.col(image) == F.col("_k")) & (F.col("type") == F.col("_t"))).filter(
        F.col("_n") <= F.col("_most")
    ).select(image, "type", "i")
    kind = edges.schema[image].dataType.simpleString()
    schema = f"{image} {kind}, pass int, down double, i bigint, j bigint, b_class string, c_class string"

    def settle(left: pd.DataFrame, copies: pd.DataFrame) -> pd.DataFrame:
        queue: dict[int, list[int]] = {}
        for t, i in sorted(zip(copies["type"], copies["i"]), reverse=True):
            queue.setdefault(t, []).append(i)
        rows = sorted(zip(left["pass"], left["down"], left["type"], left["j"], range(len(left))), reverse=True)
        used: set[int] = set()
        picked: list[tuple[int, int]] = []
        while rows:
            level, partners = rows[-1][:2], {}
            while rows and rows[-1][:2] == level:
                _, _, t, j, at = rows.pop()
                partners.setdefault(t, deque()).append((j, at))
            heads = [(queue[t][-1], t) for t in partners if queue.get(t)]
            heapq.heapify(heads)
            while heads:
                i, t = heapq.heappop(heads)
                options = partners[t]
                while options and options[0][0] in used:
                    options.popleft()
                if not options:
                    continue
                j, at = options.popleft()
                used.add(j)
                picked.append((at, queue[t].pop()))
                if queue[t]:
                    heapq.heappush(heads, (queue[t][-1], t))
        names = [image, "pass", "down", "i", "j", "b_class", "c_class"]
        out = left.iloc[[at for at, _ in picked]].copy()
        out["i"] = [i for _, i in picked]
        return out[names]

    return edges.groupBy(image).cogroup(bounded.groupBy(image)).applyInPandas(settle, schema)


#: Partners one type is offered per round; more only means more rounds.
_OFFERS = 256


def _first_elements(side: DataFrame, image: str, name: str) -> DataFrame:
    """Per image: is the set boxless, and its element of least position."""
    return side.groupBy(image).agg(
        F.bool_and(F.col("x1").isNull()).alias(f"{name}_boxless"),
        F.min_by(F.struct("pos", "class_name"), "pos").alias(name),
    )


def heavy_matches(baseline: DataFrame, current: DataFrame, threshold: float, image: str):
    """``(matches, pairs)`` of oversized images, long form."""
    heads = _first_elements(baseline, image, "b").join(
        _first_elements(current, image, "c"), image, "full_outer"
    )
    labels = durable(
        heads.filter(
            F.coalesce(F.col("b_boxless"), F.lit(False)) | F.coalesce(F.col("c_boxless"), F.lit(False))
        )
    )
    only_labels = labels.select(F.col(image).alias("_l"))
    b = baseline.join(only_labels, F.col(image) == F.col("_l"), "left_anti")
    c = current.join(only_labels, F.col(image) == F.col("_l"), "left_anti")
    matches = match_crowds(b, c, threshold, image)

    found = matches.select(
        image,
        _pair(
            F.when(F.col("pass") == 0, "agreed").otherwise("reclassified"),
            F.col("i"), F.col("j"), F.col("b_class"), F.col("c_class"), -F.col("down"),
        ).alias("p"),
    )
    used_b = matches.select(F.col(image).alias("_k"), F.col("i").alias("_p"))
    used_c = matches.select(F.col(image).alias("_k"), F.col("j").alias("_p"))
    on = (F.col(image) == F.col("_k")) & (F.col("pos") == F.col("_p"))
    whole = F.struct("pos", "class_name")
    missing = b.join(used_b, on, "left_anti").select(image, _one_sided("missing", whole).alias("p"))
    added = c.join(used_c, on, "left_anti").select(image, _one_sided("added", whole).alias("p"))
    label = labels.select(image, _label_pair(F.col("b"), F.col("c")).alias("p"))
    pairs = found.unionByName(missing).unionByName(added).unionByName(label).select(image, "p.*")
    return matches, pairs


def _objects(detections: Column) -> Column:
    """Stored detections as matchable objects; only four numbers make a box."""

    def one(d: Column, pos: Column) -> Column:
        x1, y1, x2, y2 = (F.when(F.array_size(d["box"]) == 4, F.get(d["box"], F.lit(i))) for i in range(4))
        return F.struct(
            pos.cast("bigint").alias("pos"), d["class_name"].alias("class_name"),
            x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"),
            ((x2 - x1) * (y2 - y1)).alias("area"),
        )

    return F.coalesce(F.transform(detections, one), F.array())


def _unnest(nested: DataFrame, image: str, array: str, required: str) -> DataFrame:
    """Array elements as rows.

    The plain generator would make Catalyst infer a ``size > 0`` filter that
    evaluates the whole array expression a second time; the outer one does not.
    """
    return nested.select(image, F.inline_outer(array)).filter(F.col(required).isNotNull())


def _counts() -> list[Column]:
    def count(kind: str) -> Column:
        return F.array_size(F.filter("pairs", lambda p: p["kind"] == kind)).cast("bigint")

    return [count(k).alias(k) for k in KINDS]


class Comparison:
    """Two long annotation sets compared image by image.

    Both sets need ``item_id, pos, class_name, x1, y1, x2, y2``; a null ``x1``
    marks a detection without a box. ``largest`` is an upper bound of the objects
    per image and set, where the caller knows one; otherwise they are counted.
    """

    def __init__(
        self,
        baseline: DataFrame,
        current: DataFrame,
        threshold: float = 0.5,
        image: str = "item_id",
        largest: int | None = None,
    ) -> None:
        self.image = image
        self.threshold = check_threshold(threshold)
        light, heavy = split_by_size([baseline, current], [image], largest)
        self.nested = diff_nested(nest_sets(*light, image), self.threshold)
        self.heavy = None
        if heavy is not None:
            self.heavy = heavy_matches(*heavy, self.threshold, image)

    @classmethod
    def of_items(cls, items: DataFrame, threshold: float = 0.5, image: str = "item_id") -> Comparison:
        """Compare the ``baseline`` and ``detections`` arrays stored on each item.

        Both sets already share a row, so nothing is shuffled.
        """
        comparison = cls.__new__(cls)
        comparison.image = image
        comparison.threshold = check_threshold(threshold)
        nested = items.select(
            image, _objects(F.col("baseline")).alias("b"), _objects(F.col("detections")).alias("c")
        ).filter((F.array_size("b") > 0) | (F.array_size("c") > 0))
        comparison.nested = diff_nested(nested, comparison.threshold)
        comparison.heavy = None
        return comparison

    def matches(self) -> DataFrame:
        """``item_id, i, j, pass, iou`` of every matched pair."""
        columns = [self.image, "i", "j", "pass", (-F.col("down")).alias("iou")]
        rows = _unnest(self.nested, self.image, "matches", "pass").select(*columns)
        if self.heavy is not None:
            rows = rows.unionByName(self.heavy[0].select(*columns))
        return rows

    def pairings(self) -> DataFrame:
        """One row per object: ``kind, b_pos, c_pos, b_class, c_class, overlap``."""
        rows = _unnest(self.nested, self.image, "pairs", "kind")
        if self.heavy is not None:
            rows = rows.unionByName(self.heavy[1])
        return rows

    def counted_pairings(self) -> DataFrame:
        """:meth:`pairings` beside their image's :meth:`item_counts`, with one matching for both."""
        rows = self.nested.select(self.image, *_counts(), F.inline_outer("pairs")).filter(F.col("kind").isNotNull())
        if self.heavy is not None:
            pairs = self.heavy[1]
            counts = pairs.groupBy(F.col(self.image).alias("_k")).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
            rows = rows.unionByName(pairs.join(counts, F.col(self.image).eqNullSafe(F.col("_k"))).drop("_k"))
        return rows

    def item_counts(self) -> DataFrame:
        """Objects of each kind per image, without exploding nested rows."""
        rows = self.nested.select(self.image, *_counts())
        if self.heavy is not None:
            rows = rows.unionByName(
                self.heavy[1]
                .groupBy(self.image)
                .agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
            )
        return rows
