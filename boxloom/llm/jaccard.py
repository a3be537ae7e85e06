"""Size-aware heavy-light Jaccard join over word shingles, and its components.

Two documents link when ``100 * intersection >= percent * union`` of their shingle sets.

* *Light* sets enumerate subsets. Sets of sizes a <= b that link share at least
  ``c(a, b)`` shingles, hence a subset of exactly that size; every light set lists its
  subsets of each size it may share, and equal subsets meet.
* *Heavy* sets are found by scanning inverted lists. A list is keyed by a block: all
  shingles of a set whose hash falls into one of m parts. Linked sets differ in at most
  D shingles, so with m = D + 1 + spare parts at least spare + 1 blocks are equal, and
  one of those holds shingles. Mostly many do: a set knows its own empty parts and by how
  many shingles a partner may differ, hence how many filled blocks they share at least. If
  fewer of its blocks occur twice at all, it is in none of the scheme's lists. So a
  common phrase lists no text, though a larger corpus has more of them.
* The boundary is the largest size at which the subsets cost less than ``LIST_COST``
  times the blocks, an estimate of what scanning and verifying a list entry costs.

Sets are first collapsed by digest, so copies are one node. A list's nodes are then
verified against its head, which is dropped; pairs in one component by then need no
check. The nodes of lists that stay open, mostly sets that share much and yet do not
link, are read once more by inverted lists of single shingles, the rarest of each set among these nodes, with bounds by size and position:
of two linked sets the first shared shingle stands early in both. They are
read in two rounds, because what the first joins needs no more checks. Every pair that could
join two components is verified on the texts' sets, no list is cut, and no group of
copies is expanded into all its pairs.

Most pairs share a passage and are far from linked. A node's *sketch*, about one bit a
shingle, tells them without the texts: a bit is the parity of the shingles that fall on
it, so two sets differ in at least as many shingles as their sketches do in bits. Only
pairs that the sketches leave possible meet with their texts. Tables go as soon as no
step reads them.

Defined cases: null and empty texts have no shingle and link with nothing; a text of
fewer words than a shingle is one shingle; a null doc_id comes last among ids; rows with
one doc_id are separate rows; no documents give no rows. Sets are told apart by 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from itertools import combinations
from math import ceil, comb, exp, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.graph import components
from boxloom.llm.tables import by_batch, done_with, narrow, release, stored, unused
from boxloom.llm.words import SPACED, Chunk, as_long, chunks, grams, list_column, mix

#: Cost of an inverted-list entry in units of an enumerated subset.
LIST_COST = 4
#: Bits of the bitmap of repeated signatures as a power of two: 16 MiB.
BITMAP_BITS = 27
#: Bytes of text whose sets are compared at once.
VERIFY_BYTES = 4 << 20
#: The bits of a signature that each probe of the bitmap skips.
PROBES = (0, 18, 37)
#: Bits of the smallest sketch; a set takes the next power of two from its size on.
SKETCH_BITS = 64

#: Inverted lists are read in rounds, each of one in so many of the open pairs; the last
#: takes every pair that is open still.
PARTS = (8, 1)

_LARGEST = 1 << 40
_LAST = (1 << 63) - 1
_U = np.uint64
_SIGNED = "id bigint, node bigint, n_shingles bigint, signatures array<bigint>, sketch binary, text string"
_PAIRS = "a bigint, b bigint"
_VERIFIED = "a bigint, b bigint, linked boolean"


@dataclass(frozen=True)
class Plan:
    """Sizes and schemes of one join; ``classes[k]`` is the least size of class k."""

    shingle: int
    percent: int
    light: int
    classes: tuple[int, ...]
    parts: tuple[int, ...]
    spare: tuple[int, ...]

    def overlap(self, a: int, b: int) -> int:
        """The least intersection with which sets of these sizes link."""
        return -(-self.percent * (a + b) // (100 + self.percent))


def plan_for(shingle: int, percent: int) -> Plan:
    classes = [1]
    while classes[-1] < _LARGEST:
        classes.append(classes[-1] * 100 // percent + 1)
    parts, spare = [], []
    for least, after in zip(classes[:-1], classes[1:], strict=True):
        most = after - 1
        differ = (most + most * 100 // percent) * (100 - percent) // (100 + percent)
        empty = (differ + 1) * exp(-least / (differ + 1))
        spare.append(ceil(empty + 6 * sqrt(empty)) + 1 if differ else 0)
        parts.append(differ + 1 + spare[-1])
    plan = Plan(shingle, percent, 0, tuple(classes[:-1]), tuple(parts), tuple(spare))
    light = 0
    while light < 64:
        size = light + 1
        k = int(np.searchsorted(plan.classes, size, side="right")) - 1
        blocks = plan.parts[k] + (plan.parts[k - 1] if k else 0)
        if sum(comb(size, c) for _, _, c in _partners(plan, size, size * 2)) > LIST_COST * blocks:
            break
        light = size
    return Plan(shingle, percent, light, plan.classes, plan.parts, plan.spare)


def _partners(plan: Plan, size: int, most: int) -> list[tuple[int, int, int]]:
    """``(a, b, overlap)`` of all size pairs a <= b <= most that a set can be part of."""
    pairs = [(min(size, other), max(size, other)) for other in range(1, most + 1)]
    return [(a, b, plan.overlap(a, b)) for a, b in pairs if plan.overlap(a, b) <= a]


def _sets(chunk: Chunk, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles as sorted ``(row, value)``, and the set size of every row."""
    left = chunk.left()
    at = np.flatnonzero(left >= shingle)
    rows, values = chunk.row_of()[at], grams(chunk.hashes, shingle)[at]
    short = np.flatnonzero((chunk.counts > 0) & (chunk.counts < shingle))
    if len(short):
        whole = [grams(chunk.hashes[chunk.bounds[r] : chunk.bounds[r + 1]], shingle)[:1] for r in short]
        rows, values = np.concatenate((rows, short)), np.concatenate((values, *whole))
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[new], values[new]
    return rows, values, np.bincount(rows, minlength=len(chunk.counts))


def _block_signatures(plan: Plan, rows: np.ndarray, values: np.ndarray, sizes: np.ndarray,
                      back: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, signature)`` under the scheme of each row's class, or the class before it, and
    how many of a row's filled blocks any set has that links with it there."""
    k = np.searchsorted(np.array(plan.classes), np.maximum(sizes, 1), side="right") - 1 - back
    wanted = (sizes > 0) & (k >= 0)
    # a light set takes part if a set beyond the boundary can be its partner
    wanted &= np.array([n > plan.light or plan.overlap(int(n), plan.light + 1) <= n for n in sizes])
    k = np.maximum(k, 0)
    parts = np.where(wanted, np.array(plan.parts)[k], 0)
    base = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum(parts, out=base[1:])
    own = wanted[rows]
    rows, values = rows[own], values[own]
    part = ((values >> _U(16)) % parts[rows].astype(np.uint64)).astype(np.int64)
    key = base[rows] + part
    total = np.zeros(base[-1], dtype=np.uint64)
    np.add.at(total, key, mix(values + _U(0xB10C)))
    filled = np.bincount(key, minlength=base[-1]) > 0
    row = np.repeat(np.arange(len(parts)), parts)
    place = np.arange(base[-1]) - base[row]
    scheme = mix(k[row].astype(np.uint64) * _U(1 << 32) + place.astype(np.uint64))
    signatures = mix(total + scheme)
    # a set with more empty parts than spare ones also joins the list of such sets
    empty = parts - np.bincount(row[filled], minlength=len(parts))
    bare = np.flatnonzero(wanted & (empty > np.array(plan.spare)[k]))
    # the largest partner in this scheme: under the class before, the other set is of that class
    other = np.array(plan.classes)[k + 1] - 1 if back else sizes * 100 // plan.percent
    differ = (sizes + other) * (100 - plan.percent) // (100 + plan.percent)
    return (np.concatenate((row[filled], bare)),
            np.concatenate((signatures[filled], mix(k[bare].astype(np.uint64) + _U(0xE3E3)))),
            parts - differ - empty)


def _subset_signatures(plan: Plan, rows: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> tuple[list, list]:
    out_rows, out = [], []
    bounds = np.searchsorted(rows, np.arange(len(sizes) + 1))
    for row in np.flatnonzero((sizes > 0) & (sizes <= plan.light)):
        own = mix(values[bounds[row] : bounds[row + 1]] + _U(0x5B5E))
        for a, b, overlap in _partners(plan, int(sizes[row]), plan.light):
            left_out = np.array([own[list(c)].sum(dtype=np.uint64) for c in combinations(range(len(own)), len(own) - overlap)],
                                dtype=np.uint64)
            tag = mix(np.array([a * 1000 + b + (1 << 50)], dtype=np.uint64))
            out.append(mix(own.sum(dtype=np.uint64) - left_out + tag))
            out_rows.append(np.full(len(left_out), row))
    return out_rows, out


def _sketches(rows: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the sketches of all rows, and how many each row has. A sketch folded in the
    middle is that of half as many bits."""
    bits = np.full(len(sizes), SKETCH_BITS, dtype=np.int64)
    while (low := bits < sizes).any():
        bits[low] *= 2
    bits[sizes == 0] = 0
    base = np.zeros(len(bits) + 1, dtype=np.int64)
    np.cumsum(bits, out=base[1:])
    slot = mix(values + _U(0x5CE7)) & (bits[rows].astype(np.uint64) - _U(1))
    parity = np.bincount(base[rows] + slot.astype(np.int64), minlength=base[-1]) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little"), bits // 8


def _possible(batch: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """The pairs that can link by what their sketches tell."""
    columns = [batch.column(c).to_pylist() for c in ("size_a", "size_b", "sketch_a", "sketch_b")]
    keep = []
    for size_a, size_b, a, b in zip(*columns, strict=True):
        overlap = -(-percent * (size_a + size_b) // (100 + percent))
        bits = 8 * min(len(a), len(b))
        differ = _folded(a, bits) ^ _folded(b, bits)
        keep.append(overlap <= min(size_a, size_b) and differ.bit_count() <= size_a + size_b - 2 * overlap)
    return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _folded(sketch: bytes, bits: int) -> int:
    value, width = int.from_bytes(sketch, "little"), 8 * len(sketch)
    while width > bits:
        width //= 2
        value = (value >> width) ^ (value & ((1 << width) - 1))
    return value


def _is_known(signatures: np.ndarray, known: np.ndarray) -> np.ndarray:
    keep = np.ones(len(signatures), dtype=bool)
    for shift in PROBES:
        slot = ((signatures >> _U(shift)) & _U((1 << BITMAP_BITS) - 1)).astype(np.int64)
        keep &= (known[slot >> 3] >> (slot & 7)) & 1 > 0
    return keep


def _signed(batch: pa.RecordBatch, plan: Plan, known: np.ndarray | None) -> pa.RecordBatch:
    """Per row its set's digest and size and its signatures, or with ``known`` only the
    repeated ones, of blocks only where they are as many as linked sets share, and then the
    sketch and the text where there are any."""
    nodes, counts, sizes_out, signatures, sketches, widths = [], [], [], [], [], []
    for chunk in chunks(batch.column("text"), SPACED, True):
        rows, values, sizes = _sets(chunk, plan.shingle)
        node = np.zeros(len(sizes), dtype=np.uint64)
        np.add.at(node, rows, mix(values + _U(0xD16)))
        nodes.append(mix(node + sizes.astype(np.uint64)))
        sizes_out.append(sizes)
        own_rows, own = _subset_signatures(plan, rows, values, sizes)
        if known is not None:
            kept = [_is_known(s, known) for s in own]
            own_rows, own = [r[k] for r, k in zip(own_rows, kept, strict=True)], [s[k] for s, k in zip(own, kept, strict=True)]
        for back in (0, 1):
            r, s, least = _block_signatures(plan, rows, values, sizes, back)
            if known is not None:
                keep = _is_known(s, known)
                r, s = r[keep], s[keep]
                keep = (np.bincount(r, minlength=len(sizes)) >= least)[r]
                r, s = r[keep], s[keep]
            own_rows.append(r)
            own.append(s)
        row, signature = np.concatenate(own_rows), np.concatenate(own)
        if known is not None:
            listed = np.bincount(row, minlength=len(sizes)) > 0
            own = listed[rows]
            sketch, width = _sketches(rows[own], values[own], np.where(listed, sizes, 0))
            sketches.append(sketch)
            widths.append(width)
        order = np.argsort(row, kind="stable")
        signatures.append(signature[order])
        counts.append(np.bincount(row, minlength=len(sizes)))
    node, size, value, count = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (nodes, sizes_out, signatures, counts))
    text = batch.column("text")
    if known is None:
        text, sketch = pa.nulls(len(text), pa.string()), pa.nulls(len(text), pa.binary())
    else:
        sketch = _binary_column(sketches, widths)
        text = pc.if_else(pa.array(count > 0), text, pa.scalar(None, text.type)).cast(pa.string())
    return pa.record_batch([batch.column("id"), pa.array(as_long(node)), pa.array(size, pa.int64()),
                            list_column(as_long(value), count, pa.int64()), sketch, text],
                           ["id", "node", "n_shingles", "signatures", "sketch", "text"])


def _binary_column(data: list[np.ndarray], widths: list[np.ndarray]) -> pa.Array:
    """A binary column whose row ``i`` takes the next ``widths[i]`` bytes."""
    width = np.concatenate(widths) if widths else np.zeros(0, np.int64)
    offsets = np.zeros(len(width) + 1, dtype=np.int32)
    np.cumsum(width, out=offsets[1:])
    joined = np.concatenate(data) if data else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(width), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])


def _verify(batch: pa.RecordBatch, shingle: int, percent: int) -> pa.RecordBatch:
    """Whether the sets of two texts link, for a few megabytes of text at a time."""
    size = sum(np.asarray(pc.binary_length(batch.column(c)), dtype=np.int64) for c in ("text_a", "text_b"))
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // VERIFY_BYTES)) + 1
    ends = [0, *cuts.tolist(), len(batch)]
    parts = [_linked(batch.slice(a, b - a), shingle, percent) for a, b in zip(ends[:-1], ends[1:], strict=True) if b > a]
    linked = np.concatenate(parts) if parts else np.zeros(0, dtype=bool)
    return pa.record_batch([batch.column("a"), batch.column("b"), pa.array(linked)], ["a", "b", "linked"])


def _linked(batch: pa.RecordBatch, shingle: int, percent: int) -> np.ndarray:
    found = []
    for side in ("text_a", "text_b"):
        parts = [(c.first, *_sets(c, shingle)) for c in chunks(batch.column(side), SPACED, True)]
        found.append((np.concatenate([first + rows for first, rows, _, _ in parts]),
                      np.concatenate([values for _, _, values, _ in parts]),
                      np.concatenate([sizes for _, _, _, sizes in parts])))
    (rows_a, values_a, sizes_a), (rows_b, values_b, sizes_b) = found
    rows, values = np.concatenate((rows_a, rows_b)), np.concatenate((values_a, values_b))
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    both = rows[1:][(rows[1:] == rows[:-1]) & (values[1:] == values[:-1])]
    shared = np.bincount(both, minlength=len(sizes_a))
    return (100 * shared >= percent * (sizes_a + sizes_b - shared)) & (shared > 0)


def _bitmap(signatures: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over the values of ``signature``: what it lets through
    by chance is dropped by the lists, so it decides only what they cost."""
    # Spark's bitmaps count from 1: bucket b holds the values (b - 1) * 32768 + 1 to b * 32768
    probes = [F.shiftrightunsigned("signature", s).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)) + 1 for s in PROBES]
    slots = signatures.select(F.explode(F.array(*probes)).alias("slot"))
    parts = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    bitmap = np.zeros((1 << BITMAP_BITS) // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():
        first = (row["bucket"] - 1) * 4096
        bitmap[first : first + 4096] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return bitmap


def _open(lists: DataFrame) -> DataFrame:
    """The lists (signature, node, label) that still hold nodes of different labels, with
    their size and the smallest node as head."""
    summed = lists.groupBy("signature").agg(
        F.min("node").alias("head"), F.min_by("label", "node").alias("head_label"), F.count(F.lit(1)).alias("n"),
        F.min("label").alias("low"), F.max("label").alias("high"),
    ).filter("low <> high").drop("low", "high")
    summed = stored(summed)
    found = stored(lists.join(summed, "signature"))
    done_with(summed)
    return found


def _star(lists: DataFrame) -> DataFrame:
    """Pairs of a list's head and its other nodes."""
    return lists.filter("label <> head_label").select(F.col("head").alias("a"), F.col("node").alias("b"))


def _shingled(batch: pa.RecordBatch, shingle: int) -> pa.RecordBatch:
    values, sizes = [], []
    for chunk in chunks(batch.column("text"), SPACED, True):
        _, value, size = _sets(chunk, shingle)
        values.append(as_long(value))
        sizes.append(size)
    value, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (values, sizes))
    return pa.record_batch([batch.column("node"), list_column(value, size, pa.int64())], ["node", "shingles"])


def _early(nodes: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """Inverted lists over ``nodes``: shingle, node, size, at. Shingles are taken from the
    rarest on, ``at`` is the place, and only places that a linked set could share are in."""
    sets = texts.join(nodes, "node").select("node", "text").mapInArrow(
        by_batch(partial(_shingled, shingle=plan.shingle)), "node bigint, shingles array<bigint>"
    )
    postings = stored(sets.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle")))
    rarity = stored(postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    # a shingle of one set only meets nothing; as the rarest ones they stand before all others
    ranked = postings.join(rarity, "shingle").groupBy("node").agg(
        F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("own")
    )
    alone = F.col("size") - F.size("own")
    least = F.ceil(F.col("size") * F.lit(plan.percent) / 100).cast("int")
    own = F.slice("own", F.lit(1), F.greatest(F.size("own") - least + 1, F.lit(0)))
    early = ranked.select("node", "size", alone.alias("alone"), F.posexplode(own).alias("at", "own"))
    found = stored(early.select("own.shingle", "node", "size", (F.col("alone") + F.col("at")).alias("at")))
    done_with(postings)
    done_with(rarity)
    return found


def _early_pairs(early: DataFrame, labels: DataFrame, plan: Plan, part: int) -> DataFrame:
    """Pairs with different labels that share a shingle early enough to link, or one in
    ``part`` of them."""
    named = early.join(labels, "node", "left").select(
        "shingle", "node", "size", "at", F.coalesce("component", "node").alias("label")
    )
    columns = ("node", "size", "at", "label")
    a, b = (named.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in columns]) for side in "ab")
    overlap = F.ceil(plan.percent * (F.col("size_a") + F.col("size_b")) / (100 + plan.percent))
    return (
        a.join(b, "shingle")
        .filter("node_a < node_b and label_a <> label_b")
        .filter((F.col("size_a") - F.col("at_a") >= overlap) & (F.col("size_b") - F.col("at_b") >= overlap))
        .filter(F.pmod(F.xxhash64("node_a", "node_b"), F.lit(part)) == 0)
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    )


def _components(nodes: DataFrame, plan: Plan) -> DataFrame:
    """``node, component`` of every node with a verified link; ``nodes`` is a stored table of
    node, n_shingles, signatures, sketch and text, which is deleted."""
    postings = nodes.select(F.explode("signatures").alias("signature"), "node").distinct()
    texts = nodes.select("node", "text")
    lists = _open(postings.withColumn("label", F.col("node")))
    possible = by_batch(partial(_possible, percent=plan.percent))
    verify = by_batch(partial(_verify, shingle=plan.shingle, percent=plan.percent))

    def side(of: DataFrame, name: str, **columns: str) -> DataFrame:
        return of.select(F.col("node").alias(name), *[F.col(c).alias(f"{new}_{name}") for new, c in columns.items()])

    def checked_with(pairs: DataFrame, before: DataFrame | None) -> DataFrame:
        pairs = pairs.distinct()
        if before is not None:
            pairs = pairs.join(before.select("a", "b"), ["a", "b"], "left_anti")
        marks = {"size": "n_shingles", "sketch": "sketch"}
        near = stored(
            pairs.join(side(nodes, "a", **marks), "a").join(side(nodes, "b", **marks), "b")
            .mapInArrow(possible, _PAIRS)
        )
        wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
        own = stored(texts.join(wanted, "node", "left_semi"))
        found = (
            near.join(side(own, "a", text="text"), "a").join(side(own, "b", text="text"), "b")
            .select("a", "b", "text_a", "text_b")
            .mapInArrow(verify, _VERIFIED)
        )
        checked = stored(found if before is None else before.unionByName(found))
        done_with(near)
        done_with(own)
        return checked

    checked = checked_with(_star(lists), None)
    labels = components(checked.filter("linked"))
    rest = lists.filter("node <> head").select("signature", "node").join(labels, "node", "left")
    still = _open(rest.select("signature", "node", F.coalesce("component", "node").alias("label")))
    done_with(lists)
    if not still.isEmpty():
        early = _early(still.select("node").distinct(), texts, plan)
        for part in PARTS:
            checked = checked_with(_early_pairs(early, labels, plan, part), checked)
            labels = components(checked.filter("linked"))
        done_with(early)
    done_with(still)
    done_with(nodes)
    return labels


def jaccard_components(docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id. ``docs``: doc_id, text."""
    plan = plan_for(shingle, percent)
    own = narrow(docs, id=F.coalesce(F.col("doc_id"), F.lit(_LAST)), text="text")
    signatures = own.mapInArrow(by_batch(partial(_signed, plan=plan, known=None)), _SIGNED).select(
        F.explode("signatures").alias("signature")
    )
    repeated = signatures.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    known = _bitmap(repeated)
    del signatures, repeated
    release(docs.sparkSession)
    signed = stored(own.mapInArrow(by_batch(partial(_signed, plan=plan, known=known)), _SIGNED))
    # one row of each set that shares a signature; repeated rows carry equal columns
    nodes = stored(signed.filter("text is not null").groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("n_shingles", "signatures", "sketch", "text")]
    ))
    full, signed = signed, stored(signed.select("id", "node", "n_shingles"))
    done_with(full)
    labels = _components(nodes, plan)
    sets = signed.filter("n_shingles > 0").groupBy("node").agg(F.min("id").alias("first_id"))
    joined = sets.join(labels, "node", "left").select(
        "node", "first_id", F.coalesce("component", "node").alias("component")
    )
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = joined.join(least, "component").select("node", "component_id")
    result = signed.filter("n_shingles > 0").join(classes, "node").select("id", "n_shingles", "component_id")
    alone = signed.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return result.unionByName(alone).select(
        F.when(F.col("id") != _LAST, F.col("id")).alias("doc_id"), "n_shingles",
        F.when(F.col("component_id") != _LAST, F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Of each component the row with the smallest doc_id (none: last; then by a hash of
    its text), repeated rows once; documents without shingles all stay.

    Rows are told apart by id and text: each row of an id that several texts share, or
    without one, is judged alone."""
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    found = jaccard_components(docs.select(key.alias("doc_id"), "text"), shingle, percent)
    ids = docs.select(key.alias("key"), F.coalesce("doc_id", F.lit(_LAST)).alias("id")).distinct()
    component = found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")).distinct()
    name = unused(docs, "_key")
    first = component.join(ids, "key").groupBy("component").agg(F.min(F.struct("id", "key")).alias("first")).select(
        F.col("first.key").alias(name)
    )
    return docs.withColumn(name, key).join(first, name, "left_semi").dropDuplicates([name, "text"]).drop(name)
