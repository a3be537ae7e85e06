"""Benchmark decontamination as a prefix-filtered set join.

A *window* is ``window`` consecutive words of a benchmark item (an item with fewer
words is one window). Its tokens are its shingles of up to three words. A document
holds the window exactly where all of the window's shingles stand in a row, so the
join needs only one of them (containment 1 makes the prefix one token long): the one
that is rarest over all documents. What the join proposes is then bounded by position
and length and verified word by word.

Documents enter the shuffle as *segments*, their stretches of known shingles. Whether
a shingle is known is read from a bitmap of fixed size; what it lets through by chance
is settled by the join, so its size decides only the cost.

Defined cases: a null or empty text has no words; items without words have no window;
a null item id counts as the id ``''``; items that share an id count once; repeated
document rows are each reported; no items or no documents give unhit or no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.tables import by_batch, narrow, stored, unused
from boxloom.llm.words import ALNUM, as_long, chunks, grams, list_column

#: Words in a window.
WINDOW = 10
#: Words in a shingle; windows of fewer words are one shingle.
SHINGLE = 3
#: Bits of the shingle bitmap as a power of two: 2 MiB, held by every task.
BITMAP_BITS = 24

_SPACE = bytes(b + 32 if 65 <= b <= 90 else b if ALNUM[b] else 32 for b in range(256))
_BUCKET = 1 << 15

_WINDOWS = "item string, window string, size int, tokens array<bigint>"
_SEGMENT = pa.struct([("start", pa.int32()), ("words", pa.string()), ("tokens", pa.list_(pa.int64())),
                      ("places", pa.list_(pa.int32()))])
_SCANNED = ("doc_id bigint, n_words bigint, "
            "segments array<struct<start:int,words:string,tokens:array<bigint>,places:array<int>>>")


def _item_windows(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    items, texts, sizes, tokens = [], [], [], []
    names = batch.column("item").to_pylist()
    for chunk in chunks(batch.column("text"), ALNUM, True):
        for row in range(len(chunk.counts)):
            first, last = int(chunk.bounds[row]), int(chunk.bounds[row + 1])
            size = min(window, last - first)
            if not size:
                continue
            words = chunk.data[chunk.rows[row] : chunk.rows[row + 1]].tobytes().translate(_SPACE).split()
            shingle = min(SHINGLE, size)
            hashes = as_long(grams(chunk.hashes[first:last], shingle))
            for at in range(last - first - size + 1):
                items.append(names[chunk.first + row])
                texts.append(b" ".join(words[at : at + size]).decode("utf-8", "replace"))
                sizes.append(size)
                tokens.append(hashes[at : at + size - shingle + 1].tolist())
    return pa.record_batch([pa.array(items, pa.string()), pa.array(texts, pa.string()),
                            pa.array(sizes, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))],
                           ["item", "window", "size", "tokens"])


def _segments(batch: pa.RecordBatch, known: np.ndarray, shingles: list[int], shortest: int, window: int) -> pa.RecordBatch:
    """Word counts, and the stretches of at least ``shortest`` words made of known shingles.

    A stretch is given in parts of 2 * window tokens, each with the words that a window
    around one of its tokens can reach, so no row is longer than that.
    """
    counts, found = [], []
    slots = (1 << BITMAP_BITS) - 1
    for chunk in chunks(batch.column("text"), ALNUM, True):
        n = len(chunk.hashes)
        left = chunk.left()
        covered = np.zeros(n + 1, dtype=np.int32)
        hits = []
        for shingle in shingles:
            tokens = grams(chunk.hashes, shingle)
            slot = (tokens & np.uint64(slots)).astype(np.int64)
            at = np.flatnonzero((known[slot >> 3] >> (slot & 7)) & 1 & (left >= shingle))
            np.add.at(covered, at, 1)
            np.add.at(covered, at + shingle, -1)
            hits.append((at, as_long(tokens[at])))
        inside = np.cumsum(covered)[:n] > 0
        begins = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1] | (np.diff(chunk.row_of()) > 0)))[:n])
        closes = np.flatnonzero(inside & np.concatenate((~inside[1:] | (np.diff(chunk.row_of()) > 0), [True]))[:n]) + 1
        keep = closes - begins >= shortest
        own: list[list[dict]] = [[] for _ in chunk.counts]
        rows = chunk.row_of()
        for first, last in zip(begins[keep].tolist(), closes[keep].tolist(), strict=True):
            base = int(chunk.bounds[rows[first]])
            for part in range(first, last, 2 * window):
                begin, end = max(first, part - window + 1), min(last, part + 3 * window)
                tokens, places = [], []
                for at, values in hits:
                    a, b = np.searchsorted(at, (part, min(last, part + 2 * window)))
                    tokens += values[a:b].tolist()
                    places += (at[a:b] - base).tolist()
                raw = chunk.data[chunk.starts[begin] : chunk.ends[end - 1]].tobytes().translate(_SPACE)
                own[rows[first]].append({"start": begin - base, "words": b" ".join(raw.split()).decode("utf-8", "replace"),
                                         "tokens": tokens, "places": places})
        counts.append(chunk.counts)
        found += own
    n_words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return pa.record_batch([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(found, pa.list_(_SEGMENT))],
                           ["doc_id", "n_words", "segments"])


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every window of every item: item, window, size, tokens. ``items``: item_id, text."""
    own = narrow(items, item=F.coalesce(F.col("item_id").cast("string"), F.lit("")), text="text")
    return own.mapInArrow(by_batch(partial(_item_windows, window=window)), _WINDOWS)


def known_bitmap(windows: DataFrame) -> np.ndarray:
    """The bitmap of all shingles; at most 2**BITMAP_BITS bits reach the driver."""
    tokens = windows.select(F.explode("tokens").alias("token"))
    # Spark's bitmaps count from 1: bucket b holds the values (b - 1) * 32768 + 1 to b * 32768
    slots = tokens.select((F.col("token").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)) + 1).alias("slot"))
    parts = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    bitmap = np.zeros((1 << BITMAP_BITS) // 8, dtype=np.uint8)
    for row in parts.collect():
        first = (row["bucket"] - 1) * (_BUCKET // 8)
        bitmap[first : first + _BUCKET // 8] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return bitmap


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document row: ``doc_id, n_words, n_hit, items`` (sorted ids) and ``row``.

    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    windows = stored(item_windows(items, window))
    sizes = windows.groupBy("size").count().collect()  # a row per window length: at most ``window``
    shingles = sorted({min(SHINGLE, r["size"]) for r in sizes})
    shortest = min((r["size"] for r in sizes), default=1)
    known = known_bitmap(windows)
    own = narrow(docs, doc_id="doc_id", text="text")
    scan = by_batch(partial(_segments, known=known, shingles=shingles, shortest=shortest, window=window))
    scanned = stored(own.mapInArrow(scan, _SCANNED).withColumn("row", F.monotonically_increasing_id()))

    places = scanned.select("row", F.explode("segments").alias("s")).select(
        "row", F.col("s.start").alias("first"), F.split("s.words", " ").alias("words"),
        F.explode(F.arrays_zip("s.tokens", "s.places")).alias("t"),
    ).select("row", "first", "words", F.col("t.tokens").alias("token"), F.col("t.places").alias("place"))
    rarity = places.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    distinct = windows.groupBy("window").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"))
    prefix = (
        distinct.select("window", "size", F.posexplode("tokens").alias("offset", "token"))
        .join(rarity, "token", "left")
        .groupBy("window", "size")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("rarest"))
        .filter("rarest.n > 0")
        .select("window", "size", "rarest.token", "rarest.offset")
    )
    start = F.col("place") - F.col("offset")
    hits = (
        places.join(prefix, "token")
        .filter((start >= F.col("first")) & (start + F.col("size") <= F.col("first") + F.size("words")))
        .filter(F.array_join(F.slice("words", start - F.col("first") + 1, F.col("size")), " ") == F.col("window"))
        .select("row", start.alias("start"), "size", "window")
    )
    hits = stored(hits)
    covered = F.aggregate(
        F.sort_array("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("total")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["size"]).alias("end"),
            (a["total"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(a["end"], s["start"]))).alias("total"),
        ),
    )["total"]
    spans = hits.groupBy("row").agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    owners = windows.select("window", "item").distinct()
    named = (
        hits.select("row", "window").distinct().join(owners, "window").select("row", "item").distinct()
        .groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    return (
        scanned.drop("segments")
        .join(spans.select("row", covered.alias("n_hit")), "row", "left")
        .join(named, "row", "left")
        .select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no window of any item, with their columns.

    Rows are told apart by id and text, so documents that share an id are judged alone.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    name = unused(docs, "_key")
    marked = docs.withColumn(name, key)
    found = contamination(docs.select(key.alias("doc_id"), "text"), items, window)
    bad = found.filter("n_hit > 0").select(F.col("doc_id").alias(name)).distinct()
    return marked.join(bad, name, "left_anti").drop(name)


def report(found: DataFrame) -> DataFrame:
    """The digest of :func:`contamination`."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
