"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight bytes at eight positions. Fingerprints that differ in at most
``distance`` bits differ in at most as many bytes, so they share at least
``8 - distance`` positional bytes: the guaranteed minimum of matches.

* The index lists distinct fingerprints, so copies are one entry. A list keyed by one byte
  would hold a 256th of all fingerprints and its pairs would grow with their square, so a
  list is keyed by ``width`` positional bytes out of the first ``distance + width``
  positions: of these at most ``distance`` differ, so every linkable pair meets in a list.
  ``width`` grows with the number of fingerprints, and with it lists stay short.
* In a list, the shared positional bytes of a pair are tallied over all eight positions;
  pairs that reach the minimum are retained and verified bit by bit.
* Fingerprints that are close to each other crowd the same lists. Lists of up to
  ``SMALL`` entries give each pair once, in the first list where it meets; longer ones give
  the links of a search over the list, fewer than it has entries. A list of more than
  ``LARGE`` entries is never read as a whole: each of its fingerprints names the points within
  half the distance of itself that share the list's bytes. Two of them link exactly if
  they name one point, and each point links what named it to the smallest. That is
  as long as the list times a constant.

Links, not pairs, then give components; every link is between fingerprints that were
compared, and no list is cut.

Defined cases: null and empty texts have fingerprint zero, and link like any other; a text
of fewer words than a shingle is one shingle; a null doc_id comes last among ids; rows with
one doc_id are separate rows; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.graph import components
from boxloom.llm.tables import Batches, by_batch, narrow, stored
from boxloom.llm.words import text_column

#: Words of a shingle, seed of its hash, bits in which linked fingerprints may differ.
SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Entries of a list that gives each of its pairs, and of one that is read as a whole.
SMALL = 64
LARGE = 8192
#: Fingerprints that a list should hold on average, at most, if their bytes were random.
LIST_ENTRIES = 16
#: Pairs compared at once.
PAIRS = 1 << 20
#: Hashes whose bits are counted at once.
HASHES = 1 << 15

_LAST = (1 << 63) - 1
_U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LINKS = "a bigint, b bigint"


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The bits set in over half the hashes of a text's shingles, repeats included."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), HASHES):
        part = [hashed(joined[a:b], seed) for a, b in zip(starts[k : k + HASHES].tolist(), ends[k : k + HASHES].tolist(), strict=True)]
        values = np.array(part, dtype="<u8")
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * counts > len(starts))
    return sum(1 << int(b) for b in set_bits)


def _marked(batch: pa.RecordBatch, shingle: int, seed: int) -> pa.RecordBatch:
    marks = [fingerprint(t.as_buffer().to_pybytes(), shingle, seed) for t in text_column(batch.column("text"))]
    return pa.record_batch([batch.column("id"), pa.array(np.array(marks, dtype=np.uint64).view(np.int64))], ["id", "mark"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``id, mark`` per row of ``docs`` (doc_id, text); mark is the fingerprint's 64 bits."""
    own = narrow(docs, id=F.coalesce(F.col("doc_id"), F.lit(_LAST)), text="text")
    return own.mapInArrow(by_batch(partial(_marked, shingle=shingle, seed=seed)), "id bigint, mark bigint")


def _masks(width: int, distance: int) -> list[int]:
    """One mask for each choice of positions a list is keyed by, as signed 64-bit values."""
    found = [sum(0xFF << (8 * p) for p in c) for c in combinations(range(distance + width), width)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def width_for(count: int, distance: int) -> int:
    """Bytes of a list's key: as few as keep lists of random fingerprints short."""
    width = 1
    while width < 8 - distance and count > LIST_ENTRIES << (8 * width):
        width += 1
    return width


def tally(differences: np.ndarray) -> np.ndarray:
    """Shared positional bytes of pairs, from the exclusive or of their fingerprints."""
    return (np.ascontiguousarray(differences).view(np.uint8).reshape(*differences.shape, 8) == 0).sum(axis=-1)


def _linked(differences: np.ndarray, distance: int) -> np.ndarray:
    """Count filter, then verification."""
    out = tally(differences) >= 8 - distance
    out[out] = np.bitwise_count(differences[out]) <= distance
    return out


def _small(nos: np.ndarray, lists: np.ndarray, masks: np.ndarray, distance: int) -> np.ndarray:
    """Linked pairs of lists of one length (a row each) that meet in no earlier list."""
    first, second = np.triu_indices(lists.shape[1], 1)
    which, pair = np.nonzero(_linked(lists[:, first] ^ lists[:, second], distance))
    a, b = lists[which, first[pair]], lists[which, second[pair]]
    meets = ((a ^ b)[:, None] & masks) == 0
    new = meets.argmax(axis=1) == nos[which]
    return np.stack((a[new], b[new]), axis=1)


def _search(entries: np.ndarray, distance: int) -> np.ndarray:
    """Links that join whatever the pairs of a list join: a search from entry to entry."""
    rest, found = entries, []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = _linked(rest ^ at, distance)
            found.append(np.stack((np.full(int(near.sum()), at), rest[near]), axis=1))
            front.extend(rest[near])
            rest = rest[~near]
    return np.concatenate(found) if found else np.zeros((0, 2), np.uint64)


def _links(batch: pa.RecordBatch, masks: np.ndarray, distance: int) -> pa.RecordBatch:
    """Links of the lists of a batch."""
    entries = batch.column("entries")
    lengths = np.asarray(entries.value_lengths(), dtype=np.int64)
    values = np.asarray(entries.flatten(), dtype=np.int64).view(np.uint64)
    starts, nos = np.cumsum(lengths) - lengths, np.asarray(batch.column("no"))
    found = [np.zeros((0, 2), np.uint64)]
    for length in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == length)
        if length > SMALL:
            found.extend(_search(values[s : s + length], distance) for s in starts[own].tolist())
            continue
        step = max(1, PAIRS // (length * length))
        for k in range(0, len(own), step):
            part = own[k : k + step]
            found.append(_small(nos[part], values[starts[part][:, None] + np.arange(length)], masks, distance))
    links = np.concatenate(found).view(np.int64)
    return pa.record_batch([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])


def _named(batches: Batches, masks: list[int], distance: int) -> Iterator[pa.RecordBatch]:
    """The points within half the distance that share an entry's list bytes, a list's key
    and an entry at a time: ``no, point, mark``."""
    masked = np.array(masks, dtype=np.int64).view(np.uint64)
    for batch in batches:
        nos, marks = np.asarray(batch.column("no")), np.asarray(batch.column("mark")).view(np.uint64)
        for no in np.unique(nos).tolist():
            free = [_U(1 << b) for b in range(64) if not int(masked[no]) >> b & 1]
            flips = np.array([sum(c, _U(0)) for k in range(distance // 2 + 1) for c in combinations(free, k)], dtype=np.uint64)
            own = marks[nos == no]
            for k in range(0, len(own), 512):
                part = own[k : k + 512]
                points = (part[:, None] ^ flips).reshape(-1)
                yield pa.record_batch(
                    [pa.array(np.full(len(points), no, np.int32)), pa.array(points.view(np.int64)),
                     pa.array(np.repeat(part, len(flips)).view(np.int64))], ["no", "point", "mark"],
                )


def _crowded(postings: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """Links of lists too long to read as a whole: two of their entries link exactly if
    they name one point, as half of their differing bits lead from either to it."""
    if distance % 2:
        raise ValueError("the distance has to be even")
    points = postings.mapInArrow(partial(_named, masks=masks, distance=distance), "no int, point bigint, mark bigint")
    # a point of one entry links nothing; the others link to the smallest that named it
    least = points.groupBy("no", "point").agg(F.min("mark").alias("a"), F.max("mark").alias("high")).filter("a < high")
    return points.join(least, ["no", "point"]).filter("mark <> a").select("a", F.col("mark").alias("b")).distinct()


def links(marks: DataFrame, count: int, distance: int = DISTANCE) -> DataFrame:
    """Links ``a, b`` that join all of the ``count`` distinct ``mark`` that lie within the distance."""
    width = width_for(count, distance)
    masks = _masks(width, distance)
    keys = F.array(*[F.struct(F.lit(no).alias("no"), F.col("mark").bitwiseAND(F.lit(m)).alias("key")) for no, m in enumerate(masks)])
    postings = marks.select(F.explode(keys).alias("list"), "mark").select("list.no", "list.key", "mark")
    sizes = stored(postings.groupBy("no", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    long = sizes.filter(F.col("n") > LARGE)
    whole = (
        postings.join(sizes.filter(F.col("n") <= LARGE), ["no", "key"], "left_semi")
        .groupBy("no", "key").agg(F.collect_list("mark").alias("entries")).select("no", "entries")
    )
    mask_values = np.array(masks, dtype=np.int64).view(np.uint64)
    found = whole.mapInArrow(by_batch(partial(_links, masks=mask_values, distance=distance)), _LINKS)
    if not long.isEmpty():
        found = found.unionByName(_crowded(stored(postings.join(long, ["no", "key"], "left_semi")), masks, distance))
    return stored(found)


def _hex(mark: str) -> Column:
    return F.lower(F.lpad(F.hex(mark), 16, "0"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, fingerprint, component_id``."""
    marked = stored(fingerprints(docs))
    classes = stored(marked.groupBy("mark").agg(F.min("id").alias("first_id")))
    labels = components(links(classes.select("mark"), classes.count(), distance))
    joined = classes.join(labels, classes["mark"] == labels["node"], "left").select(
        "mark", "first_id", F.coalesce("component", "mark").alias("component")
    )
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = joined.join(least, "component").select("mark", "component_id")
    result = marked.join(found, "mark")
    real = lambda c: F.when(F.col(c) != _LAST, F.col(c)).alias(c)
    return result.select(real("id").alias("doc_id"), _hex("mark").alias("fingerprint"), real("component_id"))
