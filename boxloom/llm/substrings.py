"""Removal of repeated passages with minimizer anchors and window hashes.

This stands in for prefix-partitioned suffix trees: no tree is built and no group is
fitted to memory; "node" and "leaf" below say what rows would be in one.

A suffix is the text from one word on. Its tree node at depth ``WINDOW`` words is a
*window*; a node with several leaves is a repeat, and every leaf but the earliest is
covered words to remove. Two things keep the trees small:

* Only suffixes at *anchors* are split by prefix: of the 15 six-word prefixes that
  start inside a window, the one with the smallest hash. Equal windows have equal
  anchors, so no repeat is lost, and an eighth of the suffixes goes into the shuffle.
* Prefixes have two lengths. A six-word prefix that one text alone holds is a leaf and
  ends there; the others grow to the whole window. Those deep nodes are reduced to
  their earliest leaf by a partially combined minimum, so a passage that a third of
  all documents share never meets in one task.

Which words to remove is then a set difference per document: the windows below a grown
prefix, less those whose earliest leaf is the document itself. Texts equal to that of a
smaller doc_id are settled by a digest and enter no tree.

Nodes are told apart by 96 bits of hash.

Defined cases: null and empty texts have no words; texts of fewer words than a window
stay; a null doc_id comes last in the order; rows with one doc_id and different texts
count as equally early, so neither removes from the other; repeated rows get equal
results; no documents give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.tables import by_batch, done_with, narrow, stored, unused
from boxloom.llm.words import SPACED, Chunk, as_long, chunks, grams, list_column

#: Words of a window, and of a first prefix.
WINDOW = 20
PREFIX = 6

#: The place of a null doc_id in the order.
_LAST = (1 << 63) - 1
_CHECK_SEED = np.uint64(0x5851F42D4C957F2D)

_SCANNED = "id bigint, d1 bigint, d2 bigint, n_words bigint, sha string, prefixes array<bigint>, marks array<bigint>, places array<int>"
_WINDOWS = "id bigint, nodes array<bigint>, checks array<int>"
_CLEANED = "id bigint, d1 bigint, d2 bigint, n_removed bigint, sha string, kept string"


def _anchors(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the anchor of each, and the prefix hash of every word."""
    prefixes = grams(chunk.hashes, PREFIX)
    at = np.arange(len(prefixes))
    best, value = at, prefixes
    span = WINDOW - PREFIX + 1
    step = 1
    while step < span:
        # what has been covered so far is ``step`` long; the last shift overlaps
        shift = min(step, span - step)
        other_best, other = best[shift:], value[shift:]
        smaller = other < value[: len(other)]
        best = np.concatenate((np.where(smaller, other_best, best[: len(other)]), best[len(other) :]))
        value = np.concatenate((np.where(smaller, other, value[: len(other)]), value[len(other) :]))
        step += shift
    starts = np.flatnonzero(chunk.left() >= WINDOW)
    return starts, best[starts], prefixes


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Per row its word count, the digest of all its words and its anchors."""
    digest = np.asarray(batch.column("d1"))
    counts, shas, prefixes, marks, places, sizes = [], [], [], [], [], []
    for chunk in chunks(batch.column("text"), SPACED, False):
        starts, anchors, values = _anchors(chunk)
        anchors = np.unique(anchors)
        rows = chunk.row_of()[anchors] if len(anchors) else np.zeros(0, np.int64)
        found = as_long(values[anchors])
        # a prefix that stands twice in a row marks its second place with another value
        order = np.lexsort((anchors, found, rows))
        again = np.zeros(len(anchors), dtype=bool)
        same = (found[order][1:] == found[order][:-1]) & (rows[order][1:] == rows[order][:-1])
        again[order[1:][same]] = True
        own = digest[chunk.first + rows]
        counts.append(chunk.counts)
        prefixes.append(found)
        marks.append(np.where(again, ~own, own))
        places.append(anchors - chunk.bounds[rows])
        sizes.append(np.bincount(rows, minlength=len(chunk.counts)))
        for first, last in zip(chunk.rows[:-1].tolist(), chunk.rows[1:].tolist(), strict=True):
            words = chunk.data[first:last].tobytes().split()
            shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (counts, prefixes, marks, places, sizes)]
    return pa.record_batch(
        [batch.column("id"), batch.column("d1"), batch.column("d2"), pa.array(joined[0], pa.int64()),
         pa.array(shas, pa.string()), list_column(joined[1], joined[4], pa.int64()),
         list_column(joined[2], joined[4], pa.int64()), list_column(joined[3], joined[4], pa.int32())],
        ["id", "d1", "d2", "n_words", "sha", "prefixes", "marks", "places"],
    )


def _grown(chunk: Chunk, places: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, node hashes and check values of the windows whose anchor is at one of
    the row's ``places``."""
    starts, anchors, _ = _anchors(chunk)
    wanted = np.zeros(len(chunk.hashes) + 1, dtype=bool)
    for row, own in enumerate(places.slice(chunk.first, len(chunk.counts))):
        if own.is_valid and len(own):
            at = chunk.bounds[row] + np.asarray(own.values)
            wanted[at[at < chunk.bounds[row + 1]]] = True
    starts = starts[wanted[anchors]]
    nodes = as_long(grams(chunk.hashes, WINDOW)[starts])
    checks = as_long(grams(chunk.hashes ^ _CHECK_SEED, WINDOW)[starts]).astype(np.int32)
    return starts, nodes, checks


def _first_in_row(rows: np.ndarray, nodes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Whether no earlier window of the row has the same node."""
    order = np.lexsort((np.arange(len(rows)), checks, nodes, rows))
    r, n, c = rows[order], nodes[order], checks[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (n[1:] != n[:-1]) | (c[1:] != c[:-1])
    first = np.empty(len(rows), dtype=bool)
    first[order] = new
    return first


def _windows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The deep nodes of every row, each once."""
    nodes, checks, sizes = [], [], []
    for chunk in chunks(batch.column("text"), SPACED, False):
        starts, own, check = _grown(chunk, batch.column("places"))
        rows = chunk.row_of()[starts] if len(starts) else np.zeros(0, np.int64)
        first = _first_in_row(rows, own, check)
        nodes.append(own[first])
        checks.append(check[first])
        sizes.append(np.bincount(rows[first], minlength=len(chunk.counts)))
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (nodes, checks, sizes)]
    return pa.record_batch([batch.column("id"), list_column(joined[0], joined[2], pa.int64()),
                            list_column(joined[1], joined[2], pa.int32())], ["id", "nodes", "checks"])


def _clean(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Remove the windows that are not the earliest leaf of their node."""
    removed, shas, kept_texts = [], [], []
    earliest = batch.column("earliest")
    for chunk in chunks(batch.column("text"), SPACED, False):
        starts, nodes, checks = _grown(chunk, batch.column("places"))
        rows = chunk.row_of()[starts] if len(starts) else np.zeros(0, np.int64)
        stays = _first_in_row(rows, nodes, checks)
        bounds = np.searchsorted(rows, np.arange(len(chunk.counts) + 1))
        covered = np.zeros(len(chunk.hashes) + 1, dtype=np.int32)
        for row in range(len(chunk.counts)):
            part = slice(bounds[row], bounds[row + 1])
            own = earliest[chunk.first + row]
            if own.is_valid and len(own):
                known = own.values
                stays[part] &= np.isin(nodes[part], np.asarray(known))
            else:
                stays[part] = False
        gone = starts[~stays]
        np.add.at(covered, gone, 1)
        np.add.at(covered, np.minimum(gone + WINDOW, len(covered) - 1), -1)
        keep = np.cumsum(covered)[:-1] == 0
        for row in range(len(chunk.counts)):
            first, last = int(chunk.bounds[row]), int(chunk.bounds[row + 1])
            words = chunk.data[chunk.rows[row] : chunk.rows[row + 1]].tobytes().split()
            own = keep[first:last]
            rest = b" ".join([words[i] for i in np.flatnonzero(own)])
            removed.append(last - first - int(own.sum()))
            shas.append(hashlib.sha256(rest).hexdigest())
            kept_texts.append(rest.decode("utf-8", "replace"))
    return pa.record_batch([batch.column("id"), batch.column("d1"), batch.column("d2"), pa.array(removed, pa.int64()),
                            pa.array(shas, pa.string()), pa.array(kept_texts, pa.string())],
                           ["id", "d1", "d2", "n_removed", "sha", "kept"])


def removals(docs: DataFrame, texts: bool = True) -> tuple[DataFrame, DataFrame]:
    """What to remove from ``docs`` (doc_id, text).

    The first table has a row per document: doc_id, id, d1, d2, n_words, copy (its text
    is that of a smaller doc_id) and sha, the digest of all its words. The second has the
    documents that lose some but not all words by this: id, d1, d2, n_removed, sha and
    kept, the words that stay, unless ``texts`` are not wanted.
    """
    own = narrow(docs, doc_id="doc_id", text=F.coalesce(F.col("text"), F.lit("")))
    own = own.select(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("d1"),
                     F.xxhash64("text", F.lit(1)).alias("d2"), "text")
    scanned = stored(own.mapInArrow(by_batch(_scan), _SCANNED))
    earliest = scanned.groupBy("d1", "d2").agg(F.min("id").alias("first_id"))
    listed = stored(scanned.drop("prefixes", "marks", "places").join(earliest, ["d1", "d2"]))

    anchors = scanned.select("id", F.explode(F.arrays_zip("prefixes", "marks", "places")).alias("a")).select(
        "id", F.col("a.prefixes").alias("prefix"), F.col("a.marks").alias("mark"), F.col("a.places").alias("place")
    )
    # stored, so that both sides of the join are plain exchanges, whose large partitions Spark splits
    shared = stored(
        anchors.groupBy("prefix").agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
        .filter("low <> high").select("prefix")
    )
    places = stored(
        anchors.join(shared, "prefix", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("place")).alias("places"))
    )
    done_with(scanned)
    done_with(shared)
    singles = stored(listed.filter(F.col("id") == F.col("first_id")).select("id", "d1", "d2").distinct().join(places, "id"))
    done_with(places)
    grown = stored(own.join(singles, ["id", "d1", "d2"]).dropDuplicates(["id", "d1", "d2"]))
    done_with(singles)
    leaves = (
        grown.mapInArrow(by_batch(_windows), _WINDOWS)
        .select("id", F.explode(F.arrays_zip("nodes", "checks")).alias("w"))
        .groupBy(F.col("w.nodes").alias("node"), F.col("w.checks").alias("check"))
        .agg(F.min("id").alias("id"))
    )
    # stored, so that the leaves' shuffle is gone before the texts travel
    kept = stored(leaves.groupBy("id").agg(F.collect_list("node").alias("earliest")))
    cleaned = stored(
        grown.join(kept, "id", "left").select("id", "d1", "d2", "text", "places", "earliest")
        .mapInArrow(by_batch(_clean), _CLEANED).filter("n_removed > 0")
        .select("id", "d1", "d2", "n_removed", "sha", *["kept"] * texts)
    )
    done_with(grown)
    done_with(kept)
    return listed.withColumn("copy", F.col("id") > F.col("first_id")), cleaned


def report(docs: DataFrame) -> DataFrame:
    """Per document row: ``doc_id, n_words, n_removed, kept_sha256``."""
    listed, cleaned = removals(docs, texts=False)
    whole = F.col("copy") & (F.col("n_words") >= WINDOW)
    return listed.join(cleaned.select("id", "d1", "d2", "n_removed", F.col("sha").alias("kept_sha")), ["id", "d1", "d2"], "left").select(
        F.when(F.col("id") != _LAST, F.col("id")).alias("doc_id"),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text`` and ``n_chars`` set anew.

    A text that loses nothing stays as it is, white space included; a document that
    loses every word goes.
    """
    listed, cleaned = removals(docs)
    gone = listed.filter(F.col("copy") & (F.col("n_words") >= WINDOW)).select("id", "d1", "d2").distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    own = {name: unused(docs, f"_{name}") for name in ("id", "d1", "d2", "kept")}
    marked = docs.select(
        "*", F.coalesce("doc_id", F.lit(_LAST)).alias(own["id"]), F.xxhash64(text).alias(own["d1"]),
        F.xxhash64(text, F.lit(1)).alias(own["d2"]),
    )
    changes = cleaned.select("id", "d1", "d2", "kept").unionByName(gone.withColumn("kept", F.lit(""))).withColumnsRenamed(own)
    kept = F.col(own["kept"])
    joined = marked.join(changes, [own["id"], own["d1"], own["d2"]], "left").filter(kept.isNull() | (kept != ""))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.coalesce(kept, "text").alias(name))
        elif name == "n_chars":
            columns.append(F.when(kept.isNull(), F.col("n_chars")).otherwise(F.length(kept)).cast("bigint").alias(name))
        else:
            columns.append(F.col(f"`{name}`"))
    return joined.select(columns)
