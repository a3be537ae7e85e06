"""Quality classifier: ordinal cumulative-link regression on hashed text.

A document's score is the sum of the weights of its hashed features, shared by all
grades; ordered thresholds cut the score, ``P(grade <= j) = 1 / (1 + exp(score - cut_j))``.
Expected grade and the probability of reaching the selection grade follow from it.

Features are the distinct words, the beginnings of longer words and the bands of a few shares (symbols, capitals,
repeated and distinct words, length). Only features of at least ``LEAST_ROWS`` training
rows get a weight.

The model is fitted on at most ``FIT_ROWS`` labelled rows, those whose id hashes lowest;
their hashed features (at most 2**BUCKET_BITS a row) come to the driver. Every document
is scored.

Grades from the labels are ``quality + 1 - toxic``, 0 to 2; a document is kept if it
reaches grade 2 with probability ``LEAST_TAIL`` or more.

Defined cases: null and empty texts have only the bands of an empty text; labels with a
null are left out; repeated labels count as often as they stand; with fewer than two
grades among the labels nothing can be told apart: expected_grade is the one grade (or
null without labels), tail_probability 1 and every document is kept; repeated documents
are scored alike; no documents give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.tables import by_batch, narrow
from boxloom.llm.words import ALNUM, Chunk, chunks, list_column, mix

#: Labelled rows the model is fitted on, at most.
FIT_ROWS = 12_000
BUCKET_BITS = 18
#: Training rows a feature needs.
LEAST_ROWS = 12
#: Strength of the pull of weights to zero, steps of the fit, and their length.
PENALTY = 0.3
STEPS = 120
STEP = 0.1
LEAST_TAIL = 0.8
#: Bytes of the word beginnings that are features beside whole words.
STEMS = (4, 5)

#: Features walked at once while fitting.
BLOCK = 1 << 19

_U = np.uint64
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>!@^~{}[]=+\\", dtype=np.uint8))
_CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LOWER = np.where(_CAPITAL, np.arange(256) + 32, np.arange(256)).astype(np.uint64)
_BANDS = 12


def _features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(row, bucket)`` pairs, sorted."""
    n = len(chunk.counts)
    rows, words = chunk.row_of(), chunk.hashes
    size = np.maximum(np.diff(chunk.rows), 1)
    within = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags[chunk.data])))[chunk.rows])
    count = np.maximum(chunk.counts, 1)
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    mask = _U((1 << BUCKET_BITS) - 1)
    shift = _U(BUCKET_BITS)
    key = np.unique((rows.astype(np.uint64) << shift) | (words & mask))
    stems = []
    for length in STEMS:
        longer = np.flatnonzero(chunk.ends - chunk.starts > length)
        stem = np.full(len(longer), length, dtype=np.uint64)
        for k in range(length):
            stem = (stem << _U(8)) | _LOWER[chunk.data[chunk.starts[longer] + k]]
        stems.append((rows[longer].astype(np.uint64) << shift) | (mix(stem) & mask))
    distinct = np.bincount((key >> _U(BUCKET_BITS)).astype(np.int64), minlength=n)
    shares = (within(_SYMBOL) / size * 4, within(_CAPITAL) / size, np.bincount(rows[same], minlength=n) / count,
              distinct / count, np.log2(count) / 20)
    bands = []
    for number, share in enumerate(shares):
        band = np.minimum((share * _BANDS).astype(np.int64), _BANDS)
        # the band and all below it, so that weights add up along the share
        for least in range(_BANDS + 1):
            reached = np.flatnonzero(band >= least)
            bucket = mix(np.array([1000 * (number + 1) + least], dtype=np.uint64)) & mask
            bands.append((reached.astype(np.uint64) << _U(BUCKET_BITS)) | bucket)
    key = np.unique(np.concatenate([key, *stems, *bands]))
    return (key >> _U(BUCKET_BITS)).astype(np.int64), (key & mask).astype(np.int64)


def _featured(batch: pa.RecordBatch) -> pa.RecordBatch:
    buckets, sizes = [], []
    for chunk in chunks(batch.column("text"), ALNUM, True):
        row, bucket = _features(chunk)
        buckets.append(bucket)
        sizes.append(np.bincount(row, minlength=len(chunk.counts)))
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (buckets, sizes)]
    return pa.record_batch([batch.column("doc_id"), list_column(joined[0], joined[1], pa.int32())], ["doc_id", "buckets"])


@dataclass(frozen=True)
class Model:
    grades: tuple[int, ...]
    weights: np.ndarray
    cuts: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """Of every grade, a column each."""
        below = 1 / (1 + np.exp(np.clip(score[:, None] - self.cuts[None, :], -500, 500)))
        edges = np.concatenate((np.zeros((len(score), 1)), below, np.ones((len(score), 1))), axis=1)
        return np.diff(edges, axis=1)


def fit_rows(rows: np.ndarray, buckets: np.ndarray, grade: np.ndarray) -> Model:
    """Maximum penalised likelihood by Adam steps over all rows.

    ``rows`` and ``buckets`` are walked in blocks, so a step needs little memory beside them.
    """
    grades = tuple(int(g) for g in np.unique(grade))
    weights = np.zeros(1 << BUCKET_BITS)
    if len(grades) < 2:
        return Model(grades, weights, np.zeros(0))
    seen = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for a in range(0, len(buckets), BLOCK):
        seen += np.bincount(buckets[a : a + BLOCK], minlength=len(seen))
    used = np.flatnonzero(seen >= LEAST_ROWS)
    place = np.full(1 << BUCKET_BITS, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    blocks = []
    for a in range(0, len(buckets), BLOCK):
        column = place[buckets[a : a + BLOCK]]
        blocks.append((rows[a : a + BLOCK][column >= 0], column[column >= 0]))
    n, level = len(grade), np.searchsorted(grades, grade)
    shares = np.cumsum(np.bincount(level) / n)[:-1]
    cuts = np.log(shares / (1 - shares))
    w = np.zeros(len(used))
    state = [np.zeros(len(w) + len(cuts)) for _ in range(2)]
    for step in range(1, STEPS + 1):
        score = np.zeros(n)
        for row, column in blocks:
            score += np.bincount(row, weights=w[column], minlength=n)
        high = np.append(cuts, np.inf)[level]
        low = np.insert(cuts, 0, -np.inf)[level]
        up, down = 1 / (1 + np.exp(np.clip(score - high, -60, 60))), 1 / (1 + np.exp(np.clip(score - low, -60, 60)))
        mass = np.maximum(up - down, 1e-12)
        slope_up, slope_down = up * (1 - up) / mass, down * (1 - down) / mass
        by_score = slope_up - slope_down
        gradient_w = PENALTY * n / 1000 * w
        for row, column in blocks:
            gradient_w += np.bincount(column, weights=by_score[row], minlength=len(w))
        gradient_c = np.bincount(level, weights=-slope_up, minlength=len(grades))[:-1]
        gradient_c = gradient_c + np.bincount(level, weights=slope_down, minlength=len(grades))[1:]
        gradient = np.concatenate((gradient_w, gradient_c)) / n
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient**2
        move = STEP * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-7)
        w = w - move[: len(w)]
        cuts = np.maximum.accumulate(cuts - move[len(w) :])
    weights[used] = w
    return Model(grades, weights, cuts)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = FIT_ROWS) -> Model:
    """``docs``: doc_id, text. ``labels``: doc_id, quality, toxic."""
    taught = narrow(labels, doc_id="doc_id", grade=(F.col("quality") + 1 - F.col("toxic"))).filter(
        "doc_id is not null and grade is not null"
    )
    chosen = taught.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(most_rows)
    own = narrow(docs, doc_id="doc_id", text="text").join(
        F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi"  # at most ``most_rows`` ids
    )
    found = own.mapInArrow(by_batch(_featured), "doc_id bigint, buckets array<int>").join(chosen, "doc_id")
    # sorted here, as a sort in the query would take the features twice
    table = found.select("doc_id", "grade", "buckets").toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    grade = np.asarray(table.column("grade")).astype(np.int64)
    lists = table.column("buckets").combine_chunks()
    del table, found
    sizes = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)
    return fit_rows(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.asarray(lists.flatten()), grade)


_SCORED = "doc_id bigint, expected_grade double, tail_probability double"


def _scored(batch: pa.RecordBatch, model: Model, least: int) -> pa.RecordBatch:
    scores = []
    for chunk in chunks(batch.column("text"), ALNUM, True):
        row, bucket = _features(chunk)
        scores.append(np.bincount(row, weights=model.weights[bucket], minlength=len(chunk.counts)))
    score = np.concatenate(scores) if scores else np.zeros(0)
    if len(model.grades) < 2:
        expected = pa.array([float(model.grades[0]) if model.grades else None] * len(score), pa.float64())
        tail = pa.array(np.ones(len(score)))
    else:
        chance = model.probabilities(score)
        expected = pa.array(chance @ np.array(model.grades, dtype=np.float64))
        tail = pa.array(chance[:, np.array(model.grades) >= least].sum(axis=1))
    return pa.record_batch([batch.column("doc_id"), expected, tail], ["doc_id", "expected_grade", "tail_probability"])


def classify(docs: DataFrame, labels: DataFrame, least_grade: int = 2) -> DataFrame:
    """Per document row: doc_id, expected_grade, tail_probability, kept."""
    model = fit(docs, labels)
    own = narrow(docs, doc_id="doc_id", text="text")
    scored = own.mapInArrow(by_batch(partial(_scored, model=model, least=least_grade)), _SCORED)
    return scored.withColumn("kept", F.col("tail_probability") >= LEAST_TAIL)


def _filtered(batch: pa.RecordBatch, model: Model, least: int) -> pa.RecordBatch:
    scored = _scored(pa.record_batch([batch.column("doc_id"), batch.column("text")], ["doc_id", "text"]), model, least)
    return batch.filter(pc.greater_equal(scored.column("tail_probability"), LEAST_TAIL))


def accepted(docs: DataFrame, labels: DataFrame, least_grade: int = 2) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, as they are."""
    model = fit(docs, labels)
    return docs.mapInArrow(by_batch(partial(_filtered, model=model, least=least_grade)), docs.schema)
