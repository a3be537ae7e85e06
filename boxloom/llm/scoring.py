"""Language-model scores from a subword lattice.

A word's pieces come from an existing vocabulary, and every way to cut the word into
pieces counts: the forward recursion adds the probabilities of all paths in log space.
Piece probabilities start from the vocabulary's own scores and are re-estimated once from
the expected piece counts (forward and backward) over all distinct training words.

A document's tokens are its words and one end. A training word keeps its count less a
discount; what the discounts free is shared among all words by their lattice probability,
so unseen words have a probability as well::

    P(word) = max(c - d, 0) / N + d * V / N * P_lattice(word)

Counting combines in the tasks before the shuffle. For scoring, the commonest words (at
most ``COMMON``) go to the tasks; all others meet the vocabulary table in a join, in which
no word is common enough to make a hot key.

Defined cases: a null or empty text has the end alone; a null doc_id counts as the text
``''`` in the split; without training documents a word's probability is its lattice
probability and an end's is 1; repeated rows are scored alike and each counts in
training; no documents give no rows. Words are told apart by 64 bits of hash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from math import exp, inf, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.tables import by_batch, narrow, stored
from boxloom.llm.words import SPACED, as_long, chunks, list_column

#: A vocabulary of pieces with scores, as a sentencepiece model file.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words that tasks hold, at most.
COMMON = 1 << 17
#: Weight of the vocabulary's own scores against the counted pieces, in pieces.
PRIOR = 2000.0

_MARK = "▁"
_LN10 = log(10)


@dataclass(frozen=True)
class Pieces:
    """Natural log probabilities of the pieces; ``fallback`` has those of single bytes."""

    logs: dict[str, float]
    fallback: tuple[float, ...]
    longest: int


def load_pieces(path: str = VOCABULARY) -> Pieces:
    """Probabilities from a vocabulary's scores. Scores that are log probabilities are
    taken as they are; merge ranks, which have no such meaning, by Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual, unbyted = {}, [0.0] * 256
    for i in range(model.get_piece_size()):
        piece, score = model.id_to_piece(i), model.get_score(i)
        if model.is_byte(i):
            unbyted[int(piece[3:5], 16)] = score
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and score > -1e8:
            usual[piece] = score
    ranked = min(usual.values()) < -200
    weights = {p: log(1 / (3 - s)) if ranked else s for p, s in usual.items()}
    rare = min(weights.values())
    total = log(sum(map(exp, weights.values())) + 256 * exp(rare))
    return Pieces({p: w - total for p, w in weights.items()}, tuple(rare - total for _ in unbyted), max(map(len, usual)))


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -inf else a + log1p(exp(b - a))


def arcs(word: str, pieces: Pieces) -> list[tuple[int, int, float, str]]:
    """The lattice of a word: ``(start, end, log probability, piece)``; a character that is
    no piece is spelled by its bytes."""
    s = _MARK + word
    out = []
    logs, longest, n = pieces.logs, pieces.longest, len(s)
    for i in range(n):
        for j in range(i + 1, min(i + longest, n) + 1):
            found = logs.get(s[i:j])
            if found is not None:
                out.append((i, j, found, s[i:j]))
        if s[i] not in logs:
            out.append((i, i + 1, sum(pieces.fallback[b] for b in s[i].encode("utf-8", "replace")), ""))
    return out


def forward(lattice: list[tuple[int, int, float, str]], n: int) -> list[float]:
    alpha = [0.0] + [-inf] * n
    for i, j, value, _ in lattice:
        alpha[j] = _add(alpha[j], alpha[i] + value)
    return alpha


def lattice_log(word: str, pieces: Pieces) -> float:
    """Natural log of the summed probability of all segmentations."""
    return forward(arcs(word, pieces), len(word) + 1)[-1]


def expected(word: str, pieces: Pieces, into: dict[str, float]) -> None:
    """Add the expected piece counts of one word."""
    lattice, n = arcs(word, pieces), len(word) + 1
    alpha = forward(lattice, n)
    beta = [-inf] * n + [0.0]
    for i, j, value, _ in reversed(lattice):
        beta[i] = _add(beta[i], beta[j] + value)
    for i, j, value, piece in lattice:
        if piece:
            into[piece] = into.get(piece, 0.0) + exp(alpha[i] + value + beta[j] - alpha[-1])


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Every distinct word of the batch once, with its count in training rows."""
    training = ~np.asarray(batch.column("held_out").cast(pa.int8())).astype(bool)
    hashes, counts, words = [], [], []
    for chunk in chunks(batch.column("text"), SPACED, True):
        value, first, where = np.unique(chunk.hashes, return_index=True, return_inverse=True)
        taught = training[chunk.first + chunk.row_of()]
        hashes.append(value)
        counts.append(np.bincount(where, weights=taught, minlength=len(value)).astype(np.int64))
        words += [chunk.data[chunk.starts[i] : chunk.ends[i]].tobytes().lower() for i in first]
    value = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    value, first, where = np.unique(value, return_index=True, return_inverse=True)
    count = np.bincount(where, weights=count, minlength=len(value)).astype(np.int64)
    texts = [words[i].decode("utf-8", "replace") for i in first]
    return pa.record_batch([pa.array(as_long(value)), pa.array(texts, pa.string()), pa.array(count)], ["h", "word", "c"])


def _pieces_of(batch: pa.RecordBatch, pieces: Pieces) -> pa.RecordBatch:
    into: dict[str, float] = {}
    for word in batch.column("word").to_pylist():
        expected(word, pieces, into)
    return pa.record_batch([pa.array(list(into), pa.string()), pa.array(list(into.values()), pa.float64())], ["piece", "n"])


def _lattices(batch: pa.RecordBatch, pieces: Pieces) -> pa.RecordBatch:
    values = [lattice_log(word, pieces) / _LN10 for word in batch.column("word").to_pylist()]
    return pa.record_batch([batch.column("h"), batch.column("c"), pa.array(values, pa.float64())], ["h", "c", "lattice"])


@dataclass(frozen=True)
class Totals:
    n: int
    v: int
    ends: int
    discount: float

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def model(self, c: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """log10 of the probability, from counts and log10 lattice probabilities."""
        if not self.n:
            return lattice
        shared = np.log10(self.discount * self.v / self.n) + lattice
        own = np.maximum(c - self.discount, 0) / self.n
        return np.where(c > 0, np.log10(np.maximum(own + 10 ** np.maximum(shared, -300), 1e-300)), shared)

    def end(self) -> tuple[float, float]:
        c = np.array([float(self.ends)])
        return float(self.base(c)[0]), float(np.log10((self.ends - self.discount) / self.n)) if self.n else 0.0


_SCORED = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, model double, "
           "rare array<bigint>, times array<int>")


def _score(batch: pa.RecordBatch, totals: Totals, common: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """Sums over the common words of every row, and its other words with their counts."""
    keys, c, lattice = common
    base_of, model_of = totals.base(c), totals.model(c, lattice)
    sums, rare, times, sizes = [], [], [], []
    for chunk in chunks(batch.column("text"), SPACED, True):
        n = len(chunk.counts)
        rows = chunk.row_of()
        place = np.minimum(np.searchsorted(keys, chunk.hashes), max(len(keys) - 1, 0))
        held = keys[place] == chunk.hashes if len(keys) else np.zeros(len(rows), dtype=bool)
        row, at = rows[held], place[held]
        sums.append(np.stack([
            chunk.counts + 1, np.bincount(row, weights=c[at] > 0, minlength=n),
            np.bincount(row, weights=base_of[at], minlength=n), np.bincount(row, weights=model_of[at], minlength=n),
        ]))
        row, value = rows[~held], chunk.hashes[~held]
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        first = np.flatnonzero(new)
        rare.append(value[first])
        times.append(np.diff(np.append(first, len(row))))
        sizes.append(np.bincount(row[first], minlength=n))
    total = np.concatenate(sums, axis=1).astype(np.float64) if sums else np.zeros((4, 0))
    value, count, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rare, times, sizes))
    return pa.record_batch(
        [batch.column("doc_id"), batch.column("held_out"), pa.array(total[0].astype(np.int64)), pa.array(total[1].astype(np.int64)),
         pa.array(total[2]), pa.array(total[3]), list_column(as_long(value), size, pa.int64()), list_column(count, size, pa.int32())],
        ["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rare", "times"],
    )


def vocabulary(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """Every word of ``docs`` (text, held_out): hash, training count and log10 lattice
    probability, with piece probabilities learned from the training words."""
    counted = docs.mapInArrow(by_batch(_count), "h bigint, word string, c bigint")
    words = stored(counted.groupBy("h", "word").agg(F.sum("c").alias("c")))
    # at most a row per piece of the vocabulary reaches the driver
    found = words.filter("c > 0").select("word").mapInArrow(by_batch(partial(_pieces_of, pieces=pieces)), "piece string, n double")
    counts = {r["piece"]: r["n"] for r in found.groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    whole = sum(counts[p] for p in sorted(counts)) + PRIOR
    learned = {p: log((counts.get(p, 0.0) + PRIOR * exp(v)) / whole) for p, v in pieces.logs.items()}
    fallback = tuple(v + log(PRIOR / whole) for v in pieces.fallback)
    tuned = Pieces(learned, fallback, pieces.longest)
    return stored(words.mapInArrow(by_batch(partial(_lattices, pieces=tuned)), "h bigint, c bigint, lattice double"))


def _common(words: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words from the count on from which they are at most ``COMMON``, sorted by hash."""
    band = F.floor(F.log2("c") * 4).alias("band")
    sizes = sorted(((r["band"], r["n"]) for r in words.filter("c > 0").groupBy(band).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, total = None, 0
    for b, n in sizes:
        total += n
        if total > COMMON:
            break
        least = b
    chosen = words.filter(F.lit(False)) if least is None else words.filter((F.col("c") > 0) & (F.floor(F.log2("c") * 4) >= least))
    table = chosen.toArrow()
    keys = np.asarray(table.column("h")).view(np.uint64) if len(table) else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    return keys[order], np.asarray(table.column("c")).astype(np.float64)[order], np.asarray(table.column("lattice")).astype(np.float64)[order]


def score(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    own = narrow(docs, doc_id="doc_id", text="text", held_out=held_out)
    words = vocabulary(own.select("text", "held_out"), load_pieces(vocabulary_path))
    known = words.agg(
        F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"),
        F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice"),
    ).first()
    # the usual estimate from the words seen once and twice
    discount = min(0.9, max(0.1, known["once"] / max(1, known["once"] + 2 * known["twice"])))
    ends = own.filter("not held_out").count()
    totals = Totals((known["n"] or 0) + ends, known["v"] + (ends > 0), ends, discount)
    # written before the sums meet: the join below reads it twice
    scored = stored(
        own.mapInArrow(by_batch(partial(_score, totals=totals, common=_common(words))), _SCORED)
        .withColumn("row", F.monotonically_increasing_id())
    )
    rest = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select(
        "row", F.col("w.rare").alias("h"), F.col("w.times").alias("n")
    )
    c, lattice = F.col("c"), F.col("lattice")
    base = F.log10((c + 0.1) / (totals.n + 0.1 * (totals.v + 1)))
    if totals.n:
        shared = F.log10(F.lit(totals.discount * totals.v / totals.n)) + lattice
        model = F.when(
            c > 0, F.log10((c - totals.discount) / totals.n + F.pow(F.lit(10.0), F.greatest(shared, F.lit(-300.0))))
        ).otherwise(shared)
    else:
        model = lattice
    sums = rest.join(words, "h").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * base).alias("more_base"), F.sum(F.col("n") * model).alias("more_model"),
    )
    end_base, end_model = totals.end()
    return scored.drop("rare", "times").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + int(ends > 0)).cast("bigint").alias("n_known"),
        F.lit(totals.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + end_base).alias("base_score"),
        (F.col("model") + F.coalesce("more_model", F.lit(0.0)) + end_model).alias("score"),
    )
