"""Periodic runs of words, found by block convolution at dyadic scales.

A run is a stretch of words with smallest period q (words q apart are equal) of at least
``max(least, 3 * q)`` words that no neighbouring word extends keeping period q.

* At scale L the words are cut into aligned blocks of L. A run whose period lies in the
  scale's range holds a whole block together with the same words one period on, so the
  block stands again, without a mismatch, at distance q in the window that follows it.
* The squared differences of a block and all L places of its window are sums of squares
  less twice a correlation. The correlation is a number-theoretic transform over a prime,
  of values so small that no sum reaches the prime: the sums are exact integers, and zero
  means that all values agree. Blocks of a scale are transformed together.
* A block can only stand again nearby if each of its words does. Blocks with a word whose
  next equal one lies beyond the window have no zero and are not transformed.
* Each zero seeds an extension: prefix hashes under two primes and a binary search give how
  far words q apart stay equal to either side, for all seeds of a batch at once. Stretches
  that are long enough are runs; of several periods of one stretch the smallest counts.

Every text is settled in the task that reads it, so nothing is shuffled. Work grows as
n log^2 n with a text's words n, whatever repeats in it.

Defined cases: null and empty texts have no words and no runs; a null doc_id is a row like
any other (:func:`report` leaves its words as they are, since it has no decimal form);
rows with one doc_id are separate rows; no documents give no rows. Words are told apart by
64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.tables import by_batch, narrow
from boxloom.llm.words import SPACED, Chunk, chunks

#: Fewest words of a run.
LEAST = 24
#: Values transformed at once.
BATCH = 1 << 18

#: Primes below 2^32: the first has roots of unity of every order up to 2^30.
_P, _Q = 3 * 2**30 + 1, 2**32 - 5
_ROOT = 5
_U = np.uint64
_FOUND = "id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _powers(base: int, size: int, prime: int) -> np.ndarray:
    """``base ** k`` modulo the prime for k below ``size``."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < size:
        out = np.concatenate((out, out * _U(pow(base, len(out), prime)) % _U(prime)))
    return out[:size]


@lru_cache(maxsize=64)
def _twiddles(size: int, inverse: bool) -> np.ndarray:
    root = pow(_ROOT, (_P - 1) // size, _P)
    return _powers(pow(root, -1, _P) if inverse else root, size // 2, _P)


def _forward(x: np.ndarray) -> np.ndarray:
    """Transforms of the rows of ``x``, in bit-reversed order."""
    size = x.shape[1]
    while size > 1:
        half = size // 2
        parts = x.reshape(len(x), -1, size)
        a, b = parts[..., :half], parts[..., half:]
        low = (a + b) % _U(_P)
        high = (a + (_U(_P) - b)) % _U(_P) * _twiddles(size, False) % _U(_P)
        x = np.concatenate((low, high), axis=2).reshape(len(x), -1)
        size = half
    return x


def _backward(x: np.ndarray) -> np.ndarray:
    """The rows whose transforms, in bit-reversed order, are ``x``."""
    full, size = x.shape[1], 2
    while size <= full:
        half = size // 2
        parts = x.reshape(len(x), -1, size)
        a, b = parts[..., :half], parts[..., half:] * _twiddles(size, True) % _U(_P)
        x = np.concatenate(((a + b) % _U(_P), (a + (_U(_P) - b)) % _U(_P)), axis=2).reshape(len(x), -1)
        size *= 2
    return x * _U(pow(full, -1, _P)) % _U(_P)


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Per row the sums of squared differences between a block of L values and the L values
    from each of the first L places of a window of 2 L. Sums have to stay below the prime."""
    size = blocks.shape[1]
    padded = np.zeros((len(blocks), 2 * size), dtype=np.uint64)
    padded[:, 0] = blocks[:, 0]
    padded[:, size + 1 :] = blocks[:, :0:-1]
    cross = _backward(_forward(padded) * _forward(windows) % _U(_P))[:, :size].astype(np.int64)
    sums = np.zeros((len(windows), 2 * size + 1), dtype=np.int64)
    np.cumsum((windows * windows).astype(np.int64), axis=1, out=sums[:, 1:])
    own = (blocks * blocks).sum(axis=1).astype(np.int64)
    return own[:, None] + sums[:, size : 2 * size] - sums[:, :size] - 2 * cross


class _Prefixes:
    """Prefix hashes of a sequence, to compare stretches of it."""

    def __init__(self, values: np.ndarray):
        self.sides = []
        for prime, base in ((_P, 0x2545F491), (_Q, 0x9E3779B1)):
            powers = _powers(base % prime, len(values) + 1, prime)
            sums = np.zeros(len(values) + 1, dtype=np.uint64)
            np.cumsum(values % _U(prime) * powers[:-1] % _U(prime), out=sums[1:])
            self.sides.append((_U(prime), powers, sums % _U(prime)))

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` values from i and from j >= i on are the same."""
        same = np.ones(len(i), dtype=bool)
        for prime, powers, sums in self.sides:
            first = (sums[i + length] + (prime - sums[i])) % prime * powers[j - i] % prime
            same &= first == (sums[j + length] + (prime - sums[j])) % prime
        return same

    def reach(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many values from i and j on (step 1) or before them (step -1) are the same."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            back = middle if step < 0 else 0
            same = self.equal(i - back, j - back, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _next_same(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How far on in its row each value stands again."""
    order = np.lexsort((values, rows))
    again = (values[order][1:] == values[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    out = np.full(len(values), len(values) + 1, dtype=np.int64)
    out[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return out


def _scales(longest: int, least: int) -> Iterator[tuple[int, int]]:
    """``(block, first distance)`` of all scales; a scale takes as many distances as a
    block has words."""
    block = 1
    while 6 * block <= least:
        block *= 2
    first = 1
    while 3 * first <= longest:
        yield block, first
        first += block
        block = max(block, first - 1)


def find(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, least: int = LEAST) -> np.ndarray:
    """``(start, end, period)`` of all runs in consecutive rows of values, by start, then period.

    ``rows``, ``starts`` and ``ends`` give each value's row and where that row lies.
    """
    if least < 3:
        raise ValueError("a run has at least three words")
    empty = np.zeros((0, 3), dtype=np.int64)
    n = len(values)
    if n < least:
        return empty
    apart, prefixes, found = _next_same(rows, values), None, [empty]
    for block, first in _scales(int((ends - starts).max()), least):
        whole = n // block
        near = apart[: whole * block].reshape(whole, block).max(axis=1) < first + block
        at = np.flatnonzero(near) * block
        at = at[(rows[at] == rows[at + block - 1]) & (at + block + first <= ends[at])]
        if not len(at):
            continue
        prefixes = prefixes or _Prefixes(values)
        # so few bits that the largest sum stays below the prime
        bits = max(1, (31 - block.bit_length() + 1) // 2)
        small = np.zeros(n + 3 * block, dtype=np.uint64)
        small[:n] = (values >> _U(17)) & _U((1 << bits) - 1)
        step = max(1, BATCH // (2 * block))
        for k in range(0, len(at), step):
            own = at[k : k + step]
            differences = squared_differences(
                small[own[:, None] + np.arange(block)], small[own[:, None] + (first + np.arange(2 * block))]
            )
            which, shift = np.nonzero(differences == 0)
            i, period = own[which], shift + first
            fits = i + period + block <= ends[i]
            i, period = i[fits], period[fits]
            j = i + period
            fits = prefixes.equal(i, j, np.full(len(i), block))
            i, j, period = i[fits], j[fits], period[fits]
            left = prefixes.reach(i, j, i - starts[i], -1)
            right = prefixes.reach(i + block, j + block, ends[i] - j - block, 1)
            start, end = i - left, j + block + right
            long = end - start >= np.maximum(least, 3 * period)
            found.append(_smallest(np.stack((start, end, period), axis=1)[long]))
    runs = _smallest(np.concatenate(found))
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Each stretch once, with its smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def _of_chunk(chunk: Chunk, least: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Runs of all rows, how many each row has, and the texts without repeated periods."""
    rows = chunk.row_of()
    starts, ends = chunk.bounds[rows], chunk.bounds[rows + 1]
    runs = find(rows, starts, ends, chunk.hashes, least)
    drops = np.zeros(len(rows) + 1, dtype=np.int64)
    np.add.at(drops, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drops, runs[:, 1], -1)
    kept = np.cumsum(drops)[:-1] == 0
    owner = rows[runs[:, 0]]
    counts = np.bincount(owner, minlength=len(chunk.counts))
    texts = []
    for row, (first, last) in enumerate(zip(chunk.rows[:-1].tolist(), chunk.rows[1:].tolist(), strict=True)):
        words = chunk.data[first:last].tobytes().split()
        if counts[row]:
            words = compress(words, kept[chunk.bounds[row] : chunk.bounds[row + 1]].tolist())
        texts.append(b" ".join(words))
    out = np.stack((runs[:, 0] - starts[runs[:, 0]], runs[:, 1] - runs[:, 0], runs[:, 2]), axis=1)
    return out, counts, texts


def _found(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    runs, counts, words, texts = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for chunk in chunks(batch.column("text"), SPACED, False):
        own, count, kept = _of_chunk(chunk, least)
        runs.append(own)
        counts.append(count)
        words.append(chunk.counts)
        texts.extend(kept)
    run = np.concatenate(runs)
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int32)
    columns = pa.StructArray.from_arrays([pa.array(run[:, k]) for k in range(3)], fields=list(_RUN))
    return pa.record_batch(
        [batch.column("id"), pa.array(np.concatenate(words), pa.int64()),
         pa.ListArray.from_arrays(pa.array(offsets), columns), pa.array(texts, pa.binary()).cast(pa.string())],
        ["id", "n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, n_words, runs, collapsed``.

    ``runs`` are ``(start, length, period)`` in words, by start, then period; ``collapsed``
    is the text, single-spaced, without what a run holds after its first period.
    """
    found = narrow(docs, id="doc_id", text="text").mapInArrow(by_batch(partial(_found, least=least)), _FOUND)
    return found.withColumnRenamed("id", "doc_id")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where the words of one in ten documents, by the checksum of its id,
    turn periodic from some word on."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rest = F.floor(checksum / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        first = rest % n
        period = 1 + F.floor((n - first) / (3 + rest % 8))
        at = lambda i: F.when(i < first, i).otherwise(first + (i - first) % period)
        places = F.sequence(F.lit(0).cast("bigint"), n - 1)
        return F.when(n > 0, F.array_join(F.transform(places, lambda i: F.get(words, at(i).cast("int"))), " ")).otherwise("")

    # the words are bound to a lambda's variable, so that they are cut once
    words = F.array(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    text = F.when((checksum % 10 == 0) & F.col("text").isNotNull(), F.transform(words, planted)[0]).otherwise(F.col("text"))
    return narrow(docs, doc_id="doc_id", text="text").select("doc_id", text.alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """Runs of ``docs`` after :func:`with_planted_runs`: per document row ``doc_id, n_runs``,
    ``start, length, period, exponent_milli`` of the run with the greatest length by period
    (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    runs = F.col("runs")
    greater = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    best = F.reduce(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(greater(a, b), b).otherwise(a))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return periodic_runs(with_planted_runs(docs)).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
