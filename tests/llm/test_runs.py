"""Periodic runs against a search of every period at every place."""

import random
import zlib

import brute
import numpy as np
import pytest
from samples import as_documents, rows, words

from boxloom.llm import runs


def slow_runs(w: list, least: int = 24) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, 3 * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def slow_report(docs: list[tuple]) -> list[tuple]:
    out = []
    for doc_id, text in docs:
        w = brute.spaced(text)
        n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = slow_runs(w)
        drop = {i for s, e, q in found for i in range(s + q, e)}
        best = None
        for s, e, q in found:
            if best is None or (e - s) * best[2] > best[1] * q:
                best = (s, e - s, q)
        milli = None if best is None else 1000 * best[1] // best[2]
        out.append((doc_id, len(found), *(best or (None,) * 3), milli,
                    brute.sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)),
                    brute.sha(" ".join(x for i, x in enumerate(w) if i not in drop))))
    return out


def found_in(w: list, least: int = 24) -> list[tuple[int, int, int]]:
    values = np.array([brute_hash(x) for x in w], dtype=np.uint64)
    n = len(values)
    got = runs.find(np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, n), values, least)
    return [tuple(r) for r in got.tolist()]


def brute_hash(x) -> int:
    return random.Random(f"{x}").getrandbits(64)


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_random_repetitions(seed):
    rng = random.Random(seed)
    for _ in range(15):
        w = []
        for _ in range(rng.randrange(1, 8)):
            block = [rng.randrange(rng.choice((1, 2, 2, 3, 5))) for _ in range(rng.randrange(1, 40))]
            w += block * rng.choice((1, 1, 2, 3, 4, 5, 12))
        least = rng.choice((3, 5, 12, 24, 24, 24, 40))
        assert found_in(w, least) == slow_runs(w, least)


def test_runs_of_hard_sequences():
    fibonacci, before = [0, 1], [0]
    while len(fibonacci) < 800:
        fibonacci, before = fibonacci + before, fibonacci
    morse = [0]
    for _ in range(9):
        morse += [1 - x for x in morse]
    for w in (fibonacci, morse, morse * 3 + [5], [0] * 700, ([0] * 30 + [1]) * 20, list(range(100)) * 3, list(range(100)) * 2):
        assert found_in(w) == slow_runs(w)


def test_squared_differences_are_exact():
    rng = np.random.default_rng(3)
    for size, bits in ((8, 14), (64, 12), (1024, 10)):
        blocks = rng.integers(0, 1 << bits, (3, size), dtype=np.uint64)
        windows = rng.integers(0, 1 << bits, (3, 2 * size), dtype=np.uint64)
        windows[0, 5 : 5 + size] = blocks[0]
        got = runs.squared_differences(blocks, windows)
        a, b = blocks.astype(np.int64), windows.astype(np.int64)
        assert got.tolist() == [[int(((x - y[d : d + size]) ** 2).sum()) for d in range(size)] for x, y in zip(a, b, strict=True)]
        assert got[0, 5] == 0


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_report(documents, texts):
    small = [(i, t) for i, t in texts if len(brute.spaced(t)) < 3000]
    found = [r for r in rows(runs.report(documents), *COLUMNS) if r[0] in {i for i, _ in small}]
    assert found == sorted(slow_report(small), key=repr)


def test_report_on_planted_and_repeated_rows(spark):
    rng = random.Random(11)
    docs = [(i, " ".join(words(rng, rng.randrange(0, 400), 50))) for i in range(300)]
    docs += [(None, "x y " * 40), (None, None), (3, "x y " * 40), (3, "x y " * 40), (7, "é　ü " * 20 + "\n\t z" * 30)]
    assert rows(runs.report(as_documents(spark, docs)), *COLUMNS) == sorted(slow_report(docs), key=repr)


def test_long_text(spark):
    long = [(i, "a b c " * 30_000 + "end") for i in (1, 2)]
    (row, _) = rows(runs.periodic_runs(as_documents(spark, long)), "n_words", "runs", "collapsed")
    assert row[0] == 90_001 and [tuple(r) for r in row[1]] == [(0, 90_000, 3)] and row[2] == "a b c end"


def test_nothing(nothing):
    assert rows(runs.report(nothing), *COLUMNS) == []
