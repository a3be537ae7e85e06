"""SimHash near-duplicates against comparing every pair."""

import random

import brute
import numpy as np
import pytest
import xxhash
from samples import as_documents, rows, words

from boxloom.llm import simhash


def slow_fingerprint(text: str | None) -> int:
    w = brute.spaced(brute.low(text))
    parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(marks: list[int], distance: int = 4) -> list[int]:
    """The leader of each mark's component."""
    leader = list(range(len(marks)))

    def find(x: int) -> int:
        while leader[x] != x:
            leader[x] = leader[leader[x]]
            x = leader[x]
        return x

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= distance:
                leader[find(i)] = find(j)
    return [find(i) for i in range(len(marks))]


def slow_report(docs: list[tuple]) -> list[tuple]:
    marks = [slow_fingerprint(t) for _, t in docs]
    leaders = joined(marks)
    first: dict = {}
    for (doc_id, _), leader in zip(docs, leaders, strict=True):
        known = [x for x in (first.get(leader), doc_id) if x is not None]
        first[leader] = min(known, default=None)
    return [(d, f"{m:016x}", first[x]) for (d, _), m, x in zip(docs, marks, leaders, strict=True)]


COLUMNS = ("doc_id", "fingerprint", "component_id")


def test_near_duplicates(documents, texts):
    assert rows(simhash.near_duplicates(documents), *COLUMNS) == sorted(slow_report(texts), key=repr)


def test_near_duplicates_of_another_corpus(spark):
    rng = random.Random(1)
    docs = [(i, None if i % 90 == 0 else "  ") for i in range(0, 200, 45)]
    for _ in range(25):
        base = words(rng, rng.choice((3, 4, 30, 90, 300)))
        for _ in range(rng.choice((1, 2, 8))):
            own = list(base)
            own[rng.randrange(len(own))] = rng.choice(("new", "NEW", base[0]))
            docs.append((len(docs) * 3 % 97, " ".join(own)))
    assert rows(simhash.near_duplicates(as_documents(spark, docs)), *COLUMNS) == sorted(slow_report(docs), key=repr)


def family(rng: random.Random, sizes: tuple, most: int) -> list[int]:
    marks = []
    for size in sizes:
        base = rng.getrandbits(64)
        for _ in range(size):
            own = base
            for b in rng.sample(range(64), rng.randrange(most + 1)):
                own ^= 1 << b
            marks.append(own)
            base = own if rng.random() < 0.1 else base
    return sorted(set(marks))


@pytest.mark.parametrize(("small", "large", "entries"), [(64, 8192, 16), (4, 8192, 1), (2, 12, 16), (64, 8192, 1 / 256)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, small, large, entries):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(small)
    marks = family(rng, (120, 60, 30, 5, 2, 2, 1, 1), 5) + [0, 1, (1 << 64) - 1]
    marks = sorted(set(marks))
    signed = [(m - (1 << 64) if m >> 63 else m,) for m in marks]
    count = len(marks) if entries >= 1 else 1 << 40
    frame = spark.createDataFrame(signed, "mark bigint")
    found = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(frame, count).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    at = {m: i for i, m in enumerate(marks)}
    leader = list(range(len(marks)))
    for a, b in found:
        x, y = leader[at[a]], leader[at[b]]
        leader = [y if v == x else v for v in leader]
    expected = joined(marks)
    groups = lambda ls: sorted(tuple(i for i, v in enumerate(ls) if v == x) for x in set(ls))
    assert groups(leader) == groups(expected)


def test_links_stay_few_in_a_crowd(spark):
    rng = random.Random(2)
    marks = family(rng, (900,), 2)
    frame = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in marks], "mark bigint")
    assert simhash.links(frame, len(marks)).count() < 5 * len(marks) + 15 * len(marks)


def test_width_grows_with_the_fingerprints():
    assert [simhash.width_for(n, 4) for n in (0, 10, 4096, 4097, 1 << 20, (1 << 20) + 1, 1 << 28, 1 << 40)] == [1, 1, 1, 2, 2, 3, 3, 4]


def test_tally_counts_positions():
    a, b = np.array([0x1122334455667788], np.uint64), np.array([0x1122330055667799], np.uint64)
    assert simhash.tally(a ^ b).tolist() == [6]


def test_long_text(spark):
    docs = [(1, "x " * 200_000), (2, "x " * 200_000 + "y")]
    found = rows(simhash.near_duplicates(as_documents(spark, docs)), *COLUMNS)
    assert [r[2] for r in found] == [1, 1]


def test_nothing(nothing):
    assert rows(simhash.near_duplicates(nothing), *COLUMNS) == []
