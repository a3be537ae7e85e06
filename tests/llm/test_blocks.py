"""How many blocks linked sets share, and the texts that no longer travel for a common phrase."""

import random

import brute
import numpy as np
import pytest
from samples import as_documents, rows, words

from boxloom.llm import jaccard


def blocks(plan: jaccard.Plan, values: set[int], back: int) -> tuple[set[int], int, int]:
    """Signatures of the filled blocks, how many a linked set shares, and the scheme's class."""
    own = np.array(sorted(values), dtype=np.uint64)
    _, signatures, least = jaccard._block_signatures(plan, np.zeros(len(own), np.int64), own, np.array([len(own)]), back)
    k = int(np.searchsorted(plan.classes, len(own), side="right")) - 1 - back
    return set(signatures.tolist()), int(least[0]), k


@pytest.mark.parametrize(("shingle", "percent"), [(5, 80), (3, 90), (3, 60)])
def test_linked_sets_share_as_many_blocks_as_each_of_them_asks_for(shingle, percent):
    plan = jaccard.plan_for(shingle, percent)
    rng = random.Random(percent)
    tried = asked = 0
    for size in [*range(plan.light + 1, 60), 64, 99, 100, 147, 183, 184, 230, 400, 719, 1000, 3000]:
        for other in {size, size + 1, size * 100 // percent - 1, size * 100 // percent, *(c for c in plan.classes if size <= c <= size * 2)}:
            overlap = plan.overlap(size, other)
            if overlap > size or other < size:
                continue
            both = {rng.getrandbits(64) for _ in range(overlap)}
            a, b = ({*both, *(rng.getrandbits(64) for _ in range(n - overlap))} for n in (size, other))
            own_a, least_a, scheme = blocks(plan, a, 0)
            own_b, least_b, same = min((blocks(plan, b, back) for back in (0, 1)), key=lambda x: x[2] != scheme)
            assert same == scheme
            bare = any(len(own) != len(own - {int(x) for x in jaccard.mix(np.array([scheme + 0xE3E3], dtype=np.uint64))}) for own in (own_a, own_b))
            assert len(own_a & own_b) >= max(least_a, least_b) or bare
            tried, asked = tried + 1, asked + (least_a > 1)
    assert tried > 100
    assert asked > tried / 2


def test_texts_that_share_phrases_only_are_in_no_list(spark, monkeypatch):
    """With more texts more of them have a phrase in common: that alone may not list them."""
    rng = random.Random(5)
    phrases = [words(rng, 7, 10**6) for _ in range(12)]
    docs = []
    for i in range(150):
        text = words(rng, 260, 10**6)
        for phrase in rng.sample(phrases, 4):
            at = rng.randrange(len(text))
            text[at:at] = phrase
        docs.append((i, " ".join(text)))
    docs += [(200 + i, text.replace(text.split()[200], "other")) for i, text in docs[:5]]
    seen = []
    real = jaccard.stored

    def watched(df):
        out = real(df)
        seen.append((set(df.columns), out.count()))
        return out

    monkeypatch.setattr(jaccard, "stored", watched)
    found = rows(jaccard.jaccard_components(as_documents(spark, docs), 5, 80), "doc_id", "n_shingles", "component_id")
    assert found == sorted(brute.components(docs, 5, 80), key=repr)
    assert len({c for _, _, c in found}) == 150
    nodes = [n for columns, n in seen if {"node", "sketch", "text"} <= columns and "id" not in columns]
    assert nodes == [10]
