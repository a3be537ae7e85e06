"""Sketches of sets: what they rule out, and the texts that no longer travel for it."""

import random

import brute
import numpy as np
import pyarrow as pa
from samples import as_documents, rows, words

from boxloom.llm import jaccard


def sketch_of(values: set[int]) -> bytes:
    own = np.array(sorted(values), dtype=np.uint64)
    data, width = jaccard._sketches(np.zeros(len(own), np.int64), own, np.array([len(own)]))
    assert len(data) == width[0] >= len(own) / 8
    return data.tobytes()


def possible(pairs: list[tuple[set, set]], percent: int) -> list[int]:
    batch = pa.record_batch({
        "a": list(range(len(pairs))), "b": list(range(len(pairs))),
        "size_a": [len(a) for a, _ in pairs], "size_b": [len(b) for _, b in pairs],
        "sketch_a": [sketch_of(a) for a, _ in pairs], "sketch_b": [sketch_of(b) for _, b in pairs],
    })
    return jaccard._possible(batch, percent).column("a").to_pylist()


def test_sketches_rule_out_no_link_and_most_others():
    rng = random.Random(3)
    pairs, linked = [], []
    for size in (1, 2, 5, 60, 63, 64, 65, 127, 129, 300, 1000, 5000):
        for share in (100, 98, 95, 91, 90, 89, 85, 80, 79, 60, 30):
            for other in (size, size + 1, size * 10 // 9, size * 5 // 4, size * 3 // 4 + 1):
                both = {rng.getrandbits(64) for _ in range(min(size, other) * share // 100)}
                a, b = ({*both, *(rng.getrandbits(64) for _ in range(n - len(both)))} for n in (size, other))
                pairs.append((a, b))
                linked.append(100 * len(a & b) / len(a | b))
    for percent in (80, 90):
        kept = set(possible(pairs, percent))
        assert {i for i, x in enumerate(linked) if x >= percent} <= kept
        far = [i for i, x in enumerate(linked) if x < percent - 25 and len(pairs[i][0]) > 50]
        assert len(kept & set(far)) < len(far) / 50


def test_texts_that_share_a_passage_only_are_not_read_together(spark, monkeypatch):
    """Texts with one common passage meet in lists; none of their texts may be stored again."""
    rng = random.Random(4)
    passage = words(rng, 150, 10**6)
    docs = [(i, " ".join(passage + words(rng, 150, 10**6))) for i in range(60)]
    docs += [(100 + i, text.replace(text.split()[200], "other")) for i, text in docs[:5]]
    seen = []
    real = jaccard.stored

    def watched(df):
        out = real(df)
        seen.append((sorted(df.columns), out.count()))
        return out

    monkeypatch.setattr(jaccard, "stored", watched)
    found = rows(jaccard.jaccard_components(as_documents(spark, docs)), "doc_id", "n_shingles", "component_id")
    assert found == sorted(brute.components(docs, 3, 90), key=repr)
    pairs = [n for columns, n in seen if columns == ["a", "b"]]
    assert pairs and max(pairs) <= 10
    texts = [n for columns, n in seen if columns == ["node", "text"]]
    assert max(texts) <= 10
