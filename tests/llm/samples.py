"""Small corpora with all the awkward cases, and what tests do with frames."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, node int, size string, label string, words int"


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed: int = 7) -> list[tuple]:
    """Texts with copies, near copies of every degree, shared and repeated passages, junk."""
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \n\t", "one", "One", "one two", "a b c", "A  b\nC", "x" * 3000, "é ß 漢字 é ß 漢字"]
    passage = words(rng, 45)
    for n in (4, 8, 12, 18, 21, 25, 40, 90, 200, 500):
        base = words(rng, n)
        texts.append(" ".join(base))
        for edits in (0, 1, 1, 2, 3, 5, 8, 13):
            changed = list(base)
            for _ in range(min(edits, n)):
                at = rng.randrange(len(changed))
                changed[at : at + rng.choice((0, 1, 1, 2))] = words(rng, rng.choice((0, 1, 1)))
            texts.append(" ".join(changed))
        at = rng.randrange(n)
        texts.append(" ".join(base[:at] + passage + words(rng, 30) + passage[5:] + base[at:]))
    texts += [" ".join(["spam"] * k) for k in (2, 19, 20, 21, 60, 300)]
    texts += ["LOUD!! " * 60, "a line | of table\n" * 40, "### " * 80, "ends in CC BY 4.0", "All rights\nreserved, all rights reserved."]
    texts += ["This work is licensed under the GNU General Public License, version 3.", "Released under teh MIT License."]
    texts.append(" ".join(words(rng, 20_000, 3000)))
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[3], rows[40], (None, "a text without an id " * 3)]


def as_documents(spark, rows: list[tuple]):
    data = [(i, t, "en", None if (i or 0) % 11 == 0 else f"s{(i or 0) % 4}", len(t) if t else None, "r", 1, "s", "l", 2) for i, t in rows]
    return spark.createDataFrame(data, DOCS).repartition(3)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
