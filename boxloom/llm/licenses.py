"""Licence scan: exact phrases and fuzzy search for short notices.

A notice may be found with up to ``errors`` edits (a character inserted, deleted or
replaced). Cut into ``errors + 1`` pieces, at least one piece of it must stand in the
text unchanged, so the pieces are exact seeds. Around every seed, the ``regex`` library
matches the whole notice with that bound on its errors and gives the span and the edits.

Text and notices are compared as words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in
lower case, one blank between them, so punctuation and line breaks count for nothing.
Base phrases are places where a phrase's words stand consecutively.

Score: 1 with a base phrase, else the best notice's share of unchanged characters, else 0.

Of overlapping matches, the one with the fewest edits stays (then the longest).

Defined cases: a null or empty text has no words and no label; time grows with a text of many
phrases as with any other; repeated rows get equal results; no documents give no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from boxloom.llm.tables import by_batch, narrow
from boxloom.llm.words import ALNUM, text_column

#: Base phrases and their labels (fixed values).
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Notices and their labels (fixed values).
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "creative commons attribution 4 0 international license": "cc-by-4.0",
    "mozilla public license version 2 0": "mpl-2.0",
    "this work is in the public domain": "public-domain",
}
#: One edit is allowed per so many characters of a notice.
CHARS_PER_ERROR = 14

_SPACE = bytes(b + 32 if 65 <= b <= 90 else b if ALNUM[b] else 32 for b in range(256))


@dataclass(frozen=True)
class Notice:
    """A notice ready to search: ``seeds`` are exact pieces with their offsets."""

    text: str
    label: str
    errors: int
    seeds: tuple[tuple[str, int], ...]

    def pattern(self) -> regex.Pattern:
        return regex.compile(rf"(?b)(?:{regex.escape(self.text)}){{e<={self.errors}}}")


def prepare(notices: dict[str, str] = NOTICES) -> list[Notice]:
    out = []
    for text, label in notices.items():
        errors = len(text) // CHARS_PER_ERROR
        cuts = [len(text) * k // (errors + 1) for k in range(errors + 2)]
        out.append(Notice(text, label, errors, tuple((text[a:b], a) for a, b in zip(cuts[:-1], cuts[1:], strict=True))))
    return out


def normal(raw: bytes) -> tuple[str, int]:
    """The words with one blank between them, and their number."""
    words = raw.translate(_SPACE).split()
    return b" ".join(words).decode("utf-8", "replace"), len(words)


def fuzzy_spans(text: str, notice: Notice, pattern: regex.Pattern, found: dict[str, list[int]]) -> list[tuple[int, int, int]]:
    """``(start, end, edits)`` of the notice in a normal text, overlaps left out.

    ``found`` has the places of seeds that are known already.
    """
    size, errors = len(notice.text), notice.errors
    windows: list[list[int]] = []
    for seed, offset in notice.seeds:
        if seed not in found:
            places, at = [], text.find(seed)
            while at >= 0:
                places.append(at)
                at = text.find(seed, at + 1)
            found[seed] = places
        windows += [[max(0, at - offset - errors), at - offset + size + errors] for at in found[seed]]
    windows.sort()
    spans: list[tuple[int, int, int]] = []
    done = 0
    for first, last in windows:
        at = max(first, done)
        if last - at < size - errors:
            continue
        match = pattern.search(text, at, min(last, len(text)))
        if match:
            spans.append((match.start(), match.end(), sum(match.fuzzy_counts)))
            done = match.end()
    return spans


def scan_text(raw: bytes, notices: list[Notice], patterns: list[regex.Pattern]) -> dict:
    text, n_words = normal(raw)
    padded = f" {text} "
    places, base = [], set()
    for phrase, label in PHRASES.items():
        at, seen, word = padded.find(f" {phrase} "), 0, -1
        while at >= 0:
            word += padded.count(" ", seen, at + 1)
            seen = at + 1
            places.append(word)
            base.add(label)
            at = padded.find(f" {phrase} ", at + 1)
    spans, found = [], {}
    for notice, pattern in zip(notices, patterns, strict=True):
        for start, end, edits in fuzzy_spans(text, notice, pattern, found):
            spans.append({"label": notice.label, "notice": notice.text, "start": start, "end": end, "edits": edits,
                          "match": text[start:end], "share": 1 - edits / len(notice.text)})
    # where matches overlap, the one with the fewest edits (then the longest) is meant
    best: list[dict] = []  # sorted by start, and apart from each other
    for span in sorted(spans, key=lambda s: (s["edits"], s["start"] - s["end"], s["start"], s["label"])):
        at = bisect_right(best, span["start"], key=lambda s: s["start"])
        if (at == 0 or best[at - 1]["end"] <= span["start"]) and (at == len(best) or span["end"] <= best[at]["start"]):
            best.insert(at, span)
    spans = best
    labels = base | {s["label"] for s in spans}
    return {
        "n_words": n_words, "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)),
        "score": 1.0 if base else max((s["share"] for s in spans), default=0.0), "spans": spans,
    }


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
    ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                  ("edits", pa.int64()), ("match", pa.string()), ("share", pa.float64())]))),
])
_DDL = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, spans array<struct<label:string,notice:string,start:bigint,end:bigint,edits:bigint,match:string,share:double>>")


def _scanned(batch: pa.RecordBatch, notices: list[Notice]) -> pa.RecordBatch:
    patterns = [n.pattern() for n in notices]
    rows = [scan_text(t.encode("utf-8", "replace"), notices, patterns) for t in text_column(batch.column("text")).to_pylist()]
    columns = [batch.column("doc_id")] + [pa.array([r[f.name] for r in rows], f.type) for f in list(_SCHEMA)[1:]]
    return pa.record_batch(columns, schema=_SCHEMA)


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts, labels, score and the spans of notices
    (places in the normal text)."""
    own = narrow(docs, doc_id="doc_id", text="text")
    return own.mapInArrow(by_batch(partial(_scanned, notices=prepare(notices))), _DDL)


def report(found: DataFrame) -> DataFrame:
    return found.drop("spans")
