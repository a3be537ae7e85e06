"""Plain one-by-one versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def low(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text: str | None, k: int) -> set:
    w = spaced(low(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def components(docs: list[tuple], k: int, percent: int) -> list[tuple]:
    sets = [shingles(t, k) for _, t in docs]
    leader = list(range(len(docs)))

    def find(x: int) -> int:
        while leader[x] != x:
            x = leader[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                leader[find(i)] = find(j)
    least: dict[int, list] = defaultdict(list)
    for i, (doc_id, _) in enumerate(docs):
        least[find(i)].append(doc_id)
    first = {r: min((x for x in ids if x is not None), default=None) for r, ids in least.items()}
    return [(doc_id, len(sets[i]), first[find(i)]) for i, (doc_id, _) in enumerate(docs)]


def warc(pages: list[tuple]) -> list[tuple]:
    payloads = [(i, (h or "").encode()) for i, _, h in pages]
    top: dict[bytes, int] = {}
    for i, b in payloads:
        if i is not None:
            top[b] = max(top.get(b, i), i)
    out = []
    for i, b in payloads:
        other = len(b) >= 1000 and b in top and (i is None or i < top[b])
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if other else "response", top[b] if other else None))
    return out


def base_scores(docs: list[tuple]) -> list[tuple]:
    counts: Counter = Counter()
    held, tokens = [], []
    for doc_id, text in docs:
        held.append(zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0)
        tokens.append([*spaced(low(text)), None])
        if not held[-1]:
            counts.update(tokens[-1])
    n, v = sum(counts.values()), len(counts)
    return [
        (d[0], h, len(t), sum(counts[x] > 0 for x in t), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t))
        for d, h, t in zip(docs, held, tokens, strict=True)
    ]


def contamination(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    owners: dict[tuple, set] = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            owners[tuple(w[i : i + size])].add("" if item is None else str(item))
    sizes = {len(k) for k in owners}
    out = []
    for doc_id, text in docs:
        w, hit, found = alnum(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if names := owners.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= names
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def statistics(text: str | None) -> tuple:
    w, lines = spaced(text), [x for x in (text or "").split("\n") if spaced(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed)


def removals(docs: list[tuple], window: int = 20) -> list[tuple]:
    """Documents with different ids, or repeated rows."""
    order = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0, d[1] or ""))
    first: dict[tuple, tuple] = {}
    for doc_id, text in order:
        w = spaced(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (doc_id, i))
    out = []
    for doc_id, text in docs:
        w = spaced(text)
        gone = {i + k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] != (doc_id, i) for k in range(window)}
        rest = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), sha(rest)))
    return out


def phrases(text: str | None) -> tuple:
    known = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    w = alnum(text)
    places = [(i, label) for p, label in known.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
    at = [i for i, _ in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
