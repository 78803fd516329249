"""Plain Python versions of the operators, over small lists of rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text: str | None, n: int = 5) -> Counter:
    words = SPACED.findall(text or "")
    return Counter(tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, min(len(words), 1))))


def jaccard(a: Counter, b: Counter) -> float:
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 0.0


def classes(rows: list[tuple], threshold: float = 0.8) -> dict:
    """id -> least id of the component of all pairs at or above the threshold."""
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x in range(len(sets)):
        for y in range(x):
            if sets[x][1] and sets[y][1] and jaccard(sets[x][1], sets[y][1]) >= threshold:
                a, b = sorted((root(sets[x][0]), root(sets[y][0])))
                label[b] = a
    return {i: root(i) for i, _ in rows}


def cut(rows: list[tuple], n: int = 13) -> dict:
    """id -> (words, removed, digest) where windows that a smaller id has are removed."""
    words = [(i, SPACED.findall(t or "")) for i, t in rows]
    first: dict = {}
    for i, w in words:
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - n + 1):
            if first.get(tuple(w[k : k + n]), i) is not None and (i is None or first[tuple(w[k : k + n])] < i) and tuple(w[k : k + n]) in first:
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)
