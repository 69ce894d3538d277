"""Plain-Python versions that several tests share."""

from __future__ import annotations

import collections
import re

import numpy as np

WHITE = " \t\n\x0b\f\r"
LOW = {k: k + 32 for k in range(65, 91)}


def lower(text: str | None) -> str:
    return (text or "").translate(LOW)


def words_of(text: str) -> list[str]:
    return [w for w in re.split(f"[{WHITE}]+", text) if w]


def shingles(text: str | None, k: int) -> set:
    w = words_of(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components_of(nodes, pairs) -> dict:
    """node: smallest node reachable over the pairs."""
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {x: find(x) for x in nodes}


def components(texts: dict, k: int, percent: int = 80) -> dict:
    """id: (size of its set, smallest id reachable)."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    number = {i: n for n, i in enumerate(texts)}
    names = list(texts)
    for i, s in sets.items():
        met = np.bincount([number[j] for x in s for j in held[x]], minlength=0) if s else np.zeros(0, int)
        for n in np.flatnonzero(met):
            j = names[n]
            if j > i and 100 * met[n] >= percent * (len(s) + len(sets[j]) - met[n]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def item_hits(text: str, items: list[tuple], window: int = 13, percent: int = 5) -> bool:
    """Whether benchmark items contaminate a text."""
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    w, hit = split(text), set()
    for item, t in items:
        own = split(t)
        n = min(window, len(own))
        wanted = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if item is not None and n else set()
        for k in range(len(w) - n + 1 if wanted else 0):
            if tuple(w[k : k + n]) in wanted:
                hit.update(range(k, k + n))
    return bool(hit) and 100 * len(hit) >= percent * len(w)
