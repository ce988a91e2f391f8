"""Plain re-computations on small inputs."""

from __future__ import annotations

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))


def shingle_set(text, size):
    w = words(text)
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def roots(vertices, links):
    parent = {v: v for v in vertices}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in parent}


def near_links(texts, size, percent):
    """Links between (doc_id, text) rows, by comparing all pairs that share a shingle."""
    sets = [(i, shingle_set(t, size)) for i, t in texts]
    by = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    links = set()
    for k, (i, s) in enumerate(sets):
        shared = {}
        for x in s:
            for m in by[x]:
                if m < k:
                    shared[m] = shared.get(m, 0) + 1
        for m, n in shared.items():
            j, t = sets[m]
            if 100 * n >= percent * (len(s) + len(t) - n):
                links.add((j, i))
    return links
