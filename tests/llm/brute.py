"""Plain versions of the operators, for comparison on small data."""

from __future__ import annotations

import re
from itertools import combinations


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def word_shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def near_documents(docs, num, den):
    """{id: (set size, component)}"""
    sets = {i: word_shingles(t) for i, t in docs}
    links = [(a, b) for a, b in combinations(sets, 2)
             if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    comp = components(sets, links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def line_components(docs, threshold=0.8, q=8):
    """{(id, line): first place of its component}"""
    places = {}
    for i, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            if re.search(r"\S", line, re.ASCII):
                places.setdefault(line, []).append((i, n))
    sets = {line: {line[j:j + q] for j in range(len(line) - q + 1)} or {line} for line in places}
    links = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]
    comp = components(places, links)
    first = {}
    for line, ps in places.items():
        first[comp[line]] = min([first.get(comp[line], min(ps)), *ps])
    return {p: first[comp[line]] for line, ps in places.items() for p in ps}
