r"""License scans: exact set-similarity join of text blocks with license templates.

A text block is a window of words, across line ends too, half as many again as the template
has (``SLACK``); windows overlap word by word.  A template matches a block when the block
holds at least ``threshold`` of the template's distinct tokens (containment, exact), its
numbers among them: they tell versions apart.  Matching windows that overlap are one place.
With ``windows=False`` a block is a whole line and numbers are tokens as any other.

Tokens are put in one global order, rarest first by their count over the whole corpus; then

* prefix filter: a match shares a token of the template's first
  ``size - needed + 1`` tokens in that order, so only those are indexed,
* length filter: the block has at least ``needed`` distinct template tokens,
* positional filter: from the places of the first shared token on either side, the
  overlap still possible reaches ``needed``,

and what is left is verified on the full sets.  These filters pick a document's templates;
only those are then swept over the places of their tokens, in one pass.  The template side is a fixed list, so
its index goes to every task; the text side is read twice (counts, matches) and nothing
of it is shuffled but one count per template token and task.

Base phrases are places where the phrase's words stand consecutively, across lines too.

Cases: null text is empty: no words, no labels, score 0; a repeated row gives its result
again; texts and lines of any length are taken whole; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from revlens.llm.common import map_batches, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: words of a window per word of its template
SLACK = 1.5
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

#: phrase -> label
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label -> notices whose tokens a block must hold
TEMPLATES = {
    "notice-agpl": ["licensed under the gnu affero general public license"],
    "notice-all-rights-reserved": ["all rights reserved"],
    "notice-apache-2.0": ["licensed under the apache license version 2 0"],
    "notice-bsd": ["redistribution and use in source and binary forms with or without modification are permitted",
                   "licensed under the bsd license"],
    "notice-cc-by-nc-4.0": ["licensed under cc by nc 4 0"],
    "notice-cc-by-sa-4.0": ["licensed under cc by sa 4 0"],
    "notice-cc0": ["to the extent possible under law the author has waived all copyright and related rights"],
    "notice-gpl-2": ["licensed under the gnu general public license version 2"],
    "notice-gpl-3": ["this work is licensed under the gnu general public license version 3"],
    "notice-mit": ["released under the mit license", "licensed under the mit license",
                   "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "notice-mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}


def words(text: str) -> list[str]:
    return WORD.findall(text.translate(_LOWER))


def base_places(tokens: list[str]) -> dict[str, list[int]]:
    """label -> starts of its phrase among the words."""
    found: dict[str, list[int]] = {}
    have = set(tokens)
    for phrase, label in BASE.items():
        parts = phrase.split(" ")
        if not have.issuperset(parts):
            continue
        n, at = len(parts), -1
        while True:
            try:
                at = tokens.index(parts[0], at + 1)
            except ValueError:
                break
            if tokens[at:at + n] == parts:
                found.setdefault(label, []).append(at)
    return found


@dataclass
class Index:
    """Prefix index of the templates under one global token order."""

    rank: dict[str, int]
    needed: list[int]
    ordered: list[list[int]]
    labels: list[str]
    prefix: dict[int, list[tuple[int, int]]]
    least: int
    width: list[int]
    numbers: list[set[int]]

    @classmethod
    def build(cls, counts: dict[str, int], templates: dict[str, list[str]], threshold: float) -> Index:
        sets = [(label, set(words(t))) for label, ts in sorted(templates.items()) for t in ts]
        width = [math.ceil(SLACK * len(words(t))) for _, ts in sorted(templates.items()) for t in ts]
        vocabulary = sorted(set().union(*(s for _, s in sets)), key=lambda w: (counts.get(w, 0), w))
        rank = {w: i for i, w in enumerate(vocabulary)}
        needed, ordered, prefix = [], [], {}
        for t, (_, s) in enumerate(sets):
            order = sorted(rank[w] for w in s)
            need = max(1, math.ceil(threshold * len(order) - 1e-9))
            needed.append(need)
            ordered.append(order)
            for place, r in enumerate(order[:len(order) - need + 1]):
                prefix.setdefault(r, []).append((t, place))
        return cls(rank, needed, ordered, [label for label, _ in sets], prefix, min(needed),
                   width, [{rank[w] for w in s if w.isdigit()} for _, s in sets])

    def matches(self, block: set[str]) -> list[tuple[str, float]]:
        """(label, containment) of all templates that the block's tokens reach."""
        return [(self.labels[t], both / len(self.ordered[t])) for t, both in self.reached(block)]

    def reached(self, block: set[str]) -> list[tuple[int, int]]:
        """(template, shared tokens) of all templates that the block's tokens reach."""
        mine = sorted(self.rank[w] for w in block if w in self.rank)
        if len(mine) < self.least:
            return []
        seen: set[int] = set()
        out = []
        for place, r in enumerate(mine):
            for t, there in self.prefix.get(r, ()):
                if t in seen:
                    continue
                seen.add(t)  # ranks ascend: this is the first shared token of the prefix
                need, order = self.needed[t], self.ordered[t]
                if len(mine) < need or 1 + min(len(order) - there - 1, len(mine) - place - 1) < need:
                    continue
                both = len(set(order).intersection(mine))
                if both >= need:
                    out.append((t, both))
        return out

    def places(self, tokens: list[str]) -> list[tuple[int, int, str, float]]:
        """(first word, last word, label, containment) of the places where windows reach a template."""
        reached = self.reached(set(tokens))
        if not reached:
            return []
        hits = [(at, self.rank[w]) for at, w in enumerate(tokens) if w in self.rank]
        out = []
        for t, _ in reached:
            own, n, left = set(self.ordered[t]), Counter(), 0
            mine = [h for h in hits if h[1] in own]
            found: list[list] = []
            for at, r in mine:
                n[r] += 1
                # a first word that comes again in the window, or lies before it, goes
                while n[mine[left][1]] > 1 or at - mine[left][0] >= self.width[t]:
                    n[mine[left][1]] -= 1
                    if not n[mine[left][1]]:
                        del n[mine[left][1]]
                    left += 1
                if len(n) < self.needed[t] or not all(x in n for x in self.numbers[t]):
                    continue
                start, part = mine[left][0], len(n) / len(own)
                if found and start <= found[-1][1]:
                    found[-1][1:] = [at, max(found[-1][2], part)]
                else:
                    found.append([start, at, part])
            out += [(a, b, self.labels[t], part) for a, b, part in found]
        return sorted(out)


def token_counts(docs: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """Corpus counts of the template tokens: one row per token, a fixed number of them."""
    def run(batches):
        import pyarrow as pa
        n: Counter = Counter()
        for b in batches:
            for text in texts(b.column("text")):
                for w, k in Counter(words(text)).items():
                    if w in vocabulary:
                        n[w] += k
        yield pa.RecordBatch.from_pydict({"w": list(n), "n": pa.array(list(n.values()), pa.int64())},
                                         schema=pa.schema([("w", pa.string()), ("n", pa.int64())]))

    found = docs.mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {r["w"]: r["n"] for r in found.collect()}


SCAN = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, n_blocks long, blocks array<string>")


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = 0.9,
         id_col: str = "doc_id", text_col: str = "text", windows: bool = False) -> DataFrame:
    """Per document its base places, labels, best containment and matching blocks.

    Blocks are ``word:label``, the word a place begins with; places that overlap count as one
    in ``n_blocks``.  With ``windows=False`` they are ``line:label``, counted by line.

    ``score`` is the best containment found, 1 where a base phrase stands whole, else 0.
    """
    templates = TEMPLATES if templates is None else templates
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    vocabulary = {w for ts in templates.values() for t in ts for w in words(t)}
    index = Index.build(token_counts(rows.select("text"), vocabulary), templates, threshold)

    def by_window(text: str) -> tuple:
        tokens = words(text)
        found = index.places(tokens)
        n, end = 0, -1
        for a, b, _, _ in found:
            n += a > end
            end = max(end, b)
        return tokens, {x[2] for x in found}, [f"{a}:{label}" for a, _, label, _ in found], max((x[3] for x in found), default=0.0), n

    def by_line(text: str) -> tuple:
        tokens: list[str] = []
        labels, blocks, best = set(), [], 0.0
        for no, line in enumerate(text.translate(_LOWER).split("\n")):
            own = WORD.findall(line)
            tokens += own
            for label, part in index.matches(set(own)):
                labels.add(label)
                blocks.append(f"{no}:{label}")
                best = max(best, part)
        return tokens, labels, blocks, best, len({x.split(":")[0] for x in blocks})

    def one(doc_id, text: str) -> tuple:
        tokens, labels, blocks, best, n_blocks = by_window(text) if windows else by_line(text)
        base = base_places(tokens)
        places = [p for ps in base.values() for p in ps]
        return (doc_id, len(tokens), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                ",".join(sorted(labels | set(base))), 1.0 if places else best, n_blocks, blocks)

    names = [x.split()[0] for x in SCAN.split(", ")]

    def run(b):
        found = [one(i, t) for i, t in zip(b.column("doc_id").to_pylist(), texts(b.column("text")))]
        if found:
            yield dict(zip(names, map(list, zip(*found))))

    return map_batches(rows, run, SCAN)
