r"""Byte-level BPE by overlapping chunks.

A text of more than ``chunk_chars`` characters becomes chunk rows that start every
``chunk_chars`` and run ``overlap`` characters into the next one.  Chunks are
pre-tokenised in parallel.  The pattern looks only forward, so from any true
boundary on, the matches are fixed; where the boundaries of two neighbouring chunks
meet (resynchronise) inside the overlap, the stitch passes from one to the other.  If
they never meet there (a match longer than the overlap), matching goes on
from the last true boundary until they do.  The pieces between true boundaries are
then encoded, and decoding concatenates the raw bytes of the ids.

White space is ``\p{White_Space}``, as in the library whose results count; Python's
``\s`` also takes the control characters 1C-1F.

Cases: null text is empty (no ids); a repeated row gives its result as often as it
occurs; texts of any length are taken whole; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from revlens.llm.common import map_batches, pa_schema, texts

CACHE = 400_000
#: Characters from its start on which a match may depend beyond its own end ('ll, 've, 're).
REACH = 3


class Pieces(dict):
    """Ids of a piece, remembered; forgets everything beyond CACHE pieces."""

    def __init__(self, encoding):
        self.encoding = encoding

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= CACHE:
            self.clear()
        ids = self.encoding.encode_ordinary(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    """Ranks and pattern of a vocabulary file; one per worker process."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        own = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(own)
        self.pieces = Pieces(self.encoding)

    def encode(self, pieces) -> list[int]:
        ids: list[int] = []
        known = self.pieces
        for p in pieces:
            ids += known[p]
        return ids

    def boundaries(self, text: str, start: int, end: int) -> list[int]:
        """Starts of the matches of ``text[start:end]`` and the end of the last one that
        does not depend on what follows ``end``; places count in ``text``."""
        region = text[start:end]
        out = [start]
        for m in self.pattern.finditer(region):
            stop = start + m.end()
            if end < len(text) and (stop == end or m.start() + REACH > len(region)):
                break
            out.append(stop)
        return out

    def stitch(self, text: str, starts: list[int], bounds: list[list[int]]) -> list[int]:
        """True boundaries of ``text`` from those of its chunks."""
        true = bounds[0]
        for i in range(1, len(starts)):
            own = bounds[i]
            meet = set(own)
            k = bisect_left(true, starts[i])
            at = next((j for j in range(k, len(true)) if true[j] in meet), None)
            if at is None:
                pos = true[-1]
                while pos < len(text) and pos not in meet and pos < own[-1]:
                    pos = self.pattern.match(text, pos).end()
                    true.append(pos)
                if pos not in meet:
                    continue  # a match runs past this whole chunk
                at = len(true) - 1
            true = true[:at] + own[bisect_left(own, true[at]):]
        pos = true[-1]
        while pos < len(text):
            pos = self.pattern.match(text, pos).end()
            true.append(pos)
        return true


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


IDS = "doc_id long, n_tokens long, ids array<int>"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def ids_row(c: Codec, doc_id, ids: list[int]) -> tuple:
    return doc_id, len(ids), ids


def digest_row(c: Codec, doc_id, ids: list[int]) -> tuple:
    """Counts and digests; the decoded bytes are those of the ids."""
    return (doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(c.encoding.decode_bytes(ids)).hexdigest())


def encode(docs: DataFrame, ranks_path: str, pattern: str, row: Callable = ids_row, ddl: str = IDS,
           chunk_chars: int = 32_768, overlap: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``row(codec, doc_id, ids)`` in the columns ``ddl``."""
    schema = pa_schema(ddl)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars

    def out(found: list[tuple]):
        return dict(zip(schema.names, map(list, zip(*found))))

    def whole(b):
        c = codec(ranks_path, pattern)
        found = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b.column("text"))):
            found.append(row(c, doc_id, c.encode(c.pattern.findall(text))))
            if len(found) == 256:
                yield out(found)
                found = []
        if found:
            yield out(found)

    def cut(b):
        for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b.column("text"))):
            mark = hashlib.sha256(text.encode()).digest()
            starts = list(range(0, len(text), chunk_chars))
            yield {"doc_id": [doc_id] * len(starts), "mark": [mark] * len(starts), "chunk": starts,
                   "body": [text[s:s + chunk_chars] for s in starts],
                   "ahead": [text[s + chunk_chars:s + chunk_chars + overlap] for s in starts]}

    def pretokenise(b):
        c = codec(ranks_path, pattern)
        bounds = []
        for body, ahead in zip(texts(b.column("body")), texts(b.column("ahead"))):
            # a character past the region stands for a text that goes on
            bounds.append(c.boundaries(body + ahead + (" " if len(ahead) == overlap else ""), 0, len(body) + len(ahead)))
        yield {"doc_id": b.column("doc_id"), "mark": b.column("mark"), "chunk": b.column("chunk"), "body": b.column("body"), "bounds": bounds}

    def join(batches) -> Iterator:
        c = codec(ranks_path, pattern)
        key, held = None, []

        def finish():
            copies = sum(1 for h in held if h[0] == 0)
            parts = held[::copies]  # a repeated row's chunks are equal
            text = "".join(h[1] for h in parts)
            true = c.stitch(text, [h[0] for h in parts], [[h[0] + x for x in h[2]] for h in parts])
            found = row(c, key[0], c.encode(text[p:q] for p, q in zip(true, true[1:])))
            return pa.RecordBatch.from_pydict(out([found] * copies), schema=schema)

        for b in batches:
            for doc_id, mark, chunk, body, bounds in zip(*(b.column(x) for x in ("doc_id", "mark", "chunk", "body", "bounds"))):
                if key != (k := (doc_id.as_py(), mark.as_py())):
                    if held:
                        yield finish()
                    key, held = k, []
                held.append((chunk.as_py(), body.as_py(), bounds.as_py()))
        if held:
            yield finish()

    short = map_batches(rows.where(~long), whole, ddl)
    chunks = map_batches(rows.where(long), cut, "doc_id long, mark binary, chunk long, body string, ahead string")
    spread = chunks.repartition("mark", "chunk")
    cuts = map_batches(spread, pretokenise, "doc_id long, mark binary, chunk long, body string, bounds array<int>")
    joined = cuts.repartition("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "chunk").mapInArrow(join, ddl)
    return short.unionByName(joined)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, bytes): the raw bytes of the ids, concatenated."""
    def run(b):
        c = codec(ranks_path, pattern)
        yield {"doc_id": b.column("doc_id"), "bytes": [c.encoding.decode_bytes(x or []) for x in b.column("ids").to_pylist()]}

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, bytes binary")
