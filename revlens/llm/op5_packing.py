r"""Best-fit packing by minimum bin slack.

A document's ids and the end id are cut into pieces of ``capacity`` only where longer.
Pieces are packed by their lengths alone, so the packing works on the histogram of
lengths (at most ``capacity`` entries, whatever the input): per bin, a bitset subset-sum
over the available lengths (the largest one is always taken) finds the fullest
feasible combination, which is then removed, as often as the counts allow at once.
Pieces of one length are numbered, and number and length say which sequence and offset
a piece gets; numbering counts bounded blocks first, so no length is one task's group.

Tokenisation remembers the ids of white-space separated words: the vocabulary's splits
never cross white space, and letters and closing marks of a word split alike.

Cases: null text is empty (only the end id); a repeated row is a piece of its own; texts
of any length are tokenised whole; ties between pieces of a length go by (doc_id,
piece); null ids are packed too; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from revlens.llm.common import map_batches, texts, written

CACHE = 400_000
#: Latin letters of one script block, whose case folding and composition never depend on neighbours
_latin = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+\Z")
_marked = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,!?;:]+)\Z")


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself where printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


class WordIds(dict):
    """word (bytes without white space) -> its ids as little-endian unsigned 32-bit bytes.

    A word of Latin letters is one piece of the vocabulary's pattern, so its merges are asked
    of the model at once; marks at its end are a piece of their own; anything else goes
    through the whole tokenizer.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        if m := _marked.match(word):
            ids = self[m[1]] + self[m[2]]
        elif _latin.match(word):
            low = word.decode("utf-8").lower().encode("utf-8")
            if low != word:
                ids = self[low]
            else:
                ids = _packed(t.id for t in self.model.tokenize(low.decode("latin-1").translate(_LETTERS)))
        else:
            ids = _packed(self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids)
        if len(self) < CACHE and len(word) <= 64:
            self[word] = ids
        return ids


def _packed(ids) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array([*ids], "<u4").tobytes()


@lru_cache(maxsize=1)
def word_ids(vocabulary: str) -> WordIds:
    return WordIds(vocabulary)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every row; ``keep_ids`` adds the ids themselves (little-endian unsigned 32-bit)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ddl = PIECES + (", ids binary" if keep_ids else "")
    names = [x.split()[0] for x in ddl.split(", ")]
    end = np.array([end_id], "<u4").tobytes()

    def run(b):
        known = word_ids(vocabulary)
        out = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b.column("text"))):
            ids = b"".join(map(known.__getitem__, text.encode().split())) + end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[at:at + 4 * capacity]
                out.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)) + ((own,) if keep_ids else ()))
        if out:
            yield dict(zip(names, map(list, zip(*out))))

    return map_batches(rows, run, ddl)


def fullest(available: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """The (length, times) whose sum is largest within ``room``; available in descending lengths."""
    mask = (1 << room + 1) - 1
    reach, trail = 1, []
    for length, count in available:
        if length > room:
            continue
        k, left = 1, min(count, room // length)
        while left:  # binary splitting of the copies
            k = min(k, left)
            grown = (reach | reach << k * length) & mask
            trail.append((length, k, reach))
            reach = grown
            left -= k
            k *= 2
        if reach >> room:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(trail):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + k
            at -= k * length
    return sorted(taken.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Minimum bin slack over a histogram of lengths: (bins, [(length, times per bin), ...])."""
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        order = sorted(left.items(), reverse=True)
        largest = order[0][0]
        rest = [(n, c - (n == largest)) for n, c in order if c > (n == largest)]
        combo = dict(fullest(rest, capacity - largest))
        combo[largest] = combo.get(largest, 0) + 1
        bins = min(left[n] // k for n, k in combo.items())
        out.append((bins, sorted(combo.items(), reverse=True)))
        for n, k in combo.items():
            left[n] -= bins * k
            if not left[n]:
                del left[n]
    return out


def pack(pieces_: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces_`` with sequence_id and offset: no sequence over ``capacity``, no gap in one."""
    cut = written(pieces_, "pieces")
    per_length = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    if any(n > capacity for n in per_length):
        raise ValueError("a piece is longer than a sequence")
    # number the pieces of a length: position in a bounded block plus the pieces of earlier blocks
    blocks = max(1, -(-sum(per_length.values()) // 50_000))
    salted = cut.withColumn("__block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    before = (salted.groupBy("length", "__block").agg(F.count(F.lit(1)).alias("__n"))
              .withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__block")) - F.col("__n")).drop("__n"))
    own = Window.partitionBy("length", "__block").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (salted.withColumn("__own", F.row_number().over(own)).join(before, ["length", "__block"])
                .withColumn("__rank", F.col("__before") + F.col("__own") - 1).drop("__block", "__own", "__before"))
    # per length: where each run of bins starts in that numbering
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    first, used = 0, {}
    for bins, combo in plan(per_length, capacity):
        offset = 0
        for length, times in combo:
            start = used.get(length, 0)
            runs.setdefault(length, []).append((start, times, first, offset))
            used[length] = start + bins * times
            offset += length * times
        first += bins
    table = numbered.sparkSession.sparkContext.broadcast({n: np.array(r, np.int64) for n, r in runs.items()})
    names = cut.columns

    def place(batches):
        import pyarrow as pa
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("__rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                r = table.value[int(n)]
                row = r[np.searchsorted(r[:, 0], rank[at], side="right") - 1]
                sequence[at] = row[:, 2] + (rank[at] - row[:, 0]) // row[:, 1]
                offset[at] = row[:, 3] + (rank[at] - row[:, 0]) % row[:, 1] * n
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(sequence), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return numbered.select(*names, "__rank").mapInArrow(place, ddl + ", sequence_id long, offset long")
