r"""LM scoring with an Elias-Fano n-gram trie.

A smoothed model of ``order`` 2 or 3: with c the training counts, N tokens, V distinct tokens,

    p1(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p2(w | v) = ((1 - b) c(v w) + (m + b c(v)) p1(w)) / (c(v) + m)
    p3(w | u v) = ((1 - b) c(u v w) + (m + b c(u v)) p2(w | v)) / (c(u v) + m)

which sum to one over the V tokens and one unknown.  A pair (triple) that was seen has its
log10 p2 (p3) quantised in the trie; an unseen one backs off to p1 (p2) with the context's
weight.  A text's first token has one token before it and stays with p2.
A text's tokens are its words and one end; its first word follows a begin mark.

The corpus does not pass through one place.  Texts become blocks of about
``block_tokens`` tokens over their own vocabulary.  1. Block vocabularies go to shards by word;
a shard numbers its words, sums their counts, and answers each block.  2. Blocks
send their pairs, each with the documents it is in, to shards by context (a context with
more than a quarter of a shard is dealt further by the word that follows).  A shard
counts its pairs over all blocks, builds the trie of its contexts (monotone pointers,
successors relative to their context, quantised probabilities) as flat bytes,
reads them in place, looks up all pairs by successor search and returns to each
block the sums of its documents (24 bits each).  3. At order 3 it returns the counts of the block's pairs too.
A block then sends its triples with a seen context, likewise, to shards by both words of the
context, with the counts of context, triple's pair and words; these shards build their level and return the
sums of log10 p3 - log10 p2.  So a text's pairs are scored where their contexts' level lies, and
memory per task depends on block and shard size only.

Cases: null text is empty (the end token alone); null ids are scored and never trained on; rows that
repeat an id are scored each; other columns are ignored; an empty table gives no rows; with no
training text N and V are 0 and every token scores log10 1 = 0 in the base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from revlens.llm.common import crc_fold, map_batches, pa_schema, written
from revlens.llm.elias_fano import Trie

BEGIN, END = b"\r", b"\n"  # no word holds white space


def tokens(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, byte planes apart."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
        head = np.array([len(a), len(planes)], np.int64).tobytes() + a.dtype.str.encode().ljust(8)
        out.append(head + planes)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def load(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 0
    while at < len(raw):
        n, size = np.frombuffer(raw, np.int64, 2, at).tolist()
        dtype = np.dtype(raw[at + 16:at + 24].decode().strip())
        planes = np.frombuffer(raw, np.uint8, size, at + 24)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).ravel() if n else np.zeros(0, dtype))
        at += 24 + size
    return out


SCORED = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
BLOCKS = "block long, doc_ids array<long>, flags binary, tokens binary, n_words int, words binary, counts binary"


PARTS = "block long, shard long, pairs binary, sums binary, base binary, doc_ids array<long>"


def _packed(words) -> bytes:
    """Words, which hold no blank, as compressed bytes."""
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def _unpacked(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b" ")


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    """Texts as blocks: ids, training flags, token numbers over the block's own words, words, training counts."""
    def run(batches):
        schema = pa_schema(BLOCKS)
        part, no = TaskContext.get().partitionId(), 0
        state: list = []

        def start():
            state[:] = [[], [], [], _Numbers({BEGIN: 0, END: 1}), 0]

        def close():
            nonlocal no
            ids, train, parts, numbers, _ = state
            sizes = np.array([len(p) for p in parts], np.int64)
            flat = np.concatenate(parts)
            fit = np.repeat(np.array(train, bool), sizes)
            counts = np.bincount(flat[fit], minlength=len(numbers))
            counts[0] = sum(train)
            batch = pa.RecordBatch.from_pydict(
                {"block": [part << 32 | no], "doc_ids": [ids], "flags": [dump(np.array(train, np.uint8), sizes)], "tokens": [dump(flat)],
                 "n_words": [len(numbers)], "words": [_packed(numbers)], "counts": [dump(counts)]}, schema=schema)
            no += 1
            start()
            return batch

        start()
        for b in batches:
            for doc_id, train, text in zip(b.column("doc_id").to_pylist(), b.column("train").to_pylist(), (v.as_py() for v in b.column("text"))):
                number = state[3].__getitem__
                own = np.fromiter(map(number, tokens(text)), np.int32)
                state[0].append(doc_id)
                state[1].append(train)
                state[2].append(np.append(own, np.int32(1)))
                state[4] += len(own) + 1
                if state[4] >= block_tokens:
                    yield close()
        if state[0]:
            yield close()

    return docs.mapInArrow(run, BLOCKS)


def _groups(batches, key: str, rest: list[str]) -> Iterator[tuple[object, list[tuple]]]:
    """Rows of sorted batches, one list per value of ``key``."""
    at, held = None, []
    for b in batches:
        columns = [b.column(c) for c in (key, *rest)]
        for i in range(b.num_rows):  # one row's bytes at a time
            row = tuple(c[i].as_py() for c in columns)
            if held and row[0] != at:
                yield at, held
                held = []
            at = row[0]
            held.append(row[1:])
    if held:
        yield at, held


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _sorted_columns(*columns: np.ndarray) -> list[np.ndarray]:
    """Rows of non-negative columns in ascending order; in one sort where their bits fit one number."""
    widths = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(widths) > 63:
        order = np.lexsort(columns[::-1])
        return [c[order] for c in columns]
    key = np.zeros(len(columns[0]), np.int64)
    for c, width in zip(columns, widths):
        key = key << width | c
    key.sort()
    out = []
    for width in reversed(widths):
        out.append(key & ((1 << width) - 1))
        key >>= width
    return out[::-1]


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in ascending order, and the place of every key among them."""
    order = np.argsort(keys, kind="stable").astype(np.int32)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    back = np.empty(len(keys), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], back


def _drop_shard(keys: np.ndarray, words: int) -> np.ndarray:
    """(context, word) of keys ((shard, context), word) over so many words."""
    return keys // words % words * words + keys % words


def _by_id(ids: np.ndarray, counts: np.ndarray, token: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """A block's words in ascending order of their ids, its tokens numbered by that order."""
    order = np.argsort(ids)
    rank = np.empty(len(ids), np.int32)
    rank[order] = np.arange(len(ids), dtype=np.int32)
    return [ids[order], counts[order], rank[token], rank[before]]


def number_words(found: DataFrame, shards: int) -> DataFrame:
    """(block, ids, counts) per block and word shard, and per shard its N and V (block null).

    A word's id is its place in its shard times ``shards`` plus the shard; ids and counts
    come in the order in which the block sent the shard's words.
    """
    import xxhash

    def send(b):
        for block, words, counts in zip(b.column("block").to_pylist(), b.column("words").to_pylist(), b.column("counts").to_pylist()):
            n, words = load(counts)[0], _unpacked(words)
            shard = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                yield {"shard": [int(shard[at[0]])], "block": [block], "words": [_packed(map(words.__getitem__, at.tolist()))],
                       "places": [dump(np.diff(at, prepend=0).astype(np.int32))], "counts": [dump(n[at])]}

    def count(batches):
        schema = pa_schema("block long, places binary, ids binary, counts binary, n long, v long")
        for s, rows in _groups(batches, "shard", ["block", "words", "places", "counts"]):
            number = _Numbers()
            lists = [np.fromiter(map(number.__getitem__, _unpacked(w)), np.int64) for _, w, _, _ in rows]
            total = np.zeros(len(number), np.int64)
            for ids, (_, _, _, c) in zip(lists, rows):
                total[ids] += load(c)[0]
            begin = number.get(BEGIN)
            n = int(total.sum()) - (int(total[begin]) if begin is not None else 0)
            v = int((total > 0).sum()) - (1 if begin is not None and total[begin] else 0)
            yield pa.RecordBatch.from_pydict({"block": [None] + [r[0] for r in rows], "places": [None] + [r[2] for r in rows],
                                              "ids": [None] + [dump(ids * shards + s) for ids in lists],
                                              "counts": [None] + [dump(total[ids]) for ids in lists],
                                              "n": [n] + [None] * len(rows), "v": [v] + [None] * len(rows)}, schema=schema)

    sent = map_batches(found.select("block", "words", "counts"), send, "shard long, block long, words binary, places binary, counts binary")
    sent = sent.repartition(shards, "shard").sortWithinPartitions("shard", "block")
    return sent.mapInArrow(count, "block long, places binary, ids binary, counts binary, n long, v long")


def _deal(a: np.ndarray, b: np.ndarray, fan: np.ndarray, shards: int) -> np.ndarray:
    """Shards of contexts ``a``, each dealt further to ``fan`` of them by the word ``b``."""
    return (_mix(a.astype(np.uint64) * np.uint64(2654435761) + b.astype(np.uint64) % fan.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _whole(part: list[tuple]) -> tuple:
    """A block from its rows: ids of its documents, training flags, sizes, tokens, ids and counts of its words, document and token before of each token."""
    doc_ids, flags, toks, n_words = next(r[:4] for r in part if r[0] is not None)
    train, sizes = load(flags)
    token = load(toks)[0]
    ids, counts = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
    for r in part:
        if r[4] is not None:
            at = np.cumsum(load(r[4])[0])
            ids[at], counts[at] = load(r[5])[0], load(r[6])[0]
    before = np.concatenate((np.zeros(1, token.dtype), token[:-1]))
    before[np.cumsum(sizes) - sizes] = 0
    return doc_ids, train, sizes, token, ids, counts, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), before


def _trained(times: np.ndarray, d: np.ndarray, train: np.ndarray) -> np.ndarray:
    """How often each n-gram of a message occurs in training documents."""
    upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(train[d], dtype=np.int64)))
    stop = np.cumsum(times)
    return upto[stop] - upto[stop - times]


def _sums(value: np.ndarray, times: np.ndarray, d: np.ndarray, n_docs: int) -> bytes:
    """The values of a message's n-grams added up by document, rounded to 24 bits."""
    sums = np.bincount(d, weights=np.repeat(value, times), minlength=n_docs)
    at = np.flatnonzero(np.bincount(d, minlength=n_docs))
    return dump(np.diff(at, prepend=0).astype(np.int32), sums[at].astype(np.float32))


def scores(docs: DataFrame, train: str = "train", b: float = 0.7, m: float = 1.0, block_tokens: int = 2_000_000,
           shard_tokens: int = 1_500_000, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``train`` names the boolean column of the rows to learn from.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"),
                       (F.coalesce(F.col(train), F.lit(False)) & F.col(id_col).isNotNull()).alias("train"))
    found = written(blocks(rows, block_tokens), "lm-blocks")
    shards = max(1, found.count() * block_tokens // shard_tokens)
    if shards * block_tokens**2 >= 2**63:
        raise ValueError("so many shards need a larger shard_tokens: n-grams of a block are sorted by 63-bit keys")
    numbered = written(number_words(found, shards), "lm-words")
    total = numbered.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_all, v_all = total["n"] or 0, total["v"] or 0
    below = n_all + 0.5 * (v_all + 1)
    hot = max(1, shard_tokens // 4)

    def weight(c):
        return (m + b * c) / (c + m)

    def send(batches):
        for block, part in _groups(batches, "block", ["doc_ids", "flags", "tokens", "n_words", "places", "ids", "counts"]):
            yield from send_block(block, part)

    def send_block(block, part):
        schema = pa_schema("shard long, block long, message binary, base binary, doc_ids array<long>")
        doc_ids, train_, sizes, token, ids, counts, doc, before = _whole(part)
        base = np.bincount(doc, weights=np.log10((counts + 0.5) / below)[token], minlength=len(sizes))
        known = np.bincount(doc, weights=(counts > 0)[token], minlength=len(sizes)).astype(np.int64)
        # pairs in ascending (context, word, document)
        ids, counts, w, v = _by_id(ids, counts, token, before)
        del token, before
        shard = _deal(ids[v], ids[w], (1 + counts // hot)[v], shards).astype(np.int32)
        shard, v, w, doc = _sorted_columns(shard, v, w, doc)
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        del shard
        home = int(_mix(np.array([block], np.uint64))[0] % np.uint64(shards))
        for s in range(shards):
            lo, hi = cuts[s], cuts[s + 1]
            if lo == hi and s != home:
                continue
            a, c, d = v[lo:hi], w[lo:hi], doc[lo:hi]
            new = np.ones(hi - lo, bool)
            new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            at = np.flatnonzero(new)
            used = np.unique(np.concatenate((a[at], c[at])))
            message = dump(np.diff(ids[used], prepend=0), counts[used], np.diff(np.searchsorted(used, a[at]), prepend=0).astype(np.int32),
                           np.searchsorted(used, c[at]).astype(np.int32), np.diff(at, append=hi - lo).astype(np.int32), d, train_)
            held = s == home
            yield pa.RecordBatch.from_pydict({"shard": [s], "block": [block], "message": [message], "base": [dump(sizes, known, base) if held else None],
                                              "doc_ids": [doc_ids if held else None]}, schema=schema)

    def score(batches):
        for s, rows_ in _groups(batches, "shard", ["block", "message", "base", "doc_ids"]):
            yield from score_shard(s, rows_)

    def score_shard(s, rows_):
        schema = pa_schema(PARTS)
        got = []
        for _, message, *_ in rows_:
            ids, n, a, c, times, d, train_ = load(message)
            got.append((np.cumsum(ids), n, np.cumsum(a, dtype=np.int32), c, times, d, train_))
        words = np.unique(np.concatenate([g[0] for g in got]))
        counts = np.zeros(len(words), np.int64)
        keys, weights, rest = [], [], []
        while got:
            ids, n, a, c, times, d, train_ = got.pop(0)
            local = np.searchsorted(words, ids)
            counts[local] = n
            keys.append(local[a] * len(words) + local[c])
            weights.append(_trained(times, d, train_))
            rest.append((times, d, len(train_)))
        keys = np.concatenate(keys)
        every, back = _numbered(keys)
        del keys
        seen = np.bincount(back, weights=np.concatenate(weights), minlength=len(every))
        del weights
        v, w = (x.astype(np.int32) for x in np.divmod(every, max(len(words), 1)))
        del every
        p1 = (counts + 0.5) / below
        on = np.flatnonzero(seen > 0)
        p2 = ((1 - b) * seen[on] + (m + b * counts[v[on]]) * p1[w[on]]) / (counts[v[on]] + m)
        level = Trie.build(words[v[on]], words[w[on]], np.log10(p2), int(words[-1]) + 1 if len(words) else 1).to_bytes()
        del on, p2
        value, known = Trie.from_buffer(np.frombuffer(level, np.uint8)).lookup(words, v, w)
        value = np.where(known, value, np.log10(weight(counts))[v] + np.log10(p1)[w])
        del v, w, known, level
        at = 0
        for (block, _, base, doc_ids), (times, d, n_docs) in zip(rows_, rest):
            own = back[at:at + len(times)]
            at += len(times)
            yield pa.RecordBatch.from_pydict({"block": [block], "shard": [s], "pairs": [dump(seen[own].astype(np.int64)) if order > 2 else None],
                                              "sums": [_sums(value[own], times, d, n_docs)], "base": [base], "doc_ids": [doc_ids]}, schema=schema)

    def send_triples(batches):
        for block, part in _groups(batches, "block", ["doc_ids", "flags", "tokens", "n_words", "places", "ids", "counts", "shard", "pairs"]):
            yield from send_block_triples(block, part)

    def send_block_triples(block, part):
        schema = pa_schema("shard long, block long, message binary")
        _, train_, sizes, token, ids, counts, doc, before = _whole(part)
        ids, counts, token, before = _by_id(ids, counts, token, before)
        # counts of the pairs, in the order in which they went out
        key = _deal(ids[before], ids[token], (1 + counts // hot)[before], shards)
        for x in (before, token):
            key *= len(ids)
            key += x
        sent_keys, pair = _numbered(key)
        del key
        told = np.concatenate([load(r[8])[0] for r in sorted((r for r in part if r[8] is not None), key=lambda r: r[7])])
        inner = np.ones(len(token), bool)
        inner[np.cumsum(sizes) - sizes] = False  # a text's first token has no context of two
        inner[1:] &= told[pair[:-1]] > 0
        on = np.flatnonzero(inner).astype(np.int32)
        del inner
        # contexts of two in ascending order of their words
        context_of = np.argsort(_drop_shard(sent_keys, len(ids)), kind="stable")
        place = np.empty(len(told), np.int32)
        place[context_of] = np.arange(len(told), dtype=np.int32)
        u, v, w, doc, head, n = before[on - 1], before[on], token[on], doc[on], place[pair[on - 1]], told[pair[on]]
        context = told[pair[on - 1]]
        del token, before, pair, on, told, place, context_of, sent_keys
        shard = _deal(_mix(ids[u].astype(np.uint64)) ^ ids[v].astype(np.uint64), ids[w], 1 + context // hot, shards)
        key = (shard * (int(head.max(initial=0)) + 1) + head) * len(ids) + w
        sort = np.argsort(key, kind="stable").astype(np.int32)  # documents of a triple stay in ascending order
        key = key[sort]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        del key
        cuts = np.searchsorted(shard[sort], np.arange(shards + 1))
        doc = doc[sort]
        first = sort[new]
        start = np.flatnonzero(new)
        del sort, new
        u, v, w, context, n, head, shard = u[first], v[first], w[first], context[first], n[first], head[first], shard[first]
        turn = np.ones(len(head), bool)  # where a context begins
        turn[1:] = (head[1:] != head[:-1]) | (shard[1:] != shard[:-1])
        del head, shard, first
        for s in range(shards):
            lo, hi = cuts[s], cuts[s + 1]
            if lo == hi:
                continue
            i, j = np.searchsorted(start, (lo, hi))
            own = np.flatnonzero(turn[i:j])
            a, c, d = u[i:j][own], v[i:j][own], w[i:j]
            used = np.unique(np.concatenate((a, c, d)))
            message = dump(np.diff(ids[used], prepend=0), counts[used], np.diff(np.searchsorted(used, a), prepend=0).astype(np.int32),
                           np.searchsorted(used, c).astype(np.int32), context[i:j][own], np.diff(own, append=j - i).astype(np.int32),
                           np.searchsorted(used, d).astype(np.int32), n[i:j], np.diff(start[i:j], append=hi).astype(np.int32), doc[lo:hi], train_)
            yield pa.RecordBatch.from_pydict({"shard": [s], "block": [block], "message": [message]}, schema=schema)

    def score_triples(batches):
        for s, rows_ in _groups(batches, "shard", ["block", "message"]):
            yield from score_shard_triples(s, rows_)

    def score_shard_triples(s, rows_):
        schema = pa_schema(PARTS)
        got = [load(message) for _, message in rows_]
        got = [(np.cumsum(g[0]), *g[1:]) for g in got]
        words = np.unique(np.concatenate([g[0] for g in got]))
        p1 = np.zeros(len(words))
        columns, weights, rest = [[] for _ in range(5)], [], []
        while got:
            ids, counts, u, v, context, fan, w, n, times, d, train_ = got.pop(0)
            local = np.searchsorted(words, ids).astype(np.int32)
            p1[local] = (counts + 0.5) / below
            at_v = np.repeat(counts[v], fan)
            p2 = ((1 - b) * n + (m + b * at_v) * p1[local[w]]) / (at_v + m)
            for column, x in zip(columns, (np.repeat(local[np.cumsum(u)], fan), np.repeat(local[v], fan), local[w], np.repeat(context, fan), p2)):
                column.append(x)
            weights.append(_trained(times, d, train_))
            rest.append((times, d, len(train_)))
        u, v, w, context, p2 = map(np.concatenate, columns)
        columns.clear()
        heads, head = _numbered(u * np.int64(len(words)) + v)
        n_heads = len(heads)
        del u, v, heads
        every, back = _numbered(head * np.int64(len(words)) + w)
        del head, w
        one = np.empty(len(every), np.int32)
        one[back] = np.arange(len(back), dtype=np.int32)
        seen = np.bincount(back, weights=np.concatenate(weights), minlength=len(every))
        del weights
        context, p2 = context[one].astype(np.float64), p2[one]
        head, w = (x.astype(np.int32) for x in np.divmod(every, max(len(words), 1)))
        del one, every
        on = np.flatnonzero(seen > 0)
        p3 = ((1 - b) * seen[on] + (m + b * context[on]) * p2[on]) / (context[on] + m)
        numbers = np.arange(max(n_heads, len(words)))
        level = Trie.build(head[on], w[on], np.log10(p3), len(numbers)).to_bytes()
        del on, p3, seen
        value, known = Trie.from_buffer(np.frombuffer(level, np.uint8)).lookup(numbers, head, w)
        more = np.where(known, value - np.log10(p2), np.log10(weight(context)))
        del value, known, context, p2, head, w, level
        at = 0
        for (block, _), (times, d, n_docs) in zip(rows_, rest):
            own = back[at:at + len(times)]
            at += len(times)
            yield pa.RecordBatch.from_pydict({"block": [block], "shard": [s], "pairs": [None], "sums": [_sums(more[own], times, d, n_docs)], "base": [None],
                                              "doc_ids": [None]}, schema=schema)

    def total_up(batches):
        schema = pa_schema(SCORED)
        for _, parts_ in _groups(batches, "block", ["sums", "base", "doc_ids"]):
            base, doc_ids = next(r[1:] for r in parts_ if r[1] is not None)
            n_tokens, n_known, base_score = load(base)
            score_ = np.zeros(len(n_tokens))
            for sums, _, _ in parts_:
                steps, values = load(sums)
                score_[np.cumsum(steps)] += values
            yield pa.RecordBatch.from_pydict({"doc_id": doc_ids, "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(len(n_tokens), n_all),
                                              "base_score": base_score, "score": score_}, schema=schema)

    side = numbered.where("block IS NOT NULL").select("block", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("doc_ids", "array<bigint>"), ("flags", "binary"), ("tokens", "binary"), ("n_words", "int"))], "places", "ids", "counts")
    whole = found.select("block", "doc_ids", "flags", "tokens", "n_words", *[F.lit(None).cast("binary").alias(c) for c in ("places", "ids", "counts")])
    meet = whole.unionByName(side).repartition("block").sortWithinPartitions("block")
    sent = meet.mapInArrow(send, "shard long, block long, message binary, base binary, doc_ids array<long>")
    sent = sent.repartition(shards, "shard").sortWithinPartitions("shard", "block")
    parts = sent.mapInArrow(score, PARTS)
    if order > 2:
        parts = written(parts, "lm-pairs")
        told = whole.unionByName(side).unionByName(parts.where("pairs IS NOT NULL").select("block", "shard", "pairs"), allowMissingColumns=True)
        sent = told.repartition("block").sortWithinPartitions("block").mapInArrow(send_triples, "shard long, block long, message binary")
        sent = sent.repartition(shards, "shard").sortWithinPartitions("shard", "block")
        parts = parts.unionByName(written(sent.mapInArrow(score_triples, PARTS), "lm-triples"))
    parts = parts.select("block", "sums", "base", "doc_ids")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(total_up, SCORED)


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Whether crc32(id as text) mod ``folds`` is 1; a null id is not held out."""
    return F.coalesce(crc_fold(id_col, folds) == 1, F.lit(False))
