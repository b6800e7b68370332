"""Elias-Fano sequences and a two-level n-gram trie in flat buffers.

A non-decreasing sequence of n numbers below u keeps the low log2(u / n) bits of each,
packed, and the rest in unary in a bit vector: about 2 + log2(u / n) bits a number.
Everything is read in place from its bytes, so a level can be a memory-mapped file.
Lookups take whole arrays of queries; an array about as long as the sequence first spells
out the unary part once (a few bytes a number), a short one finds its places by samples.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 16
U64 = np.uint64


def _windows(data: np.ndarray) -> np.ndarray:
    """The 64-bit little-endian words that start at each byte of ``data``."""
    return np.ndarray((len(data) - 8,), "<u8", data, strides=(1,))


def _bits_at(data: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """At least 57 bits from each bit offset on."""
    return _windows(data)[bit >> 3] >> (bit & 7).astype(U64)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits of each value, one after the other, and 16 bytes of padding."""
    out = np.zeros((len(values) * width + 63) // 64 + 2, U64)
    if width and len(values):
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(U64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] |= np.bitwise_or.reduceat(values << shift, first)
        over = np.flatnonzero(shift.astype(np.int64) + width > 64)
        out[word[over] + 1] |= values[over] >> (U64(64) - shift[over])
    return out.view(np.uint8)


class EliasFano:
    """A non-decreasing sequence; ``successor`` finds the first place of a value not below x."""

    def __init__(self, n: int, universe: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.width, self.low, self.high, self.samples = n, universe, width, low, high, samples
        self._spelled: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(U64)
        n = len(values)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = _packed(values & U64((1 << width) - 1), width)
        top = (values >> U64(width)).astype(np.int64)
        buckets = (universe >> width) + 1
        ones = np.zeros(n + buckets + 1, np.uint8)
        ones[top + np.arange(n)] = 1
        zeros = np.flatnonzero(ones == 0)
        high = np.concatenate((np.packbits(ones, bitorder="little"), np.zeros(16, np.uint8)))
        return cls(n, universe, width, low, high, zeros[::SAMPLE].astype(np.int64))

    def _spell(self, queries: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(values before each zero, high part of each value), for as many queries as pay for it."""
        buckets = (self.universe >> self.width) + 1
        if self._spelled is None and queries * 4 > self.n + buckets:
            bits = np.unpackbits(self.high, count=self.n + buckets, bitorder="little")
            zeros, ones = np.flatnonzero(bits == 0), np.flatnonzero(bits)
            self._spelled = (zeros - np.arange(len(zeros))).astype(np.int32), (ones - np.arange(len(ones))).astype(np.int64)
        return self._spelled

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero (from 0) in the high bits."""
        at = self.samples[k // SAMPLE].copy()
        left = k % SAMPLE
        todo = np.arange(len(k))
        while len(todo):
            # the zeros of the next 57 bits; the lowest is the zero at ``at`` itself or the first after it
            bits = ~_bits_at(self.high, at[todo]) & U64((1 << 57) - 1)
            need = left[todo]
            have = np.bitwise_count(bits).astype(np.int64)
            inside = have > need
            x, r = bits[inside], need[inside]
            for step in range(int(r.max(initial=0))):
                x = np.where(r > step, x & (x - U64(1)), x)
            at[todo[inside]] += np.bitwise_count((x & (~x + U64(1))) - U64(1)).astype(np.int64)
            rest = todo[~inside]
            left[rest] -= have[~inside]
            at[rest] += 57
            todo = rest
        return at

    def _one_before(self, i: np.ndarray) -> np.ndarray:
        """High part of the i-th value: zeros before its one, by bisection over the sampled zeros."""
        # place of the i-th one p satisfies p = i + high part; zeros[k] - k ones stand before zero k
        lo = np.searchsorted(self.samples - np.arange(len(self.samples)) * SAMPLE, i, side="right") - 1
        high = np.maximum(lo, 0) * SAMPLE
        todo = np.arange(len(i))
        while len(todo):
            k = high[todo]
            go = (k < (self.universe >> self.width) + 1) & (self._zero(k) - k <= i[todo])
            todo = todo[go]
            high[todo] += 1
        return high

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``."""
        i = np.asarray(i, np.int64)
        spelled = self._spell(len(i))
        return ((spelled[1][i] if spelled else self._one_before(i)).astype(U64) << U64(self.width)) | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U64)
        return _bits_at(self.low, i * self.width) & U64((1 << self.width) - 1)

    def successor(self, x: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value >= x inside x's bucket, whether the value there equals x), among places lo to hi - 1."""
        x = np.minimum(x.astype(U64), U64(self.universe))
        h = (x >> U64(self.width)).astype(np.int64)
        want = x & U64((1 << self.width) - 1)
        spelled = self._spell(len(x))
        begin = np.zeros(len(x), np.int64)
        later = h > 0
        if spelled:
            begin[later] = spelled[0][h[later] - 1]
            end = spelled[0][h].astype(np.int64)
        else:
            begin[later] = self._zero(h[later] - 1) - (h[later] - 1)
            end = self._zero(h) - h
        begin = np.maximum(begin, lo)
        if hi is not None:
            end = np.minimum(end, hi)
        found = np.zeros(len(x), bool)
        todo = np.flatnonzero(begin < end)
        while len(todo):
            low = self._low(begin[todo])
            found[todo[low == want[todo]]] = True
            todo = todo[low < want[todo]]
            begin[todo] += 1
            todo = todo[begin[todo] < end[todo]]
        return begin, found

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.universe, self.width], np.int64), self.low, self.high, self.samples]

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> EliasFano:
        n, universe, width = parts[0].view(np.int64).tolist()
        return cls(n, universe, width, parts[1], parts[2], parts[3].view(np.int64))


STEP = 1 / 1024


def quantise(log10: np.ndarray) -> np.ndarray:
    """log10 probabilities (0 to -63.99) in steps of STEP, 16 bits."""
    return np.clip(np.rint(-log10 / STEP), 0, 65535).astype(np.uint16)


class Trie:
    """Contexts, monotone pointers to their successors, successors relative to their context, and quantised probabilities.

    heads      context words, ascending
    names      words that follow some context, ascending
    starts     place of each context's first successor, and the end
    followers  name rank of each successor, counted on from the last one of the context before
    codes      quantised log10 probability of each follower

    A context's successors lie between its two pointers; what the value before the first
    says is taken off, so a search needs the pointers and stays inside its context.
    """

    def __init__(self, heads: EliasFano, names: EliasFano, starts: EliasFano, followers: EliasFano, codes: np.ndarray):
        self.heads, self.names, self.starts, self.followers, self.codes = heads, names, starts, followers, codes

    @classmethod
    def build(cls, v: np.ndarray, w: np.ndarray, log10: np.ndarray, universe: int) -> Trie:
        """From distinct pairs in ascending (v, w) order."""
        heads, counts = np.unique(v, return_counts=True)
        names, rank = np.unique(w, return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(counts)))
        last = rank[starts[1:] - 1] + 1
        keys = rank + np.repeat(np.cumsum(last) - last, counts)
        return cls(EliasFano.build(heads, universe), EliasFano.build(names, universe), EliasFano.build(starts, len(v) + 1),
                   EliasFano.build(keys, int(last.sum()) + 1), quantise(log10))

    def _ranges(self, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place, end, what to add to a name's rank) of contexts by their rank."""
        lo, hi = self.starts.access(heads).astype(np.int64), self.starts.access(heads + 1).astype(np.int64)
        base = np.zeros(len(heads), np.int64)
        later = lo > 0
        base[later] = self.followers.access(lo[later] - 1).astype(np.int64) + 1
        return lo, hi, base

    def lookup(self, words: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, whether the pair is in the trie) of the pairs (words[v], words[w])."""
        out, known = np.zeros(len(v)), np.zeros(len(v), bool)
        if not self.heads.n:
            return out, known
        head, a = self.heads.successor(words)
        name, b = self.names.successor(words)
        lo, hi, base = (np.zeros(len(words), np.int64) for _ in range(3))
        lo[a], hi[a], base[a] = self._ranges(head[a])
        on = np.flatnonzero(a[v] & b[w])
        at = v[on]
        place, there = self.followers.successor(base[at] + name[w[on]], lo[at], hi[at])
        on, place = on[there], place[there]
        known[on] = True
        out[on] = self.codes[place] * -STEP
        return out, known

    def successors(self, v: int) -> tuple[np.ndarray, np.ndarray]:
        """Words that follow ``v`` and their log10 probabilities."""
        head, there = self.heads.successor(np.array([v]))
        if not there[0]:
            return np.zeros(0, np.int64), np.zeros(0)
        (lo,), (hi,), (base,) = self._ranges(head)
        places = np.arange(lo, hi)
        ranks = self.followers.access(places).astype(np.int64) - base
        return self.names.access(ranks).astype(np.int64), self.codes[places] * -STEP

    def to_bytes(self) -> bytes:
        parts = [p for s in (self.heads, self.names, self.starts, self.followers) for p in s.parts()] + [self.codes]
        raw = [p.tobytes() for p in parts]
        raw = [r + b"\0" * (-len(r) % 8) for r in raw]
        return struct.pack(f"<{len(raw) + 1}q", len(self.codes), *map(len, raw)) + b"".join(raw)

    @classmethod
    def from_buffer(cls, data: np.ndarray) -> Trie:
        """A view of the bytes (an array over bytes, or ``np.memmap`` of a file); nothing is copied."""
        n, *sizes = data[:18 * 8].view(np.int64).tolist()
        ends = (18 * 8 + np.cumsum(sizes)).tolist()
        parts = [data[e - s:e] for s, e in zip(sizes, ends)]
        return cls(*[EliasFano.of(parts[4 * i:4 * i + 4]) for i in range(4)], parts[16].view(np.uint16)[:n])


def open_trie(path: str) -> Trie:
    """A trie whose levels stay in the memory-mapped file."""
    return Trie.from_buffer(np.memmap(path, np.uint8, "r"))
