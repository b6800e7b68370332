r"""Quality rules by line labelling: Viterbi decoding of a linear-chain CRF.

Every line with a word is content or boilerplate.  Its features are a few yes/no signs
(symbols, bars, capitals, length, closing mark, repetition ...); the chain's transition
weights carry a label on to the next line.  A document is kept when the share of its
word characters in content lines reaches ``min_content``; the base rules come first.

Training uses the documents that ``labels.quality`` judges, a sample bounded by
``max_train_docs`` documents in expectation (a share by hash of the id, from a count over
all labelled rows), whole documents only.  Line labels are not given, so they are made
in two steps: a logistic model of the lines on their document's judgement, then, in bad
documents, its boilerplate decisions as line labels for the CRF's maximum likelihood
(forward-backward, gradient ascent with a quadratic penalty).

Cases: null text has no words and fails the base rules; lines without a word are skipped;
a document without any line with a word has content share 0; with no good or no bad
labelled document there is nothing to learn and every line counts as content; a repeated
row gives its result again; whole texts are read; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revlens.llm.common import map_batches, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
_symbol = re.compile(r"[#*$%&|<>]")
SPACES = " \t\n\x0b\x0c\r"
CLOSING = (".", "!", "?", ":", ";", '"', "…", "。", "»", "”")

FEATURES = ("always", "one or two words", "three to seven words", "symbols per word over 0.2", "symbols per word over 0.6",
            "two bars", "capital words over half", "two double exclamation marks", "closing mark", "starts with a letter or digit",
            "digits over a fifth", "letters under half", "equals an earlier line", "mean word over 14", "mean word under 2.5", "web or mail address")


def line_words(line: str) -> list[str]:
    return WORD.findall(line)


def line_bits(line: str, words: list[str], earlier: bool) -> int:
    """The line's signs as bits, in the order of FEATURES."""
    n = len(words)
    body = line.strip(SPACES)
    chars = len(body) - n + 1
    symbols = len(_symbol.findall(body))
    capital = sum(map(str.isupper, words))
    digits = sum(map(body.count, "0123456789"))
    plain = sum(map(str.isalpha, words)) if n <= 3 else n
    signs = (True, n <= 2, 3 <= n <= 7, symbols > 0.2 * n, symbols > 0.6 * n, body.count("|") >= 2, 2 * capital > n,
             body.count("!!") >= 2, body.endswith(CLOSING), body[:1].isalnum(), 5 * digits > chars,
             plain == 0 or symbols + digits > 0.5 * chars, earlier, chars > 14 * n, chars < 2.5 * n,
             "http" in body or "www." in body or "@" in body)
    return sum(1 << i for i, s in enumerate(signs) if s)


def document_lines(text: str) -> list[tuple[int, int]]:
    """(bits, word characters) of each line with a word."""
    seen: set[str] = set()
    out = []
    for line in text.split("\n"):
        words = line_words(line)
        if words:
            out.append((line_bits(line, words, line in seen), sum(map(len, words))))
            seen.add(line)
    return out


def _matrix(bits: np.ndarray) -> np.ndarray:
    return ((bits[:, None] >> np.arange(len(FEATURES))) & 1).astype(float)


class Crf:
    """Labels 0 boilerplate and 1 content: emission weights per feature and label, and transitions."""

    def __init__(self):
        self.emit = np.zeros((len(FEATURES), 2))
        self.move = np.zeros((2, 2))
        self.known: dict[int, tuple[float, float]] = {}

    def scores(self, bits: int) -> tuple[float, float]:
        got = self.known.get(bits)
        if got is None:
            on = [i for i in range(len(FEATURES)) if bits >> i & 1]
            got = self.known[bits] = tuple(self.emit[on].sum(axis=0).tolist())
        return got

    def viterbi(self, lines: list[int]) -> list[int]:
        """Best label sequence; equal scores choose content."""
        (m00, m01), (m10, m11) = self.move.tolist()
        if not lines:
            return []
        a, b = self.scores(lines[0])
        back = []
        for bits in lines[1:]:
            s0, s1 = self.scores(bits)
            from0, from1 = b + m10 >= a + m00, b + m11 >= a + m01
            back.append((from0, from1))
            a, b = s0 + (b + m10 if from0 else a + m00), s1 + (b + m11 if from1 else a + m01)
        label = 1 if b >= a else 0
        out = [label]
        for step in reversed(back):
            label = 1 if step[label] else 0
            out.append(label)
        return out[::-1]

    def fit(self, docs: list[np.ndarray], gold: list[np.ndarray], rounds: int = 150, penalty: float = 1e-3, rate: float = 0.5) -> Crf:
        """Penalised maximum likelihood; all sequences advance together, one place at a time."""
        order = np.argsort([-len(d) for d in docs], kind="stable")
        docs, gold = [docs[i] for i in order], [gold[i] for i in order]
        sizes = np.array([len(d) for d in docs])
        longest, total = sizes[0], sizes.sum()
        active = [int((sizes > t).sum()) for t in range(longest)]
        x = [np.stack([d[t] for d in docs[:active[t]]]) for t in range(longest)]
        y = [np.array([g[t] for g in gold[:active[t]]]) for t in range(longest)]
        want_emit, want_move = np.zeros_like(self.emit), np.zeros_like(self.move)
        for t in range(longest):
            for k in (0, 1):
                want_emit[:, k] += x[t][y[t] == k].sum(axis=0)
            if t:
                np.add.at(want_move, (y[t - 1][:active[t]], y[t]), 1)
        speed_e, speed_m = np.zeros_like(self.emit), np.zeros_like(self.move)
        for _ in range(rounds):
            e = [xi @ self.emit for xi in x]
            fore = [e[0]]
            for t in range(1, longest):
                before = fore[-1][:active[t]]
                fore.append(e[t] + np.logaddexp(before[:, :1] + self.move[0], before[:, 1:] + self.move[1]))
            back: list[np.ndarray] = [np.zeros((0, 2))] * longest
            got_emit, got_move = np.zeros_like(self.emit), np.zeros_like(self.move)
            for t in range(longest - 1, -1, -1):
                back[t] = np.zeros((active[t], 2))
                if t + 1 < longest:
                    n = active[t + 1]
                    after = e[t + 1] + back[t + 1]
                    back[t][:n] = np.logaddexp(after[:, :1] + self.move[:, 0], after[:, 1:] + self.move[:, 1])
                post = fore[t] + back[t]
                z = np.logaddexp(post[:, 0], post[:, 1])[:, None]
                got_emit += x[t].T @ np.exp(post - z)
                if t + 1 < longest:
                    pair = fore[t][:n, :, None] + self.move + after[:, None, :]
                    got_move += np.exp(pair - z[:n, :, None]).sum(axis=0)
            speed_e = 0.9 * speed_e + (want_emit - got_emit) / total - penalty * self.emit
            speed_m = 0.9 * speed_m + (want_move - got_move) / total - penalty * self.move
            self.emit += rate * speed_e
            self.move += rate * speed_m
        return self


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = 4000) -> Crf:
    """The CRF of the judged documents; see the module for the sample's bound."""
    judged = (labels.select(F.col("doc_id").cast("long").alias("i"), F.col("quality").alias("q"))
              .where(F.col("q").isin(0, 1) & F.col("i").isNotNull()).groupBy("i").agg(F.max("q").alias("q")))
    n = judged.count()
    chosen = judged.where(F.pmod(F.xxhash64("i"), F.lit(1_000_000)) < 1_000_000 * min(1.0, max_train_docs / max(n, 1)))
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    sample = rows.join(F.broadcast(chosen), "i")  # about max_train_docs rows of (id, judgement)

    def run(b):
        yield {"q": b.column("q").to_pylist(), "i": b.column("i").to_pylist(),
               "bits": [[x for x, _ in document_lines(t)] for t in texts(b.column("text"))]}

    found = map_batches(sample.select(F.col("q").cast("long").alias("q"), "i", "text"), run, "q long, i long, bits array<int>")
    seqs = sorted((r["i"], r["q"], r["bits"]) for r in found.collect() if r["bits"])
    crf = Crf()
    if {q for _, q, _ in seqs} != {0, 1}:
        return crf
    x = [_matrix(np.array(b)) for _, _, b in seqs]
    every, judge = np.concatenate(x), np.concatenate([[q] * len(b) for _, q, b in seqs]).astype(float)
    weight = np.where(judge == 1, 0.5 / max(judge.sum(), 1), 0.5 / max((1 - judge).sum(), 1))
    w, speed = np.zeros(len(FEATURES)), np.zeros(len(FEATURES))
    for _ in range(300):
        p = 1 / (1 + np.exp(-every @ w))
        speed = 0.9 * speed + every.T @ (weight * (judge - p)) - 1e-3 * w
        w += 0.5 * speed
    gold = [np.ones(len(xi), int) if q == 1 else (xi @ w > 0).astype(int) for xi, (_, q, _) in zip(x, seqs)]
    return crf.fit(x, gold)


JUDGED = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, content_share double, line_labels string")


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def judge_text(crf: Crf, text: str, min_content: float) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, share, labels)."""
    words = WORD.findall(text)
    lines, seen, dups = [], set(), 0
    for line in text.split("\n"):
        own = line_words(line)
        if not own:
            continue
        again = line in seen
        dups += again
        seen.add(line)
        lines.append((line_bits(line, own, again), sum(map(len, own))))
    repeat = repeated_words(words)
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    marks = crf.viterbi([x for x, _ in lines])
    chars = sum(c for _, c in lines)
    share = sum(c for m, (_, c) in zip(marks, lines) if m) / chars if chars else 0.0
    return (len(words), chars, len(_symbol.findall(text)), dups, repeat, failed,
            not failed and share >= min_content, share, "".join("bc"[m] for m in marks))


def judge(docs: DataFrame, crf: Crf, min_content: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base rules, content share, line labels (b, c per line with a word) and verdict of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = [x.split()[0] for x in JUDGED.split(", ")]

    def run(b):
        found = [(i, *judge_text(crf, t, min_content)) for i, t in zip(b.column("doc_id").to_pylist(), texts(b.column("text")))]
        if found:
            yield dict(zip(names, map(list, zip(*found))))

    return map_batches(rows, run, JUDGED)


def drop_rejected(docs: DataFrame, crf: Crf, min_content: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the rules or the content share reject."""
    @F.arrow_udf("boolean")
    def keep(part: pa.Array) -> pa.Array:
        return pa.array([judge_text(crf, t, min_content)[6] for t in texts(part)], pa.bool_())

    return docs.where(keep(F.col(text_col).cast("string")))
