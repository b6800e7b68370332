r"""Language identification by language-bitmask n-gram filters.

Every language has the set of character n-grams (of a word with an edge mark on either
side) that at least ``min_share`` of its training documents hold.  The sets go into one
bit-sliced Bloom filter: a slot holds one bit per language, and the AND of an n-gram's
slots is the bitmask of all languages that (may) contain it.  A text's masks are
popcounted per language; counts are corrected for each language's false-positive rate
(its fill to the power of the probes) and the largest share of the text's n-grams wins.

Training rows are a sample bounded by ``max_train_docs`` documents per language in
expectation (a share by hash of the text, from counts over all rows); prediction covers
every row and whole texts.

Cases: null text or text without a letter is ``und`` with score 0, and so is any text
when there is nothing to learn from; a text whose n-grams no language holds gets the
first language in name order with score 0; ties go to the first language in name order;
rows with a null id are predicted but never learned from; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from revlens.llm.common import crc_fold, map_batches, texts

RUNS = re.compile(r"[^\W\d_]+")
#: Characters of such runs that are no letters: superscripts, fractions, circled and letter numbers (planes 0 and 1 hold all).
NUMBERS = "".join(c for c in map(chr, range(0x80, 0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
LETTERS = re.compile(rf"[^\W\d_{NUMBERS}]+")


def letter_words(text: str) -> Counter:
    """How often each run of letters occurs; the costly pattern only takes apart the few runs with other signs."""
    runs = Counter(RUNS.findall(text))
    for run in [r for r in runs if not r.isalpha()]:
        times = runs.pop(run)
        for word in LETTERS.findall(run):
            runs[word] += times
    return runs


def ngrams(word: str, size: int) -> set[str]:
    """n-grams of the word between edge marks; a shorter one is its own n-gram."""
    w = f"\x02{word}\x03"
    return {w[i:i + size] for i in range(max(1, len(w) - size + 1))}


class Masks:
    """Bit-sliced Bloom filter: slots x words of 64 languages."""

    def __init__(self, langs: list[str], slots: int, probes: int, size: int):
        self.langs, self.probes, self.size = langs, probes, size
        self.bits = np.zeros((slots, (len(langs) + 63) // 64), dtype=np.uint64)
        self.rate = np.zeros(len(langs))

    def _places(self, gram: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(gram)
        a, b = h & (2**64 - 1), (h >> 64) | 1
        return [((a + k * b) & (2**64 - 1)) % len(self.bits) for k in range(self.probes)]

    def add(self, gram: str, lang: int) -> None:
        self.bits[self._places(gram), lang // 64] |= np.uint64(1 << (lang % 64))

    def close(self) -> Masks:
        """False-positive rates, once all n-grams are in."""
        for i in range(len(self.langs)):
            fill = float(((self.bits[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean())
            self.rate[i] = fill ** self.probes
        return self

    def languages(self, gram: str) -> list[int]:
        """Numbers of all languages that contain the n-gram."""
        both = np.bitwise_and.reduce(self.bits[self._places(gram)], axis=0)
        return [64 * w + k for w, x in enumerate(both.tolist()) for k in range(64) if x >> k & 1]


#: Words and n-grams a task remembers; later ones are worked out each time.
CACHE = 50_000
#: Bits of a language's counter in a packed count.
FIELD = 40


class GramMasks(dict):
    """n-gram -> its language bitmask spread to one counter field per language, remembered."""

    def __init__(self, masks: Masks):
        self.masks = masks

    def __missing__(self, gram: str) -> int:
        got = sum(1 << FIELD * lang for lang in self.masks.languages(gram))
        if len(self) < CACHE:
            self[gram] = got
        return got


class WordMasks(dict):
    """word -> (n-grams, packed popcounts), remembered."""

    def __init__(self, masks: Masks):
        self.size, self.grams = masks.size, GramMasks(masks)

    def __missing__(self, word: str) -> tuple[int, int]:
        grams = ngrams(word, self.size)
        got = len(grams), sum(map(self.grams.__getitem__, grams))
        if len(self) < CACHE:
            self[word] = got
        return got


class Predictor:
    def __init__(self, masks: Masks):
        self.masks, self.words = masks, WordMasks(masks)

    def __call__(self, text: str) -> tuple[str, float]:
        words = letter_words(text.lower())
        langs = self.masks.langs
        if not words or not langs:
            return "und", 0.0
        n = packed = 0
        for word, times in words.items():
            grams, own = self.words[word]
            n += times * grams
            packed += times * own
        hits = np.array([packed >> FIELD * k & (1 << FIELD) - 1 for k in range(len(langs))])
        share = np.clip((hits / n - self.masks.rate) / np.maximum(1 - self.masks.rate, 1e-9), 0, 1)
        best = int(share.argmax())
        return langs[best], float(share[best])


def train(docs: DataFrame, max_train_docs: int = 2000, min_share: float = 0.02, size: int = 4,
          slots: int = 1 << 19, probes: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Masks:
    """Filters from the rows whose crc32(id) mod 3 is not 1 and whose lang and text are not null.

    What reaches the driver is bounded: a language has at most (n-grams of a mean
    document) / ``min_share`` n-grams that so large a share of its documents holds.
    """
    rows = (docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
            .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold("i", 3) != 1)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Masks([], 1, 1, size)
    share = F.create_map(*[F.lit(x) for la, n in counts.items() for x in (la, min(1.0, max_train_docs / n))])
    spot = F.pmod(F.xxhash64("text", "i"), F.lit(1_000_000)) / 1_000_000.0
    sample = rows.where(spot < share[F.col("lang")]).select("text", "lang")

    def count(batches):
        seen: dict[str, Counter] = {}
        n: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), texts(b.column("text"))):
                n[lang] += 1
                grams: set[str] = set()
                for w in letter_words(text.lower()):
                    grams |= ngrams(w, size)
                seen.setdefault(lang, Counter()).update(grams)
        for lang, grams in seen.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(grams) + 1), "gram": [None, *grams],
                                              "n": pa.array([n[lang], *grams.values()], pa.int64())},
                                             schema=pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())]))

    totals = sample.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    used = {r["lang"]: r["n"] for r in totals.where("gram IS NULL").collect()}
    least = F.create_map(*[F.lit(x) for la in langs for x in (la, max(1.0, min_share * used.get(la, 0)))])
    masks = Masks(langs, slots, probes, size)
    for r in totals.where(F.col("gram").isNotNull() & (F.col("n") >= least[F.col("lang")])).collect():
        masks.add(r["gram"], langs.index(r["lang"]))
    return masks.close()


def predict(docs: DataFrame, masks: Masks, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(masks)  # slots x languages / 8 bytes, a fixed size

    def run(batches):
        p = Predictor(shared.value)
        for b in batches:
            found = [p(t) for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, masks: Masks, min_score: float = 0.1, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that have no letter or whose best language holds less than
    ``min_score`` of their n-grams; with no language learned only the letters count."""
    shared = docs.sparkSession.sparkContext.broadcast(masks)

    @F.arrow_udf("boolean")
    def keep(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = Predictor(shared.value)
        for part in parts:
            yield pa.array([p(t)[1] >= min_score if p.masks.langs else any(map(str.isalpha, t)) for t in texts(part)], pa.bool_())

    return docs.where(keep(F.col(text_col).cast("string")))
