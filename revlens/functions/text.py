"""Text expressions with Python's str semantics, as JVM-side Spark columns.

Java's ``\\s``/``\\w`` are ASCII-only, so Python's whitespace, word and digit
classes are spelled out.  The emoji name table is generated from the Unicode
character database (``unicodedata``) by rule, not listed by hand.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens.functions.exprs import PY_SPACE, col_, strip_fences, ustrip  # noqa: F401


# Characters Python's str.isdigit() accepts beyond \p{Nd} (superscripts, circled digits, ...),
# generated from the Unicode database and merged into ranges.
@lru_cache(maxsize=1)
def _extra_digits() -> str:
    cps = [c for c in range(sys.maxunicode + 1)
           if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"]
    ranges, start, prev = [], None, None
    for c in cps:
        if start is None:
            start = prev = c
        elif c == prev + 1:
            prev = c
        else:
            ranges.append((start, prev))
            start = prev = c
    if start is not None:
        ranges.append((start, prev))
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


def digit_class() -> str:
    return "[\\p{Nd}" + _extra_digits() + "]"


ALNUM_CLASS = r"[\p{L}\p{N}]"
CONTROL_CLASS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
# Punctuation folding: curly single/double quotes to straight, en/em dash to hyphen.
PUNCT_FROM = "‘’“”–—"
PUNCT_TO = "''\"\"--"
# Anything that is neither a Python word character nor Python whitespace.
NON_WORD_SPACE = r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"


def _emoji_ranges():
    # Pictographic blocks: symbols & pictographs, emoticons, transport, supplemental,
    # extended-A, plus miscellaneous symbols and dingbats.
    return [(0x1F300, 0x1FAFF), (0x2600, 0x27BF), (0x1F000, 0x1F2FF)]


@lru_cache(maxsize=1)
def emoji_names() -> dict[str, str]:
    """Emoji code point -> ``" name "`` (lower case, words joined by '_')."""
    table = {}
    for lo, hi in _emoji_ranges():
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            if unicodedata.category(ch) != "So":
                continue
            name = unicodedata.name(ch, None)
            if name:
                table[ch] = " " + name.lower().replace(" ", "_") + " "
    return table


def emoji_class() -> str:
    parts = []
    for lo, hi in _emoji_ranges():
        parts.append(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
    return "[" + "".join(parts) + "]"


# Names of the five skin tones, U+1F3FB to U+1F3FF.
SKIN_TONES = ["light_skin_tone", "medium_light_skin_tone", "medium_skin_tone", "medium_dark_skin_tone", "dark_skin_tone"]
_FLAG = r"[\x{1f1e6}-\x{1f1ff}]{2}"
_TAGGED = r"\x{1f3f4}[\x{e0020}-\x{e007e}]+\x{e007f}"
_KEYCAP = r"[0-9#*]\x{20e3}"


@lru_cache(maxsize=1)
def sequence_names() -> dict[str, str]:
    """Part of an emoji sequence -> its name inside the sequence's (skin tones, flag and tag letters, keycap bases)."""
    names = {ch: name.strip() for ch, name in emoji_names().items()}
    names.update({chr(0x1F3FB + i): t for i, t in enumerate(SKIN_TONES)})
    names.update({chr(0x1F1E6 + i): chr(ord("a") + i) for i in range(26)})
    names.update({chr(0xE0000 + c): chr(c) for c in range(0x20, 0x7F)})
    names.update({c: unicodedata.name(c).lower().replace(" ", "_") for c in "0123456789#*"})
    names.update({"\u20e3": "", "\U000e007f": "", "\u200d": ""})
    return names


def emoji_unit() -> str:
    """Pattern of one unit, the longest first: flag, tagged flag, keycap, joined sequence of pictographs with skin tones, any character."""
    one = rf"{emoji_class()}[\x{{1f3fb}}-\x{{1f3ff}}]?"
    return rf"(?s)(?:{_FLAG}|{_TAGGED}|{_KEYCAP}|{one}(?:\x{{200d}}{one})*|.)"


def emoji_mark() -> str:
    """Pattern that a text with any emoji matches."""
    return rf"{emoji_class()}|\x{{20e3}}"


def emoji_to_text(c) -> Column:
    """B1: each emoji, a sequence as one, becomes its name with a space on either side; U+FE0F is dropped.

    A sequence's name joins those of its parts: ``flag_de``, ``keycap_digit_five``,
    ``waving_hand_sign_medium_skin_tone``, ``woman_personal_computer``.  Only rows that contain
    an emoji pay for the lookups.
    """
    c = col_(c)

    def table(names):
        return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    single, parts = table(emoji_names()), table(sequence_names())

    def name(u):
        letters = F.transform(F.split(u, "", -1), lambda ch: F.coalesce(F.try_element_at(parts, ch), ch))
        joined = F.array_join(F.filter(letters, lambda x: x != ""), "_")
        run = F.array_join(letters, "")
        return (F.when(F.char_length(u) == 1, F.coalesce(F.try_element_at(single, u), u))
                .when(u.rlike(_TAGGED), F.concat(F.lit(" flag_"), F.substring(run, F.lit(len(sequence_names()[chr(0x1F3F4)]) + 1), F.char_length(run)), F.lit(" ")))
                .when(u.rlike(_FLAG), F.concat(F.lit(" flag_"), run, F.lit(" ")))
                .when(u.rlike(_KEYCAP), F.concat(F.lit(" keycap_"), joined, F.lit(" ")))
                .otherwise(F.concat(F.lit(" "), joined, F.lit(" "))))

    units = F.regexp_extract_all(F.regexp_replace(c, "\\x{fe0f}", ""), F.lit(emoji_unit()), F.lit(0))
    return F.when(c.rlike(emoji_mark()), F.array_join(F.transform(units, name), "")).otherwise(c)


def strip_control(c) -> Column:
    """B2: drop C0 controls and DEL, keep tab, LF, CR."""
    return F.regexp_replace(col_(c), CONTROL_CLASS, "")


def fold_punct(c) -> Column:
    """Curly quotes to straight, en/em dash to '-'."""
    return F.translate(col_(c), PUNCT_FROM, PUNCT_TO)


def squeeze(c) -> Column:
    """Collapse runs of spaces (only U+0020), then strip all whitespace."""
    return ustrip(F.regexp_replace(col_(c), " +", " "))


def normalise(c) -> Column:
    """B2-B4 in the fixed order."""
    return squeeze(fold_punct(strip_control(c)))


def is_noise(c) -> Column:
    """Empty; or >3 chars with one (case-folded) char over 60 %; or digits over 70 %; or no alphanumeric.

    The 60 % rule needs a strict majority character: the middle element of the
    sorted code points is the only candidate, then it is counted exactly; a
    doubled-pair count rules most lines out before that sort.
    """
    t = col_(c)
    low = F.lower(t)
    m = F.length(low)
    chars = F.split(low, "", -1)
    # a strict majority character occupies the middle of the sorted characters
    cand = F.element_at(F.sort_array(chars), F.floor((F.size(chars) + 1) / 2).cast("int"))
    cand_count = m - F.length(F.replace(low, cand, F.lit("")))
    # necessary condition, one regex pass: a character holding > 60 % of m positions
    # leaves at least 0.1*m - 0.5 non-overlapping doubled pairs
    doubled = F.regexp_count(low, F.lit(r"(?s)(.)\1"))
    majority = F.when(doubled.cast("double") >= m.cast("double") * 0.1 - 0.5,
                      cand_count.cast("double") / m.cast("double") > 0.6).otherwise(F.lit(False))
    n = F.length(t)
    rule1 = (n > 3) & majority
    # digit share: bound first with the two-property class, then count exactly
    loose = n - F.length(F.regexp_replace(t, r"[\p{Nd}\p{No}]", ""))
    digits = n - F.length(F.regexp_replace(t, digit_class(), ""))
    rule2 = F.when(loose.cast("double") / n.cast("double") > 0.7,
                   digits.cast("double") / n.cast("double") > 0.7).otherwise(F.lit(False))
    rule3 = ~t.rlike(ALNUM_CLASS)
    return F.when(t.isNull() | (n == 0), F.lit(True)).otherwise(rule1 | rule2 | rule3)


def comparison_key(c) -> Column:
    """Lower, drop everything but word chars and whitespace, collapse whitespace, strip."""
    t = F.regexp_replace(F.lower(col_(c)), NON_WORD_SPACE, "")
    t = F.regexp_replace(t, f"{PY_SPACE}+", " ")
    return F.trim(t)


def enforce_length(c, lo: int = 3, hi: int | None = None) -> Column:
    """NULL if shorter than ``lo``; with ``hi``, longer texts are cut at the last . ! ? past the middle."""
    t = col_(c)
    if hi is None:
        return F.when(F.length(t) >= lo, t)
    cut = F.substring(t, 1, hi)
    upto = F.length(F.regexp_extract(cut, r"(?s)^(.*[.!?])", 1))  # = last boundary index + 1
    trimmed = F.when(upto > F.lit(hi * 0.5 + 1), F.substring(cut, 1, upto)).otherwise(cut)
    return (F.when(F.length(t) < lo, F.lit(None).cast("string"))
            .when(F.length(t) <= hi, t)
            .otherwise(ustrip(trimmed)))


def first_words(c, n: int | None = None) -> Column:
    """The stripped text; with ``n``, its first ``n`` whitespace-separated words where there are more."""
    t = ustrip(col_(c))
    if n is None:
        return t
    words = F.split(t, f"{PY_SPACE}+")
    return F.when(F.size(words) > n, F.array_join(F.slice(words, 1, n), " ")).otherwise(t)


def word_set(c) -> Column:
    """Distinct lower-case whitespace-separated words."""
    t = ustrip(F.lower(col_(c)))
    return F.array_distinct(F.filter(F.split(t, f"{PY_SPACE}+"), lambda w: w != ""))
