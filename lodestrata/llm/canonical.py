"""One spelling for texts that look the same.

A text is stable when every character passes the quick check: no full-width or
half-width form, no character whose NFC quick-check property is No or Maybe or
whose combining class is not zero, nothing invisible, no space but the common one,
no sign or letter that stands in for another of the same look. Only the unstable segments of a text are rewritten,
each with the boundary context its decision needs (the base letter before a
combining mark, the whole word around a look-alike letter); the canonical
segments are spliced into the unchanged rest.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that show nothing by themselves.
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0"
    "\U000e0000-\U000e007f\U000e0100-\U000e01ef"
)
# Spaces other than U+0020. Tabs and line breaks are not among them.
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
# Signs that look like the ASCII hyphen.
HYPHENS = "\u2010\u2011\u2212\u02d7\u2043\ufe63"
# Letters of other scripts and the Latin letters they look like.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y",
    "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l", "Ӏ": "I",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
}
#: The letters a Latin letter can stand in for, by script, when it sits in a word of that script.
BACK = {
    "CYRILLIC": {v: k for k, v in reversed(LOOK_ALIKES.items()) if unicodedata.name(k).startswith("CYRILLIC")},
    "GREEK": {v: k for k, v in reversed(LOOK_ALIKES.items()) if unicodedata.name(k).startswith("GREEK")},
}
#: So many letters of its own script make a word one of that script: `kΩ` and `Δp` are no Greek words.
WORD_OF_SCRIPT = 2

#: Blocks without a character that composition changes: ideographs, Hangul syllables, Tangut and private use.
STABLE_BLOCKS = [(0x3400, 0xA66E), (0xAC00, 0xF8FF), (0x17000, 0x1BC9C), (0x20000, 0x2F7FF)]


def unstable_points(points: Iterable[int]) -> list[int]:
    """Of ``points`` those that fail the quick check of NFC: it is not Yes, or the combining class is not zero.

    The answer is No where a character is rewritten by itself and Maybe where it
    may be the second of a pair that is composed.
    """
    points = [c for c in points if not 0xD800 <= c < 0xE000]
    second = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}  # vowels and finals of syllables
    for c in points:
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.is_normalized("NFC", chr(c)):
            second.add(chr(int(parts[1], 16)))
    return [c for c in points if chr(c) in second or unicodedata.combining(chr(c)) or not unicodedata.is_normalized("NFC", chr(c))]


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(x, y) for x, y in out]


_UNSTABLE_RANGES = _ranges(unstable_points(c for c in range(0x300, 0x30000) if not any(x <= c <= y for x, y in STABLE_BLOCKS)))
_UNSTABLE = "".join(chr(x) if x == y else f"{chr(x)}-{chr(y)}" for x, y in _UNSTABLE_RANGES)
# full- and half-width forms and the Latin ligatures are rewritten by their compatibility form
_WIDE = "\uff01-\uff9f\uffa1-\uffee\ufb00-\ufb06"
_FOREIGN = "".join(LOOK_ALIKES)

#: For the scan: a text without any of these characters is stable and never leaves the JVM.
QUICK_CHECK = (
    f"(?=[^\\x00-\\x7f])[{INVISIBLE}{SPACES}{HYPHENS}{_WIDE}{_FOREIGN}\\p{{IsCyrillic}}\\p{{IsGreek}}"
    + "".join(f"\\x{{{x:x}}}-\\x{{{y:x}}}" for x, y in _UNSTABLE_RANGES)
    + "]"
)

_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
_SPACE = re.compile(f"[{SPACES}]")
_HYPHEN = re.compile(f"[{HYPHENS}]")
_WIDTH = re.compile(f"[{_WIDE}]+")
#: An unstable segment with the character before it, which is all that composition looks at.
_SEGMENT = re.compile(f"[^{_UNSTABLE}]?[{_UNSTABLE}]+")
_WORD = re.compile(r"[^\W\d_]+")
_UNSTABLE_LETTER = re.compile("[\u0370-\u03ff\u0400-\u052f]")
_JOINERS, _EMOJI_STYLES, _FLAG, _FLAG_END = "\u200c\u200d", "\ufe0e\ufe0f", "\U0001f3f4", "\U000e007f"


def _belongs(c: str, before: str, after: str) -> bool:
    """Whether an invisible character is part of what stands around it, as the scripts and emoji that need it have it."""
    if not before:
        return False
    if c in _JOINERS:
        letters = unicodedata.bidirectional(before) in ("AL", "NSM") and after and unicodedata.bidirectional(after) == "AL"
        emoji = c == _JOINERS[1] and (unicodedata.category(before) in ("So", "Sk") or before == _EMOJI_STYLES[1]) and after and unicodedata.category(after) == "So"
        return bool(letters or emoji) or unicodedata.combining(before) == 9
    if c in _EMOJI_STYLES:
        return unicodedata.category(before) in ("So", "Sm") or before == "\u2139" or (after == "\u20e3" and before in "0123456789#*")
    if "\u180b" <= c <= "\u180f":
        return unicodedata.name(before, "").startswith("MONGOLIAN LETTER")
    if "\ufe00" <= c <= "\ufe0d" or c >= "\U000e0100":
        return unicodedata.category(before) == "Sm" or unicodedata.name(before, "").startswith("CJK ")
    if c in "\u115f\u1160":
        return "\u1100" <= (after if c == "\u115f" else before) <= "\u11ff"
    return False


def _visible(match: re.Match) -> str:
    run, text = match.group(), match.string
    before, after = text[match.start() - 1 : match.start()] if match.start() else "", text[match.end() : match.end() + 1]
    if before == _FLAG and run[-1] == _FLAG_END and all(c >= "\U000e0020" for c in run):
        return run
    kept = ""
    for i, c in enumerate(run):
        kept += c if _belongs(c, (kept or before)[-1:], run[i + 1 : i + 2] or after) else ""
    return kept


@lru_cache(maxsize=1 << 14)
def _script(letter: str) -> str:
    return unicodedata.name(letter, "?").split(" ", 1)[0]


def _own(word: str) -> dict[str, int]:
    """Letters of a word that belong to Greek or Cyrillic alone, by script."""
    own: dict[str, int] = {}
    for c in word:
        if c not in LOOK_ALIKES and (s := _script(c)) in BACK:
            own[s] = own.get(s, 0) + 1
    return own


def _word(word: str, context: set[str]) -> str:
    """A word in one script. ``context``: scripts that the text has words of."""
    own = _own(word)
    foreign = {_script(c) for c in word if c in LOOK_ALIKES}
    latin = any(_script(c) == "LATIN" for c in word)
    for script, n in own.items():
        if n >= WORD_OF_SCRIPT and (latin or foreign - {script}):
            plain = "".join(LOOK_ALIKES.get(c, c) if _script(c) != script else c for c in word)
            if all(c in BACK[script] for c in plain if _script(c) == "LATIN"):
                return "".join(BACK[script].get(c, c) for c in plain)
    if not foreign or not own.keys().isdisjoint(foreign):
        return word
    if not latin and foreign & context:
        return word  # a word of look-alikes only, in a text of that script
    return "".join(LOOK_ALIKES.get(c, c) for c in word)


def _composed(text: str) -> str:
    if unicodedata.is_normalized("NFC", text):  # the quick check of the whole text
        return text
    return _SEGMENT.sub(lambda m: unicodedata.normalize("NFC", m.group()), text)


def canonical_text(text: str | None) -> str | None:
    """The text with its unstable segments rewritten; null stays null, a stable text is returned as it is.

    Letter case, repeated spaces, tabs, line breaks and genuine words, letters and
    symbols of other scripts are kept, joiners and styles that belong to them too. A combining mark that no composed letter
    exists for stays where it is.
    """
    if text is None or text.isascii():
        return text
    out = _INVISIBLE.sub(_visible, text)
    out = _composed(_WIDTH.sub(lambda m: unicodedata.normalize("NFKC", m.group()), out))
    out = _HYPHEN.sub("-", _SPACE.sub(" ", out))
    if _UNSTABLE_LETTER.search(out):
        context = {s for w in _WORD.findall(out) for s, n in _own(w).items() if n >= WORD_OF_SCRIPT}
        out = _WORD.sub(lambda m: _word(m.group(), context) if _UNSTABLE_LETTER.search(m.group()) else m.group(), out)
        out = _composed(out)
    return out


def unstable(text: Column) -> Column:
    """Whether the quick check leaves open that the text may change; decided in the JVM, for ASCII texts by their size."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(QUICK_CHECK)


@F.pandas_udf(T.StringType())
def _canonical(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield series.map(canonical_text, na_action="ignore")


def canonicalize(df: DataFrame, column: str, to: str) -> DataFrame:
    """``df`` with the canonical spelling of ``column`` in ``to``.

    Stable texts, null and empty ones among them, never reach the Python workers. An
    existing column ``to`` is replaced, all others are kept.
    """
    return df.withColumn(to, F.coalesce(_canonical(F.when(unstable(F.col(column)), F.col(column))), F.col(column)))


def disguised(df: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` differs from its canonical spelling; empty tables give an empty result."""
    rows = df.where(unstable(F.col(column))).withColumn("_canonical", _canonical(F.col(column)))
    return rows.where(F.col("_canonical") != F.col(column)).drop("_canonical")
