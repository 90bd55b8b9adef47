"""Text of scanned pages: running lines, page numbers, divided and misread words.

What is a word is learned from the corpus: the vocabulary counts the texts that
hold each word, and a spelling counts as misread when recognition errors lead
from a far more frequent word to it. Running lines repeat, small recognition
errors folded: with the title of their document in them over the corpus, without
it at the same edge of the document's pages. Lines are joined after those lines
are gone, and a word divided at a line end is joined when the vocabulary knows
the whole.

Vocabulary, line shapes and corrections stay distributed. Two spellings that
recognition may confuse consist of the same strokes (``m`` and ``rn`` are both
``rrl``), so the words that a token may be misread from are found by one join on
the strokes, over distinct tokens; a text then gets only what concerns it. Texts
without a trace of noise never leave the JVM.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.canonical import canonical_text, canonicalize
from lodestrata.llm.duplicates import page_number
from lodestrata.operators.skew import hot_counted, skew_lookup
from lodestrata.session import materialize, ship

#: ``running`` is a running line without the title of its document.
HYPHEN, MISREAD, HEADER, PAGE_NO, RUNNING = "hyphen", "misread", "header", "page_no", "running"

# Recognition errors, read form and true form.
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("!", "i"), ("!", "l"), ("|", "l"), ("@", "a"), ("$", "s"),
    ("c", "e"), ("f", "t"), ("l", "i"), ("b", "h"), ("m", "rn"), ("d", "cl"), ("cl", "d"), ("ri", "n"), ("rn", "m"), ("ii", "u"), ("vv", "w"),
]

#: A line with the title is a running line from so many pages on.
SHAPE_PAGES = 3
#: One without is, from so many pages of its document on, this share of them at least, and with so many letters.
EDGE_PAGES, EDGE_SHARE, EDGE_LETTERS = 3, 0.25, 12
#: A true word is in so many times the texts of its misread form.
MISREAD_RATIO = 6
#: A word is known from so many texts on.
KNOWN_TEXTS = 3
#: So many misread words at most are broadcast, of some 60 bytes each.
BROADCAST_ROWS = 500_000
#: Words run together are looked at apart where one of them is in so many texts.
COMMON_TEXTS = 50 * KNOWN_TEXTS

_TOKEN = re.compile(r"[\w!@$|]+(?:[-/][\w!@$|]+)*")
_IDENTIFIER = re.compile(r"(?:^|[-/])\d+(?:$|[-/])")
_LETTERS = re.compile(r"[^\W\d_]")
_SPACING = re.compile(r"[^\w!@|$]|_")
_CODE = re.compile(r"[a-z]{1,4}\d{2,}$|\d+[a-z]{1,3}$")
_EDGE = "!|$"
_HYPHENS = ("-", "¬", "=")
_LINE_END = re.compile(r"([\w!@$|]+)[-¬=] *$")
_LINE_START = re.compile(r"^ *([\w!@$|]+)")
_PAGE_LINE = r"^[\W_]*+(?:pp|pg|page|seite|página|pág|blatt|p|s)?[\W_]*+\d{1,6}(?:\s*+(?:/|of|von|de)\s*+\d{1,6})?[\W_]*+$"
_PAGE = re.compile(_PAGE_LINE, re.I)
_LINE_BREAK = r"\r\n|\r|\n"
_BARE = re.compile(r"^\s*(\d{1,6})\s*$")
_ROMAN = re.compile(r"^[\W_]*(?=[ivxlcdm])m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})[\W_]*$", re.I)

# Letters and signs in strokes; what CONFUSIONS leads to each other has the same strokes.
STROKES = {
    "0": "o", "1": "l", "i": "l", "!": "l", "|": "l", "5": "s", "$": "s", "6": "b", "8": "b", "9": "g", "@": "a", "e": "c", "t": "f", "h": "b",
    "m": "rrl", "n": "rl", "u": "ll", "d": "cl", "w": "vv",
}
_STROKES = str.maketrans(STROKES)
_SIGNS = set("015689!|@$")


def strokes(text: str) -> str:
    """Letter by letter the strokes of a text in lower case: equal for a text and all its misreadings."""
    return text.lower().translate(_STROKES)


def strokes_of(text: Column, drop: str = "") -> Column:
    """``strokes`` as a column, without the characters of ``drop``."""
    one = [k for k, v in STROKES.items() if len(v) == 1]
    out = F.translate(F.lower(text), "".join(one) + drop, "".join(STROKES[k] for k in one))
    for k, v in STROKES.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def misreads(token: str, word: str) -> bool:
    """Whether one or two recognition errors lead from ``word`` to ``token``; signs and digits for letters are one error, however many."""
    if token == word:
        return False
    best: dict[tuple[int, int], set[tuple[int, bool]]] = {(0, 0): {(0, False)}}
    for i in range(len(token) + 1):
        for j in sorted(k for a, k in best if a == i):
            for letters, signs in best[i, j]:
                if i < len(token) and j < len(word) and token[i] == word[j]:
                    best.setdefault((i + 1, j + 1), set()).add((letters, signs))
                for read, true in CONFUSIONS:
                    if token.startswith(read, i) and word.startswith(true, j):
                        step = (letters, True) if read in _SIGNS else (letters + 1, signs)
                        if sum(step) <= 2:
                            best.setdefault((i + len(read), j + len(true)), set()).add(step)
    return (len(token), len(word)) in best


@lru_cache(maxsize=1 << 16)
def _title(document: str) -> str:
    """The letters of a document's title in strokes; empty without any."""
    return strokes(re.sub(r"[\W_]+", "", canonical_text(document)))


def without_title(line: str, title: str) -> str | None:
    """The line with a blank for the title (in strokes), whatever stands between its letters; null if it isn't there."""
    # most lines lack even the strokes
    if not title or title not in strokes(_SPACING.sub("", line)):
        return None
    stream, begins, ends = [], {}, {}
    at = 0
    for i, c in enumerate(line):
        if not _SPACING.match(c):
            begins[at] = i
            stream.append(strokes(c))
            at += len(stream[-1])
            ends[at] = i + 1
    whole = "".join(stream)
    at = whole.find(title)
    while at >= 0:
        if at in begins and at + len(title) in ends:
            return line[: begins[at]] + " " + line[ends[at + len(title)] :]
        at = whole.find(title, at + 1)
    return None


def line_shape(rest: str) -> str:
    """The fuzzy shape of what a running line has besides the title: words in strokes, numbers as ``#``."""
    return " ".join("#" if w.isdigit() or _ROMAN.match(w) else strokes(w) for w in re.findall(r"[^\W_]+", rest))


def lines_of(text: str) -> list[str]:
    return re.split(r"\r\n|\r|\n", canonical_text(re.sub("­(?=[ \t]*[\r\n])", "-", text)))


class Reader:
    """Reads texts with a vocabulary (word to number of texts), the known shapes of running lines, and ``fixes``.

    ``fixes`` are the corrections of tokens, (misread word, true word) by lower
    case; without them they are taken from the vocabulary.
    """

    def __init__(self, vocabulary: dict[str, int], shapes: set[str], fixes: dict[str, tuple[str, str]] | None = None) -> None:
        self.vocabulary, self.shapes, self.fixes = vocabulary, shapes, fixes
        self._by_strokes: dict[str, list[str]] = {}
        for word in vocabulary:
            self._by_strokes.setdefault(strokes(word), []).append(word)
        self._sizes = {len(w) for w, n in vocabulary.items() if n >= KNOWN_TEXTS}
        self._corrected: dict[str, str | None] = {}

    def known(self, word: str) -> bool:
        return self.vocabulary.get(word, 0) >= KNOWN_TEXTS

    def true_word(self, token: str) -> str | None:
        """The most frequent word that ``token`` (lower case) is a misreading of, the first in order on a tie, else null."""
        if len(token) < 3 and token.isalpha() or not _LETTERS.search(token):
            return None
        least = max(KNOWN_TEXTS, MISREAD_RATIO * self.vocabulary.get(token, 0))
        from_ = [w for w in self._by_strokes.get(strokes(token), ()) if self.vocabulary[w] >= least and (len(w) > 3 or not token.isalpha()) and misreads(token, w)]
        return min(from_, key=lambda w: (-self.vocabulary[w], w), default=None)

    def correct(self, token: str) -> str | None:
        """The token with its misread word put right, else null. Words run together are looked at apart."""
        if token not in self._corrected:
            if len(self._corrected) > 500_000:
                self._corrected.clear()
            self._corrected[token] = self._compound(token) if "-" in token or "/" in token else self._put_right(token)
        return self._corrected[token]

    def _compound(self, token: str) -> str | None:
        if _IDENTIFIER.search(token):
            return None
        right = re.sub(r"[^-/]+", lambda m: self.correct(m.group()) or m.group(), token)
        return right if right != token else None

    def _put_right(self, token: str) -> str | None:
        found = self.find(token.lower()) if self.fixes is None else self.fixes.get(token.lower())
        if found is None:
            return None
        low, word = found
        at = token.lower().find(low)
        return token[:at] + _cased(word, token[at : at + len(low)]) + token[at + len(low) :]

    def find(self, low: str) -> tuple[str, str] | None:
        """What of a token in lower case is misread, and the true word."""
        if len(low) < 2 or low.isdigit() or _CODE.match(low):
            return None
        core = low.rstrip(_EDGE).lstrip("|$")
        if self.known(core) and core != low:
            low = core
        word = self.true_word(low)
        if word is None and core != low:
            low, word = core, self.true_word(core)
        if word is None and len(low) > 7 and not self.known(low):
            word = self._apart(low)
        return (low, word) if word is not None else None

    def _apart(self, token: str) -> str | None:
        """Two words run together, one of them misread."""
        found = None
        n = len(token)
        for i in sorted({i for size in self._sizes for i in (size, n - size) if 2 <= i <= n - 2}):
            a, b = token[:i], token[i:]
            if self.known(a) and self.known(b):
                return None
            if found is None and len(b) > 4 and self.known(a) and self.vocabulary[a] > COMMON_TEXTS and not self.known(b) and (w := self.true_word(b)):
                found = a + w
            elif found is None and len(a) > 4 and self.known(b) and self.vocabulary[b] > COMMON_TEXTS and not self.known(a) and (w := self.true_word(a)):
                found = w + b
        return found

    def read(self, text: str | None, document: str | None, page: str | None) -> tuple[list[str], str | None]:
        """The kinds of noise in a text, and the text in continuous paragraphs with the noise gone.

        Null stays null, an empty text empty; neither has noise. A null document has
        no title, a null page allows only decorated page numbers.
        """
        if text is None:
            return [], None
        kinds, body = self.strip(lines_of(text), document, page)
        return self.mend(body, kinds)

    def strip(self, lines: list[str], document: str | None, page: str | None, edges: str = "") -> tuple[set[str], list[str]]:
        """The lines without running lines and page numbers, and which of these there were.

        ``edges``: ``t`` and ``b`` where the first and last line repeat over the document's pages.
        """
        kinds: set[str] = set()
        title = _title(document) if document else ""
        number = _number(page)
        body: list[str] = []
        filled = [i for i, line in enumerate(lines) if line.strip()]
        running = {filled[0 if e == "t" else -1] for e in edges if filled}
        for i, line in enumerate(lines):
            rest = without_title(line, title)
            if rest is not None and ((shape := line_shape(rest)) in ("", "#") or shape in self.shapes or _PAGE.match(rest)):
                kinds.add(HEADER)
                # a number beside the title: at an end of the line, not the number of a revision
                if any(_PAGE.match(p) or _ROMAN.match(p) for p in re.split(r"\s{2,}", rest.strip()) if p.strip()) and re.search(r"\w", rest):
                    kinds.add(PAGE_NO)
            elif _page_line(line, number):
                kinds.add(PAGE_NO)
            elif i in running:
                kinds.add(RUNNING)
            else:
                body.append(line)
        return kinds, body

    def mend(self, lines: list[str], kinds: set[str]) -> tuple[list[str], str]:
        """The kinds of noise, and the lines as paragraphs with divided and misread words put right."""
        paragraphs = self._join(lines, kinds)
        repaired = "\n\n".join(self._words(p, kinds) for p in paragraphs)
        return sorted(kinds), repaired

    def _join(self, lines: list[str], kinds: set[str]) -> list[str]:
        paragraphs, current = [], ""
        for line in lines:
            if not line.strip():
                if current:
                    paragraphs.append(current)
                current = ""
                continue
            end = _divided_end(current)
            start = _LINE_START.search(line) if end else None
            if end and start and self._divided(end.group(1), start.group(1)):
                kinds.add(HYPHEN)
                current = current[: end.end(1)] + line.lstrip()
            else:
                current = f"{current.rstrip()} {line.strip()}" if current else line.lstrip()
        return [*paragraphs, current] if current else paragraphs

    def _divided(self, left: str, right: str) -> bool:
        """Whether the two halves are one word: the vocabulary knows the whole, or a word that it is misread from."""
        whole = (left + right).lower()
        if not _LETTERS.search(left) or not _LETTERS.search(right):
            return False
        if self.known(whole.rstrip(_EDGE)):
            return True
        return not (self.known(left.lower()) and self.known(right.lower())) and self.true_word(whole) is not None

    def _words(self, text: str, kinds: set[str]) -> str:
        wrong = {t: right for t in set(_TOKEN.findall(text)) if (right := self.correct(t)) is not None}
        if not wrong:
            return text
        kinds.add(MISREAD)
        return _TOKEN.sub(lambda m: wrong.get(m.group(), m.group()), text)


def _cased(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word.capitalize() if like[:1].isupper() else word


def _number(page: str | None) -> int | None:
    try:
        return int(float(page))
    except (TypeError, ValueError, OverflowError):
        return None


def _page_line(line: str, page: int | None) -> bool:
    if bare := _BARE.match(line):
        return page is not None and int(bare.group(1)) == page
    stripped = line.strip()
    if stripped.isalpha() and stripped.islower() and _ROMAN.match(stripped):
        return True
    found = _PAGE.match(line)
    # a number with a full stop or comma only is the end of a sentence
    return bool(found) and not re.match(r"^\s*[\d.,;:]+\s*$", line)


def _divided_end(line: str) -> re.Match | None:
    """The piece before a hyphen at the end of a line."""
    return _LINE_END.search(line) if line.rstrip(" ")[-1:] in _HYPHENS else None


def halves(lines: list[str]) -> list[tuple[str, str]]:
    """The halves (lower case) that may be one word divided between two lines of a paragraph, whatever the vocabulary knows."""
    out: list[tuple[str, str]] = []
    lefts: list[str] = []
    for line in lines:
        start, end = _LINE_START.search(line), _divided_end(line)
        pairs = [(a, start.group(1).lower()) for a in lefts] if start else []
        out.extend(pairs)
        lefts = []
        if end:
            lefts.append(end.group(1).lower())
            if start and start.start(1) == end.start(1):  # the line is one piece: it may continue a word
                lefts.extend(a + b for a, b in pairs)
    return out


# the scan: what of a text the Python side has to look at
_JVM_PAGE = r"(?imU)^[\W_&&[^\r\n]]*+(?:pp|pg|page|seite|página|pág|blatt|p|s)?[\W_&&[^\r\n]]*+\d{1,6}(?:[ \t]*+(?:/|of|von|de)[ \t]*+\d{1,6})?[\W_&&[^\r\n]]*+\r?$"
_JVM_ROMAN = r"(?m)^[ \t]*+[ivxlcdm]+[ \t]*+\r?$"
_JVM_BARE = r"(?m)^[ \t]*+\d{1,6}[ \t]*+\r?$"
_JVM_NUMBER = r"^\s*[\d.,;:]+\s*$"
_JVM_HYPHEN = r"(?U)[\w!@$|][-¬=] *[\r\n]"
_JVM_TOKEN = r"[a-z0-9_!@$|\p{L}\p{N}]+(?:[-/][a-z0-9_!@$|\p{L}\p{N}]+)*"
_JVM_CODE = r"^(?:[a-z]{1,4}\d{2,}|\d+[a-z]{1,3})$"


def _letters(text: Column) -> Column:
    """Letters, digits and signs in strokes; an ASCII text loses the rest by ``translate``, which costs less than a pattern."""
    rest = strokes_of(F.regexp_replace(text, r"[^A-Za-z0-9!@|$\p{L}\p{N}]+", ""))
    return F.when(F.octet_length(text) == F.length(text), strokes_of(text, " \n\r\t._-,;:'\"()[]{}<>/\\\\#%&*+=?^`~")).otherwise(rest)


def _tokens(text: Column) -> Column:
    """The distinct tokens of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_JVM_TOKEN), F.lit(0)))


def _parts(tokens: DataFrame) -> DataFrame:
    """``tokens`` with each ``part`` that may be a misread word: no numbers, codes or parts of identifiers."""
    words = tokens.where(~F.col("token").rlike(r"(?:^|[-/])\d+(?:$|[-/])")).withColumn("part", F.explode(F.split("token", "[-/]")))
    return words.where((F.length("part") > 1) & F.col("part").rlike(r"\p{L}") & ~F.col("part").rlike(_JVM_CODE))


def _core(part: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(part, r"[!|$]+$", ""), r"^[|$]+", "")


def vocabulary(parts: DataFrame) -> DataFrame:
    """(word, texts): words of letters only, with the number of texts that hold them (as several tokens, several times)."""
    words = parts.select(_core(F.col("part")).alias("word"), "texts").where(F.col("word").rlike(r"^\p{L}{2,}$"))
    return words.groupBy("word").agg(F.sum("texts").alias("texts")).where("texts > 1")


def _index(words: DataFrame) -> DataFrame:
    """(strokes, words): the vocabulary by strokes."""
    return words.groupBy(strokes_of(F.col("word")).alias("strokes")).agg(F.collect_list(F.struct("word", "texts")).alias("words"))


def _slices(forms: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """(key, words): of the vocabulary the words with the strokes of any form of each key; ``forms`` has key and form."""
    asked = forms.select(key, strokes_of(F.col("form")).alias("strokes")).distinct()
    found = asked.join(index, "strokes")
    return found.groupBy(key).agg(F.flatten(F.collect_list("words")).alias("words"))


_FIX = T.StructType([T.StructField("low", T.StringType()), T.StructField("word", T.StringType())])


@F.pandas_udf(_FIX)
def _find(parts: pd.Series, words: pd.Series) -> pd.DataFrame:
    found = [Reader({w: int(n) for w, n in _rows(own)}, set()).find(p) or (None, None) for p, own in zip(parts, words, strict=True)]
    return pd.DataFrame(found, columns=["low", "word"])


def corrections(parts: DataFrame, words: DataFrame, index: DataFrame) -> DataFrame:
    """(part, low, word) for every part of a token that is misread: ``low`` is what of it is, ``word`` the true word.

    One join on strokes finds the words that a part may come from, and those of the
    pieces of unknown long parts (two words run together, one of them misread).
    """
    known = words.where(F.col("texts") >= KNOWN_TEXTS).select(F.col("word").alias("core"), F.lit(True).alias("known"))
    asked = parts.select("part", _core(F.col("part")).alias("core")).join(known, "core", "left")
    low, core, n = F.col("part"), F.col("core"), F.length("core")
    # one of two words run together is known: a part is cut only where a piece has the length of a known word
    lengths = [r[0] for r in known.select(F.length("core")).distinct().collect()]  # as many as words have lengths
    sizes = F.array(*map(F.lit, lengths)).cast("array<int>")
    cuts = F.filter(F.array_union(sizes, F.transform(sizes, lambda i: n - i)), lambda i: (i >= 2) & (i <= n - 2))
    pieces = F.flatten(F.transform(cuts, lambda i: F.array(F.substring(core, F.lit(1), i), F.substring(core, i + 1, n - i))))
    apart = F.when(F.col("known").isNull() & (n > 7), pieces).otherwise(F.array().cast("array<string>"))
    forms = asked.select("part", F.explode(F.array_distinct(F.concat(F.array(low, core), apart))).alias("form"))
    found = _slices(forms, "part", index)
    # a part whose strokes only it has cannot be misread
    open_ = found.where(F.exists("words", lambda w: (w["word"] != F.col("part")) & (w["texts"] >= KNOWN_TEXTS)))
    return open_.select("part", _find("part", _joined("words", "word", "texts")).alias("f")).where("f.low IS NOT NULL").select("part", "f.low", "f.word")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _shapes(documents: pd.Series, texts: pd.Series) -> pd.Series:
    def one(document, text):
        title = _title(document)
        return sorted({line_shape(rest) for line in re.split(_LINE_BREAK, text) if (rest := without_title(line, title)) is not None})

    return pd.Series([one(d, t) for d, t in zip(documents, texts, strict=True)], dtype=object)


def title_shapes(units: DataFrame) -> DataFrame:
    """(unit, shapes): of the lines with the document's title the shapes that SHAPE_PAGES pages or more have."""
    own = materialize(units.select("unit", "document", page_number(F.col("page")).alias("page"), F.explode(_shapes("document", "text")).alias("shape")), "shapes")
    pages = own.select("shape", "document", "page").distinct().groupBy("shape").agg(F.count(F.lit(1)).alias("pages"))
    known = pages.where(F.col("pages") >= SHAPE_PAGES).withColumn("known", F.lit(True)).select("shape", "known")
    return skew_lookup(own.select("unit", "shape"), known, ["shape"], "inner").groupBy("unit").agg(F.collect_set("shape").alias("shapes"))


def edge_lines(units: DataFrame) -> DataFrame:
    """(unit, edges): ``t`` and ``b`` where the first or last line of a text repeats at that edge of its document's pages.

    Lines are compared in strokes without numbers; copies of a page count once.
    """
    one = F.when(F.col("text").contains("\r"), F.regexp_replace("text", r"\r\n?", "\n")).otherwise(F.col("text"))
    rows = units.select("unit", "document", page_number(F.col("page")).alias("page"), F.regexp_replace(one, r"(?U)^\s+|\s+$", "").alias("l")).where(F.col("l").contains("\n"))
    line = lambda edge, at: F.struct(F.lit(edge).alias("edge"), F.substring_index("l", "\n", at).alias("line"))
    rows = rows.select("unit", "document", "page", F.explode(F.array(line("t", 1), line("b", -1))).alias("e"))
    shape = F.regexp_replace(strokes_of(F.regexp_replace("e.line", r"\b\d+\b", "#")), r"[^\p{L}\p{N}#]+", "")
    rows = materialize(rows.select("unit", "document", "page", "e.edge", shape.alias("shape")), "edges")
    pages = rows.select("document", "page").distinct().groupBy("document").agg(F.count(F.lit(1)).alias("of"))
    long = rows.where(F.length(F.replace("shape", F.lit("#"), F.lit(""))) >= EDGE_LETTERS)
    seen = long.select("document", "edge", "shape", "page").distinct().groupBy("document", "edge", "shape").agg(F.count(F.lit(1)).alias("pages"))
    known = seen.where(F.col("pages") >= EDGE_PAGES).join(pages, "document").where(F.col("pages") >= EDGE_SHARE * F.col("of")).select("document", "edge", "shape")
    hits = long.join(known, ["document", "edge", "shape"], "left_semi")
    return hits.groupBy("unit").agg(F.array_join(F.sort_array(F.collect_set("edge")), "").alias("edges"))


_STRIPPED = T.StructType([
    T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("body", T.StringType()), T.StructField("halves", T.ArrayType(T.StringType())),
    T.StructField("wholes", T.ArrayType(T.StringType())),
])


@F.pandas_udf(_STRIPPED)
def _strip(documents: pd.Series, pages: pd.Series, texts: pd.Series, shapes: pd.Series, edges: pd.Series) -> pd.DataFrame:
    """``documents`` is null where the text lacks the title."""
    out = []
    for document, page, text, own, edge in zip(documents, pages, texts, shapes, edges, strict=True):
        known = set(own) if own is not None else set()
        kinds, lines = Reader({}, known).strip(re.split(_LINE_BREAK, text), document, page, edge or "")
        pairs = set(halves(lines))
        out.append((sorted(kinds), "\n".join(lines), sorted({x for p in pairs for x in p}), sorted({a + b for a, b in pairs})))
    return pd.DataFrame(out, columns=_STRIPPED.names)


_MENDED = T.StructType([T.StructField("kinds", T.StringType()), T.StructField("repaired", T.StringType())])


def _joined(column: str, *fields: str) -> Column:
    """An array of structs as text, a line for each with its fields between tabs: words hold neither, and nested values cost the workers more."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws("\t", *(x[f].cast("string") for f in fields))), "\n")


def _rows(text: str) -> list[list[str]]:
    return [line.split("\t") for line in text.split("\n")] if text else []


@F.pandas_udf(_MENDED)
def _mend(kinds: pd.Series, bodies: pd.Series, words: pd.Series, fixes: pd.Series) -> pd.DataFrame:
    out = []
    for have, body, own, fix in zip(kinds, bodies, words, fixes, strict=True):
        reader = Reader({w: int(n) for w, n in _rows(own)}, set(), {part: (low, word) for part, low, word in _rows(fix)})
        found, repaired = reader.mend(re.split(_LINE_BREAK, body), set(have.split()))
        out.append((" ".join(found), repaired))
    return pd.DataFrame(out, columns=["kinds", "repaired"])


def text_units(df: DataFrame, document: str, page: str, columns: list[str]) -> DataFrame:
    """Each distinct (document, page, text) once in canonical spelling, with its digest ``unit``, the number of fields ``n`` that hold it, and marks.

    The marks are traces of noise, seen by patterns in the JVM: several lines, the
    title's strokes, a page number's line, a hyphen at a line end.
    """
    # a row's equal texts are one before anything is hashed or moved
    texts = F.array_distinct(F.array(*columns))
    rows = df.select(F.col(document).cast("string").alias("document"), F.col(page).cast("string").alias("page"), F.array(*columns).alias("all"), F.explode(texts).alias("text")).where("text <> ''")
    fields = reduce(lambda n, i: n + F.when(F.col("all")[i] == F.col("text"), 1).otherwise(0), range(len(columns)), F.lit(0))
    rows = rows.select("document", "page", "text", _digest().alias("unit"), fields.alias("n")).groupBy("unit").agg(
        F.any_value("document").alias("document"), F.any_value("page").alias("page"), F.any_value("text").alias("text"), F.sum("n").alias("n")
    )
    soft = F.when(F.octet_length("text") != F.length("text"), F.regexp_replace("text", "­(?=[ \\t]*[\\r\\n])", "-")).otherwise(F.col("text"))
    units = canonicalize(canonicalize(rows.withColumn("text", soft), "text", "text"), "document", "document")
    text = F.col("text")
    many = text.rlike("[\r\n]")
    number = F.regexp_extract("page", r"^\s*(\d+)(?:\.0*)?\s*$", 1).try_cast("bigint")
    page_line = (text.rlike(_JVM_PAGE) & ~text.rlike(_JVM_NUMBER)) | text.rlike(_JVM_ROMAN) | (text.rlike(_JVM_BARE) & (many | (F.trim(text).try_cast("bigint") == number)))
    title = _letters(F.col("document"))
    titled = (title != "") & _letters(text).contains(title)
    marks = {"many": many, "titled": titled, "paged": page_line, "hyphened": many & text.rlike(_JVM_HYPHEN)}
    return units.withColumns({name: F.coalesce(mark, F.lit(False)) for name, mark in marks.items()})


def _fields(df: DataFrame, document: str, page: str, columns: list[str], keep: list[str]) -> DataFrame:
    """One row per non-empty field: ``keep``, field, document, page, text and the digest ``unit`` of the last three."""
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns))
    rows = df.select(*keep, F.col(document).cast("string").alias("document"), F.col(page).cast("string").alias("page"), F.explode(fields).alias("f"))
    rows = rows.select(*keep, "document", "page", "f.field", "f.text").where("text <> ''")
    return rows.withColumn("unit", _digest())


def _digest() -> Column:
    return F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce("document", F.lit("\x00")), F.coalesce("page", F.lit("\x00")), "text")))


def noisy_units(units: DataFrame) -> DataFrame:
    """(unit, n, kinds, repaired) of the units that have noise. ``units`` as ``text_units`` gives them, written."""
    ship(units.sparkSession)
    text = F.col("text")
    # tokens and vocabulary, over all units
    tokens = materialize(units.select(F.explode(_tokens(text)).alias("token"), "n").groupBy("token").agg(F.sum("n").alias("texts")), "tokens")
    parts = _parts(tokens).groupBy("part").agg(F.sum("texts").alias("texts"))
    words = materialize(vocabulary(parts), "vocabulary")
    index = materialize(_index(words), "strokes")
    # running lines, page numbers and divided words: only units with a trace of one
    shapes = title_shapes(units.where("titled"))
    edges = edge_lines(units.where("many"))
    suspects = units.join(shapes, "unit", "left").join(edges, "unit", "left").where("titled OR paged OR hyphened OR edges IS NOT NULL")
    stripped = materialize(suspects.select("unit", _strip(F.when(F.col("titled"), F.col("document")), "page", "text", "shapes", "edges").alias("s")).select("unit", "s.*"), "stripped")
    # misread words, over distinct tokens; wholes of divided words may be misread too
    wholes = stripped.select("unit", F.explode("wholes").alias("token"))
    tokens = tokens.select("token").unionByName(wholes.select("token")).distinct()
    fixes = materialize(corrections(_parts(tokens).select("part").distinct(), words, index), "fixes")
    wrong = materialize(_parts(tokens).join(fixes, "part").select("token", "part", "low", "word"), "wrong")
    held = units.select("unit", F.explode(_tokens(text)).alias("token")).unionByName(wholes)
    # a few misread words travel to the texts; many meet the tokens in a shuffle
    few = wrong.count() <= BROADCAST_ROWS
    hits = held.join(F.broadcast(wrong) if few else wrong, "token").groupBy("unit").agg(F.collect_list(F.struct("part", "low", "word")).alias("fixes"))
    forms = stripped.select("unit", F.explode(F.array_distinct(F.concat("halves", "wholes", F.transform("wholes", _core)))).alias("form"))
    slices = _slices(forms, "unit", index)
    both = units.select("unit", "n", "text").join(hits, "unit", "left").join(stripped.select("unit", "kinds", "body"), "unit", "left")
    both = both.where("fixes IS NOT NULL OR kinds IS NOT NULL").join(slices, "unit", "left")
    mended = _mend(
        F.coalesce(F.array_join("kinds", " "), F.lit("")), F.coalesce("body", "text"), F.coalesce(_joined("words", "word", "texts"), F.lit("")),
        F.coalesce(_joined("fixes", "part", "low", "word"), F.lit("")),
    )
    done = both.select("unit", "n", mended.alias("m")).select("unit", "n", "m.kinds", "m.repaired").where("kinds <> ''")
    return done.withColumn("kinds", F.split("kinds", " "))


def read_noise(df: DataFrame, key: str, document: str, page: str, columns: list[str]) -> DataFrame:
    """(key, field, kinds, repaired) for every field of ``columns`` that has noise: its kinds and the repaired text.

    Vocabulary and line shapes come from all of ``df``. Null and empty texts have
    none; a null document has no title, a null page allows only decorated page
    numbers. Repeated rows give repeated results.
    """
    units = materialize(text_units(df, document, page, columns), "units")
    noisy = materialize(noisy_units(units), "noisy")
    rows = _fields(df, document, page, columns, [key]).select(key, "field", "unit")
    # how many fields hold a unit is counted already
    total = units.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    heavy = hot_counted(noisy, ["unit"], "n", total)
    return skew_lookup(rows, noisy, ["unit"], "inner", heavy=heavy).select(key, "field", "kinds", "repaired")
