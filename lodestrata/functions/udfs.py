"""The few text functions Spark has no built-in for, as vectorised UDFs.

Callers filter or take distinct values first: a UDF inside a ``when`` runs on
every row.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLASSES = {"L": "LETTER", "N": "NUMBER", "Z": "SPACE", "S": "SYMBOL", "P": "PUNCTUATION", "M": "MARK", "C": "CONTROL"}


@lru_cache(maxsize=1 << 16)
def _class(c: str) -> str:
    return "SPACE" if c.isspace() else _CLASSES[unicodedata.category(c)[0]]


@lru_cache(maxsize=1 << 16)
def _sign(c: str) -> str:
    """How a character shows in a shape: letters, digits and spaces by a letter, others by class and name."""
    kind = _class(c)
    if kind in ("LETTER", "NUMBER", "SPACE"):
        return {"LETTER": "L", "NUMBER": "N", "SPACE": "W"}[kind]
    return f"{kind[0]}:{unicodedata.name(c, 'UNKNOWN')}" if kind != "CONTROL" else kind


def structure_of(text: str) -> str:
    """One sign for each character."""
    return "|".join("SPACE" if (s := _sign(c)) == "W" else s for c in " ".join(text.split()))


def shape_of(text: str) -> str:
    """Runs of letters, digits and spaces with their length, other characters one by one."""
    out = []
    for sign, run in groupby(" ".join(text.split()), key=_sign):
        n = len(list(run))
        out.extend([f"{sign}{n}"] if len(sign) == 1 else [sign] * n)
    return "|".join(out)


def describe_special(text: str) -> list[dict]:
    """Characters beyond ASCII letters, digits and space, each once, with code point, name and category."""
    odd = dict.fromkeys(c for c in text if not (c.isascii() and (c.isalnum() or c.isspace())))
    return [{"character": c, "code": f"U+{ord(c):04X}", "name": unicodedata.name(c, "UNKNOWN"), "category": unicodedata.category(c)} for c in odd]


def edit_script(a: str, b: str) -> str:
    """The edit script between two texts: operation and the shapes of both sides."""
    steps = SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    return ";".join(f"{op}:{shape_of(a[i:j])}>{shape_of(b[k:m])}" for op, i, j, k, m in steps if op != "equal")


def tokens_of(text: str) -> list[str]:
    """Tokens: numbers whole, letters in runs, every other sign by itself, as kind and length."""
    out = []
    for kind, run in groupby((c for c in text), key=lambda c: "N" if _class(c) == "NUMBER" or c in ".," else _sign(c)):
        if kind == "W":
            continue
        part = "".join(run)
        if kind == "N" and not any(c.isdigit() for c in part):
            out.extend(_sign(c) for c in part)
        else:
            out.append(f"{kind}{len(part)}" if kind in ("L", "N") else kind)
    return out


def _over(function, kind: T.DataType, empty):
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: function(t) if isinstance(t, str) else empty)

    return F.pandas_udf(run, kind)


_SPECIAL = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("character", "code", "name", "category")]))

nfc = _over(lambda t: unicodedata.normalize("NFC", t), T.StringType(), None)
casefold = _over(lambda t: " ".join(t.split()).casefold(), T.StringType(), "")
structure = _over(structure_of, T.StringType(), "")
shape = _over(shape_of, T.StringType(), "")
tokens = _over(tokens_of, T.ArrayType(T.StringType()), [])
special_characters = _over(describe_special, _SPECIAL, [])


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio; null counts as empty, two empty texts are equal."""
    return pd.Series([SequenceMatcher(None, x if isinstance(x, str) else "", y if isinstance(y, str) else "").ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_script(x or "", y or "") for x, y in zip(a, b, strict=True)])
