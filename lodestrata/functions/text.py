"""Text rules as native column expressions, shared by the side that writes an index and the side that reads it."""

from __future__ import annotations

from calendar import month_name
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that carry technical meaning and are read wrongly at a cost.
HIGH_RISK = "Ωω±∓≥≤Δ∆μµ°→↔≠≈≅×÷∞∑√∂∫∇λθφσταβγδεηκπχψξζ∈∉⊂⊃∩∪"
# Signs that stand for the same dash.
DASHES = "–—−‒﹘﹣－"
# Marks that separate the parts of ordinary values.
SEPARATORS = "-_/:.,"
# Words that say nothing about the field a question asks for.
STOP_WORDS = [
    "what", "which", "when", "where", "show", "give", "tell", "find", "get", "the", "for", "from", "with", "about", "does", "did", "was",
    "were", "are", "is", "of", "in", "on", "to", "and", "me", "please", "value", "record", "document",
]
# Phrases that may stand before the value a question is about, tried in this order.
PHRASES = [
    "show everything about", "find all information about", "find information about", "all information about", "show all about", "everything about",
    "details for", "information on", "information about", "details about", "data for",
]
# Words that a boolean is written with.
BOOLEANS = ["yes", "no", "true", "false", "y", "n"]

_MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_PLAIN_NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
#: A number standing by itself, not inside an identifier.
STANDALONE_NUMBER = r"(?<![A-Za-z_])[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?![A-Za-z_])"


def mojibake(symbols: str = HIGH_RISK + "–—‘’“") -> list[tuple[str, str]]:
    """(garbled, symbol): what the UTF-8 bytes of a symbol look like when read as Windows-1252, longest first."""
    pairs = []
    for s in symbols:
        try:
            pairs.append((s.encode("utf-8").decode("cp1252"), s))
        except UnicodeDecodeError:
            continue
    return sorted(pairs, key=lambda p: (-len(p[0]), p[0]))


def squash(c: Column) -> Column:
    """White space of any script as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """The key that values are matched by: ``squash`` without letter case."""
    return F.translate(F.replace(F.lower(squash(c)), F.lit("ß"), F.lit("ss")), "ςµ", "σμ")


def label(c: Column) -> Column:
    """The key that headers are matched by: letters and digits only, a degree sign as a word."""
    spelled = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("°"), F.lit(" degree "))
    return F.trim(F.regexp_replace(spelled, r"(?U)[\W_]+", " "))


def engine_text(c: Column) -> Column:
    """Text for the comparison of two engines: without table rules, case and runs of space."""
    return F.lower(squash(F.regexp_replace(F.coalesce(c, F.lit("")), "[|¦]", " ")))


def repair_mojibake(c: Column) -> Column:
    """Symbols in place of what their bytes look like when read as Windows-1252; texts without such letters are not touched."""
    repaired = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), mojibake(), c)
    repaired = F.replace(F.replace(repaired, F.lit("°℃"), F.lit("°C")), F.lit("℃"), F.lit("°C"))
    return F.coalesce(F.when(c.rlike("[ÂÃÎÏâ℃]"), repaired).otherwise(c), F.lit(""))


def has_mojibake(c: Column) -> Column:
    return F.coalesce(c.rlike("|".join(rf"\Q{garbled}\E" for garbled, _ in mojibake())), F.lit(False))


def comparison_form(c: Column) -> Column:
    """The form in which harmless differences of writing are gone: units, dashes, space in decimals and before % and °C."""
    t = repair_mojibake(squash(c))
    for old, new in (("μm", "µm"), ("um", "µm"), ("Ohm", "Ω"), ("ohm", "Ω")):
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.translate(t, DASHES, "-" * len(DASHES))
    t = F.regexp_replace(t, r"(?<=\d)\s*\.\s*(?=\d)", ".")
    t = F.regexp_replace(F.regexp_replace(t, r"\s*°\s*C\b", " °C"), r"\s*%\b", "%")
    return fold(t)


def _number(t: Column) -> Column:
    cleaned = F.trim(F.replace(F.translate(t, "−–", "--"), F.lit(","), F.lit("")))
    return cleaned.rlike(rf"^{_PLAIN_NUMBER}(?:\s*[^\d\s]{{1,8}})?$")


def _date(t: Column) -> Column:
    return t.rlike(rf"^(?:\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}|\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2,4}}|(?i:{_MONTH}[- /]\d{{2,4}}))$")


def _identifier(t: Column, plain: Column) -> Column:
    digit, upper = t.rlike(r"\d"), F.upper(t) == t
    return (
        F.when((t == "") | (F.length(t) > 120) | plain, 0.0)
        .when(t.rlike(r"^[A-Za-z0-9]+(?:[-_/.:][A-Za-z0-9]+)+$"), 1.0)
        .when(~t.rlike(r"^[A-Za-z0-9]{2,32}$"), 0.0)
        .when(digit & upper, 0.9)
        .when(digit, 0.75)
        .when(upper & (F.length(t) <= 12), 0.55)
        .otherwise(0.0)
    )


def is_number(c: Column) -> Column:
    """A number with grouping marks, or one followed by a short unit."""
    return _number(squash(c))


def is_date(c: Column) -> Column:
    return _date(squash(c))


def is_boolean(c: Column) -> Column:
    return fold(c).isin(BOOLEANS)


def identifier_score(c: Column) -> Column:
    """How much a value is shaped like a code: 1, 0.9, 0.75, 0.55 or 0."""
    return _identifier(squash(c), is_number(c) | is_date(c))


def value_type(c: Column) -> Column:
    return (
        F.when(squash(c) == "", "empty")
        .when(is_date(c), "date")
        .when(is_number(c), "number")
        .when(is_boolean(c), "boolean")
        .when(identifier_score(c) >= 0.75, "identifier_like")
        .otherwise("text")
    )


def with_types(df: DataFrame, column: str) -> DataFrame:
    """``df`` with kind, score, code (score of a code) and number of a column, built step by step so no rule is repeated."""
    t = F.col("_t")
    steps = df.withColumn("_t", squash(F.col(column))).withColumns({"number": _number(t), "_date": _date(t)})
    steps = steps.withColumn("score", _identifier(t, F.col("number") | F.col("_date"))).withColumn("code", F.col("score") >= 0.75)
    kind = F.when(t == "", "empty").when(F.col("_date"), "date").when(F.col("number"), "number").when(is_boolean(t), "boolean").when(F.col("code"), "identifier_like")
    return steps.withColumn("kind", kind.otherwise("text")).drop("_t", "_date")


def numeric_like(c: Column) -> Column:
    """The candidate dialect: what reads as a float once grouping marks and some signs are gone."""
    t = F.regexp_replace(F.regexp_replace(squash(c), ",", ""), "[%°±Ωμλ∆]", "")
    return t.rlike(r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:nan|inf(?:inity)?))\s*$")


def temporal_like(c: Column) -> Column:
    """The candidate dialect of dates, years with months among them."""
    return F.lower(squash(c)).rlike(rf"^(?:\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}|\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{4}}|{_MONTH}[a-z]*[- ]\d{{4}}|\d{{4}}[-/]\d{{1,2}})$")


def code_like(c: Column) -> Column:
    """The candidate dialect of identifiers: letters with digits, or two compact parts."""
    t = squash(c)
    mixed = t.rlike("[A-Za-z]") & t.rlike(r"(?U)\d") & (F.length(t) <= 80)
    return (t != "") & ~numeric_like(c) & ~temporal_like(c) & (mixed | t.rlike(r"^[A-Za-z]{1,12}[-_/][A-Za-z0-9]{1,24}$"))


def identifier_like(c: Column) -> Column:
    """The verification dialect: letter and digit, and a separator or a change between the two."""
    t = F.coalesce(c, F.lit(""))
    return t.rlike("[A-Za-z]") & t.rlike(r"\d") & (t.rlike(r"[_:/.\-]") | t.rlike(r"[A-Za-z]\d|\d[A-Za-z]"))


def _tight_decimals(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<=\d)\s*\.\s*(?=\d)", ".")


def numbers(c: Column) -> Column:
    """The standalone numbers of a text, as written."""
    return F.regexp_extract_all(_tight_decimals(c), F.lit(STANDALONE_NUMBER), F.lit(0))


def numbers_equal(a: Column, b: Column) -> Column:
    """Whether two texts have the same standalone numbers in the same order, up to 1e-12."""
    near = F.forall(F.arrays_zip(numbers(a).alias("x"), numbers(b).alias("y")), lambda p: F.abs(p["x"].cast("double") - p["y"].cast("double")) <= 1e-12)
    return (F.size(numbers(a)) == F.size(numbers(b))) & near


def skeleton(c: Column) -> Column:
    """A text with ``#`` in place of each standalone number."""
    return F.regexp_replace(_tight_decimals(c), STANDALONE_NUMBER, "#")


def _distinct_characters(c: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0)))


#: Neither letter, digit, white space nor a separator of ordinary values.
TECHNICAL = rf"(?U)[^\s\p{{L}}\p{{N}}{SEPARATORS.replace('-', '')}\-]"


def technical_symbols(c: Column) -> Column:
    """The technical characters of a text, each once, in the order they come."""
    return _distinct_characters(c, TECHNICAL)


def high_risk_symbols(c: Column) -> Column:
    return _distinct_characters(c, f"[{HIGH_RISK}]")


def special_signature(c: Column) -> Column:
    """The code points of a text's signs, marks and punctuation beyond ASCII, in the order they come."""
    found = F.regexp_extract_all(squash(c), F.lit(r"[\p{S}\p{P}\p{M}&&[^\x00-\x7f]]"), F.lit(0))
    code = lambda s: F.hex(F.ascii(s))
    return F.array_join(F.transform(found, lambda s: F.concat(F.lit("U+"), F.when(F.length(code(s)) < 4, F.lpad(code(s), 4, "0")).otherwise(code(s)))), "|")


def is_technical(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(TECHNICAL)


def is_high_risk(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(f"[{HIGH_RISK}]") | has_mojibake(c)


def character_class(c: Column) -> Column:
    """Class of one character by its Unicode category."""
    classes = [("LETTER", r"\p{L}"), ("NUMBER", r"\p{N}"), ("SPACE", r"\p{Z}|\s"), ("SYMBOL", r"\p{S}"), ("PUNCTUATION", r"\p{P}"), ("MARK", r"\p{M}"), ("CONTROL", r"\p{C}")]
    return reduce(lambda w, x: w.when(c.rlike(rf"(?U)^(?:{x[1]})$"), x[0]), classes[1:], F.when(c.rlike(rf"^{classes[0][1]}$"), classes[0][0])).otherwise("OTHER")


def class_string(c: Column) -> Column:
    """A text with L for each letter, N for each digit and W for each white space; other characters stay."""
    t = F.regexp_replace(squash(c), r"\p{L}", "L")
    return F.regexp_replace(F.regexp_replace(t, r"\p{N}", "N"), r"(?U)[\s\p{Z}]", "W")


def edit_classes(a: Column, b: Column) -> Column:
    """(position, from, to) of the places where two texts of one length differ; empty for texts of other lengths."""
    x, y = F.split(squash(a), ""), F.split(squash(b), "")
    pairs = F.transform(F.arrays_zip(x.alias("a"), y.alias("b")), lambda p, i: F.struct(i.alias("position"), p["a"].alias("from"), p["b"].alias("to")))
    changed = F.filter(pairs, lambda p: p["from"] != p["to"])
    return F.when(F.length(squash(a)) == F.length(squash(b)), changed).otherwise(F.slice(changed, 1, 0))


def stable_id(*parts: Column) -> Column:
    """SHA-1 of the normalised parts, a null part as empty, joined by the unit separator."""
    return F.sha1(F.concat_ws("\u001f", *(squash(p.cast("string")) for p in parts)))


def entity_id(value: Column) -> Column:
    return F.concat(F.lit("entity_"), F.substring(F.sha1(fold(value)), 1, 24))


def rule_key(*parts: Column) -> Column:
    """The one key that rules are written and looked up by."""
    return F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def safe_double(c: Column) -> Column:
    """A finite double, else null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def first_text(*columns: Column) -> Column:
    """The first of the texts that isn't blank, as squashed; empty if there is none."""
    return F.coalesce(*(F.nullif(squash(c), F.lit("")) for c in columns), F.lit(""))


def page_key(c: Column) -> Column:
    """A page as written in keys: whole numbers without decimals, other text as it is."""
    t = squash(c.cast("string"))
    d = t.try_cast("double")
    return F.when((d == F.floor(d)) & (F.abs(d) < 1e15), F.floor(d).cast("bigint").cast("string")).otherwise(t)


def query_value(c: Column) -> Column:
    """The value that a query names, without command phrase and enclosing quotes."""
    quoted = r"""^(['"])(.*)\1$"""
    phrase = r"(?i)^(?:" + "|".join(p.replace(" ", r"\s+") for p in PHRASES) + r")\s+(.+)$"
    text = F.trim(c)
    unquoted = lambda t: F.trim(F.regexp_replace(t, quoted, "$2"))
    return F.when(text.rlike(quoted), unquoted(text)).otherwise(unquoted(F.regexp_replace(text, phrase, "$1")))


def content_words(c: Column) -> Column:
    """The words of a question or header that may name a field, each once."""
    words = F.array_distinct(F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.filter(F.array_except(words, F.array(*map(F.lit, STOP_WORDS))), lambda w: F.length(w) > 1)


def months() -> dict[str, int]:
    names = {m.lower(): i for i, m in enumerate(month_name) if m}
    return names | {m[:3]: i for m, i in names.items()}


def month_of(c: Column) -> Column:
    """The month that a text names, null where it names none or several."""
    known = F.create_map(*(x for name, n in months().items() for x in (F.lit(name), F.lit(n))))
    words = F.regexp_extract_all(fold(c), F.lit("[a-z]+"), F.lit(0))
    named = F.array_distinct(F.array_compact(F.transform(words, lambda w: F.try_element_at(known, w))))
    # bound to a lambda's argument, the array is computed once
    return F.transform(F.array(named), lambda m: F.when(F.size(m) == 1, F.get(m, F.lit(0))))[0]


def is_figure_caption(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?i)\b(?:figure|fig\.)\s*[a-z0-9]+\b")


def compact(c: Column, most: int) -> Column:
    """At most ``most`` characters of a text, an ellipsis where some are missing."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)
