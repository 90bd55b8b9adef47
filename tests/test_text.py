"""Text rules against plain Python."""

import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import statuses, text, udfs


def one(spark, expression, value, kind="STRING"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).head()[0]


VALUES = [None, "", "  ", "a  b\tc", "STRASSE ß", "µm", "24 .4", "1,234.5", "12 kPa", "2024-01-31", "jan 24", "YES", "SEN-104", "AB12", "ab12", "ABC", "Ω", "x" * 200]


@pytest.mark.parametrize("v", VALUES)
def test_squash_and_fold(spark, v):
    plain = re.sub(r"\s+", " ", v or "").strip()
    assert one(spark, text.squash, v) == plain
    assert one(spark, text.fold, v) == plain.casefold()


@pytest.mark.parametrize(
    ("value", "kind"),
    [(None, "empty"), (" ", "empty"), ("2024-1-3", "date"), ("31/12/24", "date"), ("Mar 2024", "date"), ("1,234.5", "number"), ("-.5e3", "number"), ("12 kPa", "number"), ("Yes", "boolean"), ("SEN-104", "identifier_like"), ("AB12", "identifier_like"), ("hello world", "text"), ("ABC", "text")],
)
def test_value_type(spark, value, kind):
    assert one(spark, text.value_type, value) == kind
    df = spark.createDataFrame([(value,)], "v STRING")
    assert text.with_types(df, "v").head()["kind"] == kind


@pytest.mark.parametrize(("value", "score"), [("SEN-104", 1.0), ("AB12", 0.9), ("ab12", 0.75), ("ABC", 0.55), ("abc", 0.0), ("12", 0.0), ("x" * 121, 0.0), ("", 0.0)])
def test_identifier_score(spark, value, score):
    assert one(spark, text.identifier_score, value) == score


def test_two_dialects_stay_apart(spark):
    assert one(spark, text.is_number, "12 kPa") and not one(spark, text.numeric_like, "12 kPa")
    assert one(spark, text.temporal_like, "2024-05") and not one(spark, text.is_date, "2024-05")
    assert one(spark, text.code_like, "T4 x") and not one(spark, text.identifier_like, "T x 4") is None


def test_numbers_and_skeleton(spark):
    assert one(spark, text.numbers, "24 .4 of A1 and -3") == ["24.4", "-3"]
    assert one(spark, text.skeleton, "24 .4 of A1 and -3") == "# of A1 and #"
    df = spark.createDataFrame([("1.50 bar", "1.5 bar"), ("1 2", "1"), (None, None)], "a STRING, b STRING")
    assert [r[0] for r in df.select(text.numbers_equal(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_mojibake_round_trip(spark):
    for garbled, symbol in text.mojibake():
        assert one(spark, text.repair_mojibake, f"5 {garbled}") == f"5 {symbol}"
    assert one(spark, text.has_mojibake, "5 Î©") and not one(spark, text.has_mojibake, "5 Ω")


def test_comparison_form(spark):
    for a, b in [("24 .4 mm", "24.4 mm"), ("5 um", "5 μm"), ("20℃", "20 °C"), ("a–b", "a-b"), ("3 Ohm", "3 Ω")]:
        assert one(spark, text.comparison_form, a) == one(spark, text.comparison_form, b), (a, b)
    assert one(spark, text.comparison_form, "≥ 5") != one(spark, text.comparison_form, "> 5")


def test_symbols_keep_order(spark):
    assert one(spark, text.technical_symbols, "5% ± 3% (x)") == ["%", "±", "(", ")"]
    assert one(spark, text.high_risk_symbols, "λ ± Ω λ") == ["λ", "±", "Ω"]
    assert not one(spark, text.is_technical, "a-b_c/d:e.f,g")


def test_edit_classes(spark):
    df = spark.createDataFrame([("S0V", "SOV"), ("a", "ab"), ("x", "x")], "a STRING, b STRING")
    got = [[tuple(e) for e in r[0]] for r in df.select(text.edit_classes(F.col("a"), F.col("b"))).collect()]
    assert got == [[(1, "0", "O")], [], []]


def test_ids_drop_no_null_part(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x STRING, y STRING, z STRING")
    ids = [r[0] for r in df.select(text.stable_id(F.col("x"), F.col("y"), F.col("z"))).collect()]
    import hashlib

    assert ids == [hashlib.sha1(b"a\x1f\x1fb").hexdigest(), hashlib.sha1(b"a\x1fb\x1f").hexdigest()]


@pytest.mark.parametrize(
    ("query", "value"),
    [("show everything about SEN-1", "SEN-1"), ("Find all  information about 'A b'", "A b"), ('"data for x"', "data for x"), ("SEN-1", "SEN-1"), ("details for  X ", "X")],
)
def test_query_value(spark, query, value):
    assert one(spark, text.query_value, query) == value


def test_question_words_and_months(spark):
    assert one(spark, text.content_words, "What is the Pressure of the valve?") == ["pressure", "valve"]
    assert one(spark, text.month_of, "in may or May") == 5
    assert one(spark, text.month_of, "from may to june") is None
    assert one(spark, text.month_of, None) is None


def test_pages_and_casts(spark):
    assert [one(spark, text.page_key, v) for v in ("1.0", " 007 ", "xii", None)] == ["1", "7", "xii", ""]
    assert [one(spark, text.safe_double, v) for v in ("1.5", "nan", "inf", "x", None)] == [1.5, None, None, None, None]


def test_statuses(spark):
    df = spark.createDataFrame([("Paragraph", None), (None, 3), ("table_cell", None), (None, None)], "k STRING, b INT")
    assert [r[0] for r in df.select(statuses.object_type(F.col("k"), F.col("b"))).collect()] == ["PARAGRAPH", "PARAGRAPH", "TABLE_CELL", "TABLE_CELL"]
    assert one(spark, statuses.is_uncertain, None) is False and one(spark, statuses.is_uncertain, "unverified") is True


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=1, max_size=8))
def test_fold_is_stable(spark, values):
    values = [v for v in values if "\ud800" > v or True]
    df = spark.createDataFrame([(v.encode("utf-8", "replace").decode(),) for v in values], "v STRING")
    once = df.select(text.fold(F.col("v")).alias("v"))
    assert once.collect() == once.select(text.fold(F.col("v")).alias("v")).collect()


def test_python_functions(spark):
    df = spark.createDataFrame([("é 12±", "kitten", "sitting"), (None, None, None), ("", "", "")], "t STRING, a STRING, b STRING")
    rows = df.select(udfs.nfc("t"), udfs.shape("t"), udfs.structure("t"), udfs.similarity("a", "b"), udfs.tokens("t"), udfs.edits("a", "b")).collect()
    assert rows[0][0] == unicodedata.normalize("NFC", "é 12±")
    assert rows[0][1] == "L1|M:COMBINING ACUTE ACCENT|W1|N2|S:PLUS-MINUS SIGN"
    assert rows[0][3] == SequenceMatcher(None, "kitten", "sitting").ratio()
    assert rows[1][1] == "" and rows[2][3] == 1.0 and rows[2][4] == []
    special = df.select(udfs.special_characters("t")).head()[0]
    assert [c["name"] for c in special] == ["COMBINING ACUTE ACCENT", "PLUS-MINUS SIGN"]
