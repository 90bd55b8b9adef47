"""Two readings of the same place against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.functions.udfs import similarity

#: Similarity of readings that count as agreeing, as close, and confidence below which another reading wins.
AGREE, NEAR, CLOSE, LOW_CONFIDENCE = 0.95, 0.80, 0.85, 0.85


def agreement_status(ratio: Column, primary: Column, secondary: Column, confidence: Column) -> Column:
    """What two engines say about one cell, from the similarity of their texts."""
    empty = (text.squash(primary) == "") & (text.squash(secondary) == "")
    return (
        F.when(empty, "EMPTY")
        .when(ratio >= AGREE, "VERIFIED")
        .when(ratio >= NEAR, "REVIEW")
        .when((confidence < LOW_CONFIDENCE) & (text.squash(secondary) != ""), "LOW_CONFIDENCE")
        .otherwise("DISAGREEMENT")
    )


def rule_decision(a: Column, b: Column, original: Column, source: Column, paragraph: Column) -> Column:
    """The decision that the rules before similarity reach, in their order; null where only similarity can decide.

    ``a`` and ``b`` are the comparison forms of the readings. Paragraphs have no
    rule for identifiers and none for equal numbers in the same frame.
    """
    symbols = text.is_high_risk(original) | text.is_technical(original) | text.is_high_risk(source) | text.is_technical(source)
    return (
        F.when(b == "", "SOURCE_EMPTY")
        .when((a == b) & (text.has_mojibake(original) | text.has_mojibake(source)), "HIGH_RISK_AGREEMENT_REVIEW")
        .when(a == b, "SOURCE_VERIFIED")
        .when(symbols, "HIGH_RISK_SYMBOL_REVIEW")
        .when(~paragraph & (text.identifier_like(original) | text.identifier_like(source)), "SOURCE_DISAGREEMENT")
        .when(~text.numbers_equal(original, source), "NUMERIC_DISAGREEMENT")
        .when(~paragraph & (text.fold(text.skeleton(original)) == text.fold(text.skeleton(source))), "SOURCE_VERIFIED_CLOSE")
    )


def verify(pairs: DataFrame, original: str, source: str, paragraph: Column) -> DataFrame:
    """``pairs`` with ``verification``; the similarity UDF sees only the distinct pairs that no rule decides.

    The text that is kept is always the original.
    """
    formed = pairs.withColumns({"_a": text.comparison_form(F.col(original)), "_b": text.comparison_form(F.col(source))})
    ruled = formed.withColumn("verification", rule_decision(F.col("_a"), F.col("_b"), F.col(original), F.col(source), paragraph))
    decided, open_ = ruled.where("verification IS NOT NULL"), ruled.where("verification IS NULL")
    compared = open_.select("_a", "_b").distinct().withColumn("_ratio", similarity("_a", "_b"))
    close = F.when(F.col("_ratio") >= CLOSE, "SOURCE_VERIFIED_CLOSE").otherwise("SOURCE_DISAGREEMENT")
    closed = open_.join(compared, ["_a", "_b"]).withColumn("verification", close).select(ruled.columns)
    return decided.unionByName(closed).drop("_a", "_b")


def consensus(variants: Column) -> Column:
    """The most frequent non-empty text of an array of readings, the first read on a tie; empty if there is none."""
    read = F.filter(F.transform(variants, text.squash), lambda t: t != "")
    counted = F.transform(F.array_distinct(read), lambda t: F.struct(F.size(F.filter(read, lambda x: x == t)).alias("n"), (-F.array_position(read, t)).alias("first"), t.alias("t")))
    return F.coalesce(F.array_max(counted)["t"], F.lit(""))


def mean_confidence(confidences: Column) -> Column:
    """The mean of the confidences that are not negative; 0 without any."""
    known = F.filter(confidences, lambda c: c >= 0)
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda t, c: t + c) / F.size(known)).otherwise(0.0)


def escalated(pairs: DataFrame, original: str, fast: str) -> DataFrame:
    """The rows whose first, fast reading does not agree: only these get the slower readings."""
    return pairs.where(text.comparison_form(F.col(original)) != text.comparison_form(F.col(fast)))


def structural_empty(value: Column, box: Column) -> Column:
    """A cell of the layout only: neither text nor place."""
    return (text.squash(value) == "") & box.isNull()
