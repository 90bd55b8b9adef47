"""Status words and the predicates over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.text import squash

# Decisions that a person made.
HUMAN = ["USER_CONFIRMED_ORIGINAL", "USER_CONFIRMED_SOURCE", "USER_ENTERED_CORRECTION", "USER_CORRECTION"]
# Decisions that a rule made.
AUTOMATIC = [
    "EXACT_CASE_REUSED", "CONTEXT_PATTERN_REUSED", "OCR_TRANSFORMATION_PATTERN_REUSED", "STRUCTURAL_PATTERN_REUSED", "LEARNED_GENERALIZED_TRANSFORMATION",
    "LEARNED_STRUCTURAL_CONTEXT", "AGREEMENT_PATTERN_REUSED", "LEARNED_CROSS_CONTEXT_TRANSFORMATION", "LEARNED_CROSS_CONTEXT_STRUCTURAL",
]
# Verification results that need a review.
REVIEW = ["HIGH_RISK_SYMBOL_REVIEW", "HIGH_RISK_AGREEMENT_REVIEW", "NUMERIC_DISAGREEMENT", "SOURCE_DISAGREEMENT", "SOURCE_EMPTY", "NO_SOURCE_IMAGE"]
# Verification results that make a compared value uncertain.
UNCERTAIN = [
    "HIGH_RISK_AGREEMENT_REVIEW", "REQUIRES_VISUAL_REVIEW", "AMBIGUOUS", "CONFLICTING_EVIDENCE", "NUMERIC_DISAGREEMENT", "UNVERIFIED", "LOW_CONFIDENCE",
]
# Where a document's source stands.
CURRENT, HISTORICAL, UNKNOWN = "CURRENT", "SOURCE_MISSING_HISTORICAL", "UNKNOWN"


def status(c: Column) -> Column:
    return F.upper(squash(c))


def is_human(decision: Column) -> Column:
    return F.coalesce(status(decision).isin(HUMAN), F.lit(False))


def is_automatic(decision: Column) -> Column:
    return F.coalesce(status(decision).isin(AUTOMATIC) | status(decision).endswith("_REUSED"), F.lit(False))


def needs_review(verification: Column) -> Column:
    return F.coalesce(status(verification).isin(REVIEW), F.lit(False))


def is_uncertain(verification: Column) -> Column:
    return F.coalesce(status(verification).isin(UNCERTAIN), F.lit(False))


def is_resolved(verification: Column) -> Column:
    """Verified, confirmed or entered by a person, or an empty cell of the layout."""
    s = status(verification)
    return F.coalesce(s.startswith("SOURCE_VERIFIED") | s.endswith("_VERIFIED") | s.startswith("USER_") | s.isin("EMPTY_STRUCTURAL_CELL"), F.lit(False))


def object_type(kind: Column, paragraph_block: Column) -> Column:
    """TABLE_CELL or PARAGRAPH, whatever spelling; without one, by whether a paragraph block is named."""
    s = status(kind)
    return F.when(s.contains("PARAGRAPH"), "PARAGRAPH").when(s.contains("CELL") | s.contains("TABLE"), "TABLE_CELL").otherwise(F.when(paragraph_block.isNotNull(), "PARAGRAPH").otherwise("TABLE_CELL"))


def chosen_text(decision: Column, original: Column, source: Column, entered: Column) -> Column:
    """The text that a decision settles on."""
    s = status(decision)
    return F.when(s == "USER_CONFIRMED_ORIGINAL", original).when(s == "USER_CONFIRMED_SOURCE", source).otherwise(entered)


def action(decision: Column) -> Column:
    """original, source, or null for an entered text."""
    s = status(decision)
    return F.when(s == "USER_CONFIRMED_ORIGINAL", "original").when(s == "USER_CONFIRMED_SOURCE", "source")
