"""What is verified, empty, uncertain or missing: totals per document and over all."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import statuses, text
from lodestrata.operators import geometry

#: Confidence below this, and above 0, is low; boxes that cover this share of an empty cell are evidence for text.
LOW, BOX_SHARE = 0.80, 0.20
#: A block whose width lies in an empty slot by this share is evidence for text.
SLOT_SHARE = 0.35


def validation_totals(cells: DataFrame) -> DataFrame:
    """Cells, empty ones, statuses to review, uncertain and low-confidence ones per document, and for all as null document."""
    c = F.col
    count = lambda condition: F.count(F.when(condition, 1))
    rolled = cells.rollup("document_id").agg(
        F.grouping("document_id").alias("is_total"),
        F.count(F.lit(1)).alias("n_cells"),
        count(text.squash(c("value")) == "").alias("n_empty"),
        count(c("verification_status").isNull()).alias("n_unverified"),
        count(statuses.needs_review(c("verification_status"))).alias("n_review"),
        count(statuses.is_uncertain(c("verification_status"))).alias("n_uncertain"),
        count((c("source_ocr_confidence") > 0) & (c("source_ocr_confidence") < LOW)).alias("n_low_confidence"),
    )
    return rolled.withColumn("is_total", F.col("is_total") == 1)


def status_histogram(cells: DataFrame) -> DataFrame:
    return cells.groupBy(F.coalesce("verification_status", F.lit("NONE")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def coverage(expected: DataFrame, found: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """(owner, n_expected, n_found, n_missing, complete): how much of what is expected was found."""
    marked = expected.select(owner, *keys).distinct().join(found.select(*keys).distinct().withColumn("_found", F.lit(1)), keys, "left")
    sums = marked.groupBy(owner).agg(F.count(F.lit(1)).alias("n_expected"), F.count("_found").alias("n_found"))
    return sums.withColumns({"n_missing": F.col("n_expected") - F.col("n_found"), "complete": F.col("n_expected") == F.col("n_found")})


def empty_cells_with_evidence(cells: DataFrame, blocks: DataFrame, on: list[str], key: str) -> DataFrame:
    """Empty cells that a block of text on their page covers: their text was lost, not absent."""
    empty = cells.where((text.squash(F.col("text")) == "") & F.col("bbox").isNotNull())
    seen = blocks.where((text.squash(F.col("text")) != "") & F.col("bbox").isNotNull()).select(*on, F.col("bbox").alias("_box")).distinct()
    hit = empty.join(seen, on).where(geometry.overlap_of_first(F.col("_box"), F.col("bbox")) >= BOX_SHARE)
    return empty.join(hit.select(key).distinct(), key, "left_semi")


def empty_slots_with_evidence(cells: DataFrame, blocks: DataFrame, on: list[str], key: str) -> DataFrame:
    """Empty cells without a box in whose slot a block of text on their page lies: ``slot`` is a box, open sides null.

    A block lies there when its centre does and SLOT_SHARE of its width.
    """
    empty = cells.where((text.squash(F.col("text")) == "") & F.col("bbox").isNull() & F.col("slot").isNotNull())
    seen = blocks.where((text.squash(F.col("text")) != "") & F.col("bbox").isNotNull()).select(*on, F.col("bbox").alias("_box")).distinct()
    side = lambda i: F.coalesce(F.col("slot")[i], F.lit(-math.inf if i < 2 else math.inf))
    c = geometry.centre(F.col("_box"))
    inside = (c["x"] >= side(0)) & (c["x"] <= side(2)) & (c["y"] >= side(1)) & (c["y"] <= side(3))
    width = F.col("_box")[2] - F.col("_box")[0]
    shared = F.greatest(F.lit(0.0), F.least(F.col("_box")[2], side(2)) - F.greatest(F.col("_box")[0], side(0))) / F.greatest(F.lit(1.0), width)
    return empty.join(empty.join(seen, on).where(inside & (shared >= SLOT_SHARE)).select(key).distinct(), key, "left_semi")
