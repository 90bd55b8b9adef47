"""Upkeep over the project tables: stale outputs, histograms, jobs, names over versions, regions of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import statuses, text
from lodestrata.operators import geometry, merge, quality
from lodestrata.plans import sqltext as q
from lodestrata.sources import documents
from lodestrata.sources.cells import value_cells
from lodestrata.sources.tables import table


def snk5_stale_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """SNK5: entries of the retrieval index whose entity is retired or gone, listed and not deleted."""
    active = table(spark, folder, "entities").where("retired_at IS NULL")
    return merge.stale(table(spark, folder, "entity_retrieval_index").where("entity_id IS NOT NULL").select("entity_id").distinct(), active, "entity_id")


def agg11_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """AGG11: cells of each verification status."""
    return quality.status_histogram(value_cells(spark, folder))


def f32_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """F32: cells by whether their status settles them, per document."""
    done = statuses.is_resolved(F.col("verification_status"))
    return value_cells(spark, folder).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(done, 1)).alias("n_resolved"))


def f31_captions(spark: SparkSession, folder: str) -> DataFrame:
    """documents that name a figure, with the start of their text."""
    rows = table(spark, folder, "documents").where(text.is_figure_caption(F.col("text")))
    return rows.select("doc_id", text.compact(F.col("text"), 60).alias("start"))


def src16_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """SRC16: the last known state of each review job."""
    runs = table(spark, folder, "manual_review_decisions").where("job_id IS NOT NULL")
    return documents.job_catalog(runs.select("job_id", F.col("decision_id").alias("stage"), F.col("decision").alias("status"), F.col("loaded_at").alias("at")))


def src11_texts(spark: SparkSession, folder: str) -> DataFrame:
    """SRC11, SRC17: the text of each decision under the first of its names that is not blank, and where its page's image lies."""
    rows = table(spark, folder, "manual_review_decisions")
    page = text.page_key(F.col("page")).try_cast("int")
    return rows.select("decision_id", documents.coalesced(["verified_text", "source_text", "original_text"], F.lit("(none)")).alias("text"), documents.page_image(F.col("document"), page).alias("image"))


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "manual_review_decisions").withColumn("bbox", geometry.normal_box(F.col("bbox")))
    rows = rows.select("decision_id", text.label(F.col("document")).alias("document"), text.page_key(F.col("page")).alias("page"), "bbox", statuses.object_type(F.col("object_type"), F.col("paragraph_block")).alias("kind"))
    return rows.where("bbox IS NOT NULL")


def g5_outside(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs whose centre lies in no cell of their page."""
    rows = _boxes(spark, folder)
    cells = rows.where("kind = 'TABLE_CELL'").select("document", "page", "bbox").distinct()
    return geometry.outside_regions(rows.where("kind = 'PARAGRAPH'"), cells, ["document", "page"]).select("decision_id")


def g22_kept_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes that no box of higher priority on their page covers by half: cells come before paragraphs."""
    rows = _boxes(spark, folder).withColumn("priority", F.when(F.col("kind") == "TABLE_CELL", 2).otherwise(1))
    return geometry.suppress_overlaps(rows, ["document", "page"], "decision_id", "priority", 0.50).select("decision_id", "kind")


QUERIES = {name: f for name, f in globals().copy().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}

_NUMBER = f"TRY_CAST({q.squash('page')} AS DOUBLE)"
_PAGE = f"CASE WHEN {_NUMBER} = floor({_NUMBER}) THEN CAST(CAST({_NUMBER} AS BIGINT) AS VARCHAR) ELSE {q.squash('page')} END"
_BOXES = f"""WITH b AS (SELECT decision_id, {q.label("document")} AS document, {_PAGE} AS page,
    CASE WHEN contains(upper({q.squash("object_type")}), 'PARAGRAPH') THEN 'PARAGRAPH' WHEN contains(upper({q.squash("object_type")}), 'CELL') OR contains(upper({q.squash("object_type")}), 'TABLE') THEN 'TABLE_CELL'
      WHEN paragraph_block IS NOT NULL THEN 'PARAGRAPH' ELSE 'TABLE_CELL' END AS kind,
    least(bbox[1], bbox[3]) AS x1, least(bbox[2], bbox[4]) AS y1, greatest(bbox[1], bbox[3]) AS x2, greatest(bbox[2], bbox[4]) AS y2
  FROM manual_review_decisions WHERE len(bbox) = 4 AND NOT list_contains(list_transform(bbox, lambda v: v IS NULL), true))
"""

SQL = {
    "snk5_stale_outputs": "SELECT DISTINCT entity_id FROM entity_retrieval_index WHERE entity_id IS NOT NULL AND entity_id NOT IN (SELECT entity_id FROM entities WHERE retired_at IS NULL AND entity_id IS NOT NULL)",
    "agg11_histogram": q.CELLS + " SELECT coalesce(verification_status, 'NONE') AS status, count(*) AS n FROM cell GROUP BY 1",
    "f32_resolved": q.CELLS
    + f""", s AS (SELECT document_id, upper({q.squash("verification_status")}) AS s FROM cell)
      SELECT document_id, count(*) AS n, count(*) FILTER (starts_with(s, 'SOURCE_VERIFIED') OR suffix(s, '_VERIFIED') OR starts_with(s, 'USER_') OR s = 'EMPTY_STRUCTURAL_CELL') AS n_resolved FROM s GROUP BY 1""",
    "f31_captions": r"""SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 59) || '…' ELSE text END AS start FROM documents WHERE regexp_matches(text, '(?i)\b(figure|fig\.)\s*[a-z0-9]+\b')""",
    "src16_jobs": """SELECT job_id, arg_max(decision_id, (loaded_at, decision_id)) AS stage, arg_max(coalesce(decision, '∅'), (loaded_at, decision_id)) AS status, min(loaded_at) AS created_at, max(loaded_at) AS updated_at
      FROM manual_review_decisions WHERE job_id IS NOT NULL GROUP BY job_id""",
    "src11_texts": f"""SELECT decision_id, coalesce(nullif(trim(verified_text), ''), nullif(trim(source_text), ''), nullif(trim(original_text), ''), '(none)') AS text,
      document || '/page_' || printf('%04d', TRY_CAST({_PAGE} AS INTEGER)) || '.png' AS image FROM manual_review_decisions""",
    "g5_outside": _BOXES
    + """SELECT decision_id FROM b a WHERE kind = 'PARAGRAPH' AND NOT EXISTS (SELECT 1 FROM b r WHERE r.kind = 'TABLE_CELL' AND r.document = a.document AND r.page = a.page
        AND (a.x1 + a.x2) / 2 BETWEEN r.x1 AND r.x2 AND (a.y1 + a.y2) / 2 BETWEEN r.y1 AND r.y2)""",
    "g22_kept_regions": _BOXES
    + """SELECT decision_id, kind FROM b a WHERE NOT (kind = 'PARAGRAPH' AND EXISTS (SELECT 1 FROM b r WHERE r.kind = 'TABLE_CELL' AND r.document = a.document AND r.page = a.page
        AND greatest(0, least(a.x2, r.x2) - greatest(a.x1, r.x1)) * greatest(0, least(a.y2, r.y2) - greatest(a.y1, r.y1)) / nullif(least((a.x2 - a.x1) * (a.y2 - a.y1), (r.x2 - r.x1) * (r.y2 - r.y1)), 0) >= 0.50))""",
}
