"""Comparison, verification, learning, review, questions, geometry and quality over the project tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import statuses, text
from lodestrata.operators import diff, geometry, learn, merge, quality, query, review, verify
from lodestrata.operators.profile import column_profiles  # noqa: F401
from lodestrata.plans import sqltext as q
from lodestrata.session import materialize
from lodestrata.sources.cells import fields_of, value_cells
from lodestrata.sources.tables import table


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The fields of records, and the fields that the retrieval index has of the same records."""
    left = fields_of(spark, folder).select("record_id", "table_id", "header", "column_index", "value", F.lit(None).cast("string").alias("verification_status"))
    index = table(spark, folder, "entity_retrieval_index").select(F.explode("records").alias("r")).where("r IS NOT NULL")
    right = index.select("r.record_id", "r.table_id", F.col("r.provenance.verification_status").alias("verification_status"), F.explode("r.fields").alias("f")).where("f IS NOT NULL")
    right = right.select("record_id", "table_id", "f.header", "f.column_index", "f.value", "verification_status")
    flat = lambda side: diff.flatten_side(side, F.col("record_id"), F.col("table_id"))
    return flat(left), flat(right)


def j5_table_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of the records against those of the retrieval index, by record."""
    return diff.diff_cells(*_sides(spark, folder)).select("row_key", "header", "left_value", "right_value", "status", "value_relation", "repeated_key")


def agg13_diff_summary(spark: SparkSession, folder: str) -> DataFrame:
    """AGG13: number of cells of every status of the comparison."""
    return diff.summary(diff.diff_cells(*_sides(spark, folder)))


def j5_row_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Status of every row of the comparison, counted."""
    left, right = (materialize(s, "side") for s in _sides(spark, folder))
    return diff.summary(diff.diff_rows(diff.diff_cells(left, right), left, right))


def s3_header_sets(spark: SparkSession, folder: str) -> DataFrame:
    """S3: headers of both sides and of one."""
    return diff.header_sets(*_sides(spark, folder))


def j6_table_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Tables of each document in the records matched with those of the entity links, by their headers; unmatched ones of both sides are REMOVED or ADDED."""
    own = fields_of(spark, folder).select("document_id", "table_id", text.label(F.col("header")).alias("header"))
    links = table(spark, folder, "entity_links").select("document_id", "table_id", text.label(F.col("header")).alias("header")).where("table_id IS NOT NULL")
    return diff.match_all_tables(own.distinct(), links.distinct(), ["document_id"])


def s1_index_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The current records merged with the previous index; documents without current records are historical."""
    rows = table(spark, folder, "records").select("record_id", "document_id", "page", "table_id", "source_status").distinct()
    current = rows.where("source_status = 'CURRENT'")
    merged = merge.merge_index(rows, current)
    return merged.groupBy("source_status", "document_id").agg(F.count(F.lit(1)).alias("n"))


def s2_state_diff(spark: SparkSession, folder: str) -> DataFrame:
    """First against last state of every occurrence, by content hash."""
    rows = table(spark, folder, "value_index").withColumn("sha", F.sha2(F.concat_ws("\u001f", F.coalesce("value", F.lit("")), F.coalesce("verification_status", F.lit(""))), 256))
    state = lambda f: rows.groupBy("occurrence_id").agg(f("sha", F.struct("loaded_at", "sha")).alias("sha"))
    return merge.state_diff(state(F.min_by), state(F.max_by), "occurrence_id", "sha")


_LEDGER = ["document", "page", "object_type", "original_text", "source_text", "verified_text", "decision"]


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    payload = ", ".join(f"{c} STRING" for c in _LEDGER)
    lines = table(spark, folder, "ledger_lines").select("decision_id", F.from_json("payload", payload).alias("p")).select("decision_id", "p.*")
    return lines.withColumn("page", text.page_key(F.col("page")))


def s6_insert_absent(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger lines that the decisions lack, by document, page and texts."""
    base = table(spark, folder, "manual_review_decisions").select("decision_id", *_LEDGER).withColumn("page", text.page_key(F.col("page")))
    keys = ["document", "page", "original_text", "source_text", "verified_text", "decision"]
    return merge.insert_absent(base, _lines(spark, folder), keys).select("decision_id")


def s7_ledger_union(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of both ledgers in one shape, identical ones once, counted per decision."""
    base = table(spark, folder, "manual_review_decisions").select("decision_id", *_LEDGER).withColumn("page", text.page_key(F.col("page")))
    return merge.ledger_union(base, _lines(spark, folder)).groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document").alias("n_documents"))


def p3_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Verification of every decision's readings."""
    rows = table(spark, folder, "manual_review_decisions").select("decision_id", "original_text", "source_text", statuses.object_type(F.col("object_type"), F.col("paragraph_block")).alias("kind"))
    return verify.verify(rows, "original_text", "source_text", F.col("kind") == "PARAGRAPH").select("decision_id", "kind", "verification")


def agg20_verification_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """AGG20: number of decisions of each verification result."""
    return p3_rules(spark, folder).groupBy("kind", "verification").agg(F.count(F.lit(1)).alias("n"))


def p1_engine_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of two readings of a cell, the ratio of distinct pairs only."""
    from lodestrata.functions.udfs import similarity

    a, b = text.engine_text(F.col("original_text")), text.engine_text(F.col("source_text"))
    rows = table(spark, folder, "manual_review_decisions").select("decision_id", a.alias("a"), b.alias("b"))
    ratios = rows.select("a", "b").distinct()
    ratios = ratios.where("a = b").withColumn("ratio", F.lit(1.0)).unionByName(ratios.where("a <> b").withColumn("ratio", similarity("a", "b")))
    status = verify.agreement_status(F.col("ratio"), F.col("a"), F.col("b"), F.lit(1.0))
    return rows.join(ratios, ["a", "b"]).select("decision_id", F.round("ratio", 6).alias("ratio"), status.alias("status"))


def agg10_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """AGG10: the text that most readings of a decision have."""
    rows = table(spark, folder, "manual_review_decisions")
    return rows.select("decision_id", verify.consensus(F.array("original_text", "source_text", "verified_text")).alias("consensus"))


def p5_structural_cells(spark: SparkSession, folder: str) -> DataFrame:
    """P5: cells of the layout only, per document."""
    rows = table(spark, folder, "manual_review_decisions").where(verify.structural_empty(F.col("original_text"), F.col("bbox")))
    return rows.groupBy("document").agg(F.count(F.lit(1)).alias("n"))


def agg7_rules(spark: SparkSession, folder: str) -> DataFrame:
    """AGG7, AGG8, W16, F21, F23: rules learned from the decisions, with their verdict."""
    return learn.learn_rules(table(spark, folder, "manual_review_decisions"))


def j7_rule_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The most specific promoted rule for each decision that no person made."""
    decisions = table(spark, folder, "manual_review_decisions")
    typed = decisions.withColumn("object_type", statuses.object_type(F.col("object_type"), F.col("paragraph_block")))
    rules = materialize(learn.learn_rules(decisions), "rules")
    return learn.apply_rules(typed.where(~statuses.is_human(F.col("human_decision"))), "decision_id", rules)


def agg9_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """AGG9: decisions and distinct places per kind of decision, people apart from rules."""
    rows = review.normalised(table(spark, folder, "manual_review_decisions"))
    kind = F.when(F.col("is_human"), "human").when(statuses.is_automatic(F.col("decision")), "automatic").otherwise("other")
    place = F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in review.LOCATION))
    return rows.groupBy("decision", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(place).alias("n_places"))


def _review(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = materialize(review.normalised(table(spark, folder, "manual_review_decisions")), "decisions")
    return rows.where("NOT is_human"), rows


def j11_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """What each tier of evidence answers for decisions that no person made."""
    items, rows = _review(spark, folder)
    return review.evidence_tiers(items, rows, "decision_id").select("decision_id", "exact", "place", "legacy", "pair", "text")


def j16_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The tier that answers each open item; high-risk items stay open."""
    return review.answer_items(*_review(spark, folder), "decision_id")


def w7_current(spark: SparkSession, folder: str) -> DataFrame:
    """The last decision of each place."""
    rows = review.normalised(table(spark, folder, "manual_review_decisions"))
    return review.current_decisions(rows, F.col("loaded_at"), "decision_id").select("decision_id", "document", "page", "decision")


def w8_authoritative(spark: SparkSession, folder: str) -> DataFrame:
    """The decision with the greatest authority for each place."""
    rows = review.normalised(table(spark, folder, "manual_review_decisions"))
    return review.authoritative(rows, "decision_id").select("decision_id", "weight")


def w12_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Open places per document in their order, skipped places left out."""
    rows = review.normalised(table(spark, folder, "manual_review_decisions")).select(*review.LOCATION, "decision_id", "previous_status", "is_human", "verified_text", "recovered_from_historical_log")
    open_ = rows.where(~F.col("is_human"))
    old = F.coalesce("recovered_from_historical_log", F.lit(False))
    skipped = rows.where(F.col("is_human") & (F.trim(F.coalesce("verified_text", F.lit(""))) == ""))
    found = review.queue(open_.where(~old), open_.where(old), skipped, review.LOCATION, ["decision_id"])
    return found.select("document", "decision_id", "position")


def w9_preferred(spark: SparkSession, folder: str) -> DataFrame:
    """Of open items with one text on a page the one that is reviewed, a cell before a paragraph."""
    items = review.normalised(table(spark, folder, "manual_review_decisions")).where("NOT is_human AND original <> ''").withColumn("key", text.fold(F.col("original")))
    return review.preferred(items.select("document", "page", "key", "object_type", "decision_id"), ["document", "page", "key"], "decision_id").select("decision_id", "object_type")


def s8_effective(spark: SparkSession, folder: str) -> DataFrame:
    """The decision that counts for each place, items that are open now before decided ones."""
    rows = review.normalised(table(spark, folder, "manual_review_decisions"))
    current = rows.where(~F.col("is_human") & F.coalesce(~F.col("recovered_from_historical_log"), F.lit(True)))
    return review.effective(rows.where("is_human"), current, review.LOCATION, "decision_id").select("decision_id", "weight", "is_current")


def j10_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The cell of the value index that each decision about a cell is about."""
    items = review.normalised(table(spark, folder, "manual_review_decisions")).where("object_type = 'TABLE_CELL'")
    cells = value_cells(spark, folder).select(
        text.label(F.col("document_id")).alias("document"), text.page_key(F.col("page")).alias("page"), "table_index", F.col("source_row_index").alias("row_index"), "column_index",
        text.squash(F.col("value")).alias("original"), text.squash(F.col("value")).alias("source"), "occurrence_id",
    )
    return review.find_targets(items, cells, "decision_id", "occurrence_id").withColumnRenamed("cell", "occurrence_id")


def k10_actions(spark: SparkSession, folder: str) -> DataFrame:
    """The decisions after the ledger's lines were done to them as actions, by document, page and texts."""
    rows = review.normalised(table(spark, folder, "manual_review_decisions"))
    payload = ", ".join(f"{c} STRING" for c in (*_LEDGER, "human_decision"))
    lines = table(spark, folder, "ledger_lines").select("decision_id", "received_at", F.from_json("payload", payload).alias("p")).select("decision_id", "received_at", "p.*")
    on = ["document", "page", "original", "source"]
    said = lines.select(
        text.label(F.col("document")).alias("document"), text.page_key(F.col("page")).alias("page"), text.squash(F.col("original_text")).alias("original"), text.squash(F.col("source_text")).alias("source"),
        F.col("human_decision").alias("action"), F.col("verified_text").alias("text"), F.struct("received_at", "decision_id").alias("at"),
    )
    actions = said.join(rows.select("decision_id", *on), on).select("decision_id", "action", "text", "at")
    return review.apply_actions(rows, actions, "decision_id").select("decision_id", "human_decision", "verified_text", "previous_status")


def j18_distinct_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs that no cell in the same place repeats."""
    rows = review.normalised(table(spark, folder, "manual_review_decisions"))
    left, right = rows.where("object_type = 'PARAGRAPH'"), rows.where("object_type = 'TABLE_CELL'")
    return review.without_repeated_paragraphs(left, right, "decision_id").select("decision_id")


def j19_stale_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions about pages of which the record tables hold nothing."""
    rows = review.normalised(table(spark, folder, "manual_review_decisions"))
    pages = table(spark, folder, "records").select(text.label(F.col("document_id")).alias("document"), text.page_key(F.col("page")).alias("page")).distinct()
    return rows.join(pages, ["document", "page"], "left_anti").select("decision_id")


def j23_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Each paragraph with the ones around it."""
    rows = review.normalised(table(spark, folder, "manual_review_decisions")).where("object_type = 'PARAGRAPH'")
    return review.neighbours(rows)


def agg18_progress(spark: SparkSession, folder: str) -> DataFrame:
    """AGG18, P15: progress of every document."""
    return review.progress(review.normalised(table(spark, folder, "manual_review_decisions")))


def k1_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Every entity asked for by value and by id, and every code of the value index by itself."""
    entities = table(spark, folder, "entities")
    asked = entities.select(F.concat(F.lit("show everything about "), F.col("display_value")).alias("query")).unionByName(entities.select(F.col("entity_id").alias("query")))
    asked = asked.unionByName(table(spark, folder, "value_index").where(text.code_like(F.col("value"))).select(F.col("value").alias("query")))
    return query.lookup(asked.where("query IS NOT NULL"), entities, fields_of(spark, folder))


def k4_value_matches(spark: SparkSession, folder: str) -> DataFrame:
    """K4: every field that holds an entity's value, whole."""
    asked = table(spark, folder, "entities").where("display_value IS NOT NULL").select(F.col("display_value").alias("query"))
    return query.value_matches(asked, fields_of(spark, folder)).select("query", "record_id", "column_index")


def k4_contained_values(spark: SparkSession, folder: str) -> DataFrame:
    """K4 with ``contains``: fields that hold a whole text value of the value index as a part, counted per value."""
    asked = table(spark, folder, "value_index").where(text.value_type(F.col("value")) == "text").select(text.fold(F.col("value")).alias("query"))
    found = query.value_matches(asked, fields_of(spark, folder), "contains")
    return found.groupBy("query").agg(F.count(F.lit(1)).alias("n_fields"), F.countDistinct("record_id").alias("n_records"))


def _questions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    links = table(spark, folder, "entity_links")
    fields = fields_of(spark, folder)
    occurrences = links.where("entity_id IS NOT NULL AND record_id IS NOT NULL").select("entity_id", "record_id").distinct()
    evidence = occurrences.join(fields, "record_id").select(
        "entity_id", F.col("record_id").alias("occurrence"), "document_id", "page", "table_id", "source_row_index", "column_index", "header", "value", F.lit(None).cast("string").alias("verification_status")
    )
    ask = lambda start, end: F.concat(F.lit(start), F.coalesce("header", F.lit("value")), F.lit(" of "), F.col("value"), F.lit(end))
    questions = links.select(ask("What is the ", "?").alias("question")).unionByName(links.select(ask("Give the ", " in May, please").alias("question")))
    return questions.where("question IS NOT NULL").distinct(), table(spark, folder, "entities"), evidence


def j20_named_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The entity that each question names."""
    questions, entities, _ = _questions(spark, folder)
    return query.resolve_entities(questions, entities)


def k5_answers(spark: SparkSession, folder: str) -> DataFrame:
    """K5, J20, P13, P14, F29, F30, AGG12, AGG19: answers with their status."""
    questions, entities, evidence = _questions(spark, folder)
    return query.answer_questions(questions, entities, materialize(evidence, "evidence"))


def agg15_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """AGG15, AGG17: evidence of each entity per document, page and table."""
    return query.evidence_by_table(_questions(spark, folder)[2])


def k7_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """K7: fields of an entity for which its records disagree."""
    return query.conflicts(_questions(spark, folder)[2])


def agg16_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """AGG16, W13: the first names of entities, headers and documents."""
    return query.catalog(table(spark, folder, "entities"), fields_of(spark, folder))


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "manual_review_decisions").withColumn("bbox", geometry.normal_box(F.col("bbox")))
    return rows.select("decision_id", text.label(F.col("document")).alias("document"), text.page_key(F.col("page")).alias("page"), "bbox", F.coalesce("original_text", F.lit("")).alias("text"))


def g1_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Normal boxes with area and centre."""
    rows = _blocks(spark, folder).where("bbox IS NOT NULL")
    c = geometry.centre(F.col("bbox"))
    return rows.select("decision_id", F.round(geometry.area(F.col("bbox")), 3).alias("area"), F.round(c["x"], 3).alias("x"), F.round(c["y"], 3).alias("y"))


def g3_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of a page that cover more than half of the smaller one, counted per page; equal boxes are taken once."""
    rows = _blocks(spark, folder).where("bbox IS NOT NULL").groupBy("document", "page", "bbox").agg(F.min("decision_id").alias("id"))
    other = rows.select("document", "page", F.col("bbox").alias("box"), F.col("id").alias("other"))
    pairs = rows.join(other, ["document", "page"]).where((F.col("id") < F.col("other")) & (geometry.overlap_of_smaller(F.col("bbox"), F.col("box")) > 0.5))
    return pairs.groupBy("document", "page").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("id").alias("n_boxes"))


def g6_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Row and column of every block on its page."""
    return geometry.grid_of_blocks(_blocks(spark, folder), ["document", "page"], "decision_id")


def g13_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of one slot as cells, empty slots filled up, counted per page."""
    blocks = _blocks(spark, folder)
    placed = g6_grid(spark, folder).join(blocks.select("decision_id", "bbox", "text", F.lit(1.0).alias("confidence")), "decision_id")
    page = ["document", "page"]
    cells = geometry.combine_cells(placed, [*page, "row_number", "column_number"])
    return geometry.dense_grid(cells, page).groupBy(*page).agg(F.count(F.lit(1)).alias("n_slots"), F.count(F.when(F.col("text") != "", 1)).alias("n_filled"))


def g8_row_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of consecutive rows that are close and alike."""
    blocks = _blocks(spark, folder)
    placed = g6_grid(spark, folder).join(blocks.select("decision_id", "bbox"), "decision_id")
    c = geometry.centre(F.col("bbox"))
    rows = placed.groupBy("document", "page", "row_number").agg(F.avg(c["y"]).alias("y"), F.transform(F.sort_array(F.collect_list(F.struct(F.col("bbox")[0].alias("left"), c["x"].alias("x")))), lambda v: v["x"]).alias("edges"))
    return geometry.anchor_groups(rows, ["document", "page"])


def g10_table_cores(spark: SparkSession, folder: str) -> DataFrame:
    """Cores of tables on every page, with their score."""
    return geometry.table_cores(_blocks(spark, folder), ["document", "page"], "decision_id").select("document", "page", "first_row", "last_row", "n_rows", "score")


def g15_engine_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of each table of decisions placed by their boxes alone."""
    rows = table(spark, folder, "manual_review_decisions").where("table_index IS NOT NULL")
    rows = rows.select("decision_id", text.label(F.col("document")).alias("document"), text.page_key(F.col("page")).alias("page"), "table_index", geometry.normal_box(F.col("bbox")).alias("bbox"))
    return geometry.engine_rows(rows, ["document", "page", "table_index"], "decision_id")


#: Distance of the made lines that g21_grid_cells rules a page with.
GRID = 100


def g21_grid_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks by the cell of a ruled grid that holds their centre, counted per cell."""
    blocks = _blocks(spark, folder).where("bbox IS NOT NULL")
    lines = lambda i: F.transform(F.sequence(F.lit(0), (F.floor(F.max(F.col("bbox")[i]) / GRID) + 1).cast("int")), lambda v: v * GRID)
    ruled = blocks.groupBy("document", "page").agg(lines(2).alias("verticals"), lines(3).alias("horizontals"))
    placed = geometry.grid_cells(blocks.join(ruled, ["document", "page"]), ["document", "page"])
    return placed.groupBy("document", "page", "row_number", "column_number").agg(F.count(F.lit(1)).alias("n"))


def g24_page_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes in pixels of a page of 1,000 by 1,400, and whether they can be their text's place."""
    width, height = F.lit(1000.0), F.lit(1400.0)
    box = geometry.scale_box(F.col("bbox"), width, height)
    rows = _blocks(spark, folder).where("bbox IS NOT NULL").withColumn("pixels", box)
    suspicious = geometry.is_suspicious(F.col("pixels"), text.squash(F.col("text")), width, height)
    return rows.select("decision_id", *(F.col("pixels")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))), suspicious.alias("suspicious"))


def agg10_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """AGG10: mean confidence of the deliveries of each occurrence."""
    held = table(spark, folder, "value_index").groupBy("occurrence_id").agg(F.sort_array(F.collect_list("source_ocr_confidence")).alias("c"))
    return held.select("occurrence_id", F.round(verify.mean_confidence(F.col("c")), 6).alias("confidence"))


def p5_index_cells(spark: SparkSession, folder: str) -> DataFrame:
    """P5 on the retrieval index: fields without a value in records without a place, per table."""
    rows = table(spark, folder, "entity_retrieval_index").select("entity_id", F.explode("records").alias("r")).where("r IS NOT NULL")
    fields = rows.select("r.table_id", F.col("r.provenance.bbox").alias("bbox"), F.explode("r.fields").alias("f")).where("f IS NOT NULL")
    return fields.where(verify.structural_empty(F.col("f.value"), F.col("bbox"))).groupBy("table_id").agg(F.count(F.lit(1)).alias("n"))


def w11_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The longest run of verified cells in each table."""
    cells = value_cells(spark, folder).withColumn("ok", F.coalesce(F.col("verification_status").startswith("SOURCE_VERIFIED"), F.lit(False)))
    cells = cells.withColumn("place", F.struct("source_row_index", "column_index", "occurrence_id"))
    return geometry.longest_run(cells, ["table_id"], "place", "ok")


def w14_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Upper median and percentiles of block heights per page."""
    heights = _blocks(spark, folder).where("bbox IS NOT NULL").groupBy("document", "page").agg(F.collect_list(F.round(F.col("bbox")[3] - F.col("bbox")[1], 3)).alias("h"))
    rank = lambda s, n: geometry.upper_rank(F.col("h"), s).alias(n)
    return heights.select("document", "page", rank(0.5, "p50"), rank(0.75, "p75"), rank(0.95, "p95"))


def agg11_totals(spark: SparkSession, folder: str) -> DataFrame:
    """AGG11: validation totals per document and over all."""
    return quality.validation_totals(value_cells(spark, folder))


def agg14_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """AGG14: fields of records of which the value index has the cell, per document."""
    place = ["document_id", "table_id", "source_row_index", "column_index"]
    return quality.coverage(fields_of(spark, folder), table(spark, folder, "value_index"), place, "document_id")


def p7_lost_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions with an empty text whose box a text on the same page covers."""
    blocks = _blocks(spark, folder)
    return quality.empty_cells_with_evidence(blocks, blocks, ["document", "page"], "decision_id").select("decision_id")


def snk4_complete_tables(spark: SparkSession, folder: str) -> DataFrame:
    """SNK4: pages of tables none of whose cells lacks its source: all of a table or nothing."""
    pages = value_cells(spark, folder).groupBy("table_id", "page").agg(F.max(F.coalesce(F.col("verification_status") == "SOURCE_EMPTY", F.lit(False))).alias("failed"), F.count(F.lit(1)).alias("n_cells"))
    return merge.publish_complete(pages, "table_id", F.col("failed")).select("table_id", "page", "n_cells")


QUERIES = {name: f for name, f in globals().copy().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}
# p1_, p3_, p5_ and p7_ are the names of problems: operators P1–P7 take another prefix
for _old, _new in (("p1_engine_agreement", "op_p1_engine_agreement"), ("p3_rules", "op_p3_rules"), ("p5_structural_cells", "op_p5_structural_cells"), ("p5_index_cells", "op_p5_index_cells"), ("p7_lost_cells", "op_p7_lost_cells")):
    QUERIES[_new] = QUERIES.pop(_old)

_FOLD_V = q.fold("value")


def _side_sql(name: str, rows: str) -> str:
    uncertain = ", ".join(f"'{s}'" for s in statuses.UNCERTAIN)
    return f"""{name}_raw AS ({rows}),
{name}_flat AS (SELECT DISTINCT ON (row_key, row_id, header) * FROM (SELECT nullif({q.fold("record_id")}, '') AS row_key, table_id AS row_id, {q.label("header")} AS header, column_index, value,
    coalesce(upper({q.squash("verification_status")}) IN ({uncertain}), false) AS uncertain FROM {name}_raw) ORDER BY row_key, row_id, header, column_index DESC, value DESC NULLS LAST, uncertain DESC),
{name}_row AS (SELECT row_key, max(row_id) AS row_id, count(DISTINCT row_id) > 1 AS repeated FROM {name}_flat WHERE row_key IS NOT NULL GROUP BY row_key),
{name} AS (SELECT * FROM {name}_flat JOIN {name}_row USING (row_key, row_id))"""


_DIFF = (
    q.FIELDS
    + ", "
    + _side_sql("l", "SELECT record_id, table_id, header, column_index, value, NULL AS verification_status FROM field")
    + ", "
    + _side_sql(
        "r",
        """SELECT x.record_id, x.table_id, f.header, f.column_index, f.value, x.provenance.verification_status FROM (
    SELECT x, unnest(x.fields) AS f FROM (SELECT unnest(records) AS x FROM entity_retrieval_index) WHERE x IS NOT NULL) WHERE f IS NOT NULL""",
    )
    + f""", cell AS (SELECT coalesce(l.row_key, r.row_key) AS row_key, coalesce(l.header, r.header) AS header, l.value AS left_value, r.value AS right_value,
    {q.fold("l.value")} AS a, {q.fold("r.value")} AS b, l.row_key IS NOT NULL AS on_left, r.row_key IS NOT NULL AS on_right,
    coalesce(l.uncertain, false) OR coalesce(r.uncertain, false) AS uncertain, coalesce(l.repeated, false) OR coalesce(r.repeated, false) AS repeated_key
  FROM l FULL JOIN r ON l.row_key = r.row_key AND l.header = r.header),
verdict AS (SELECT *, CASE WHEN NOT on_left THEN 'ADDED' WHEN NOT on_right THEN 'REMOVED' WHEN uncertain THEN 'AMBIGUOUS' WHEN a = b THEN 'UNCHANGED' ELSE 'CHANGED' END AS status,
    CASE WHEN a = '' THEN CASE WHEN b = '' THEN 'MISSING' ELSE 'RIGHT_ONLY' END WHEN b = '' THEN 'LEFT_ONLY' WHEN a = b THEN 'MATCH' ELSE 'DIFFERENT' END AS value_relation FROM cell)"""
)
_EVERY = "(SELECT unnest(['CHANGED', 'UNCHANGED', 'ADDED', 'REMOVED', 'AMBIGUOUS']) AS status)"
_PAGE = f"CASE WHEN TRY_CAST({q.squash('page')} AS DOUBLE) = floor(TRY_CAST({q.squash('page')} AS DOUBLE)) THEN CAST(CAST(TRY_CAST({q.squash('page')} AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE {q.squash('page')} END"
_KIND = f"""CASE WHEN contains(upper({q.squash("object_type")}), 'PARAGRAPH') THEN 'PARAGRAPH' WHEN contains(upper({q.squash("object_type")}), 'CELL') OR contains(upper({q.squash("object_type")}), 'TABLE') THEN 'TABLE_CELL'
  WHEN paragraph_block IS NOT NULL THEN 'PARAGRAPH' ELSE 'TABLE_CELL' END"""
_HUMAN = "coalesce(upper(trim(human_decision)) IN (" + ", ".join(f"'{s}'" for s in statuses.HUMAN) + "), false)"
_SETTLED = q.squash("CASE upper(trim(human_decision)) WHEN 'USER_CONFIRMED_ORIGINAL' THEN original_text WHEN 'USER_CONFIRMED_SOURCE' THEN source_text ELSE verified_text END")
_NORMAL = f"""
WITH d AS (SELECT * REPLACE ({_KIND} AS object_type, {_PAGE} AS page, {q.label("document")} AS document),
    {q.squash("original_text")} AS original, {q.squash("source_text")} AS source, {_SETTLED} AS settled, {_HUMAN} AS is_human FROM manual_review_decisions)"""
_PLACE = ", ".join(review.LOCATION)
_AUTOMATIC = "coalesce(upper(trim(decision)) IN (" + ", ".join(f"'{s}'" for s in statuses.AUTOMATIC) + ") OR upper(trim(decision)) LIKE '%\\_REUSED' ESCAPE '\\', false)"
_OVERLAP = """(greatest(0, least(a.bbox[3], b.bbox[3]) - greatest(a.bbox[1], b.bbox[1])) * greatest(0, least(a.bbox[4], b.bbox[4]) - greatest(a.bbox[2], b.bbox[2]))
    / nullif(least(greatest(0, a.bbox[3] - a.bbox[1]) * greatest(0, a.bbox[4] - a.bbox[2]), greatest(0, b.bbox[3] - b.bbox[1]) * greatest(0, b.bbox[4] - b.bbox[2])), 0))"""
_CLASSES = r"regexp_replace(regexp_replace(regexp_replace({0}, '\p{{L}}', 'L', 'g'), '\p{{N}}', 'N', 'g'), '[\s\p{{Z}}]', 'W', 'g')"
_J = lambda *parts: "to_json([" + ", ".join(f"coalesce({p}, '')" for p in parts) + "])"
_CONTEXT = "CASE WHEN object_type = 'TABLE_CELL' THEN concat_ws('/', table_index, column_index) ELSE '' END"
_POSITIONS = "CASE WHEN length({0}) = length({1}) THEN list_filter(range(1, length({0}) + 1), lambda i: substr({0}, i, 1) <> substr({1}, i, 1)) ELSE [] END"
_AROUND = lambda start, n: q.squash(_CLASSES.format(q.squash(f"substr(original, {start}, {n})")))
_PAIR = f"""pair AS (SELECT *, {_CLASSES.format("original")} AS ca, {_CLASSES.format("source")} AS cb, {_CONTEXT} AS context, {_POSITIONS.format("original", "source")} AS pos FROM {{0}}),
changed AS (SELECT *, array_to_string(list_transform(pos, lambda i: substr(ca, i, 1) || '>' || substr(cb, i, 1)), ' ') AS edits FROM pair),
place AS (SELECT *, unnest(pos) AS i FROM pair),
keyed AS (
  SELECT decision_id, original, source, settled, action, document, pos, 'exact' AS family, {_J("object_type", "original", "source")} AS key FROM changed WHERE original <> '' OR source <> ''
  UNION ALL SELECT decision_id, original, source, settled, action, document, pos, 'generalized', {_J("object_type", "context", "ca", "cb", "edits")} FROM changed WHERE original <> '' AND source <> ''
  UNION ALL SELECT decision_id, original, source, settled, action, document, pos, 'structural', {_J("object_type", "context", "ca", "cb")} FROM changed WHERE original <> '' AND source <> ''
  UNION ALL SELECT decision_id, original, source, settled, action, document, pos, 'context', {_J("object_type", "context", "ca")} FROM changed WHERE original <> ''
  UNION ALL SELECT decision_id, original, source, settled, action, document, pos, 'cross_generalized', {_J("object_type", "ca", "cb", "edits")} FROM changed WHERE original <> '' AND source <> ''
  UNION ALL SELECT decision_id, original, source, settled, action, document, pos, 'cross_structural', {_J("object_type", "ca", "cb")} FROM changed WHERE original <> '' AND source <> ''
  UNION ALL SELECT decision_id, original, source, settled, action, document, pos, 'local', {_J("object_type", "substr(original, i, 1)", "substr(source, i, 1)", _AROUND("greatest(1, i - 2)", "least(2, i - 1)"), _AROUND("i + 1", "2"),
    "CASE WHEN i = 1 THEN 'START' WHEN i = length(original) THEN 'END' ELSE 'MIDDLE' END")} FROM place)"""
_EDITED = f"""edit AS (SELECT document, object_type, settled, wrong, {_POSITIONS.format("wrong", "settled")} AS spot FROM (SELECT *, CASE WHEN action = 'original' THEN source ELSE original END AS wrong FROM seen)),
example AS (
  SELECT family, CAST(key AS VARCHAR) AS key, CASE WHEN family = 'exact' THEN settled ELSE action END AS v, document FROM keyed
  UNION ALL SELECT 'character_edit', CAST({_J("object_type", "substr(wrong, spot[1], 1)", "substr(settled, spot[1], 1)")} AS VARCHAR), substr(settled, spot[1], 1), document FROM edit WHERE len(spot) = 1)"""
_LEAST = "CASE family " + " ".join(f"WHEN '{f}' THEN examples >= {n} AND documents >= {m}" for f, (n, m) in learn.FAMILIES.items()) + " END"
_SEEN = f"""
WITH typed AS (SELECT * REPLACE ({_KIND} AS object_type, {_PAGE} AS page), {q.squash("original_text")} AS original, {q.squash("source_text")} AS source FROM manual_review_decisions),
told AS (SELECT *, {_SETTLED} AS settled, CASE upper(trim(human_decision)) WHEN 'USER_CONFIRMED_ORIGINAL' THEN 'original' WHEN 'USER_CONFIRMED_SOURCE' THEN 'source' END AS action, {_HUMAN} AS is_human FROM typed),
seen AS (SELECT DISTINCT ON (document, page, table_index, row_index, column_index, bbox, original, source) * FROM told WHERE is_human AND settled <> ''
         ORDER BY document, page, table_index, row_index, column_index, bbox, original, source, decision_id),
{_PAIR.replace("{0}", "seen")},
{_EDITED},
rule AS (SELECT family, key, examples, documents, CASE WHEN n = 1 THEN v END AS value, CASE WHEN n > 1 THEN 'conflict' WHEN {_LEAST} THEN 'promoted' ELSE 'insufficient' END AS verdict
         FROM (SELECT family, key, count(v) AS examples, count(DISTINCT nullif(trim(document), '')) AS documents, count(DISTINCT v) AS n, min(v) AS v FROM example GROUP BY family, key) WHERE examples > 0)
"""
_ASKED = (
    _SEEN
    + ", asked AS (SELECT * FROM told WHERE NOT is_human AND original <> '' AND source <> ''), "
    + re.sub(r"\b(pair|changed|place|keyed)\b", r"open_\1", _PAIR.replace("{0}", "(SELECT * FROM asked WHERE original <> source)"))
    + f""", letter AS (SELECT decision_id, a, b, unnest(list_distinct(string_split(b, ''))) AS c FROM (SELECT decision_id, {q.squash(q.repair_mojibake("original"))} AS a, {q.squash(q.repair_mojibake("source"))} AS b FROM asked) WHERE length(a) = length(b)),
once AS (SELECT decision_id, a, c, strpos(b, c) AS i FROM letter WHERE c <> '' AND length(b) - length(replace(b, c, '')) = length(c) AND substr(a, strpos(b, c), 1) = c),
hit AS (
  SELECT k.decision_id, k.family, r.examples, r.key, CASE WHEN k.family = 'exact' THEN r.value WHEN r.value = 'original' THEN k.original ELSE k.source END AS verified_text
  FROM open_keyed k JOIN rule r ON r.family = k.family AND r.key = CAST(k.key AS VARCHAR) WHERE r.verdict = 'promoted' AND (k.family <> 'local' OR len(k.pos) = 1)
  UNION ALL
  SELECT o.decision_id, 'character_edit', r.examples, r.key, substr(a, 1, i - 1) || (CAST(r.key AS JSON) ->> 2) || substr(a, i + 1)
  FROM once o JOIN rule r ON r.family = 'character_edit' AND r.verdict = 'promoted' AND (CAST(r.key AS JSON) ->> 1) = o.c),
learned AS (SELECT DISTINCT ON (decision_id) decision_id, family, verified_text FROM hit
  ORDER BY decision_id, list_position([{", ".join(f"'{f}'" for f in learn.FAMILIES)}], family), examples DESC, encode(key))
"""
)

_TIERS = f""", h AS (SELECT * FROM d WHERE is_human AND settled <> ''),
      e AS (SELECT document, page, original, source, min(settled) AS v FROM h GROUP BY ALL HAVING count(DISTINCT settled) = 1),
      p AS (SELECT original, source, min(settled) AS v FROM h GROUP BY ALL HAVING count(DISTINCT settled) = 1),
      g AS (SELECT document, page, original, min(settled) AS v FROM h WHERE object_type = 'PARAGRAPH' GROUP BY ALL HAVING count(*) = 1),
      t AS (SELECT original, original AS v FROM h GROUP BY original HAVING bool_and(settled = original)),
      near AS (SELECT a.decision_id, b.settled, b.decision_id AS known, {_OVERLAP} AS o FROM d a JOIN h b ON a.document = b.document AND a.page = b.page AND a.original = b.original WHERE NOT a.is_human AND a.bbox IS NOT NULL AND b.bbox IS NOT NULL),
      pl AS (SELECT decision_id, arg_max(settled, (o, -known)) AS v FROM near WHERE o >= 0.80 GROUP BY decision_id),
      tier AS (SELECT d.decision_id, e.v AS exact, pl.v AS place, g.v AS legacy, p.v AS pair, t.v AS text FROM d LEFT JOIN e USING (document, page, original, source) LEFT JOIN pl ON pl.decision_id = d.decision_id
        LEFT JOIN g USING (document, page, original) LEFT JOIN p USING (original, source) LEFT JOIN t USING (original) WHERE NOT is_human)"""

_WEIGHT = f"""CAST(CASE WHEN upper(trim(coalesce(human_decision, decision))) IN ('USER_ENTERED_CORRECTION', 'USER_CORRECTION') THEN 5 WHEN upper(trim(coalesce(human_decision, decision))) = 'USER_CONFIRMED_SOURCE' THEN 4
        WHEN upper(trim(coalesce(human_decision, decision))) = 'USER_CONFIRMED_ORIGINAL' THEN 3 WHEN {_AUTOMATIC.replace("decision", "coalesce(human_decision, decision)")} THEN 1 ELSE 0 END
        + CASE WHEN {q.squash("verified_text")} <> '' THEN 1 ELSE 0 END AS INTEGER)"""
_ON_PAGE = " AND ".join(f"c.{x} = i.{x}" for x in ("document", "page", "table_index", "row_index", "column_index"))
_ASKED_QUESTIONS = f"""
link AS (SELECT 'What is the ' || coalesce(header, 'value') || ' of ' || value || '?' AS a, 'Give the ' || coalesce(header, 'value') || ' of ' || value || ' in May, please' AS b FROM entity_links),
question AS (SELECT DISTINCT question FROM (SELECT a AS question FROM link UNION ALL SELECT b FROM link) WHERE question IS NOT NULL),
word AS (SELECT question, list_filter(list_transform(string_split({q.fold("question")}, ' '), lambda w: regexp_replace(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}_.\\-]+', ''), '[^\\p{{L}}\\p{{N}}_\\-]+$', '')), lambda w: w <> '') AS ws FROM question),
named AS (SELECT DISTINCT entity_id, key FROM (SELECT entity_id, {q.fold("canonical_value")} AS key FROM entities UNION ALL SELECT entity_id, {q.fold("display_value")} FROM entities) WHERE key <> ''),
span AS (SELECT DISTINCT question, array_to_string(ws[i:j], ' ') AS key FROM (SELECT question, ws, i, unnest(range(i, len(ws) + 1)) AS j FROM (SELECT question, ws, unnest(range(1, len(ws) + 1)) AS i FROM word))),
hit AS (SELECT question, length(s.key) AS n_chars, count(DISTINCT entity_id) AS n, min(entity_id) AS entity_id FROM span s JOIN named n ON n.key = s.key GROUP BY question, length(s.key)),
resolved AS (SELECT question, arg_max(entity_id, n_chars) AS entity_id, arg_max(n, n_chars) AS n FROM hit GROUP BY question)"""
_CONTENT = lambda x: f"list_filter(list_distinct(regexp_extract_all({q.fold(x)}, '[a-z0-9]+')), lambda w: length(w) > 1 AND NOT list_contains([{', '.join(repr(w) for w in text.STOP_WORDS)}], w))"
_MONTHS = "MAP {" + ", ".join(f"'{m}': {n}" for m, n in text.months().items()) + "}"
_MONTH_OF = lambda x: f"list_distinct(list_filter(list_transform(regexp_extract_all({q.fold(x)}, '[a-z]+'), lambda w: {_MONTHS}[w]), lambda m: m IS NOT NULL))"
_ANSWERS = f"""
evidence AS (SELECT entity_id, record_id, document_id, header, column_index, value, {q.fold("header")} AS field, {q.fold("value")} AS key
             FROM (SELECT DISTINCT entity_id, record_id FROM entity_links WHERE entity_id IS NOT NULL AND record_id IS NOT NULL) JOIN field USING (record_id)),
asked AS (SELECT question, CASE WHEN r.n = 1 THEN r.entity_id END AS entity_id, {_MONTH_OF("question")} AS ms FROM question LEFT JOIN resolved r USING (question)),
header AS (SELECT DISTINCT entity_id, field, unnest({_CONTENT("header")}) AS w FROM evidence WHERE field <> ''),
overlap AS (SELECT question, field, count(*) AS n FROM (SELECT question, entity_id, unnest({_CONTENT("question")}) AS w FROM asked WHERE entity_id IS NOT NULL) JOIN header USING (entity_id, w) GROUP BY ALL),
best AS (SELECT question, count(*) AS n_fields, min(field) AS field FROM overlap o WHERE n = (SELECT max(n) FROM overlap x WHERE x.question = o.question) GROUP BY question),
dated AS (SELECT entity_id, record_id, arg_min(m, column_index) AS m FROM (SELECT *, TRY_CAST(regexp_extract(value, '\\b[0-9]{{4}}[-/]([0-9]{{1,2}})[-/][0-9]{{1,2}}\\b', 1) AS INTEGER) AS m FROM evidence) WHERE m BETWEEN 1 AND 12 GROUP BY ALL),
fact AS (SELECT a.question, e.*, coalesce(d.m, CASE WHEN len({_MONTH_OF("translate(document_id, '_-', '  ')")}) = 1 THEN {_MONTH_OF("translate(document_id, '_-', '  ')")}[1] END) AS month
         FROM asked a JOIN best b ON b.question = a.question AND b.n_fields = 1 JOIN evidence e ON e.entity_id = a.entity_id AND e.field = b.field LEFT JOIN dated d ON d.entity_id = e.entity_id AND d.record_id = e.record_id),
rolled AS (SELECT f.question, count(*) AS n_evidence, count(DISTINCT key) AS n_values, min(value) AS answer FROM fact f JOIN asked a USING (question) WHERE len(ms) <> 1 OR month = ms[1] GROUP BY f.question),
status AS (SELECT a.question, a.entity_id, b.n_fields, b.field, r.n_evidence, r.answer, CASE WHEN a.entity_id IS NULL THEN 'NO_ENTITY_OR_AMBIGUOUS_ENTITY'
    WHEN n_fields IS NULL AND NOT list_has_any(regexp_extract_all({q.fold("a.question")}, '[a-z0-9]+'), [{", ".join(repr(w) for w in query.GENERIC)}]) THEN 'FIELD_NOT_FOUND'
    WHEN n_fields IS NULL OR n_fields > 1 THEN 'FIELD_AMBIGUOUS' WHEN n_evidence IS NULL THEN CASE WHEN len(ms) = 1 THEN 'NO_MATCHING_DATA' ELSE 'NO_EVIDENCE' END
    WHEN n_values > 1 THEN 'AMBIGUOUS_MULTIPLE_VALUES' WHEN n_evidence = 1 THEN 'ANSWERED' ELSE 'CONSISTENT_MULTIPLE_EVIDENCE' END AS status
  FROM asked a LEFT JOIN best b USING (question) LEFT JOIN rolled r USING (question))
SELECT question, status, CASE WHEN status IN ('ANSWERED', 'CONSISTENT_MULTIPLE_EVIDENCE') THEN answer END AS answer, entity_id, CASE WHEN n_fields = 1 THEN field END AS field, coalesce(n_evidence, 0) AS n_evidence FROM status"""
_BOX = f"""b AS (SELECT decision_id, {q.label("document")} AS document, {_PAGE} AS page, coalesce(original_text, '') AS text, CASE WHEN len(bbox) = 4 AND NOT list_contains(list_transform(bbox, lambda v: v IS NULL), true)
  THEN [least(bbox[1], bbox[3]), least(bbox[2], bbox[4]), greatest(bbox[1], bbox[3]), greatest(bbox[2], bbox[4])] END AS bbox FROM manual_review_decisions)"""

SQL = {
    "j5_table_diff": _DIFF + " SELECT row_key, header, left_value, right_value, status, value_relation, repeated_key FROM verdict",
    "agg13_diff_summary": _DIFF + f" SELECT status, count(v.row_key) AS n FROM {_EVERY} LEFT JOIN verdict v USING (status) GROUP BY status",
    "j5_row_statuses": _DIFF
    + f""", keyed AS (SELECT row_key, CASE WHEN NOT bool_or(on_left) THEN 'ADDED' WHEN NOT bool_or(on_right) THEN 'REMOVED' WHEN bool_or(repeated_key) OR bool_or(status = 'AMBIGUOUS') THEN 'AMBIGUOUS'
        WHEN bool_or(status IN ('CHANGED', 'ADDED', 'REMOVED')) THEN 'CHANGED' ELSE 'UNCHANGED' END AS status FROM verdict GROUP BY row_key
        UNION ALL SELECT DISTINCT row_id, 'REMOVED' FROM l_flat WHERE row_key IS NULL UNION ALL SELECT DISTINCT row_id, 'ADDED' FROM r_flat WHERE row_key IS NULL)
      SELECT status, count(k.status) AS n FROM {_EVERY} s LEFT JOIN keyed k USING (status) GROUP BY status""",
    "s3_header_sets": _DIFF
    + """ SELECT coalesce(a.header, b.header) AS header, CASE WHEN a.header IS NULL THEN 'right' WHEN b.header IS NULL THEN 'left' ELSE 'both' END AS place
      FROM (SELECT DISTINCT header FROM l_flat) a FULL JOIN (SELECT DISTINCT header FROM r_flat) b ON a.header = b.header""",
    "s1_index_merge": """WITH prev AS (SELECT DISTINCT record_id, document_id, page, table_id, source_status FROM records), cur AS (SELECT * FROM prev WHERE source_status = 'CURRENT')
      SELECT 'SOURCE_MISSING_HISTORICAL' AS source_status, document_id, count(*) AS n FROM prev WHERE document_id NOT IN (SELECT document_id FROM cur WHERE document_id IS NOT NULL) GROUP BY document_id
      UNION ALL SELECT 'CURRENT', document_id, count(*) FROM cur GROUP BY document_id""",
    "s2_state_diff": """WITH v AS (SELECT occurrence_id, loaded_at, sha256(coalesce(value, '') || chr(31) || coalesce(verification_status, '')) AS sha FROM value_index),
      x AS (SELECT occurrence_id, arg_min(sha, (loaded_at, sha)) AS a, arg_max(sha, (loaded_at, sha)) AS b FROM v GROUP BY occurrence_id)
      SELECT occurrence_id, CASE WHEN a = b THEN 'unchanged' ELSE 'modified' END AS change FROM x""",
    "s7_ledger_union": f"""WITH line AS (SELECT decision_id, CAST(payload AS JSON) AS p FROM ledger_lines),
      every AS (SELECT decision_id, document, {_PAGE} AS page, object_type, original_text, source_text, verified_text, decision FROM manual_review_decisions
      UNION SELECT decision_id, p ->> 'document', {_PAGE.replace("page", "(p ->> 'page')")} , p ->> 'object_type', p ->> 'original_text', p ->> 'source_text', p ->> 'verified_text', p ->> 'decision' FROM line)
      SELECT decision, count(*) AS n, count(DISTINCT document) AS n_documents FROM every GROUP BY decision""",
    "s6_insert_absent": f"""WITH line AS (SELECT decision_id, CAST(payload AS JSON) AS p FROM ledger_lines),
      new AS (SELECT decision_id, p ->> 'document' AS document, {_PAGE.replace("page", "(p ->> 'page')")} AS page, p ->> 'original_text' AS o, p ->> 'source_text' AS s, p ->> 'verified_text' AS v, p ->> 'decision' AS decision FROM line),
      base AS (SELECT decision_id, document, {_PAGE} AS page, original_text AS o, source_text AS s, verified_text AS v, decision FROM manual_review_decisions)
      SELECT decision_id FROM base UNION ALL SELECT decision_id FROM new n WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.document IS NOT DISTINCT FROM n.document AND b.page IS NOT DISTINCT FROM n.page
        AND b.o IS NOT DISTINCT FROM n.o AND b.s IS NOT DISTINCT FROM n.s AND b.v IS NOT DISTINCT FROM n.v AND b.decision IS NOT DISTINCT FROM n.decision)""",
    "agg10_consensus": f"""WITH read AS (SELECT decision_id, list_filter([{q.squash("original_text")}, {q.squash("source_text")}, {q.squash("verified_text")}], lambda t: t <> '') AS r FROM manual_review_decisions)
      SELECT decision_id, CASE WHEN len(r) = 0 THEN '' WHEN len(r) < 3 THEN r[1] WHEN r[2] = r[3] AND r[1] <> r[2] THEN r[2] ELSE r[1] END AS consensus FROM read""",
    "op_p5_structural_cells": f"SELECT document, count(*) AS n FROM manual_review_decisions WHERE {q.squash('original_text')} = '' AND bbox IS NULL GROUP BY document",
    "agg7_rules": _SEEN + "SELECT * FROM rule",
    "j7_rule_lookup": _ASKED + "SELECT * FROM learned",
    "agg9_outcomes": _NORMAL
    + f" SELECT decision, CASE WHEN is_human THEN 'human' WHEN {_AUTOMATIC} THEN 'automatic' ELSE 'other' END AS kind, count(*) AS n, count(DISTINCT ({_PLACE})) AS n_places FROM d GROUP BY 1, 2",
    "j11_evidence": _NORMAL + _TIERS + " SELECT decision_id, exact, place, legacy, pair, text FROM tier",
    # rules are learned from the normalised decisions here: one document in two spellings is one
    "j16_answers": _ASKED.replace("WITH typed AS", _NORMAL + _TIERS + ", typed AS", 1).replace("AS source FROM manual_review_decisions),\ntold", "AS source FROM (SELECT * EXCLUDE (original, source, settled, is_human) FROM d)),\ntold")
    + """ SELECT t.decision_id, CASE WHEN contains(d.previous_status, 'HIGH_RISK') THEN NULL WHEN exact IS NOT NULL THEN 'exact' WHEN place IS NOT NULL THEN 'place' WHEN legacy IS NOT NULL THEN 'legacy'
        WHEN t.pair IS NOT NULL THEN 'pair' WHEN text IS NOT NULL THEN 'text' WHEN l.verified_text IS NOT NULL THEN 'rule' END AS tier,
      CASE WHEN contains(d.previous_status, 'HIGH_RISK') THEN NULL ELSE coalesce(exact, place, legacy, t.pair, text, l.verified_text) END AS answer
      FROM tier t JOIN d USING (decision_id) LEFT JOIN learned l USING (decision_id)""",
    "w7_current": _NORMAL + f" SELECT DISTINCT ON ({_PLACE}) decision_id, document, page, decision FROM d ORDER BY {_PLACE}, loaded_at DESC NULLS LAST, decision_id DESC",
    "w8_authoritative": _NORMAL
    + f""", w AS (SELECT *, CAST(CASE WHEN upper(trim(coalesce(human_decision, decision))) IN ('USER_ENTERED_CORRECTION', 'USER_CORRECTION') THEN 5 WHEN upper(trim(coalesce(human_decision, decision))) = 'USER_CONFIRMED_SOURCE' THEN 4
        WHEN upper(trim(coalesce(human_decision, decision))) = 'USER_CONFIRMED_ORIGINAL' THEN 3 WHEN {_AUTOMATIC.replace("decision", "coalesce(human_decision, decision)")} THEN 1 ELSE 0 END
        + CASE WHEN {q.squash("verified_text")} <> '' THEN 1 ELSE 0 END AS INTEGER) AS weight FROM d)
      SELECT DISTINCT ON ({_PLACE}) decision_id, weight FROM w ORDER BY {_PLACE}, weight DESC, decision_id""",
    "w9_preferred": _NORMAL
    + f""" SELECT DISTINCT ON (document, page, key) decision_id, object_type FROM (SELECT *, {q.fold("original")} AS key FROM d) WHERE NOT is_human AND original <> ''
      ORDER BY document, page, key, object_type = 'TABLE_CELL' DESC, decision_id""",
    "s8_effective": _NORMAL
    + f""", w AS (SELECT *, CASE WHEN is_human THEN {_WEIGHT} ELSE 100 END AS weight, NOT is_human AS is_current FROM d WHERE is_human OR NOT coalesce(recovered_from_historical_log, false))
      SELECT DISTINCT ON ({_PLACE}) decision_id, weight, is_current FROM w ORDER BY {_PLACE}, weight DESC, decision_id""",
    "j10_targets": _NORMAL
    + f""", cell AS (SELECT DISTINCT ON (occurrence_id) * FROM value_index ORDER BY occurrence_id, loaded_at DESC NULLS LAST, value DESC NULLS LAST),
      c AS (SELECT {q.label("document_id")} AS document, CAST(page AS VARCHAR) AS page, table_index, source_row_index AS row_index, column_index, {q.squash("value")} AS t, occurrence_id FROM cell),
      i AS (SELECT * FROM d WHERE object_type = 'TABLE_CELL'),
      here AS (SELECT i.decision_id, arg_min(c.occurrence_id, (NOT ((i.original = '' OR i.original = t) AND (i.source = '' OR i.source = t)), c.occurrence_id)) AS cell,
                 bool_or((i.original = '' OR i.original = t) AND (i.source = '' OR i.source = t)) AS same
               FROM i JOIN c ON {_ON_PAGE} WHERE i.table_index <> 0 AND i.row_index <> 0 AND i.column_index <> 0 GROUP BY i.decision_id),
      by_text AS (SELECT document, t, count(*) AS n, min(occurrence_id) AS cell FROM c GROUP BY ALL), by_document AS (SELECT document, count(*) AS n, min(occurrence_id) AS cell FROM c GROUP BY ALL)
      SELECT i.decision_id, CASE WHEN h.same THEN 'coordinates+evidence' WHEN NOT h.same THEN 'coordinates' WHEN coalesce(x.cell, y.cell) IS NOT NULL THEN 'evidence' ELSE 'none' END AS tier, coalesce(h.cell, x.cell, y.cell) AS occurrence_id
      FROM i LEFT JOIN here h USING (decision_id)
        LEFT JOIN by_text x ON x.document = i.document AND x.n = 1 AND (i.original <> '' OR i.source <> '') AND (i.original = '' OR i.original = x.t) AND (i.source = '' OR i.source = x.t)
        LEFT JOIN by_document y ON y.document = i.document AND y.n = 1 AND i.original = '' AND i.source = ''""",
    "k10_actions": _NORMAL
    + f""", line AS (SELECT decision_id AS line_id, received_at, CAST(payload AS JSON) AS p FROM ledger_lines),
      said AS (SELECT line_id, received_at, {q.label("(p ->> 'document')")} AS document, {_PAGE.replace("page", "(p ->> 'page')")} AS page, {q.squash("(p ->> 'original_text')")} AS original, {q.squash("(p ->> 'source_text')")} AS source,
               upper({q.squash("(p ->> 'human_decision')")}) AS action, p ->> 'verified_text' AS told FROM line),
      act AS (SELECT DISTINCT ON (d.decision_id) d.decision_id, action, told FROM d JOIN said USING (document, page, original, source) ORDER BY d.decision_id, received_at DESC NULLS LAST, line_id DESC),
      new AS (SELECT d.*, act.action, {q.squash("CASE act.action WHEN 'USER_CONFIRMED_ORIGINAL' THEN original_text WHEN 'USER_CONFIRMED_SOURCE' THEN source_text ELSE told END")} AS t FROM d LEFT JOIN act USING (decision_id)),
      done AS (SELECT *, coalesce(action IN ({", ".join(f"'{h}'" for h in statuses.HUMAN)}), false) AND t <> '' AS ok FROM new)
      SELECT decision_id, CASE WHEN ok THEN action ELSE human_decision END AS human_decision, CASE WHEN ok THEN t ELSE verified_text END AS verified_text,
        CASE WHEN ok THEN coalesce(human_decision, decision) ELSE previous_status END AS previous_status FROM done""",
    "j20_named_entities": "WITH " + _ASKED_QUESTIONS + " SELECT question, entity_id FROM resolved WHERE n = 1",
    "k5_answers": q.FIELDS + ", " + _ASKED_QUESTIONS + ", " + _ANSWERS,
    "agg16_catalog": q.FIELDS
    + "".join(f""", {kind}_name AS (SELECT DISTINCT '{kind}' AS kind, {q.squash(c)} AS name FROM {rows} WHERE {q.squash(c)} <> '' ORDER BY encode({q.squash(c)}) LIMIT {query.CATALOG[kind]})"""
              for kind, c, rows in (("entity", "display_value", "entities"), ("header", "header", "field"), ("document", "document_id", "field")))
    + " SELECT * FROM entity_name UNION ALL SELECT * FROM header_name UNION ALL SELECT * FROM document_name",
    "g3_overlaps": "WITH " + _BOX
    + f""", once AS (SELECT document, page, bbox, min(decision_id) AS id FROM b WHERE bbox IS NOT NULL GROUP BY ALL)
      SELECT a.document AS document, a.page AS page, count(*) AS n_pairs, count(DISTINCT a.id) AS n_boxes FROM once a JOIN once b ON a.document IS NOT DISTINCT FROM b.document AND a.page = b.page AND a.id < b.id AND {_OVERLAP} > 0.5 GROUP BY ALL""",
    "g21_grid_cells": "WITH " + _BOX
    + """ SELECT document, page, CAST(floor((bbox[2] + bbox[4]) / 2 / 100) AS INTEGER) + 1 AS row_number, CAST(floor((bbox[1] + bbox[3]) / 2 / 100) AS INTEGER) + 1 AS column_number, count(*) AS n
      FROM b WHERE bbox IS NOT NULL AND document IS NOT NULL GROUP BY ALL""",
    "g24_page_boxes": "WITH " + _BOX
    + f""", r AS (SELECT decision_id, text, len(list_filter(bbox, lambda v: v >= 0 AND v <= 1)) = 4 AS rel, bbox FROM b WHERE bbox IS NOT NULL),
      p AS (SELECT decision_id, text, list_transform(bbox, lambda v, i: CAST(round_even(greatest(0.0, least(CASE WHEN i % 2 = 1 THEN 1000.0 ELSE 1400.0 END, CASE WHEN rel THEN v * CASE WHEN i % 2 = 1 THEN 1000.0 ELSE 1400.0 END ELSE v END)), 0) AS INTEGER)) AS x FROM r),
      s AS (SELECT decision_id, text, x[1] AS x1, x[2] AS y1, x[3] AS x2, x[4] AS y2 FROM p)
      SELECT decision_id, x1, y1, x2, y2, x2 - x1 <= 0 OR y2 - y1 <= 0 OR (y2 - y1 >= 560 AND (y2 - y1) / greatest(x2 - x1, 1) >= 12 AND length({q.squash("text")}) <= 160) AS suspicious FROM s""",
    "agg10_confidence": """SELECT occurrence_id, round(coalesce(avg(source_ocr_confidence) FILTER (source_ocr_confidence >= 0), 0.0), 6) AS confidence FROM value_index GROUP BY 1""",
    "op_p5_index_cells": f"""WITH r AS (SELECT unnest(records) AS r FROM entity_retrieval_index), f AS (SELECT r.table_id AS table_id, r.provenance.bbox AS bbox, unnest(r.fields) AS f FROM r WHERE r IS NOT NULL)
      SELECT table_id, count(*) AS n FROM f WHERE f IS NOT NULL AND {q.squash("f.value")} = '' AND bbox IS NULL GROUP BY 1""",
    "k4_contained_values": q.FIELDS
    + f""", asked AS (SELECT DISTINCT query, {q.fold("v")} AS key, string_split({q.fold("v")}, ' ')[1] AS w FROM (SELECT {q.fold("value")} AS query, {q.fold("value")} AS v FROM value_index WHERE {q.value_type("value")} = 'text') WHERE {q.fold("v")} <> ''),
      word AS (SELECT record_id, column_index, {_FOLD_V} AS value_key, unnest(list_distinct(string_split({_FOLD_V}, ' '))) AS w FROM field)
      SELECT query, count(*) AS n_fields, count(DISTINCT record_id) AS n_records FROM asked JOIN word USING (w) WHERE contains(' ' || value_key || ' ', ' ' || key || ' ') GROUP BY query""",
    "w12_queue": _NORMAL
    + f""", o AS (SELECT DISTINCT ON ({_PLACE}) * FROM d WHERE NOT is_human ORDER BY {_PLACE}, coalesce(recovered_from_historical_log, false) DESC, decision_id DESC),
      s AS (SELECT DISTINCT {_PLACE} FROM d WHERE is_human AND trim(coalesce(verified_text, '')) = '')
      SELECT document, decision_id, CAST(row_number() OVER (PARTITION BY document ORDER BY decision_id) AS INTEGER) AS position FROM o
      WHERE NOT EXISTS (SELECT 1 FROM s WHERE {" AND ".join(f"s.{c} IS NOT DISTINCT FROM o.{c}" for c in review.LOCATION)})""",
    "j18_distinct_objects": _NORMAL
    + f""" SELECT decision_id FROM d WHERE object_type = 'PARAGRAPH' AND decision_id NOT IN (SELECT a.decision_id FROM d a JOIN d b ON a.document = b.document AND a.page = b.page
        AND {q.fold("a.original_text")} = {q.fold("b.original_text")} WHERE a.object_type = 'PARAGRAPH' AND b.object_type = 'TABLE_CELL' AND a.bbox IS NOT NULL AND b.bbox IS NOT NULL AND {_OVERLAP} >= 0.90)""",
    "j19_stale_reviews": _NORMAL
    + f""", known AS (SELECT DISTINCT {q.label("document_id")} AS document, CAST(page AS VARCHAR) AS page FROM records)
      SELECT decision_id FROM d WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.document = d.document AND k.page = d.page)""",
    "j23_neighbours": _NORMAL
    + """ SELECT decision_id, lag(original) OVER w AS before, lead(original) OVER w AS after FROM d WHERE object_type = 'PARAGRAPH'
      WINDOW w AS (PARTITION BY document, page ORDER BY paragraph_block NULLS FIRST, decision_id)""",
    "agg18_progress": _NORMAL
    + f""" SELECT document, count(*) AS n, count(*) FILTER (is_human) AS n_human, count(*) FILTER (NOT is_human AND {_AUTOMATIC}) AS n_automatic,
      count(*) FILTER (NOT is_human AND NOT {_AUTOMATIC}) AS n_open, count(*) FILTER (contains(previous_status, 'HIGH_RISK')) AS n_high_risk FROM d GROUP BY document""",
    "k1_lookup": q.FIELDS
    + f""", asked AS (SELECT DISTINCT query FROM (SELECT 'show everything about ' || display_value AS query FROM entities UNION ALL SELECT entity_id FROM entities
        UNION ALL SELECT value FROM value_index WHERE {q.code_like("value")}) WHERE query IS NOT NULL),
      a AS (SELECT query, CASE WHEN starts_with(lower(trim(query)), 'show everything about ') THEN trim(substr(trim(query), 23)) ELSE trim(query) END AS v FROM asked),
      ids AS (SELECT DISTINCT entity_id FROM entities WHERE entity_id IS NOT NULL),
      named AS (SELECT key, min(entity_id) AS entity_id FROM (SELECT entity_id, {q.fold("canonical_value")} AS key FROM entities UNION ALL SELECT entity_id, {q.fold("display_value")} FROM entities) WHERE key <> '' GROUP BY key),
      held AS (SELECT {_FOLD_V} AS key, count(*) AS n FROM field WHERE {_FOLD_V} <> '' GROUP BY 1)
      SELECT query, CASE WHEN ids.entity_id IS NOT NULL THEN 'EXACT_ENTITY_ID' WHEN named.entity_id IS NOT NULL THEN 'EXACT_VALUE' WHEN n IS NOT NULL THEN 'VALUE_MATCH' ELSE 'NO_MATCH' END AS match_type,
        coalesce(ids.entity_id, named.entity_id) AS entity_id, coalesce(n, 0) AS n_fields
      FROM a LEFT JOIN ids ON ids.entity_id = a.v LEFT JOIN named ON named.key = {q.fold("a.v")} LEFT JOIN held ON held.key = {q.fold("a.v")}""",
    "k4_value_matches": q.FIELDS
    + f""" SELECT query, record_id, column_index FROM (SELECT DISTINCT display_value AS query FROM entities WHERE display_value IS NOT NULL) JOIN field ON {q.fold("query")} = {_FOLD_V} WHERE {_FOLD_V} <> ''""",
    "agg15_evidence": q.FIELDS
    + f""" SELECT entity_id, document_id, page, table_id, count(DISTINCT source_row_index) AS n_rows, count(*) AS n_fields, count(DISTINCT {_FOLD_V}) AS n_values
      FROM (SELECT DISTINCT entity_id, record_id FROM entity_links WHERE entity_id IS NOT NULL AND record_id IS NOT NULL) JOIN field USING (record_id) GROUP BY ALL""",
    "k7_conflicts": q.FIELDS
    + f""" SELECT entity_id, {q.fold("header")} AS header, count(DISTINCT {_FOLD_V}) AS n_values, count(*) AS n_fields
      FROM (SELECT DISTINCT entity_id, record_id FROM entity_links WHERE entity_id IS NOT NULL AND record_id IS NOT NULL) JOIN field USING (record_id)
      WHERE {q.fold("header")} <> '' AND {_FOLD_V} <> '' GROUP BY ALL HAVING count(DISTINCT {_FOLD_V}) > 1""",
    "g1_boxes": """WITH b AS (SELECT decision_id, [least(bbox[1], bbox[3]), least(bbox[2], bbox[4]), greatest(bbox[1], bbox[3]), greatest(bbox[2], bbox[4])] AS b FROM manual_review_decisions
        WHERE len(bbox) = 4 AND NOT list_contains(list_transform(bbox, lambda v: v IS NULL), true))
      SELECT decision_id, round((b[3] - b[1]) * (b[4] - b[2]), 3) AS area, round((b[1] + b[3]) / 2, 3) AS x, round((b[2] + b[4]) / 2, 3) AS y FROM b""",
    "w11_runs": q.CELLS
    + """, f AS (SELECT table_id, coalesce(starts_with(verification_status, 'SOURCE_VERIFIED'), false) AS ok,
        sum(CASE WHEN starts_with(verification_status, 'SOURCE_VERIFIED') THEN 0 ELSE 1 END) OVER (PARTITION BY table_id ORDER BY source_row_index, column_index, occurrence_id ROWS UNBOUNDED PRECEDING) AS i FROM cell),
      r AS (SELECT table_id, i, count(*) FILTER (ok) AS n FROM f GROUP BY ALL) SELECT table_id, max(n) AS longest FROM r GROUP BY table_id""",
    "w14_percentiles": f"""WITH b AS (SELECT {q.label("document")} AS document, {_PAGE} AS page, round(greatest(bbox[2], bbox[4]) - least(bbox[2], bbox[4]), 3) AS h FROM manual_review_decisions
        WHERE len(bbox) = 4 AND NOT list_contains(list_transform(bbox, lambda v: v IS NULL), true)),
      l AS (SELECT document, page, list_sort(list(h)) AS h FROM b GROUP BY ALL)
      SELECT document, page, h[least(len(h), CAST(floor(len(h) * 0.5) AS INTEGER) + 1)] AS p50, h[least(len(h), CAST(floor(len(h) * 0.75) AS INTEGER) + 1)] AS p75,
        h[least(len(h), CAST(floor(len(h) * 0.95) AS INTEGER) + 1)] AS p95 FROM l""",
    "agg11_totals": q.CELLS
    + f""" SELECT document_id, grouping(document_id) = 1 AS is_total, count(*) AS n_cells, count(*) FILTER ({q.squash("value")} = '') AS n_empty, count(*) FILTER (verification_status IS NULL) AS n_unverified,
      count(*) FILTER (upper(trim(verification_status)) IN ({", ".join(f"'{s}'" for s in statuses.REVIEW)})) AS n_review,
      count(*) FILTER (upper(trim(verification_status)) IN ({", ".join(f"'{s}'" for s in statuses.UNCERTAIN)})) AS n_uncertain,
      count(*) FILTER (source_ocr_confidence > 0 AND source_ocr_confidence < 0.80) AS n_low_confidence FROM cell GROUP BY ROLLUP (document_id)""",
    "agg14_coverage": q.FIELDS
    + """, e AS (SELECT DISTINCT document_id, table_id, source_row_index, column_index FROM field), f AS (SELECT DISTINCT document_id, table_id, source_row_index, column_index, 1 AS hit FROM value_index)
      SELECT document_id, count(*) AS n_expected, count(hit) AS n_found, count(*) - count(hit) AS n_missing, count(*) = count(hit) AS complete
      FROM e LEFT JOIN f USING (document_id, table_id, source_row_index, column_index) GROUP BY document_id""",
    "snk4_complete_tables": q.CELLS
    + """, p AS (SELECT table_id, page, coalesce(bool_or(verification_status = 'SOURCE_EMPTY'), false) AS failed, count(*) AS n_cells FROM cell GROUP BY ALL)
      SELECT table_id, page, n_cells FROM p WHERE table_id NOT IN (SELECT table_id FROM p WHERE failed)""",
}
