"""Queries of the text problems."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import canonical, duplicates, leaks, ledger, packing, reading_level, scan_noise, survivors
from lodestrata.session import materialize
from lodestrata.sources.tables import table

def _groups(spark: SparkSession, folder: str) -> DataFrame:
    names = ["document", "page", "original_text", "source_text"]
    raw = F.col("raw")
    rules = {n: duplicates.page_number(raw) if n == "page" else duplicates.folded(raw) for n in names}
    entries = ledger.entries(spark, folder).select("decision_id", *names)
    return duplicates.duplicate_groups(entries, "decision_id", {n: F.col(n) for n in names}, rules)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every copy of a ledger entry with the entry that is kept."""
    return _groups(spark, folder).where(F.col("keep") < F.col("decision_id")).select(F.col("keep").alias("keep_id"), F.col("decision_id").alias("copy_id"))


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Each kept entry with the number of its copies, itself included."""
    return _groups(spark, folder).where(F.col("keep") == F.col("decision_id")).select(F.col("keep").alias("keep_id"), "copies")


def _grouped(spark: SparkSession, folder: str, entries: DataFrame) -> DataFrame:
    groups = _groups(spark, folder).where(F.col("copies") > 1).select("decision_id", F.col("keep").alias("group_id"))
    return entries.join(groups, "decision_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """For each group of copies the entries that verified_text and human_decision survive from.

    Only whether a field is blank meets the groups, not its text.
    """
    fields = ["verified_text", "human_decision"]
    oldest = F.coalesce(-F.col("at"), F.lit(2**63 - 1))
    marks = ledger.entries(spark, folder).select("decision_id", "recovered", oldest.alias("age"), *(ledger.blank(F.col(c)).alias(c) for c in fields))
    chosen = survivors.survivors(_grouped(spark, folder, marks), ["group_id"], "decision_id", {c: F.col(c) for c in fields}, [F.col("recovered"), F.col("age")], values=False)
    return chosen.where(F.col("n") > 1).select("group_id", F.col("verified_text_from").alias("text_from"), F.col("human_decision_from").alias("decision_from"))


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    """What the entries of groups of copies say about verified_text. A source is a kind of decision, apart for entries recovered from the log."""
    source = F.concat_ws("/", F.coalesce("human_decision", "decision", F.lit("unknown")), F.when(F.col("recovered"), "recovered"))
    entries = ledger.entries(spark, folder).where(~ledger.blank(F.col("verified_text"))).select("decision_id", source.alias("source"), "verified_text")
    return _grouped(spark, folder, entries)


def p2_truths(spark: SparkSession, folder: str) -> DataFrame:
    """Every verified text of a group of copies with the probability that it is true."""
    return survivors.truths(_claims(spark, folder), "group_id", "source", "verified_text")


def p2_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Sensitivity and specificity of every source of verified texts."""
    quality = survivors.estimate(_claims(spark, folder), "group_id", "source", "verified_text")[1]
    return quality.select("source", F.round("sensitivity", 4).alias("sensitivity"), F.round("specificity", 4).alias("specificity"))


_SCANNED = ["original_text", "source_text", "verified_text"]


def _noise(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "manual_review_decisions").select("decision_id", "document", "page", *_SCANNED)
    return scan_noise.read_noise(rows, "decision_id", "document", "page", _SCANNED).withColumnRenamed("field", "field_name")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of scan noise by decision and field; running lines without the title are no case."""
    kinds = _noise(spark, folder).select("decision_id", "field_name", F.explode("kinds").alias("noise_kind"))
    return kinds.where(F.col("noise_kind") != scan_noise.RUNNING).distinct()


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Every text that had noise, in continuous paragraphs without it."""
    return _noise(spark, folder).select("decision_id", "field_name", F.col("repaired").alias("text")).distinct()


_VALUES = {"value_index": ("occurrence_id", "value"), "manual_review_decisions": ("decision_id", "original_text")}


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose text is written with other characters than it seems to be."""
    parts = []
    for name, (key, column) in _VALUES.items():
        rows = canonical.disguised(table(spark, folder, name).select(F.col(key).alias("row_id"), column), column)
        parts.append(rows.select(F.lit(name).alias("source_table"), "row_id"))
    return parts[0].unionByName(parts[1]).distinct()


def p4_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical spellings in value_index that were written in several ways: spellings and rows of each."""
    values = table(spark, folder, "value_index").where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    by = canonical.canonicalize(values, "value", "spelling").groupBy("spelling")
    return by.agg(F.count(F.lit(1)).alias("n_spellings"), F.sum("n").alias("n_rows")).where("n_spellings > 1")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document for every capacity; over-long documents in pieces."""
    sizes = materialize(packing.token_counts(table(spark, folder, "documents"), "doc_id", "text"), "sizes")
    specs = table(spark, folder, "pack_specs").select("spec_id", "capacity_tokens").distinct().orderBy("spec_id").collect()

    def packed(spec) -> DataFrame:
        placed = packing.pack(sizes, "doc_id", "tokens", spec["capacity_tokens"])
        return placed.select(F.lit(spec["spec_id"]).alias("spec_id"), "doc_id", "piece", "container", "tokens")

    # the capacities don't depend on each other: their jobs share the executors
    with ThreadPoolExecutor(max_workers=4) as pool:
        return reduce(DataFrame.unionByName, pool.map(packed, specs))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers of each capacity, the least possible number, and the share of room used."""
    used = p7_containers(spark, folder).groupBy("spec_id").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"))
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    share = F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4)
    return used.join(table(spark, folder, "pack_specs"), "spec_id").select("spec_id", "containers", least.alias("least_containers"), share.alias("used_share"))


def _leaks(spark: SparkSession, folder: str, edited: bool = False) -> DataFrame:
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), edited=edited)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with twelve or more consecutive words of an evaluation item."""
    return _leaks(spark, folder).where(F.col("longest_run") >= leaks.WINDOW).select("doc_id", "item_id")


def p8_alignments(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and item whose passages align, edited copies included, with the score."""
    return _leaks(spark, folder, edited=True)


#: Shorter documents get no band.
LEAST_CHARS = 400


def _described(spark: SparkSession, folder: str) -> DataFrame:
    english = table(spark, folder, "documents").where("lang = 'en'").select("doc_id", "n_chars", "text")
    described = reading_level.features(english, "doc_id", "text", ["n_chars"])
    return materialize(described, "features").where(F.col("n_chars") >= LEAST_CHARS)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The reading band of every English document without a label."""
    described, labels = _described(spark, folder), table(spark, folder, "level_labels")
    bands = reading_level.fit_bands(described, labels, "doc_id", "reading_band")
    if bands is None:
        return spark.createDataFrame([], "doc_id BIGINT, reading_band INT")
    return reading_level.predict_bands(described.join(labels, "doc_id", "left_anti"), bands, "doc_id")


def p9_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, mean share of unfamiliar words and mean sentence length by band and kind."""
    described, labels = _described(spark, folder), table(spark, folder, "level_labels")
    bands = reading_level.fit_bands(described, labels, "doc_id", "reading_band")
    if bands is None:
        return spark.createDataFrame([], "reading_band INT, n BIGINT, unfamiliar DOUBLE, sentence_words DOUBLE")
    both = reading_level.predict_bands(described, bands, "doc_id").join(described, "doc_id")
    share, words = F.avg(F.col("features")[reading_level.SHARES.index(0.02)]), F.avg(F.col("features")[len(reading_level.SHARES)])
    return both.groupBy("reading_band").agg(F.count(F.lit(1)).alias("n"), F.round(share, 4).alias("unfamiliar"), F.round(words, 2).alias("sentence_words"))


QUERIES = {
    "p2_found": p2_found,
    "p2_truths": p2_truths,
    "p2_sources": p2_sources,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p4_found": p4_found,
    "p4_spellings": p4_spellings,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_alignments": p8_alignments,
    "p9_found": p9_found,
    "p9_profile": p9_profile,
}
