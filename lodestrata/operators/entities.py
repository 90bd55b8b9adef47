"""From values of records to entities: candidates, links, retrieval and the cross-document rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import text
from lodestrata.operators.skew import skew_lookup
from lodestrata.session import materialize

#: A candidate is kept from this score on.
LEAST_SCORE = 0.60
PLACE = ["document_id", "table_id", "table_index", "page", "source_row_index", "column_index"]


def frequencies(fields: DataFrame) -> DataFrame:
    """(key, value_frequency, document_frequency, context_frequency) of each value, by its key."""
    keyed = fields.withColumn("key", text.fold(F.col("value"))).where("key <> ''")
    # two steps: distinct places first, so one frequent value never meets in one task
    places = keyed.groupBy("key", "document_id", "column_index").agg(F.count(F.lit(1)).alias("n"))
    documents = places.groupBy("key", "document_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("contexts"))
    return documents.groupBy("key").agg(
        F.sum("n").alias("value_frequency"), F.count(F.lit(1)).alias("document_frequency"), F.sum("contexts").alias("context_frequency")
    )


def candidate_evidence() -> tuple[Column, Column]:
    """Score and evidence of a value from its column's roles, its frequencies and its looks (columns ``looks_…``)."""
    role = lambda name: F.coalesce(F.col(f"{name}_score"), F.lit(0.0))
    code = F.col("looks_code")
    plain = (role("identifier") < 0.60) & ~code
    repeated = F.least(F.lit(0.10), 0.025 * F.col("value_frequency"))
    terms = [
        ("identifier_role", role("identifier") >= 0.60, 0.65 * role("identifier")),
        ("identifier_like_value", code, F.lit(0.20)),
        ("repeated_value", F.col("value_frequency") >= 2, repeated),
        ("repeated_column_context", F.col("context_frequency") >= 2, F.lit(0.05)),
        ("cross_document_occurrence", F.col("document_frequency") >= 2, F.lit(0.10)),
        ("temporal_suppression", (role("temporal") >= 0.70) | F.col("looks_temporal"), F.lit(-0.35)),
        ("measurement_suppression", (role("measurement") >= 0.70) | F.col("looks_numeric"), F.lit(-0.45)),
        ("status_suppression", (role("status") >= 0.80) & plain, F.lit(-0.20)),
        ("parameter_suppression", (role("parameter") >= 0.80) & plain, F.lit(-0.10)),
        ("categorical_penalty", (role("categorical") >= 0.80) & plain, F.lit(-0.05)),
    ]
    score = F.lit(0.0)
    for _, holds, points in terms:
        score = score + F.when(holds, points).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds, _ in terms)))


def scored_occurrences(fields: DataFrame, profiles: DataFrame) -> DataFrame:
    """Field occurrences that score as candidates, with score and evidence."""
    roles = profiles.select("table_id", "column_index", *(f"{r}_score" for r in ("identifier", "temporal", "measurement", "categorical", "parameter", "status")))
    keyed = fields.withColumn("key", text.fold(F.col("value"))).where("key <> ''")
    # looks are taken once per distinct value, and before the joins, so no expression repeats them
    v = F.col("value")
    looks = keyed.select("key", "value").distinct().withColumns({"looks_code": text.code_like(v), "looks_temporal": text.temporal_like(v), "looks_numeric": text.numeric_like(v)})
    joined = keyed.join(roles, ["table_id", "column_index"], "left")
    joined = skew_lookup(skew_lookup(joined, frequencies(fields), ["key"], "inner"), looks, ["key", "value"], "inner")
    score, evidence = candidate_evidence()
    return joined.withColumns({"score": score, "evidence": evidence}).where(F.col("score") >= LEAST_SCORE).drop("looks_code", "looks_temporal", "looks_numeric")


def candidates(occurrences: DataFrame) -> DataFrame:
    """One row per candidate value: best and mean score, counts, evidence, and its most frequent spelling (the smallest on a tie)."""
    spelled = occurrences.groupBy("key", text.squash(F.col("value")).alias("spelling")).agg(F.count(F.lit(1)).alias("n"))
    display = spelled.groupBy("key").agg(F.min_by("spelling", F.struct(-F.col("n"), "spelling")).alias("display_value"))
    rolled = occurrences.groupBy("key").agg(
        F.round(F.max("score"), 6).alias("score"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.count(F.lit(1)).alias("occurrence_count"),
        F.countDistinct("document_id").alias("document_count"),
        F.countDistinct("document_id", "table_id").alias("table_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence"),
    )
    return rolled.join(display, "key").withColumnRenamed("key", "canonical_value")


def number_candidates(found: DataFrame) -> DataFrame:
    """Candidates with ``entity_000001`` and on: best first, then frequent, then by value.

    The order is total, so ranks come from one range-partitioned sort: the place
    inside a partition plus the sizes of the partitions before it.
    """
    ordered = found.repartitionByRange(F.desc("score"), F.desc("occurrence_count"), "canonical_value").sortWithinPartitions(F.desc("score"), F.desc("occurrence_count"), "canonical_value")
    placed = materialize(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("bigint"), 33)), "ranked")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_before", before).drop("_n")
    ranked = placed.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_before") + F.col("_row") + 1)
    return ranked.withColumn("entity_candidate_id", F.format_string("entity_%06d", F.col("rank"))).drop("_part", "_row", "_before")


def link_entities(found: DataFrame, fields: DataFrame) -> DataFrame:
    """Every record field that holds a candidate's value, linked to its entity, each occurrence once.

    Joined on the key of the exploded fields; the status of the record's source
    travels along.
    """
    keys = found.select("canonical_value", "display_value", text.entity_id(F.col("canonical_value")).alias("entity_id"))
    keyed = fields.withColumn("canonical_value", text.fold(F.col("value")))
    linked = skew_lookup(keyed, keys, ["canonical_value"], "inner")
    # of repeated fields the first by their whole row, whatever order they arrive in
    return first_seen(linked, ["entity_id", "record_id", "column_index"], [c for c in linked.columns if c not in ("entity_id", "record_id", "column_index")])


def entity_rollup(links: DataFrame) -> DataFrame:
    """Entities with counts of occurrences, documents and tables, and whether they cross documents."""
    rolled = links.groupBy("entity_id", "canonical_value").agg(
        F.count(F.lit(1)).alias("occurrence_count"),
        F.countDistinct("document_id").alias("document_count"),
        F.countDistinct("document_id", "table_index").alias("table_count"),
        F.countDistinct("record_id").alias("record_count"),
    )
    return rolled.withColumn("link_status", F.when(F.col("document_count") > 1, "cross_document").otherwise("single_document"))


def merge_occurrences(candidate: DataFrame, verified: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate and verified occurrences of the same place as one row; what is verified wins."""
    a = candidate.select(*keys, F.col("value").alias("candidate_value"), F.col("source_status").alias("candidate_status"))
    b = verified.select(*keys, F.col("value").alias("verified_value"), F.col("source_status").alias("verified_status"))
    both = a.join(b, keys, "full_outer")
    return both.select(
        *keys,
        F.coalesce("verified_value", "candidate_value").alias("value"),
        F.coalesce("verified_status", "candidate_status", F.lit("UNKNOWN")).alias("source_status"),
        F.col("verified_value").isNotNull().alias("is_verified"),
    )


def retrieval_records(links: DataFrame, records: DataFrame) -> DataFrame:
    """One row per entity and record, by the record's id: its fields in the order of their columns, unnumbered ones last.

    A link to a record that does not exist is kept with an empty field list.
    """
    held = records.select("record_id", F.col("source_status").alias("record_status"), ordered_fields(F.col("fields")).alias("fields"))
    once = links.groupBy("entity_id", "record_id").agg(F.min("column_index").alias("entity_column_index"))
    joined = once.join(held, "record_id", "left")
    empty = F.slice(F.col("fields"), 1, 0)
    return joined.withColumns({"fields": F.coalesce("fields", empty, F.array()), "source_status": F.coalesce("record_status", F.lit("UNKNOWN"))}).drop("record_status").withColumn("field_count", F.size("fields"))


def ordered_fields(fields: Column) -> Column:
    """The non-null entries of a field map as an array in column order."""
    entries = F.filter(F.map_entries(fields), lambda e: e["value"].isNotNull())
    number = lambda e: F.coalesce(F.regexp_extract(e["key"], r"(\d+)$", 1).try_cast("int"), F.lit(2**31 - 1))
    keyed = F.transform(entries, lambda e: F.struct(number(e).alias("n"), e["key"].alias("k"), e["value"].alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["n"].alias("column_index"), x["v"]["header"].alias("header"), x["v"]["value"].alias("value")))


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the stated order, decided by a partial minimum and not by arrival."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("s")).select(*keys, "s.*")


def cross_document_rollup(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Entities of either side with their occurrences rolled up over documents; those without any have counts of 0."""
    own = entities.where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.max("canonical_value").alias("canonical_value"))
    distinct = links.where("entity_id IS NOT NULL").groupBy("entity_id", "document_id", "page", "table_id", "source_row_index").agg(F.max("normalized_value").alias("value"))
    counts = distinct.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("occurrence_count"),
        F.countDistinct("document_id").alias("document_count"),
        F.countDistinct("document_id", "page", "table_id").alias("table_count"),
        F.max("value").alias("value"),
    )
    both = own.join(counts, "entity_id", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return both.select(
        "entity_id", F.coalesce("canonical_value", "value").alias("canonical_value"), zero("occurrence_count"), zero("document_count"), zero("table_count"),
        (F.coalesce("document_count", F.lit(0)) > 1).alias("cross_document"),
    )


def inverted_index(cells: DataFrame) -> DataFrame:
    """Distinct places of each value key: the inverted index kept flat, one row per key and place."""
    return cells.select(text.fold(F.col("value")).alias("key"), *PLACE).where("key <> ''").distinct()


def index_statistics(records: DataFrame, fields: DataFrame) -> DataFrame:
    """(statistic, n): numbers of documents, tables, records, fields and distinct values."""
    held = [("documents", "document_id"), ("tables", "table_id"), ("records", "record_id")]
    a = records.agg(*(F.countDistinct(c).alias(n) for n, c in held)).unpivot([], [n for n, _ in held], "statistic", "n")
    b = fields.agg(F.count(F.lit(1)).alias("fields"), F.countDistinct(F.nullif(text.fold(F.col("value")), F.lit(""))).alias("distinct_values"))
    return a.unionByName(b.unpivot([], ["fields", "distinct_values"], "statistic", "n"))
