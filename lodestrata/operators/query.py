"""Questions to the index, many at a time: exact lookups, a scan of values, and plain-language questions with a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators.skew import skew_lookup
from lodestrata.session import materialize

# Nouns that name no field in particular.
GENERIC = ["value", "measurement", "reading", "data", "information"]


def lookup(queries: DataFrame, entities: DataFrame, fields: DataFrame) -> DataFrame:
    """(query, match_type, entity_id, n_fields) for each distinct query: by id, else by value, else in any field.

    The id is compared as written, values by their key. One equi-join per tier;
    queries without a match have NO_MATCH.
    """
    asked = queries.select("query").distinct().withColumn("asked", text.query_value(F.col("query"))).withColumn("key", text.fold(F.col("asked")))
    ids = entities.where("entity_id IS NOT NULL").select(F.col("entity_id").alias("asked"), F.col("entity_id").alias("by_id")).distinct()
    named = entities.select("entity_id", F.explode(F.array(text.fold(F.col("canonical_value")), text.fold(F.col("display_value")))).alias("key")).where("key <> ''")
    values = named.groupBy("key").agg(F.min("entity_id").alias("by_value"))
    held = fields.select(text.fold(F.col("value")).alias("key")).where("key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    found = asked.join(ids, "asked", "left").join(values, "key", "left").join(held, "key", "left")
    kind = F.when(F.col("by_id").isNotNull(), "EXACT_ENTITY_ID").when(F.col("by_value").isNotNull(), "EXACT_VALUE").when(F.col("n").isNotNull(), "VALUE_MATCH").otherwise("NO_MATCH")
    return found.select("query", kind.alias("match_type"), F.coalesce("by_id", "by_value").alias("entity_id"), F.coalesce("n", F.lit(0)).alias("n_fields"))


def value_matches(queries: DataFrame, fields: DataFrame, mode: str = "exact") -> DataFrame:
    """Every field whose value a query names, whole (``exact``) or as part of it (``contains``, by whole words).

    ``contains`` joins on words too: the word of the query that the fewest values
    hold must be a word of the value, the rest is compared afterwards.
    """
    asked = queries.select("query").distinct().withColumn("key", text.fold(text.query_value(F.col("query")))).where("key <> ''")
    keyed = fields.withColumn("value_key", text.fold(F.col("value"))).where("value_key <> ''")
    if mode == "exact":
        return asked.join(keyed.withColumnRenamed("value_key", "key"), "key").drop("key")
    if mode != "contains":
        raise ValueError(f"unknown mode {mode!r}")
    worded = keyed.withColumn("word", F.explode(F.array_distinct(F.split("value_key", " "))))
    held = worded.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = asked.withColumn("word", F.explode(F.array_distinct(F.split("key", " ")))).join(held, "word", "left")
    # a word that no value holds leaves the query without a match
    asked = words.groupBy("query", "key").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("word"))
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return asked.join(worded, "word").where(padded("value_key").contains(padded("key"))).drop("word", "key", "value_key")


def question_words(question: Column) -> Column:
    """The words of a question as keys, edge punctuation gone."""
    words = F.transform(F.split(text.fold(question), " "), lambda w: F.regexp_replace(w, r"(?U)^[^\w.\-]+|[^\w\-]+$", ""))
    return F.filter(words, lambda w: w != "")


def spans(words: Column, most: Column) -> Column:
    """All runs of up to ``most`` of the words: the keys that entities are joined by."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)))
    sizes = lambda i: F.sequence(F.lit(1), F.greatest(F.least(most, F.size(words) - i + 1), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(sizes(i), lambda n: F.array_join(F.slice(words, i, n), " ")))))


def resolve_entities(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """(question, entity_id): the entity with the longest value that a question names; none where two share that length."""
    named = entities.select("entity_id", F.explode(F.array(text.fold(F.col("canonical_value")), text.fold(F.col("display_value")))).alias("key")).where("key <> ''").distinct()
    worded = questions.select("question").distinct().withColumn("words", question_words(F.col("question")))
    most = named.agg(F.coalesce(F.max(F.size(F.split("key", " "))), F.lit(1)).alias("most"))
    parts = worded.crossJoin(F.broadcast(most)).select("question", F.explode(spans(F.col("words"), F.col("most"))).alias("key"))
    hits = parts.join(named, "key").groupBy("question", F.length("key").alias("length")).agg(F.countDistinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id"))
    longest = hits.groupBy("question").agg(F.max(F.struct("length", "n", "entity_id")).alias("b"))
    return longest.where("b.n = 1").select("question", "b.entity_id")


def answer_questions(questions: DataFrame, entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question, status, answer, entity_id, field, n_evidence) for each distinct question.

    ``evidence`` has one row per field of an occurrence: entity_id, occurrence,
    document_id, header, value, verification_status. The field is found over all
    occurrences of the entity by the words it shares with the question, and before
    the month that the question may name.
    """
    asked = questions.select("question").distinct()
    named = materialize(skew_lookup(asked, resolve_entities(asked, entities), ["question"], "left"), "named")
    headers = evidence.select("entity_id", text.fold(F.col("header")).alias("header")).where("header <> ''").distinct()
    headers = headers.withColumn("word", F.explode(text.content_words(F.col("header"))))
    worded = named.where("entity_id IS NOT NULL").select("question", "entity_id", F.explode(text.content_words(F.col("question"))).alias("word"))
    scored = worded.join(headers, ["entity_id", "word"]).groupBy("question", "header").agg(F.count(F.lit(1)).alias("overlap"))
    best = scored.groupBy("question", "overlap").agg(F.count(F.lit(1)).alias("n"), F.min("header").alias("field"))
    best = best.groupBy("question").agg(F.max(F.struct("overlap", "n", "field")).alias("b")).select("question", F.col("b.n").alias("n_fields"), "b.field")
    state = materialize(named.join(best, "question", "left").withColumn("month", text.month_of(F.col("question"))), "state")
    wanted = state.where("n_fields = 1").select("question", "entity_id", "field", "month")
    dated = evidence.withColumn("m", _month_in(F.col("value"))).groupBy("entity_id", "occurrence").agg(F.min_by("m", F.when(F.col("m").isNotNull(), F.col("column_index"))).alias("by_field"))
    # evidence is summed by entity, field and month first: questions meet the sums, however much an entity has
    rows = evidence.withColumns({"field": text.fold(F.col("header")), "key": text.fold(F.col("value"))}).join(dated, ["entity_id", "occurrence"], "left")
    rows = rows.withColumn("occurrence_month", F.coalesce("by_field", text.month_of(F.translate("document_id", "_-", "  "))))
    disagrees = F.max(F.coalesce(F.col("verification_status") == "NUMERIC_DISAGREEMENT", F.lit(False)))
    sums = rows.groupBy("entity_id", "field", "occurrence_month").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("greatest"), F.min("value").alias("value"), disagrees.alias("disagrees")
    )
    facts = wanted.join(sums, ["entity_id", "field"]).where("month IS NULL OR month = occurrence_month")
    several = F.min("least") != F.max("greatest")
    rolled = facts.groupBy("question").agg(F.sum("n").alias("n_evidence"), several.alias("several"), F.min("value").alias("answer"), F.max("disagrees").alias("disagrees"))
    generic = F.arrays_overlap(F.regexp_extract_all(text.fold(F.col("question")), F.lit("[a-z0-9]+"), F.lit(0)), F.array(*map(F.lit, GENERIC)))
    status = (
        F.when(F.col("entity_id").isNull(), "NO_ENTITY_OR_AMBIGUOUS_ENTITY")
        .when(F.col("n_fields").isNull() & ~generic, "FIELD_NOT_FOUND")
        .when(F.col("n_fields").isNull() | (F.col("n_fields") > 1), "FIELD_AMBIGUOUS")
        .when(F.col("n_evidence").isNull(), F.when(F.col("month").isNotNull(), "NO_MATCHING_DATA").otherwise("NO_EVIDENCE"))
        .when(F.col("several"), "AMBIGUOUS_MULTIPLE_VALUES")
        .when(F.col("disagrees"), "UNVERIFIED_SOURCE_DISAGREEMENT")
        .when(F.col("n_evidence") == 1, "ANSWERED")
        .otherwise("CONSISTENT_MULTIPLE_EVIDENCE")
    )
    out = state.join(rolled, "question", "left").withColumn("status", status)
    settled = F.col("status").isin("ANSWERED", "CONSISTENT_MULTIPLE_EVIDENCE", "UNVERIFIED_SOURCE_DISAGREEMENT")
    field = F.when(F.col("n_fields") == 1, F.col("field"))
    return out.select("question", "status", F.when(settled, F.col("answer")).alias("answer"), "entity_id", field.alias("field"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def _month_in(value: Column) -> Column:
    month = F.regexp_extract(value, r"\b\d{4}[-/](\d{1,2})[-/]\d{1,2}\b", 1).try_cast("int")
    return F.when(month.between(1, 12), month)


def evidence_by_table(evidence: DataFrame) -> DataFrame:
    """Evidence of each entity per document, page and table: distinct rows, fields and values."""
    return evidence.groupBy("entity_id", "document_id", "page", "table_id").agg(
        F.countDistinct("source_row_index").alias("n_rows"), F.count(F.lit(1)).alias("n_fields"), F.countDistinct(text.fold(F.col("value"))).alias("n_values")
    )


def conflicts(evidence: DataFrame) -> DataFrame:
    """(entity_id, header): fields of an entity for which its records give different values, with how many."""
    rows = evidence.select("entity_id", text.fold(F.col("header")).alias("header"), text.fold(F.col("value")).alias("value")).where("header <> '' AND value <> ''")
    return rows.groupBy("entity_id", "header").agg(F.countDistinct("value").alias("n_values"), F.count(F.lit(1)).alias("n_fields")).where("n_values > 1")


# Names of each kind in a catalog.
CATALOG = {"entity": 250, "header": 250, "document": 100}


def catalog(entities: DataFrame, fields: DataFrame) -> DataFrame:
    """(kind, name): the first names of entities, headers and documents, at most CATALOG of each (this limit is its purpose)."""
    first = lambda rows, most: rows.where("name <> ''").distinct().orderBy("name").limit(most)
    named = lambda kind, c, df: first(df.select(F.lit(kind).alias("kind"), text.squash(F.col(c)).alias("name")), CATALOG[kind])
    return named("entity", "display_value", entities).unionByName(named("header", "header", fields)).unionByName(named("document", "document_id", fields))
