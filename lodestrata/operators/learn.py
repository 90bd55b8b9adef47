"""Rules learned from reviewed decisions, and their lookup: one key function for both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import statuses, text

# Families from the most specific on, with the least examples and the least documents of a rule.
FAMILIES = {
    "exact": (1, 0), "generalized": (2, 0), "structural": (2, 0), "context": (2, 0), "cross_generalized": (3, 2), "cross_structural": (3, 2),
    "character_edit": (2, 2), "local": (3, 2),
}
#: Observations that agree in all of these are one.
EVIDENCE = ["document", "page", "table_index", "row_index", "column_index", "bbox", "original", "source"]
#: Characters before and after a substitution that a local rule looks at.
AROUND = 2


def human_evidence(decisions: DataFrame) -> DataFrame:
    """Decisions of people with normalised object type, action and settled text; of one observation the first entry counts."""
    d = F.col
    human = decisions.where(statuses.is_human(d("human_decision")))
    settled = statuses.chosen_text(d("human_decision"), d("original_text"), d("source_text"), d("verified_text"))
    typed = human.withColumns({
        "object_type": statuses.object_type(d("object_type"), d("paragraph_block")), "page": text.page_key(d("page")),
        "original": text.squash(d("original_text")), "source": text.squash(d("source_text")),
        "action": statuses.action(d("human_decision")), "settled": text.squash(settled),
    }).where("settled <> ''")
    rest = [c for c in typed.columns if c not in EVIDENCE]
    return typed.groupBy(*EVIDENCE).agg(F.min_by(F.struct(*rest), "decision_id").alias("s")).select(*EVIDENCE, "s.*")


def _context(d) -> Column:
    """Where a rule holds: a column of a table, or paragraphs."""
    cell = F.concat_ws("/", d("table_index").cast("string"), d("column_index").cast("string"))
    return F.when(d("object_type") == "TABLE_CELL", cell).otherwise("")


def _keyed(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """One row per row and key that applies: columns ``family`` and ``key``."""
    exploded = rows.withColumn("f", F.explode(F.array(*(F.struct(F.lit(f).alias("family"), k.alias("key")) for f, k in keys.items())))).where("f.key IS NOT NULL")
    return exploded.withColumns({"family": F.col("f.family"), "key": F.col("f.key")}).drop("f")


def keyed_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of readings (original, source) by the keys of the families that both sides share: all but character edits.

    Shapes are texts with a sign for each letter, digit and space, which tell the
    same apart as counted runs do. A generalized key adds the classes of the places
    where texts of one length differ. Several such places give several local keys.
    """
    d = F.col
    a, b, kind = d("original"), d("source"), d("object_type")
    shaped = pairs.withColumns({"_ca": text.class_string(a), "_cb": text.class_string(b), "_context": _context(d), "_edits": text.edit_classes(a, b)})
    both = (a != "") & (b != "")
    classes = F.transform("_edits", lambda e: F.concat(F.substring("_ca", e["position"] + 1, F.lit(1)), F.lit(">"), F.substring("_cb", e["position"] + 1, F.lit(1))))
    changed = F.concat_ws(" ", classes)
    keys = {
        "exact": F.when((a != "") | (b != ""), text.rule_key(kind, a, b)),
        "generalized": F.when(both, text.rule_key(kind, d("_context"), d("_ca"), d("_cb"), changed)),
        "structural": F.when(both, text.rule_key(kind, d("_context"), d("_ca"), d("_cb"))),
        "context": F.when(a != "", text.rule_key(kind, d("_context"), d("_ca"))),
        "cross_generalized": F.when(both, text.rule_key(kind, d("_ca"), d("_cb"), changed)),
        "cross_structural": F.when(both, text.rule_key(kind, d("_ca"), d("_cb"))),
    }
    last = F.length(a) - 1
    place = lambda p: F.when(p == 0, "START").when(p == last, "END").otherwise("MIDDLE")
    # the edits are exploded first: shapes of a few characters are column rules, not lambdas
    around = shaped.where(F.size("_edits") > 0).withColumn("e", F.explode("_edits"))
    at = F.col("e.position")
    left = text.class_string(F.substring(a, F.greatest(at - AROUND, F.lit(0)) + 1, F.least(at, F.lit(AROUND))))
    right = text.class_string(F.substring(a, at + 2, F.lit(AROUND)))
    local = around.withColumns({"family": F.lit("local"), "key": text.rule_key(kind, F.col("e.from"), F.col("e.to"), left, right, place(at))}).drop("e")
    return _keyed(shaped, keys).unionByName(local).drop("_ca", "_cb", "_context")


def learn_rules(decisions: DataFrame) -> DataFrame:
    """Every key with its examples, documents and verdict: promoted, conflict or too little evidence.

    An exact rule needs one settled text. Other families need one side that was
    always right, examples and documents; entered texts name no side, so they count
    for the documents only. A character edit leads from the reading that was wrong
    to the settled text by one substitution. A key of entered texts only is no rule.
    """
    evidence = human_evidence(decisions)
    pairs = keyed_pairs(evidence).drop("_edits")
    value = F.when(F.col("family") == "exact", F.col("settled")).otherwise(F.col("action"))
    wrong = F.when(F.col("action") == "original", F.col("source")).otherwise(F.col("original"))
    edits = evidence.withColumn("_e", text.edit_classes(wrong, F.col("settled"))).where(F.size("_e") == 1).withColumn("e", F.get("_e", F.lit(0)))
    edits = edits.withColumns({"family": F.lit("character_edit"), "key": text.rule_key(F.col("object_type"), F.col("e.from"), F.col("e.to")), "value": F.col("e.to")})
    columns = ["family", "key", "value", "document"]
    rows = pairs.withColumn("value", value).select(columns).unionByName(edits.select(columns))
    grouped = rows.groupBy("family", "key").agg(
        F.count("value").alias("examples"), F.countDistinct(F.nullif(F.trim("document"), F.lit(""))).alias("documents"), F.countDistinct("value").alias("values"), F.min("value").alias("value")
    ).where("examples > 0")
    enough = F.lit(False)
    for family, (examples, documents) in FAMILIES.items():
        enough = enough | ((F.col("family") == family) & (F.col("examples") >= examples) & (F.col("documents") >= documents))
    verdict = F.when(F.col("values") > 1, "conflict").when(enough, "promoted").otherwise("insufficient")
    return grouped.withColumn("verdict", verdict).withColumn("value", F.when(F.col("values") == 1, F.col("value"))).drop("values")


def apply_rules(pairs: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(key, family, verified_text): the most specific promoted rule for each pair whose readings differ, or that a character edit changes.

    All families are looked up by equality; the order of the families decides
    afterwards, so no tier hides another. A local rule holds for pairs that differ in
    one place. A character edit holds, whatever the object, for a character that the
    source has once and the original has in the same place too; it is then replaced
    in the original. Of several edits the one with the most examples counts, then
    the first by key.
    """
    d = F.col
    typed = pairs.withColumns({"original": text.squash(d("original_text")), "source": text.squash(d("source_text"))}).where("original <> '' AND source <> ''").withColumnRenamed(key, "_id")
    promoted = rules.where("verdict = 'promoted'").select("family", "key", "value", "examples")
    keyed = keyed_pairs(typed.where("original <> source")).where((F.col("family") != "local") | (F.size("_edits") == 1))
    told = F.when(F.col("family") == "exact", F.col("value")).when(F.col("value") == "original", F.col("original")).otherwise(F.col("source"))
    hits = keyed.join(promoted, ["family", "key"]).select("_id", "family", "examples", "key", told.alias("verified_text"))
    # characters that a rule says are misread, once in the source and in the same place of the original
    repaired = lambda c: text.squash(text.repair_mojibake(c))
    edits = promoted.where("family = 'character_edit'").withColumn("parts", F.from_json("key", "ARRAY<STRING>")).select(
        F.col("parts")[1].alias("character"), F.col("parts")[2].alias("target"), "family", "examples", "key"
    )
    letters = typed.withColumns({"_a": repaired(d("original")), "_b": repaired(d("source"))}).where(F.length("_a") == F.length("_b"))
    letters = letters.withColumn("character", F.explode(F.array_distinct(F.split("_b", ""))))
    once = letters.where("character <> ''").withColumn("_at", F.instr("_b", F.col("character")))
    once = once.where((F.length("_b") - F.length(F.replace("_b", F.col("character"), F.lit(""))) == F.length("character")) & (F.substring("_a", F.col("_at"), F.lit(1)) == F.col("character")))
    changed = F.concat(F.substring("_a", F.lit(1), F.col("_at") - 1), F.col("target"), F.substring("_a", F.col("_at") + 1, F.length("_a")))
    hits = hits.unionByName(once.join(edits, "character").select("_id", "family", "examples", "key", changed.alias("verified_text")))
    order = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family"))
    best = hits.groupBy("_id").agg(F.min_by(F.struct("family", "verified_text"), F.struct(order.alias("o"), (-F.col("examples")).alias("n"), "key")).alias("b"))
    return best.select(F.col("_id").alias(key), "b.family", "b.verified_text")
