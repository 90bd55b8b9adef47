"""The review queue and the evidence that can answer its items: ordered tiers, and none where people disagree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import statuses, text
from lodestrata.operators import geometry, learn, merge
from lodestrata.operators.skew import numbered

LOCATION = ["document", "page", "object_type", "table_index", "row_index", "column_index", "paragraph_block"]
#: Least overlap of boxes that show the same place, and of a paragraph that repeats a cell.
SAME_PLACE, SAME_OBJECT = 0.80, 0.90
# Fixed value: what an item that is open now weighs against decisions of the past.
CURRENT_WEIGHT = 100


def normalised(decisions: DataFrame) -> DataFrame:
    """Decisions with one spelling of object type, page and document."""
    d = F.col
    return decisions.withColumns({
        "object_type": statuses.object_type(d("object_type"), d("paragraph_block")),
        "page": text.page_key(d("page")),
        "document": text.label(d("document")),
        "original": text.squash(d("original_text")),
        "source": text.squash(d("source_text")),
        "settled": text.squash(statuses.chosen_text(d("human_decision"), d("original_text"), d("source_text"), d("verified_text"))),
        "is_human": statuses.is_human(d("human_decision")),
    })


def unanimous(evidence: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): the text that all evidence of a key settles on; keys with two texts give none."""
    agreed = evidence.groupBy(*keys).agg(F.countDistinct("settled").alias("n"), F.min("settled").alias(name))
    return agreed.where("n = 1").select(*keys, name)


def evidence_tiers(items: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """(key, one column per tier) for open items: what each kind of evidence would answer.

    ``exact``: same document, page and both readings. ``place``: same document,
    page and original, boxes that overlap, the best overlap. ``legacy``: the one
    paragraph decision about this original. ``pair``: both readings anywhere.
    ``text``: originals that people only ever confirmed unchanged. Each tier's
    evidence is brought to its key first, then joined by equality.
    """
    human = decisions.where(F.col("is_human") & (F.col("settled") != ""))
    exact = unanimous(human, ["document", "page", "original", "source"], "exact")
    pair = unanimous(human, ["original", "source"], "pair")
    legacy = human.where("object_type = 'PARAGRAPH'").groupBy("document", "page", "original").agg(F.count(F.lit(1)).alias("n"), F.min("settled").alias("legacy"))
    legacy = legacy.where("n = 1").drop("n")
    kept = human.groupBy("original").agg(F.bool_and(F.col("settled") == F.col("original")).alias("kept")).where("kept").select("original", F.col("original").alias("text"))
    # distinct boxes on both sides: copies of one decision never multiply
    where = ["document", "page", "original"]
    boxed = human.where("bbox IS NOT NULL").groupBy(*where, F.col("bbox").alias("known"), F.col("settled").alias("known_text")).agg(F.min(key).alias("known_id"))
    near = items.where("bbox IS NOT NULL").select(*where, "bbox").distinct().join(boxed, where)
    overlap = geometry.overlap_of_smaller(F.col("bbox"), F.col("known"))
    place = near.withColumn("o", overlap).where(F.col("o") >= SAME_PLACE).groupBy(*where, "bbox").agg(F.max_by("known_text", F.struct("o", (-F.col("known_id")).alias("early"))).alias("place"))
    out = items.join(exact, [*where, "source"], "left").join(place, [*where, "bbox"], "left").join(legacy, where, "left")
    return out.join(pair, ["original", "source"], "left").join(kept, "original", "left")


def answer_items(items: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """(key, tier, answer): the first tier that answers each open item, then learned rules; no tier may close a high-risk item."""
    tiers = ["exact", "place", "legacy", "pair", "text"]
    found = evidence_tiers(items, decisions, key)
    learned = learn.apply_rules(items, key, learn.learn_rules(decisions)).select(key, F.col("verified_text").alias("rule"))
    found = found.join(learned, key, "left")
    every = [*tiers, "rule"]
    tier = F.coalesce(*(F.when(F.col(t).isNotNull(), F.lit(t)) for t in every))
    veto = F.coalesce(F.col("previous_status").contains("HIGH_RISK"), F.lit(False))
    return found.select(key, F.when(~veto, tier).alias("tier"), F.when(~veto, F.coalesce(*map(F.col, every))).alias("answer"))


def current_decisions(decisions: DataFrame, at: Column, key: str) -> DataFrame:
    """The last decision for each place."""
    return merge.latest_wins(decisions, [F.col(c) for c in LOCATION], [at, F.col(key)])


def authority(decision: Column, verified: Column) -> Column:
    """How much a decision weighs: entered texts before confirmations before reuse, one more with a text."""
    s = statuses.status(decision)
    weight = F.when(s.isin("USER_ENTERED_CORRECTION", "USER_CORRECTION"), 5).when(s == "USER_CONFIRMED_SOURCE", 4).when(s == "USER_CONFIRMED_ORIGINAL", 3).when(statuses.is_automatic(decision), 1).otherwise(0)
    return weight + F.when(text.squash(verified) != "", 1).otherwise(0)


def authoritative(decisions: DataFrame, key: str) -> DataFrame:
    """The decision that counts for each place: the greatest authority, the first entry on a tie."""
    weight = authority(F.coalesce("human_decision", "decision"), F.col("verified_text"))
    return merge.latest_wins(decisions.withColumn("weight", weight), [F.col(c) for c in LOCATION], [F.col("weight"), -F.col(key)])


def queue(unresolved: DataFrame, historical: DataFrame, skipped: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Open items of both sides, the historical one where they share a place, without skipped places, numbered per document."""
    both = historical.withColumn("_old", F.lit(1)).unionByName(unresolved.withColumn("_old", F.lit(0)))
    once = merge.latest_wins(both, [F.col(k) for k in keys], [F.col("_old"), *map(F.col, order)]).drop("_old")
    condition = None
    gone = skipped.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        condition = same if condition is None else condition & same
    return numbered(once.join(gone, condition, "left_anti"), "document", order, "position")


def preferred(items: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Of items that agree in ``keys`` one: a table cell before a paragraph, then the first entry."""
    return merge.latest_wins(items, [F.col(k) for k in keys], [F.col("object_type") == "TABLE_CELL", -F.col(key)])


def effective(decisions: DataFrame, current: DataFrame, keys: list[str], key: str) -> DataFrame:
    """The decision that counts for each group of ``keys``: an item that is open now before all, then by authority, the first entry on a tie."""
    weight = authority(F.coalesce("human_decision", "decision"), F.col("verified_text"))
    both = decisions.withColumns({"weight": weight, "is_current": F.lit(False)}).unionByName(current.withColumns({"weight": F.lit(CURRENT_WEIGHT), "is_current": F.lit(True)}))
    return merge.latest_wins(both, [F.col(k) for k in keys], [F.col("weight"), -F.col(key)])


def find_targets(items: DataFrame, cells: DataFrame, key: str, cell: str) -> DataFrame:
    """(key, tier, cell): the cell that each item is about.

    ``coordinates+evidence`` and ``coordinates``: the cell in the item's place (the
    first one, where several were delivered; one that holds the item's texts before
    others); ``evidence``: the only cell of the document that holds them; else
    ``none``. Places are document, page, table_index, row_index and column_index,
    all of them set and not 0; cells have original and source too. An empty text
    agrees with any.
    """
    place = ["document", "page", "table_index", "row_index", "column_index"]
    agrees = lambda a, b: (F.col(a) == "") | (F.col(a) == F.col(b))
    both = agrees("original", "_o") & agrees("source", "_s")
    given = items.select(key, *place, "original", "source")
    set_ = F.lit(True)
    for c in place[2:]:
        set_ = set_ & (F.coalesce(F.col(c), F.lit(0)) != 0)
    here = given.where(set_).join(cells.select(*place, F.col(cell).alias("cell"), F.col("original").alias("_o"), F.col("source").alias("_s")), place)
    at = here.groupBy(key).agg(F.min(F.struct((~both).alias("differs"), "cell")).alias("at"))
    # elsewhere: one cell with both texts, or with the one that the item has
    texts = lambda *names: cells.groupBy("document", *names).agg(F.count(F.lit(1)).alias("n"), F.min(cell).alias("only")).where("n = 1").drop("n")
    rest = given.join(at, key, "left_anti")
    whole = rest.where("original <> '' AND source <> ''").join(texts("original", "source"), ["document", "original", "source"]).select(key, "only")
    first = rest.where("original <> '' AND source = ''").join(texts("original"), ["document", "original"]).select(key, "only")
    second = rest.where("original = '' AND source <> ''").join(texts("source"), ["document", "source"]).select(key, "only")
    empty = rest.where("original = '' AND source = ''").join(texts(), "document").select(key, "only")
    only = whole.unionByName(first).unionByName(second).unionByName(empty)
    tier = F.when(F.col("at").isNotNull(), F.when(F.col("at.differs"), "coordinates").otherwise("coordinates+evidence")).when(F.col("only").isNotNull(), "evidence").otherwise("none")
    return items.select(key).join(at, key, "left").join(only, key, "left").select(key, tier.alias("tier"), F.coalesce("at.cell", "only").alias("cell"))


def apply_actions(decisions: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """``decisions`` with what people did to them; rows without an action stay as they are.

    ``actions``: ``key``, action (a human decision, or SKIP), text and at; the last
    one of a key counts. A confirmation settles on the reading it names, an entered
    text on itself; a blank entered text and SKIP change nothing. ``previous_status``
    keeps the decision that was there.
    """
    last = actions.groupBy(key).agg(F.max_by(F.struct(statuses.status(F.col("action")).alias("action"), "text"), F.struct("at", "action", "text")).alias("a"))
    joined = decisions.join(last, key, "left")
    told = text.squash(statuses.chosen_text(F.col("a.action"), F.col("original_text"), F.col("source_text"), F.col("a.text")))
    done = F.coalesce(statuses.is_human(F.col("a.action")) & (told != ""), F.lit(False))
    new = lambda value, name: F.when(done, value).otherwise(F.col(name))
    return joined.withColumns({
        "previous_status": new(F.coalesce("human_decision", "decision"), "previous_status"), "verified_text": new(told, "verified_text"),
        "human_decision": new(F.col("a.action"), "human_decision"), "decision": new(F.col("a.action"), "decision"),
    }).select(decisions.columns)


def without_repeated_paragraphs(paragraphs: DataFrame, cells: DataFrame, key: str, least: float = SAME_OBJECT) -> DataFrame:
    """Paragraphs that no cell of the same page repeats: the same text in a place that overlaps."""
    held = cells.where("bbox IS NOT NULL").select("document", "page", text.fold(F.col("original_text")).alias("_t"), F.col("bbox").alias("_box")).distinct()
    own = paragraphs.where("bbox IS NOT NULL").withColumn("_t", text.fold(F.col("original_text")))
    repeated = own.join(held, ["document", "page", "_t"]).where(geometry.overlap_of_smaller(F.col("bbox"), F.col("_box")) >= least).select(key).distinct()
    return paragraphs.join(repeated, key, "left_anti")


def neighbours(blocks: DataFrame) -> DataFrame:
    """Each paragraph with the text before and after it on its page."""
    w = Window.partitionBy("document", "page").orderBy("paragraph_block", "decision_id")
    return blocks.select("decision_id", F.lag("original").over(w).alias("before"), F.lead("original").over(w).alias("after"))


def progress(items: DataFrame) -> DataFrame:
    """Counts per document: decided by people, by rules, open and high-risk."""
    human, automatic = F.col("is_human"), statuses.is_automatic(F.col("decision"))
    count = lambda c: F.count(F.when(c, 1))
    risk = F.coalesce(F.col("previous_status").contains("HIGH_RISK"), F.lit(False))
    return items.groupBy("document").agg(
        F.count(F.lit(1)).alias("n"), count(human).alias("n_human"), count(~human & automatic).alias("n_automatic"), count(~human & ~automatic).alias("n_open"), count(risk).alias("n_high_risk")
    )
