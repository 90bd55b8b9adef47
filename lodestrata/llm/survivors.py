"""One surviving record for each group of duplicates.

``survivors`` chooses field by field by a stated order of preference.
``truths`` judges values instead: a latent model with two-sided quality gives
every source a sensitivity and a specificity, estimated with the truth of the
values by expectation-maximisation, and keeps every value judged true, so a field
may have several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.skew import skew_lookup
from lodestrata.session import discard, materialize


#: Counts added to both sides of a source's rates, which keep them inside (0, 1): hits, misses, false alarms, true denials.
PSEUDO_COUNTS = (8.0, 2.0, 1.0, 9.0)
#: The estimation ends when no probability moves by more than this in a round.
TOLERANCE = 1e-3


def survivors(df: DataFrame, group: list[str], key: str, fields: dict[str, Column], preference: list[Column], values: bool = True) -> DataFrame:
    """For each group and field of ``fields`` (name to a column that is true where the field is blank) the row it survives from.

    Result: ``group``, n (rows), ``<field>_from`` (key) and, with ``values``, the
    value as ``<field>``; without them no text is moved. Lower values of
    ``preference`` win in turn, the smaller key on a tie; rows where the field is
    blank don't count, and a field that is blank everywhere stays null. One
    aggregation with partial minima: no group is ever gathered.
    """
    best = {}
    for name, blank in fields.items():
        held = [F.col(name).alias("v")] if values else []
        best[name] = F.min(F.when(~blank, F.struct(*(p.alias(f"p{i}") for i, p in enumerate(preference)), F.col(key).alias("k"), *held)))
    chosen = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *(b.alias(f"_{n}") for n, b in best.items()))
    return chosen.select(*group, "n", *(F.col(f"_{n}.k").alias(f"{n}_from") for n in fields), *(F.col(f"_{n}.v").alias(n) for n in fields if values))


def truths(claims: DataFrame, group: str, source: str, value: str, prior: float = 0.5, tolerance: float = TOLERANCE) -> DataFrame:
    """Every value of every group with the probability that it is true: ``estimate`` without the sources."""
    return estimate(claims, group, source, value, prior, tolerance)[0]


def estimate(claims: DataFrame, group: str, source: str, value: str, prior: float = 0.5, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """The values of every group with the probability that they are true, and the quality of every source.

    ``claims`` has one row per claim; repeated ones count once, null values and
    sources are left out. A source that claims something about a group is taken to
    deny the group's other values. First result: ``group``, ``value``, n_sources,
    probability, is_true (probability of one half or more); second: ``source``,
    sensitivity, specificity. M and E steps alternate until no probability moves by
    more than ``tolerance``. All sums are partial, the denials of a group enter as
    one sum per group and never as pairs of source and value. An empty table gives
    two empty results.
    """
    said = claims.select(F.col(group).alias("g"), F.col(source).alias("s"), F.col(value).alias("v"))
    said = materialize(said.where("g IS NOT NULL AND s IS NOT NULL AND v IS NOT NULL").distinct(), "claims")
    present = materialize(said.select("g", "s").distinct(), "present")
    facts = said.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n_sources"))
    # first belief: the share of the group's sources that claim the value
    sources = present.groupBy("g").agg(F.count(F.lit(1)).alias("n_present"))
    first = facts.join(sources, "g").select("g", "v", "n_sources", ((F.col("n_sources") + prior) / (F.col("n_present") + 1)).alias("p"))
    belief = materialize(first, "belief")
    while True:
        quality = materialize(_quality(said, present, belief), "quality")
        after = materialize(_belief(said, present, belief, quality, prior), "belief")
        moved = after.agg(F.max(F.abs(F.col("p") - F.col("before")))).head()[0]
        discard(belief)
        belief = after
        if moved is None or moved <= tolerance:
            break
        discard(quality)
    out = belief.select(F.col("g").alias(group), F.col("v").alias(value), "n_sources", F.round("p", 6).alias("probability"))
    return out.withColumn("is_true", F.col("probability") >= 0.5), quality.withColumnRenamed("s", source)


def _quality(said: DataFrame, present: DataFrame, belief: DataFrame) -> DataFrame:
    """M step: how much of what is true a source claims, and how much of what is false it denies."""
    hits, misses, alarms, denials = PSEUDO_COUNTS
    totals = belief.groupBy("g").agg(F.sum("p").alias("true_mass"), F.count(F.lit(1)).alias("n_facts"))
    claimed = said.join(belief, ["g", "v"]).groupBy("s").agg(F.sum("p").alias("hit"), F.sum(1 - F.col("p")).alias("false_alarm"))
    exposed = present.join(totals, "g").groupBy("s").agg(F.sum("true_mass").alias("true_mass"), F.sum(F.col("n_facts") - F.col("true_mass")).alias("false_mass"))
    return claimed.join(exposed, "s").select(
        "s",
        ((F.col("hit") + hits) / (F.col("true_mass") + hits + misses)).alias("sensitivity"),
        (1 - (F.col("false_alarm") + alarms) / (F.col("false_mass") + alarms + denials)).alias("specificity"),
    )


def _belief(said: DataFrame, present: DataFrame, belief: DataFrame, quality: DataFrame, prior: float) -> DataFrame:
    """E step: the odds of each value from the sources that claim it and those that deny it; ``before`` is the last belief."""
    weights = quality.select(
        "s", F.log(F.col("sensitivity") / (1 - F.col("specificity"))).alias("claim"), F.log((1 - F.col("sensitivity")) / F.col("specificity")).alias("denial")
    )
    denied = skew_lookup(present, weights, ["s"], "inner").groupBy("g").agg(F.sum("denial").alias("denied"))
    support = skew_lookup(said, weights, ["s"], "inner").groupBy("g", "v").agg(F.sum(F.col("claim") - F.col("denial")).alias("support"))
    odds = F.col("support") + F.col("denied") + F.log(F.lit(prior / (1 - prior)))
    joined = support.join(denied, "g").join(belief.select("g", "v", "n_sources", F.col("p").alias("before")), ["g", "v"])
    return joined.select("g", "v", "n_sources", "before", (1 / (1 + F.exp(-odds))).alias("p"))
