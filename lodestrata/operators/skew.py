"""Lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.session import materialize

#: A key is hot from so many rows on, and from one part in HOT_KEYS of the rows on; so there are at most HOT_KEYS.
HOT_ROWS, HOT_KEYS = 100_000, 1_000


def hot_hashes(df: DataFrame, keys: list[str], rows: int = HOT_ROWS, most: int = HOT_KEYS) -> list[int]:
    """Hashes of the hot keys of ``df``, at most ``most``; rows with a null key don't count.

    One scan with a sketch of frequent items per task: neither rows nor keys are
    shuffled. The sketch never counts too little by more than one part in five of
    the bound, which the bound makes up for.
    """
    hashed = df.where(_all_set(keys)).select(_hash(keys).alias("h"))
    sketch = F.expr(f"approx_top_k(h, {most}, {most * 20})")
    found = hashed.agg(sketch.alias("top"), F.count(F.lit(1)).alias("n")).collect()[0]
    return [x["item"] for x in found["top"] or [] if x["count"] >= 0.8 * max(rows, found["n"] / most)]


def hot_counted(counted: DataFrame, keys: list[str], n: str, total: int, rows: int = HOT_ROWS, most: int = HOT_KEYS) -> list[int]:
    """``hot_hashes`` where the rows of each key are counted already, in ``n``; ``total`` rows in all."""
    return [r[0] for r in counted.where(F.col(n) >= max(rows, total / most)).select(_hash(keys)).distinct().collect()]  # at most ``most``


def skew_lookup(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", rows: int = HOT_ROWS, most: int = HOT_KEYS, heavy: list[int] | None = None
) -> DataFrame:
    """``left.join(right, keys, how)`` for a ``right`` that is unique on ``keys``.

    Rows of hot keys never move: their matches (at most ``most`` rows, so the
    broadcast is bounded) travel to them. All other keys take the shuffled join, and
    without hot keys all rows do. Null keys match nothing and follow ``how`` (kept
    by ``left`` and ``left_anti``). ``heavy``: the hashes of the hot keys, where they
    are known.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    heavy = hot_hashes(left, keys, rows, most) if heavy is None else heavy
    if not heavy:
        return left.join(right, keys, how)
    hot = F.coalesce(_hash(keys).isin(heavy) & _all_set(keys), F.lit(False))
    kept = left.where(hot).join(F.broadcast(right.where(hot)), keys, how)
    return kept.unionByName(left.where(~hot).join(right, keys, how))


def numbered(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row among those of its ``by`` in ``name``, from 1 on; ``order`` is total inside ``by``.

    Places come from one range-partitioned sort: the place inside a partition plus
    the rows of the same ``by`` in the partitions before. So the rows of one key may
    fill many tasks.
    """
    rows = df.withColumn("_by", F.coalesce(F.col(by).cast("string"), F.lit("\x00"))).repartitionByRange("_by", *order).sortWithinPartitions("_by", *order)
    placed = materialize(rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    parts = placed.groupBy("_by", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = placed.join(parts.withColumn("_before", before).drop("_n"), ["_by", "_part"])
    return joined.withColumn(name, (F.col("_before") + F.col("_row") - F.col("_first") + 1).cast("int")).select(*df.columns, name)


def _hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def _all_set(keys: list[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).isNotNull()
    return condition
