"""Records that agree but for the way they are written.

Columns are dictionary-encoded: each distinct raw value is canonicalised once,
each distinct canonical value gets an integer, and a record becomes the sorted
tuple of its integers (one integer belongs to one field and value, so field order
plays no part). Texts are shuffled once, as distinct values; from there on only
digests and integers move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.skew import skew_lookup
from lodestrata.session import materialize

#: White space, and punctuation that is not directly between two digits.
_DROPPED = r"(?U)\s+|(?<!\p{Nd})\p{P}|\p{P}(?!\p{Nd})"


def folded(text: Column) -> Column:
    """Text without letter case, white space and punctuation; a mark between two digits stays. Null reads as empty."""
    lower = F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ς", "σ")
    return F.coalesce(F.regexp_replace(lower, _DROPPED, ""), F.lit(""))


def page_number(page: Column) -> Column:
    """A page as number in text (``0038``, `` 38``, ``38.0`` are ``38.0``); what is no number stays as trimmed text."""
    trimmed = F.trim(page.cast("string"))
    return F.coalesce(trimmed.try_cast("double").cast("string"), trimmed, F.lit(""))


def encode(df: DataFrame, key: str, fields: dict[str, Column], canonical: dict[str, Column]) -> DataFrame:
    """(key, codes): each record as the sorted tuple of the integers of its canonical field values.

    ``fields`` gives the raw values as text, ``canonical`` the rule for each field
    as a column over ``raw``. Null and empty values are values like any other. Rows
    with one key make one record.
    """
    names = list(fields)
    rows = df.select(
        F.col(key).alias("_key"),
        F.explode(F.array(*(F.struct(F.lit(i).cast("tinyint").alias("field"), F.coalesce(fields[n], F.lit("")).alias("raw")) for i, n in enumerate(names)))).alias("_v"),
    ).select("_key", "_v.*")
    rule = F.coalesce(*(F.when(F.col("field") == i, canonical[n]) for i, n in enumerate(names)))
    # texts: one shuffle of raw values, made distinct on the map side first
    values = rows.select("field", "raw").distinct()
    values = materialize(values.select("field", F.unhex(F.md5("raw")).alias("raw_digest"), F.unhex(F.md5(rule.cast("binary"))).alias("digest")), "values")
    codes = materialize(values.select("field", "digest").distinct().withColumn("code", F.monotonically_increasing_id()), "codes")
    dictionary = values.join(codes, ["field", "digest"]).select("field", "raw_digest", "code")
    coded = skew_lookup(rows.select("_key", "field", F.unhex(F.md5("raw")).alias("raw_digest")), dictionary, ["field", "raw_digest"], "inner")
    return coded.groupBy(F.col("_key").alias(key)).agg(F.sort_array(F.collect_set("code")).alias("codes"))


def duplicate_groups(df: DataFrame, key: str, fields: dict[str, Column], canonical: dict[str, Column]) -> DataFrame:
    """(key, keep, copies): the smallest key of each record's group and the number of records in it.

    Groups of any size are counted by partial sums and looked up without bringing
    a large group together. Rows that share a key are one record with the values of
    all of them. An empty table gives an empty result.
    """
    coded = materialize(encode(df, key, fields, canonical), "tuples")
    groups = coded.groupBy("codes").agg(F.min(key).alias("keep"), F.count(F.lit(1)).alias("copies"))
    many = groups.where(F.col("copies") > 1)
    return skew_lookup(coded, many, ["codes"], "left").select(
        key, F.coalesce("keep", F.col(key)).alias("keep"), F.coalesce("copies", F.lit(1)).alias("copies")
    )
