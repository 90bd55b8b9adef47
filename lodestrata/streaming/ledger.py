"""The ledger and the index as streams: late rows, corrections and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators import merge
from lodestrata.session import discard, materialize
from lodestrata.sinks.writers import held_rows, replace_table


def windowed_counts(events: DataFrame, at: str, by: list[str], width: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events per window and key; rows later than the watermark allows are left to the batch side."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    counts = events.withWatermark(at, late).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), *by, "n")


def sessions(events: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each key: events no further apart than the gap."""
    counts = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n")


def upsert_stream(decisions: DataFrame, table: str, keys: list[str], order: list[str], checkpoint: str, buckets: int | None = None) -> StreamingQuery:
    """Keep ``table`` at the last row of each key while decisions arrive; a batch that is delivered again changes nothing.

    Without ``buckets`` a batch is merged with the table and replaces it as a whole.
    With them the table is partitioned by a hash of the key (column ``bucket``), and
    only the partitions that the batch touches are read and written again. A table
    that is there but can't be read fails the stream and stays as it is.
    """

    def last(rows: DataFrame) -> DataFrame:
        return merge.latest_wins(rows, [F.col(k) for k in keys], [F.col(o) for o in order])

    def whole(batch: DataFrame, _: int) -> None:
        replace_table(last(held_rows(batch.sparkSession, table, batch).unionByName(batch)), table)

    def by_bucket(batch: DataFrame, _: int) -> None:
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        held = held_rows(batch.sparkSession, table, new).where(F.col("bucket").isin(touched))
        # what is overwritten must not be read meanwhile
        rows = materialize(last(held.unionByName(new)), "upsert")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)
        discard(rows)

    return decisions.writeStream.foreachBatch(by_bucket if buckets else whole).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_updates(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the rows of an aggregation that a batch changed to a table of updates; nothing comes to the driver. A batch that is delivered again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last update of each key of ``latest_updates``."""
    updates = spark.read.parquet(path)
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*keys, "s.*")
