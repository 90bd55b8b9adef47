"""Streaming, sessions and general relational work over the events and order tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.operators import diff, geometry, merge
from lodestrata.functions import text
from lodestrata.session import scratch_root
from lodestrata.sources.tables import table
from lodestrata.streaming import ledger


def st1_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts of events per type, as a stream that ends with the files there are."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    counts = ledger.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], late="60 days")
    counts = counts.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    path = f"{scratch_root(spark)}/windows-{uuid.uuid4().hex}"
    ledger.latest_updates(counts, path, f"{path}-checkpoint").awaitTermination()
    return ledger.read_updates(spark, path, ["window_start", "event_type"])


def st2_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of users: events at most half an hour apart."""
    return ledger.sessions(table(spark, folder, "events"), "ts", "user_id")


def w7_event_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of each user and type."""
    events = table(spark, folder, "events")
    return merge.latest_wins(events, [F.col("user_id"), F.col("event_type")], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


def g8_event_groups(spark: SparkSession, folder: str) -> DataFrame:
    """W11 in one dimension: groups of a user's events with gaps of two hours or less."""
    events = table(spark, folder, "events").withColumn("place", F.struct("ts", "event_id"))
    seconds = F.col("ts").cast("timestamp").cast("double")
    gap = seconds - F.lag(seconds).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    grouped = geometry.row_groups(events.withColumn("start", F.coalesce(gap > 7200, F.lit(False))), ["user_id"], "place", F.col("start"))
    return grouped.groupBy("user_id", "group_number").agg(F.count(F.lit(1)).alias("n"))


def j5_order_diff(spark: SparkSession, folder: str) -> DataFrame:
    """J5, AGG13: two snapshots of the orders, one without some and with other prices, by status."""
    orders = table(spark, folder, "orders")
    right = orders.where("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))

    def side(df: DataFrame) -> DataFrame:
        long = df.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string").alias("price"), F.col("o_orderpriority").alias("priority"))
        cells = long.unpivot(["o_orderkey"], ["status", "price", "priority"], "header", "value").withColumns({"column_index": F.lit(1), "verification_status": F.lit(None).cast("string")})
        return diff.flatten_side(cells, F.col("o_orderkey").cast("string"), F.col("o_orderkey"))

    cells = diff.diff_cells(side(orders), side(right))
    return cells.groupBy("header", "status", "value_relation").agg(F.count(F.lit(1)).alias("n"))


def h6_part_profile(spark: SparkSession, folder: str) -> DataFrame:
    """H6, H7 on the columns of part, unpivoted."""
    from lodestrata.operators.profile import column_profiles

    names = ["p_name", "p_brand", "p_type", "p_size"]
    cells = table(spark, folder, "part").select(*(F.col(n).cast("string").alias(n) for n in names)).unpivot([], names, "column_name", "value")
    found = column_profiles(cells, ["column_name"], "value")
    return found.select("column_name", "values", "distinct_values", F.round("identifier_score", 3).alias("identifier_score"), "primary_role")


def snk8_text_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """documents by the hash of their text, with the number that share it."""
    texts = table(spark, folder, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return texts.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def agg11_source_totals(spark: SparkSession, folder: str) -> DataFrame:
    """AGG11 with labels as evidence: documents per source and over all, and those without a label."""
    labels = table(spark, folder, "level_labels").select("doc_id").distinct().withColumn("labelled", F.lit(1))
    joined = table(spark, folder, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return joined.rollup("source").agg(F.grouping("source").alias("is_total"), F.count(F.lit(1)).alias("n"), F.count("labelled").alias("n_labelled"))


def f3_header_labels(spark: SparkSession, folder: str) -> DataFrame:
    """headers by their label."""
    heads = table(spark, folder, "entity_links").where("header IS NOT NULL").groupBy(text.label(F.col("header")).alias("label"))
    return heads.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("header").alias("n_spellings"))


QUERIES = {name: f for name, f in globals().copy().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}

from lodestrata.plans import sqltext as q  # noqa: E402

SQL = {
    "st1_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "st2_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n_session FROM e)
      SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM g GROUP BY user_id, n_session""",
    "w7_event_upsert": "SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC",
    "g8_event_groups": """WITH e AS (SELECT *, epoch(ts) - lag(epoch(ts)) OVER w > 7200 AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      g AS (SELECT user_id, sum(CASE WHEN start THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS group_number FROM e)
      SELECT user_id, group_number, count(*) AS n FROM g GROUP BY ALL""",
    "j5_order_diff": """WITH l AS (SELECT o_orderkey AS k, unnest(['status', 'price', 'priority']) AS header, unnest([o_orderstatus, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), o_orderpriority]) AS v FROM orders),
      r AS (SELECT o_orderkey AS k, unnest(['status', 'price', 'priority']) AS header, unnest([o_orderstatus, CAST(CAST(round((o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) * 100) AS BIGINT) AS VARCHAR), o_orderpriority]) AS v
        FROM orders WHERE o_orderkey % 7 <> 0)
      SELECT l.header AS header, CASE WHEN r.k IS NULL THEN 'REMOVED' WHEN l.v = r.v THEN 'UNCHANGED' ELSE 'CHANGED' END AS status,
        CASE WHEN r.k IS NULL THEN 'LEFT_ONLY' WHEN l.v = r.v THEN 'MATCH' ELSE 'DIFFERENT' END AS value_relation, count(*) AS n
      FROM l LEFT JOIN r ON l.k = r.k AND l.header = r.header GROUP BY 1, 2, 3""",
    "snk8_text_hashes": "SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "agg11_source_totals": """SELECT source, CAST(grouping(source) AS TINYINT) AS is_total, count(*) AS n, count(l.doc_id) AS n_labelled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM level_labels) l USING (doc_id) GROUP BY ROLLUP (source)""",
    "f3_header_labels": f"SELECT {q.label('header')} AS label, count(*) AS n, count(DISTINCT header) AS n_spellings FROM entity_links WHERE header IS NOT NULL GROUP BY 1",
}
