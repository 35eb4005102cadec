"""Streams over the tables' files, run once over what is there; their results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from wfscan import streaming
from wfscan.plans.registry import query
from wfscan.session import shared_folder, table


def _events(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    """Windowed counts per micro-batch, added up: the stream's partial totals give the batch's result."""
    base = shared_folder(spark, "stream")
    s = _events(spark, d).select(F.date_trunc("DAY", "ts").alias("day"), "event_type")
    streaming.partial_totals(s, ["day", "event_type"], f"{base}/totals", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/totals").groupBy("day", "event_type").agg(F.sum("n").alias("n"))


@query("SELECT DISTINCT event_id, event_type FROM events")
def stream_ingest_dedup(spark, d):
    base = shared_folder(spark, "stream")
    s = streaming.without_repeats(_events(spark, d), ["event_id"], "ts", "30 days").select("event_id", "event_type")
    streaming.to_table(s, f"{base}/events", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("event_id bigint, event_type string").parquet(f"{base}/events")
