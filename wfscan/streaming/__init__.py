"""Streams of findings and events: ingest without repeats, windowed counts with late rows, batch tables kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, schema, most: int = 100, form: str = "parquet") -> DataFrame:
    """New files of a folder as they come; a checkpoint remembers which were read."""
    return spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", most).load(path)


def without_repeats(stream: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """Rows whose keys weren't seen within the delay: state is dropped behind the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def daily_counts(stream: DataFrame, ts: str, by: list[str], delay: str = "1 day", window: str = "1 day") -> DataFrame:
    g = stream.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("day"), *by, "n")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write what is there now and stop; called again, it goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def partial_totals(stream: DataFrame, by: list[str], path: str, checkpoint: str):
    """Counts of each micro-batch under its number; a batch that is run again replaces its own rows, so totals stay exact."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*by).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
