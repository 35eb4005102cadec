"""Registry records, caches and snapshots: latest row, first seen, union of sources, differences, fill-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wfscan.functions.text import non_blank
from wfscan.functions.versions import sort_key
from wfscan.session import checkpoint


def latest_per_key(df: DataFrame, key: Column, latest: str, updated: str, position: str) -> DataFrame:
    """One row per key: flagged rows first, then the greatest time as text, then the last one read; blank keys stay apart.

    An aggregate of whole rows under a composite order, so that a key of any size is combined on the map side.
    """
    k = F.when(F.trim(key) != "", F.lower(F.trim(key)))
    own = F.coalesce(k, F.concat(F.lit("\u0000"), F.col(position).cast("string")))
    rank = F.struct(F.coalesce(F.col(latest), F.lit(False)).alias("l"), F.coalesce(F.col(updated), F.lit("")).alias("u"), F.col(position).alias("p"))
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(own.alias("_k")).agg(F.max_by(row, rank).alias("r")).select("r.*")


def first_seen(df: DataFrame, names: list[str], source_order: dict[str, int], source: str, position: str) -> DataFrame:
    """One row per first non-blank of several names: the source that comes first, then the first row; rows without any are dropped."""
    key = non_blank(*[F.col(n) for n in names])
    order = F.coalesce(*[F.when(F.col(source) == s, F.lit(o)) for s, o in source_order.items()], F.lit(len(source_order)))
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.where(key.isNotNull()).groupBy(key.alias("_k")).agg(F.min_by(row, F.struct(order.alias("o"), F.col(position).alias("p"))).alias("r")).select("r.*")


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def highest_version(df: DataFrame, key: str, version: str, tagged: str | None = None) -> DataFrame:
    """(key, version): the tagged latest version, else the greatest by its numbers."""
    best = F.max_by(version, F.struct(sort_key(F.col(version)).alias("k"), F.col(version)))
    return df.groupBy(key).agg((F.coalesce(F.max(tagged), best) if tagged else best).alias(version))


def by_source(df: DataFrame, source: str) -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n"))


def most_starred(df: DataFrame, key: str, stars: str, most: int = 10) -> DataFrame:
    return df.where(F.col(stars).isNotNull()).groupBy(key).agg(F.max(stars).alias(stars)).orderBy(F.desc(stars), key).limit(most)


def named_like(df: DataFrame, columns: list[str], part: str) -> DataFrame:
    c = F.lit(False)
    for n in columns:
        c = c | F.coalesce(F.contains(F.lower(n), F.lit(part.lower())), F.lit(False))
    return df.where(c)


def filled(df: DataFrame, extra: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Blank columns filled from another table with the same names; what is there stays."""
    e = extra.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return df.join(e, key, "left").select(*[F.coalesce(F.when(F.trim(c) != "", F.col(c)), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def with_default(df: DataFrame, extra: DataFrame, key: str, column: str, default) -> DataFrame:
    return df.join(extra.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def fresh(cache: DataFrame, ts: str, now: Column, hours: int = 24) -> DataFrame:
    return cache.where(F.col(ts) > now - F.expr(f"INTERVAL {hours} HOURS"))


def not_done(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't yet done: resume and seen-id skip."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def snapshot_difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): keys that came or went."""
    came = new.select(key).distinct().join(old.select(key).distinct(), key, "left_anti").withColumn("change", F.lit("new"))
    went = old.select(key).distinct().join(new.select(key).distinct(), key, "left_anti").withColumn("change", F.lit("deleted"))
    return came.unionByName(went)


def snapshot_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row: sizes of both snapshots, what came, what went, and the net change."""
    j = old.select(key).distinct().withColumn("_o", F.lit(1)).join(new.select(key).distinct().withColumn("_n", F.lit(1)), key, "full")
    g = j.agg(F.count("_o").alias("previous"), F.count("_n").alias("current"), F.count_if(F.col("_o").isNull()).alias("new"), F.count_if(F.col("_n").isNull()).alias("deleted"))
    return g.withColumn("net_change", F.col("new") - F.col("deleted"))


def view_statistics(df: DataFrame, views: str, created: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.round(F.avg(views), 2).alias("avg_views"), F.count_if(F.col(views) < 10).alias("under_ten"), F.count_if(F.col(views) == 0).alias("none"), F.min(created).alias("first"), F.max(created).alias("last"))


def last_position(df: DataFrame, by: list) -> DataFrame:
    """A 1-based position of each row in a total order, without gathering the rows in one task.

    The rows are range-partitioned and sorted, and cut off by a checkpoint so that partitions keep still; a row's position is its
    place in its partition plus the rows of earlier ones, of which there is one count a partition.
    """
    rows = checkpoint(df.orderBy(*by)).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))  # one row a partition
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    return rows.join(F.broadcast(before), "_p").withColumn("position", F.col("_b") + F.col("_i") + 1).drop("_p", "_i", "_b")
