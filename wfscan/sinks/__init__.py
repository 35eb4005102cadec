"""Writers: JSON, CSV, lists, reports, resumable tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def json_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def csv(df: DataFrame, path: str, sep: str = ",", joined: str = "|") -> None:
    """With a header; lists are joined, maps and structs written as JSON."""
    flat = []
    for c, kind in df.dtypes:
        flat.append(F.array_join(F.col(c).cast("array<string>"), joined).alias(c) if kind.startswith("array") else F.to_json(c).alias(c) if kind.startswith(("map", "struct")) else F.col(c))
    df.select(*flat).write.mode("overwrite").option("escape", '"').csv(path, header=True, sep=sep)


def lines(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.cast("string").alias("value")).write.mode("overwrite").text(path)


def fixed_width(*columns: tuple[str, int]) -> Column:
    return F.concat(*[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), n, " ") for c, n in columns])


def markdown_rows(*columns: str) -> Column:
    """A table row in Markdown; bars in values are escaped."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]), F.lit(" |"))


def resumable(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys aren't in the table at `path`; a lost run is continued by calling it again. Returns how many."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(*keys).distinct()
        df = df.join(done, keys, "left_anti")
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    df = df.cache()
    n = df.count()
    if n:
        df.write.mode("append").parquet(path)
    df.unpersist()
    return n


def replaced(df: DataFrame, path: str, kept: str) -> None:
    """Write a new version of a table and keep the old one under another path."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old, bak = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(kept)
    fs = old.getFileSystem(conf)
    df.write.mode("overwrite").parquet(path + ".new")
    if fs.exists(old):
        fs.delete(bak, True)
        fs.rename(old, bak)
    fs.rename(jvm.org.apache.hadoop.fs.Path(path + ".new"), old)


def _files(df: DataFrame, path: str):
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(conf), target, jvm.org.apache.hadoop.fs.Path


def json_report(df: DataFrame, path: str, header: dict, counters: dict[str, Callable[[Row], bool]], items: str = "packages", order: list[str] | None = None) -> dict[str, int]:
    """One JSON document: the header's members, the rows as a list, and what was counted on the way at its end.

    Rows are streamed through the driver a partition at a time, in the order of the columns named; the file appears under its name once
    it is whole. Returns the counters, with `total` among them.
    """
    fs, target, as_path = _files(df, path)
    partial = as_path(path + ".partial")
    counts = {"total": 0, **dict.fromkeys(counters, 0)}
    out = fs.create(partial, True)

    def put(text: str) -> None:
        out.write(bytearray(text.encode("utf-8")))

    try:
        head = json.dumps(header, ensure_ascii=False)[1:-1]
        put("{" + head + (", " if head else "") + json.dumps(items) + ": [")
        text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("_json")
        rows = df.orderBy(*order) if order else df
        for n, r in enumerate(rows.select("*", text).toLocalIterator()):
            put((",\n" if n else "\n") + r["_json"])
            counts["total"] += 1
            for name, test in counters.items():
                counts[name] += bool(test(r))
        put("\n], " + json.dumps(counts, ensure_ascii=False)[1:-1] + "}\n")
    finally:
        out.close()
    fs.delete(target, True)
    fs.rename(partial, target)
    return counts


def normalised_in_place(df: DataFrame, path: str, change: Callable[[DataFrame], DataFrame], suffix: str = ".bak") -> None:
    """Rewrite the table at `path` as `change` makes it of `df`, and keep the old one beside it under the suffix."""
    replaced(change(df), path, path.rstrip("/") + suffix)


def batches(keys: list, size: int = 25) -> Iterator[list]:
    """Keys in portions: what is done between two savings of a resumable run."""
    for i in range(0, len(keys), size):
        yield keys[i : i + size]
