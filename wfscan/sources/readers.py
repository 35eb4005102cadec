"""Readers: delimited files, lists, JSON in several shapes, source trees, archives, paged services."""

from __future__ import annotations

import io
import json
import random
import tarfile
import time
import zipfile
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Answers of a service that are worth asking again.
RETRIED = {429, 500, 502, 503, 504}


def csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """A delimited file with a header: the named columns must be there; values are trimmed, blanks and 'nan' null, a byte-order mark ignored."""
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    clean = lambda c: F.when(~F.lower(F.trim(F.col(f"`{c}`"))).isin("", "nan"), F.trim(F.col(f"`{c}`")))
    return df.select(*[clean(c).alias(c) for c in columns])


def ids(spark: SparkSession, path: str, column: str) -> DataFrame:
    return csv(spark, path, [column]).where(f"`{column}` is not null").distinct()


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(name): the lines of a list that are neither blank nor comments; equal ones in any case count once."""
    t = spark.read.text(path).select(F.trim("value").alias("name")).where("name <> '' and not startswith(name, '#')")
    return t.groupBy(F.lower("name").alias("_k")).agg(F.min("name").alias("name")).select("name")


def listed_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(id): numbers after the word ID, or alone on a line."""
    v = F.trim("value")
    number = F.coalesce(F.nullif(F.regexp_extract(v, r"ID\s+(\d+)", 1), F.lit("")), F.when(v.rlike(r"^\d+$"), v))
    return spark.read.text(path).select(number.alias("id")).where("id is not null").distinct()


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank and broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_documents(spark: SparkSession, path: str, glob: str = "*.json*") -> DataFrame:
    """(source_file, doc VARIANT): whole files that are an object, a list, or records by line; a list's members are rows of their own."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("source_file"), F.regexp_replace("value", "^\\x{FEFF}", "").alias("t"))
    # a first line that is a document by itself, with more lines after it, makes a file of records by line
    head = F.try_parse_json(F.regexp_extract("t", r"^\s*([^\n]*)", 1)).isNotNull() & F.col("t").rlike(r"^\s*[^\n]+\n\s*\S")
    whole = raw.withColumn("v", F.when(~head, F.try_parse_json("t")))
    by_line = whole.where("v is null").select("source_file", F.explode(F.split("t", "\n")).alias("l")).select("source_file", F.try_parse_json("l").alias("v")).where("v is not null")
    docs = whole.where("v is not null").select("source_file", "v").unionByName(by_line)
    members = F.expr("try_variant_get(v, '$', 'array<variant>')")
    wrapped = F.coalesce(*[F.expr(f"try_variant_get(v, '$.{k}', 'array<variant>')") for k in ("items", "data", "templates", "records")])
    return docs.withColumn("_a", F.coalesce(members, wrapped)).select("source_file", F.explode(F.coalesce("_a", F.array("v"))).alias("doc"))


def unreadable(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(source_file): files that hold no readable document."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return raw.where(F.try_parse_json("value").isNull()).select(F.col("_metadata.file_path").alias("source_file"))


def report_packages(spark: SparkSession, path: str, package_schema: str) -> DataFrame:
    """The packages of a large report document, one row each."""
    return spark.read.schema(f"packages array<{package_schema}>").option("multiLine", True).json(path).select(F.explode("packages").alias("p")).select("p.*")


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a .jsonl, .json or .csv file, by its ending."""
    if path.endswith(".jsonl"):
        return json_lines(spark, path, schema)
    if path.endswith(".csv"):
        return spark.read.schema(schema).csv(path, header=True)
    d = json_documents(spark, path)
    return d.select(F.from_json(F.to_json("doc"), schema).alias("r")).select("r.*")


def source_files(spark: SparkSession, root: str, keep: Column | None = None) -> DataFrame:
    """(path, code): whole files below a root; `keep` is a predicate on the column path."""
    t = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    t = t.select(F.regexp_replace("_metadata.file_path", "^file:(//)?", "").alias("path"), F.col("value").alias("code"))
    return t.where(keep) if keep is not None else t


def archive_members(content: bytes) -> list[tuple[str, bytes]]:
    """(path, bytes) of a tar or zip archive's files of any size, without a single top directory; paths that leave it are left out."""
    found: list[tuple[str, bytes]] = []
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            found = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
    else:
        try:
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                found = [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
        except tarfile.TarError:
            return []
    safe = [(n.replace("\\", "/"), b) for n, b in found]
    safe = [(n.removeprefix("./"), b) for n, b in safe if not n.startswith("/") and ".." not in n.split("/")]
    tops = {n.split("/", 1)[0] for n, _ in safe}
    if len(tops) == 1 and all("/" in n for n, _ in safe):
        safe = [(n.split("/", 1)[1], b) for n, b in safe]
    return safe


def archives(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(archive, path, code): text files out of archives, expanded on the executors."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches):
        for b in batches:
            rows = [(p, n, data.decode("utf-8", "replace")) for p, c in zip(b["path"], b["content"], strict=True) for n, data in archive_members(c)]
            yield pd.DataFrame(rows, columns=["archive", "path", "code"])

    return raw.mapInPandas(run, "archive string, path string, code string")


@dataclass(frozen=True)
class Answer:
    """What a service said: the status, the body that was read, and its headers."""

    status: int
    body: object = None
    headers: Mapping[str, str] = field(default_factory=dict)


def asked(ask: Callable[[], Answer], tries: int = 5, base: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> Answer:
    """Ask until the answer isn't one to be asked again: after the time the service names, else after twice as long each time, with jitter."""
    for n in range(tries):
        answer = ask()
        if answer.status not in RETRIED or n == tries - 1:
            break
        named = answer.headers.get("Retry-After", "")
        sleep(min(most, float(named)) if named.replace(".", "", 1).isdigit() else min(most, base * 2**n) * (0.5 + jitter() / 2))
    if answer.status >= 400:
        raise OSError(f"status {answer.status} after {n + 1} tries")
    return answer


def list_in(body) -> list:
    """The records of a page: the page itself, or the first list under one of the usual names."""
    return body if isinstance(body, list) else next((body[k] for k in ("objects", "servers", "workflows", "items", "topics", "posts", "data") if isinstance(body.get(k), list)), []) if isinstance(body, dict) else []


@dataclass(frozen=True)
class Paging:
    """How a service is read on: `first` is the key of the first page; `next_key` gives the key of the next, or null at the end."""

    first: object
    next_key: Callable[[object, object, list], object | None]  # of the key, the body and the records of the page
    most_pages: int = 100_000


def by_offset(size: int = 250) -> Paging:
    """Offsets until the total that the service names, or a page that isn't full."""
    return Paging(0, lambda key, body, got: key + len(got) if got and (key + len(got) < body["total"] if isinstance(body, dict) and "total" in body else len(got) >= size) else None)


def by_page(first: int = 1) -> Paging:
    """Page numbers until a page is empty."""
    return Paging(first, lambda key, body, got: key + 1 if got else None)


def by_cursor(*path: str, most_pages: int = 1000) -> Paging:
    """Cursors that each page holds under a path; an empty one, or one seen before, ends it."""

    def next_key(key, body, got):
        for p in path:
            body = body.get(p) if isinstance(body, dict) else None
        return body if body and body != key else None

    return Paging(None, next_key, most_pages)


def pages(ask: Callable[[object], Answer], paging: Paging, limit: int = 0, **retry) -> Iterator[tuple[object, list]]:
    """(key, records) of each page in turn; `limit` records at most, if it isn't zero."""
    key, left = paging.first, limit
    for _ in range(paging.most_pages):
        body = asked(lambda key=key: ask(key), **retry).body
        got = list_in(body)
        following = paging.next_key(key, body, got)
        if limit:
            got = got[:left]
            left -= len(got)
        if got:
            yield key, got
        if following is None or limit and left <= 0:
            return
        key = following


def recorded(root: str) -> Callable[[object], Answer]:
    """Pages that were recorded under a folder: `KEY.json`, the first `first.json` if it has no key."""

    def ask(key) -> Answer:
        p = Path(root) / f"{'first' if key is None else key}.json"
        return Answer(200, json.loads(p.read_text(encoding="utf-8"))) if p.exists() else Answer(200, [])

    return ask


def service(spark: SparkSession, queries: list[str], ask_for: Callable[[str], Callable[[object], Answer]], paging: Paging, limit: int = 0) -> DataFrame:
    """(query, page, record): the pages of several queries, each read by one task; what one query has is read page by page in its task."""

    def run(batches):
        for b in batches:
            for q in b["q"]:
                for n, (_, got) in enumerate(pages(ask_for(q), paging, limit)):
                    yield pd.DataFrame({"query": q, "page": n, "record": [json.dumps(r, ensure_ascii=False) for r in got]})

    asked_for = spark.createDataFrame([(q,) for q in queries], "q string").repartition(max(1, len(queries)), "q")
    return asked_for.mapInPandas(run, "query string, page int, record string")


class PagedReader(DataSourceReader):
    """Pages of a recorded service, one partition each: files page-00000.json, page-00001.json, ... with a list of records."""

    def __init__(self, options):
        self.root, self.pages, self.column = options["path"], int(options["pages"]), options.get("column", "record")

    def partitions(self):
        return [InputPartition(i) for i in range(self.pages)]

    def read(self, partition):
        p = Path(self.root) / f"page-{partition.value:05d}.json"
        if p.exists():
            body = json.loads(p.read_text(encoding="utf-8"))
            for r in list_in(body):
                yield (partition.value, json.dumps(r, ensure_ascii=False))


class PagedSource(DataSource):
    """format("paged").option("path", folder).option("pages", n): (page, record). A live service needs only another reader."""

    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return "page int, record string"

    def reader(self, schema):
        return PagedReader(self.options)


def paged(spark: SparkSession, path: str, pages: int) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").option("path", path).option("pages", pages).load()
