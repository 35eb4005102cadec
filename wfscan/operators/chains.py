"""Multi-stage risk chains from counted risk classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which classes of packages (N) and of servers (M) make each stage.
STAGES = {"A1": ((8, 9), (3,)), "A2": ((6, 7), (7,)), "A3": ((1,), (1, 2)), "A4": ((5, 3), (4, 8)), "A5": ((2, 4), (5, 6))}


def star_counts(text: Column, letter: str) -> Column:
    """map<int,int> of a text like 'N1=3; M2=1; N1=2': counts of a letter, equal numbers added."""
    parts = F.regexp_extract_all(text, F.lit(letter + r"(\d+)\s*=\s*\d+"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(letter + r"\d+\s*=\s*(\d+)"), F.lit(1))
    pairs = F.arrays_zip(parts.alias("k"), values.alias("v"))
    keys = F.array_distinct(F.transform(parts, lambda x: x.cast("int")))
    total = lambda k: F.aggregate(F.filter(pairs, lambda p: p["k"].cast("int") == k), F.lit(0), lambda a, p: a + p["v"].cast("int"))
    return F.map_from_arrays(keys, F.transform(keys, total))


def star_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, letter, number, n) in long form."""
    m = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"[NM]\d+\s*=\s*\d+"), F.lit(0))).alias("p")
    p = df.select(key, m)
    return p.select(key, F.substring("p", 1, 1).alias("letter"), F.regexp_extract("p", r"^[NM](\d+)", 1).cast("int").alias("number"), F.regexp_extract("p", r"=\s*(\d+)", 1).cast("int").alias("n")).groupBy(key, "letter", "number").agg(F.sum("n").alias("n"))


def stage_flags(rows: DataFrame, key: str, servers: bool = False) -> DataFrame:
    """(key, A1..A5, stages, combination, two_or_more) from counts in long form; servers adds the stages of the M classes."""
    hit = {}
    for stage, (n, m) in STAGES.items():
        c = (F.col("letter") == "N") & F.col("number").isin(*n)
        if servers:
            c = c | (F.col("letter") == "M") & F.col("number").isin(*m)
        hit[stage] = F.coalesce(F.bool_or(c & (F.col("n") > 0)), F.lit(False))
    g = rows.groupBy(key).agg(*[c.alias(s) for s, c in hit.items()])
    names = F.array_compact(F.array(*[F.when(F.col(s), F.lit(s)) for s in STAGES]))
    return g.withColumns({"stages": F.size(names), "combination": F.array_join(names, "+")}).withColumn("two_or_more", F.col("stages") >= 2)


def stage_totals(flags: DataFrame) -> DataFrame:
    return flags.agg(F.count("*").alias("templates"), *[F.count_if(s).alias(s) for s in STAGES], F.count_if("two_or_more").alias("two_or_more"))


def combinations(flags: DataFrame, most: int = 50) -> DataFrame:
    return flags.where("combination <> ''").groupBy("combination").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "combination").limit(most)


def merged_counts(main: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """The main table's counts with those of the extra one added, for the main table's keys only."""
    known = extra.join(main.select(key).distinct(), key, "left_semi")
    return main.unionByName(known).groupBy(key, "letter", "number").agg(F.sum("n").alias("n"))


def named_totals(df: DataFrame, key: str, name: str, package: str) -> DataFrame:
    """(key, name, packages, has_server): the longest name of each key, the first in order among equals, and its packages."""
    return df.groupBy(key).agg(F.min_by(name, F.struct((-F.length(F.col(name))).alias("l"), F.col(name))).alias("name"), F.count_distinct(package).alias("packages"), F.coalesce(F.bool_or(F.lower(package).contains("mcp")), F.lit(False)).alias("has_server"))


def server_hits(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, letter, number, n): server classes counted in JSON, as an object of counts or as a list of objects with a name and a count."""
    d = df.select(key, F.try_parse_json(F.col(text)).alias("v")).where("v is not null")
    as_map = F.expr("try_variant_get(v, '$', 'map<string,int>')")
    as_list = F.expr("try_variant_get(v, '$', 'array<struct<id:string,rule:string,count:int,n:int>>')")
    pairs = F.coalesce(
        F.transform(as_list, lambda x: F.struct(F.coalesce(x["id"], x["rule"]).alias("k"), F.coalesce(x["count"], x["n"], F.lit(1)).alias("n"))),
        F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("n"))),
    )
    r = d.select(key, F.explode(pairs).alias("p")).where(F.col("p.k").rlike(r"^M\d+$"))
    return r.groupBy(key, F.lit("M").alias("letter"), F.substring("p.k", 2, 9).cast("int").alias("number")).agg(F.sum("p.n").alias("n"))
