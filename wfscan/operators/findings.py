"""Summaries of findings: counts by any grouping, rates, panels, capped examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wfscan.operators import dims


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits)


def summary(findings: DataFrame, source: str) -> DataFrame:
    """(by, source, rule, category, n): totals by rule, by category, each with and without the source, in one pass."""
    f = findings.select(F.col(source).alias("source"), "rule", "category")
    sets = [["rule"], ["source", "rule"], ["category"], ["source", "category"], []]
    g = f.groupingSets([[F.col(c) for c in s] for s in sets], "source", "rule", "category").agg(
        F.concat_ws("+", F.when(F.grouping("source") == 0, F.lit("source")), F.when(F.grouping("rule") == 0, F.lit("rule")), F.when(F.grouping("category") == 0, F.lit("category"))).alias("by"),
        F.count("*").alias("n"),
    )
    return g.select(F.when(F.col("by") == "", "total").otherwise(F.col("by")).alias("by"), "source", "rule", "category", "n")


def errors_by_package(findings: DataFrame, without: str = "I18N_NON_EN") -> DataFrame:
    """(npm_name, errors, rules, top_rules): errors of each package and how they spread over rules."""
    e = findings.where((F.lower("severity") == "error") & (F.col("rule") != without))
    g = e.groupBy("npm_name", "rule").agg(F.count("*").alias("n"))
    return g.groupBy("npm_name").agg(F.sum("n").alias("errors"), F.count("*").alias("rules"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "rule"))), lambda x: F.concat(x["rule"], F.lit("="), -x["m"])), "|").alias("top_rules"))


def clean_rates(packages: DataFrame, findings: DataFrame) -> DataFrame:
    """(packages, zero_error, strict_zero, rates): packages without errors, and without any finding but notes."""
    e = findings.groupBy("npm_name").agg(F.count_if(F.lower("severity") == "error").alias("errors"), F.count_if(F.lower("severity").isin("error", "warn")).alias("serious"))
    j = packages.select("npm_name").distinct().join(e, "npm_name", "left")
    g = j.agg(F.count("*").alias("packages"), F.count_if(F.coalesce("errors", F.lit(0)) == 0).alias("zero_error"), F.count_if(F.coalesce("serious", F.lit(0)) == 0).alias("strict_zero"))
    return g.withColumns({"zero_error_rate": percent(F.col("zero_error"), F.col("packages")), "strict_rate": percent(F.col("strict_zero"), F.col("packages"))})


def script_classes(findings: DataFrame, text: str = "matched_text") -> DataFrame:
    """(kind, findings, packages): what kinds of characters beyond ASCII the texts hold; Chinese and Japanese before others."""
    t = F.col(text)
    cjk, emoji = t.rlike(r"[぀-ヿ㐀-鿿]"), t.rlike(r"[\x{1F300}-\x{1FAFF}☀-➿]")
    kinds = F.array_compact(F.array(F.when(emoji, F.lit("emoji")), F.when(cjk, F.lit("cjk")).when(t.rlike(r"[^\x00-\x7F]"), F.lit("other_unicode"))))
    return findings.select("npm_name", F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("findings"), F.count_distinct("npm_name").alias("packages"))


def panel_counts(findings: DataFrame, source: str) -> DataFrame:
    return findings.join(F.broadcast(dims.panels(findings.sparkSession)), "rule").groupBy("panel", F.col(source).alias("source")).agg(F.count("*").alias("n"))


def violation_rates(findings: DataFrame, key: str = "rule") -> DataFrame:
    """(key, packages, errors, warnings, infos, and rates): packages with each violation, by severity, as a part of all."""
    s = F.lower("severity")
    total = findings.agg(F.count_distinct("npm_name").alias("total"))  # one row
    g = findings.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.count_distinct("npm_name").alias("packages"), *[F.count_distinct(F.when(s == k, F.col("npm_name"))).alias(n) for k, n in (("error", "errors"), ("warn", "warnings"), ("info", "infos"))]
    )
    return g.join(F.broadcast(total)).select("key", "packages", "errors", "warnings", "infos", percent(F.col("packages"), F.col("total")).alias("rate"), percent(F.col("errors"), F.col("total")).alias("error_rate"))


def package_levels(findings: DataFrame, rules: list[str]) -> DataFrame:
    """(npm_name, a column per rule and severity): the wide counters of each package; the rules are given, so no extra pass."""
    s = F.lower("severity")
    cols = [F.count_if((F.col("rule") == r) & (True if k is None else s == k)).alias(f"{r}_{n}") for r in rules for n, k in (("T", None), ("E", "error"), ("W", "warn"), ("I", "info"))]
    return findings.groupBy("npm_name").agg(*cols)


def capped_examples(findings: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each group; the limit is the feature."""
    return findings.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("position") <= most)


def top_counts(df: DataFrame, key: str, most: int) -> DataFrame:
    """The most frequent keys; equal counts by key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(most)


def network_dependencies(deps: DataFrame) -> DataFrame:
    """(dep_kind, dependencies, suspect, modules)."""
    return deps.groupBy("dep_kind").agg(F.count("*").alias("dependencies"), F.count_if("is_network_suspect").alias("suspect"), F.count_distinct(F.when(F.col("is_network_suspect"), F.col("module"))).alias("modules"))


def folded_status(df: DataFrame, status: Column, known: list[str]) -> DataFrame:
    return df.groupBy(F.when(status.isin(*known), status).otherwise("unknown").alias("status")).agg(F.count("*").alias("n"))


def availability(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row: how many rows there are, and for each flag how many and which part have it."""
    g = df.agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()])
    return g.select("n", *flags, *[percent(F.col(k), F.col("n")).alias(f"{k}_rate") for k in flags])
