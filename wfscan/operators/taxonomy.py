"""Keyword taxonomies: which domains a text belongs to, which standards its prompts meet, and rates by domain.

A taxonomy is a table of (domain, keyword, ordinal); the shipped ones are small examples and parameters like any other.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wfscan.operators.findings import percent

# Keywords by domain; a parameter, to be replaced by a full taxonomy.
DOMAINS = {
    "health": ["patient", "medical", "diagnosis", "clinic", "prescription"],
    "finance": ["credit score", "loan", "bank account", "invoice", "price"],
    "employment": ["recruitment", "resume", "candidate", "employee"],
    "access": ["credential", "permission", "token", "registry", "account"],
    "data": ["export", "import", "database", "schema", "queue"],
}
# What shows that a prompt meets a standard.
STANDARDS = {
    "risk_limitation_disclaimers": "risk|limitation|disclaimer|warning|not responsible|no warranty|use at your own risk|limitations|risks|may not be accurate|errors may occur|no guarantee|as-is|without warranty|not liable|disclaim|limitation of liability|no assurance".split("|"),
    "bias_discrimination_statements": "bias|discrimination|discriminatory|unfair|may contain bias|potential bias|bias detection|bias mitigation|avoid discrimination|fair|equitable|unbiased|prejudice|stereotyp|may discriminate|discrimination risk".split("|"),
    "output_interpretability": "interpret|interpretability|explain|explanation|understand|transparent|transparency|clarity|may not be clear|output may vary|results may differ|uncertain|confidence|reliability|accuracy|may be incorrect|verify|validate|check".split("|"),
    "over_reliance_warnings": "over-reliance|overreliance|do not rely solely|not a substitute|should not replace|supplementary|human oversight|human review|verify with|consult professional|not professional advice|not medical advice|not legal advice|not financial advice|not a replacement|use with caution|supplement|additional verification|human judgment|expert review".split("|"),
}
MAX_KEYWORDS = 10_000


def keywords(spark: SparkSession, taxonomy: dict[str, list[str]] = DOMAINS) -> DataFrame:
    return spark.createDataFrame([(d, k, i) for d, ks in taxonomy.items() for i, k in enumerate(ks)], "domain string, keyword string, ordinal int")


def word_match(text: Column, keyword: str) -> Column:
    """The keyword as a whole word or phrase, in any case; only ASCII letters, digits and _ count as parts of words."""
    return F.contains(F.lower(text), F.lit(keyword.lower())) & text.rlike(r"(?i)(?<![0-9A-Za-z_])" + re.escape(keyword).replace(r"\ ", " ").replace(r"\-", "-") + r"(?![0-9A-Za-z_])")


def domain_scores(texts: DataFrame, key: str, title: str, description: str, taxonomy: dict[str, list[str]] = DOMAINS, least: float = 0.5) -> DataFrame:
    """(key, domain, score, keywords): 1.0 for each keyword in the title, else 0.5 for each in the description.

    Of the description's keywords only one that opens its domain is named, as every title keyword is. Map-only: a fixed list of tests.
    """
    if sum(map(len, taxonomy.values())) > MAX_KEYWORDS:
        raise ValueError(f"more than {MAX_KEYWORDS} keywords; give the taxonomy in parts")
    rows = []
    for d, words in taxonomy.items():
        hits = F.array(*[F.struct(F.when(word_match(F.col(title), w), 1.0).when(word_match(F.col(description), w), 0.5).otherwise(0.0).alias("s"), F.lit(w).alias("w")) for w in words])
        found = F.filter(hits, lambda h: h["s"] > 0)
        named = F.filter(F.transform(found, lambda h, i: F.when((h["s"] == 1.0) | (i == 0), h["w"])), lambda w: w.isNotNull())
        rows.append(F.struct(F.lit(d).alias("domain"), F.aggregate(found, F.lit(0.0), lambda a, h: a + h["s"]).alias("score"), F.array_join(named, "|").alias("keywords")))
    return texts.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.domain", "x.score", "x.keywords").where(F.col("score") >= least)


def domain_totals(scores: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(domain, n, rate): texts of each domain and their part of all."""
    total = texts.agg(F.count_distinct(key).alias("total"))  # one row
    g = scores.groupBy("domain").agg(F.count_distinct(key).alias("n"))
    return g.join(F.broadcast(total)).select("domain", "n", percent(F.col("n"), F.col("total")).alias("rate"))


def compliance(prompts: DataFrame, key: str, content: str, standards: dict[str, list[str]] = STANDARDS) -> DataFrame:
    """(key, prompts, a flag per standard): a standard is met if any prompt of the key holds one of its words."""
    met = {s: F.coalesce(F.bool_or(_any_word(F.col(content), words)), F.lit(False)) for s, words in standards.items()}
    return prompts.groupBy(key).agg(F.count("*").alias("prompts"), *[c.alias(s) for s, c in met.items()])


def _any_word(text: Column, words: list[str]) -> Column:
    body = "|".join(re.escape(w).replace(r"\ ", " ").replace(r"\-", "-") for w in words)
    return text.rlike(r"(?i)(?<![0-9A-Za-z_])(?:" + body + r")(?![0-9A-Za-z_])")


def compliance_keywords(prompts: DataFrame, key: str, content: str, standards: dict[str, list[str]] = STANDARDS) -> DataFrame:
    """(key, standard, keywords): the distinct words by which each standard is met, in order."""
    found = F.flatten(F.array(*[F.array_compact(F.array(*[F.when(word_match(F.col(content), w), F.struct(F.lit(s).alias("standard"), F.lit(w).alias("word"))) for w in words])) for s, words in standards.items()]))
    return prompts.select(key, F.explode(found).alias("x")).groupBy(key, "x.standard").agg(F.array_join(F.array_sort(F.collect_set("x.word")), "|").alias("keywords"))


def compliance_totals(rows: DataFrame, standards: list[str]) -> DataFrame:
    none = ~F.coalesce(*[F.col(s) for s in standards[:1]])
    for s in standards[1:]:
        none = none & ~F.col(s)
    return rows.agg(F.count("*").alias("templates"), *[F.count_if(s).alias(s) for s in standards], F.count_if(none).alias("none"))


def by_domain(flags: DataFrame, domains: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(domain, n, counts, rates): flags by domain with an overall row; a key of several domains counts in each, and so in the total."""
    j = domains.select(key, "domain").join(flags, key)
    g = j.rollup("domain").agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in columns])
    return g.select(F.coalesce("domain", F.lit("all")).alias("domain"), "n", *columns, *[percent(F.col(c), F.col("n")).alias(f"{c}_rate") for c in columns])
