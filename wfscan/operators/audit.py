"""Audit rows of an external scorer: lists, judgments, labels, payloads, summaries. The scorer itself is a pluggable function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wfscan.operators.findings import percent

# Judgments and their order, and the labels of domains in their order.
JUDGMENTS = ("confirmed_non_compliant", "no_clear_issue", "insufficient_information", "compliant")
DOMAIN_ORDER = ("Health", "Finance", "Employment", "Education", "Law Enforcement", "Critical Infrastructure", "Other")
PAYLOAD_CHARS = 15_000


def list_of(text: Column) -> Column:
    """A list written as JSON, or with ; , | or / between its members."""
    parsed = F.from_json(text, "array<string>")
    parts = F.filter(F.transform(F.split(text, r"[;,|/]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.when(F.startswith(F.trim(text), F.lit("[")), parsed), parts)


def judgment(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin(*JUDGMENTS), low).when(low == "likely_non_compliant", "confirmed_non_compliant").otherwise("no_clear_issue")


def domain_label(text: Column, labels: tuple[str, ...] = DOMAIN_ORDER) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.coalesce(*[F.when(F.lower(t) == label.lower(), F.lit(label)) for label in labels], t)


def fenced_json(text: Column, schema: str) -> Column:
    """JSON out of a model's answer, with or without a code fence."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    return F.from_json(t, schema)


def payload(name: Column, domains: Column, prompt: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("name: "), F.coalesce(name, F.lit(""))), F.concat(F.lit("domains: "), F.array_join(domains, ", ")), F.substring(F.coalesce(prompt, F.lit("")), 1, PAYLOAD_CHARS))


def record_id(*columns: Column) -> Column:
    """The first id that isn't blank, else a hash of the record."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns], F.concat(F.lit("h"), F.hex(F.xxhash64(*columns))))


def score_with(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a scorer to batches of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield scorer(b)

    return df.mapInPandas(run, schema)


def by_domain(df: DataFrame, domains: Column, status: Column, statuses: tuple[str, ...] = JUDGMENTS) -> DataFrame:
    """(domain, n, a count per status): rows count in each of their domains."""
    x = df.select(F.explode(domains).alias("domain"), status.alias("_s"))
    return x.groupBy("domain").agg(F.count("*").alias("n"), *[F.count_if(F.col("_s") == s).alias(s) for s in statuses])


def fail_rates(counts: DataFrame, failed: str = "confirmed_non_compliant") -> DataFrame:
    return counts.withColumn("fail_rate", percent(F.col(failed), F.col("n")))


def ordered(counts: DataFrame, order: tuple[str, ...] = DOMAIN_ORDER) -> DataFrame:
    """With each domain's place: those of the fixed order first, the rest by name."""
    place = F.coalesce(*[F.when(F.lower("domain") == d.lower(), F.lit(i)) for i, d in enumerate(order)], F.lit(1_000_000))
    return counts.withColumn("place", place).orderBy("place", "domain")


def extraction_summary(df: DataFrame, text: str, key: str) -> DataFrame:
    empty = F.col(text).isNull() | (F.trim(text) == "")
    return df.agg(F.count("*").alias("n"), F.count_if(empty).alias("empty"), F.count_if(~empty).alias("filled"), F.min(F.when(empty, F.col(key))).alias("first_empty"), F.max(F.when(empty, F.col(key))).alias("last_empty"))


def model_texts(params: Column) -> Column:
    """Every value under a prompt-like key at any depth of a JSON text, joined; a recursive walk, so an Arrow function."""
    return _walk(params)


_KEYS = ("text", "prompt", "systemMessage", "messages")


def walk(value, out: list[str]) -> None:
    import json

    if isinstance(value, dict):
        for k, v in value.items():
            if k in _KEYS and v not in (None, "", [], {}):
                out.append(f"[{k}] " + (v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)))
            walk(v, out)
    elif isinstance(value, list):
        for v in value:
            walk(v, out)


def _walk(params: Column) -> Column:
    import json

    from pyspark.sql import types as T

    @F.pandas_udf(T.StringType())
    def f(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                out: list[str] = []
                walk(json.loads(t), out)
                return "\n".join(dict.fromkeys(out))
            except (TypeError, ValueError, RecursionError):
                return None

        return s.map(one)

    return f(params)
