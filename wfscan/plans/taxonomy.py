"""Keyword taxonomies, standards, and rates by domain."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from wfscan.operators import taxonomy as tax
from wfscan.plans.registry import query, text, values
from wfscan.session import table

_EDGE = "(^|[^0-9A-Za-z_])"
_RX = [(d, i, k, f"(?i){_EDGE}{re.escape(k).replace(chr(92) + ' ', ' ')}($|[^0-9A-Za-z_])") for d, ks in tax.DOMAINS.items() for i, k in enumerate(ks)]
_SCORES = f"""WITH k AS {values(_RX, "domain, ordinal, keyword, rx")},
    h AS (SELECT rec_id, domain, ordinal, keyword, CASE WHEN regexp_matches(coalesce(name, ''), rx) THEN 1.0 WHEN regexp_matches(coalesce(prompt_text, ''), rx) THEN 0.5 ELSE 0.0 END AS s FROM template_records, k),
    f AS (SELECT *, row_number() OVER (PARTITION BY rec_id, domain ORDER BY ordinal) AS i FROM h WHERE s > 0),
    g AS (SELECT rec_id, domain, CAST(sum(s) AS DOUBLE) AS score, coalesce(string_agg(CASE WHEN s = 1.0 OR i = 1 THEN keyword END, '|' ORDER BY ordinal), '') AS keywords FROM f GROUP BY ALL HAVING sum(s) >= 0.5)"""


def _scores(spark, d):
    return tax.domain_scores(table(spark, d, "template_records"), "rec_id", "name", "prompt_text")


@query(f"{_SCORES} SELECT rec_id, domain, score, keywords FROM g")
def keyword_scores(spark, d):
    return _scores(spark, d)


@query(f"{_SCORES}, t AS (SELECT count(DISTINCT rec_id) AS total FROM template_records) SELECT domain, count(DISTINCT rec_id) AS n, round(100.0 * count(DISTINCT rec_id) / max(total), 2) AS rate FROM g, t GROUP BY domain")
def domain_totals(spark, d):
    return tax.domain_totals(_scores(spark, d), table(spark, d, "template_records"), "rec_id")


_STD = list(tax.STANDARDS)
_WORD = {s: f"(?i){_EDGE}(" + "|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-") for w in ws) + ")($|[^0-9A-Za-z_])" for s, ws in tax.STANDARDS.items()}
_KEY = "trim(template_id)"
_FLAGS = f"SELECT {_KEY} AS template, count(*) AS prompts, " + ", ".join(f"coalesce(bool_or(regexp_matches(prompt_text, {text(_WORD[s])})), false) AS {s}" for s in _STD) + f" FROM template_records GROUP BY {_KEY}"


def _flags(spark, d):
    return tax.compliance(table(spark, d, "template_records").withColumn("template", F.trim("template_id")), "template", "prompt_text")


@query(_FLAGS)
def compliance_flags(spark, d):
    return _flags(spark, d)


@query(f"SELECT count(*) AS templates, {', '.join(f'count(*) FILTER (WHERE {s}) AS {s}' for s in _STD)}, count(*) FILTER (WHERE NOT ({' OR '.join(_STD)})) AS none FROM ({_FLAGS})")
def compliance_totals(spark, d):
    return tax.compliance_totals(_flags(spark, d), _STD)


_EACH = values([(n, w, f"(?i){_EDGE}" + re.escape(w).replace("\\ ", " ").replace("\\-", "-") + "($|[^0-9A-Za-z_])") for n, ws in tax.STANDARDS.items() for w in ws], "standard, word, rx")


@query(f"SELECT template, standard, string_agg(word, '|' ORDER BY word) AS keywords FROM (SELECT DISTINCT {_KEY} AS template, standard, word FROM template_records, {_EACH} w WHERE regexp_matches(prompt_text, rx)) GROUP BY template, standard")
def compliance_keywords(spark, d):
    return tax.compliance_keywords(table(spark, d, "template_records").withColumn("template", F.trim("template_id")), "template", "prompt_text")


@query(
    f"""{_SCORES}, r AS (SELECT rec_id, {', '.join(f"coalesce(regexp_matches(prompt_text, {text(_WORD[s])}), false) AS {s}" for s in _STD)} FROM template_records)
    SELECT coalesce(domain, 'all') AS domain, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE {s}) AS {s}' for s in _STD)}, {', '.join(f'round(100.0 * count(*) FILTER (WHERE {s}) / count(*), 2) AS {s}_rate' for s in _STD)}
    FROM g JOIN r USING (rec_id) GROUP BY ROLLUP (domain)"""
)
def compliance_by_domain(spark, d):
    flags = tax.compliance(table(spark, d, "template_records"), "rec_id", "prompt_text")
    return tax.by_domain(flags, _scores(spark, d), "rec_id", _STD)


@query(
    f"""{_SCORES}, r AS (SELECT rec_id, coalesce(regexp_matches(prompt_text, '(?i)vector store|memory buffer'), false) AS retrieval FROM template_records)
    SELECT coalesce(domain, 'all') AS domain, count(*) AS n, count(*) FILTER (WHERE retrieval) AS retrieval, round(100.0 * count(*) FILTER (WHERE retrieval) / count(*), 2) AS retrieval_rate FROM g JOIN r USING (rec_id) GROUP BY ROLLUP (domain)"""
)
def adoption_by_domain(spark, d):
    r = table(spark, d, "template_records").select("rec_id", F.coalesce(F.col("prompt_text").rlike("(?i)vector store|memory buffer"), F.lit(False)).alias("retrieval"))
    return tax.by_domain(r, _scores(spark, d), "rec_id", ["retrieval"])
