"""Audit rows: domain lists, judgments, counts by domain, order. The judgments come from the prompts' own texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wfscan.operators import audit
from wfscan.plans.registry import query
from wfscan.session import table

_LIST = """CASE WHEN starts_with(trim(domains), '[') AND try_cast(domains AS JSON) IS NOT NULL THEN from_json(domains, '["VARCHAR"]') ELSE list_filter(list_transform(string_split_regex(domains, '[;,|/]'), lambda x: trim(x)), lambda x: x <> '') END"""
_RAW = "CASE WHEN regexp_matches(prompt_text, '(?i)never reveal') THEN 'compliant' WHEN regexp_matches(prompt_text, '(?i)careful reviewer') THEN 'likely_non_compliant' WHEN prompt_text IS NULL OR trim(prompt_text) = '' THEN ' Insufficient_Information ' ELSE 'else' END"
_JUDGED = f"WITH r AS (SELECT rec_id, {_LIST} AS ds, lower(trim({_RAW})) AS s FROM template_records), j AS (SELECT rec_id, ds, CASE WHEN s IN ('confirmed_non_compliant', 'no_clear_issue', 'insufficient_information', 'compliant') THEN s WHEN s = 'likely_non_compliant' THEN 'confirmed_non_compliant' ELSE 'no_clear_issue' END AS status FROM r)"
_COUNTS = f"{_JUDGED}, x AS (SELECT unnest(ds) AS domain, status FROM j), c AS (SELECT domain, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE status = {chr(39)}{s}{chr(39)}) AS {s}' for s in audit.JUDGMENTS)} FROM x GROUP BY domain)"


def _judged(spark, d):
    raw = F.when(F.col("prompt_text").rlike("(?i)never reveal"), "compliant").when(F.col("prompt_text").rlike("(?i)careful reviewer"), "likely_non_compliant").when(F.col("prompt_text").isNull() | (F.trim("prompt_text") == ""), " Insufficient_Information ").otherwise("else")
    return table(spark, d, "template_records").select("rec_id", audit.list_of(F.col("domains")).alias("ds"), audit.judgment(raw).alias("status"))


@query(f"SELECT rec_id, array_to_string({_LIST}, '+') AS domains FROM template_records")
def domain_lists(spark, d):
    return table(spark, d, "template_records").select("rec_id", F.array_join(audit.list_of(F.col("domains")), "+").alias("domains"))


@query(f"{_JUDGED} SELECT rec_id, status FROM j")
def judgments(spark, d):
    return _judged(spark, d).select("rec_id", "status")


@query(f"{_COUNTS} SELECT * FROM c")
def audit_by_domain(spark, d):
    return audit.by_domain(_judged(spark, d), F.col("ds"), F.col("status"))


@query(f"{_COUNTS} SELECT domain, round(100.0 * confirmed_non_compliant / nullif(n, 0), 2) AS fail_rate FROM c")
def audit_fail_rates(spark, d):
    return audit.fail_rates(audit.by_domain(_judged(spark, d), F.col("ds"), F.col("status"))).select("domain", "fail_rate")


_PLACE = "CASE " + " ".join(f"WHEN lower(domain) = '{x.lower()}' THEN {i}" for i, x in enumerate(audit.DOMAIN_ORDER)) + " ELSE 1000000 END"


@query(f"{_COUNTS} SELECT domain, n, CAST({_PLACE} AS INT) AS place FROM c")
def ordered_domains(spark, d):
    return audit.ordered(audit.by_domain(_judged(spark, d), F.col("ds"), F.col("status"))).select("domain", "n", "place")


@query("SELECT status, count(*) AS n FROM (" + _JUDGED + " SELECT status FROM j) GROUP BY status")
def audit_overall(spark, d):
    return _judged(spark, d).groupBy("status").agg(F.count("*").alias("n"))


_LABEL = "CASE " + " ".join(f"WHEN lower(y) = '{x.lower()}' THEN '{x}'" for x in audit.DOMAIN_ORDER) + " ELSE y END"


@query(f"SELECT DISTINCT {_LABEL} AS label FROM (SELECT trim(regexp_replace(x, '\\s+', ' ', 'g')) AS y FROM (SELECT unnest({_LIST}) AS x FROM template_records))")
def domain_labels(spark, d):
    x = table(spark, d, "template_records").select(F.explode(audit.list_of(F.col("domains"))).alias("x"))
    return x.select(audit.domain_label(F.col("x")).alias("label")).distinct()


@query(
    """SELECT count(*) AS n, count(*) FILTER (WHERE prompt_text IS NULL OR trim(prompt_text) = '') AS empty, count(*) FILTER (WHERE NOT (prompt_text IS NULL OR trim(prompt_text) = '')) AS filled,
    min(CASE WHEN prompt_text IS NULL OR trim(prompt_text) = '' THEN rec_id END) AS first_empty, max(CASE WHEN prompt_text IS NULL OR trim(prompt_text) = '' THEN rec_id END) AS last_empty FROM template_records"""
)
def extraction_summary(spark, d):
    return audit.extraction_summary(table(spark, d, "template_records"), "prompt_text", "rec_id")


@query(
    f"""SELECT rec_id, concat_ws(chr(10), 'name: ' || coalesce(name, ''), 'domains: ' || array_to_string({_LIST}, ', '), left(coalesce(prompt_text, ''), 15000)) AS payload FROM template_records"""
)
def audit_payloads(spark, d):
    return table(spark, d, "template_records").select("rec_id", audit.payload(F.col("name"), audit.list_of(F.col("domains")), F.col("prompt_text")).alias("payload"))
