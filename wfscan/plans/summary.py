"""Summaries of findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from wfscan.operators import dims, findings
from wfscan.plans.registry import query, values
from wfscan.session import table


@query(
    """SELECT CASE WHEN grouping(source) = 0 AND grouping(rule) = 0 THEN 'source+rule' WHEN grouping(source) = 0 AND grouping(category) = 0 THEN 'source+category' WHEN grouping(rule) = 0 THEN 'rule' WHEN grouping(category) = 0 THEN 'category' ELSE 'total' END AS by,
    source, rule, category, count(*) AS n FROM (SELECT lower(severity) AS source, rule, category FROM scan_findings) GROUP BY GROUPING SETS ((rule), (source, rule), (category), (source, category), ())"""
)
def a1_findings_summary(spark, d):
    """Counts by rule and category, each also by severity, in one pass."""
    f = table(spark, d, "scan_findings").select(F.lower("severity").alias("sev"), "rule", "category")
    return findings.summary(f, "sev")


_ERRORS = "SELECT npm_name, rule, count(*) AS n FROM scan_findings WHERE lower(severity) = 'error' AND rule <> 'TEXT_LITERAL' GROUP BY npm_name, rule"


@query(
    f"""SELECT npm_name, CAST(sum(n) AS BIGINT) AS errors, count(*) AS rules, string_agg(rule || '=' || n, '|' ORDER BY n DESC, rule) AS top_rules FROM ({_ERRORS}) GROUP BY npm_name"""
)
def a2_errors_by_package(spark, d):
    return findings.errors_by_package(table(spark, d, "scan_findings"), "TEXT_LITERAL")


@query(
    """WITH p AS (SELECT DISTINCT npm_name FROM source_files), e AS (SELECT npm_name, count(*) FILTER (WHERE lower(severity) = 'error') AS errors, count(*) FILTER (WHERE lower(severity) IN ('error', 'warn')) AS serious FROM scan_findings WHERE rule = 'DESTRUCTIVE_CALL' GROUP BY npm_name),
    g AS (SELECT count(*) AS packages, count(*) FILTER (WHERE coalesce(errors, 0) = 0) AS zero_error, count(*) FILTER (WHERE coalesce(serious, 0) = 0) AS strict_zero FROM p LEFT JOIN e USING (npm_name))
    SELECT *, round(100.0 * zero_error / nullif(packages, 0), 2) AS zero_error_rate, round(100.0 * strict_zero / nullif(packages, 0), 2) AS strict_rate FROM g"""
)
def a3_clean_rates(spark, d):
    return findings.clean_rates(table(spark, d, "source_files"), table(spark, d, "scan_findings").where("rule = 'DESTRUCTIVE_CALL'"))


@query(
    """SELECT kind, count(*) AS findings, count(DISTINCT npm_name) AS packages FROM (SELECT npm_name, unnest(list_filter([CASE WHEN regexp_matches(matched_text, '[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]') THEN 'emoji' END,
    CASE WHEN regexp_matches(matched_text, '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}]') THEN 'cjk' WHEN regexp_matches(matched_text, '[^\\x00-\\x7F]') THEN 'other_unicode' END], lambda x: x IS NOT NULL)) AS kind FROM scan_findings) GROUP BY kind"""
)
def a4_script_classes(spark, d):
    return findings.script_classes(table(spark, d, "scan_findings"))


@query("""SELECT count(*) AS findings, count(DISTINCT npm_name) AS packages, count(DISTINCT file) AS files FROM scan_findings WHERE rule = 'HARDCODED_SECRET' AND NOT regexp_matches(coalesce(message, ''), '(?i)mit')""")
def a5_filtered_harvest(spark, d):
    f = table(spark, d, "scan_findings").where((F.col("rule") == "HARDCODED_SECRET") & ~F.coalesce("message", F.lit("")).rlike("(?i)mit"))
    return f.agg(F.count("*").alias("findings"), F.count_distinct("npm_name").alias("packages"), F.count_distinct("file").alias("files"))


_PANELS = values([(r, p) for p, rs in dims.PANELS.items() for r in rs], "rule, panel")


@query(f"SELECT panel, lower(severity) AS source, count(*) AS n FROM scan_findings JOIN {_PANELS} USING (rule) GROUP BY ALL")
def a6_panel_counts(spark, d):
    return findings.panel_counts(table(spark, d, "scan_findings").withColumn("sev", F.lower("severity")), "sev")


@query("SELECT CASE WHEN lower(severity) IN ('error', 'warn') THEN lower(severity) ELSE 'unknown' END AS status, count(*) AS n FROM scan_findings GROUP BY ALL")
def a8_status_distribution(spark, d):
    return findings.folded_status(table(spark, d, "scan_findings"), F.lower("severity"), ["error", "warn"])


@query(
    """SELECT n, file, matched_text, category, round(100.0 * file / nullif(n, 0), 2) AS file_rate, round(100.0 * matched_text / nullif(n, 0), 2) AS matched_text_rate, round(100.0 * category / nullif(n, 0), 2) AS category_rate
    FROM (SELECT count(*) AS n, count(file) AS file, count(matched_text) AS matched_text, count(category) AS category FROM scan_findings)"""
)
def a10_availability(spark, d):
    return findings.availability(table(spark, d, "scan_findings"), {c: F.col(c).isNotNull() for c in ("file", "matched_text", "category")})


def _rates(key):
    return f"""WITH t AS (SELECT count(DISTINCT npm_name) AS total FROM scan_findings)
    SELECT {key} AS key, count(DISTINCT npm_name) AS packages, count(DISTINCT CASE WHEN lower(severity) = 'error' THEN npm_name END) AS errors, count(DISTINCT CASE WHEN lower(severity) = 'warn' THEN npm_name END) AS warnings,
    count(DISTINCT CASE WHEN lower(severity) = 'info' THEN npm_name END) AS infos, round(100.0 * count(DISTINCT npm_name) / max(total), 2) AS rate, round(100.0 * count(DISTINCT CASE WHEN lower(severity) = 'error' THEN npm_name END) / max(total), 2) AS error_rate
    FROM scan_findings, t WHERE {key} IS NOT NULL GROUP BY {key}"""


@query(_rates("rule"))
def a11_rule_violations(spark, d):
    return findings.violation_rates(table(spark, d, "scan_findings"), "rule")


@query(_rates("category"))
def a11_category_violations(spark, d):
    return findings.violation_rates(table(spark, d, "scan_findings"), "category")


_LEVELS = ["EVAL_DYNAMIC", "RAW_NET", "HTTP_PROTO"]


@query(
    "SELECT npm_name, "
    + ", ".join(f"count(*) FILTER (WHERE rule = '{r}'{'' if k is None else f" AND lower(severity) = '{k}'"}) AS {r}_{n}" for r in _LEVELS for n, k in (("T", None), ("E", "error"), ("W", "warn"), ("I", "info")))
    + " FROM scan_findings GROUP BY npm_name"
)
def t7_package_levels(spark, d):
    return findings.package_levels(table(spark, d, "scan_findings"), _LEVELS)


@query("SELECT rule, finding_id, CAST(position AS INT) AS position FROM (SELECT rule, finding_id, row_number() OVER (PARTITION BY rule ORDER BY finding_id) AS position FROM scan_findings) WHERE position <= 5")
def w8_capped_examples(spark, d):
    return findings.capped_examples(table(spark, d, "scan_findings"), "rule", ["finding_id"], 5).select("rule", "finding_id", "position")


@query("SELECT npm_name, count(*) AS n FROM scan_findings WHERE npm_name IS NOT NULL GROUP BY npm_name ORDER BY n DESC, npm_name LIMIT 20")
def o2_top_packages(spark, d):
    return findings.top_counts(table(spark, d, "scan_findings"), "npm_name", 20)


@query("""SELECT severity, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS rate FROM (SELECT coalesce(lower(trim(severity)), 'none') AS severity FROM scan_findings) GROUP BY severity""")
def severity_breakdown(spark, d):
    f = table(spark, d, "scan_findings").select(F.coalesce(F.lower(F.trim("severity")), F.lit("none")).alias("severity"))
    total = f.agg(F.count("*").alias("total"))  # one row
    return f.groupBy("severity").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("severity", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("rate"))


@query()
def a7_network_dependencies(spark, d):
    from wfscan.operators.package_scan import dependencies

    m = table(spark, d, "source_files").where(F.col("file_path").endswith("package.json")).select("npm_name", "code")
    return findings.network_dependencies(dependencies(m))


@query(
    """WITH m AS (SELECT npm_name, bool_or(json_valid(code)) AS ok, max(CASE WHEN json_valid(code) THEN coalesce(code->>'$.license', code->>'$.licenses') END) AS licence FROM source_files WHERE ends_with(file_path, 'config.json') GROUP BY npm_name),
    j AS (SELECT p.npm_name, m.npm_name IS NOT NULL AS there, ok, licence FROM (SELECT DISTINCT npm_name FROM source_files) p LEFT JOIN m ON m.npm_name = p.npm_name)
    SELECT npm_name, 'PKG_JSON_MISSING' AS rule, 'warn' AS severity FROM j WHERE NOT there UNION ALL SELECT npm_name, 'PKG_JSON_INVALID', 'error' FROM j WHERE NOT ok
    UNION ALL SELECT npm_name, 'LICENSE', 'warn' FROM j WHERE ok AND (licence IS NULL OR NOT regexp_matches(licence, '(?i)mit') AND NOT regexp_matches(licence, '^[\\[{]'))"""
)
def manifest_findings(spark, d):
    from wfscan.operators.package_scan import manifest_findings as find

    f = table(spark, d, "source_files")
    return find(f, f.where(F.col("file_path").endswith("config.json")).select("npm_name", "code"))
