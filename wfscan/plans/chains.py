"""Risk chains: counts as text per file, stages, combinations. A class's number comes from the rule's place in the alphabet."""

from __future__ import annotations

from pyspark.sql import functions as F

from wfscan.operators import chains
from wfscan.plans.registry import query
from wfscan.session import table

# One text such as 'N1=3; N4=1' per file: the number is the length of the rule's name modulo nine, plus one.
_TEXT = """t AS (SELECT file, string_agg(letter || k || '=' || n, '; ' ORDER BY letter, k) AS stars FROM
    (SELECT file, CASE WHEN lower(severity) = 'info' THEN 'M' ELSE 'N' END AS letter, length(rule) % 9 + 1 AS k, count(*) AS n FROM scan_findings WHERE file IS NOT NULL GROUP BY ALL) GROUP BY file)"""


def _texts(spark, d):
    f = table(spark, d, "scan_findings").where("file is not null")
    g = f.groupBy("file", F.when(F.lower("severity") == "info", "M").otherwise("N").alias("letter"), (F.length("rule") % 9 + 1).alias("k")).agg(F.count("*").alias("n"))
    return g.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("letter", "k", "n"))), lambda x: F.concat(x["letter"], x["k"], F.lit("="), x["n"])), "; ").alias("stars"))


_ROWS = f"""WITH {_TEXT}, p AS (SELECT file, unnest(regexp_extract_all(stars, '[NM][0-9]+\\s*=\\s*[0-9]+')) AS x FROM t),
    r AS (SELECT file, left(x, 1) AS letter, CAST(regexp_extract(x, '^[NM]([0-9]+)', 1) AS INT) AS number, CAST(sum(CAST(regexp_extract(x, '=\\s*([0-9]+)', 1) AS INT)) AS BIGINT) AS n FROM p GROUP BY ALL)"""
_HIT = {s: f"coalesce(bool_or(n > 0 AND (letter = 'N' AND number IN {a if len(a) > 1 else f'({a[0]})'} OR letter = 'M' AND number IN {b if len(b) > 1 else f'({b[0]})'})), false)" for s, (a, b) in chains.STAGES.items()}
_FLAGS = f"""{_ROWS}, f AS (SELECT file, {", ".join(f"{c} AS {s}" for s, c in _HIT.items())} FROM r GROUP BY file),
    g AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {s} THEN '{s}' END" for s in chains.STAGES)}], lambda x: x IS NOT NULL) AS names FROM f),
    z AS (SELECT * EXCLUDE (names), CAST(len(names) AS INT) AS stages, array_to_string(names, '+') AS combination, len(names) >= 2 AS two_or_more FROM g)"""


def _rows(spark, d):
    return chains.star_rows(_texts(spark, d), "file", "stars")


@query(f"{_ROWS} SELECT file, letter, number, n FROM r")
def star_counts(spark, d):
    return _rows(spark, d)


@query(f"WITH {_TEXT} SELECT file, regexp_matches(stars, 'N3\\s*=') AS has_n3, CAST(len(regexp_extract_all(stars, 'N[0-9]+')) AS INT) AS classes FROM t")
def star_maps(spark, d):
    m = chains.star_counts(F.col("stars"), "N")
    return _texts(spark, d).select("file", F.map_contains_key(m, F.lit(3)).alias("has_n3"), F.size(m).alias("classes"))


def _flags(spark, d):
    return chains.stage_flags(_rows(spark, d), "file", servers=True)


@query(f"{_FLAGS} SELECT * FROM z")
def stage_flags(spark, d):
    return _flags(spark, d)


@query(f"{_FLAGS} SELECT count(*) AS templates, {', '.join(f'count(*) FILTER (WHERE {s}) AS {s}' for s in chains.STAGES)}, count(*) FILTER (WHERE two_or_more) AS two_or_more FROM z")
def stage_totals(spark, d):
    return chains.stage_totals(_flags(spark, d))


@query(f"{_FLAGS} SELECT combination, count(*) AS n FROM z WHERE combination <> '' GROUP BY combination ORDER BY n DESC, combination LIMIT 50")
def stage_combinations(spark, d):
    return chains.combinations(_flags(spark, d))


@query(
    """WITH m AS (SELECT npm_name, 'N' AS letter, length(rule) % 9 + 1 AS number, count(*) AS n FROM scan_findings WHERE lower(severity) = 'error' GROUP BY ALL), x AS (SELECT npm_name, 'M' AS letter, length(rule) % 9 + 1 AS number, count(*) AS n FROM scan_findings WHERE lower(severity) = 'info' GROUP BY ALL)
    SELECT npm_name, letter, number, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM m UNION ALL SELECT * FROM x WHERE npm_name IN (SELECT npm_name FROM m)) GROUP BY ALL"""
)
def merged_counts(spark, d):
    f = table(spark, d, "scan_findings")
    count = lambda sev, letter: f.where(F.lower("severity") == sev).groupBy("npm_name", F.lit(letter).alias("letter"), (F.length("rule") % 9 + 1).cast("bigint").alias("number")).agg(F.count("*").alias("n"))
    return chains.merged_counts(count("error", "N"), count("info", "M"), "npm_name")


@query(
    """SELECT template_id, name, packages, has_server FROM (SELECT template_id, first(name ORDER BY length(name) DESC NULLS LAST, name) AS name, count(DISTINCT domains) AS packages, coalesce(bool_or(contains(lower(domains), 'mcp')), false) AS has_server
    FROM (SELECT trim(template_id) AS template_id, name, domains FROM template_records WHERE name IS NOT NULL) GROUP BY template_id)"""
)
def longest_names(spark, d):
    r = table(spark, d, "template_records").where("name is not null").select(F.trim("template_id").alias("template_id"), "name", "domains")
    return chains.named_totals(r, "template_id", "name", "domains")


@query("SELECT template, CAST(row_number() OVER (ORDER BY try_cast(template AS BIGINT) NULLS LAST, template) AS BIGINT) AS place FROM (SELECT DISTINCT trim(template_id) AS template FROM template_records WHERE template_id IS NOT NULL)")
def numeric_order(spark, d):
    """Ids in numeric order, others last."""
    from wfscan.operators.registry import last_position

    t = table(spark, d, "template_records").where("template_id is not null").select(F.trim("template_id").alias("template")).distinct()
    return last_position(t, [F.col("template").try_cast("bigint").asc_nulls_last(), "template"]).select("template", F.col("position").alias("place"))
