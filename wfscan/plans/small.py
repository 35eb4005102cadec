"""Small predicates and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from wfscan.functions import names, text
from wfscan.operators import chains, dims, lexing, package_scan, registry, workflow
from wfscan.plans.registry import query, values
from wfscan.plans.registry import text as sql_text
from wfscan.plans.registry import text as literal
from wfscan.plans.workflow import _NODES
from wfscan.session import table


@query(f"SELECT class_id, class_name, tier, family FROM {values([(c[0], c[1], c[2], c[1].lower().replace(' / ', '_').replace('/', '_').replace(' ', '_')) for c in dims.CLASSES], 'class_id, class_name, tier, family')}")
def risk_class_catalogue(spark, d):
    return dims.classes(spark).select("class_id", "class_name", "tier", "family")


@query(f"{_NODES} SELECT record_id, node_no FROM n WHERE lower(string_split(node_type, '.')[1]) IN ('flow-base', '@flow/langchain')")
def official_nodes(spark, d):
    n = workflow.nodes(table(spark, d, "template"), ["record_id"])
    return n.where(names.is_official(names.package_of_type(F.col("node_type")), ["flow-base", "@flow/langchain"])).select("record_id", "node_no")


@query(
    f"""{_NODES} SELECT DISTINCT node_name FROM n WHERE trim(lower(node_name)) <> '' AND lower(trim(node_name)) NOT IN ({", ".join(literal(x) for x in package_scan.PROMPT_DENIED)}) AND regexp_matches(lower(trim(node_name)), '{"|".join(package_scan.PROMPT_NEEDLES)}')"""
)
def prompt_like_names(spark, d):
    n = workflow.nodes(table(spark, d, "template"), ["record_id"])
    return n.where(package_scan.prompt_like(F.col("node_name"))).select("node_name").distinct()


@query("SELECT DISTINCT npm_name FROM source_files WHERE contains(lower(npm_name), '-nodes-')")
def package_keyword(spark, d):
    return table(spark, d, "source_files").where(F.contains(F.lower("npm_name"), F.lit("-nodes-"))).select("npm_name").distinct()


@query("SELECT record_id FROM mcp_registry_servers WHERE lower(regexp_replace(trim(repository, ' '), '/+$', '')) = (SELECT min(lower(regexp_replace(trim(repository, ' '), '/+$', ''))) FROM mcp_registry_servers WHERE trim(repository, ' ') <> '')")
def same_repository(spark, d):
    """Records that give the first repository of the table as theirs; the compared address is one value."""
    s = table(spark, d, "mcp_registry_servers")
    first = s.where("trim(repository) <> ''").agg(F.min(F.lower(F.regexp_replace(F.trim("repository"), "/+$", ""))).alias("r")).first()[0]
    return s.where(names.same_repository(F.col("repository"), first or "")).select("record_id")


@query("SELECT row_id, coalesce(CASE WHEN trim(doc_text) <> '' THEN doc_text END, CASE WHEN trim(title) <> '' THEN title END) AS shown FROM topics_full")
def first_non_blank(spark, d):
    return table(spark, d, "topics_full").select("row_id", text.non_blank(F.col("doc_text"), F.col("title")).alias("shown"))


_HITS = """WITH c AS (SELECT server_name, CASE WHEN lang = 'py' THEN 1 WHEN lang = 'js' THEN 2 ELSE 3 END AS k, count(*) AS n FROM server_files GROUP BY ALL)"""


@query(f"{_HITS} SELECT server_name, 'M' AS letter, CAST(k AS INT) AS number, CAST(n AS BIGINT) AS n FROM c")
def server_class_hits(spark, d):
    """Counts written as JSON in both shapes - an object for Python, a list for the rest - and read again."""
    k = F.when(F.col("lang") == "py", 1).when(F.col("lang") == "js", 2).otherwise(3)
    c = table(spark, d, "server_files").groupBy("server_name", k.alias("k")).agg(F.count("*").cast("int").alias("n"))
    name = F.concat(F.lit("M"), F.col("k"))
    body = F.when(F.col("k") == 1, F.to_json(F.create_map(name, F.col("n")))).otherwise(F.to_json(F.array(F.struct(name.alias("id"), F.col("n").alias("count")))))
    return chains.server_hits(c.select("server_name", body.alias("body")), "server_name", "body")


def _hits_of(rx: str) -> str:
    """Matches of a pattern in source files as SQL: file_id, code, pos (0-based)."""
    return f"""a AS (SELECT file_id, code, regexp_extract_all(code, {sql_text(rx)}) AS m, string_split_regex(code, {sql_text(rx)}) AS p FROM source_files WHERE regexp_matches(code, {sql_text(rx)})),
    b AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM a),
    h AS (SELECT file_id, code, CAST(list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS INT) AS pos FROM b)"""


@query(
    f"""WITH {_hits_of("https?://")}, q AS (SELECT *, regexp_extract(substr(code, greatest(pos - 300, 0) + 1, least(pos, 300)), '(["''])[^"'']*$', 1) AS quoted, substr(code, greatest(pos - 300, 0) + 1, least(pos, 300) + 300) AS around FROM h)
    SELECT file_id, pos FROM q WHERE quoted <> '' AND contains(substr(code, pos + 1, 300), quoted) AND regexp_matches(around, '(?i)\\b(placeholder|default|example|examples|hint|help|tooltip|sample|description|displayName)\\s*:\\s*[''"`]')"""
)
def interface_text(spark, d):
    """Web addresses in quotes near interface keys; the quote context is an Arrow function."""
    f = table(spark, d, "source_files").where(F.col("code").rlike("https?://"))
    at = F.transform(text.all_matches(F.col("code"), "https?://"), lambda h: h["pos"].cast("int"))
    ui = lexing.ui_text_positions(package_scan.UI_KEY_PATTERN)
    return f.select("file_id", F.explode(F.arrays_zip(at.alias("pos"), ui(F.col("code"), at).alias("ui"))).alias("x")).where("x.ui").select("file_id", F.col("x.pos").alias("pos"))


_BLOCK_AT = r"password\s*:\s*\{"


@query(
    f"""WITH {_hits_of(_BLOCK_AT)}, w AS (SELECT *, substr(code, pos + 1, 2000) AS w FROM h), l AS (SELECT *, regexp_extract_all(w, '[{{}}]') AS braces, string_split_regex(w, '[{{}}]') AS bits FROM w),
    e AS (SELECT *, list_filter(range(1, len(braces) + 1), lambda j: braces[j] = '}}' AND 2 * len(list_filter(braces[1:j], lambda x: x = '{{')) <= j)[1] AS j FROM l)
    SELECT file_id, CASE WHEN j IS NULL THEN substr(w, 1, 800) ELSE substr(w, 1, j + CAST(list_sum(list_transform(bits[1:j], lambda y: length(y))) AS BIGINT)) END AS block FROM e"""
)
def field_blocks(spark, d):
    """The brace block around each credential field, as far as 2,000 characters; an Arrow function."""
    rx = _BLOCK_AT
    f = table(spark, d, "source_files").where(F.col("code").rlike(rx))
    at = F.transform(text.all_matches(F.col("code"), rx), lambda h: h["pos"].cast("int"))
    return f.select("file_id", F.explode(lexing.blocks_at(F.col("code"), at)).alias("block"))


@query("SELECT platform, count(*) AS n FROM (SELECT platform FROM topics_full UNION ALL SELECT source FROM documents WHERE source IS NOT NULL) GROUP BY platform")
def sources_together(spark, d):
    a, b = table(spark, d, "topics_full").select("platform"), table(spark, d, "documents").where("source is not null").select(F.col("source").alias("platform"))
    return registry.union_sources(a, b).groupBy("platform").agg(F.count("*").alias("n"))


@query("SELECT rec_id FROM template_records ORDER BY views DESC NULLS LAST, rec_id LIMIT 100")
def row_cap(spark, d):
    """The first rows of an explicit order; the cap is the feature."""
    return table(spark, d, "template_records").orderBy(F.desc_nulls_last("views"), "rec_id").limit(100).select("rec_id")
