"""Templates: nodes, metadata, prompts, package risk, agents, connections."""

from __future__ import annotations

from pyspark.sql import functions as F

from wfscan.operators import workflow as wf
from wfscan.plans.registry import query, text
from wfscan.session import table

_DOC = "WITH d AS (SELECT record_id, try_cast(ltrim(trim(body), chr(65279)) AS JSON) AS j, body FROM template WHERE body IS NOT NULL)"
_NODES = f"""{_DOC}, l AS (SELECT record_id, j, json_extract(j, '$.workflow.workflow.nodes[*]') AS a, json_extract(j, '$.workflow.nodes[*]') AS b, json_extract(j, '$.nodes[*]') AS c FROM d WHERE j IS NOT NULL),
    s AS (SELECT record_id, CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b ELSE c END AS ns FROM l),
    e AS (SELECT record_id, unnest(ns) AS node, unnest(range(0, len(ns))) AS node_no FROM s),
    n AS (SELECT record_id, CAST(node_no AS INT) AS node_no, node, trim(coalesce(CASE WHEN trim(node->>'$.type') <> '' THEN node->>'$.type' END, CASE WHEN trim(node->>'$.name') <> '' THEN node->>'$.name' END)) AS node_type, node->>'$.name' AS node_name
      FROM e WHERE json_type(node) = 'OBJECT')"""
_PACKAGED = f"""{_NODES}, p AS (SELECT *, string_split(node_type, '.')[1] AS package,
    coalesce(NOT (starts_with(node_type, 'flow-base.') OR starts_with(node_type, '@flow/')) AND (contains(node_type, '@custom/') OR (starts_with(node_type, '@') AND NOT starts_with(node_type, '@flow/')) OR regexp_matches(node_type, '^[a-z0-9]+-nodes-')), false) AS community FROM n)"""


def _nodes(spark, d):
    return wf.nodes(table(spark, d, "template"), ["record_id"])


@query(f"{_NODES} SELECT record_id, node_no, node_type, node_name FROM n")
def workflow_nodes(spark, d):
    return _nodes(spark, d).drop("node")


@query(
    f"""{_DOC} SELECT record_id, coalesce(nullif(trim(j->>'$.workflow.id'), ''), nullif(trim(j->>'$.id'), '')) AS meta_id, coalesce(nullif(j->>'$.workflow.name', ''), nullif(j->>'$.name', '')) AS title,
    coalesce(nullif(j->>'$.workflow.description', ''), nullif(j->>'$.description', '')) AS description, try_cast(coalesce(j->>'$.workflow.views', j->>'$.views') AS BIGINT) AS views,
    coalesce(nullif(j->>'$.workflow.createdAt', ''), nullif(j->>'$.createdAt', '')) AS created FROM d WHERE j IS NOT NULL"""
)
def template_meta(spark, d):
    return wf.template_meta(table(spark, d, "template"), ["record_id"])


@query(f"{_DOC} SELECT record_id FROM d WHERE j IS NULL")
def unreadable_templates(spark, d):
    t = table(spark, d, "template").where("body is not null")
    return t.where(wf.document(F.col("body")).isNull()).select("record_id")


@query(f"{_PACKAGED} SELECT package, community, count(*) AS nodes, count(DISTINCT record_id) AS templates FROM p GROUP BY ALL")
def node_packages(spark, d):
    return wf.with_packages(_nodes(spark, d)).groupBy("package", "community").agg(F.count("*").alias("nodes"), F.count_distinct("record_id").alias("templates"))


@query(
    f"""{_NODES}, f AS (SELECT record_id, node_no, node_type, unnest([{{'field': 'text', 'content': node->>'$.parameters.text'}}, {{'field': 'prompt', 'content': node->>'$.parameters.prompt'}}, {{'field': 'systemMessage', 'content': node->>'$.parameters.systemMessage'}},
      {{'field': 'options.systemMessage', 'content': node->>'$.parameters.options.systemMessage'}}, {{'field': 'options.text', 'content': node->>'$.parameters.options.text'}}, {{'field': 'options.prompt', 'content': node->>'$.parameters.options.prompt'}}]) AS p FROM n),
    ml AS (SELECT record_id, node_no, node_type, CASE WHEN json_type(node, '$.parameters.messages.values') = 'ARRAY' THEN json_extract(node, '$.parameters.messages.values[*]') WHEN json_type(node, '$.parameters.messages') = 'ARRAY' THEN json_extract(node, '$.parameters.messages[*]') ELSE [] END AS ms FROM n),
    me AS (SELECT record_id, node_no, node_type, unnest(ms) AS m, unnest(range(0, len(ms))) AS i FROM ml)
    SELECT record_id, node_no, node_type, p.field AS field, p.content AS content FROM f WHERE trim(p.content) <> '' UNION ALL
    SELECT record_id, node_no, node_type, 'messages[' || i || '].content', m->>'$.content' FROM me WHERE trim(m->>'$.content') <> ''"""
)
def prompt_fields(spark, d):
    return wf.prompts(_nodes(spark, d), ["record_id"])


_RISK = "SELECT npm_name AS package, CASE WHEN count(*) FILTER (WHERE lower(severity) = 'error') >= 30 THEN 'high' WHEN count(*) FILTER (WHERE lower(severity) = 'error') >= 3 THEN 'medium' ELSE 'low' END AS risk_level, count(*) AS score FROM scan_findings GROUP BY npm_name"


@query(_RISK)
def package_risk(spark, d):
    return wf.package_risk(table(spark, d, "scan_findings"), 3)


# Node types of the templates and scanned packages have few names in common, so the first word of a package stands for it.
_STEM = "regexp_extract(package, '^(?:@[a-z]+/)?[a-z0-9]+-nodes-([a-z]+)', 1)"
_STEM_RISK = f"SELECT {_STEM} AS package, CASE WHEN count(*) FILTER (WHERE lower(severity) = 'error') >= 30 THEN 'high' WHEN count(*) FILTER (WHERE lower(severity) = 'error') >= 3 THEN 'medium' ELSE 'low' END AS risk_level FROM (SELECT npm_name AS package, severity FROM scan_findings) GROUP BY 1"


def _stem_risk(spark, d):
    f = table(spark, d, "scan_findings").withColumn("npm_name", F.regexp_extract("npm_name", r"^(?:@[a-z]+/)?[a-z0-9]+-nodes-([a-z]+)", 1))
    return wf.package_risk(f, 3)


@query(
    f"""{_PACKAGED}, q AS (SELECT * EXCLUDE (package), CASE WHEN community THEN {_STEM} ELSE package END AS package FROM p), r AS ({_STEM_RISK})
    SELECT record_id, count(*) AS nodes, count(risk_level) AS risky_nodes, count(*) FILTER (WHERE risk_level = 'high') AS high_nodes, coalesce(bool_or(risk_level = 'high'), false) AS has_high FROM q LEFT JOIN r USING (package) GROUP BY record_id"""
)
def template_risk_rollup(spark, d):
    n = _nodes(spark, d)
    n = n.withColumn("node_type", F.when(F.col("node_type").rlike("^[a-z0-9]+-nodes-"), F.concat(F.regexp_extract("node_type", r"^(?:@[a-z]+/)?[a-z0-9]+-nodes-([a-z]+)", 1), F.lit("."))).otherwise(F.col("node_type")))
    return wf.risk_rollup(n, _stem_risk(spark, d), "record_id").select("record_id", "nodes", "risky_nodes", "high_nodes", "has_high")


@query(
    f"""{_PACKAGED}, h AS (SELECT package, record_id, count(*) AS hits FROM p WHERE community AND contains(node_type, '.') GROUP BY ALL)
    SELECT package, CAST(sum(hits) AS BIGINT) AS occurrences, count(DISTINCT record_id) AS templates, array_to_string(list_sort(list(DISTINCT record_id))[1:10], '|') AS examples FROM h GROUP BY package ORDER BY templates DESC, package LIMIT 20"""
)
def risky_packages_top(spark, d):
    n = wf.with_packages(_nodes(spark, d))
    listed = n.where("community").select("package").distinct()
    hits = wf.prefix_hits(_nodes(spark, d), listed, "record_id")
    return wf.package_occurrences(hits, "record_id").orderBy(F.desc("templates"), "package").limit(20)


@query(
    f"""{_PACKAGED}, k AS (SELECT DISTINCT package FROM p WHERE community) SELECT package, record_id, count(*) AS hits, array_to_string(list_sort(list(DISTINCT node_type)), '|') AS types FROM p SEMI JOIN k USING (package) WHERE contains(node_type, '.') GROUP BY ALL"""
)
def risky_prefix_hits(spark, d):
    n = _nodes(spark, d)
    return wf.prefix_hits(n, wf.with_packages(n).where("community").select("package"), "record_id")


def _contains(words):
    return "coalesce(" + " OR ".join(f"contains(node_type, {text(w)})" for w in words) + ", false)"


# The types once more, as SQL sees them; fixed values.
_MODELS = [
    "langchain.agent", "langchain.openAi", "langchain.anthropic", "langchain.chainLlm", "langchain.informationExtractor", "langchain.agentTool",
    "langchain.googleGemini", "langchain.googleGeminiTool", "langchain.chainRetrievalQa", "langchain.outputParserAutofixing",
    "langchain.outputParserStructured", "langchain.guardrails", "base.openAi", "base.openai", "base.anthropic", "langchain.lmChatOpenAi",
    "langchain.lmChatAnthropic", "langchain.lmChatGoogleGemini", "langchain.lmChatAzureOpenAi", "langchain.lmChatGroq",
    "langchain.lmChatMistralCloud", "langchain.lmChatOpenRouter", "langchain.lmChatXAiGrok", "langchain.chat", "langchain.chatTrigger",
    "langchain.chainSummarization", "langchain.textClassifier",
]
_RETRIEVAL = [
    "langchain.chainRetrievalQa", "langchain.retrievalQa", "base.pinecone", "base.weaviate", "base.chroma", "base.qdrant", "base.milvus",
    "base.vectorStore", "base.openAiEmbeddings", "base.embedding", "langchain.documentLoader", "langchain.documentLoaderText",
    "langchain.documentLoaderPdf", "langchain.documentLoaderCsv", "langchain.textSplitter", "langchain.memoryBufferWindow", "langchain.memoryBuffer",
    "langchain.retriever", "langchain.vectorStore",
]
_DISCLAIMED = ("self-hosted only", "self-hosted", "self hosted only", "self hosted", "not available in flow cloud", "not available in cloud", "cloud not supported", "requires self-hosting", "self-hosting required")


_AGENTS = f"""{_NODES}, g AS (SELECT record_id, count(*) FILTER (WHERE ends_with(node_type, '.agent')) AS agents, count(*) FILTER (WHERE {_contains(_MODELS)}) AS models, count(*) FILTER (WHERE {_contains(_RETRIEVAL)}) AS retrieval,
    count(*) FILTER (WHERE regexp_matches(lower(node_type), 'tool|mcp')) AS tools FROM n GROUP BY record_id)"""


@query(f"{_AGENTS} SELECT *, agents > 1 AS multi_agent FROM g")
def agent_stats(spark, d):
    return wf.agent_stats(_nodes(spark, d), "record_id")


@query(f"{_AGENTS} SELECT agents, count(*) AS templates FROM g GROUP BY agents")
def agent_distribution(spark, d):
    return wf.agent_stats(_nodes(spark, d), "record_id").groupBy("agents").agg(F.count("*").alias("templates"))


@query(f"{_NODES} SELECT node_type, count(*) AS nodes FROM n WHERE {_contains(_MODELS)} GROUP BY node_type")
def model_node_types(spark, d):
    return _nodes(spark, d).where(wf.type_contains(_MODELS)).groupBy("node_type").agg(F.count("*").alias("nodes"))


@query(
    f"""{_PACKAGED}, c AS (SELECT record_id, bool_or(community) AS community FROM p GROUP BY record_id),
    m AS (SELECT record_id, coalesce({" OR ".join(f"contains(lower(coalesce(nullif(j->>'$.workflow.description', ''), nullif(j->>'$.description', ''))), {text(w)})" for w in _DISCLAIMED)}, false) AS described FROM d WHERE j IS NOT NULL),
    g AS (SELECT count(*) AS templates, count(*) FILTER (WHERE described) AS with_disclaimer FROM c JOIN m USING (record_id) WHERE community)
    SELECT *, round(100.0 * with_disclaimer / nullif(templates, 0), 1) AS rate FROM g"""
)
def disclaimer_rates(spark, d):
    return wf.disclaimer_rates(table(spark, d, "template"), _nodes(spark, d), "record_id", "flow")


_P = lambda k: f"CASE WHEN trim(node->>'$.parameters.{k}') <> '' THEN node->>'$.parameters.{k}' END"
_CONN = f"""{_NODES}, u AS (SELECT record_id, node_no, trim(coalesce({_P("endpointUrl")}, {_P("url")}, {_P("serverUrl")}, {_P("endpoint")})) AS raw,
      coalesce({_P("authentication")}, {_P("authType")}, {_P("auth")}) IS NOT NULL OR coalesce(len(list_filter(json_extract(node, '$.parameters.headerParameters.parameters[*]'), lambda h: regexp_matches(lower(h->>'$.name'), 'auth|bearer|token|api') AND (h->>'$.value') <> '')) > 0, false) AS auth,
      coalesce(node->>'$.parameters.verifySSL', node->>'$.parameters.ssl', node->>'$.parameters.tls') IS NOT NULL AS verified FROM n),
    v AS (SELECT record_id, node_no, raw AS url, lower(raw) AS low, auth, verified, regexp_extract(raw, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host FROM u WHERE raw IS NOT NULL AND NOT starts_with(raw, '=')),
    x AS (SELECT record_id, node_no, url, auth, verified, NOT regexp_matches(low, 'localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0') AS external, {" OR ".join(f"contains(low, {text(t)})" for t in wf.TUNNELS)} AS tunnel,
      regexp_matches(low, 'localhost|127\\.0\\.0\\.1') AND (starts_with(low, 'http://') OR coalesce(try_cast(regexp_extract(low, ':([0-9]+)', 1) AS INT), 80) NOT IN (80, 443, 8080)) AS exposed,
      contains(lower(host), 'flow') AND host <> 'flow.example' AND contains(host, '.') AS lookalike FROM v)"""


@query(f"{_CONN} SELECT * FROM x")
def connection_traits(spark, d):
    return wf.connections(_nodes(spark, d), ["record_id"], ["flow.example"], "flow").where("url is not null")


@query(
    f"""{_CONN}, t AS (SELECT record_id, bool_or(external) AS external, bool_or(tunnel) AS tunnel, bool_or(exposed) AS exposed, bool_or(lookalike) AS lookalike, bool_or(NOT auth) AS no_auth, bool_or(NOT verified) AS no_verification FROM x GROUP BY record_id)
    SELECT count(*) AS templates, {", ".join(f"count(*) FILTER (WHERE {c}) AS {c}" for c in ("external", "tunnel", "exposed", "lookalike", "no_auth", "no_verification"))} FROM t"""
)
def connection_summary(spark, d):
    return wf.connection_summary(wf.connections(_nodes(spark, d), ["record_id"], ["flow.example"], "flow"), "record_id")


_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


@query(f"SELECT uuid, count(*) AS uses, count(DISTINCT finding_id) AS templates FROM (SELECT finding_id, lower(unnest(regexp_extract_all(code_snippet, '{_UUID}'))) AS uuid FROM scan_findings) GROUP BY uuid HAVING count(*) > 1")
def reused_identifiers(spark, d):
    return wf.reused_ids(table(spark, d, "scan_findings"), "finding_id", "code_snippet")


@query(
    """WITH a AS (SELECT DISTINCT npm_name FROM source_files), b AS (SELECT DISTINCT npm_name FROM scan_findings), j AS (SELECT a.npm_name AS x, b.npm_name AS y FROM a FULL JOIN b ON a.npm_name = b.npm_name)
    SELECT CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 'both' WHEN x IS NOT NULL THEN 'only_first' ELSE 'only_second' END AS part, count(*) AS n FROM j GROUP BY ALL"""
)
def both_only_partition(spark, d):
    return wf.partition_of(table(spark, d, "source_files"), table(spark, d, "scan_findings"), "npm_name")


@query(f"WITH t AS (SELECT DISTINCT template_id FROM template), r AS (SELECT rec_id, try_cast(nullif(regexp_replace(trim(template_id), '^0+', ''), '') AS BIGINT) AS tid FROM template_records) SELECT rec_id FROM r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.template_id = r.tid)")
def missing_lookup(spark, d):
    """Prompts whose template isn't there: the lookup that came back empty."""
    r = table(spark, d, "template_records").select("rec_id", F.regexp_replace(F.trim("template_id"), "^0+", "").try_cast("bigint").alias("template_id"))
    return r.join(table(spark, d, "template").select("template_id").distinct(), "template_id", "left_anti").select("rec_id")


@query(f"WITH t AS (SELECT DISTINCT template_id FROM template), r AS (SELECT rec_id, try_cast(nullif(regexp_replace(trim(template_id), '^0+', ''), '') AS BIGINT) AS tid FROM template_records) SELECT rec_id, tid AS template_id FROM r WHERE EXISTS (SELECT 1 FROM t WHERE t.template_id = r.tid)")
def found_lookup(spark, d):
    r = table(spark, d, "template_records").select("rec_id", F.regexp_replace(F.trim("template_id"), "^0+", "").try_cast("bigint").alias("template_id"))
    return r.join(table(spark, d, "template").select("template_id").distinct(), "template_id", "left_semi").select("rec_id", "template_id")


@query(
    """WITH i AS (SELECT DISTINCT name FROM mcp_registry_servers WHERE trim(name) <> ''), h AS (SELECT s.file_id, i.name FROM (SELECT file_id, code_path FROM server_files) s JOIN i ON contains(s.code_path, i.name))
    SELECT file_id, array_to_string(list_sort(list(name)), '|') AS ids FROM h GROUP BY file_id"""
)
def contained_names(spark, d):
    """Registry names that occur in a path, also inside longer words."""
    out = wf.contained_ids(table(spark, d, "mcp_registry_servers"), "name", table(spark, d, "server_files"), "file_id", "code_path")
    return out.withColumn("file_id", F.col("file_id").cast("bigint"))


@query()
def model_texts(spark, d):
    """Texts under prompt-like keys at any depth; the walk is recursive, so there is no SQL."""
    from wfscan.operators.audit import model_texts as walk

    return table(spark, d, "template").select("record_id", walk(F.col("body")).alias("texts")).where("texts <> ''")
