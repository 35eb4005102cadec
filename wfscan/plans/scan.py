"""Pattern scans: rates, hits, offsets, lines, snippets, repeats, imports, enrichment, servers."""

from __future__ import annotations

from pyspark.sql import functions as F

from wfscan.functions import text as tx
from wfscan.functions.names import is_tooling, language_class, module_base, network_reason
from wfscan.operators import dims, package_scan, server_scan
from wfscan.plans.registry import query, text, values
from wfscan.session import table

# Patterns that Java and RE2 read alike.
PORTABLE = {
    "eval_call": r"\beval\s*\(",
    "command_call": r"\b(execSync|spawn|subprocess\.run)\s*\(",
    "json_parse": r"\bJSON\.parse\s*\(",
    "web_address": r"https?://[A-Za-z0-9.-]+",
    "environment": r"\bprocess\.env\b",
    "select_statement": r"SELECT [A-Za-z]+",
}
TEXT_RULES = {"version_mention": r"[Vv]ersion [0-9]+", "bullet_list": r"(?m)^[-*] ", "non_ascii": r"[^\x00-\x7F]", "number_unit": r"[0-9]+ (MB|ms|rows|items)"}


def _rule_rows(rules):
    return values(list(rules.items()), "rule, rx")


@query(
    f"""WITH r AS {_rule_rows(TEXT_RULES)}, d AS (SELECT doc_id, text FROM documents),
    n AS (SELECT count(DISTINCT doc_id) AS total FROM d)
    SELECT rule, count(DISTINCT doc_id) AS docs, round(100.0 * count(DISTINCT doc_id) / max(total), 2) AS rate
    FROM d, r, n WHERE regexp_matches(text, rx) GROUP BY rule"""
)
def finding_rates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    total = docs.agg(F.count_distinct("doc_id").alias("total"))
    hit = docs.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.col("text").rlike(rx), F.lit(r)) for r, rx in TEXT_RULES.items()]))).alias("rule"))
    g = hit.groupBy("rule").agg(F.count_distinct("doc_id").alias("docs"))
    return g.join(F.broadcast(total)).select("rule", "docs", F.round(100.0 * F.col("docs") / F.col("total"), 2).alias("rate"))


def _hits(spark, d):
    files = table(spark, d, "source_files").where("code is not null")
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.regexp_count("code", F.lit(rx)).cast("bigint").alias("n")) for r, rx in PORTABLE.items()])
    return files.select("file_id", "npm_name", "lang", F.explode(rows).alias("h")).select("file_id", "npm_name", "lang", "h.rule", "h.n").where("n > 0")


_HITS = f"SELECT file_id, npm_name, lang, rule, CAST(len(regexp_extract_all(code, rx)) AS BIGINT) AS n FROM source_files, {_rule_rows(PORTABLE)} AS r WHERE regexp_matches(code, rx)"


@query(f"SELECT file_id, rule, n FROM ({_HITS})")
def rule_hits_long(spark, d):
    return _hits(spark, d).select("file_id", "rule", "n")


@query(f"SELECT lang, rule, CAST(sum(n) AS BIGINT) AS hits, count(*) AS files FROM ({_HITS}) GROUP BY lang, rule")
def rule_hits_by_lang(spark, d):
    return _hits(spark, d).groupBy("lang", "rule").agg(F.sum("n").alias("hits"), F.count("*").alias("files"))


_SPANS = f"""WITH a AS (SELECT file_id, code, regexp_extract_all(code, {text(PORTABLE["command_call"])}) AS m, string_split_regex(code, {text(PORTABLE["command_call"])}) AS p FROM source_files WHERE code IS NOT NULL),
    b AS (SELECT file_id, code, m, p, unnest(range(1, len(m) + 1)) AS i FROM a),
    s AS (SELECT file_id, code, m[i] AS match, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos FROM b)"""


def _spans(spark, d):
    f = table(spark, d, "source_files").where("code is not null")
    return f.select("file_id", "code", F.explode(tx.all_matches(F.col("code"), PORTABLE["command_call"])).alias("h")).select("file_id", "code", "h.match", F.col("h.pos").cast("bigint").alias("pos"))


@query(f"{_SPANS} SELECT file_id, match, pos FROM s")
def finding_spans(spark, d):
    return _spans(spark, d).drop("code")


@query(f"{_SPANS} SELECT file_id, pos, CAST(length(left(code, pos)) - length(replace(left(code, pos), chr(10), '')) + 1 AS BIGINT) AS line FROM s")
def finding_lines(spark, d):
    return _spans(spark, d).select("file_id", "pos", tx.line_of(F.col("code"), F.col("pos")).cast("bigint").alias("line"))


@query(
    f"""{_SPANS}, l AS (SELECT file_id, pos, string_split(code, chr(10)) AS ls, CAST(length(left(code, pos)) - length(replace(left(code, pos), chr(10), '')) + 1 AS BIGINT) AS line FROM s)
    SELECT file_id, pos, array_to_string(ls[greatest(1, line - 3):least(len(ls), line + 3)], chr(10)) AS snippet FROM l"""
)
def finding_snippets(spark, d):
    s = _spans(spark, d)
    return s.select("file_id", "pos", tx.lines_around(F.col("code"), tx.line_of(F.col("code"), F.col("pos")), 3, 3).alias("snippet"))


@query(
    """SELECT finding_id, rule, file FROM (SELECT *, row_number() OVER (PARTITION BY rule, file, message, npm_name, line_start, line_end, array_to_string(match_lines, ',') ORDER BY finding_id) AS n FROM scan_findings) WHERE n = 1"""
)
def finding_dedup(spark, d):
    return package_scan.distinct_findings(table(spark, d, "scan_findings"), ["finding_id"]).select("finding_id", "rule", "file")


@query(f"""SELECT file_id FROM source_files WHERE regexp_matches(code, {text(PORTABLE["eval_call"])}) AND regexp_matches(code, {text(PORTABLE["json_parse"])})""")
def file_conjunctive_rule(spark, d):
    f = table(spark, d, "source_files")
    return f.where(F.col("code").rlike(PORTABLE["eval_call"]) & F.col("code").rlike(PORTABLE["json_parse"])).select("file_id")


@query(f"""SELECT file_id FROM source_files WHERE regexp_matches(code, {text(PORTABLE["command_call"])}) AND NOT regexp_matches(code, {text(PORTABLE["json_parse"])})""")
def file_anti_rule(spark, d):
    f = table(spark, d, "source_files")
    return f.where(F.col("code").rlike(PORTABLE["command_call"]) & ~F.col("code").rlike(PORTABLE["json_parse"])).select("file_id")


@query(
    f"""SELECT file_id, length(left(code, length(string_split_regex(code, {text(PORTABLE["web_address"])})[1]))) AS pos, regexp_extract(code, {text(PORTABLE["web_address"])}) AS match
    FROM source_files WHERE regexp_matches(code, {text(PORTABLE["web_address"])})"""
)
def first_match_rule(spark, d):
    f = table(spark, d, "source_files").where(F.col("code").rlike(PORTABLE["web_address"]))
    return f.select("file_id", (F.regexp_instr("code", F.lit(PORTABLE["web_address"])) - 1).cast("bigint").alias("pos"), F.regexp_extract("code", PORTABLE["web_address"], 0).alias("match"))


@query(
    """SELECT file_id, count(*) AS lines, CAST(sum(CASE WHEN regexp_matches(line, '^\\s*(//|#|\\*|/\\*)') THEN 1 ELSE 0 END) AS BIGINT) AS comment_lines
    FROM (SELECT file_id, unnest(string_split(code, chr(10))) AS line FROM source_files) GROUP BY file_id"""
)
def comment_lines(spark, d):
    f = table(spark, d, "source_files").select("file_id", F.explode(F.split("code", "\n", -1)).alias("line"))
    return f.groupBy("file_id").agg(F.count("*").alias("lines"), F.count_if(tx.is_comment_line(F.col("line"))).alias("comment_lines"))


_IMPORT = r"""(?m)import\s+(?:[^'";]*?\s+from\s+)?['"]([^'"]+)['"]"""
_MODULES = f"""SELECT file_id, CASE WHEN s LIKE '@%' THEN array_to_string(string_split(s, '/')[1:2], '/') ELSE string_split(s, '/')[1] END AS module
    FROM (SELECT file_id, regexp_replace(unnest(regexp_extract_all(code, {text(_IMPORT)}, 1)), '^node:', '') AS s FROM source_files)"""


def _modules(spark, d):
    f = table(spark, d, "source_files").where("code is not null")
    return f.select("file_id", F.explode(F.regexp_extract_all("code", F.lit(_IMPORT), F.lit(1))).alias("spec")).select("file_id", module_base(F.col("spec")).alias("module"))


@query(f"SELECT module, count(*) AS imports, count(DISTINCT file_id) AS files FROM ({_MODULES}) GROUP BY module")
def import_modules(spark, d):
    return _modules(spark, d).groupBy("module").agg(F.count("*").alias("imports"), F.count_distinct("file_id").alias("files"))


from wfscan.functions.names import NETWORK_PREFIXES, NETWORK_WORDS, TOOLING_PREFIXES  # noqa: E402

_LIST = lambda xs: "[" + ", ".join(text(x) for x in xs) + "]"
_REASON = f"""coalesce('name_prefix:' || list_filter({_LIST(NETWORK_PREFIXES)}, lambda p: starts_with(lower(module), p))[1], 'name_keyword:' || list_filter({_LIST(NETWORK_WORDS)}, lambda p: contains(lower(module), p))[1])"""


@query(f"SELECT DISTINCT module, {_REASON} AS reason, len(list_filter({_LIST(TOOLING_PREFIXES)}, lambda p: starts_with(lower(module), p))) > 0 AS tooling FROM ({_MODULES})")
def network_module_reason(spark, d):
    m = _modules(spark, d).select("module").distinct()
    return m.select("module", network_reason(F.col("module")).alias("reason"), is_tooling(F.col("module")).alias("tooling"))


# A family table for the modules at hand: the first word of a module's name decides.
_WORDS = [("socket", "network"), ("request", "network"), ("relay", "network"), ("proxy", "tunnel"), ("session", "state"), ("cookie", "state"), ("token", "secret"), ("key", "secret")]


@query(f"SELECT f.family, count(*) AS imports, count(DISTINCT file_id) AS files FROM ({_MODULES}) m JOIN {values(_WORDS, 'word, family')} f ON string_split(m.module, '-')[1] = f.word GROUP BY f.family")
def suspicious_family_join(spark, d):
    dim = spark.createDataFrame(_WORDS, "word string, family string")
    m = _modules(spark, d).withColumn("word", F.substring_index("module", "-", 1))
    return m.join(F.broadcast(dim), "word").groupBy("family").agg(F.count("*").alias("imports"), F.count_distinct("file_id").alias("files"))


_RULES = values([(r, c) for c, rs in dims.RISK_CLASS.items() for r in rs], "rule, class_id")
_CLASS = values([(c[0], c[1], c[2]) for c in dims.CLASSES], "class_id, class_name, tier")


@query(
    f"""SELECT coalesce(r.class_id, 'N7') AS class_id, c.class_name, c.tier, count(*) AS findings, count(DISTINCT s.npm_name) AS packages
    FROM scan_findings s LEFT JOIN {_RULES} r ON s.rule = r.rule JOIN {_CLASS} c ON c.class_id = coalesce(r.class_id, 'N7') GROUP BY ALL"""
)
def rule_enrichment(spark, d):
    e = package_scan.enriched(table(spark, d, "scan_findings"))
    return e.groupBy("class_id", "class_name", "tier").agg(F.count("*").alias("findings"), F.count_distinct("npm_name").alias("packages"))


@query(
    """SELECT score, CASE WHEN score >= 4 THEN 2 ELSE 1 END AS confidence, count(*) AS findings FROM (SELECT least(6,
      CAST(coalesce(trim(file) <> '', false) AS INT) + CAST(line_start IS NOT NULL OR line_end IS NOT NULL AS INT) + CAST(coalesce(len(match_lines) > 0, false) AS INT) + CAST(coalesce(trim(matched_text) <> '', false) AS INT)
      + CAST(coalesce(trim(code_snippet) <> '', false) AS INT) + CAST(coalesce(trim(message) <> '', false) AS INT) + CAST(coalesce(trim(rule) <> '', false) AS INT)) AS score FROM scan_findings) GROUP BY ALL"""
)
def evidence_scores(spark, d):
    f = package_scan.labelled(table(spark, d, "scan_findings"))
    return f.groupBy(F.col("evidence_score").alias("score"), "confidence").agg(F.count("*").alias("findings"))


@query(r"""SELECT lang AS given, CASE WHEN regexp_matches(lower(file_path), '\.tsx?$') THEN 'ts' WHEN regexp_matches(lower(file_path), '\.(js|mjs|cjs|jsx)$') THEN 'js' ELSE 'other' END AS found, count(*) AS files FROM source_files GROUP BY ALL""")
def language_classes(spark, d):
    return table(spark, d, "source_files").groupBy(F.col("lang").alias("given"), language_class(F.col("file_path")).alias("found")).agg(F.count("*").alias("files"))


@query(
    r"""SELECT file_id FROM source_files WHERE NOT list_has_any(string_split(file_path, '/')[1:-2], ['node_modules', 'lib', 'credentials']) AND regexp_extract(lower(file_path), '(\.[a-z0-9]+)$', 1) IN ('.js', '.ts', '.json')"""
)
def source_tree_filter(spark, d):
    return package_scan.source_tree(table(spark, d, "source_files"), "file_path", ["node_modules", "lib", "credentials"], [".js", ".ts", ".json"]).select("file_id")


def _matches(column, rxs):
    return "(" + " OR ".join(f"regexp_matches({column}, {text(rx)})" for rx in rxs) + ")"


_SERVER = f"""WITH p0 AS (SELECT *, string_split(replace(lower(file), '\\', '/'), '/') AS ps FROM server_files WHERE code IS NOT NULL),
    f AS (SELECT server_name, file, code FROM p0 WHERE NOT list_has_any(ps[1:-2], {_LIST(server_scan.VENDOR_DIRS)}) AND NOT regexp_matches(ps[-1], 'test|spec|fixture|example|sample|demo')
      AND (regexp_extract(ps[-1], '(\\.[a-z0-9]+)$', 1) IN ({", ".join(map(text, server_scan.EXTENSIONS))}) OR ps[-1] IN ({", ".join(text(m.lower()) for m in server_scan.MANIFESTS)}))),
    r AS {values([x for x in server_scan.SERVER_RULES], "rule, family, rx")},
    a AS (SELECT server_name, file, code, rule, family, regexp_extract_all(code, rx) AS m, string_split_regex(code, rx) AS p FROM f, r WHERE regexp_matches(code, rx)),
    b AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM a),
    c AS (SELECT server_name AS server, file, rule, family, m[i] AS match, string_split(code, chr(10)) AS ls, code,
      CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos FROM b),
    l AS (SELECT *, length(left(code, pos)) - length(replace(left(code, pos), chr(10), '')) + 1 AS line FROM c),
    n AS (SELECT server, file, rule, family, match, pos, line, array_to_string(ls[greatest(1, line - 6):line + 6], chr(10)) AS near, array_to_string(ls[greatest(1, line - 8):line + 8], chr(10)) AS wide,
      array_to_string(ls[greatest(1, line - 2):line + 2], chr(10)) AS context FROM l WHERE NOT regexp_matches(ls[line], '^\\s*(//|#|\\*|/\\*)')),
    k AS (SELECT * FROM n WHERE CASE rule WHEN 'path_traversal' THEN {_matches("near", [server_scan.FILE_OPERATION])} AND {_matches("near", [server_scan.USER_PATH])} WHEN 'secret_env_source' THEN {_matches("near", server_scan.SINKS)} ELSE true END),
    u AS (SELECT *, row_number() OVER (PARTITION BY server, file, rule, line ORDER BY pos, match, context) AS rn FROM k),
    g AS (SELECT *, {_matches("near", server_scan.GUARDS)} AS guarded, {_matches("wide", server_scan.SOURCES)} AND {_matches("wide", server_scan.SINKS)} AS source_sink_chain FROM u WHERE rn = 1),
    z AS (SELECT server, file, rule, family, CAST(line AS INT) AS line, left(match, 120) AS match, guarded, source_sink_chain, CASE WHEN source_sink_chain AND NOT guarded THEN 'strong' ELSE 'weak' END AS chain_confidence,
      CASE WHEN guarded THEN 'low' WHEN family IN ({", ".join(map(text, server_scan.HIGH_FAMILIES))}) THEN 'high' ELSE 'medium' END AS severity,
      array_to_string(list_filter([CASE WHEN regexp_matches(lower(near), 'docker|container') THEN 'container' END, CASE WHEN regexp_matches(lower(near), 'linux|systemd') THEN 'linux' END,
        CASE WHEN regexp_matches(lower(near), 'darwin|launchctl') THEN 'macos' END, CASE WHEN regexp_matches(lower(near), 'powershell|win32') THEN 'windows' END], lambda x: x IS NOT NULL), '|') AS platform_hints, left(context, 2000) AS context FROM g)"""


@query(f"{_SERVER} SELECT * FROM z")
def server_findings(spark, d):
    files = table(spark, d, "server_files").where(server_scan.scannable(F.col("file")))
    return server_scan.scan_servers(files)


_EXPECTED = values([("rule", r) for r, _, _ in server_scan.SERVER_RULES] + [("family", f) for f in sorted({f for _, f, _ in server_scan.SERVER_RULES})] + [("confidence", "strong"), ("confidence", "weak")], "kind, key")


@query(
    f"""{_SERVER}, s AS (SELECT server, 'rule' AS kind, rule AS key FROM z UNION ALL SELECT server, 'family', family FROM z UNION ALL SELECT server, 'confidence', chain_confidence FROM z)
    SELECT e.kind, e.key, count(s.key) AS findings, count(DISTINCT s.server) AS servers FROM {_EXPECTED} e LEFT JOIN s ON s.kind = e.kind AND s.key = e.key GROUP BY e.kind, e.key"""
)
def server_totals(spark, d):
    return server_scan.scan_totals(server_findings(spark, d))


@query(
    f"""{_SERVER}, o AS (SELECT *, row_number() OVER (PARTITION BY server, family ORDER BY file, line, rule) AS n FROM z)
    SELECT server, family, count(*) AS n, string_agg(file || ':' || line, '|' ORDER BY o.n) FILTER (WHERE o.n <= 20) AS examples FROM o GROUP BY server, family"""
)
def server_families(spark, d):
    return server_scan.findings_by_family(server_findings(spark, d))


def _any(rxs):
    return " OR ".join(f"regexp_matches(code, {text(rx)})" for rx in rxs)


@query("SELECT server_name AS server, " + ", ".join(f"count(*) FILTER (WHERE {_any(rx)}) AS {k}" for k, rx in server_scan.CAPABILITIES.items()) + " FROM server_files GROUP BY server_name")
def capability_surface(spark, d):
    return server_scan.capabilities(table(spark, d, "server_files"))


_VENDOR = _LIST(server_scan.VENDOR_DIRS)


@query(
    f"""WITH p AS (SELECT file_id, string_split(replace(lower(file), '\\', '/'), '/') AS ps FROM server_files), n AS (SELECT file_id, ps, ps[-1] AS name FROM p)
    SELECT file_id FROM n WHERE NOT list_has_any(ps[1:-2], {_VENDOR}) AND NOT regexp_matches(name, 'test|spec|fixture|example|sample|demo')
    AND (regexp_extract(name, '(\\.[a-z0-9]+)$', 1) IN ({", ".join(map(text, server_scan.EXTENSIONS))}) OR name IN ({", ".join(text(m.lower()) for m in server_scan.MANIFESTS)}))"""
)
def server_scannable(spark, d):
    return table(spark, d, "server_files").where(server_scan.scannable(F.col("file"))).select("file_id")


_NAMED = {m: "bool_or(list_last(string_split(replace(file, chr(92), '/'), '/')) = " + text(m) + ") AS " + m.replace(".", "_") for m in ("package.json", "requirements.txt", "pyproject.toml", "go.mod", "Cargo.toml")}


@query(f"SELECT server_name AS server, {', '.join(_NAMED.values())} FROM server_files GROUP BY server_name")
def server_manifests(spark, d):
    return server_scan.manifests(table(spark, d, "server_files"))
