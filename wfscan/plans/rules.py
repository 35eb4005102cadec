"""The package rules against SQL: the same rules written once more, for another matcher, and planted cases for each of them.

The SQL below shares no list and no pattern with the operator. Comments are cut out by a lexer that is one regular expression; what a
rule asks about the surroundings of a hit is asked in SQL.
"""

from __future__ import annotations

from wfscan.operators import package_scan
from wfscan.plans.registry import query, text, values
from wfscan.session import table

# One token of a script: a comment, a string, a template with its expressions, or an open comment, which runs to the end.
_EXPR = r"""'(?:\\(?s:.)|[^'\\])*(?:'|\\?\z)|"(?:\\(?s:.)|[^"\\])*(?:"|\\?\z)|`(?:\\(?s:.)|[^`\\])*(?:`|\\?\z)|//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|[^}]"""
_LEXER = r"""//[^\n]*|/\*(?s:.*?)\*/|/\*(?s:.*)|'(?:\\(?s:.)|[^'\\])*(?:'|\\?\z)|"(?:\\(?s:.)|[^"\\])*(?:"|\\?\z)|`(?:\\(?s:.)|\$\{(?:""" + _EXPR + r""")*(?:\}|\z)|[^`\\])*(?:`|\\?\z)"""
_UI_KEYS = r"(?:placeholder|default|example|examples|hint|help|tooltip|sample|description|displayName)"
_SURFACE = r"(?i)\b(?:openai|@openai/|anthropic|@anthropic-ai/|ollama|@langchain|langchain|ChatOpenAI|ChatAnthropic|AzureOpenAI|GoogleGenerativeAI|GenerativeModel|createChatCompletion|chat\.completions|\.messages\.|client\.chat|bedrock|cohere|mistral|together\.ai|replicate|huggingface|@google/generative-ai|google\.generativeai|VertexAI|ai\.google)\b"
_CLEANERS = r"(?i)sanitizeHtml\(|DOMPurify|xss\(|sanitize\(|filterXSS"
_WEAK = r"""(?i)(toString\(\s*['"]base64['"]\s*\)|Buffer\.from\s*\([^)]*,\s*['"]base64['"]\s*\)|data:\w+\/[\w.+-]+;base64,)"""
# (no, rule, pattern, what the file must hold, what it must not hold); fixed values.
_RULES = [
    (1, "PROCESS_ENV", r"\bprocess\.env\b", None, None),
    (2, "FS_CHILD_IMPORT", r"""(?m)^\s*import\s+.*from\s+['"]fs['"]|require\(\s*['"]fs['"]\s*\)|require\(\s*['"]child_process['"]\s*\)""", None, None),
    (3, "RAW_NET", r"""(?im)import\s+[^'";]*\s+from\s+['"](?:node:)?(?:http|https|net)['"]|require\(\s*['"](?:node:)?(?:http|https|net)['"]\s*\)""", None, None),
    (4, "HTTP_PROTO", r"(?i)http://", None, None),
    (5, "SSRF_HOST", r"(?i)localhost|127\.0\.0\.1|0\.0\.0\.0|169\.254\.\d+\.\d+|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[0-1])\.\d+\.\d+", None, None),
    (6, "EVAL_DYNAMIC", r"\beval\s*\(", None, None),
    (7, "EVAL_DYNAMIC", r"\bnew\s+Function\s*\(", None, None),
    (8, "EVAL_DYNAMIC", r"""(?i)\bset(?:Timeout|Interval)\s*\(\s*['"]""", None, None),
    (9, "COMMAND_EXEC", r"(?i)\bchild_process\.(?:exec|execSync|spawn|spawnSync|execFile|execFileSync|fork)\s*\(", None, None),
    (10, "VM_DYNAMIC", r"(?i)\bvm\.(?:runInNewContext|runInThisContext|Script)\b", None, None),
    (11, "DYNAMIC_REQUIRE", r"(?i)require\s*\(\s*[A-Za-z_$][\w$]*\s*\)", None, None),
    (12, "DYNAMIC_REQUIRE", r"""(?i)require\s*\(\s*[^)"']*\+[^)]+\)""", None, None),
    (13, "DYNAMIC_IMPORT", r"(?i)\bimport\(\s*[^)]+?\s*\)", None, None),
    (14, "EXT_HTTP_CALL", r"(?i)\b(?:fetch|axios|request|got|superagent)\s*\(|\bhttps?\.request\s*\(", None, None),
    (15, "DYNAMIC_REGEX", r"(?i)\bnew\s+RegExp\s*\(", None, None),
    (16, "DESERIALIZE", r"(?i)\byaml\.load\b", None, None),
    (17, "DATAURL_JSON", r"toDataURL\s*\(", r"\.json\s*:\s*\{[^}]*data", None),
    (18, "BINARY_PREPARE", r"\bbinary\s*:\s*\{", None, "prepareBinaryData"),
    (19, "CRED_DECL", r"""credentials\s*:\s*\[\s*\{[^}]*name\s*:\s*['"][^'"]+['"]""", None, None),
    (20, "I18N_NON_EN", rf"""(?i)\b{_UI_KEYS}\s*:\s*(?:'(?:[^'\\]|\\(?s:.))*'|"(?:[^"\\]|\\(?s:.))*")""", None, None),
    (21, "I18N_NON_EN", rf"(?i)\b{_UI_KEYS}\s*:\s*`[^`]*`", None, None),
    (22, "BROWSER_STEALTH", r"""puppeteer\.use\s*\(\s*require\(\s*['"]puppeteer-extra-plugin-stealth['"]\s*\)\s*\(\s*\)\s*\)""", None, None),
    (23, "LOG_SENSITIVE", r"(?i)\b(?:console\.(?:log|error|warn)|this\.logger\.(?:info|debug|warn|error)|logger\.(?:info|debug|warn|error))\s*\(", None, None),
    (24, "BINARY_PREPARE_WEAK", _WEAK, r"(?i)\bbinary(?:PropertyName)?\b", None),
    (25, "DELETE_RET_BOOL", r"""(?i)return\s+\[\s*\{\s*['"]deleted['"]\s*:\s*(?:true|false)\s*\}\s*\]""", r"""(?i)\b(?:operation|resource|method)\s*:\s*['"](?:delete|remove|destroy)["']""", None),
    (26, "INPUT_SECRET_UNMASKED", r"""(?i)\b(?:name|displayName)\s*:\s*['"]\s*(?:api[_-]?key|apikey|api key|token|access[_-]?token|bearer|password|pass|secret|client[_-]?secret|private[_-]?key|auth|authorization|cookie)\s*['"]""", None, None),
    (27, "HTML_UNSANITIZED", r"(?i)\.innerHTML\s*=", None, _CLEANERS),
    (28, "HTML_UNSANITIZED", r"(?i)dangerouslySetInnerHTML", None, _CLEANERS),
    (29, "HTML_UNSANITIZED", r"(?i)\bres\.send\s*\(", None, _CLEANERS),
    (30, "HTML_UNSANITIZED", r"(?i)\bres\.render\s*\(", None, _CLEANERS),
    (31, "HTML_UNSANITIZED", r"""(?i)\breturn\s+[`'"]\s*<""", None, _CLEANERS),
    (32, "HTML_UNSANITIZED", r"(?i)\bdocument\.write\s*\(", None, _CLEANERS),
    (33, "EXFIL_SDK_CALL", r"(?i)\b(?:Sentry\.capture|mixpanel\.(?:track|people)|analytics\.)", None, None),
    (34, "REMOTE_SHELL_CALL", r"""(?i)\b(?:node-pty|pty\.js|ssh2|spawn\(\s*['"]sh|spawn\(\s*['"]bash)""", None, None),
    (35, "PROMPT_INJECTION_CANDIDATE", r"""getNodeParameter\s*\(\s*['"][^'"]+['"]""", _SURFACE, None),
]


def rules_sql(source: str) -> str:
    """Hits of all rules over rows (id, file, code) as SQL: id, no, rule, pos (0-based), match, code, masked, window."""
    return f"""WITH s AS ({source}),
    x AS (SELECT id, file, code, regexp_matches(lower(coalesce(file, 'x.js')), '\\.(js|ts|mjs|cjs|jsx|tsx)$') AS script, regexp_extract_all(code, {text(_LEXER)}) AS tk, string_split_regex(code, {text(_LEXER)}) AS gp FROM s WHERE code <> ''),
    c AS (SELECT id, code, CASE WHEN script THEN array_to_string(list_transform(range(1, len(gp) + 1), lambda i: gp[i] || coalesce(CASE WHEN starts_with(tk[i], '//') OR starts_with(tk[i], '/*') AND ends_with(tk[i], '*/') AND length(tk[i]) >= 4
      THEN repeat(chr(1), length(tk[i])) ELSE tk[i] END, '')), '') ELSE code END AS masked FROM x),
    r AS {values(_RULES, "no, rule, rx, requires, forbids")},
    a AS (SELECT id, code, masked, no, rule, regexp_extract_all(code, rx) AS m, string_split_regex(code, rx) AS p FROM c, r
      WHERE regexp_matches(code, rx) AND (requires IS NULL OR regexp_matches(code, requires)) AND (forbids IS NULL OR NOT regexp_matches(code, forbids)) AND (no <> 35 OR regexp_matches(masked, requires))),
    b AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM a),
    h AS (SELECT id, code, masked, no, rule, m[i] AS match, CAST(list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS pos FROM b),
    k AS (SELECT *, min(pos) OVER (PARTITION BY id, no) AS first_pos, first_value(match) OVER (PARTITION BY id, no ORDER BY pos) AS first_match, substr(code, pos + 1, 2000) AS w FROM h),
    l AS (SELECT *, regexp_extract_all(w, '[{{}}]') AS braces, string_split_regex(w, '[{{}}]') AS bits, substr(masked, pos + 1, 1) <> chr(1) AS live FROM k),
    e AS (SELECT *, list_filter(range(1, len(braces) + 1), lambda j: braces[j] = '}}' AND 2 * len(list_filter(braces[1:j], lambda q: q = '{{')) <= j AND (j > 1 OR length(bits[1]) > 0))[1] AS j FROM l),
    g AS (SELECT *, CASE WHEN j IS NULL THEN substr(w, 1, 800) ELSE substr(w, 1, j + CAST(list_sum(list_transform(bits[1:j], lambda y: length(y))) AS BIGINT)) END AS block,
      regexp_extract(substr(code, greatest(pos - 300, 0) + 1, least(pos, 300)), '(["''])[^"'']*$', 1) AS quoted, substr(code, greatest(pos - 300, 0) + 1, least(pos, 300) + 300) AS around, lower(trim(regexp_extract(match, '[''"]([^''"]+)', 1))) AS key FROM e),
    o AS (SELECT * FROM g WHERE (live OR no IN (22, 33, 34)) AND CASE
      WHEN no = 2 THEN NOT regexp_matches(match, '^\\s*import\\stype\\b')
      WHEN no IN (4, 5) THEN NOT (regexp_matches(around, '(?i)\\b{_UI_KEYS}\\s*:\\s*[''"`]') AND quoted <> '' AND contains(substr(code, pos + 1, 300), quoted))
      WHEN no IN (20, 21) THEN regexp_matches(match, '[^\\x00-\\x7F]')
      WHEN no IN (22, 33, 34) THEN pos = first_pos
      WHEN no = 23 THEN regexp_matches(substr(code, pos + 1, length(match) + 300), '(?i)cookie|authorization|bearer|token|api[_-]?key|secret|client[_-]?secret|private[_-]?key|passwd|password')
      WHEN no = 26 THEN NOT regexp_matches(block, '(?is)typeOptions\\s*:\\s*\\{{[^}}]*\\bpassword\\s*:\\s*true\\b[^}}]*\\}}|inputType\\s*:\\s*[''"]password[''"]|ui\\s*:\\s*\\{{[^}}]*\\bpassword\\b')
      WHEN no = 35 THEN NOT list_contains(['operation', 'resource', 'model', 'models', 'version', 'url', 'endpoint', 'authentication'], key) AND regexp_matches(key, 'prompt|message|system|instruction|chat|query|completion|user|assistant|input|context|text')
      ELSE true END),
    z AS (SELECT id, no, rule, first_value(pos) OVER (PARTITION BY id, no ORDER BY pos) AS live_pos, pos AS own_pos, CASE WHEN no = 24 THEN first_pos ELSE pos END AS pos, CASE WHEN no = 24 THEN first_match ELSE match END AS match, block, code FROM o),
    f AS (SELECT id, no, rule, pos, code, CASE WHEN no = 23 THEN length(match) + 300 WHEN no = 26 THEN length(block) ELSE length(match) END + pos AS fin,
      CASE WHEN no = 20 THEN regexp_extract(match, '(?s)^[A-Za-z]+\\s*:\\s*[''"](.*)[''"]$', 1) WHEN no = 21 THEN regexp_extract(match, '(?s)`(.*)`$', 1) WHEN no = 23 THEN substr(code, pos + 1, length(match) + 300)
        WHEN no = 26 THEN regexp_extract(match, ':\\s*[''"]\\s*(.*?)\\s*[''"]$', 1) WHEN no = 35 THEN regexp_extract(match, '[''"]([^''"]+)', 1) ELSE match END AS shown FROM z WHERE no NOT IN (24, 25) OR own_pos = live_pos),
    n AS (SELECT id, no, rule, pos, shown, length(left(code, pos)) - length(replace(left(code, pos), chr(10), '')) + 1 AS la, length(left(code, fin)) - length(replace(left(code, fin), chr(10), '')) + 1 AS lz, string_split(code, chr(10)) AS ls FROM f)"""


_FINDINGS = "SELECT id AS {0}, rule, CAST(pos AS INT) AS pos, shown AS matched_text, CAST(la AS INT) AS first_line, CAST(lz AS INT) AS last_line, CAST(greatest(1, la - 3) AS INT) AS line_start, CAST(least(len(ls), lz + 3) AS INT) AS line_end, md5(array_to_string(ls[greatest(1, la - 3):lz + 3], chr(10))) AS snippet FROM n"


def _shown(hits, key):
    from pyspark.sql import functions as F

    return hits.select(key, "rule", "pos", "matched_text", F.get("match_lines", F.lit(0)).alias("first_line"), F.get("match_lines", F.lit(1)).alias("last_line"), "line_start", "line_end", F.md5("code_snippet").alias("snippet"))


@query(rules_sql("SELECT file_id AS id, file_path AS file, code FROM source_files") + _FINDINGS.format("file_id"))
def package_rule_hits(spark, d):
    """Every hit of every package rule in every source file, before repeats are removed."""
    from pyspark.sql import functions as F

    return _shown(package_scan.find_hits(table(spark, d, "source_files").select("file_id", F.col("file_path").alias("file"), "code")), "file_id")


# What a finding says, by the rule's number, and what each rule belongs to; fixed values.
_CLEAN_WITH = "HTML rendered with no sanitizer (need one of: sanitizeHtml(, DOMPurify, xss(, sanitize(, filterXSS, dompurify)"
_SAID = [
    (1, "error", "process.env usage"), (2, "error", "fs/child_process import"), (3, "error", "Raw http/https/net import"), (4, "error", "http:// detected"), (5, "error", "localhost/127.0.0.1/private range detected"), (6, "error", "eval() detected"), (7, "error", "new Function() detected"),
    (8, "error", "setTimeout/Interval with string code"), (9, "error", "child_process.* command execution"), (10, "error", "vm.* dynamic code execution"), (11, "warn", "require(var) dynamic module load"), (12, "warn", "require(a+b) dynamic module load"), (13, "warn", "import(expr) dynamic module load"),
    (14, "error", "External HTTP call function detected"), (15, "warn", "new RegExp(...) from variable input"), (16, "warn", "yaml.load (use safeLoad/safeLoadAll)"), (17, "warn", "DataURL returned in JSON"), (18, "error", "Binary output w/o prepareBinaryData"), (19, "info", "Credential declared: "),
    (20, "error", "Non-English chars found in UI text (quoted)"), (21, "error", "Non-English chars found in UI text (template)"), (22, "error", "Puppeteer stealth plugin enabled"), (23, "error", "Sensitive data printed in logs"), (24, "warn", "Manual base64/dataURL for binary; prefer prepareBinaryData()"),
    (25, "warn", "Delete returns [{deleted:true}] — return structured summary instead"), (26, "error", "Sensitive input without masking: add typeOptions:{password:true} or use Credentials."), *((n, "error", _CLEAN_WITH) for n in range(27, 33)), (33, "warn", "Telemetry/exfil-like call"), (34, "error", "Potential remote shell execution"),
    (35, "warn", "LLM/chat API with getNodeParameter for prompt-like key (static N9: user-controlled text may reach the model)."),
]
_BELONGS = [
    ("COMMAND_EXEC", "CODE_EXEC", "N1", "Sv"), ("VM_DYNAMIC", "CODE_EXEC", "N1", "Sv"), ("EVAL_DYNAMIC", "CODE_EXEC", "N1", "Sv"), ("DYNAMIC_REQUIRE", "CODE_EXEC", "N1", "Sv"), ("DYNAMIC_IMPORT", "CODE_EXEC", "N1", "Sv"), ("DYNAMIC_REGEX", "CODE_EXEC", "N1", "Sv"), ("DESERIALIZE", "CODE_EXEC", "N1", "Sv"),
    ("REMOTE_SHELL_CALL", "NET_RISK", "N1", "Sv"), ("EXT_HTTP_CALL", "NET_RISK", "N2", "Sv"), ("RAW_NET", "NET_RISK", "N2", "Sv"), ("HTTP_PROTO", "NET_RISK", "N2", "Sv"), ("EXFIL_SDK_CALL", "NET_RISK", "N2", "Sv"), ("BROWSER_STEALTH", "SUSPICIOUS_IMPORT", "N2", "Sv"), ("FS_CHILD_IMPORT", "DATA_PRIVACY", "N3", "Md"),
    ("SSRF_HOST", "NET_RISK", "N4", "Md"), ("PROCESS_ENV", "DATA_PRIVACY", "N5", "Sv"), ("LOG_SENSITIVE", "DATA_PRIVACY", "N5", "Sv"), ("DATAURL_JSON", "DATA_PRIVACY", "N5", "Sv"), ("BINARY_PREPARE", "DATA_PRIVACY", "N5", "Sv"), ("BINARY_PREPARE_WEAK", "DATA_PRIVACY", "N5", "Sv"), ("CRED_DECL", "DATA_PRIVACY", "N5", "Sv"),
    ("INPUT_SECRET_UNMASKED", "DATA_PRIVACY", "N5", "Sv"), ("DELETE_RET_BOOL", "DATA_PRIVACY", "N7", "Md"), ("I18N_NON_EN", "CONFIG", "N7", "Md"), ("HTML_UNSANITIZED", "HTML_XSS", "N8", "Md"), ("PROMPT_INJECTION_CANDIDATE", "PROMPT_INJECTION", "N9", "Md"),
]


@query(
    rules_sql("SELECT file_id AS id, file_path AS file, code FROM source_files")
    + f""", m AS (SELECT n.id, n.rule, pos, la, lz, shown, greatest(1, la - 3) AS line_start, least(len(ls), lz + 3) AS line_end, array_to_string(ls[greatest(1, la - 3):lz + 3], chr(10)) AS snippet, severity,
      message || CASE WHEN n.no = 19 THEN regexp_extract(shown, 'name\\s*:\\s*[''"]([^''"]+)[''"]$', 1) ELSE '' END AS message FROM n JOIN {values(_SAID, 'no, severity, message')} w ON w.no = n.no),
    q AS (SELECT m.*, npm_name, file_path, row_number() OVER (PARTITION BY m.rule, file_path, message, npm_name, line_start, line_end, la, lz ORDER BY id, pos) AS one FROM m JOIN source_files f ON f.file_id = m.id),
    y AS (SELECT q.*, rule_category, class_id, tier, least(6, CAST(coalesce(trim(file_path) <> '', false) AS INT) + 2 + CAST(trim(shown, ' ') <> '' AS INT) + CAST(trim(snippet, ' ') <> '' AS INT) + 2) AS score FROM q JOIN {values(_BELONGS, 'rule, rule_category, class_id, tier')} b ON b.rule = q.rule WHERE one = 1)
    SELECT id AS file_id, npm_name, file_path AS file, rule, severity, rule_category, class_id, tier, CAST(line_start AS INT) AS line_start, CAST(line_end AS INT) AS line_end, shown AS matched_text, score AS evidence_score, CASE WHEN score >= 4 THEN 2 ELSE 1 END AS confidence,
      rule || '; ' || severity || '; evidence=' || score || '; confidence=' || CASE WHEN score >= 4 THEN 2 ELSE 1 END AS label FROM y"""
)
def package_findings(spark, d):
    """All package rules with comment filter, lines and snippets, repeats removed and enriched."""
    from pyspark.sql import functions as F

    f = package_scan.find_hits(table(spark, d, "source_files").select("file_id", "npm_name", F.col("file_path").alias("file"), "code"))
    e = package_scan.enriched(package_scan.distinct_findings(f, ["file_id", "pos"]))
    return package_scan.labelled(e).select("file_id", "npm_name", "file", "rule", "severity", "rule_category", "class_id", "tier", "line_start", "line_end", "matched_text", "evidence_score", "confidence", "label")


# Imports outside of comments, and what their modules are known for; fixed values.
_IMPORTS = [(1, r"""import\s+(?:[^'";]*?\s+from\s+)?['"][^'"]+['"]"""), (2, r"""require\(\s*['"][^'"]+['"]\s*\)"""), (3, r"""\bimport\(\s*['"][^'"]+['"]\s*\)""")]
_NET_PREFIXES = ["http", "https", "ws", "socket", "net", "tls"]
_NET_WORDS = ["http", "https", "fetch", "request", "undici", "ws", "websocket", "socket", "net", "tls", "redis", "mysql", "pg", "postgres", "mongo", "mongodb", "mssql", "ftp", "sftp", "smtp", "imap", "pop3", "s3", "oss", "minio", "grpc", "mqtt", "kafka"]
_TOOLS = r"^(@types/|@?eslint|@?prettier|ts-node|typescript|tslib|@?babel|rollup|webpack|vite|esbuild|@?swc|jest|mocha|vitest)"
_FAMILY = [
    *((m, "stealth", "EXT_SUS_IMPORT", "error") for m in ("puppeteer-extra-plugin-stealth", "puppeteer-extra", "@extra/stealth")),
    *((m, "captcha", "EXT_SUS_IMPORT", "error") for m in ("2captcha", "node-2captcha", "anticaptcha", "anti-captcha", "capsolver", "hcaptcha-solver", "deathbycaptcha")),
    *((m, "tunnel_proxy", "PROXY_TUNNEL", "warn") for m in ("proxy-chain", "socks-proxy-agent", "https-proxy-agent", "http-proxy-agent", "tunnel", "tunnel-agent", "ngrok", "localtunnel", "node-tor", "tor-request")),
    *((m, "remote_shell", "REMOTE_SHELL_CALL", "error") for m in ("node-pty", "pty.js", "ssh2", "shelljs", "ws-shell", "wetty")),
    *((m, "exfil_sdk", "EXFIL_SDK_CALL", "warn") for m in ("@sentry/node", "sentry", "mixpanel", "analytics-node", "@segment/analytics-node", "amplitude", "rollbar", "bugsnag")),
]


@query(
    rules_sql("SELECT file_id AS id, file_path AS file, code FROM source_files").split(",\n    r AS ")[0]
    + f""", ia AS (SELECT id, masked, regexp_extract_all(code, rx) AS m, string_split_regex(code, rx) AS p FROM c, {values(_IMPORTS, 'no, rx')} WHERE regexp_matches(code, rx)),
    ib AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ia),
    ic AS (SELECT id, regexp_extract(m[i], '[''"]([^''"]+)[''"]', 1) AS spec, substr(masked, CAST(list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS BIGINT) + 1, 1) <> chr(1) AS live FROM ib),
    id_ AS (SELECT id, regexp_extract(regexp_replace(trim(spec), '^node:', ''), '^[^?#]*', 0) AS t FROM ic WHERE live), ie AS (SELECT id, CASE WHEN t LIKE '@%' THEN array_to_string(string_split(t, '/')[1:2], '/') ELSE string_split(t, '/')[1] END AS module FROM id_),
    ig AS (SELECT id, module, coalesce('name_prefix:' || list_filter({_NET_PREFIXES}, lambda y: starts_with(lower(module), y))[1], 'name_keyword:' || list_filter({_NET_WORDS}, lambda y: contains(lower(module), y))[1]) AS reason FROM ie WHERE module <> ''),
    ih AS (SELECT id, module, 'EXT_HTTP_IMPORT' AS rule, 'error' AS severity, reason FROM ig WHERE reason IS NOT NULL AND NOT regexp_matches(lower(module), '{_TOOLS}') AND NOT starts_with(module, '.')
      UNION ALL SELECT id, ig.module, k.rule, k.severity, 'family:' || family FROM ig JOIN {values(_FAMILY, 'module, family, rule, severity')} k ON k.module = ig.module)
    SELECT file_id, npm_name, file_path AS file, module, rule, severity, reason FROM ih JOIN source_files f ON f.file_id = ih.id"""
)
def import_findings(spark, d):
    from pyspark.sql import functions as F

    f = table(spark, d, "source_files").select("file_id", "npm_name", F.col("file_path").alias("file"), "code")
    return package_scan.import_findings(f).select("file_id", "npm_name", "file", "module", "rule", "severity", "reason")


# Planted cases: rule, number of its hits, file name, text. What must be found and what must not, for every rule; lines by line feeds.
CASES = [
    ("PROCESS_ENV", 2, "a.js", "const a = process.env.HOME;\nconst b = process.env['X'];"), ("PROCESS_ENV", 0, "a.js", "// process.env.HOME\n/* process.env */ const processXenv = 1;"), ("PROCESS_ENV", 1, "a.json", "// process.env in what isn't a script"),
    ("FS_CHILD_IMPORT", 3, "a.ts", "import { a } from 'fs';\nconst f = require( \"fs\" );\nrequire('child_process')"), ("FS_CHILD_IMPORT", 0, "a.ts", "import type { Stats } from 'fs';\nimport x from 'fs/promises';\n// require('fs')"),
    ("RAW_NET", 3, "a.ts", "import http from 'http';\nimport * as n from \"node:net\";\nrequire('https')"), ("RAW_NET", 0, "a.ts", "import x from 'http2';\nimport y from 'net-tools'; // require('net')"),
    ("HTTP_PROTO", 2, "a.ts", "get('http://a.example'); get('HTTP://b.example')"), ("HTTP_PROTO", 0, "a.ts", "const p = { placeholder: 'see http://a.example' };"), ("HTTP_PROTO", 1, "a.ts", "placeholder: 'x'; " + "y" * 400 + " get('http://a.example')"), ("HTTP_PROTO", 0, "a.ts", "get('https://a.example') // http://b.example"),
    ("SSRF_HOST", 5, "a.ts", "f('localhost', '127.0.0.1', '10.1.2.3', '192.168.0.9', '172.31.0.1')"), ("SSRF_HOST", 0, "a.ts", "f('172.32.0.1', '8.8.8.8'); const o = { description: 'runs on localhost' };"),
    ("EVAL_DYNAMIC", 4, "a.ts", "eval(a); new Function ('b'); setTimeout('c', 1); setInterval( \"d\", 2);"), ("EVAL_DYNAMIC", 0, "a.ts", "evaluate(a); medieval(b); setTimeout(() => 1, 2); new Functions(); // eval(x)"),
    ("COMMAND_EXEC", 2, "a.ts", "child_process.exec('ls'); child_process.spawnSync ('x')"), ("COMMAND_EXEC", 0, "a.ts", "child_process.kill(1); my_child_process2.exec('ls')"),
    ("VM_DYNAMIC", 2, "a.ts", "vm.runInNewContext(c); new vm.Script(c)"), ("VM_DYNAMIC", 0, "a.ts", "vm.createContext(); vm.Scripts(); /* vm.Script */"),
    ("DYNAMIC_REQUIRE", 2, "a.ts", "require(name); require('./a/' + name) ; require(base + '/x')"), ("DYNAMIC_REQUIRE", 0, "a.ts", "require('name'); require(a.b)"),
    ("DYNAMIC_IMPORT", 2, "a.ts", "await import('x'); import( a + b )"), ("DYNAMIC_IMPORT", 0, "a.ts", "import x from 'y'; reimport(a); // import(z)"),
    ("EXT_HTTP_CALL", 4, "a.ts", "fetch(u); axios (u); got(u); https.request(o)"), ("EXT_HTTP_CALL", 0, "a.ts", "prefetch(u); forgot(u); axios.get(u); 'a' // fetch(u)"),
    ("DYNAMIC_REGEX", 1, "a.ts", "new RegExp(x)"), ("DYNAMIC_REGEX", 0, "a.ts", "RegExp(x); renew RegExpX(y)"),
    ("DESERIALIZE", 1, "a.ts", "yaml.load(x); yaml.loadAll(y)"), ("DESERIALIZE", 0, "a.ts", "yaml.safeLoad(x)"),
    ("DATAURL_JSON", 1, "a.ts", "const u = c.toDataURL();\nitem.json: { data: u }"), ("DATAURL_JSON", 0, "a.ts", "const u = c.toDataURL(); return { url: u }"),
    ("BINARY_PREPARE", 1, "a.ts", "return { binary: { a } }"), ("BINARY_PREPARE", 0, "a.ts", "return { binary: { a: await prepareBinaryData(b) } }"),
    ("CRED_DECL", 1, "a.ts", "credentials: [\n  { required: true, name: 'lanternApi' },\n]"), ("CRED_DECL", 0, "a.ts", "credentials: ['lanternApi'], name: 'x'"),
    ("I18N_NON_EN", 2, "a.ts", "displayName: 'Größe', hint: `多行\n文本`, description: 'plain'"), ("I18N_NON_EN", 1, "a.ts", "description: 'it\\'s größer', name: 'Größe'"), ("I18N_NON_EN", 0, "a.ts", "// hint: 'Größe'\ntitle: 'Größe', hint: 'size'"),
    ("BROWSER_STEALTH", 1, "a.ts", "puppeteer.use(require('puppeteer-extra-plugin-stealth')());\npuppeteer.use(require('puppeteer-extra-plugin-stealth')())"), ("BROWSER_STEALTH", 0, "a.ts", "const puppeteer = require('puppeteer'); // stealth\npuppeteer.use(other())"),
    ("LOG_SENSITIVE", 2, "a.ts", "console.log('token', t);\n" + "x;" * 200 + "\nthis.logger.info(api_key)"), ("LOG_SENSITIVE", 0, "a.ts", "console.log('done');" + " " * 301 + "const password = 1; console.table(password)"),
    ("BINARY_PREPARE_WEAK", 1, "a.ts", "const binary = b.toString('base64'); Buffer.from(x, 'base64')"), ("BINARY_PREPARE_WEAK", 0, "a.ts", "const text = b.toString('base64')"), ("BINARY_PREPARE_WEAK", 0, "a.ts", "const binary = 1; // b.toString('base64')"),
    ("DELETE_RET_BOOL", 1, "a.ts", "operation: 'delete'; return [{ 'deleted': true }]; return [{ 'deleted': false }]"), ("DELETE_RET_BOOL", 0, "a.ts", "operation: 'get'; return [{ 'deleted': true }]"),
    ("INPUT_SECRET_UNMASKED", 1, "a.ts", "{ name: 'apiKey', type: 'string' }"), ("INPUT_SECRET_UNMASKED", 0, "a.ts", "{ name: 'token', typeOptions: { password: true } }"), ("INPUT_SECRET_UNMASKED", 1, "a.ts", "{ name: 'token', type: 'string' },\n{ name: 'x', typeOptions: { password: true } }"), ("INPUT_SECRET_UNMASKED", 0, "a.ts", "{ name: 'tokenizer' }, { name: 'secret', inputType: 'password' }"),
    ("HTML_UNSANITIZED", 6, "a.ts", "a.innerHTML = b; <p dangerouslySetInnerHTML={c}/>; res.send(d); res.render(e); return '<b>'; document.write(f)"), ("HTML_UNSANITIZED", 0, "a.ts", "a.innerHTML = DOMPurify.sanitize(b)"), ("HTML_UNSANITIZED", 0, "a.ts", "a.textContent = b; return 'x<'"),
    ("EXFIL_SDK_CALL", 1, "a.ts", "// Sentry.captureException(e)\nmixpanel.track('x')"), ("EXFIL_SDK_CALL", 0, "a.ts", "sentry.init(); myanalytics.x()"),
    ("REMOTE_SHELL_CALL", 1, "a.ts", "const pty = require('node-pty'); spawn('bash')"), ("REMOTE_SHELL_CALL", 0, "a.ts", "spawn('ls'); const ssh = 2"),
    ("PROMPT_INJECTION_CANDIDATE", 2, "a.ts", "import { ChatOpenAI } from '@langchain/openai';\nthis.getNodeParameter('prompt', 0); this.getNodeParameter(\"userMessage\", 0); this.getNodeParameter('model', 0)"), ("PROMPT_INJECTION_CANDIDATE", 0, "a.ts", "// openai\nthis.getNodeParameter('prompt', 0)"), ("PROMPT_INJECTION_CANDIDATE", 0, "a.ts", "this.getNodeParameter('prompt', 0)"),
    ("PROCESS_ENV", 3, "a.ts", "const t = `a ${ /* process.env.A */ x } // process.env.B`; // process.env.C\n'it\\'s' /* process.env.D"),
]
# The hits that each case must have, written out: case number and hits, cases without a hit left out.
_EXPECTED = [(n, rule, hits) for n, (rule, hits, _, _) in enumerate(CASES) if hits]


@query(f"SELECT CAST(case_no AS INT) AS case_no, rule, CAST(hits AS BIGINT) AS hits FROM {values(_EXPECTED, 'case_no, rule, hits')}")
def package_rule_cases(spark, d):
    """How often each planted case is found by its rule."""
    from pyspark.sql import functions as F

    cases = spark.createDataFrame([(n, *c) for n, c in enumerate(CASES)], "case_no int, of string, hits int, file string, code string")
    found = package_scan.find_hits(cases.select("case_no", "of", "file", "code"))
    return found.where("rule = of").groupBy("case_no", "rule").agg(F.count("*").alias("hits"))


# Imports and package files, planted, with the findings that they must have written out.
_IMPORTING = [
    (1, "a.ts", "import f from 'node-fetch';\nimport { x } from \"@sentry/node/lib\";\nconst p = require('node:ngrok');"),
    (2, "a.ts", "// import axios from 'axios'\n/* require('ssh2') */\nimport './local-request'; import eslint from 'eslint-request';"),
    (3, "a.ts", "await import('puppeteer-extra'); require('shelljs'); require('2captcha'); require('lodash')"),
]
_IMPORTED = [
    (1, "node-fetch", "EXT_HTTP_IMPORT", "error"), (1, "@sentry/node", "EXFIL_SDK_CALL", "warn"), (1, "ngrok", "PROXY_TUNNEL", "warn"),
    (3, "puppeteer-extra", "EXT_SUS_IMPORT", "error"), (3, "shelljs", "REMOTE_SHELL_CALL", "error"), (3, "2captcha", "EXT_SUS_IMPORT", "error"),
]


@query(f"SELECT CAST(case_no AS INT) AS case_no, module, rule, severity FROM {values(_IMPORTED, 'case_no, module, rule, severity')}")
def package_import_cases(spark, d):
    return package_scan.import_findings(spark.createDataFrame(_IMPORTING, "case_no int, file string, code string")).select("case_no", "module", "rule", "severity")


_MANIFESTS = [
    ("p", '{"license": "MIT", "dependencies": {"ioredis": "^1", "lodash": "4"}, "devDependencies": {"undici": "1", "eslint-plugin-request": "2"}}'), ("q", '{"license": "Apache-2.0", "peerDependencies": {"ngrok": "5", "node-pty": "1"}, "optionalDependencies": {"capsolver": "1", "mixpanel": "2", "smtp-relay": "3"}}'),
    ("r", "{ not json"), ("t", '{"licenses": "The MIT License"}'), ("u", '{"name": "u"}'), ("v", '{"license": {"type": "x"}}'),
]
_DEPENDING = [
    ("p", "ioredis", "EXT_HTTP_DEP", "error"), ("p", "undici", "EXT_HTTP_DEP", "warn"), ("q", "ngrok", "PROXY_TUNNEL", "warn"), ("q", "node-pty", "REMOTE_SHELL_CALL", "error"), ("q", "capsolver", "EXT_SUS_DEP", "error"), ("q", "mixpanel", "EXFIL_SDK_CALL", "warn"),
    ("q", "smtp-relay", "EXT_HTTP_DEP", "error"), ("q", None, "LICENSE", "warn"), ("r", None, "PKG_JSON_INVALID", "error"), ("s", None, "PKG_JSON_MISSING", "warn"), ("u", None, "LICENSE", "warn"),
]


@query(f"SELECT npm_name, module, rule, severity FROM {values(_DEPENDING, 'npm_name, module, rule, severity')}")
def package_manifest_cases(spark, d):
    from pyspark.sql import functions as F

    manifests = spark.createDataFrame(_MANIFESTS, "npm_name string, code string")
    packages = spark.createDataFrame([(n,) for n in "pqrstuv"], "npm_name string")
    found = package_scan.dependency_findings(manifests).select("npm_name", "module", "rule", "severity")
    return found.unionByName(package_scan.manifest_findings(packages, manifests).withColumn("module", F.lit(None).cast("string")))


@query(
    f"""WITH x AS (SELECT file_id, regexp_extract_all(code, {text(_LEXER)}) AS tk, string_split_regex(code, {text(_LEXER)}) AS gp FROM source_files WHERE lang IN ('js', 'ts') AND code <> ''),
    y AS (SELECT file_id, tk[i] AS t, CAST(list_sum(list_transform(gp[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(tk[1:i - 1], lambda g: length(g))), 0) AS INT) AS span_start FROM (SELECT *, unnest(range(1, len(tk) + 1)) AS i FROM x))
    SELECT file_id, span_start, span_start + CAST(length(t) AS INT) AS span_end FROM y WHERE starts_with(t, '//') OR starts_with(t, '/*') AND ends_with(t, '*/') AND length(t) >= 4"""
)
def comment_spans(spark, d):
    """Spans of comments by the script lexer."""
    from pyspark.sql import functions as F

    from wfscan.operators.lexing import comment_spans_of

    f = table(spark, d, "source_files").where("lang in ('js', 'ts')")
    return f.select("file_id", F.explode(comment_spans_of(F.col("code"))).alias("c")).select("file_id", F.col("c.s").alias("span_start"), F.col("c.e").alias("span_end"))


@query("SELECT * FROM (VALUES ('dependencies', CAST(2 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT)), ('devDependencies', 2, 1, 1), ('peerDependencies', 2, 0, 0), ('optionalDependencies', 3, 1, 1)) AS t(dep_kind, dependencies, suspect, modules)")
def package_network_cases(spark, d):
    """Dependencies of the planted package files by kind: how many, how many reach the network, and how many modules those are."""
    from wfscan.operators import findings

    return findings.network_dependencies(package_scan.dependencies(spark.createDataFrame(_MANIFESTS, "npm_name string, code string")))


_REUSED = [(1, "id: 0A1b2c3d-1111-2222-3333-444455556666 and again 0a1b2c3d-1111-2222-3333-444455556666"), (2, "0a1b2c3d-1111-2222-3333-444455556666"), (3, "ffffffff-0000-1111-2222-333344445555 once"), (4, None), (5, "aaaaaaaa-0000-1111-2222-333344445555"), (6, "x-aaaaaaaa-0000-1111-2222-333344445555")]


@query("SELECT * FROM (VALUES ('0a1b2c3d-1111-2222-3333-444455556666', CAST(3 AS BIGINT), CAST(2 AS BIGINT)), ('aaaaaaaa-0000-1111-2222-333344445555', 2, 2)) AS t(uuid, uses, templates)")
def reused_identifier_cases(spark, d):
    """Planted identifiers that several templates share."""
    from wfscan.operators import workflow

    return workflow.reused_ids(spark.createDataFrame(_REUSED, "template int, body string"), "template", "body")
