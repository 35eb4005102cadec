"""Dimension tables: what the rules are called, grouped into and weighed by. All have a fixed number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Category of each rule.
CATEGORY = {
    "CODE_EXEC": ("COMMAND_EXEC", "VM_DYNAMIC", "EVAL_DYNAMIC", "DYNAMIC_REQUIRE", "DYNAMIC_IMPORT", "DYNAMIC_REGEX", "DESERIALIZE"),
    "NET_RISK": ("EXT_HTTP_CALL", "EXT_HTTP_IMPORT", "EXT_HTTP_DEP", "RAW_NET", "HTTP_PROTO", "SSRF_HOST", "PROXY_TUNNEL", "EXFIL_SDK_CALL", "REMOTE_SHELL_CALL"),
    "SUSPICIOUS_IMPORT": ("EXT_SUS_DEP", "EXT_SUS_IMPORT", "BROWSER_STEALTH"),
    "DATA_PRIVACY": ("ENV_FS", "PROCESS_ENV", "FS_CHILD_IMPORT", "LOG_SENSITIVE", "DATAURL_JSON", "BINARY_PREPARE", "BINARY_PREPARE_WEAK", "DELETE_RET_BOOL", "CRED_DECL", "INPUT_SECRET_UNMASKED"),
    "HTML_XSS": ("HTML_UNSANITIZED",),
    "PROMPT_INJECTION": ("PROMPT_INJECTION_CANDIDATE",),
    "CONFIG": ("LICENSE", "PKG_JSON_INVALID", "PKG_JSON_MISSING", "I18N_NON_EN"),
    "SUPPLYCHAIN": ("OFFICIAL_REPO_IMPERSONATION", "VERSION_MISMATCH"),
}
# Risk class of each rule; what isn't listed is N7.
RISK_CLASS = {
    "N1": ("COMMAND_EXEC", "VM_DYNAMIC", "EVAL_DYNAMIC", "DYNAMIC_REQUIRE", "DYNAMIC_IMPORT", "DYNAMIC_REGEX", "DESERIALIZE", "REMOTE_SHELL_CALL"),
    "N2": ("EXT_HTTP_CALL", "EXT_HTTP_IMPORT", "RAW_NET", "HTTP_PROTO", "PROXY_TUNNEL", "EXFIL_SDK_CALL", "BROWSER_STEALTH"),
    "N3": ("FS_CHILD_IMPORT",),
    "N4": ("SSRF_HOST",),
    "N5": ("PROCESS_ENV", "LOG_SENSITIVE", "DATAURL_JSON", "BINARY_PREPARE", "BINARY_PREPARE_WEAK", "CRED_DECL", "INPUT_SECRET_UNMASKED"),
    "N6": ("OFFICIAL_REPO_IMPERSONATION",),
    "N7": ("EXT_HTTP_DEP", "DELETE_RET_BOOL", "EXT_SUS_DEP", "EXT_SUS_IMPORT", "PKG_JSON_INVALID", "PKG_JSON_MISSING", "LICENSE", "I18N_NON_EN", "VERSION_MISMATCH"),
    "N8": ("HTML_UNSANITIZED",),
    "N9": ("PROMPT_INJECTION_CANDIDATE",),
}
# Name, severity tier, weakness numbers and detection of each risk class.
CLASSES = (
    ("N1", "Dynamic Code Execution", "Sv", ["CWE-78", "CWE-94"], "Usage of eval, vm, new Function, or child_process."),
    ("N2", "Outbound Data Exfiltration", "Sv", ["CWE-201", "CWE-359"], "Outbound HTTP with data adjacent to files or secrets."),
    ("N3", "File-System Access Risk", "Md", ["CWE-73", "CWE-22"], "fs.* on tainted or user-influenced paths."),
    ("N4", "SSRF / Internal Reachability", "Md", ["CWE-918"], "Attacker-influenced URLs reaching internal or non-public addresses."),
    ("N5", "Credential Handling Misuse", "Sv", ["CWE-798", "CWE-532", "CWE-256"], "Env vars or hardcoded secrets near network or file sinks."),
    ("N6", "Dependency Supply-Chain Risk", "Md", ["CWE-1104", "CWE-1357"], "Install scripts, risky package.json dependencies, weak provenance."),
    ("N7", "Approved third-party node Non-Compliance", "Md", [], "I/O, dependencies, provenance, licensing, documentation vs platform policy."),
    ("N8", "UI/Output Injection Surface", "Md", ["CWE-79"], "HTML/DOM write sinks (e.g. innerHTML, document.write)."),
    ("N9", "Prompt Injection", "Md", ["CWE-74"], "User input passed into LLM or tool prompts."),
)
# Policy theme of the N7 rules, and tier of the server classes.
POLICY = {
    "DELETE_RET_BOOL": "duplicate_nodes", "EXT_HTTP_DEP": "prohibited_external_dependencies", "EXT_SUS_DEP": "prohibited_external_dependencies", "EXT_SUS_IMPORT": "prohibited_external_dependencies",
    "VERSION_MISMATCH": "version_misalignment", "PKG_JSON_INVALID": "package_source_verification_failure", "PKG_JSON_MISSING": "package_source_verification_failure",
    "LICENSE": "non_mit_license_compliance", "I18N_NON_EN": "non_english_documentation",
}
SERVER_TIER = {"M1": "Sv", "M2": "Sv", "M3": "Md", "M4": "Md", "M5": "Md", "M6": "Md", "M7": "Md", "M8": "Sv", "M9": "Sv"}
# Modules by suspicious family.
FAMILIES = {
    "stealth": ("puppeteer-extra-plugin-stealth", "puppeteer-extra", "@extra/stealth"),
    "captcha": ("2captcha", "node-2captcha", "anticaptcha", "anti-captcha", "capsolver", "hcaptcha-solver", "deathbycaptcha"),
    "tunnel_proxy": ("proxy-chain", "socks-proxy-agent", "https-proxy-agent", "http-proxy-agent", "tunnel", "tunnel-agent", "ngrok", "localtunnel", "node-tor", "tor-request"),
    "remote_shell": ("node-pty", "pty.js", "ssh2", "shelljs", "ws-shell", "wetty"),
    "exfil_sdk": ("@sentry/node", "sentry", "mixpanel", "analytics-node", "@segment/analytics-node", "amplitude", "rollbar", "bugsnag"),
}
# Rule and severity that a module of a family gets as an import and as a dependency.
FAMILY_RULES = {"tunnel_proxy": ("PROXY_TUNNEL", "warn"), "remote_shell": ("REMOTE_SHELL_CALL", "error"), "exfil_sdk": ("EXFIL_SDK_CALL", "warn")}
# Rule groups of the report's panels.
PANELS = {
    "HTML": ("HTML_UNSANITIZED",),
    "EXEC": ("COMMAND_EXEC", "VM_DYNAMIC", "EVAL_DYNAMIC"),
    "DYNLOAD": ("DYNAMIC_REQUIRE", "DYNAMIC_IMPORT", "DYNAMIC_REGEX"),
    "NETWORK": ("EXT_HTTP_CALL", "EXT_HTTP_IMPORT", "EXT_HTTP_DEP", "RAW_NET", "HTTP_PROTO", "SSRF_HOST", "PROXY_TUNNEL"),
    "DESERIALIZE": ("DESERIALIZE",),
}


def _pairs(groups: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    return [(item, group) for group, items in groups.items() for item in items]


def rules(spark: SparkSession) -> DataFrame:
    """(rule, rule_category, class_id, policy)."""
    category, risk = dict(_pairs(CATEGORY)), dict(_pairs(RISK_CLASS))
    return spark.createDataFrame([(r, category.get(r), risk.get(r, "N7"), POLICY.get(r)) for r in sorted(set(category) | set(risk))], "rule string, rule_category string, class_id string, policy string")


def classes(spark: SparkSession) -> DataFrame:
    """(class_id, class_name, tier, cwes, detection, family): the catalogue of risk classes."""
    slug = lambda n: n.lower().replace(" / ", "_").replace("/", "_").replace(" ", "_")
    return spark.createDataFrame([(*c, slug(c[1])) for c in CLASSES], "class_id string, class_name string, tier string, cwes array<string>, detection string, family string")


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_pairs(FAMILIES), "module string, family string")


def panels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_pairs(PANELS), "rule string, panel string")
