"""Pattern rules over source files of packages.

A rule is data: what to look for, what the file must or must not hold, how many hits count, and what else a hit must satisfy. One
Arrow kernel evaluates all rules of a file in one go and gives finished findings - offsets, lines, snippet - so a text never leaves
its task and no row carries it. A cheap test for a word that any hit must hold comes before each pattern; comment spans and line
starts are found once per file, and only for files with a hit, so the work is linear in the text and the number of hits.

Results: null and empty texts give nothing; files that aren't scripts by their name have no comments; repeated files give theirs again.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wfscan.functions.names import is_tooling, module_base, network_reason, same_repository
from wfscan.operators import dims
from wfscan.operators.lexing import block_end, comment_spans, inside_quotes
from wfscan.session import ship_package, spread

# Keys whose strings are interface text.
UI_KEYS = ["placeholder", "default", "example", "examples", "hint", "help", "tooltip", "sample", "description", "displayName"]
UI_KEY_PATTERN = r"\b(" + "|".join(UI_KEYS) + r")\s*:\s*['\"`]"
_UI = "(?:" + "|".join(UI_KEYS) + ")"
# What shows that a file cleans its HTML, what shows a masked field, which words are sensitive in logs.
SANITIZERS = r"(?i)sanitizeHtml\(|DOMPurify|xss\(|sanitize\(|filterXSS"
MASKED = r"(?is)typeOptions\s*:\s*\{[^}]*\bpassword\s*:\s*true\b[^}]*\}|inputType\s*:\s*['\"]password['\"]|ui\s*:\s*\{[^}]*\bpassword\b"
SENSITIVE = r"(?i)(cookie|authorization|bearer|token|api[_-]?key|secret|client[_-]?secret|private[_-]?key|passwd|password)"
PROMPT_NEEDLES = [
    "prompt", "message", "messages", "system", "instruction", "chat", "query", "completion", "user", "assistant", "input", "context", "text",
]
PROMPT_DENIED = ["operation", "resource", "model", "models", "version", "baseUrl", "url", "endpoint", "authentication"]
MODEL_SURFACE = (
    r"(?is)\b(?:openai|@openai/|anthropic|@anthropic-ai/|ollama|@langchain|langchain|ChatOpenAI|ChatAnthropic|AzureOpenAI|GoogleGenerativeAI|GenerativeModel|createChatCompletion|chat\.completions|\.messages\.|client\.chat"
    r"|bedrock|cohere|mistral|together\.ai|replicate|huggingface|@google/generative-ai|google\.generativeai|VertexAI|ai\.google)\b"
)


@dataclass(frozen=True)
class Rule:
    rule: str
    severity: str
    message: str  # {} stands for what is captured
    pattern: str
    requires: str | None = None  # the file must hold this
    requires_code: str | None = None  # the file must hold this outside of comments
    forbids: str | None = None  # the file must not hold this
    in_comments: bool = False  # hits inside comments count too
    first_only: bool = False
    first_anywhere: bool = False  # if there is a hit, the first one is reported even if that is a comment's
    skip_ui_text: bool = False
    within: tuple[int, str] | None = None  # from the hit to so many characters after it this must occur; the finding extends as far
    holds: str | None = None  # the captured or matched text must hold this
    block_lacks: str | None = None  # the brace block from the hit on must not hold this; the finding extends over the block
    capture: int = 0  # group of the pattern that is reported
    names_prompt: bool = False  # what is captured must be the name of a parameter with text for a model
    hints: tuple[str, ...] = ()  # one of these stands in any text with a hit, in lower case; looked for before the pattern


# The patterns of the rules.
RULES: tuple[Rule, ...] = (
    Rule("PROCESS_ENV", "error", "process.env usage", r"\bprocess\.env\b", hints=("process.env",)),
    Rule("FS_CHILD_IMPORT", "error", "fs/child_process import", r"(?m)^\s*import\s+(?!type\b).*from\s+['\"]fs['\"]|require\(\s*['\"]fs['\"]\s*\)|require\(\s*['\"]child_process['\"]\s*\)", hints=("fs'", 'fs"', "child_process")),
    Rule("RAW_NET", "error", "Raw http/https/net import", r"(?im)(?:import\s++[^'\";]*\s+from\s+['\"](?:(?:node:)?(?:http|https|net))['\"])|(?:require\(\s*['\"](?:(?:node:)?(?:http|https|net))['\"]\s*\))", hints=("http'", 'http"', "https'", 'https"', "net'", 'net"')),
    Rule("HTTP_PROTO", "error", "http:// detected", r"(?i)http://", skip_ui_text=True, hints=("http://",)),
    Rule("SSRF_HOST", "error", "localhost/127.0.0.1/private range detected", r"(?i)(localhost|127\.0\.0\.1|0\.0\.0\.0|169\.254\.\d+\.\d+|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(1[6-9]|2\d|3[0-1])\.\d+\.\d+)", skip_ui_text=True, hints=("localhost", "127.0.", "0.0.0.0", "169.254.", "10.", "192.168.", "172.")),
    Rule("EVAL_DYNAMIC", "error", "eval() detected", r"\beval\s*\(", hints=("eval",)),
    Rule("EVAL_DYNAMIC", "error", "new Function() detected", r"\bnew\s+Function\s*\(", hints=("function",)),
    Rule("COMMAND_EXEC", "error", "child_process.* command execution", r"(?i)\bchild_process\.(exec|execSync|spawn|spawnSync|execFile|execFileSync|fork)\s*\(", hints=("child_process.",)),
    Rule("VM_DYNAMIC", "error", "vm.* dynamic code execution", r"(?i)\bvm\.(runInNewContext|runInThisContext|Script)\b", hints=("vm.",)),
    Rule("EVAL_DYNAMIC", "error", "setTimeout/Interval with string code", r"(?i)\bset(?:Timeout|Interval)\s*\(\s*(['\"])", hints=("settimeout", "setinterval")),
    Rule("DYNAMIC_REQUIRE", "warn", "require(var) dynamic module load", r"(?i)require\s*\(\s*[A-Za-z_$][\w$]*\s*\)", hints=("require",)),
    Rule("DYNAMIC_REQUIRE", "warn", "require(a+b) dynamic module load", r"(?i)require\s*\((?>[^)\"'+]*\+)[^)]++\)", hints=("require",)),
    Rule("DYNAMIC_IMPORT", "warn", "import(expr) dynamic module load", r"(?i)\bimport\([^)]++\)", hints=("import(",)),
    Rule("EXT_HTTP_CALL", "error", "External HTTP call function detected", r"(?i)\b(fetch|axios|request|got|superagent)\s*\(|\bhttp\.request\s*\(|\bhttps\.request\s*\(", hints=("fetch", "axios", "request", "got", "superagent")),
    Rule("DYNAMIC_REGEX", "warn", "new RegExp(...) from variable input", r"(?i)\bnew\s+RegExp\s*\(", hints=("regexp",)),
    Rule("DESERIALIZE", "warn", "yaml.load (use safeLoad/safeLoadAll)", r"(?i)\byaml\.load\b", hints=("yaml.load",)),
    Rule("DATAURL_JSON", "warn", "DataURL returned in JSON", r"toDataURL\s*\(", requires=r"\.json\s*:\s*\{[^}]*data", hints=("todataurl",)),
    Rule("BINARY_PREPARE", "error", "Binary output w/o prepareBinaryData", r"\bbinary\s*:\s*\{", forbids="prepareBinaryData", hints=("binary",)),
    Rule("CRED_DECL", "info", "Credential declared: {}", r"credentials\s*:\s*\[\s*\{[^}]*name\s*:\s*['\"]([^'\"]+)['\"]", hints=("credentials",)),
    Rule("I18N_NON_EN", "error", "Non-English chars found in UI text (quoted)", rf"(?i)\b{_UI}\s*:\s*(?:'((?:[^']++|(?<=\\)')*+)'|\"((?:[^\"]++|(?<=\\)\")*+)\")", capture=-1, holds=r"[^\x00-\x7F]"),
    Rule("I18N_NON_EN", "error", "Non-English chars found in UI text (template)", rf"(?i)\b{_UI}\s*:\s*`([^`]*+)`", capture=1, holds=r"[^\x00-\x7F]"),
    Rule("BROWSER_STEALTH", "error", "Puppeteer stealth plugin enabled", r"puppeteer\.use\s*\(\s*require\(\s*['\"]puppeteer-extra-plugin-stealth['\"]\s*\)\s*\(\s*\)\s*\)", in_comments=True, first_only=True, hints=("puppeteer.use",)),
    Rule("LOG_SENSITIVE", "error", "Sensitive data printed in logs", r"(?i)\b(console\.(log|error|warn)|this\.logger\.(info|debug|warn|error)|logger\.(info|debug|warn|error))\s*\(", within=(300, SENSITIVE), hints=("console.", "logger.")),
    Rule("BINARY_PREPARE_WEAK", "warn", "Manual base64/dataURL for binary; prefer prepareBinaryData()", r"(?i)(toString\(\s*['\"]base64['\"]\s*\)|Buffer\.from\s*\([^)]*,\s*['\"]base64['\"]\s*\)|data:\w+\/[\w.+-]+;base64,)", requires=r"(?i)\bbinary(PropertyName)?\b", first_only=True, first_anywhere=True, hints=("base64",)),
    Rule("DELETE_RET_BOOL", "warn", "Delete returns [{deleted:true}] — return structured summary instead", r"(?i)return\s+\[\s*\{\s*['\"]deleted['\"]\s*:\s*(true|false)\s*\}\s*\]", requires=r"(?i)\b(operation|resource|method)\s*:\s*['\"](delete|remove|destroy)[\"']", first_only=True, hints=("deleted",)),
    Rule(
        "INPUT_SECRET_UNMASKED", "error", "Sensitive input without masking: add typeOptions:{password:true} or use Credentials.",
        r"(?i)\b(?:name|displayName)\s*:\s*['\"]\s*(api[_-]?key|apikey|api key|token|access[_-]?token|bearer|password|pass|secret|client[_-]?secret|private[_-]?key|auth|authorization|cookie)\s*['\"]",
        block_lacks=MASKED, capture=1, hints=("name",),
    ),
    *(
        Rule("HTML_UNSANITIZED", "error", "HTML rendered with no sanitizer (need one of: sanitizeHtml(, DOMPurify, xss(, sanitize(, filterXSS, dompurify)", p, forbids=SANITIZERS, hints=(h,))
        for p, h in ((r"(?i)\.innerHTML\s*=", ".innerhtml"), (r"(?i)dangerouslySetInnerHTML", "dangerouslysetinnerhtml"), (r"(?i)\bres\.send\s*\(", "res.send"), (r"(?i)\bres\.render\s*\(", "res.render"), (r"(?i)\breturn\s+[`'\"]\s*<", "return"), (r"(?i)\bdocument\.write\s*\(", "document.write"))
    ),
    Rule("EXFIL_SDK_CALL", "warn", "Telemetry/exfil-like call", r"(?i)\b(Sentry\.capture|mixpanel\.(track|people)|analytics\.)", in_comments=True, first_only=True, hints=("sentry.capture", "mixpanel.", "analytics.")),
    Rule("REMOTE_SHELL_CALL", "error", "Potential remote shell execution", r"(?i)\b(node-pty|pty\.js|ssh2|spawn\(\s*['\"]sh|spawn\(\s*['\"]bash)", in_comments=True, first_only=True, hints=("node-pty", "pty.js", "ssh2", "spawn(")),
    Rule("PROMPT_INJECTION_CANDIDATE", "warn", "LLM/chat API with getNodeParameter for prompt-like key (static N9: user-controlled text may reach the model).", r"getNodeParameter\s*\(\s*['\"]([^'\"]+)['\"]", requires_code=MODEL_SURFACE, capture=1, names_prompt=True, hints=("getnodeparameter",)),
)
SCRIPTS = (".js", ".ts", ".mjs", ".cjs", ".jsx", ".tsx")  # what has comments
# How modules are imported.
IMPORTS = (r"(?m)import\s+(?:[^'\";]*?\s+from\s+)?['\"]([^'\"]+)['\"]", r"require\(\s*['\"]([^'\"]+)['\"]\s*\)", r"\bimport\(\s*['\"]([^'\"]+)['\"]\s*\)")


def prompt_like(key: Column) -> Column:
    """Whether a parameter's name suggests text for a model."""
    low = F.lower(F.trim(key))
    return (low != "") & ~low.isin(*[d for d in PROMPT_DENIED]) & low.rlike("|".join(PROMPT_NEEDLES))


def _names_prompt(key: str) -> bool:
    low = key.strip().lower()
    return low != "" and low not in PROMPT_DENIED and any(n in low for n in PROMPT_NEEDLES)


class _File:
    """What the rules ask about one text, found when first asked."""

    def __init__(self, text: str, comments: bool):
        self.text, self.comments, self.low = text, comments, text.lower()
        self._spans: tuple[list[int], list[int]] | None = None
        self._lines: list[int] | None = None
        self._holds: dict[str, bool] = {}

    def holds(self, pattern: str) -> bool:
        if pattern not in self._holds:
            self._holds[pattern] = bool(_compiled(pattern).search(self.text))
        return self._holds[pattern]

    def in_comment(self, at: int) -> bool:
        if not self.comments:
            return False
        if self._spans is None:
            spans = comment_spans(self.text)
            self._spans = [a for a, _ in spans], [b for _, b in spans]
        k = bisect_right(self._spans[0], at) - 1
        return k >= 0 and at < self._spans[1][k]

    def holds_in_code(self, pattern: str) -> bool:
        return any(not self.in_comment(m.start()) for m in _compiled(pattern).finditer(self.text))

    @property
    def lines(self) -> list[int]:
        if self._lines is None:
            self._lines = [0, *(m.end() for m in re.finditer("\n", self.text))]
        return self._lines

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def cut(self, first: int, last: int) -> str:
        """The lines from one to another, without the last line feed."""
        return self.text[self.lines[first - 1] : self.lines[last] - 1 if last < len(self.lines) else len(self.text)]


@lru_cache(256)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


_UI_KEY = re.compile(UI_KEY_PATTERN, re.I)


def _interface_text(text: str, at: int) -> bool:
    return bool(_UI_KEY.search(text[max(0, at - 300) : at + 300])) and inside_quotes(text, at)


def _hits(f: _File, r: Rule) -> Iterator[tuple[str, int, int, str]]:
    """(message, start, end, matched text) of each finding of a rule in a file."""
    if r.hints and not any(h in f.low for h in r.hints):
        return
    if r.forbids and f.holds(r.forbids) or r.requires and not f.holds(r.requires):
        return
    asked = False
    first = None
    for m in _compiled(r.pattern).finditer(f.text):
        first = first or m
        if not r.in_comments and f.in_comment(m.start()):
            continue
        if r.requires_code and not asked:
            if not f.holds_in_code(r.requires_code):
                return
            asked = True
        if r.first_anywhere:
            m = first
        start, end = m.span()
        shown = m[m.lastindex] if r.capture < 0 else m[r.capture]
        if r.holds and not _compiled(r.holds).search(shown) or r.names_prompt and not _names_prompt(shown):
            continue
        if r.skip_ui_text and _interface_text(f.text, start):
            continue
        if r.within:
            end = min(len(f.text), end + r.within[0])
            if not _compiled(r.within[1]).search(f.text, start, end):
                continue
            shown = f.text[start:end]
        if r.block_lacks:
            end = block_end(f.text, start)
            if _compiled(r.block_lacks).search(f.text[start:end]):
                continue
        yield r.message.format(m[1]) if "{}" in r.message else r.message, start, end, shown
        if r.first_only:
            return


FINDING = [("rule", T.StringType()), ("severity", T.StringType()), ("message", T.StringType()), ("pos", T.IntegerType()), ("end", T.IntegerType()), ("matched_text", T.StringType()), ("line_start", T.IntegerType()), ("line_end", T.IntegerType()), ("match_lines", T.ArrayType(T.IntegerType())), ("code_snippet", T.StringType())]
_ARROW = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string())
HELD_CHARS = 16_000_000  # characters of snippets that a task holds before it hands them on


def find_hits(files: DataFrame, rules: Sequence[Rule] = RULES, comments: bool = True, text: str = "code", path: str | None = "file", before: int = 3, after: int = 3) -> DataFrame:
    """The input's columns but the text, and a row per finding: rule, severity, message, pos, end, matched_text, line_start, line_end,
    match_lines, code_snippet. `path` names the column that tells scripts from other files; without one all are scripts."""
    keep = [c for c in files.columns if c != text]
    kept = files.select(*keep).schema.fields
    named = keep.index(path) if path in keep else None
    ship_package(files.sparkSession)

    def batch(b: pa.RecordBatch, rows: list[tuple], at: list[int]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        own = [pa.array(c, k) for c, k in zip(cols, _ARROW, strict=True)]
        return pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(at)) for i in range(len(keep))), *own], [*keep, *(n for n, _ in FINDING)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at, chars = [], [], 0
            names = b.column(named).to_pylist() if named is not None else [None] * b.num_rows
            for i, (t, name) in enumerate(zip(b.column(len(keep)).to_pylist(), names, strict=True)):
                if not t:
                    continue
                f = _File(t, comments and (name is None or name.lower().endswith(SCRIPTS)))
                for r in rules:
                    for message, start, end, shown in _hits(f, r):
                        a, z = f.line(start), f.line(end)
                        first, last = max(1, a - before), min(len(f.lines), z + after)
                        snippet = f.cut(first, last)
                        rows.append((r.rule, r.severity, message, start, end, shown, first, last, [a, z], snippet))
                        at.append(i)
                        chars += len(snippet) + len(shown)
                        if chars > HELD_CHARS:
                            yield batch(b, rows, at)
                            rows, at, chars = [], [], 0
            if rows:
                yield batch(b, rows, at)

    schema = T.StructType([*kept, *(T.StructField(n, k) for n, k in FINDING)])
    return spread(files.where(F.col(text).isNotNull()).select(*keep, text)).mapInArrow(run, schema)


def distinct_findings(findings: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first of findings that agree in rule, file, message, package and lines."""
    key = [F.col(c) if c != "match_lines" else F.array_join("match_lines", ",") for c in ("rule", "file", "message", "npm_name", "line_start", "line_end", "match_lines")]
    return findings.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def enriched(findings: DataFrame) -> DataFrame:
    """Adds category, risk class, its name, tier, weaknesses, family and policy theme; the dimensions have a fixed size."""
    spark = findings.sparkSession
    d = dims.rules(spark)
    classes = dims.classes(spark)
    out = findings.join(F.broadcast(d), "rule", "left").withColumn("class_id", F.coalesce("class_id", F.lit("N7")))
    return out.join(F.broadcast(classes), "class_id", "left")


def imports(files: DataFrame, text: str = "code", path: str | None = "file") -> DataFrame:
    """The input's columns but the text, and module: every imported package, as often as it is imported outside of comments."""
    rules = [Rule("import", "", "", p, capture=1, hints=("import", "require")) for p in IMPORTS]
    keep = [c for c in files.columns if c != text]
    return find_hits(files, rules, text=text, path=path, before=0, after=0).select(*keep, module_base(F.col("matched_text")).alias("module")).where("module <> ''")


def import_findings(files: DataFrame) -> DataFrame:
    """Findings from imports: network modules that aren't tools, and modules of suspicious families."""
    found = imports(files)
    network = found.withColumn("reason", network_reason(F.col("module"))).where(F.col("reason").isNotNull() & ~is_tooling(F.col("module")) & ~F.startswith("module", F.lit("."))).withColumns({"rule": F.lit("EXT_HTTP_IMPORT"), "severity": F.lit("error")})
    fam = found.join(F.broadcast(dims.families(files.sparkSession)), "module")
    rule = F.coalesce(*[F.when(F.col("family") == f, F.lit(r)) for f, (r, _) in dims.FAMILY_RULES.items()], F.lit("EXT_SUS_IMPORT"))
    severity = F.coalesce(*[F.when(F.col("family") == f, F.lit(s)) for f, (_, s) in dims.FAMILY_RULES.items()], F.lit("error"))
    return network.unionByName(fam.withColumns({"reason": F.concat(F.lit("family:"), F.col("family")), "rule": rule, "severity": severity}).drop("family"))


def dependencies(manifests: DataFrame, text: str = "code") -> DataFrame:
    """(..., module, version_spec, dep_kind, is_tooling, is_network_suspect, reason): dependencies of all four kinds in package files."""
    keep = [c for c in manifests.columns if c != text]
    kinds = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    parts = F.array(*[F.struct(F.lit(k).alias("dep_kind"), F.from_json(F.get_json_object(text, f"$.{k}"), "map<string,string>").alias("m")) for k in kinds])
    rows = manifests.select(*keep, F.explode(parts).alias("p")).select(*keep, "p.dep_kind", F.explode("p.m").alias("module", "version_spec"))
    m = module_base(F.col("module"))
    return rows.withColumns({"is_tooling": is_tooling(m), "reason": network_reason(m)}).withColumn("is_network_suspect", F.col("reason").isNotNull() & ~F.col("is_tooling"))


def dependency_findings(manifests: DataFrame, text: str = "code") -> DataFrame:
    """(..., module, dep_kind, rule, severity, reason): dependencies that reach the network without being tools, and those of suspicious families."""
    found = dependencies(manifests, text).drop("version_spec")
    harder = F.col("dep_kind").isin("dependencies", "optionalDependencies")
    network = found.where("is_network_suspect").withColumns({"rule": F.lit("EXT_HTTP_DEP"), "severity": F.when(harder, "error").otherwise("warn")})
    fam = found.withColumn("module", module_base(F.col("module"))).join(F.broadcast(dims.families(manifests.sparkSession)), "module")
    rule = F.coalesce(*[F.when(F.col("family") == f, F.lit(r)) for f, (r, _) in dims.FAMILY_RULES.items()], F.lit("EXT_SUS_DEP"))
    severity = F.coalesce(*[F.when(F.col("family") == f, F.lit(s)) for f, (_, s) in dims.FAMILY_RULES.items()], F.lit("error"))
    suspicious = fam.withColumns({"reason": F.concat(F.lit("family:"), F.col("family")), "rule": rule, "severity": severity}).drop("family")
    return network.unionByName(suspicious).drop("is_tooling", "is_network_suspect")


def manifest_findings(packages: DataFrame, manifests: DataFrame) -> DataFrame:
    """(npm_name, rule, severity): packages whose package file is missing, unreadable or not under the expected licence."""
    m = manifests.withColumn("_j", F.try_parse_json("code")).groupBy("npm_name").agg(F.max(F.struct(F.col("_j").isNotNull().alias("ok"), F.coalesce(F.get_json_object("code", "$.license"), F.get_json_object("code", "$.licenses")).alias("licence"))).alias("m"))
    j = packages.select("npm_name").distinct().join(m, "npm_name", "left")
    missing = j.where("m is null").select("npm_name", F.lit("PKG_JSON_MISSING").alias("rule"), F.lit("warn").alias("severity"))
    broken = j.where("not m.ok").select("npm_name", F.lit("PKG_JSON_INVALID").alias("rule"), F.lit("error").alias("severity"))
    licence = j.where("m.ok").where(F.col("m.licence").isNull() | ~F.col("m.licence").rlike("(?i)mit") & ~F.col("m.licence").rlike(r"^[\[{]")).select("npm_name", F.lit("LICENSE").alias("rule"), F.lit("warn").alias("severity"))
    return missing.unionByName(broken).unionByName(licence)


def impersonations(packages: DataFrame, url: str, official: str) -> DataFrame:
    """Packages that give the official repository as theirs."""
    return packages.where(same_repository(F.col(url), official)).withColumns({"rule": F.lit("OFFICIAL_REPO_IMPERSONATION"), "severity": F.lit("error")})


def evidence_score() -> Column:
    """How many of seven signals a finding has, six at most."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    signals = [blank("file"), F.col("line_start").isNotNull() | F.col("line_end").isNotNull(), F.coalesce(F.size("match_lines") > 0, F.lit(False)), blank("matched_text"), blank("code_snippet"), blank("message"), blank("rule")]
    return F.least(F.lit(6), sum((s.cast("int") for s in signals[1:]), signals[0].cast("int")))


def labelled(findings: DataFrame) -> DataFrame:
    """Adds evidence_score, confidence (2 from four signals on) and a one-line label."""
    f = findings.withColumn("evidence_score", evidence_score()).withColumn("confidence", F.when(F.col("evidence_score") >= 4, 2).otherwise(1))
    return f.withColumn("label", F.concat_ws("; ", F.col("rule"), F.lower("severity"), F.concat(F.lit("evidence="), F.col("evidence_score")), F.concat(F.lit("confidence="), F.col("confidence"))))


def source_tree(files: DataFrame, path: str, ignored: Sequence[str], extensions: Sequence[str]) -> DataFrame:
    """Files below a root that no ignored directory holds and whose name has an allowed ending."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    ends = F.regexp_extract(F.lower(path), r"(\.[a-z0-9]+)$", 1)
    return files.where(~F.arrays_overlap(dirs, F.array(*[F.lit(i) for i in ignored])) & ends.isin(*extensions))
