"""Pattern rules over the files of tool servers, with the lines around a hit as context.

One Arrow kernel reads a file once and gives small rows: a hit's line, its context and what stands nearby. The text isn't carried on;
what is nearby is asked once per line and not per hit.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wfscan.functions.text import any_match
from wfscan.session import ship_package, spread

# Rule, family and pattern of the server rules.
SERVER_RULES = (
    ("cmd_exec", "command_injection", r"(?i)\b(exec|execSync|spawn|spawnSync|popen|subprocess\.run|os\.system)\s*\("),
    ("dynamic_code", "dynamic_code_execution", r"(?i)\b(eval|new\s+Function|vm\.Script|compile|exec)\s*\("),
    ("unsafe_deserialization", "unsafe_parsing", r"(?i)\b(yaml\.load|pickle\.loads|marshal\.loads|JSON\.parse)\s*\("),
    ("path_traversal", "file_path_traversal", r"(?i)(\.\./|%2e%2e|path\.join\s*\(|path\.resolve\s*\()"),
    ("outbound_http", "unauthorized_network_access", r"(?i)\b(fetch|axios|requests\.(get|post)|http\.(get|request)|https\.(get|request)|urllib\.request)\b"),
    ("tls_relaxed", "insecure_transport_verification", r"(?i)(verify\s*=\s*False|rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED)"),
    ("broad_permission", "overbroad_permission_scope", r"(?i)(allowAll|permissions?\s*[:=]\s*['\"]?\*|read[^\n]*write[^\n]*execute)"),
    ("secret_literal", "sensitive_data_exposure", r"(?i)((api[_-]?key|secret|token|password)\s*[:=]\s*['\"][^'\"]{8,}['\"])"),
    ("secret_env_source", "sensitive_data_exposure", r"(?i)(process\.env\.[A-Z0-9_]+|os\.environ|getenv\s*\()"),
)
# What a server can reach, and what guards, sources and sinks look like.
CAPABILITIES = {
    "file_resource": (r"(?i)\bfs\.(read|write|append|unlink|rename|mkdir|rmdir|createReadStream|createWriteStream)\b", r"(?i)\b(open|read|write|chmod|chown|remove|copyfile)\s*\("),
    "system_resource": (r"(?i)\b(child_process|subprocess|os\.system|execv|fork|spawn)\b", r"(?i)\b(exec|execSync|spawn|spawnSync|popen|subprocess\.run)\s*\("),
    "network_resource": (r"(?i)\b(fetch|axios|get|post|put|delete|request)\s*\(", r"(?i)\b(http|https|socket|urllib|requests)\b", r"(?i)https?://"),
    "memory_resource": (r"(?i)\b(ctypes\.CDLL|dlopen|unsafe|malloc|free|memcpy|create_string_buffer)\b",),
}
GUARDS = [
    r"(?i)\b(allowlist|whitelist|denylist|blocklist|sanitize|validator|validate|escape)\b",
    r"(?i)\b(auth|authentication|authorization|bearer|token check|apikey)\b",
    r"(?i)\b(timeout|rate.?limit|retry|backoff)\b",
    r"(?i)\b(verify\s*=\s*True|rejectUnauthorized\s*:\s*true)\b",
]
SOURCES = [r"(?i)(process\.env\.[A-Z0-9_]+|os\.environ|getenv\s*\()", r"(?i)(request\.(body|query|params)|ctx\.(request|params)|input\(|argv)"]
SINKS = [
    r"(?i)\b(fetch|axios|requests\.(get|post)|http\.(get|request)|https\.(get|request)|urllib\.request)\b",
    r"(?i)\b(exec|execSync|spawn|subprocess\.run|os\.system|eval|new\s+Function)\b",
    r"(?i)\b(fs\.(write|append|createWriteStream)|writeFile|open\s*\()",
]
FILE_OPERATION = r"(?i)\b(fs\.(read|write|open)|readFile|writeFile|open\s*\()"
USER_PATH = r"(?i)(req\.(body|query|params)|input|argv|user|path)"
HIGH_FAMILIES = ("command_injection", "dynamic_code_execution", "sensitive_data_exposure", "unauthorized_network_access")
# Directories, name parts, endings and names that decide which files are scanned.
VENDOR_DIRS = (".git", "node_modules", "dist", "build", "vendor", "venv", ".venv", "target", "__pycache__", ".next", ".cache")
SKIPPED_NAMES = ("test", "spec", "fixture", "example", "sample", "demo")
EXTENSIONS = (".py", ".js", ".ts", ".mjs", ".cjs", ".jsx", ".tsx", ".go", ".rs", ".java", ".rb")
MANIFESTS = ("package.json", "requirements.txt", "pyproject.toml", "go.mod", "Cargo.toml")


def scannable(path: Column) -> Column:
    """Whether a server's file is scanned: no vendor directory above it, no test or example by name, a source ending."""
    parts = F.split(F.regexp_replace(F.lower(path), r"\\", "/"), "/")
    name = F.element_at(parts, -1)
    return (
        ~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(d) for d in VENDOR_DIRS]))
        & ~name.rlike("|".join(SKIPPED_NAMES))
        & (F.regexp_extract(name, r"(\.[a-z0-9]+)$", 1).isin(*EXTENSIONS) | name.isin(*[m.lower() for m in MANIFESTS]))
    )


# What tells of the platform a server runs on.
PLATFORMS = (("container", "docker|container"), ("linux", "linux|systemd"), ("macos", "darwin|launchctl"), ("windows", "powershell|win32"))
_COMMENT = re.compile(r"\s*(?://|#|\*|/\*)")
_HIT = "server string, file string, rule string, family string, line int, pos int, match string, guarded boolean, source_sink_chain boolean, platform_hints string, context string"


def _any(patterns: list[str]) -> list[re.Pattern]:
    return [re.compile(p) for p in patterns]


class _Context:
    """The lines of a file, and what stands around each, found when first asked."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self._asked: dict[tuple[int, int, str], bool] = {}

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def around(self, line: int, n: int) -> str:
        first, last = max(1, line - n), min(len(self.starts), line + n)
        return self.text[self.starts[first - 1] : self.starts[last] - 1 if last < len(self.starts) else len(self.text)]

    def has(self, line: int, n: int, what: str, patterns: list[re.Pattern]) -> bool:
        key = (line, n, what)
        if key not in self._asked:
            near = self.around(line, n)
            self._asked[key] = any(p.search(near) for p in patterns)
        return self._asked[key]


def scan_servers(files: DataFrame, server: str = "server_name", file: str = "file", text: str = "code") -> DataFrame:
    """A finding per rule, file and line: its first match, guards and chains nearby, confidence, severity, platform hints."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [(rule, family, re.compile(rx)) for rule, family, rx in SERVER_RULES]
        guards, sources, sinks, operation, user = _any(GUARDS), _any(SOURCES), _any(SINKS), _any([FILE_OPERATION]), _any([USER_PATH])
        platforms = [(k, _any(["(?i)" + rx])) for k, rx in PLATFORMS]
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string())
        names = [c.split()[0] for c in _HIT.split(", ")]
        for b in batches:
            rows: list[tuple] = []
            for who, where, code in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c = _Context(code)
                for rule, family, rx in rules:
                    seen = 0
                    for m in rx.finditer(code):
                        line = c.line(m.start())
                        if line == seen:  # the first match of a line counts
                            continue
                        if _COMMENT.match(code, c.starts[line - 1], c.starts[line] if line < len(c.starts) else len(code)):
                            continue
                        if rule == "path_traversal" and not (c.has(line, 6, "operation", operation) and c.has(line, 6, "user", user)) or rule == "secret_env_source" and not c.has(line, 6, "sinks", sinks):
                            continue
                        seen = line
                        chain = c.has(line, 8, "sources", sources) and c.has(line, 8, "sinks", sinks)
                        hints = "|".join(k for k, p in platforms if c.has(line, 6, k, p))
                        rows.append((who, where, rule, family, line, m.start(), m[0][:120], c.has(line, 6, "guards", guards), chain, hints, c.around(line, 2)[:2000]))
            for k in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 20_000], strict=True), kinds, strict=True)], names)

    h = spread(files.where(F.col(text).isNotNull()).select(server, file, text)).mapInArrow(run, _HIT)
    # a file that is there more than once counts once
    h = h.withColumn("_n", F.row_number().over(Window.partitionBy("server", "file", "rule", "line").orderBy("pos", "match", "context"))).where("_n = 1")
    return h.select(
        "server", "file", "rule", "family", "line", "match", "guarded", "source_sink_chain",
        F.when(F.col("source_sink_chain") & ~F.col("guarded"), "strong").otherwise("weak").alias("chain_confidence"),
        F.when(F.col("guarded"), "low").when(F.col("family").isin(*HIGH_FAMILIES), "high").otherwise("medium").alias("severity"),
        "platform_hints", "context",
    )


def capabilities(files: DataFrame, server: str = "server_name", text: str = "code") -> DataFrame:
    """(server, four counts): files of each server that show a capability."""
    return files.groupBy(F.col(server).alias("server")).agg(*[F.count_if(any_match(F.col(text), list(rx))).alias(k) for k, rx in CAPABILITIES.items()])


def scan_totals(findings: DataFrame) -> DataFrame:
    """(kind, key, findings, servers): totals by rule, family and confidence; what never occurs is there with zero."""
    spark = findings.sparkSession
    parts = [("rule", "rule", [r for r, _, _ in SERVER_RULES]), ("family", "family", sorted({f for _, f, _ in SERVER_RULES})), ("confidence", "chain_confidence", ["strong", "weak"])]
    expected = spark.createDataFrame([(kind, k) for kind, _, keys in parts for k in keys], "kind string, key string")
    stacked = findings.select("server", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key")) for kind, c, _ in parts])).alias("x")).select("server", "x.kind", "x.key")
    g = stacked.groupBy("kind", "key").agg(F.count("*").alias("findings"), F.count_distinct("server").alias("servers"))
    return F.broadcast(expected).join(g, ["kind", "key"], "left").select("kind", "key", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("servers", F.lit(0)).alias("servers"))


def findings_by_family(findings: DataFrame, most: int = 20) -> DataFrame:
    """(server, family, n, examples): count, and the first findings of each family of a server by file and line.

    Counts combine on the map side, and the ranking is limited there; only a group's first rows are gathered.
    """
    w = Window.partitionBy("server", "family").orderBy("file", "line", "rule")
    first = findings.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    examples = first.groupBy("server", "family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.concat_ws(":", "file", "line").alias("at")))), lambda x: x["at"]), "|").alias("examples"))
    return findings.groupBy("server", "family").agg(F.count("*").alias("n")).join(examples, ["server", "family"])


def manifests(files: DataFrame, server: str = "server_name", file: str = "file") -> DataFrame:
    """(server, a flag per kind): which package files a server has."""
    name = F.element_at(F.split(F.regexp_replace(file, r"\\", "/"), "/"), -1)
    return files.groupBy(F.col(server).alias("server")).agg(*[F.bool_or(name == m).alias(m.replace(".", "_")) for m in MANIFESTS])
