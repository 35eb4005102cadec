"""Names, addresses and paths: packages, modules, repositories, languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wfscan.functions.text import non_blank

# Development tools, and names of modules that reach the network (prefixes first, then words).
TOOLING_PREFIXES = [
    "@types/", "eslint", "@eslint", "prettier", "@prettier", "ts-node", "typescript", "tslib", "babel", "@babel", "rollup", "webpack", "vite",
    "esbuild", "swc", "@swc", "jest", "mocha", "vitest",
]
NETWORK_PREFIXES = ["http", "https", "ws", "socket", "net", "tls"]
NETWORK_WORDS = [
    "http", "https", "fetch", "request", "undici", "ws", "websocket", "socket", "net", "tls", "redis", "mysql", "pg", "postgres", "mongo", "mongodb",
    "mssql", "ftp", "sftp", "smtp", "imap", "pop3", "s3", "oss", "minio", "grpc", "mqtt", "kafka",
]


def safe_file_name(name: Column) -> Column:
    """A package name as a file name: scope marks and separators become underscores."""
    t = F.regexp_replace(F.regexp_replace(name, "[@/]", "_"), r"[^0-9A-Za-z_.-]+", "_")
    return F.coalesce(F.when(t != "", t), F.lit("pkg"))


def https_repository(url: Column) -> Column:
    """A repository address as plain https: no git+ prefix, no .git suffix, ssh rewritten."""
    t = F.regexp_replace(F.trim(url), r"^git\+", "")
    t = F.regexp_replace(t, r"^(?:ssh://)?git@([^:/]+)[:/]", "https://$1/")
    return F.regexp_replace(F.regexp_replace(t, r"^git://", "https://"), r"\.git$", "")


def owner_and_repository(url: Column) -> tuple[Column, Column]:
    rx = r"^https?://[^/]+/([^/]+)/([^/?#]+?)(?:\.git)?/?$"
    return F.nullif(F.regexp_extract(url, rx, 1), F.lit("")), F.nullif(F.regexp_extract(url, rx, 2), F.lit(""))


def module_base(spec: Column) -> Column:
    """The package of an import: no node: prefix, nothing after ? or #, two parts of a scoped name, one of others."""
    t = F.regexp_replace(F.trim(spec), "^node:", "")
    t = F.regexp_extract(t, r"^([^?#]*)", 1)
    return F.when(F.startswith(t, F.lit("@")), F.substring_index(t, "/", 2)).otherwise(F.substring_index(t, "/", 1))


def is_tooling(module: Column) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in TOOLING_PREFIXES]), lambda p: F.startswith(F.lower(module), p))


def network_reason(module: Column) -> Column:
    """Why a module counts as reaching the network: the first prefix, else the first word in it; null if neither."""
    low = F.lower(module)
    prefix = F.get(F.filter(F.array(*[F.lit(p) for p in NETWORK_PREFIXES]), lambda p: F.startswith(low, p)), F.lit(0))
    word = F.get(F.filter(F.array(*[F.lit(p) for p in NETWORK_WORDS]), lambda p: F.contains(low, p)), F.lit(0))
    return F.coalesce(F.concat(F.lit("name_prefix:"), prefix), F.concat(F.lit("name_keyword:"), word))


def language_class(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.rlike(r"\.tsx?$"), "ts").when(low.rlike(r"\.(js|mjs|cjs|jsx)$"), "js").otherwise("other")


def is_node_file(path: Column) -> Column:
    return F.lower(path).rlike(r"\.node\.(ts|js)$")


def name_tail(full_name: Column) -> Column:
    return F.substring_index(full_name, "/", -1)


def clone_address(clone_url: Column, url: Column, repository: Column) -> Column:
    """Where to clone from: the clone address, else a web address with .git, else the repository."""
    web = F.when(url.rlike("^https?://"), F.concat(F.regexp_replace(url, r"(\.git)?/?$", ""), F.lit(".git")))
    return F.coalesce(non_blank(clone_url), web, non_blank(repository))


def clone_cache_key(url: Column, name: Column) -> Column:
    return F.md5(F.concat(F.coalesce(url, F.lit("")), F.coalesce(name, F.lit(""))))


def package_of_type(node_type: Column) -> Column:
    return F.substring_index(node_type, ".", 1)


def is_official(name: Column, prefixes: list[str]) -> Column:
    """The name is one of the official ones, or a version of it after an at sign."""
    low = F.lower(name)
    hits = [(low == p.lower()) | F.startswith(low, F.lit(p.lower() + "@")) for p in prefixes]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def is_community(node_type: Column, official: list[str], scope: str, community: str = "^[a-z0-9]+-nodes-") -> Column:
    """A node type of nobody official: a scoped package other than the platform's own, or one named as the platform's packages are."""
    own = F.lit(False)
    for p in official:
        own = own | F.startswith(node_type, F.lit(p))
    foreign = F.contains(node_type, F.lit("@custom/")) | (F.startswith(node_type, F.lit("@")) & ~F.startswith(node_type, F.lit(scope))) | node_type.rlike(community)
    return F.coalesce(~own & foreign, F.lit(False))


def same_repository(url: Column, official: str) -> Column:
    return F.lower(F.regexp_replace(F.trim(url), "/+$", "")) == official.lower()
