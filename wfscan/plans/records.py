"""Registry records, versions, caches and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from wfscan.functions import names, versions
from wfscan.functions.text import strip_controls, truncated
from wfscan.operators import registry
from wfscan.plans.registry import query, values
from wfscan.session import table


def _servers(spark, d):
    return table(spark, d, "mcp_registry_servers")


@query(
    """WITH k AS (SELECT *, CASE WHEN trim(full_name, ' ') <> '' THEN lower(trim(full_name, ' ')) ELSE chr(1) || record_id END AS key FROM mcp_registry_servers)
    SELECT record_id, full_name, version FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY coalesce(is_latest, false) DESC, coalesce(updated_at, '') DESC, record_id DESC) AS n FROM k) WHERE n = 1"""
)
def latest_per_key(spark, d):
    return registry.latest_per_key(_servers(spark, d), F.col("full_name"), "is_latest", "updated_at", "record_id").select("record_id", "full_name", "version")


_ORDER = {"official_registry": 0, "npm": 1, "github_topic": 2}
_NAME = "coalesce(CASE WHEN trim(url, ' ') <> '' THEN url END, CASE WHEN trim(clone_url, ' ') <> '' THEN clone_url END, CASE WHEN trim(full_name, ' ') <> '' THEN full_name END, CASE WHEN trim(name, ' ') <> '' THEN name END)"


@query(
    f"""SELECT record_id, source FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o, record_id) AS n FROM (SELECT *, {_NAME} AS key, CASE source WHEN 'official_registry' THEN 0 WHEN 'npm' THEN 1 WHEN 'github_topic' THEN 2 ELSE 3 END AS o FROM mcp_registry_servers) WHERE key IS NOT NULL) WHERE n = 1"""
)
def first_seen_dedup(spark, d):
    return registry.first_seen(_servers(spark, d), ["url", "clone_url", "full_name", "name"], _ORDER, "source", "record_id").select("record_id", "source")


@query("SELECT source, count(*) AS n FROM mcp_registry_servers GROUP BY source")
def servers_by_source(spark, d):
    return registry.by_source(_servers(spark, d), "source")


@query("SELECT full_name, max(stars) AS stars FROM mcp_registry_servers WHERE stars IS NOT NULL GROUP BY full_name ORDER BY stars DESC, full_name NULLS FIRST LIMIT 10")
def most_starred(spark, d):
    return registry.most_starred(_servers(spark, d), "full_name", "stars")


@query("SELECT record_id FROM mcp_registry_servers WHERE contains(lower(name), 'flow') OR contains(lower(full_name), 'flow') OR contains(lower(url), 'flow')")
def named_like(spark, d):
    return registry.named_like(_servers(spark, d), ["name", "full_name", "url"], "flow").select("record_id")


@query("SELECT 'server' AS kind, full_name AS name, stars, NULL AS lang FROM mcp_registry_servers UNION ALL SELECT 'file', npm_name, NULL, lang FROM source_files")
def union_sources(spark, d):
    a = _servers(spark, d).select(F.lit("server").alias("kind"), F.col("full_name").alias("name"), "stars")
    b = table(spark, d, "source_files").select(F.lit("file").alias("kind"), F.col("npm_name").alias("name"), "lang")
    return registry.union_sources(a, b).select("kind", "name", "stars", "lang")


_NORMAL = "nullif(trim(string_split(string_split(regexp_replace(trim({c}, ' '), '^[vV]', ''), '+')[1], '-')[1]), '')"
_PART = "coalesce(try_cast(string_split({n}, '.')[{i}] AS INT), 0)"


@query(f"SELECT record_id, {_NORMAL.format(c='version')} AS normal FROM mcp_registry_servers")
def version_normalise(spark, d):
    return _servers(spark, d).select("record_id", versions.normal(F.col("version")).alias("normal"))


_TRIPLE = lambda n: f"CASE WHEN coalesce({', '.join(f'try_cast(string_split({n}, chr(46))[{i}] AS INT)' for i in (1, 2, 3))}) IS NOT NULL THEN [{', '.join(_PART.format(n=n, i=i) for i in (1, 2, 3))}] END"
_PAIRS = f"""WITH o AS (SELECT record_id, {_NORMAL.format(c="version")} AS v, lag({_NORMAL.format(c="version")}) OVER (PARTITION BY lower(trim(full_name, ' ')) ORDER BY record_id) AS w FROM mcp_registry_servers WHERE trim(full_name, ' ') <> ''),
    t AS (SELECT record_id, v, w, {_TRIPLE("v")} AS a, {_TRIPLE("w")} AS b FROM o),
    c AS (SELECT record_id, CASE WHEN v IS NULL THEN 'missing_npm_version' WHEN w IS NULL THEN 'missing_github_version' WHEN v = w THEN 'equal' WHEN a IS NULL OR b IS NULL THEN 'unparsable' WHEN a = b THEN 'equal' WHEN a > b THEN 'npm_newer' ELSE 'github_newer' END AS status,
      CASE WHEN v IS NULL OR w IS NULL THEN 'unknown' WHEN v = w THEN 'match' ELSE 'mismatch' END AS consistency FROM t)"""


def _pairs(spark, d):
    from pyspark.sql import Window

    s = _servers(spark, d).where("trim(full_name) <> ''")
    w = Window.partitionBy(F.lower(F.trim("full_name"))).orderBy("record_id")
    s = s.select("record_id", "version", F.lag(versions.normal(F.col("version"))).over(w).alias("previous"))
    return s.select("record_id", versions.compare(F.col("version"), F.col("previous")).alias("status"), versions.consistency(F.col("version"), F.col("previous")).alias("consistency"))


@query(f"{_PAIRS} SELECT * FROM c")
def version_compare(spark, d):
    return _pairs(spark, d)


@query(f"{_PAIRS} SELECT status, count(*) AS n FROM c GROUP BY status")
def a9_version_asymmetry(spark, d):
    return _pairs(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(
    """WITH v AS (SELECT lower(trim(full_name, ' ')) AS server, trim(version, ' ') AS version, list_transform(list_filter(string_split_regex(trim(version, ' '), '[^0-9]+'), lambda x: x <> ''), lambda x: CAST(x AS BIGINT)) AS k FROM mcp_registry_servers WHERE trim(full_name, ' ') <> '' AND regexp_matches(version, '[0-9]')),
    r AS (SELECT *, row_number() OVER (PARTITION BY server ORDER BY list_resize(k, 3, 0) DESC, version DESC) AS n FROM v) SELECT server, version FROM r WHERE n = 1"""
)
def highest_version(spark, d):
    s = _servers(spark, d).where("trim(full_name) <> ''").where(F.col("version").rlike("[0-9]")).select(F.lower(F.trim("full_name")).alias("server"), F.trim("version").alias("version"))
    return registry.highest_version(s, "server", "version")


@query(
    r"""SELECT record_id, regexp_replace(regexp_replace(trim(clone_url, ' '), '^git\+', ''), '\.git$', '') AS web, nullif(regexp_extract(url, '^https?://[^/]+/([^/]+)/([^/?#]+?)(?:\.git)?/?$', 1), '') AS owner, nullif(regexp_extract(url, '^https?://[^/]+/([^/]+)/([^/?#]+?)(?:\.git)?/?$', 2), '') AS repo,
    list_last(string_split(full_name, '/')) AS tail, coalesce(nullif(regexp_replace(regexp_replace(full_name, '[@/]', '_', 'g'), '[^0-9A-Za-z_.-]+', '_', 'g'), ''), 'pkg') AS safe_name FROM mcp_registry_servers"""
)
def url_and_name_forms(spark, d):
    owner, repo = names.owner_and_repository(F.col("url"))
    return _servers(spark, d).select("record_id", names.https_repository(F.col("clone_url")).alias("web"), owner.alias("owner"), repo.alias("repo"), names.name_tail(F.col("full_name")).alias("tail"), names.safe_file_name(F.col("full_name")).alias("safe_name"))


@query(
    r"""SELECT record_id, coalesce(CASE WHEN trim(clone_url, ' ') <> '' THEN clone_url END, CASE WHEN regexp_matches(url, '^https?://') THEN regexp_replace(url, '(\.git)?/?$', '') || '.git' END, CASE WHEN trim(repository, ' ') <> '' THEN repository END) AS address,
    md5(coalesce(clone_url, '') || coalesce(name, '')) AS cache_key FROM mcp_registry_servers"""
)
def clone_addresses(spark, d):
    return _servers(spark, d).select("record_id", names.clone_address(F.col("clone_url"), F.col("url"), F.col("repository")).alias("address"), names.clone_cache_key(F.col("clone_url"), F.col("name")).alias("cache_key"))


@query("SELECT row_id, CASE WHEN length(doc_text) > 57 THEN left(doc_text, 57) || '...' ELSE doc_text END AS short, regexp_replace(title, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') AS title FROM topics_full")
def truncated_texts(spark, d):
    return table(spark, d, "topics_full").select("row_id", truncated(F.col("doc_text"), 57).alias("short"), strip_controls(F.col("title")).alias("title"))


_EARLY, _LATE = "created_at < TIMESTAMP '2025-06-01'", "created_at >= TIMESTAMP '2025-06-01'"
_OLD, _NEW = f"(SELECT DISTINCT trim(template_id, ' ') AS t FROM template_records WHERE {_EARLY})", f"(SELECT DISTINCT trim(template_id, ' ') AS t FROM template_records WHERE {_LATE})"


def _snapshots(spark, d):
    r = table(spark, d, "template_records").select(F.trim("template_id").alias("t"), "created_at")
    return r.where(_EARLY), r.where(_LATE)


@query(f"SELECT t, 'new' AS change FROM {_NEW} n WHERE NOT EXISTS (SELECT 1 FROM {_OLD} o WHERE o.t = n.t) UNION ALL SELECT t, 'deleted' FROM {_OLD} o WHERE NOT EXISTS (SELECT 1 FROM {_NEW} n WHERE o.t = n.t)")
def snapshot_diff(spark, d):
    return registry.snapshot_difference(*_snapshots(spark, d), "t")


@query(
    f"""WITH j AS (SELECT o.t AS a, n.t AS b FROM {_OLD} o FULL JOIN {_NEW} n ON o.t = n.t), g AS (SELECT count(a) AS previous, count(b) AS current, count(*) FILTER (WHERE a IS NULL) AS new, count(*) FILTER (WHERE b IS NULL) AS deleted FROM j)
    SELECT *, new - deleted AS net_change FROM g"""
)
def snapshot_counts(spark, d):
    return registry.snapshot_counts(*_snapshots(spark, d), "t")


@query("SELECT count(*) AS n, round(avg(views), 2) AS avg_views, count(*) FILTER (WHERE views < 10) AS under_ten, count(*) FILTER (WHERE views = 0) AS none, min(created_at) AS first, max(created_at) AS last FROM template_records")
def a33_view_statistics(spark, d):
    return registry.view_statistics(table(spark, d, "template_records"), "views", "created_at")


@query("SELECT server_name, file_id FROM server_files s WHERE scanned_at > (SELECT max(scanned_at) FROM server_files) - INTERVAL 240 HOURS")
def ttl_cache(spark, d):
    """Rows of a cache that are fresh against the newest row; the newest time is one value."""
    f = table(spark, d, "server_files")
    now = f.agg(F.max("scanned_at").alias("now"))
    return f.join(F.broadcast(now)).where(F.col("scanned_at") > F.col("now") - F.expr("INTERVAL 240 HOURS")).select("server_name", "file_id")


@query("SELECT p.npm_name, coalesce(n, 0) AS findings FROM (SELECT DISTINCT npm_name FROM source_files) p LEFT JOIN (SELECT npm_name, count(*) AS n FROM scan_findings WHERE rule = 'EXT_HTTP_DEP' GROUP BY npm_name) f USING (npm_name)")
def default_lookup(spark, d):
    f = table(spark, d, "scan_findings").where("rule = 'EXT_HTTP_DEP'").groupBy("npm_name").agg(F.count("*").alias("findings"))
    return registry.with_default(table(spark, d, "source_files").select("npm_name").distinct(), f, "npm_name", "findings", 0)


@query(
    """WITH e AS (SELECT lower(trim(full_name, ' ')) AS k, max(url) AS url FROM mcp_registry_servers WHERE trim(url, ' ') <> '' AND trim(full_name, ' ') <> '' GROUP BY ALL)
    SELECT record_id, coalesce(CASE WHEN trim(s.url, ' ') <> '' THEN s.url END, e.url) AS url FROM mcp_registry_servers s LEFT JOIN e ON lower(trim(s.full_name, ' ')) = e.k"""
)
def filled_fields(spark, d):
    s = _servers(spark, d).withColumn("k", F.lower(F.trim("full_name")))
    e = s.where("trim(url) <> '' and trim(full_name) <> ''").groupBy("k").agg(F.max("url").alias("url"))
    return registry.filled(s.select("record_id", "url", "k"), e, "k", ["url"]).select("record_id", "url")


@query("SELECT file_id FROM server_files s WHERE NOT EXISTS (SELECT 1 FROM server_files o WHERE o.server_name = s.server_name AND o.file = s.file AND o.lang = 'py')")
def resume_antijoin(spark, d):
    f = table(spark, d, "server_files")
    return registry.not_done(f, f.where("lang = 'py'"), ["server_name", "file"]).select("file_id")


@query("SELECT platform, id, min(row_id) AS row_id, count(*) AS crawls FROM topics_full GROUP BY platform, id")
def run_scoped_dedup(spark, d):
    return table(spark, d, "topics_full").groupBy("platform", "id").agg(F.min("row_id").alias("row_id"), F.count("*").alias("crawls"))


@query("SELECT CAST(row_number() OVER (ORDER BY npm_name, file_path, file_id) AS BIGINT) AS position, file_id FROM source_files")
def sequential_ids(spark, d):
    return registry.last_position(table(spark, d, "source_files"), ["npm_name", "file_path", "file_id"]).select(F.col("position").cast("bigint").alias("position"), "file_id")
