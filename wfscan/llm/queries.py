"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wfscan.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from wfscan.llm.survivorship import duplicate_groups

    return duplicate_groups(table(spark, d, "mcp_registry_servers")).select("group_id", "record_id", "version_record_id")


@query
def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    from wfscan.llm.survivorship import survivors

    return survivors(table(spark, d, "mcp_registry_servers"), ["full_name", "name", "description", "version", "status", "url", "clone_url", "repository", "stars"])


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from wfscan.llm.tokenizer import encode_corpus

    return encode_corpus(table(spark, d, "documents"))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from wfscan.llm.leakage import find_leaks

    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


@query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Partial leaks too: from a quarter of an item on, with the greatest share that stands in one stretch."""
    from pyspark.sql import functions as F

    from wfscan.llm.leakage import find_leaks

    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), share=0.25).groupBy("doc_id", "item_id").agg(F.round(F.max("share"), 4).alias("share"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from wfscan.llm.provenance import classify

    return classify(table(spark, d, "server_files")).select("file_id").distinct()


@query
def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    from wfscan.llm.provenance import classify

    return classify(table(spark, d, "server_files"))


_SECRET_COLUMNS = {"code_snippet": "code_snippet", "matched_text": "matched_text"}


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from wfscan.llm.secrets import find_secrets

    files = find_secrets(table(spark, d, "source_files"), "file_id", {"code": "code"})
    return files.unionByName(find_secrets(table(spark, d, "scan_findings"), "finding_id", _SECRET_COLUMNS))


@query
def p5_masked(spark: SparkSession, d: str) -> DataFrame:
    from wfscan.llm.secrets import mask_secrets

    files = mask_secrets(table(spark, d, "source_files"), "file_id", {"code": "code"})
    return files.unionByName(mask_secrets(table(spark, d, "scan_findings"), "finding_id", _SECRET_COLUMNS))


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from wfscan.llm.hidden_text import text_languages

    return text_languages(table(spark, d, "source_files"), table(spark, d, "scan_findings"), table(spark, d, "documents"))


@query
def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    from wfscan.llm.hidden_text import text_shares

    return text_shares(table(spark, d, "source_files"), table(spark, d, "scan_findings"), table(spark, d, "documents"))


@query
def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    from wfscan.llm.hidden_text import texts

    return texts(table(spark, d, "source_files"), table(spark, d, "scan_findings"), table(spark, d, "documents")).drop("n_chars")


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from wfscan.llm.personal import find_personal

    return find_personal(table(spark, d, "topics_full"), "row_id", ("title", "doc_text")).select("row_id", "field", "kind").distinct()


@query
def p7_placeholders(spark: SparkSession, d: str) -> DataFrame:
    from wfscan.llm.personal import replace_personal

    return replace_personal(table(spark, d, "topics_full"), "row_id", ("title", "doc_text"))


def _surrogate_key(spark: SparkSession) -> bytes:
    """The owner's key, from the session's settings; where none is set, one that lives as long as the session."""
    import secrets

    name = "wfscan.surrogate.key"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, secrets.token_hex(16))
    return spark.conf.get(name).encode()[:64]


@query
def p7_surrogates(spark: SparkSession, d: str) -> DataFrame:
    from wfscan.llm.personal import surrogate_personal

    return surrogate_personal(table(spark, d, "topics_full"), "row_id", ("title", "doc_text"), _surrogate_key(spark))


@query
def p7_collisions(spark: SparkSession, d: str) -> DataFrame:
    """No rows unless two different mentions would get the same surrogate."""
    from wfscan.llm.personal import collisions

    return collisions(table(spark, d, "topics_full"), ("title", "doc_text"), _surrogate_key(spark))


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from wfscan.llm.sentences import split_sentences

    return split_sentences(table(spark, d, "documents")).distinct()


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    from wfscan.llm.near_duplicates import near_pairs

    prompts = near_pairs(table(spark, d, "template_records"), "rec_id", "prompt_text", 0.6, 3).select(F.lit("prompt_text").alias("origin"), "id_a", "id_b")
    snippets = near_pairs(table(spark, d, "scan_findings"), "finding_id", "code_snippet", 0.6, 3).select(F.lit("code_snippet").alias("origin"), "id_a", "id_b")
    return prompts.unionByName(snippets)


@query
def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    from wfscan.llm.near_duplicates import near_groups

    prompts = near_groups(table(spark, d, "template_records"), "rec_id", "prompt_text", 0.6, 3).withColumn("origin", F.lit("prompt_text"))
    return prompts.unionByName(near_groups(table(spark, d, "scan_findings"), "finding_id", "code_snippet", 0.6, 3).withColumn("origin", F.lit("code_snippet")))


# --- SQL where it can say the same --------------------------------------------------------------------------------------------------

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))).replace("'", "''")
_PLAIN = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_NAME = f"nullif(regexp_replace(lower(translate(regexp_replace(full_name, '[\\p{{Cf}}\\p{{Cc}}]', '', 'g'), '{_WIDE}', '{_PLAIN}')), '^[\\s\\p{{Z}}/]+|[\\s\\p{{Z}}/]+$', '', 'g'), '')"
_TIME = "coalesce(CASE WHEN regexp_matches(t, '^[0-9]{9,15}$') THEN CAST(t AS BIGINT) * 1000 END, " + ", ".join(f"epoch_us(try_strptime(t, '{f}'))" for f in ("%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S.%fZ", "%Y-%m-%d %H:%M:%S UTC", "%Y/%m/%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S%z", "%d %b %Y %H:%M:%S %z")) + ")"
_NUMBER = "CASE WHEN regexp_matches(w, '^[0-9]+([.][0-9]+)*$') THEN list_resize(list_transform(string_split(w, '.'), lambda x: CAST(x AS BIGINT)), 4, 0) END"

SQL["p2_found"] = f"""WITH a AS (SELECT record_id, {_NAME} AS k, coalesce(is_latest, false) AS l, trim(updated_at, ' ') AS t, regexp_replace(trim(version, ' '), '^[vV]', '') AS w FROM mcp_registry_servers),
    r AS (SELECT record_id, k, l, {_TIME} AS u, {_NUMBER} AS v FROM a WHERE k IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l DESC, u DESC NULLS LAST, v DESC NULLS LAST, record_id) AS n, row_number() OVER (PARTITION BY k ORDER BY v IS NULL, l DESC, u DESC NULLS LAST, v DESC NULLS LAST, record_id) AS m FROM r)
    SELECT min(record_id) AS group_id, min(CASE WHEN n = 1 THEN record_id END) AS record_id, min(CASE WHEN m = 1 AND v IS NOT NULL THEN record_id END) AS version_record_id FROM o GROUP BY k HAVING count(*) >= 2"""


# Built records: for each attribute the first value that isn't blank, by trust in the source, time, flag and id.
_ATTRIBUTES = ("full_name", "name", "description", "version", "status", "url", "clone_url", "repository", "stars")
_FILLED = {a: f"CASE WHEN lower({{0}}) NOT IN ('', '-', 'n/a', 'na', 'none', 'null', 'unknown', 'latest') THEN {{0}} END".format(rf"trim(regexp_replace(regexp_replace({a}, '\p{{Cf}}', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'), ' ')") for a in _ATTRIBUTES}
_FILLED["stars"] = "stars"
_FILLED["version"] = f"CASE WHEN v IS NOT NULL THEN {_FILLED['version']} END"
_TRUST = "CASE source WHEN 'official_registry' THEN 3 WHEN 'npm' THEN 2 WHEN 'github_topic' THEN 1 ELSE 0 END"
_PICKED = {a: f"(list({x} ORDER BY p DESC, u DESC NULLS LAST, l DESC, record_id) FILTER (WHERE {x} IS NOT NULL))[1]" for a, x in _FILLED.items()}
SQL["p2_survivors"] = f"""WITH a AS (SELECT *, {_NAME} AS k, coalesce(is_latest, false) AS l, trim(updated_at, ' ') AS t, regexp_replace(trim(version, ' '), '^[vV]', '') AS w, {_TRUST} AS p FROM mcp_registry_servers),
    r AS (SELECT *, {_TIME} AS u, {_NUMBER} AS v FROM a WHERE k IS NOT NULL),
    g AS (SELECT min(record_id) AS group_id, count(*) AS n_records, {", ".join(f"{x} AS {a}" for a, x in _PICKED.items())} FROM r GROUP BY k)
    SELECT group_id, n_records, {" + ".join(f"CAST({a} IS NOT NULL AS INT)" for a in _ATTRIBUTES)} AS n_filled, {", ".join(_ATTRIBUTES)} FROM g"""


def _near(table_name: str, row_id: str, column: str, origin: str) -> str:
    return f"""(WITH v AS (SELECT {row_id} AS id, regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {table_name}),
      u AS (SELECT id, ws, count(*) OVER (PARTITION BY ws) AS copies, min(id) OVER (PARTITION BY ws) AS first FROM v WHERE len(ws) >= 3), w AS (SELECT id, ws FROM u WHERE copies <= 256 OR id = first),
      s AS (SELECT DISTINCT id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS sh FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
      n AS (SELECT id, count(*) AS n FROM s GROUP BY id), c AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS o FROM s x JOIN s y ON x.sh = y.sh AND x.id < y.id GROUP BY ALL)
      SELECT '{origin}' AS origin, id_a, id_b FROM c JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE o >= 0.6 * (a.n + b.n - o) - 1e-9
      UNION ALL SELECT '{origin}', first, id FROM u WHERE copies > 256 AND id <> first)"""


SQL["p3_found"] = _near("template_records", "rec_id", "prompt_text", "prompt_text") + " UNION ALL " + _near("scan_findings", "finding_id", "code_snippet", "code_snippet")


def _groups(n: int, table_name: str, row_id: str, column: str, origin: str) -> str:
    """Classes of equal sets, links between their first rows, and the parts that links connect; names of the n-th part of a query."""
    return f"""v{n} AS (SELECT {row_id} AS id, regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {table_name}),
      s{n} AS (SELECT DISTINCT id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS sh FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) AS i FROM v{n} WHERE len(ws) >= 3)),
      k{n} AS (SELECT id, rep, n, count(*) OVER (PARTITION BY rep) AS m FROM (SELECT id, n, min(id) OVER (PARTITION BY digest) AS rep FROM (SELECT id, count(*) AS n, md5(string_agg(sh, '|' ORDER BY sh)) AS digest FROM s{n} GROUP BY id))),
      c{n} AS (SELECT x.id AS a, y.id AS b, count(*) AS o FROM s{n} x JOIN s{n} y ON x.sh = y.sh AND x.id <> y.id SEMI JOIN (SELECT rep FROM k{n}) r ON r.rep = x.id SEMI JOIN (SELECT rep FROM k{n}) t ON t.rep = y.id GROUP BY ALL),
      l{n} AS (SELECT a, b FROM c{n} JOIN k{n} p ON p.id = a JOIN k{n} q ON q.id = b WHERE o >= 0.6 * (p.n + q.n - o) - 1e-9),
      r{n}(id, seen) AS (SELECT a, a FROM l{n} UNION SELECT l{n}.b, seen FROM r{n} JOIN l{n} ON l{n}.a = r{n}.id),
      p{n} AS (SELECT id, min(seen) AS label FROM r{n} GROUP BY id), d{n} AS (SELECT a, count(*) AS n_links FROM l{n} GROUP BY a),
      z{n} AS (SELECT k.id, k.rep AS class_id, coalesce(label, k.rep) AS group_id, coalesce(n_links, 0) AS n_links, '{origin}' AS origin FROM k{n} k LEFT JOIN p{n} p ON p.id = k.rep LEFT JOIN d{n} d ON d.a = k.rep WHERE m > 1 OR n_links > 0)"""


SQL["p3_groups"] = "WITH RECURSIVE " + _groups(1, "template_records", "rec_id", "prompt_text", "prompt_text") + ", " + _groups(2, "scan_findings", "finding_id", "code_snippet", "code_snippet") + " SELECT * FROM z1 UNION ALL SELECT * FROM z2"
