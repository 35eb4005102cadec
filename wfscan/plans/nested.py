"""Problem 4: nested templates as flat tables."""

from __future__ import annotations

from wfscan.operators import shredding
from wfscan.plans.registry import query
from wfscan.plans.workflow import _NODES
from wfscan.session import table


_PARAMS = f"""{_NODES}, q AS (SELECT record_id, CAST(node_no AS BIGINT) AS node_no, CASE json_type(node, '$.parameters') WHEN 'VARCHAR' THEN try_cast(node->>'$.parameters' AS JSON) WHEN 'OBJECT' THEN node->'$.parameters' WHEN 'ARRAY' THEN node->'$.parameters' END AS p FROM n),
    t AS (SELECT q.record_id, q.node_no, replace(regexp_replace(t.fullkey, '^\\$\\.?', ''), '"', '') AS param_path, t.atom, t.type FROM q, json_tree(q.p) t WHERE q.p IS NOT NULL AND json_type(q.p) IN ('OBJECT', 'ARRAY') AND t.atom IS NOT NULL)"""


@query(f"{_PARAMS} SELECT record_id, node_no, param_path FROM t UNION ALL SELECT record_id, node_no, '' FROM q")
def p4_found(spark, d):
    return shredding.nodes_and_values(table(spark, d, "template"))


@query(
    f"""{_PARAMS}, k AS (SELECT *, regexp_replace(param_path, '\\[\\d+\\]', '[]', 'g') AS column_path, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS one FROM t),
    c AS (SELECT record_id, column_path, string_agg(DISTINCT one, '|' ORDER BY one) AS kind FROM k GROUP BY ALL)
    SELECT k.record_id, node_no, param_path, atom->>'$' AS value, kind FROM k JOIN c ON c.record_id = k.record_id AND c.column_path = k.column_path"""
)
def p4_param_values(spark, d):
    return shredding.parameter_values(table(spark, d, "template"))


@query(
    f"""{_PARAMS}, v AS (SELECT record_id, node_no, count(*) AS n FROM t GROUP BY ALL)
    SELECT record_id, CAST(node_no AS BIGINT) AS node_no, node->>'$.type' AS type, node->>'$.name' AS name, coalesce(v.n, 0) AS n_values FROM n LEFT JOIN v USING (record_id, node_no)"""
)
def p4_nodes(spark, d):
    return shredding.node_table(table(spark, d, "template"))


_PATHS = f"""{_PARAMS}, a AS (SELECT record_id, 'nodes[' || node_no || '].parameters' || CASE WHEN param_path = '' OR starts_with(param_path, '[') THEN '' ELSE '.' END || param_path AS path, atom, type FROM t),
    b AS (SELECT *, regexp_extract_all(path, '\\[(\\d+)\\]', 1) AS ks, regexp_extract(path, '^(.*\\])', 1) AS row_path FROM a)"""


@query(
    f"""{_PATHS} SELECT record_id, regexp_replace(row_path, '\\[\\d+\\]', '[]', 'g') AS table_name, array_to_string(ks, '.') AS row_key, CASE WHEN len(ks) = 1 THEN '' ELSE regexp_replace(regexp_extract(row_path, '^(.*\\])[^\\]]*\\]$', 1), '\\[\\d+\\]', '[]', 'g') END AS parent_table,
    array_to_string(ks[1:len(ks) - 1], '.') AS parent_key, ltrim(substr(path, length(row_path) + 1), '.') AS field FROM b"""
)
def p4_tables(spark, d):
    """The fields of the tables of nodes and of every repeated part of their parameters, with keys of rows and parents."""
    rows = shredding.flat_tables(table(spark, d, "template"), [shredding.PARAMETERS]).where("kind <> 'object' and not (table_name = 'nodes[]' and field = 'parameters')")  # no marks, no parameters without structure
    return rows.select("record_id", "table_name", "row_key", "parent_table", "parent_key", "field")


_LIST = lambda p: f"CASE json_type(j, '{p}') WHEN 'VARCHAR' THEN try_cast(j->>'{p}' AS JSON) ELSE j->'{p}' END"
_ANY = lambda x: f"array_to_string(list_transform({x}, lambda s: CASE WHEN starts_with(s, '[') THEN '[]' ELSE s END), '')"
_BODIES = f"""WITH d AS (SELECT record_id, try_cast(ltrim(trim(body), chr(65279)) AS JSON) AS j FROM template WHERE body IS NOT NULL),
    u AS (SELECT record_id, CASE json_type(j) WHEN 'VARCHAR' THEN try_cast(ltrim(trim(j->>'$'), chr(65279)) AS JSON) ELSE j END AS j FROM d),
    l AS (SELECT record_id, j, {_LIST("$.workflow.workflow.nodes")} AS a, {_LIST("$.workflow.nodes")} AS b, {_LIST("$.nodes")} AS c FROM u WHERE json_type(j) = 'OBJECT'),
    s AS (SELECT record_id, j, CASE WHEN json_array_length(a) > 0 THEN '$.workflow.workflow.nodes' WHEN json_array_length(b) > 0 THEN '$.workflow.nodes' WHEN json_array_length(c) > 0 THEN '$.nodes' ELSE '' END AS place,
      CASE WHEN json_array_length(a) > 0 THEN a WHEN json_array_length(b) > 0 THEN b WHEN json_array_length(c) > 0 THEN c END AS ns FROM l),
    e AS (SELECT record_id, unnest(json_extract(ns, '$[*]')) AS node, unnest(range(0, CAST(json_array_length(ns) AS BIGINT))) AS node_no FROM s WHERE ns IS NOT NULL),
    f AS (SELECT *, CASE json_type(node, '$.parameters') WHEN 'VARCHAR' THEN try_cast(node->>'$.parameters' AS JSON) ELSE node->'$.parameters' END AS once FROM e),
    g AS (SELECT *, CASE json_type(once) WHEN 'VARCHAR' THEN try_cast(once->>'$' AS JSON) ELSE once END AS twice FROM f),
    q AS (SELECT record_id, node_no, CASE WHEN json_type(twice) IN ('OBJECT', 'ARRAY') THEN twice ELSE node->'$.parameters' END AS p FROM g),
    t AS (SELECT record_id, CASE WHEN place <> '$.nodes' AND regexp_matches(t.fullkey, '^\\$\\.nodes($|[.\\[])') THEN '.other_' || substr(t.fullkey, 3) ELSE substr(t.fullkey, 2) END AS path, t.atom, t.type FROM s, json_tree(s.j) t
        WHERE t.atom IS NOT NULL AND (place = '' OR NOT (t.fullkey = place OR starts_with(t.fullkey, place || '.') OR starts_with(t.fullkey, place || '[')))
      UNION ALL SELECT record_id, '.nodes[' || node_no || ']' || substr(t.fullkey, 2), t.atom, t.type FROM e, json_tree(e.node) t WHERE t.atom IS NOT NULL AND NOT regexp_matches(t.fullkey, '^\\$\\.parameters($|[.\\[])')
      UNION ALL SELECT record_id, '.nodes[' || node_no || '].parameters' || substr(t.fullkey, 2), t.atom, t.type FROM q, json_tree(q.p) t WHERE t.atom IS NOT NULL),
    k AS (SELECT record_id, atom, type, list_transform(regexp_extract_all(path, '\\[\\d+\\]|\\."(?:[^"\\\\]|\\\\.)*"|\\.[A-Za-z0-9_]+'), lambda s: CASE WHEN starts_with(s, '."') THEN '.' || regexp_replace(s[3:len(s) - 1], '\\\\(.)', '\\1', 'g') ELSE s END) AS steps FROM t),
    i AS (SELECT *, list_filter(range(1, len(steps) + 1), lambda x: starts_with(steps[x], '[')) AS ends, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS one FROM k),
    m AS (SELECT *, list_transform(steps, lambda s: CASE WHEN starts_with(s, '[') THEN '[]' ELSE s END) AS col, coalesce(ends[-1], 0) AS last, coalesce(ends[-2], 0) AS above, list_transform(ends, lambda x: trim(steps[x], '[]')) AS ks FROM i),
    c AS (SELECT record_id, col, string_agg(DISTINCT one, '|' ORDER BY one) AS kind FROM m GROUP BY ALL)"""


@query(
    f"""{_BODIES} SELECT m.record_id, substr({_ANY("steps[1:last]")}, 2) AS table_name, array_to_string(ks, '.') AS row_key, CASE WHEN last > 0 THEN substr({_ANY("steps[1:above]")}, 2) END AS parent_table,
    CASE WHEN last > 0 THEN array_to_string(ks[1:len(ks) - 1], '.') END AS parent_key, substr(array_to_string(steps[last + 1:], ''), 2) AS field, atom->>'$' AS value, kind FROM m JOIN c ON c.record_id = m.record_id AND c.col = m.col
    UNION ALL SELECT record_id, 'nodes[]', CAST(node_no AS VARCHAR), '', '', '', NULL, 'object' FROM e WHERE json_type(node) = 'OBJECT'"""
)
def p4_all_tables(spark, d):
    """The whole documents: every value, outside parameters too, as a field of the table of its repeated ancestor, and a row for every node."""
    return shredding.flat_tables(table(spark, d, "template"))
