import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import oracle
from wfscan.operators import shredding as sh
from wfscan.plans import QUERIES, SQL

values = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab", max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("xyz", min_size=1, max_size=2), c, max_size=3), max_leaves=12)


def leaves(v, path=""):
    if isinstance(v, dict):
        for k, x in v.items():
            yield from leaves(x, f"{path}.{k}" if path else k)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from leaves(x, f"{path}[{i}]")
    elif v is not None:
        yield path, v if isinstance(v, str) else json.dumps(v)


def rebuilt(doc):
    out = []
    for steps, reps, defs, vals, _ in sh.shred_document(doc):
        if steps[-1] == sh.OBJECT:
            continue
        at = sh.indexes(reps, steps.count(sh.ITEM)).tolist()
        out += [(sh.path_text(list(steps), at[k]), v) for k, (d, v) in enumerate(zip(defs, vals, strict=True)) if d == len(steps) + 1]
    return out


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("pqr", min_size=1, max_size=2), values, max_size=4))
def test_levels_give_back_every_value_and_place(doc):
    assert sorted(rebuilt(doc)) == sorted(leaves(doc))


def test_forms_of_documents(spark):
    node = {"type": "t", "parameters": {"a": [{"b": 1}, None, {"b": "x"}], "e": ""}}
    bodies = [
        json.dumps({"workflow": {"workflow": {"nodes": [None, node]}, "nodes": [{"type": "other"}]}}),
        "﻿" + json.dumps({"workflow": {"nodes": [dict(node, parameters=json.dumps(node["parameters"]))]}}),
        json.dumps({"nodes": [{"parameters": []}, {"parameters": None}, {}, 5]}),
        '{"nodes": [', "", None, "[]", "null", "7",
    ]
    df = spark.createDataFrame([(i, b, "clash") for i, b in enumerate(bodies)], "record_id bigint, body string, value string")
    got = sorted(map(tuple, sh.nodes_and_values(df).collect()))
    paths = ["", "a[0].b", "a[2].b", "e"]
    assert got == sorted([(0, 1, p) for p in paths] + [(1, 0, p) for p in paths] + [(2, 0, ""), (2, 1, ""), (2, 2, "")])
    assert sh.parameter_values(df).where("param_path = 'a[2].b'").select("value").distinct().collect()[0][0] == "x"
    assert sh.node_table(df).where(F.col("record_id") == 0).select("type", "n_values").collect() == [("t", 3)]


def test_tables_of_repeated_ancestors_keep_their_links(spark):
    doc = {
        "id": 7, "meta": {"tags": ["a", None, "b"]}, "connections": {"A": {"main": [[{"node": "B"}], []]}}, "settings": {},
        "workflow": {"name": "w", "nodes": [{"name": "A", "parameters": {"values": [{"k": 1, "opts": [{"o": True}, {"o": False}]}, {"k": 2}]}}, {}]}, "nodes": [{"name": "unused"}],
    }
    df = spark.createDataFrame([(1, json.dumps(doc), "clash"), (2, None, "x")], "record_id bigint, body string, table_name string")
    got = {(r.table_name, r.row_key, r.parent_table, r.parent_key, r.field): r.value for r in sh.flat_tables(df).collect()}
    assert got == {
        ("", "", None, None, "id"): "7", ("", "", None, None, "workflow.name"): "w", ("meta.tags[]", "0", "", "", ""): "a", ("meta.tags[]", "2", "", "", ""): "b",
        ("connections.A.main[][]", "0.0", "connections.A.main[]", "0", "node"): "B", ("other_nodes[]", "0", "", "", "name"): "unused",
        ("nodes[]", "0", "", "", ""): None, ("nodes[]", "0", "", "", "name"): "A", ("nodes[]", "1", "", "", ""): None,
        ("nodes[].parameters.values[]", "0.0", "nodes[]", "0", "k"): "1", ("nodes[].parameters.values[]", "0.1", "nodes[]", "0", "k"): "2",
        ("nodes[].parameters.values[].opts[]", "0.0.0", "nodes[].parameters.values[]", "0.0", "o"): "true", ("nodes[].parameters.values[].opts[]", "0.0.1", "nodes[].parameters.values[]", "0.0", "o"): "false",
    }
    flat = sh.flat_table(sh.flat_tables(df), "nodes[].parameters.values[]", ["k", "absent"]).collect()
    assert sorted((r.record_id, r.row_key, r.parent_key, r.k, r.absent) for r in flat) == [(1, "0.0", "0", "1", None), (1, "0.1", "0", "2", None)]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("pqr", min_size=1, max_size=2), values, max_size=4))
def test_projection_keeps_what_is_wanted(doc):
    wanted = [(".p",), (".q", sh.ITEM, ".x")]
    whole = [c for c in sh.shred_document(doc) if any(c[0][: len(w)] == w for w in wanted)]
    some = [c for c in sh.shred_document(sh._projected(doc, wanted)) if any(c[0][: len(w)] == w for w in wanted)]
    assert sorted(map(repr, whole)) == sorted(map(repr, some))


def test_empty_table_and_repeats(spark):
    df = spark.createDataFrame([], "record_id bigint, body string")
    assert sh.nodes_and_values(df).count() == 0 and sh.node_table(df).count() == 0
    b = json.dumps({"nodes": [{"parameters": {"t": "x" * 200_000}}]})
    assert sh.nodes_and_values(spark.createDataFrame([(1, b), (1, b)], "record_id bigint, body string")).count() == 4


def test_depth_has_no_limit(spark):
    def nest(n):
        return '{"a":[' * n + "1" + "]}" * n

    bodies = [f'{{"nodes": [{{"type": "t", "parameters": {{"p": {nest(n)}, "q": 2}}}}, {{}}]}}' for n in (400, 6000)]
    bodies += [json.dumps({"nodes": [{"parameters": nest(6000)}]}), bodies[1][:-1]]
    df = spark.createDataFrame(list(enumerate(bodies)), "record_id bigint, body string")
    got = sorted((r.record_id, r.node_no, len(r.param_path)) for r in sh.nodes_and_values(df).collect())
    assert got == sorted((i, *r) for i, n in ((0, 400), (1, 6000)) for r in ((0, 0), (1, 0), (0, 1), (0, 1 + 5 * n))) + [(2, 0, 0), (2, 0, 5 * 6000 - 1)]


@given(st.text('{}[]",:1 a.-e', max_size=12) | values.map(json.dumps))
def test_deep_reader_equals_json(text):
    def read(f):
        try:
            return repr(f(text))
        except ValueError:
            return None

    assert read(sh._loads_deep) == read(json.loads)


def compared(spark, folder, name, bodies):
    """Rows of a query and of its SQL over these bodies."""
    import duckdb

    spark.createDataFrame(list(enumerate(bodies)), "record_id bigint, body string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/template.parquet")
    con = duckdb.connect()
    con.execute(f"create view template as select * from '{folder}/template.parquet/*.parquet'")
    cols, mine = oracle.rows_of_frame(QUERIES[name](spark, str(folder)))
    names, theirs = oracle.rows_of_sql(con, SQL[name])
    assert cols == names
    return mine, theirs


NODE = {"type": "t", "name": "n", "position": [1, 2], "credentials": {"x y": {"id": "1"}}, "parameters": {"a": [{"b": 1}, None, {"b": "x"}], "z": {"k.l": True}}}


def test_whole_documents_come_out(spark, tmp_path):
    bodies = [
        json.dumps({"id": 7, "meta": {"a.b": {"c[0]": [{"e": [1, {"f": 2}]}]}}, "workflow": {"workflow": {"nodes": [NODE, None], "connections": {"A": {"main": [[{"node": "B"}], []]}}}, "nodes": [{"p": 1}]}, "nodes": [3]}),
        json.dumps({"nodes": [5, "s", NODE, [1, [2]], True, "{}"]}),
        json.dumps({"nodes": [{"parameters": "text"}, {"parameters": 5}, {"parameters": json.dumps([1, {"a": 2}])}, {"parameters": json.dumps(json.dumps({"a": 1}))}, {}]}),
        json.dumps({"workflow": {"nodes": json.dumps([NODE])}, "nodes": 0}),
        json.dumps(json.dumps({"nodes": [], "name": "w"})),
        '{"nodes": [', "", None, "[1]", "7",
    ]
    mine, theirs = compared(spark, tmp_path, "p4_all_tables", bodies)
    assert oracle.same(mine, theirs)
    assert len(mine) == 51
    mine, theirs = compared(spark, tmp_path, "p4_tables", [json.dumps({"nodes": [NODE, {"parameters": "text"}, {"parameters": {"a": 1, "parameters": [2]}}]})])
    assert oracle.same(mine, theirs) and len(mine) == 5


@settings(max_examples=150, deadline=None)
@given(st.lists(values | st.fixed_dictionaries({"parameters": values, "type": values}), max_size=4), values)
def test_every_value_of_a_document_is_in_one_column(nodes, rest):
    doc = {"id": rest, "nodes": nodes}
    assert sorted(v for _, v in rebuilt(sh.normalise(doc))) == sorted(v for _, v in leaves(doc))


def test_no_readable_document_is_left_out(spark, tmp_path):
    digits = "9" * 5000
    bodies = ['{"nodes": [{"parameters": {"a": %s, "b": -%s, "c": 2}}]}' % (digits, digits), "\u00a0" + json.dumps({"nodes": [NODE]}) + "\u3000", json.dumps({"nodes": [NODE]})]
    for name, rows in (("p4_tables", 9), ("p4_param_values", 9), ("p4_found", 12), ("p4_all_tables", 22)):
        mine, theirs = compared(spark, tmp_path, name, bodies)
        assert oracle.same(mine, theirs) and len(mine) == rows, name


def test_half_of_a_surrogate_pair_does_not_end_the_query(spark):
    body = '{"nodes": [{"parameters": {"\\ud83d": "\\ude00", "b": "\\ud83d\\ude00"}}]}'
    df = spark.createDataFrame([(1, body), (2, '{"nodes": [{}]}')], "record_id bigint, body string")
    assert sorted((r.field, r.value) for r in sh.flat_tables(df).where("kind <> 'object'").collect()) == [("parameters.b", "\U0001f600"), ("parameters.\ufffd", "\ufffd")]
    assert sh.nodes_and_values(df).count() == 4 and sh.shred(df).count() == 4
