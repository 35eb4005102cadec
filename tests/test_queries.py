import pytest

from tests import oracle
from wfscan.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(data):
    return oracle.connection(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, duck, name):
    cols, mine = oracle.rows_of_frame(QUERIES[name](spark, data))
    names, theirs = oracle.rows_of_sql(duck, SQL[name])
    assert cols == names
    assert oracle.same(mine, theirs)


# Queries without SQL: the columns they must have, and the fewest rows they must give on the smallest tables.
WITHOUT_SQL = {
    "a7_network_dependencies": ("", 0),
    "model_texts": ("record_id texts", 1),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(spark, data, name):
    df = QUERIES[name](spark, data)
    columns, rows = WITHOUT_SQL[name]
    assert set(columns.split()) <= set(df.columns)
    assert df.count() >= rows


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_works_without_the_text_operators():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "wfscan"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            for n in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) else []
                assert not any(x.startswith("wfscan.llm") for x in names), p
