"""Compare a query with its SQL: rows as sorted tuples, columns by name."""

import math

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings eval_items mcp_registry_servers scan_findings server_files source_files template template_records topics_full".split()


def connection(folder):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v).tz_localize(None))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return int(v) if isinstance(v, int) else v


def rows_of_frame(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(x[i]) for i in order) for x in r.fetchall()), key=repr)


def same(a, b):
    if len(a) != len(b):
        return False
    close = lambda p, q: p == q or isinstance(p, (int, float)) and isinstance(q, (int, float)) and abs(p - q) <= 1e-6 * max(1, abs(p))
    return all(len(x) == len(y) and all(map(close, x, y)) for x, y in zip(a, b, strict=True))
