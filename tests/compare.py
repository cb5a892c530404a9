"""Order-insensitive comparison of a Spark result with the DuckDB result of its SQL."""
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


def compare(df, con, sql: str) -> tuple[int, list[str]]:
    """Row count and the differences found (none when equal)."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    mine = [tuple(r) for r in df.collect()]
    problems = []
    if sorted(names) != sorted(df.columns):
        return len(mine), [f"columns {sorted(df.columns)} != {sorted(names)}"]
    order = [df.columns.index(n) for n in sorted(names)]
    back = [names.index(n) for n in sorted(names)]
    a = sorted(tuple(norm(r[i]) for i in order) for r in mine)
    b = sorted(tuple(norm(r[i]) for i in back) for r in theirs)
    if len(a) != len(b):
        problems.append(f"{len(a)} rows != {len(b)} rows")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        problems.append(f"{len(bad)} rows differ, first {bad[0]}")
    return len(mine), problems
