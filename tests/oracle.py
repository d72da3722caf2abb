"""Run registered queries beside their SQL text in DuckDB and compare values."""

import re
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return "T" if v else "F"
    if isinstance(v, float):
        return "∅" if v != v else f"{v:.6f}"
    if isinstance(v, int):
        return f"{v}"
    return str(v)


def kind(v):
    return "bool" if isinstance(v, bool) else type(v).__name__ if v is not None else None


def compare(spark, con, name, folder, queries, oracles):
    """(ok, message) of one query."""
    start = time.time()
    df = queries[name](spark, folder)
    cols = sorted(df.columns)
    table = df.select(*cols).toArrow().to_pydict()
    rows = list(zip(*[table[c] for c in cols])) if cols else []
    took = time.time() - start
    if name not in oracles:
        return True, f"{len(rows)} rows, no SQL, {took:.1f}s"
    start = time.time()
    cur = con.execute(oracles[name])
    names = [d[0] for d in cur.description]
    got = cur.fetchall()
    sql_took = time.time() - start
    if sorted(names) != cols:
        return False, f"columns differ: spark-only {set(cols) - set(names)}, sql-only {set(names) - set(cols)}"
    order = [names.index(c) for c in cols]
    want = [tuple(row[i] for i in order) for row in got]
    if len(rows) != len(want):
        return False, f"rows {len(rows)} vs {len(want)}"
    types = []
    for i, c in enumerate(cols):
        a = {kind(x[i]) for x in rows} - {None}
        b = {kind(x[i]) for x in want} - {None}
        if a != b:
            types.append((c, a, b))
    left = sorted(tuple(map(plain, x)) for x in rows)
    right = sorted(tuple(map(plain, x)) for x in want)
    if left != right:
        bad = [(a, b) for a, b in zip(left, right) if a != b]
        diff = [(c, x, y) for c, x, y in zip(cols, *bad[0]) if x != y]
        return False, f"{len(bad)} rows differ, e.g. {diff[:6]} at {bad[0][0][:6]}"
    if types:
        return False, f"types differ: {types}"
    return True, f"{len(rows)} rows, spark {took:.1f}s, sql {sql_took:.1f}s"


def main(pattern: str, sf: str = "0.01"):
    import __spark_entry__ as entry
    from obsframe.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{sf}"
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name in queries:
        if not re.search(pattern, name):
            continue
        try:
            ok, message = compare(spark, con, name, folder, queries, oracles)
        except Exception as e:
            ok, message = False, f"{type(e).__name__}: {str(e)[:900]}"
        print("ok  " if ok else "FAIL", name, message, flush=True)
        if not ok:
            failed.append(name)
    print(len(failed), "failed:", failed)


if __name__ == "__main__":
    main(*sys.argv[1:])
