"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in sorted(Path(directory).glob("*.parquet")):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p if p.is_file() else str(p) + '/*.parquet'}')")
    return c


def canon(v: object) -> str:
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(map(canon, v.values())) + "}"
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def compare(spark, con, query, sql: str, directory: str) -> tuple[int, int, list]:
    df = query(spark, directory)
    cols = sorted(df.columns)
    ours = sorted(tuple(canon(r[c]) for c in cols) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == cols, (sorted(names), cols)
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(canon(r[i]) for i in at) for r in res.fetchall())
    diff = []
    if ours != theirs:
        a, b = set(ours), set(theirs)
        diff = [("only spark", x) for x in sorted(a - b)[:3]] + [("only sql", x) for x in sorted(b - a)[:3]] or [("counts differ", len(ours), len(theirs))]
    return len(ours), len(theirs), diff


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e
    from tessera.session import build_session

    d, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(d)
    sqls = e.oracle_sql()
    bad = 0
    for n, q in e.queries().items():
        if names and not any(n.startswith(x) for x in names):
            continue
        t = time.time()
        try:
            if n in sqls:
                a, b, diff = compare(spark, con, q, sqls[n], d)
                print(n, a, b, "OK" if not diff else diff, f"{time.time() - t:.1f}s", flush=True)
                bad += bool(diff)
            else:
                print(n, q(spark, d).count(), "rows only", f"{time.time() - t:.1f}s", flush=True)
        except Exception as x:  # noqa: BLE001
            bad += 1
            print(n, "ERROR", str(x)[:600], flush=True)
    print("bad", bad)
