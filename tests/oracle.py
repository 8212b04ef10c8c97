"""Run named queries beside DuckDB and report differences. Usage: python tests/oracle.py [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, "" if v is None else (round(v, 4) if isinstance(v, float) else v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, (int, float)) and a is not None and b is not None:
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> tuple[str, bool]:
    """('' or a message, exactly equal)."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    left = sorted((tuple(r) for r in df.select(*names).collect()), key=_key)
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} against {sorted(rel.columns)}", False
    right = sorted(rel.select(", ".join(f'"{n}"' for n in names)).fetchall(), key=_key)
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}", False
    for a, b in zip(left, right):
        if not all(_same(x, y) for x, y in zip(a, b)):
            return f"{dict(zip(names, a))} against {dict(zip(names, b))}", False
    return "", left == right


def main() -> int:
    import __spark_entry__ as entry
    from wardline.sources.session import local_session

    sf_dir = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session("8")
    con = connect(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    wanted = sys.argv[1:]
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                message, exact = compare(spark, con, name, fn, sqls[name], sf_dir)
            else:
                message, exact = ("" if fn(spark, sf_dir).count() > 0 else "no rows"), True
        except Exception as error:  # noqa: BLE001
            message, exact = f"{type(error).__name__}: {str(error)[:700]}", False
        bad += bool(message)
        state = "FAIL " + message if message else ("ok" if exact else "close")
        print(f"{name:32s} {time.time() - start:6.1f}s {state}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
