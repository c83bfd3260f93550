"""Run registered queries beside their checking SQL and compare names and values."""

from __future__ import annotations

import sys
import time

import duckdb

from quern.sources.tables import TABLES, table_path


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{table_path(sf_dir, name)}'")
    return con


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, [tuple(row[n] for n in names) for row in df.collect()]


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], [tuple(r[i] for i in order) for r in cur.fetchall()]


def difference(left: tuple, right: tuple) -> str | None:
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    a, b = (sorted(map(repr, side[1])) for side in (left, right))
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}: {a[:2]} / {b[:2]}"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} != {y}"
    return None


def main(sf_dir: str, wanted: list[str]) -> int:
    from quern.plans import load_all
    from quern.session import local_session

    registry = load_all()
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in registry.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            got = spark_rows(fn(spark, sf_dir))
            took = time.time() - started
            if name not in registry.ORACLE:
                print(f"rows {name} {len(got[1])} {took:.2f}s")
                continue
            problem = difference(got, duck_rows(con, registry.ORACLE[name]))
        except Exception as exc:  # report and go on with the next query
            problem, took, got = f"{type(exc).__name__}: {str(exc)[:600]}", time.time() - started, ([], [])
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {len(got[1])} {took:.2f}s {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) != 0)
