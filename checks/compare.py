"""Run registered queries against DuckDB: ``python -m checks.compare [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 9) + 0.0)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, int):
        return repr(value)
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, query, sql: str | None, sf_dir: str) -> str:
    start = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if sql is None:
        return f"rows {len(got):>7} {spent:6.2f}s {name}"
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = [str(d[1]) for d in res.description]
    want = res.fetchall()
    cols_a, a = _rows(df.columns, got)
    cols_b, b = _rows(names, want)
    if cols_a != cols_b:
        return f"COLUMNS {name}: {set(cols_a) ^ set(cols_b)}"
    kinds_a = dict(df.dtypes)
    same = {
        "bigint": {"BIGINT"}, "int": {"INTEGER"}, "string": {"VARCHAR", "STRING"}, "double": {"DOUBLE"}, "boolean": {"BOOLEAN", "BOOL"},
    }
    odd = [
        (n, kinds_a[n], k)
        for n, k in zip(names, kinds)
        if k not in same.get(kinds_a[n], {k}) and k not in ("NUMBER",)
    ]
    if a == b:
        return f"ok   {len(a):>7} {spent:6.2f}s {name}" + (f"  types {odd}" if odd else "")
    left, right = set(a) - set(b), set(b) - set(a)
    lines = [f"DIFF {name}: {len(a)} vs {len(b)} rows, {len(left)}/{len(right)} differ"]
    lines += [f"   spark {r}" for r in sorted(left)[:3]] + [f"   duck  {r}" for r in sorted(right)[:3]]
    return "   " + "\n".join([str(cols_a)] + lines)


def main(argv: list[str]) -> int:
    from checks import ALL
    from rentweave.session import build_session

    sf_dir = argv[0] if argv and argv[0].startswith("/") else f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    wanted = argv[1:] or list(ALL)
    spark = build_session("checks", "local[8]", spark__sql__shuffle__partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in wanted:
        try:
            line = compare(spark, con, name, *ALL[name], sf_dir)
        except Exception as err:  # noqa: BLE001
            line = f"FAIL {name}: {type(err).__name__} {str(err)[:600]}"
        bad += not line.startswith(("ok", "rows"))
        print(line, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
