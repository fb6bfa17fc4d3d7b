"""Run queries against their SQL on one sample folder and compare the rows exactly.

    python tests/compare.py /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if v is None:
        return ""
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str:
    """Empty when both sides hold the same rows."""
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(set(df.columns) ^ set(names))}"
    a, b = rows_of(df.columns, got), rows_of(names, cur.fetchall())
    if a == b:
        return ""
    in_a, in_b = set(a), set(b)
    only_a = [x for x in a if x not in in_b][:2]
    only_b = [x for x in b if x not in in_a][:2]
    return f"{len(a)} vs {len(b)} rows\n   columns {sorted(names)}\n   spark {only_a}\n   sql   {only_b}"


def main(folder: str, prefixes: list[str]) -> int:
    import __spark_entry__ as entry
    from eventlens.session import get_session

    spark = get_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(folder), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = run(spark, folder)
            if name in sqls:
                msg = difference(df, con, sqls[name])
                n = "" if msg else f"{con.execute(f'SELECT count(*) FROM ({sqls[name]})').fetchone()[0]} rows"
            else:
                n, msg = f"{len(df.collect())} rows only", ""
        except Exception as e:  # noqa: BLE001
            n, msg = "", f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {name} {n} {time.time() - t0:.1f}s {msg}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
