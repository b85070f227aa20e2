"""Runs registered queries against their SQL on DuckDB and compares the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, (list, tuple)) and not hasattr(v, "_fields"):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} against {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        diffs = [(c, str(a)[:300], str(b)[:300]) for c, a, b in zip(got_cols, g, w) if a != b]
        return f"{len(bad)} of {len(got)} rows differ, first: key {str(g)[:200]} {diffs}"
    return None


def main(folder: str, names: list[str]) -> None:
    from __spark_entry__ import oracle_sql, queries
    from passagework.session import local_session

    spark = local_session("oracle")
    con = connect(folder)
    qs, sqls = queries(), oracle_sql()
    bad = []
    for name in [n for n in qs if not names or any(n.startswith(x) for x in names)]:
        try:
            start = time.time()
            df = qs[name](spark, folder)
            if name in sqls:
                verdict = compare(df, con, sqls[name])
                n = df.count() if verdict is None and len(names) > 0 else -1
            else:
                n = df.count()
                verdict = None if n else "no rows"
            state = "ok  " if verdict is None else "FAIL"
            print(f"{state} {name:32s} {time.time() - start:6.1f}s rows={n} {'(rows only)' if name not in sqls else ''} {verdict or ''}", flush=True)
        except Exception as e:  # report and go on with the next query
            verdict = str(e)
            print(f"ERR  {name}: {str(e)[:900]}", flush=True)
        if verdict:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    sys.path.insert(0, ".")
    main(sys.argv[1], sys.argv[2:])
