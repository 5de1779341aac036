"""Run registered queries next to their oracle SQL and compare the results.

``python -m tests.compare [sf_dir] [name…]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


# Column types both engines must agree on.
FAMILY = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


def compare(df, con, sql) -> str:
    """Empty when names, types and rows agree; else what differs first."""
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    theirs = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    wrong = {n: (t, types[n]) for n, t in df.dtypes if FAMILY.get(t) != types[n]}
    if wrong:
        return f"types {wrong}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{sorted(names)}: {a} != {b}"
    return "" if mine else "no rows"


def main(argv: list[str]) -> int:
    import __spark_entry__ as contract
    from urnstat.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = local_session(8), oracle(sf_dir)
    sqls, bad = contract.oracle_sql(), 0
    for name, fn in contract.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            if name in sqls:
                verdict = compare(fn(spark, sf_dir), con, sqls[name]) or "ok"
            else:
                verdict = f"ok, {fn(spark, sf_dir).count()} rows, no oracle"
        except Exception as error:
            verdict = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not verdict.startswith("ok")
        print(f"{name:28s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print("not agreeing:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
