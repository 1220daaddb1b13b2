"""Run registered queries next to their SQL and compare the rows.

As a script: ``python tests/oracle.py [--sf DIR] [name ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(float(value))
    if isinstance(value, list):
        return str([_cell(v) for v in value])
    return repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows), sorted(names)


def compare(spark, con, plan, sql: str, sf_dir: str) -> tuple[bool, str]:
    df = plan(spark, sf_dir)
    ours, names = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    theirs, expected = _rows([d[0] for d in result.description], result.fetchall())
    if names != expected:
        return False, f"columns {names} != {expected}"
    if ours != theirs:
        extra, lacking = sorted(set(ours) - set(theirs))[:3], sorted(set(theirs) - set(ours))[:3]
        return False, f"{len(ours)} vs {len(theirs)} rows; only ours {extra}; only sql {lacking}"
    return True, f"{len(ours)} rows"


def main() -> None:
    from tallyloom import plans
    from tallyloom.session import local_session

    arguments = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in arguments:
        i = arguments.index("--sf")
        sf_dir = arguments[i + 1]
        del arguments[i:i + 2]
    plans.load_all()
    spark, con = local_session(8), connect(sf_dir)
    for name, plan in plans.QUERIES.items():
        if arguments and name not in arguments:
            continue
        started = time.time()
        try:
            if name in plans.ORACLE_SQL:
                good, text = compare(spark, con, plan, plans.ORACLE_SQL[name], sf_dir)
            else:
                good, text = True, f"{len(plan(spark, sf_dir).collect())} rows, no SQL"
        except Exception as error:
            good, text = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if good else 'FAIL'} {name} {time.time() - started:.1f}s {text}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
