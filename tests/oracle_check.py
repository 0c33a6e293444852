"""Run registered queries and their SQL side by side: python tests/oracle_check.py [sf_dir] [name part ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        if math.isnan(v):
            return "null"
        return repr(v + 0.0)
    return repr(v)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty text if both sides agree, else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    left = sorted(tuple(_cell(r[c]) for c in names) for r in df.collect())
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    order = [cols.index(c) for c in names] if sorted(cols) == names else None
    if order is None:
        return f"columns {names} against {sorted(cols)}"
    right = sorted(tuple(_cell(r[i]) for i in order) for r in rel.fetchall())
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    if not left:
        return "both sides are empty"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} of {len(left)} rows differ, first {names}: {bad[0][0]} against {bad[0][1]}" if bad else ""


def main() -> None:
    import __spark_entry__ as entry
    from tabloom.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build_session("oracle-check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, name, query, sql[name], sf_dir)
            else:
                problem = "" if query(spark, sf_dir).count() > 0 else "no rows"
        except Exception as e:  # noqa: BLE001 - reported, the other queries go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.2f}s {name} {problem}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
