"""Compare registered queries with their SQL in DuckDB.

    python tests/oracle_check.py [-d folder] [name or prefix* ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.12g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)
    return [columns[i] for i in order], body


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(df, con, sql):
    spark_side = table_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    sql_side = table_of(names, cur.fetchall())
    if spark_side[0] != sql_side[0]:
        return f"columns {spark_side[0]} != {sql_side[0]}"
    if len(spark_side[1]) != len(sql_side[1]):
        return f"rows {len(spark_side[1])} != {len(sql_side[1])}"
    for a, b in zip(spark_side[1], sql_side[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"first difference\n    spark {a}\n    sql   {b}\n    columns {spark_side[0]}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from tests.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["-d"]:
        sf_dir, argv = argv[1], argv[2:]
    spark = local_session()
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not argv or any(
        n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                built = time.time()
                problem = compare(df, con, oracle[name])
                note = "match"
            else:
                rows = df.collect()
                problem, note = None, f"rows {len(rows)} (no SQL)"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{name:32s} {time.time() - start:6.2f}s  {problem or note}", flush=True)
    print(f"{len(chosen) - bad}/{len(chosen)} good, {sum(n in oracle for n in chosen)} with SQL")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
