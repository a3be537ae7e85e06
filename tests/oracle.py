"""Run registered queries on Spark and their SQL on DuckDB and compare rows."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str:
    """Empty when both sides agree, otherwise what differs."""
    mine = _rows(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = _rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    types = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    kinds = dict(df.dtypes)
    odd = [
        f"{d[0]}: {kinds[d[0]]} vs {d[1]}"
        for d in cursor.description
        if str(d[1]) in types and types[str(d[1])] != kinds[d[0]] or str(d[1]) == "HUGEINT"
    ]
    if odd:
        return f"types {odd}"
    if mine != theirs:
        return (
            f"rows {sum(mine.values())} vs {sum(theirs.values())}; only here "
            f"{list((mine - theirs).items())[:2]}; only there {list((theirs - mine).items())[:2]}"
        )
    return "" if mine else "no rows on either side"


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from boxloom.session import build_session

    sf_dir = argv[0]
    conf = dict(a.split("=", 1) for a in argv[1:] if "=" in a)
    wanted = [a for a in argv[1:] if "=" not in a]
    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k", **conf},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(run(spark, sf_dir), con, oracles[name])
            else:
                problem = "" if run(spark, sf_dir).count() else "no rows"
        except Exception as exc:  # noqa: BLE001 - a report over all queries
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {problem}", flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
