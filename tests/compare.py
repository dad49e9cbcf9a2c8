"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else ("n", repr(value + 0.0))
    if isinstance(value, int):
        return ("n", repr(value))
    if isinstance(value, decimal.Decimal):
        return ("d", str(value))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr([cell(row[i]) for i in order]) for row in rows))


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def compare(spark, con, query, sql, sf_dir):
    """None when equal, else a description."""
    df = query(spark, sf_dir)
    got = [tuple(row) for row in df.collect()]
    result = con.sql(sql)
    want_names, want_types = result.columns, [str(t) for t in result.types]
    want = result.fetchall()
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} != {sorted(want_names)}"
    types = {n: KINDS.get(t, t) for n, t in df.dtypes}
    differing = {n: (types[n], t) for n, t in zip(want_names, want_types) if types[n] != t}
    if differing:
        return f"types {differing}"
    a, b = rows_of(df.columns, got), rows_of(want_names, want)
    if a != b:
        extra = [x for x in a if x not in set(b)][:2]
        missing = [x for x in b if x not in set(a)][:2]
        return f"rows {len(a)} vs {len(b)}; only here {str(extra)[:700]}; only there {str(missing)[:700]}"
    return "EMPTY" if not a else None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from rolecall.checks.registry import ORACLES, QUERIES
    from rolecall.session import get_spark
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    from rolecall import checks

    checks.load_all()
    spark = get_spark(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, query in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, query, ORACLES[name], sf_dir)
            else:
                n = query(spark, sf_dir).count()
                problem = None if n else "EMPTY"
                name += f" (rows only: {n})"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)
