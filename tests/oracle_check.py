"""Compare registered queries with their oracle SQL, value by value.

    python tests/oracle_check.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


TYPES = {
    "bigint": ("BIGINT", "NUMBER"),
    "int": ("INTEGER", "NUMBER"),
    "double": ("DOUBLE", "NUMBER"),
    "string": ("VARCHAR", "STRING"),
    "date": ("DATE", "DATETIME"),
    "boolean": ("BOOLEAN", "BOOL"),
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        if file.endswith(".parquet"):
            con.execute(f"create view {file[:-8]} as select * from '{sf_dir}/{file}'")
    return con


def canonical(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, pd.Timestamp):
            return str(v.date())
        if isinstance(v, float):
            return v + 0.0
        return str(v) if type(v).__name__ in ("date", "Decimal") else v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql) -> str | None:
    """None when equal, else what differs."""
    mine = [tuple(r) for r in spark_df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    types = dict(zip(names, [str(d[1]).upper() for d in cursor.description]))
    odd = [
        (f.name, f.dataType.simpleString(), types[f.name])
        for f in spark_df.schema
        if types[f.name] not in TYPES[f.dataType.simpleString()]
    ]
    if odd:
        return f"types differ: {odd}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    a, b = canonical(mine, spark_df.columns), canonical(theirs, names)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}"

    return None


def main() -> None:
    from newsignal.session import local_session
    from __spark_entry__ import oracle_sql, queries

    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), oracle_sql()
    failed = 0
    for name, query in queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            if name in sql:
                df = query(spark, sf_dir)
                result = compare(df, con, sql[name]) or f"ok {df.count() if chosen else ''}"
            else:
                result = f"rows only: {query(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001 - report and go on
            result = f"ERROR {type(error).__name__}: {str(error)[:900]}"
        failed += not result.startswith(("ok", "rows"))
        print(f"{name:28s} {time.time() - start:6.1f}s {result}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
