"""Run registered queries next to their SQL on the same tables and compare the rows.

    python tests/compare.py FOLDER [NAME ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, list):
        return tuple(_plain(x) for x in value)
    return value


def _sort_key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=_sort_key)


def _same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a Spark result and the SQL's, or None."""
    got = rows_of(spark_df.columns, spark_df.collect())
    answer = con.sql(sql)
    wanted = rows_of(answer.columns, answer.fetchall())
    if sorted(spark_df.columns) != sorted(answer.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(answer.columns)}"
    if len(got) != len(wanted):
        return f"{len(got)} rows, expected {len(wanted)}"
    for g, w in zip(got, wanted):
        if not all(_same(a, b) for a, b in zip(g, w)):
            bad = [i for i, (a, b) in enumerate(zip(g, w)) if not _same(a, b)]
            names = sorted(spark_df.columns)
            return "; ".join(f"{names[i]}: {g[i]!r:.300} != {w[i]!r:.300}" for i in bad[:2])
    return None


def main() -> None:
    import __spark_entry__ as entry
    from caseloom.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session(**{
        "spark.master": "local[8]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in sqls:
                found = difference(df, con, sqls[name])
                rows = df.count()
            else:
                rows, found = len(df.collect()), None
        except Exception as error:  # noqa: BLE001
            found, rows = f"{type(error).__name__}: {str(error)[:1500]}", -1
        kind = "sql " if name in sqls else "rows"
        print(f"{'ok  ' if found is None else 'BAD '} {kind} {name} rows={rows} {time.time() - start:.1f}s {found or ''}", flush=True)
        bad += found is not None
    print("differences:", bad, "sql without query:", set(sqls) - set(entry.queries()))


if __name__ == "__main__":
    main()
