"""Run registered queries and their SQL side by side: ``python -m checks.compare [sf_dir] [names...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


SAME_TYPE = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}

LAST_SQL: list[float] = []  # when each SQL statement ended


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def canonical(columns, rows) -> list[tuple]:
    """Rows with columns sorted by name, in a fixed order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None if both give the same rows, else what differs first."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected_rows = cursor.fetchall()
    LAST_SQL.append(time.time())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    types = {c: t for c, t in spark_df.dtypes}
    sql_types = {d[0]: str(d[1]) for d in cursor.description}
    odd = {c: (t, sql_types[c]) for c, t in types.items() if SAME_TYPE.get(t) != sql_types[c]}
    if odd:
        return f"types {odd}"
    got = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    expected = canonical(names, expected_rows)
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}"
    for g, e in zip(got, expected):
        if g != e:
            return f"first difference: {g} != {e}"
    return None if got else "no rows on either side"


def main() -> int:
    from checks.oracle import ORACLE_SQL
    from checks.queries import QUERIES
    from hearsay.session import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = session(
        "compare", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names:
        begin = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            problem = difference(df, con, ORACLE_SQL[name]) if name in ORACLE_SQL else f"rows only: {df.count()}"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None and not problem.startswith("rows only")
        end, sql_end = time.time(), LAST_SQL.pop() if LAST_SQL else begin
        print(f"{name:28s} sql {sql_end - begin:6.1f}s spark {end - sql_end:6.1f}s  {problem or 'equal'}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
