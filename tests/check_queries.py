"""Compare registered queries with their SQL twins on DuckDB: python -m tests.check_queries [sf_dir] [name ...]"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

SAMPLE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(directory: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in SAMPLE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def canonical(value):
    """One comparable form for equal values of the two engines."""
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        if math.isnan(number):
            return "nan"
        return str(int(value)) if number == int(number) else f"{number:.6g}"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    got_columns = df.columns
    got = rows_of(got_columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    want = rows_of(want_columns, result.fetchall())
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}: spark only {sorted(set(got) - set(want))[:3]}, sql only {sorted(set(want) - set(got))[:3]}"
    if got != want:
        return f"values: spark only {sorted(set(got) - set(want))[:3]}, sql only {sorted(set(want) - set(got))[:3]}"
    return None if got else "EMPTY"


def main(argv: list[str]) -> int:
    from slotwise.plans import registry, catalog  # noqa: F401
    from slotwise.session import local_session

    directory = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        directory, argv = argv[0], argv[1:]
    spark = local_session()
    con = connect(directory)
    bad = 0
    for name, q in registry.QUERIES.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        try:
            df = q.run(spark, directory)
            message = compare(df, con, q.sql) if q.sql else f"no sql, rows={df.count()}"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            message = "ERROR " + str(error).strip()[:600]
        ok = message is None or message.startswith("no sql")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {message or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
