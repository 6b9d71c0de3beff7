"""Side-by-side run of queries and their SQL; a table of differences, if any."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

DUCK_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET enable_progress_bar = false")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _sortable(row):
    return tuple((value is not None, str(type(value)), value) for value in row)


def compare(spark_frame, connection, sql: str) -> list[str]:
    """Problems found: names, types, row count, values (exact, doubles included)."""
    result = connection.execute(sql)
    duck_types = {column[0]: str(column[1]) for column in result.description}
    names = sorted(duck_types)
    spark_types = {name: DUCK_TYPES.get(kind, kind) for name, kind in spark_frame.dtypes}
    if spark_types != duck_types:
        return [f"types {spark_types} / {duck_types}"]
    order = [column[0] for column in result.description]
    expected = sorted(
        (tuple(row[order.index(name)] for name in names) for row in result.fetchall()), key=_sortable
    )
    actual = sorted((tuple(row[name] for name in names) for row in spark_frame.collect()), key=_sortable)
    problems = []
    if len(expected) != len(actual):
        problems.append(f"rows {len(actual)} / {len(expected)}")
    differing = [(a, e) for a, e in zip(actual, expected) if repr(a) != repr(e)]
    problems += [f"{a} / {e}" for a, e in differing[:3]]
    if differing:
        problems.append(f"{len(differing)} rows differ")
    negative_zeros = sum(
        isinstance(v, float) and v == 0 and math.copysign(1, v) < 0 for row in actual for v in row
    )
    if negative_zeros:
        problems.append(f"{negative_zeros} negative zeros")
    return problems


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as contract
    from aislewise.session import build_session

    directory = sys.argv[1]
    session = build_session("parity", master="local[8]", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    connection, statements = duck(directory), contract.oracle_sql()
    for name, query in contract.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        started = time.time()
        frame = query(session, directory)
        problems = compare(frame, connection, statements[name])
        print(f"{name:34} {'ok' if not problems else problems} {time.time() - started:.2f}s", flush=True)
