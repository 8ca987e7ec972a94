"""Runs registered queries and their SQL side by side: ``python tests/compare.py [--folder F] [names]``."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from terraced.workload.queries import TABLES  # noqa: E402


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _plain(value: object) -> object:
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float, Decimal)):
        number = float(value)
        return (0, "") if math.isnan(number) else (2, f"{number:.9g}")
    return (3, str(value))


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(name: str, spark, con, folder: str) -> str | None:
    df = contract.queries()[name](spark, folder)
    ours = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(contract.oracle_sql()[name])
    types = {d[0]: str(d[1]) for d in result.description}
    theirs = canonical(list(types), result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
    for column, kind in df.dtypes:
        if kinds.get(kind) != types[column]:
            return f"type of {column}: {kind} / {types[column]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} / {len(theirs[1])}"
    for mine, other in zip(ours[1], theirs[1]):
        if mine != other:
            return f"row {mine} / {other}"
    return None


def main() -> None:
    from conftest import make_session

    names = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if names[:1] == ["--folder"]:
        folder, names = names[1], names[2:]
    spark, con = make_session(), duck(folder)
    bad = 0
    for name in contract.queries():
        if (names and name not in names) or name not in contract.oracle_sql():
            continue
        start = time.time()
        try:
            problem = differences(name, spark, con, folder)
        except Exception as error:  # noqa: BLE001 - reported per query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'OK  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"failures {bad}")


if __name__ == "__main__":
    main()
