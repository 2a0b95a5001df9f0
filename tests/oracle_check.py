"""Compare registered queries with their SQL in DuckDB: names, row count, values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "~" if math.isnan(value) else f"{value:.6f}"
    if hasattr(value, "item"):
        return _cell(value.item())
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str, build, sql: str) -> str | None:
    """None when equal, else a description of the first difference."""
    result = con.execute(sql)
    expected_columns, expected = _rows([c[0] for c in result.description], result.fetchall())
    df = build(spark, sf_dir)
    columns, rows = _rows(df.columns, [tuple(x) for x in df.collect()])
    if columns != expected_columns:
        return f"columns {sorted(set(columns) ^ set(expected_columns))}"
    if len(rows) != len(expected):
        return f"rows {len(rows)} instead of {len(expected)}"
    different = [(a, b) for a, b in zip(rows, expected) if a != b]
    if different:
        a, b = different[0]
        where = [(c, x, y) for c, x, y in zip(columns, a, b) if x != y]
        return f"{len(different)} rows differ, first: {where}"
    if not rows:
        return "no rows"
    return None


def main() -> None:
    import __spark_entry__ as contract

    from fairlead.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    wanted = sys.argv[1:]
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name, build in contract.queries().items():
        if wanted and name not in wanted:
            continue
        sql = contract.oracle_sql().get(name)
        start = time.time()
        try:
            if sql is None:
                outcome = None if build(spark, sf_dir).count() else "no rows"
                label = "rows only"
            else:
                outcome, label = compare(spark, con, sf_dir, name, build, sql), "equal"
        except Exception as error:  # noqa: BLE001
            outcome, label = f"{type(error).__name__}: {str(error)[:600]}", ""
        bad += outcome is not None
        print(f"{'FAIL' if outcome else 'ok  '} {name:28} {time.time() - start:6.2f}s {outcome or label}", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
