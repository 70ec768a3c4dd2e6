"""Compare a Spark result with DuckDB's, value by value and type by type."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(table: pa.Table) -> tuple[dict[str, str], list[tuple]]:
    """Types by column name, and the rows in a fixed order."""
    names = sorted(table.column_names)
    kinds = {name: str(table.schema.field(name).type) for name in names}
    columns = [table.column(name).to_pylist() for name in names]
    return kinds, sorted(zip(*columns), key=lambda row: tuple((v is None, str(v)) for v in row))


def differences(spark_table: pa.Table, duck_table: pa.Table) -> list[str]:
    kinds, rows = canonical(spark_table)
    duck_kinds, duck_rows = canonical(duck_table)
    found = []
    if kinds != duck_kinds:
        odd = {
            name: (kinds.get(name), duck_kinds.get(name))
            for name in {*kinds, *duck_kinds}
            if kinds.get(name) != duck_kinds.get(name)
        }
        found.append(f"types {odd}")
    if len(rows) != len(duck_rows):
        found.append(f"rows {len(rows)} and {len(duck_rows)}")
    unequal = [(a, b) for a, b in zip(rows, duck_rows) if a != b]
    if unequal:
        found.append(f"{len(unequal)} unequal rows, first {unequal[0]}")
    return found
