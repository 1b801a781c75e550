"""Run a registered query on Spark and its twin on DuckDB and compare the rows."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, float):
        return repr(float(value))
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    return str(value)


def rows_of(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in ordered.astype(object).itertuples(index=False, name=None))


def kinds_of(frame: pd.DataFrame) -> dict[str, str]:
    """Kinds of the columns; what is null throughout has none, and whole numbers with nulls count as floats."""

    def kind(c: str) -> str:
        column = frame[c]
        return "" if len(column) and column.isna().all() else "f" if column.dtype.kind == "i" and column.isna().any() else column.dtype.kind

    return {c: kind(c) for c in sorted(frame.columns)}


def difference(spark_frame: pd.DataFrame, duck_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(duck_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(duck_frame.columns)}"
    spark_frame, duck_frame = spark_frame.copy(), duck_frame.copy()
    for c in spark_frame.columns:
        if {spark_frame[c].dtype.kind, duck_frame[c].dtype.kind} == {"f", "i"}:  # whole numbers with nulls
            spark_frame[c], duck_frame[c] = spark_frame[c].astype(float), duck_frame[c].astype(float)
    left, right = rows_of(spark_frame), rows_of(duck_frame)
    if left != right:
        only_left = [r for r in left if r not in set(right)][:3]
        only_right = [r for r in right if r not in set(left)][:3]
        return f"{len(left)} vs {len(right)} rows; only Spark {only_left}; only DuckDB {only_right}"
    return None
