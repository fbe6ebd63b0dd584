"""Comparing a query's rows with DuckDB's."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(df) -> list[tuple]:
    """Rows as texts, columns by name, in an order that does not matter."""
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    # pandas turns whole numbers beside nulls into floats, on one side or on both
    shown = lambda v: "" if v is None else str(int(v)) if isinstance(v, float) and v.is_integer() else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(shown, row)) for row in df.itertuples(index=False))
