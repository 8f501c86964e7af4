"""Results of Spark and DuckDB as sorted rows, for comparison."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET max_temp_directory_size = '1GB'")
    con.execute("SET temp_directory = '/tmp/duckdb-tests'")
    con.execute("SET timezone = 'UTC'")
    for t in TABLES.split():
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def rows(frame):
    """Sorted rows of a pandas frame, columns by name, floats to 9 digits."""
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if x is None or x is pd.NA or x != x:
            return (0, 0.0)
        if isinstance(x, (bool,)) or type(x).__name__ == "bool_":
            return (1, float(x))
        if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf":
            return (1, float(f"{float(x):.9g}") + 0.0)
        return (2, str(x))

    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None))
