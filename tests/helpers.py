"""Compare a registered query with its SQL, as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def oracle(sql: str, sf: str = SF) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con.execute(sql).df()


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or isinstance(x, float) and x != x or x is pd.NaT:
            return None
        if isinstance(x, (bytes, bytearray)):
            return bytes(x).hex()
        if hasattr(x, "item"):
            x = x.item()
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    columns = sorted(df.columns)
    return sorted((tuple(plain(x) for x in r) for r in df[columns].itertuples(index=False)), key=repr)


def same(spark_df, sql: str, sf: str = SF) -> None:
    got, want = spark_df.toPandas(), oracle(sql, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
