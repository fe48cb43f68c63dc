"""Rows of a Spark query and of its SQL in DuckDB, made comparable."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]

    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v.item() if hasattr(v, "item") else v) for v in r) for r in pdf.itertuples(index=False, name=None))
