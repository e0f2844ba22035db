"""Run queries and their SQL side by side: python -m tests.compare [sf_dir] [names...]"""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, (np.floating, float)):
        return None if np.isnan(v) else float(v)
    if isinstance(v, (np.integer, np.bool_)):
        return v.item()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else what differs first."""
    mine = rows_of(df.columns, df.collect())
    found = con.sql(sql)
    theirs = rows_of(found.columns, found.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}"
    for a, b in zip(mine[1], theirs[1], strict=True):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{str(a)[:600]}\n   != {str(b)[:600]}"
    return None


def main() -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as contract
    from tidewire.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(contract.queries())
    spark = local_session("8")
    con = connect(sf_dir)
    sql = contract.oracle_sql()
    for name in names:
        start = time.time()
        try:
            df = contract.queries()[name](spark, sf_dir)
            if name in sql:
                diff = difference(df, con, sql[name])
            else:
                diff = f"(no SQL) {len(df.collect())} rows"
        except Exception as error:  # report and go on with the next
            diff = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name}: {diff or 'equal'} [{time.time() - start:.1f}s]", flush=True)


if __name__ == "__main__":
    main()
