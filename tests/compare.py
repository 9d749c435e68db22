"""Holds queries against their DuckDB SQL on the same parquet tables."""

import math
import sys
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.9g}"
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def difference(df, sql: str, sf_dir: str) -> str:
    """What differs between a DataFrame and the oracle, or an empty string."""
    names, want = oracle_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = {c: i for i, c in enumerate(names)}
    theirs = sorted(tuple(plain(r[at[c]]) for c in order) for r in want)
    if mine == theirs:
        return ""
    a, b = sorted(set(mine) - set(theirs)), sorted(set(theirs) - set(mine))
    return f"rows {len(mine)} and {len(theirs)}; only here {len(a)} {a[:3]}; only there {len(b)} {b[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parent.parent))
    import time

    import __spark_entry__ as e
    from strandline.session import local_session

    sf_dir = sys.argv[1]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[2:] or list(e.queries())
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = e.queries()[n](spark, sf_dir)
            if n in e.oracle_sql():
                said = difference(df, e.oracle_sql()[n], sf_dir) or "equal"
            else:
                said = f"rows only: {df.count()}"
        except Exception as x:
            said = "ERROR " + str(x)[:600]
        bad += not said.startswith(("equal", "rows only"))
        print(f"{n}: {said} ({time.time() - t:.1f} s)", flush=True)
    sys.exit(bad > 0)
