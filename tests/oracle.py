"""Compare registered queries with their SQL: python tests/oracle.py [name...]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v) + 0.0:.6g}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    """None if equal, else a short text."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    got = canon(tuple(r[n] for n in names) for r in df.collect())
    cur = con.execute(sql)
    found = [d[0] for d in cur.description]
    if sorted(found) != names:
        return f"columns {names} and {sorted(found)}"
    at = [found.index(n) for n in names]
    want = canon(tuple(r[i] for i in at) for r in cur.fetchall())
    if got != want:
        odd = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:3]
        return f"{len(got)} and {len(want)} rows; {odd}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import tabweft.catalogue as c

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    session = SparkSession.builder.master(f"local[{os.environ.get('CPUS', '4')}]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    q, s = c.queries(), c.oracle_sql()
    for name in sys.argv[1:] or q:
        began = time.time()
        try:
            says = compare(session, con, sf, q[name], s[name]) if name in s else f"no SQL, {q[name](session, sf).count()} rows"
        except Exception as e:  # noqa: BLE001
            says = f"{type(e).__name__}: {str(e)[:600]}"
        word = "ok" if says is None else "--" if name not in s and says.startswith("no SQL") else "BAD"
        print(f"{word} {name} {time.time() - began:.1f}s {says or ''}", flush=True)
