"""Compare a registered query with its SQL text on the same parquet files."""

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TESTDATA = Path("/root/testdata")


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TESTDATA / sf / name}.parquet'")
    return con


def kind(dtype: str) -> str:
    d = str(dtype).lower()
    for names, label in ((("bigint", "long"), "bigint"), (("int",), "int"), (("double",), "double"), (("float",), "float"),
                         (("varchar", "string"), "string"), (("bool",), "bool"), (("timestamp",), "timestamp"), (("date",), "date")):
        if d in names or any(d.startswith(n) for n in names):
            return label
    return d


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def differences(spark, name: str, sf: str) -> tuple[str, int, float]:
    from __spark_entry__ import oracle_sql, queries
    started = time.time()
    frame = queries()[name](spark, str(TESTDATA / sf))
    rows = frame.collect()
    seconds = time.time() - started
    sql = oracle_sql().get(name)
    if sql is None:
        return "", len(rows), seconds
    result = duck(sf).execute(sql)
    columns = [c[0] for c in result.description]
    kinds = {c[0]: kind(c[1]) for c in result.description}
    expected = result.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} vs {sorted(columns)}", len(rows), seconds
    types = {c: (kind(t), kinds[c]) for c, t in frame.dtypes if kind(t) != kinds[c]}
    if types:
        return f"types (spark, duckdb) {types}", len(rows), seconds
    order = sorted(columns)
    got = sorted((repr([plain(r[c]) for c in order]) for r in rows))
    want = sorted((repr([plain(r[columns.index(c)]) for c in order]) for r in expected))
    if got != want:
        only_got, only_want = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return f"rows {len(got)} vs {len(want)}\n  columns {order}\n  spark only: {only_got}\n  sql only:   {only_want}", len(rows), seconds
    return "", len(rows), seconds


if __name__ == "__main__":
    from corrobora.session import local_session
    sf = sys.argv[1]
    from __spark_entry__ import queries
    names = [n for n in queries() if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    spark = local_session("compare")
    bad = []
    for name in names:
        try:
            problem, count, seconds = differences(spark, name, sf)
        except Exception as exc:  # keep going: the report lists every failing query
            problem, count, seconds = f"{type(exc).__name__}: {str(exc)[:900]}", -1, 0.0
        print(f"{'ok  ' if not problem else 'BAD '} {name} rows={count} {seconds:.1f}s {problem}", flush=True)
        bad += [name] if problem else []
    print("failing:", bad)
