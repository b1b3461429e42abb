"""Compare registered queries with their DuckDB text on the given tables.

    python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(_norm(v)) for v in value) + "]"
    return value if value is None else str(value)


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_norm(row[i]) for i in order) for row in data]
    return [columns[i] for i in order], sorted(rows, key=lambda r: tuple("" if v is None else v for v in r))


def _close(a, b) -> bool:
    """Equal, or floats that differ only by how a rounding tie was resolved."""
    if a == b:
        return True
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-9)
    except (TypeError, ValueError):
        return False


def compare(spark, con, sf_dir: str, key: str, fn, sql: str, strict: bool = True) -> str | None:
    """None when both sides agree, else a short description of the difference.

    ``strict`` compares every printed digit, as a hash would.
    """
    frame = fn(spark, sf_dir)
    left = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    right = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    bad = [(a, b) for a, b in zip(left[1], right[1])
           if a != b and (strict or not all(_close(x, y) for x, y in zip(a, b)))]
    if bad:
        return f"{len(bad)} of {len(left[1])} rows differ; {left[0]} spark {bad[0][0]} duckdb {bad[0][1]}"
    return None


def main() -> None:
    from barline import build_session
    from barline.plans import catalog

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for key, fn in catalog.QUERIES.items():
        if args and not any(key == a or (a.endswith("*") and key.startswith(a[:-1])) for a in args):
            continue
        start = time.time()
        try:
            if key in catalog.ORACLES:
                problem = compare(spark, con, sf_dir, key, fn, catalog.ORACLES[key])
                note = "ok"
            else:
                note, problem = f"rows only: {fn(spark, sf_dir).count()}", None
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {key} {time.time() - start:.1f}s {problem or note}", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
