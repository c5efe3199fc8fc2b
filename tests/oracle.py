"""Compare queries with their SQL in DuckDB: python tests/oracle.py [folder] [name...]"""

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = """region nation customer supplier part orders lineitem events documents embeddings player_identity injury_consensus_current
player_game_stats player_projection_snapshots player_projection_predictions source_capture source_events dim_game fanduel_players_list mix_targets lang_codes""".split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def plain(x):
    import datetime
    import decimal

    import numpy as np

    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (np.integer, int)):
        return int(x)
    if isinstance(x, (decimal.Decimal, np.floating, float)):
        x = float(x)
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in x)
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r)), sorted(columns)


def same(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return abs(a - b) <= 1e-7 * max(1, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def compare(spark, con, name, f, sql, folder):
    df = f(spark, folder)
    got, gc = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if not sql:
        return f"rows only: {len(got)}"
    cur = con.execute(sql)
    want, wc = rows_of([c[0] for c in cur.description], cur.fetchall())
    if gc != wc:
        return f"DIFFERS: columns {gc} and {wc}"
    if len(got) != len(want):
        return f"DIFFERS: {len(got)} rows and {len(want)}; only here {[x for x in got if x not in want][:2]}, only there {[x for x in want if x not in got][:2]}" if len(got) < 5000 else f"DIFFERS: {len(got)} rows and {len(want)}"
    bad = [(x, y) for x, y in zip(got, want) if not same(x, y)]
    return f"DIFFERS in {len(bad)} rows: {bad[:2]}" if bad else f"same: {len(got)}"


def main(args):
    import __spark_entry__ as e
    from tallyforge.session import local_session

    folder = args[0] if args else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(folder)
    qs, sql = e.queries(), e.oracle_sql()
    bad = 0
    for name in args[1:] or qs:
        began = time.time()
        try:
            said = compare(spark, con, name, qs[name], sql.get(name), folder)
        except Exception:
            said = "FAILED: " + traceback.format_exc()[-1200:]
        bad += said[:4] in ("DIFF", "FAIL")
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
