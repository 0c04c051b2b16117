"""Runs registered queries next to their SQL in DuckDB and reports differences.

usage: python tests/oracle_check.py [folder] [name prefix ...]
"""
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def compare(spark, con, folder, name, queries, oracles):
    df = queries[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in oracles:
        return f"rows only ({len(got)})", len(got) > 0
    cur = con.execute(oracles[name])
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", False
    order = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    if got == want:
        return f"ok ({len(got)})", True
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}: {[x for x in got if x not in want][:2]} / {[x for x in want if x not in got][:2]}", False
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} rows differ, e.g. {cols}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}", False


def connect(folder):
    import duckdb
    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return con


def main(argv):
    import __spark_entry__ as entry
    from millrace.session import local_session
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not wanted or any(n.startswith(w) for w in wanted)]
    spark, con = local_session("8"), connect(folder)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            text, good = compare(spark, con, folder, n, queries, oracles)
        except Exception as e:  # noqa: BLE001
            text, good = f"{type(e).__name__}: {str(e)[:600]}", False
        bad += not good
        print(f"{'  ' if good else '! '}{n:38s} {time.time() - t0:6.2f}s {text}", flush=True)
    print(f"{len(names)} queries, {bad} wrong, {sum(n in oracles for n in names)} with SQL")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
