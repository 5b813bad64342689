"""Compare contract queries with their SQL statements on the shared tables.

``python tests/oracle.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _rows(arrow):
    names = sorted(arrow.column_names)
    values = zip(*(arrow[n].to_pylist() for n in names))
    return names, sorted(values, key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when equal, otherwise what differs."""
    import __spark_entry__ as entry

    sql = entry.oracle_sql().get(name)
    got = entry.queries()[name](spark, sf_dir).toArrow()
    if sql is None:
        return None if got.num_rows else "no rows"
    want = con.execute(sql).to_arrow_table()
    types = {n: (str(got.schema.field(n).type), str(want.schema.field(n).type)) for n in got.column_names if n in want.column_names}
    (gn, gr), (wn, wr) = _rows(got), _rows(want)
    if gn != wn:
        return f"columns {gn} != {wn}"
    odd = {n: t for n, t in types.items() if t[0].replace("large_", "") != t[1].replace("large_", "")}
    if odd:
        return f"types {odd}"
    if len(gr) != len(wr):
        return f"rows {len(gr)} != {len(wr)}"
    bad = [(g, w) for g, w in zip(gr, wr) if g != w]
    if not gr:
        return "no rows"
    return f"{len(bad)} of {len(gr)} rows differ, first {bad[0]} in {gn}" if bad else None


if __name__ == "__main__":
    from loudframe.session import local_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session("oracle")
    spark.sparkContext.setLogLevel("OFF")
    con, failed = connect(sf), []
    for query in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            problem = compare(spark, con, query, sf)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {query} {time.time() - start:.1f}s {problem or ''}", flush=True)
        if problem:
            failed.append(query)
    print(len(failed), "failed:", failed)
