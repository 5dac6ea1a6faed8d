"""Run queries against their SQL: ``python -m checks.compare SF_DIR [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb

from checks.oracles import oracle_sql
from checks.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def key(row) -> tuple:
    return tuple((v is None, str(type(v).__name__) if v is None else "", repr(v)) for v in row)


def rows_of(names, rows) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=key)


def compare(spark, con, sf_dir: str, name: str, sql: str | None) -> tuple[bool, str]:
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = f"{len(got)} rows, {time.time() - started:.1f}s"
    if sql is None:
        return len(got) > 0, f"{took}, no SQL"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return False, f"{len(got)} rows, SQL has {len(want)}"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return False, f"{sorted(names)}: {g} != {w}"
    return True, took


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main() -> None:
    from salesloom.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), oracle_sql()
    failed = []
    for name in names or QUERIES:
        try:
            good, note = compare(spark, con, sf_dir, name, sql.get(name))
        except Exception as e:  # noqa: BLE001
            good, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        if not good:
            failed.append(name)
        print("ok  " if good else "FAIL", name, note, flush=True)
    print(len(failed), "failed:", *failed)
    print("SQL without query:", *sorted(set(sql) - set(QUERIES)))


if __name__ == "__main__":
    main()
