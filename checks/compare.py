"""Runs registered queries in Spark and their SQL in DuckDB and compares.

    python -m checks.compare [sf_dir] [query ...]
"""

import datetime
import decimal
import sys
import tempfile
import time

import duckdb

from checks.oracles import ORACLES
from checks.registry import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents"
    " embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, name: str, sf_dir: str) -> str | None:
    got = QUERIES[name](spark, sf_dir)
    mine = normal([tuple(r) for r in got.collect()], got.columns)
    answer = con.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    theirs = normal(answer.fetchall(), names)
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} != {sorted(names)}"
    if mine == theirs:
        return None
    extra = [r for r in mine if r not in set(theirs)][:2]
    missing = [r for r in theirs if r not in set(mine)][:2]
    return f"rows {len(mine)} / {len(theirs)}, only Spark {extra}, only SQL {missing}"


def main(argv):
    from postmill.session import local_session, use_scratch

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = use_scratch(local_session(), tempfile.mkdtemp(prefix="postmill-compare-")), connect(sf_dir)
    bad = 0
    for name in argv[1:] or QUERIES:
        if name not in ORACLES:
            print(f"{name}: no SQL, rows {QUERIES[name](spark, sf_dir).count()}", flush=True)
            continue
        start = time.time()
        try:
            problem = differences(spark, con, name, sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {error}"
        bad += problem is not None
        print(f"{name}: {problem or 'same'} ({time.time() - start:.1f} s)"[:700], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
