"""Runs registered queries against DuckDB: ``python -m tests.compare [names or module prefixes]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, decimal.Decimal):
        return ("decimal", value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def duck_rows(con, text):
    cur = con.execute(text)
    columns = [d[0] for d in cur.description]
    names = sorted(columns)
    at = [columns.index(c) for c in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr), dict(zip(columns, [str(d[1]) for d in cur.description]))


FAMILY = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "float": "FLOAT"}


def type_notes(df, duck_types):
    notes = []
    for name, kind in df.dtypes:
        want = FAMILY.get(kind)
        got = duck_types.get(name)
        if want and got and want != got:
            notes.append(f"{name}: spark {kind} duck {got}")
    return notes


def difference(mine, theirs):
    left, right = mine, theirs
    if len(left) != len(right):
        only_l = [r for r in left if r not in set(right)][:3]
        only_r = [r for r in right if r not in set(left)][:3]
        return f"rows {len(left)} vs {len(right)}; only spark {only_l}; only sql {only_r}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, e.g. spark {bad[0][0]} sql {bad[0][1]}"
    return None


def main(argv):
    from tastelake.plans.registry import REGISTRY, load_all
    from tastelake.session import local_session
    from tastelake.sources.views import Views

    folder = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        folder, argv = argv[0], argv[1:]
    load_all()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    failed = []
    for name, entry in REGISTRY.items():
        module = entry.build.__module__.split(".")[-1]
        if argv and name not in argv and module not in argv:
            continue
        start = time.time()
        try:
            df = entry.build(Views(spark, folder))
            names, mine = spark_rows(df)
            spent = time.time() - start
            note = ""
            if entry.check_sql is None:
                verdict = f"rows-only {len(mine)}"
            else:
                d_names, theirs, kinds = duck_rows(con, entry.check_sql)
                if names != d_names:
                    verdict = f"FAIL columns {names} vs {d_names}"
                else:
                    gap = difference(mine, theirs)
                    verdict = f"FAIL {gap}" if gap else f"ok {len(mine)}"
                notes = type_notes(df, kinds)
                if notes:
                    note = f" TYPES {notes}"
            if not mine:
                note += " EMPTY"
        except Exception as problem:  # noqa: BLE001 - report and go on
            spent = time.time() - start
            verdict, note = f"FAIL {type(problem).__name__}: {str(problem)[:700]}", ""
        if verdict.startswith("FAIL") or note:
            failed.append(name)
        print(f"{name:34s} {spent:6.1f}s {time.time() - start - spent:5.1f}s {verdict}{note}", flush=True)
    print("problems:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
