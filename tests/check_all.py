"""Compare every registered query with its twin: python tests/check_all.py [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from metricledger.session import local_session  # noqa: E402
from tests.compare import difference, duck, kinds_of  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    con, twins, failed = duck(sf), entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            got = query(spark, sf).toPandas()
            took = time.time() - start
            if name not in twins:
                print(f"{name:34s} rows-only {len(got)} {took:.2f}s", flush=True)
                continue
            want = con.execute(twins[name]).df()
            problem = difference(got, want)
            note = "" if kinds_of(got) == kinds_of(want) else f"  types {kinds_of(got)} {kinds_of(want)}"
        except Exception as error:
            problem, took, note, got = f"{type(error).__name__}: {str(error)[:600]}", time.time() - start, "", []
        if problem:
            failed.append(name)
        print(f"{name:34s} {'FAIL ' + problem if problem else 'ok'} {len(got)} {took:.2f}s{note}", flush=True)
    print("missing queries for", sorted(set(twins) - set(entry.queries())), "failed", failed)


main()
