"""Run registered queries against their SQL: ``python tests/check_queries.py SF [name ...]``."""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

import __spark_entry__ as entry  # noqa: E402
from compare import connect, difference  # noqa: E402
from fleetlens.session import local_session  # noqa: E402


def main() -> int:
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem, n = difference(fn(spark, sf_dir), con, oracles[name])
            else:
                problem, n = None, fn(spark, sf_dir).count()
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        mark = "FAIL" if problem else ("ok" if name in oracles else "rows")
        print(f"{mark:4} {name:32} {n:7} rows {time.time() - start:6.2f} s", flush=True)
        if problem:
            bad += 1
            print("    ", problem)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
