"""Compare registered queries with their SQL: python tests/check_queries.py [sf_dir] [name prefix ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import connect, difference  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from gradewell.session import build_session  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = build_session(8, "check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    oracles = oracle_sql()
    for name, fn in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                state = "ok" if problem is None else f"DIFF {problem}"
            else:
                state = f"rows {df.count()} (no SQL)"
        except Exception as error:
            state = "FAIL " + str(error)[:1500]
            if "-v" in os.environ.get("CHECK", ""):
                traceback.print_exc()
        bad += not state.startswith(("ok", "rows"))
        print(f"{time.time() - start:6.2f}s {name}: {state}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
