"""Stand-alone: compare every registered query against its oracle.

    python tests/run_oracle.py [sf_dir] [key ...]
"""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

import __spark_entry__ as entry  # noqa: E402
from oracle_compare import compare, duck  # noqa: E402

from claimscope.session import local_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or list(entry.queries())
    spark = local_session()
    con = duck(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for k in keys:
        t = time.time()
        if k not in sqls:
            print(f"{k}: no oracle")
            continue
        try:
            ok, msg = compare(spark, con, k, qs[k], sqls[k], sf)
        except Exception as e:  # report and continue
            ok, msg = False, f"{k}: ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(("PASS " if ok else "FAIL ") + msg + f" [{time.time() - t:.1f}s]", flush=True)
    print(f"{len(keys) - bad}/{len(keys)} passed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
