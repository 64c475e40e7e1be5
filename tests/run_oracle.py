"""Run registered queries against their DuckDB oracles (driver-style), print one line each.

Usage: python tests/run_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpuslab.plans.queries import ORACLES, QUERIES  # noqa: E402
from corpuslab.session import build_session  # noqa: E402
from tests.oracle import compare, duck  # noqa: E402

ROUND4 = {"density_shares", "tfidf_top"}


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or list(QUERIES)
    spark = build_session(8)
    con = duck(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = QUERIES[n](spark, sf)
            if n in ORACLES:
                r = compare(df, con, ORACLES[n], 4 if n in ROUND4 else 6)
            else:
                r = {"ok": True, "rows": (df.count(), None), "rows_only": True}
        except Exception as e:  # noqa: BLE001
            r = {"ok": False, "error": repr(e)[:600]}
        bad += not r["ok"]
        print(f"{'OK ' if r['ok'] else 'BAD'} {n:28s} {time.time() - t:6.1f}s {r}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
