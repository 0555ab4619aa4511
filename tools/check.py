"""Local correctness check: every registered query against its DuckDB twin (or its own row check).

usage: python tools/check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from emberwatch.plans import catalog  # noqa: E402
from emberwatch.plans.verify import compare, duck  # noqa: E402
from emberwatch.session import local_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 and sys.argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in sys.argv[1:] if not a.startswith("/")]
    spark = local_session(os.environ.get("CPUS", "8"))
    con = duck(sf)
    good = bad = 0
    for name in sorted(catalog.load_all()):
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            ok, msg = compare(name, spark, sf, con)
        except Exception:
            ok, msg = False, traceback.format_exc()[-2500:]
        good, bad = good + ok, bad + (not ok)
        print(f"{'OK  ' if ok else 'FAIL'} {name}: {msg} {time.time() - t0:.1f}s", flush=True)
    print(f"summary ok={good} bad={bad}")


if __name__ == "__main__":
    main()
