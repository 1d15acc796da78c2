"""Command line: python tests/check.py [sf] [query ...] compares queries with their SQL and times them."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest import make_session  # noqa: E402
from oracle import compare, connect  # noqa: E402

from typeloom.plans.queries import ORACLES, QUERIES  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
names = sys.argv[2:] or list(QUERIES)
sf_dir = f"/root/testdata/sf{sf}"
spark = make_session()
con = connect(sf_dir)
bad = 0
for n in names:
    t = time.time()
    try:
        if n in ORACLES:
            err = compare(spark, con, n, QUERIES[n], ORACLES[n], sf_dir)
        else:
            err = None if QUERIES[n](spark, sf_dir).count() else f"{n}: empty"
    except Exception as e:  # show and go on
        err = f"{n}: {type(e).__name__} {str(e)[:600]}"
    bad += err is not None
    print(f"{'ok ' if err is None else 'BAD'} {n} {time.time() - t:.2f}s{'' if n in ORACLES else ' (no sql)'}", err or "", flush=True)
print(f"{len(names) - bad}/{len(names)} ok")
