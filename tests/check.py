"""Command-line check: python tests/check.py [sf] [name ...]; names may be module names."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from importlib import import_module  # noqa: E402

from tests.compare import compare, duck  # noqa: E402
from wastelake.catalog import MODULES, load  # noqa: E402
from wastelake.session import local_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    if wanted and all(w in MODULES for w in wanted):
        queries, oracles = {}, {}
        for w in wanted:
            book = import_module(f"wastelake.catalog.{w}").BOOK
            queries.update(book.queries)
            oracles.update(book.oracles)
    else:
        queries, oracles = load()
        if wanted:
            queries = {k: v for k, v in queries.items() if k in wanted}
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name, fn in queries.items():
        t = time.time()
        try:
            if name in oracles:
                diff = compare(spark, con, sf_dir, fn, oracles[name])
            else:
                n = fn(spark, sf_dir).count()
                diff = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            text = str(e).split("JVM stacktrace")[0]
            if "Fatal" in type(e).__name__ or "Internal" in type(e).__name__:
                con = duck(sf_dir)
            diff = f"{type(e).__name__}: {text[:700]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if diff == "both empty" and sf == "0.001":
            diff = None
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {time.time() - t:5.2f}s {name} {'' if name in oracles else '(rows only)'} {diff or ''}", flush=True)
    print(f"{len(queries)} queries, {bad} failing", flush=True)


if __name__ == "__main__":
    main()
