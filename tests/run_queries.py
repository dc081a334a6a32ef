"""Development helper: python tests/run_queries.py [name-part ...] compares queries with their oracles."""

from __future__ import annotations

import os
import sys
import time
import traceback

here = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [here, os.path.dirname(here)]

from compare import connect, differences  # noqa: E402

from tripspark import build_session  # noqa: E402
from tripspark.plans import catalog  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        "compare",
        **{
            "spark.master": "local[8]",
            "spark.driver.memory": "10g",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.sql.session.timeZone": os.environ.get("TEST_TZ", "UTC"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    wanted = sys.argv[1:]
    failed = []
    for name, entry in catalog.load().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = differences(entry, spark, con, sf_dir)
        except Exception:
            problem = traceback.format_exc(limit=-4)[-1500:]
        kind = "oracle" if entry.sql else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.2f}s {kind:6} {name}", flush=True)
        if problem:
            failed.append(name)
            print(problem[:2500], flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
