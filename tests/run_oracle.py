"""Command line check: python tests/run_oracle.py [sf] [name-prefix ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rankspark.session import build_session, drop_cuts  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> int:
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                diff = compare(df, con, oracle[name])
                note = "ok" if diff is None else f"DIFF {diff}"
            else:
                note = f"rows={df.count()} (no oracle)"
        except Exception as e:  # noqa: BLE001
            note = "ERROR " + str(e).split("JVM stacktrace")[0][:700]
        if not (note == "ok" or note.startswith("rows")):
            bad += 1
        drop_cuts(spark)
        print(f"{name:34s} {time.time() - start:6.2f}s {note}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
