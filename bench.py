"""Time every query at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

Each query runs twice and the faster run counts, so that code generation and a cold JVM, which
are the same at any data size, do not hide the work on the data.
"""

from __future__ import annotations

import json
import os
import sys
import time

from adcorpus.plans.catalog import QUERIES
from adcorpus.session import build_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(QUERIES)
    spark = build_session(
        app="adcorpus-bench",
        master=f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        # All columns of all rows are computed; nothing is collected or stored.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {name: round(min(run(name), run(name)), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total wall time of all queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
