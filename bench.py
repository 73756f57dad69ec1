"""Times the queries and prints one JSON line.

Every query runs once to warm up and once timed, its result written to a sink
that keeps nothing.  Queries named on the command line are run alone.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from plumbline import workload  # noqa: E402
from plumbline.session import build_session  # noqa: E402
from plumbline.workload import table  # noqa: E402


def _many_metrics(df):
    """Forty-four metrics of a table: count, nulls and bounds of every column, of texts their lengths."""
    metrics = []
    for c, kind in df.dtypes:
        value = F.length(c) if kind == "string" else F.col(c)
        metrics += [F.count(c), F.count_if(F.col(c).isNull()), F.min(value), F.max(value)]
    return [m.alias(f"m{i}") for i, m in enumerate(metrics)]


def fused_metrics(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.agg(*_many_metrics(df))


def separate_metrics(spark, sf_dir):
    """The same metrics as one job each; gives the last of them to be timed with the rest."""
    df = table(spark, sf_dir, "lineitem")
    *first, last = _many_metrics(df)
    for m in first:
        df.agg(m).write.format("noop").mode("overwrite").save()
    return df.agg(last)


def _timed(run, spark, sf_dir):
    started = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
    )
    spark.sparkContext.setLogLevel("OFF")
    runs = {name: q.run for name, q in workload.load_all().items()}
    runs |= {"metrics_fused": fused_metrics, "metrics_separate": separate_metrics}
    wanted = sys.argv[1:] or list(runs)
    seconds = {}
    for name in wanted:
        if not name.startswith("stream_"):
            _timed(runs[name], spark, sf_dir)
        seconds[name] = _timed(runs[name], spark, sf_dir)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
