"""Times the headline queries on the log derived from $BENCH_SF_DIR and prints one JSON line.

Writing the derived log is set-up and not timed. Each query runs once to warm the JVM up and
then three times; the median counts. Queries that return a table are drained into a sink
that discards rows, so that every column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import dwelltrace as dt
from dwelltrace.operators import rules as R
from dwelltrace.plans.workspace import shared_folder
from dwelltrace.sinks.lines import write_lines
from querybook import catalogue
from querybook.derive import log_root, write_wave

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 3


def rule_list(n: int) -> list[R.Rule]:
    """Rules of the kinds users write: by path, by name, by idle time and tags, by host."""
    kinds = [
        lambda k: R.Rule(
            R.AttributeRegex("processPath", rf"^/(srv|opt)/tool{k}(-[0-9]+)?/"), (R.SetAttribute("category", f"c{k}"),)
        ),
        lambda k: R.Rule(
            R.AttributeRegex("name", f"click{k}|view{k}|sign{k}"), (R.AddTag(f"t{k}"), R.SetAttribute("category", f"n{k}"))
        ),
        lambda k: R.Rule(
            R.And((R.IdleForGreaterThan(300 + k), R.Not(R.HasTag(f"t{k - 1}")))), (R.Ignore(),)
        ),
        lambda k: R.Rule(R.AttributeValue("hostname", f"host{k % 7}"), (R.AddTag(f"h{k}"),)),
    ]
    return [kinds[k % 4](k) for k in range(n)]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp())
        # Call sites for error messages cost several JVM round trips per expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for key, value in dt.recommended_settings().items():
        spark.conf.set(key, value)
    for variant in ("plain", "mixed", "live"):
        log_root(spark, SF_DIR, variant)

    def scan(rules=()):
        return catalogue.active(spark, SF_DIR, rules)

    def many_files() -> str:
        """The derived log a dozen times over, in a hundred files."""
        folder = shared_folder(spark, "bench-many")
        copies = spark.read.text(f"{log_root(spark, SF_DIR)}/devices/*").select("value", F.explode(F.sequence(F.lit(1), F.lit(12))))
        write_lines(copies.repartition(96).select("value"), folder)
        return folder

    many = many_files()
    update_root, update_out = shared_folder(spark, "bench-logs"), shared_folder(spark, "bench-versions")
    for wave in (0, 1):
        write_wave(spark, SF_DIR, wave, f"{update_root}/wave-{wave}")
    update = catalogue._configured(update_root, update_out, rule_list(10))
    dt.run_incremental(spark, update)

    def one_wave_changed() -> None:
        write_wave(spark, SF_DIR, 1, f"{update_root}/wave-1")
        dt.run_incremental(spark, update)

    def parquet():
        dt.write_table(scan(), shared_folder(spark, "bench"), "parquet")

    timed = {
        "scan_to_parquet": parquet,
        "unlock_scan": lambda: drain(catalogue.unlock_events(spark, SF_DIR)),
        "rules_10": lambda: drain(scan(rule_list(10))),
        "rules_80": lambda: drain(scan(rule_list(80))),
        "recorder_batch": lambda: drain(catalogue.QUERIES["recorder_chain"](spark, SF_DIR)),
        "recorder_stream": lambda: drain(catalogue.recorder_stream(spark, SF_DIR)),
        "drop_ignored": lambda: drain(dt.drop_ignored(scan(rule_list(10)))),
        "many_files": lambda: drain(dt.active_events(spark, many, rule_list(10))),
        "split_long_events": lambda: drain(dt.split_long_events(scan(), 7)),
        "compact_logs": lambda: dt.compact_logs(
            spark, log_root(spark, SF_DIR, "mixed"), shared_folder(spark, "bench"), upgrade=True
        ),
        "run_direct": lambda: drain(catalogue.run_active_output(spark, SF_DIR)),
        "update_nothing_new": lambda: dt.run_incremental(spark, update),
        "update_half_rewritten": one_wave_changed,
        "run_csv": lambda: drain(catalogue.run_unlock_output_csv(spark, SF_DIR)),
    }
    seconds = {}
    for name, query in timed.items():
        query()
        laps = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            query()
            laps.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(laps), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    sys.exit(main())
