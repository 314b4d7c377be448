"""``spark-submit`` entry: one command per job. ``run`` may be left out."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from dwelltrace.plans.etl import SCANS, run_pipeline
from dwelltrace.plans.incremental import follow_logs, run_incremental
from dwelltrace.plans.maintenance import compact_logs
from dwelltrace.sinks.snapshots import forget as forget_versions
from dwelltrace.sources.config import load_job_config
from dwelltrace.sources.logs import CORRUPT_POLICIES, stream_runtime_events
from dwelltrace.streaming.live_tables import start_live_tables
from dwelltrace.streaming.recorder import start_configured_recorder

COMMANDS = ("run", "update", "follow", "record", "tables", "compact")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="dwelltrace", description="Jobs over activity logs.")
    commands = parser.add_subparsers(dest="command", required=True)

    run = commands.add_parser("run", help="turn all logs into two flat tables")
    run.add_argument("config", help="main configuration file")
    run.add_argument("--scan", choices=SCANS, default="direct")
    run.add_argument("--on-corrupt", choices=CORRUPT_POLICIES, default="file")
    run.add_argument("--drop-ignored", action="store_true", help="leave out rows that a rule flagged")
    run.add_argument("--split-long", action="store_true", help="cut long phone events into pieces")
    run.add_argument("--partition-bytes", type=int, default=512 << 20, help="input bytes per task, at most")
    run.add_argument("--max-records-per-file", type=int, default=0)
    run.add_argument("--partition-by-date", action="store_true", help="one folder per day in both tables")
    run.add_argument("--cluster-by", nargs="*", default=(), metavar="COLUMN", help="lay the active table out in ranges of these")
    run.add_argument("--list-refused", action="store_true", help="write a table of unreadable lines (with --scan staged)")

    update = commands.add_parser("update", help="bring versioned tables up to date: new files and changed rules only")
    update.add_argument("config", help="main configuration file")
    update.add_argument("--on-corrupt", choices=CORRUPT_POLICIES, default="file")
    update.add_argument("--partition-bytes", type=int, default=512 << 20, help="input bytes per task, at most")
    update.add_argument("--keep", type=int, default=0, help="versions to keep; older ones are deleted (0: all)")

    follow = commands.add_parser("follow", help="keep versioned tables up to date from the log folder as logs come")
    follow.add_argument("config", help="main configuration file")
    follow.add_argument("checkpoint")
    follow.add_argument("--once", action="store_true", help="read what is there and end")
    follow.add_argument("--on-corrupt", choices=("line", "drop"), default="line")

    record = commands.add_parser("record", help="log live events, as the configuration says")
    record.add_argument("config", help="main configuration file")
    record.add_argument("events", help="folder in which live events arrive as JSON lines")
    record.add_argument("checkpoint")
    record.add_argument("--once", action="store_true", help="log what is there and end")
    record.add_argument("--on-corrupt", choices=("line", "drop"), default="line")

    tables = commands.add_parser("tables", help="keep both tables up to date from the log folder")
    tables.add_argument("config", help="main configuration file")
    tables.add_argument("active", help="folder of the table of events")
    tables.add_argument("unlock", help="folder of the table of unlocks")
    tables.add_argument("checkpoint")
    tables.add_argument("--once", action="store_true", help="read what is there and end")
    tables.add_argument("--on-corrupt", choices=("line", "drop"), default="line")
    tables.add_argument("--partition-by-date", action="store_true")

    compact = commands.add_parser("compact", help="copy many small logs into few large ones")
    compact.add_argument("source")
    compact.add_argument("target")
    compact.add_argument("--upgrade", action="store_true", help="rewrite legacy events on the way")
    return parser


def main() -> None:
    words = sys.argv[1:]
    if words and words[0] not in (*COMMANDS, "-h", "--help"):
        words = ["run", *words]
    options = vars(_parser().parse_args(words))
    command = options.pop("command")
    # Long rule lists are thousands of small expressions; do not record a call site for each.
    builder = SparkSession.builder.appName("dwelltrace").config("spark.python.sql.dataFrameDebugging.enabled", "false")
    spark = builder.getOrCreate()
    if command == "run":
        outputs = run_pipeline(spark, options.pop("config"), **options)
        print(outputs.active_events)
        print(outputs.unlock_events)
        if outputs.refused_lines:
            print(outputs.refused_lines)
    elif command == "update":
        config, keep = load_job_config(options.pop("config"), spark), options.pop("keep")
        done = run_incremental(spark, config, **options)
        if keep:
            forget_versions(spark, config.output_directory, keep)
        print(f"version {done.version}: {done.files_read} files read, {done.files_dropped} dropped, {done.days_ruled_again} days ruled again")
    elif command == "compact":
        compact_logs(spark, options["source"], options["target"], upgrade=options["upgrade"])
    else:
        config = load_job_config(options["config"], spark)
        if command == "record":
            events = stream_runtime_events(spark, options["events"], on_corrupt=options["on_corrupt"])
            query = start_configured_recorder(
                events, config, checkpoint=options["checkpoint"], once=options["once"], source_folder=options["events"]
            )
        elif command == "follow":
            query = follow_logs(
                spark,
                config.log_directory,
                config.transform.rules,
                config.output_directory,
                checkpoint=options["checkpoint"],
                every_sec=None if options["once"] else config.write_every_sec,
                on_corrupt=options["on_corrupt"],
            )
        else:
            query = start_live_tables(
                spark,
                config.log_directory,
                config.transform.rules,
                options["active"],
                options["unlock"],
                checkpoint=options["checkpoint"],
                output_format=config.output_format,
                every_sec=None if options["once"] else config.write_every_sec,
                on_corrupt=options["on_corrupt"],
                partition_by_date=options["partition_by_date"],
            )
        query.awaitTermination()


if __name__ == "__main__":
    main()
